"""Operator 3: repeated passages by a sparse suffix array.

Suffixes are retained only where content selects them: of each window of LENGTH words the leftmost smallest hash of
SEED words is its minimiser, so equal windows retain equal suffixes wherever they occur. A retained
suffix stands for the run of windows whose minimiser it is, and carries their words to its left and right.

Suffixes whose runs are equal are one class, of which the first occurrence is kept by an aggregation; its others are repeats of the whole run. The classes
that share their first SEED words are sorted as suffixes: dealt out by ranges of their first words and sorted within. Neighbours are compared word by
word, to the right and, from the seed, to the left; what they have in common is a match if it is LENGTH words long.

Longest matches to the right are between neighbours, but of three classes the first and the third may have more in common on the left. So windows that no
neighbour has covered, of seeds with three classes or more (or cut apart by the borders of ranges), are compared one by one, by an
aggregation over their hashes. No pairs within a group are ever made.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import idsets, scratch, words
from .columns import fresh

LENGTH, SEED = 50, 16
#: A document: its id, and a hash of its text where ids repeat (else 0).
DOC = ["doc_id", "copy"]


def retained(w: words.Words, length: int = LENGTH, seed: int = SEED) -> tuple[np.ndarray, ...]:
    """Of each retained suffix: the hash of its first words, its text, and its run: the hash, first window, number of windows, and the suffix's place in the first."""
    value, at, text = w.windows(seed)
    span = length - seed + 1
    n_windows = np.maximum(w.count - length + 1, 0)
    total = int(n_windows.sum())
    empty = np.zeros(0, np.int64)
    if not total:
        return (empty,) * 6
    owner = np.repeat(np.arange(len(n_windows)), n_windows)
    begin = w.first[:-1][owner]
    first = np.arange(total) - np.repeat(np.cumsum(n_windows) - n_windows, n_windows) + begin
    seeds = np.maximum(w.count - seed + 1, 0)
    base = np.cumsum(seeds) - seeds  # a text's first seed among all seeds
    best = leftmost_minima(value, span)[first - begin + base[owner]]
    cut = np.flatnonzero(np.r_[True, (best[1:] != best[:-1]) | (owner[1:] != owner[:-1])])
    n = np.diff(np.r_[cut, total])
    run = w.spans(first[cut], first[cut] + n - 1 + length)
    return value[best[cut]].view(np.int64), owner[cut], run.view(np.int64), first[cut] - begin[cut], n, at[best[cut]] - first[cut]


def leftmost_minima(value: np.ndarray, span: int) -> np.ndarray:
    """For each i the position of the leftmost minimum of value[i:i + span] (cut at the end): minima over doubled spans, then two of them that overlap."""
    n = len(value)
    best, width = np.arange(n), 1

    def less(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return np.where(value[b] < value[a], b, a)

    while 2 * width <= span:
        other = np.minimum(np.arange(n) + width, n - 1)
        best = less(best, best[other])
        width *= 2
    other = np.minimum(np.arange(n) + span - width, n - 1)
    return less(best, best[other])


def _documents(docs: DataFrame) -> tuple[DataFrame, bool]:
    """(doc_id, copy, text) of the rows with an id, and whether any id repeats."""
    rows = docs.where("doc_id is not null")
    repeated = not rows.groupBy("doc_id").count().where("count > 1").isEmpty()
    return rows.select(F.col("doc_id").cast("bigint").alias("doc_id"), (F.xxhash64("text") if repeated else F.lit(0).cast("bigint")).alias("copy"), "text"), repeated


def suffixes(texts: DataFrame, length: int) -> DataFrame:
    """(key, run, doc_id, copy, at, n, off): a retained suffix, its run's hash, where the run's windows begin in words of the document, how many they are, and the suffix's place behind ``at``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in words.sliced(batch):
                key, text, whole, at, n, off = retained(words.words_of(part, words.SPACED), length)
                ids = [part.column(c).take(pa.array(text)) for c in DOC]
                yield pa.RecordBatch.from_arrays([pa.array(key, pa.int64()), pa.array(whole, pa.int64()), *ids, *(pa.array(x, pa.int32()) for x in (at, n, off))], ["key", "run", *DOC, "at", "n", "off"])

    return texts.mapInArrow(run, "key bigint, run bigint, doc_id bigint, copy bigint, at int, n int, off int")


def contexts(texts: DataFrame, classes: DataFrame, length: int, repeated: bool) -> DataFrame:
    """``classes`` (key, kinds, doc_id, copy, at, n, off) with ``left`` and ``right``: hashes of the words of their runs before the suffix and from it on, and ``next``: the first word behind the seed."""
    wanted = scratch.keep(classes.groupBy(*DOC).agg(F.collect_list(F.struct("key", "kinds", "at", "n", "off")).alias("runs")), "wanted")  # of one document, so no longer than it
    likely, _ = idsets.split(texts, scratch.keep(wanted.select("doc_id").distinct(), "ids"))
    rows = (likely.dropDuplicates(DOC) if repeated else likely).join(wanted, DOC)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in words.sliced(batch):
                w = words.words_of(part, words.SPACED)
                runs = part.column("runs")
                flat = runs.flatten()
                text = np.repeat(np.arange(part.num_rows), runs.value_lengths().to_numpy())
                at, n, off = (pc.struct_field(flat, c).to_numpy().astype(np.int64) for c in ("at", "n", "off"))
                begin = w.first[:-1][text] + at
                left, right = _binary(w.hash, begin, begin + off), _binary(w.hash, begin + off, begin + n - 1 + length)
                behind = w.hash[np.minimum(begin + off + SEED, len(w.hash) - 1)].view(np.int64) if len(begin) else np.zeros(0, np.int64)
                ids = [part.column(c).take(pa.array(text)) for c in DOC]
                yield pa.RecordBatch.from_arrays([*(pc.struct_field(flat, c) for c in ("key", "kinds")), *ids, *(pc.struct_field(flat, c) for c in ("at", "n", "off")), left, right, pa.array(behind)],
                    ["key", "kinds", *DOC, "at", "n", "off", "left", "right", "next"])

    return rows.mapInArrow(run, "key bigint, kinds bigint, doc_id bigint, copy bigint, at int, n int, off int, left binary, right binary, next bigint")


def _binary(h: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    """h[start:end] of each as a binary."""
    size = ends - starts
    bounds = np.r_[0, np.cumsum(size)]
    data = h[np.arange(bounds[-1]) + np.repeat(starts - bounds[:-1], size)]
    return pa.BinaryArray.from_buffers(pa.binary(), len(size), [None, pa.py_buffer((bounds * 8).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data))])


def _matrix(column: pa.Array, to_the_right: bool) -> tuple[np.ndarray, np.ndarray]:
    """The binaries as rows of words, padded with 0 on the right (or the left), and their sizes."""
    data, bounds = words.binary_buffer(column)
    size = np.diff(bounds) // 8
    width = int(size.max(initial=0))
    places = np.arange(width)
    out = np.zeros((len(size), width), np.uint64)
    out[places >= width - size[:, None] if to_the_right else places < size[:, None]] = data.view(np.uint64)
    return out, size


def _common(m: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Of each row and the next: how many words they have in common from the first on."""
    least = np.minimum(size[1:], size[:-1])
    same = (m[1:] == m[:-1]) & (np.arange(m.shape[1]) < least[:, None])
    return np.where(same.all(axis=1), m.shape[1], same.argmin(axis=1)) if m.shape[1] else least


def compared(rows: pa.RecordBatch, length: int, lo: int, hi: int) -> pa.RecordBatch:
    """Of the sorted suffixes lo to hi, each beside its neighbours: matches with a neighbour that stands before it in the corpus (``window`` null), and windows left open."""
    key, kinds, doc, copy, at, n, off = (rows.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("key", "kinds", *DOC, "at", "n", "off"))
    right, right_size = _matrix(rows.column("right"), False)
    left, left_size = _matrix(rows.column("left"), True)
    same = key[1:] == key[:-1]
    r, l = np.where(same, _common(right, right_size), 0), np.where(same, _common(left[:, ::-1], left_size), 0)  # noqa: E741
    place = np.stack([doc, copy, at + off])
    lower = _before(place[:, :-1], place[:, 1:])  # the first of the two stands before
    out, covered = [], []
    for later, earlier, mine in ((slice(1, None), slice(None, -1), lower), (slice(None, -1), slice(1, None), ~lower)):
        first = np.maximum(-l, -off[later])
        last = np.minimum(r - length, n[later] - 1 - off[later])
        found = np.where(same & mine, np.maximum(last - first + 1, 0), 0)
        a, b = np.zeros(len(key), np.int64), np.zeros(len(key), np.int64)
        a[later], b[later] = np.where(found > 0, first + off[later], 0), np.where(found > 0, first + off[later] + found, 0)
        covered.append((a, b))
        i = np.flatnonzero(found)
        out.append([np.arange(len(key))[later][i], at[later][i] + off[later][i] + first[i], found[i], doc[earlier][i]])
    whole, start, count, source = (np.concatenate([o[k] for o in out]) for k in range(4))
    partner = np.r_[False, same] | np.r_[same, False]
    open_ = np.where((kinds == 2) & partner, 0, n)
    owner = np.repeat(np.arange(len(key)), open_)
    k = np.arange(len(owner)) - np.repeat(np.cumsum(open_) - open_, open_)
    free = np.ones(len(owner), bool)
    for a, b in covered:
        free &= (k < a[owner]) | (k >= b[owner])
    owner, k = owner[free], k[free]
    window = _windows(rows, owner, k, length)
    which = np.r_[whole, owner]
    asked = (which >= lo) & (which < hi)
    null = np.r_[np.ones(len(whole), bool), np.zeros(len(owner), bool)]
    columns = [np.r_[np.zeros(len(whole), np.int64), window], doc[which], copy[which], np.r_[start, at[owner] + k], np.r_[count, np.ones(len(owner), np.int64)], np.r_[source, doc[owner]]]
    return pa.RecordBatch.from_arrays([pa.array(columns[0][asked], mask=null[asked]), *(pa.array(c[asked]) for c in columns[1:])], ["window", *DOC, "at", "n", "source"])


def _before(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Lexicographic order of the columns of two tables of three rows."""
    return (a[0] < b[0]) | (a[0] == b[0]) & ((a[1] < b[1]) | (a[1] == b[1]) & (a[2] < b[2]))


def _windows(rows: pa.RecordBatch, owner: np.ndarray, k: np.ndarray, length: int) -> np.ndarray:
    """Hashes of the k-th windows of some rows."""
    (left, lb), (right, rb) = words.binary_buffer(rows.column("left")), words.binary_buffer(rows.column("right"))
    lb, rb = lb // 8, rb // 8
    flat = np.zeros(lb[-1] + rb[-1], np.uint64)
    flat[np.arange(lb[-1]) + np.repeat(rb[:-1], np.diff(lb))] = left.view(np.uint64)
    flat[np.arange(rb[-1]) + np.repeat(lb[1:], np.diff(rb))] = right.view(np.uint64)
    begin = lb[owner] + rb[owner] + k
    return words.ranges(flat, begin, begin + length).view(np.int64)


def neighbours(suffixes: DataFrame, length: int) -> DataFrame:
    """(window, doc_id, copy, at, n, source): matches of sorted neighbours (window null), and windows that are left to be compared one by one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, lo = None, 0
        for batch in batches:
            if batch.num_rows:
                rows = batch if held is None else pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0]
                yield compared(rows, length, lo, rows.num_rows - 1)
                # the last row waits for the one behind it; the one before it, which is done, goes along
                held, lo = rows.slice(max(rows.num_rows - 2, 0)), min(rows.num_rows, 2) - 1
        if held is not None:
            yield compared(held, length, held.num_rows - 1, held.num_rows)

    order = ["key", "next", "right", *DOC, "at"]
    ranged = suffixes.repartitionByRange("key", "next", *DOC).sortWithinPartitions(*order)
    return ranged.mapInArrow(run, "window bigint, doc_id bigint, copy bigint, at bigint, n bigint, source bigint")


def _found(docs: DataFrame, length: int) -> DataFrame:
    """Runs of windows that occur before: (doc_id, copy, at, n, source)."""
    texts, repeated = _documents(docs)
    held = suffixes(texts, length)
    held = scratch.keep(held.dropDuplicates([*DOC, "at"]) if repeated else held, "suffixes")
    runs = held.groupBy("key", "run").agg(F.min(F.struct(*DOC, "at")).alias("first"), F.max("n").alias("n"), F.max("off").alias("off"), F.count("*").alias("copies"))
    runs = scratch.keep(runs.select("key", "run", "first.*", "n", "off", "copies"), "runs")
    seeds = scratch.keep(runs.groupBy("key").agg(F.count("*").alias("kinds")).where("kinds > 1"), "seeds")
    mixed = runs.join(seeds, "key").select("key", "kinds", *DOC, "at", "n", "off")
    first = F.struct(*DOC, "at")
    copied = scratch.keep(runs.where("copies > 1").select("key", "run", first.alias("first")), "copied")
    whole = held.join(copied, ["key", "run"]).where(first != F.col("first")).select(*DOC, "at", "n", F.col("first.doc_id").alias("source"))
    found = scratch.keep(neighbours(scratch.keep(contexts(texts, mixed, length, repeated), "contexts"), length), "neighbours")
    windows = found.where("window is not null")
    firsts = windows.groupBy("window").agg(F.min(first).alias("first"), F.count("*").alias("copies")).where("copies > 1")
    parts = windows.join(scratch.keep(firsts.select("window", "first"), "firsts"), "window").where(first != F.col("first"))
    parts = parts.select(*DOC, "at", "n", F.col("first.doc_id").alias("source"))
    return whole.unionByName(found.where("window is null").drop("window")).unionByName(parts)


SPANS = "doc_id bigint, copy bigint, start bigint, n_words bigint, source_doc_id bigint"


def repeated_spans(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """Maximal spans of words that lie in a window of ``length`` words which occurs before: doc_id, copy, start, n_words, source_doc_id.

    "Before" goes by doc_id, then by copy and position, so the first occurrence of a passage is never in
    the result; ``source_doc_id`` is the smallest of the documents that were found to hold a part of the span before. Words are
    lower-cased (A-Z); white space does not matter. Null, empty and short texts give no rows, nor do rows without a doc_id.
    Rows that repeat a doc_id with other texts are documents of their own, told apart by ``copy``, a hash of the text (0
    where no id repeats); rows that repeat both are one document. Other columns are not read; an empty table gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_ = None
        for batch in batches:
            out = []
            for doc, copy, at, n, source in zip(*(batch.column(c).to_pylist() for c in (*DOC, "at", "n", "source")), strict=True):
                end = at + n - 1 + length
                if open_ and open_[:2] == [doc, copy] and at <= open_[3]:
                    open_[3], open_[4] = max(open_[3], end), min(open_[4], source)
                else:
                    if open_:
                        out.append(open_)
                    open_ = [doc, copy, at, end, source]
            yield _spans(out)
        yield _spans([open_] if open_ else [])

    rows = _found(docs, length).repartition(*DOC).sortWithinPartitions(*DOC, "at", F.desc("n"))
    return rows.mapInArrow(run, SPANS)


def _spans(rows: list[list[int]]) -> pa.RecordBatch:
    columns = [[r[0] for r in rows], [r[1] for r in rows], [r[2] for r in rows], [r[3] - r[2] for r in rows], [r[4] for r in rows]]
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], [x.split()[0] for x in SPANS.split(", ")])


def without_repeats(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """``docs`` with the repeated spans cut out of ``text``, ``n_chars`` set anew, and rows left out of which nothing but white space remains.

    Texts without repeated spans stay as they are, null and empty ones included, and so do rows without an id. Rows that
    repeat an id are cut each by the spans of their own text. Texts that may have spans alone are shuffled, to meet them.
    """
    spans = scratch.keep(repeated_spans(docs, length), "spans")
    name, copy = fresh(docs, "spans", "copy")
    spans = spans.groupBy(*DOC).agg(F.collect_list(F.struct("start", "n_words")).alias(name)).withColumnRenamed("copy", copy)  # of one document
    spans = scratch.keep(spans, "cuts")
    likely, rest = idsets.split(docs, scratch.keep(spans.select("doc_id").distinct(), "cut"))
    # copy is 0 for all spans, or the text's hash for all of them
    likely = likely.withColumn(copy, F.xxhash64("text")) if not spans.where(F.col(copy) != 0).isEmpty() else likely.withColumn(copy, F.lit(0).cast("bigint"))
    marked = likely.join(spans, ["doc_id", copy], "left").select(*docs.columns, name)

    def cut(part: pa.RecordBatch) -> pa.RecordBatch:
        """Rows that have spans, without them."""
        w = words.words_of(part, words.SPACED)
        data = w.data.tobytes()
        texts = []
        for i, spans in enumerate(part.column(name).to_pylist()):
            at, kept, base = int(w.offsets[i]), [], int(w.first[i])
            for s in sorted(spans, key=lambda x: x["start"]):
                a, b = base + s["start"], base + s["start"] + s["n_words"]
                kept.append(data[at : int(w.start[a])])
                at = int(w.start[b]) if b < w.first[i + 1] else int(w.offsets[i + 1])
            kept.append(data[at : int(w.offsets[i + 1])])
            texts.append(b"".join(kept).decode())
        part = _put(part, "text", pa.array(texts, pa.string()))
        if "n_chars" in part.schema.names:
            part = _put(part, "n_chars", pa.array(map(len, texts), pa.int64()))
        return part.filter(pa.array([bool(t.strip()) for t in texts]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            touched = pc.is_valid(batch.column(name))
            yield batch.filter(pc.invert(touched)).drop_columns([name])
            for part in words.sliced(batch.filter(touched)):
                yield cut(part).drop_columns([name])

    return rest.unionByName(marked.mapInArrow(run, docs.schema))


def _put(part: pa.RecordBatch, name: str, values: pa.Array) -> pa.RecordBatch:
    at = part.schema.get_field_index(name)
    return part.set_column(at, name, values.cast(part.schema.field(at).type))
