"""Operator 4: benchmark decontamination by suffix arrays of the training documents.

Documents are cut into shards (slices of Arrow batches). Of each shard a suffix array over
words is built: the positions of its words, sorted by the words that follow. Positions
that no test suffix can match are left out beforehand: those whose first words
begin no window of the benchmark; so are test suffixes whose first words the shard lacks. Every other test suffix is
binary-searched in the shard, which gives all its occurrences; matches are then followed in the item, word by word, as far as they go.

A benchmark of more than BLOCK_BYTES is searched for block after block: one block at a time lies in the driver and is broadcast, and
a task builds its test suffixes once.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import idsets, scratch, words
from .columns import fresh

WINDOW = 13
#: Words by which positions are left out before sorting.
SEED = 3
#: Bytes of benchmark text in one block, about; a longer item is a block's own.
BLOCK_BYTES = 4 << 20
MATCHES = "array<struct<item_id:string,start:bigint,length:bigint,item_start:bigint>>"
_MATCHES = pa.list_(pa.struct([("item_id", pa.string()), ("start", pa.int64()), ("length", pa.int64()), ("item_start", pa.int64())]))


class Suffixes:
    """Test suffixes: each distinct window of ``window`` words of the items (or whole shorter item), as a place in their word hashes ``h``.

    Of suffix g: ``at`` and ``length``; ``item`` and ``offset`` of its occurrences stand from ``first[g]`` to ``first[g + 1]``.
    """

    def __init__(self, names: list[str], texts: list[str], window: int):
        w = words.words_of(pa.RecordBatch.from_pydict({"text": pa.array(texts, pa.string())}), words.ALNUM)
        value, at, item = w.windows(window)
        short = np.flatnonzero((w.count > 0) & (w.count < window))
        value, at, item = np.r_[value, w.whole()[short]], np.r_[at, w.first[:-1][short]], np.r_[item, short]
        length = np.r_[np.full(len(at) - len(short), window), w.count[short]].astype(np.int64)
        order = np.lexsort((at, value))
        value, at, length, item = value[order], at[order], length[order], item[order]
        new = np.flatnonzero(np.r_[np.ones(min(len(value), 1), bool), value[1:] != value[:-1]])
        self.names, self.h, self.window = names, w.hash, window
        self.first = np.r_[new, len(value)]
        self.at, self.length = at[new], length[new]
        self.item, self.offset = item, at - w.first[:-1][item] if len(at) else at
        self.seeds = []
        for n in range(1, SEED + 1):
            which = np.flatnonzero(self.length == n if n < SEED else self.length >= n)
            value = seed(self.h, self.at[which], n)
            order = np.argsort(value, kind="stable")
            self.seeds.append((np.unique(self.h[self.at[which]]), value[order], which[order]))

    def occurrences(self, g: int) -> list[tuple[int, np.ndarray]]:
        """(item, its offsets) of a suffix."""
        item, offset = self.item[self.first[g] : self.first[g + 1]], self.offset[self.first[g] : self.first[g + 1]]
        cut = np.flatnonzero(item[1:] != item[:-1]) + 1
        return [(int(i[0]), o) for i, o in zip(np.split(item, cut), np.split(offset, cut), strict=True)]


def member(held: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Which of ``x`` are in ``held``, which is sorted."""
    if not len(held):
        return np.zeros(len(x), bool)
    return held[np.minimum(np.searchsorted(held, x), len(held) - 1)] == x


def seed(h: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    """A hash of the ``n`` words at each place."""
    with np.errstate(over="ignore"):
        value = h[at].copy()
        for k in range(1, n):
            value = value * np.uint64(0x9E3779B97F4A7C15) + h[at + k]
    return value


def suffix_array(h: np.ndarray, end: np.ndarray, at: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """``at`` in the order of the words that follow (hash order, shorter first), and those words; a text's end counts as word 0.

    h: word hashes; end: for each position in ``at``, where its text ends.
    """
    step = at[:, None] + np.arange(depth)
    rows = np.where(step < end[:, None], h[np.minimum(step, len(h) - 1)], np.uint64(0))
    order = np.lexsort(rows.T[::-1])
    return at[order], rows[order]


def bisect(column: np.ndarray, want: np.ndarray, lo: np.ndarray, hi: np.ndarray, right: bool) -> np.ndarray:
    """For each ``want`` its insertion point in column[lo:hi], which is sorted there."""
    lo, hi = lo.copy(), hi.copy()
    while (live := lo < hi).any():
        mid = (lo + hi) >> 1
        value = column[np.minimum(mid, len(column) - 1)]
        up = (value <= want) if right else (value < want)
        lo = np.where(live & up, mid + 1, lo)
        hi = np.where(live & ~up, mid, hi)
    return lo


def equal_range(rows: np.ndarray, test: Suffixes, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each of the test suffixes the range of sorted ``rows`` that begin with it, by binary search, word after word."""
    lo, hi = np.zeros(len(which), np.int64), np.full(len(which), len(rows), np.int64)
    for d in range(rows.shape[1]):
        live = np.flatnonzero((test.length[which] > d) & (lo < hi))
        if not len(live):
            break
        column, want = np.ascontiguousarray(rows[:, d]), test.h[test.at[which[live]] + d]
        a, b = lo[live], hi[live]
        lo[live], hi[live] = bisect(column, want, a, b, False), bisect(column, want, a, b, True)
    return lo, hi


def search(w: words.Words, test: Suffixes) -> tuple[np.ndarray, np.ndarray]:
    """All occurrences in the shard: (suffix, word position), by position."""
    text_end = np.repeat(w.first[1:], w.count)
    keep, asked = np.zeros(len(w.hash), bool), []
    for n, (firsts, seeds, which) in enumerate(test.seeds, 1):
        m = len(w.hash) - n + 1
        if not len(seeds) or m <= 0:
            continue
        at = np.flatnonzero(member(firsts, w.hash[:m]))
        at = at[at + n <= text_end[at]]
        value = seed(w.hash, at, n)
        found = member(seeds, value)
        keep[at[found]] = True
        asked.append(which[member(np.unique(value[found]), seeds)])
    at = np.flatnonzero(keep)
    if not len(at):
        return np.zeros(0, np.int64), at
    which = np.unique(np.concatenate(asked))
    sa, rows = suffix_array(w.hash, text_end[at], at, test.window)
    lo, hi = equal_range(rows, test, which)
    n = hi - lo
    place = sa[np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo, n)]
    which = np.repeat(which, n)
    order = np.argsort(place, kind="stable")
    return which[order], place[order]


def longest(found: list[tuple[int, int]], test: Suffixes) -> list[tuple[int, int, int, int]]:
    """Of one text's occurrences (suffix, position), by position: (item, start, length, start in the item) of the verbatim matches.

    A match is followed from its first window while the next words of the text are the next words of the item at any of the places
    where the match still holds, so it is the longest that begins there; where it ends, the next begins with the first window beyond.
    """
    out, open_ = [], {}

    def end(item: int) -> None:
        start, last, length, places = open_.pop(item)
        out.append((item, start, last - start + length, int(places[0]) - (last - start)))

    for g, p in found:
        length = int(test.length[g])
        for item, offsets in test.occurrences(g):
            if item in open_:
                start, last, size, places = open_[item]
                on = np.intersect1d(places + 1, offsets, assume_unique=True) if p == last + 1 else offsets[:0]
                if len(on):
                    open_[item] = (start, p, size, on)
                    continue
                end(item)
            open_[item] = (p, p, length, offsets)
    for item in list(open_):
        end(item)
    return sorted(out)


def matches_of(w: words.Words, test: Suffixes) -> dict[int, list[dict]]:
    """The matches of each text that has any."""
    which, at = search(w, test)
    text = np.searchsorted(w.first, at, "right") - 1
    out: dict[int, list[dict]] = {}
    cut = np.flatnonzero(text[1:] != text[:-1]) + 1
    for t, g, p in zip(np.split(text, cut), np.split(which, cut), np.split(at, cut), strict=True):
        if len(t):
            found = longest(list(zip(g.tolist(), (p - w.first[t[0]]).tolist(), strict=True)), test)
            out[int(t[0])] = [{"item_id": test.names[i], "start": a, "length": n, "item_start": b} for i, a, n, b in found]
    return out


def verdict(n_words: int, matches: list[dict]) -> tuple[int, int, str, bool]:
    """n_hit, n_items, items_sha256, contaminated: every hit word lies in a match."""
    n_hit = end = 0
    for a, n in sorted((m["start"], m["length"]) for m in matches):
        n_hit += max(0, a + n - max(a, end))
        end = max(end, a + n)
    items = sorted({m["item_id"] for m in matches})
    return n_hit, len(items), hashlib.sha256(",".join(items).encode()).hexdigest(), n_hit > 0 and 20 * n_hit >= n_words


def blocks(benchmark: DataFrame) -> Iterator[tuple[list[str], list[str], int]]:
    """The benchmark in blocks (ids, texts, number of blocks) of BLOCK_BYTES, one after the other; each block's size is checked here."""
    rows = benchmark.select(F.col("item_id").cast("string").alias("item_id"), F.coalesce("text", F.lit("")).alias("text")).where("item_id is not null")
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = -(-size // BLOCK_BYTES) or 1
    for k in range(n):
        got = (rows.where(F.pmod(F.xxhash64("item_id"), F.lit(n)) == k) if n > 1 else rows).toArrow()
        yield got.column("item_id").to_pylist(), got.column("text").to_pylist(), n


def _searched(docs: DataFrame, block: tuple[list[str], list[str]], window: int, found, schema) -> DataFrame:
    """``found(part, words, matches)`` of every slice, for one block."""
    shared = docs.sparkSession.sparkContext.broadcast(block)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        test = Suffixes(*shared.value, window)
        for batch in batches:
            for part in words.sliced(batch):
                w = words.words_of(part, words.ALNUM)
                yield found(part, w, matches_of(w, test))

    return docs.mapInArrow(run, schema)


def _verdicts(part: pa.RecordBatch, n_words: list[int], matches: list[list[dict]]) -> pa.RecordBatch:
    judged = [verdict(n, m) for n, m in zip(n_words, matches, strict=True)]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.bool_()]
    columns = [pa.array([j[k] for j in judged], kind) for k, kind in enumerate(kinds)]
    return pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(n_words, pa.int64()), *columns, pa.array(matches, _MATCHES)], ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "matches"])


SCHEMA = f"doc_id bigint, n_words bigint, n_hit bigint, n_items bigint, items_sha256 string, contaminated boolean, matches {MATCHES}"


def _by_digest(docs: DataFrame, benchmark: DataFrame, window: int) -> DataFrame:
    """(digest, n_words, matches) of the texts with matches in any block; a text's verdict depends on nothing else."""

    def found(part: pa.RecordBatch, w: words.Words, matches: dict) -> pa.RecordBatch:
        at = sorted(matches)
        return pa.RecordBatch.from_arrays([part.column("digest").take(pa.array(at, pa.int64())), pa.array(w.count[at], pa.int64()), pa.array([matches[t] for t in at], _MATCHES)], ["digest", "n_words", "matches"])

    texts = docs.select(_digest().alias("digest"), "text")
    parts = [scratch.keep(_searched(texts, names_texts[:2], window, found, f"digest string, n_words bigint, matches {MATCHES}").dropDuplicates(["digest"]), "block") for names_texts in blocks(benchmark)]
    every = parts[0]
    for part in parts[1:]:
        every = every.unionByName(part)
    return scratch.keep(every.groupBy("digest").agg(F.max("n_words").alias("n_words"), F.flatten(F.collect_list("matches")).alias("matches")), "matches")


def _digest():
    return F.md5(F.coalesce("text", F.lit("")))


def _one(benchmark: DataFrame) -> tuple[list[str], list[str]] | None:
    """The only block, if there is no other."""
    names, texts, n = next(blocks(benchmark))
    return (names, texts) if n == 1 else None


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """Per row of ``docs``: doc_id, n_words, n_hit, n_items, items_sha256, contaminated, and ``matches``: (item_id, start, length, item_start)
    of the longest verbatim matches with each item and where they are, in words of the document and of the item.

    A word is hit if it lies in a window of ``window`` words that also occurs in an item of the
    benchmark; a shorter item is one window. Null and empty texts have no words and no hits;
    rows with null or repeated ids are judged each by their own text; items without id or words match nothing, ids may be of any type; further
    columns are not read. An empty table gives no rows; an empty benchmark, no hits. The benchmark is taken in blocks of bounded size.
    """
    source = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    block = _one(benchmark)
    if block:
        return _searched(source, block, window, lambda part, w, m: _verdicts(part, w.count.tolist(), [m.get(t, []) for t in range(part.num_rows)]), SCHEMA)
    matches = _by_digest(source, benchmark, window)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in words.sliced(batch):
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("digest"), pa.array(words.words_of(part, words.ALNUM).count, pa.int64())], ["doc_id", "digest", "n_words"])

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield _verdicts(batch, batch.column("n_words").to_pylist(), [m or [] for m in batch.column("matches").to_pylist()])

    counted = source.withColumn("digest", _digest()).mapInArrow(count, "doc_id bigint, digest string, n_words bigint")
    return counted.join(matches.drop("n_words"), "digest", "left").mapInArrow(judge, SCHEMA)


def clean(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """The rows of ``docs`` that are not contaminated, with all their columns (see ``contamination``). Each is judged where it is read; no text is shuffled."""
    block = _one(benchmark)
    if block:
        keep = lambda part, w, m: part.filter(pa.array([not verdict(int(w.count[t]), m.get(t, []))[3] for t in range(part.num_rows)]))
        return _searched(docs, block, window, keep, docs.schema)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = zip(*(batch.column(c).to_pylist() for c in ("digest", "n_words", "matches")), strict=True)
            yield pa.RecordBatch.from_arrays([pa.array([d for d, n, m in rows if verdict(n, m)[3]], pa.string())], [digest])

    (digest,) = fresh(docs, "digest")
    bad = scratch.keep(_by_digest(docs, benchmark, window).mapInArrow(judge, f"{digest} string"), "contaminated")
    return idsets.without(docs.withColumn(digest, _digest()), bad, digest).drop(digest)
