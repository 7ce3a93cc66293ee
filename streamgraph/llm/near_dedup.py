"""Operator 2: near duplicates by fast similarity sketching, banding and exact verification.

Sketch: BINS coordinates. In round i each shingle is thrown into one bin by the round's hash, with a value that
counts earlier rounds as smaller; a bin keeps its smallest value. Rounds go on until no bin is empty, and
from round BINS on all shingles go into one given bin each round, so that 2 BINS rounds fill every coordinate. The number of equal coordinates
is concentrated about the Jaccard similarity as for independent permutations, at the cost of
about one pass for long texts.

Banding: BANDS bands of ROWS coordinates. A pair of similarity 0.75 shares no band with
probability (1 - 0.75^4)^32 < 6e-6. Sets that are equal are one class before; each class is one node.

Verification: in each bucket the class with the smallest document is compared with all others, on full
shingle sets. What then still lies in one bucket and in different components is compared pairwise in
bounded blocks. No pair goes unexamined because a bucket is large.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import idsets, scratch, words
from .components import components

SHINGLE, BINS, BANDS, ROWS = 5, 128, 32, 4
#: Similarity as a fraction.
NUMERATOR, DENOMINATOR = 75, 100
#: Members that one task's group holds when a bucket is compared.
BLOCK = 128
#: Equal coordinates without which a similarity of 0.75 is ruled out: 5.4 standard deviations below its mean of 96.
EQUAL = 70
_EMPTY = np.uint64(2**64 - 1)


def shingle_sets(part: pa.RecordBatch, k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Distinct 64-bit shingle hashes of all texts, sorted within each text, and the texts' bounds in them."""
    w = words.words_of(part, words.SPACED)
    value, _, text = w.windows(k)
    short = np.flatnonzero((w.count > 0) & (w.count < k))
    value, text = np.r_[value, w.whole()[short]], np.r_[text, short]
    order = np.lexsort((value, text))
    value, text = value[order], text[order]
    if len(value):
        new = np.r_[True, (value[1:] != value[:-1]) | (text[1:] != text[:-1])]
        value, text = value[new], text[new]
    return value, np.searchsorted(text, np.arange(part.num_rows + 1))


def sketches(value: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """A row of BINS 32-bit coordinates for each set; those of empty sets mean nothing."""
    n = len(bounds) - 1
    size = np.diff(bounds)
    table = np.full((n, BINS), _EMPTY)
    live = np.flatnonzero(size > 0)
    with np.errstate(over="ignore"):
        for i in range(2 * BINS):
            if not len(live):
                break
            whole = len(live) == n
            owner = np.repeat(live, size[live])
            element = value if whole else value[np.arange(len(owner)) - np.repeat(np.cumsum(size[live]) - size[live], size[live]) + np.repeat(bounds[live], size[live])]
            h = words.mix(element + np.uint64(i + 1) * np.uint64(0x9E3779B97F4A7C15))
            column = (h >> np.uint64(57)).astype(np.int64) if i < BINS else i - BINS
            np.minimum.at(table.reshape(-1), owner * BINS + column, np.uint64(i << 32) | (h & np.uint64(0xFFFFFFFF)))
            live = live[(table[live] == _EMPTY).any(axis=1)]
    return (words.mix(table) >> np.uint64(32)).astype(np.uint32)


def bands(sketch: np.ndarray) -> np.ndarray:
    """BANDS 64-bit keys of each sketch."""
    with np.errstate(over="ignore"):
        rows = sketch.reshape(len(sketch), BANDS, ROWS).astype(np.uint64)
        key = np.broadcast_to(np.arange(BANDS, dtype=np.uint64) + np.uint64(1), rows.shape[:2]).copy()
        for r in range(ROWS):
            key = words.mix(key * np.uint64(0x9E3779B97F4A7C15) + rows[:, :, r])
        return key.view(np.int64)


def _views(column: pa.Array, dtype: type) -> Iterator[np.ndarray]:
    """Each binary as an array, without a copy of the batch."""
    data, bounds = words.binary_buffer(column)
    for a, b in zip(bounds.tolist(), bounds[1:].tolist(), strict=False):
        yield data[a:b].view(dtype)


def _binary(data: np.ndarray, bounds: np.ndarray) -> pa.Array:
    raw = np.ascontiguousarray(data)
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(bounds) - 1, [None, pa.py_buffer((bounds * raw.itemsize).astype(np.int64)), pa.py_buffer(raw)]).cast(pa.binary())


def signed(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, n (set size), fa and fb (a 128-bit fingerprint of the set), sketch (binary) and bands."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in words.sliced(batch):
                value, bounds = shingle_sets(part)
                total = np.zeros((2, len(value) + 1), np.uint64)
                with np.errstate(over="ignore"):
                    np.cumsum(words.mix(value), out=total[0, 1:])
                    np.cumsum(words.mix(value ^ np.uint64(0xA5A5A5A5A5A5A5A5)), out=total[1, 1:])
                    fa, fb = ((t[bounds[1:]] - t[bounds[:-1]]).view(np.int64) for t in total)
                sketch = sketches(value, bounds)
                keys = bands(sketch)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(np.diff(bounds), pa.int64()), pa.array(fa), pa.array(fb), _binary(sketch.reshape(-1), np.arange(part.num_rows + 1) * BINS),
                     pa.ListArray.from_arrays(pa.array(np.arange(part.num_rows + 1, dtype=np.int32) * BANDS), pa.array(keys.reshape(-1)))],
                    ["doc_id", "n", "fa", "fb", "sketch", "bands"],
                )

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(run, "doc_id bigint, n bigint, fa bigint, fb bigint, sketch binary, bands array<bigint>")


def sets(docs: DataFrame) -> DataFrame:
    """(doc_id, shingles): the full set as sorted 64-bit hashes in a binary."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in words.sliced(batch):
                value, bounds = shingle_sets(part)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), _binary(value, bounds)], ["doc_id", "shingles"])

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(run, "doc_id bigint, shingles binary")


def texts_of(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """(doc_id, text), once each, of the documents in ``ids`` (doc_id); no other text is shuffled."""
    ids = scratch.keep(ids.distinct(), "wanted")
    return idsets.within(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text"), ids).dropDuplicates(["doc_id"])


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    """Of two sorted sets: DENOMINATOR * intersection >= NUMERATOR * union."""
    small, large = (a, b) if len(a) <= len(b) else (b, a)
    if DENOMINATOR * len(small) < NUMERATOR * len(large):
        return False
    at = np.searchsorted(large, small)
    common = int((large[np.minimum(at, len(large) - 1)] == small).sum())
    return DENOMINATOR * common >= NUMERATOR * (len(a) + len(b) - common)


def close(a: str, b: str) -> str:
    """SQL: two set sizes can reach the similarity."""
    return f"{DENOMINATOR} * least({a}, {b}) >= {NUMERATOR} * greatest({a}, {b})"


def _met(pairs: DataFrame, payload: DataFrame, measure: Callable[[np.ndarray, np.ndarray], int], dtype: type, least: int) -> DataFrame:
    """(a, b, score) of the pairs whose ``measure`` is at least ``least``. payload: (doc_id, data).

    Each ``a`` meets its ``b`` in chunks of BLOCK about; its data is sent once per chunk, and no task holds more than one chunk's head.
    """
    chunks = scratch.keep(pairs.groupBy("a").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("chunks")), "chunks")
    heads = chunks.select("a", F.col("a").alias("b"), F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"))
    members = pairs.select("a", "b").join(chunks, "a").select("a", "b", F.pmod(F.xxhash64("b"), "chunks").cast("int").alias("chunk"))
    rows = members.union(heads).join(payload.select(F.col("doc_id").alias("b"), "data"), "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, head = None, None
        for batch in batches:
            found = []
            for x, y, c, mine in zip(*(batch.column(k).to_pylist() for k in ("a", "b", "chunk")), _views(batch.column("data"), dtype), strict=True):
                if x == y:
                    key, head = (x, c), mine.copy()
                elif key == (x, c) and (score := measure(head, mine)) >= least:
                    found.append((x, y, score))
            yield pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], pa.int64()) for k in range(3)], ["a", "b", "score"])

    grouped = rows.repartition("a", "chunk").sortWithinPartitions("a", "chunk", F.col("a") != F.col("b"), "b")
    return grouped.mapInArrow(run, "a bigint, b bigint, score bigint")


def possible(pairs: DataFrame, nodes: DataFrame, equal: int = EQUAL) -> DataFrame:
    """Those pairs (a, b) whose sketches leave the similarity possible, with ``score``, the number of equal coordinates."""
    return _met(pairs, nodes.select("doc_id", F.col("sketch").alias("data")), lambda a, b: int((a == b).sum()), np.uint32, equal)


def verified(pairs: DataFrame, docs: DataFrame) -> DataFrame:
    """Those pairs (a, b) whose full sets are similar."""
    pairs = scratch.keep(pairs.select("a", "b"), "pairs")
    ids = pairs.select(F.col("a").alias("doc_id")).union(pairs.select(F.col("b").alias("doc_id")))
    held = scratch.keep(sets(texts_of(docs, ids)), "sets")
    return scratch.keep(_met(pairs, held.select("doc_id", F.col("shingles").alias("data")), lambda a, b: int(similar(a, b)), np.uint64, 1).select("a", "b"), "links")


def leftover(bucket_rows: DataFrame, leaders: DataFrame, labels: DataFrame, nodes: DataFrame, docs: DataFrame, equal: int = EQUAL) -> DataFrame:
    """Links (a, b), verified on full sets, among what shares a bucket but, after the leaders' links, no component.

    A bucket belongs to its leader's component. All members of a component's unsettled buckets that lie
    outside of it are cut into blocks of BLOCK about; each block meets, in chunks, the members inside, and
    every block. So a pair meets once per component, not once per bucket, and a task compares two blocks: by their
    sketches, then by the full sets of those documents alone that a sketch has left. Pairs that don't hold never leave the task.
    """
    named = lambda c, out: labels.select(F.col("id").alias(c), F.col("component").alias(out))
    spread = bucket_rows.join(leaders, "key").join(named("doc_id", "c"), "doc_id", "left").join(named("leader", "lc"), "leader", "left")
    spread = scratch.keep(spread.select("key", "doc_id", "n", F.coalesce("c", "doc_id").alias("c"), F.coalesce("lc", "leader").alias("lc")), "spread")
    out = F.col("c") != F.col("lc")
    state = spread.groupBy("key").agg(F.count_if(out).alias("strays"), F.count_if(~out).alias("mains"), F.min(F.when(out, F.col("c"))).alias("c0"), F.max(F.when(out, F.col("c"))).alias("c1"))
    # settled: no strays, or all of one component and none but the leader, which has met them, in its own
    unsettled = scratch.keep(state.where("strays > 0 and not (c0 = c1 and mains = 1)").select("key"), "unsettled")
    rows = scratch.keep(spread.join(unsettled, "key").select(F.col("lc").alias("key"), "doc_id", "n", "c").distinct(), "open")
    stray = F.col("c") != F.col("key")
    sizes = rows.groupBy("key").agg(F.greatest(F.ceil(F.count_if(stray) / BLOCK), F.lit(1)).cast("int").alias("blocks"), F.greatest(F.ceil(F.count_if(~stray) / BLOCK), F.lit(1)).cast("int").alias("chunks"))
    rows = rows.join(scratch.keep(sizes, "sizes"), "key")
    h, grid = F.xxhash64("doc_id"), lambda n: F.sequence(F.lit(0), n - 1)
    # a group is (key, block, with): with < blocks, another block of strays; from there on a chunk of the component
    main = rows.where(~stray).select("key", "doc_id", "n", "c", F.explode(grid(F.col("blocks"))).alias("block"), (F.col("blocks") + F.pmod(h, "chunks")).cast("int").alias("with"), F.lit(False).alias("left"))
    rows = rows.where(stray).withColumn("own", F.pmod(h, "blocks").cast("int"))
    first = rows.select("key", "doc_id", "n", "c", F.col("own").alias("block"), F.explode(grid(F.col("blocks") + F.col("chunks"))).alias("with"), F.lit(True).alias("left")).where("with >= block")
    second = rows.select("key", "doc_id", "n", "c", F.explode(grid(F.col("blocks"))).alias("block"), F.col("own").alias("with"), F.lit(False).alias("left")).where("with > block")
    groups = scratch.keep(main.unionByName(first).unionByName(second), "groups")
    # sketches first: only documents that some other of their group resembles go on, and only they send their sets
    alike = scratch.keep(_compared(groups.join(nodes.select("doc_id", F.col("sketch").alias("data")), "doc_id"), _alike(equal), GROUP), "alike")
    held = sets(texts_of(docs, alike.select("doc_id"))).join(nodes.select("doc_id", "sketch"), "doc_id")
    held = scratch.keep(held.select("doc_id", F.concat("sketch", "shingles").alias("data")), "sets")
    return _compared(alike.join(held, "doc_id"), _linked(equal), "a bigint, b bigint").distinct()


GROUP = "key bigint, block int, with int, doc_id bigint, n bigint, c bigint, left boolean"


@dataclass
class Member:
    doc_id: int
    n: int
    c: int
    left: bool
    data: bytes


def _sides(held: list[Member]) -> tuple[list[Member], list[Member]]:
    """Those of the group's block, and those that they are compared with; within one block each other."""
    left = [x for x in held if x.left]
    return left, [x for x in held if not x.left] or left


def _compared(groups: DataFrame, compare: Callable[[tuple, list[Member]], list[tuple]], schema: str) -> DataFrame:
    """``compare`` of every group (key, block, with); a task holds one at a time."""
    names = [x.split()[0] for x in schema.split(", ")]

    def batch_of(found: list[tuple]) -> pa.RecordBatch:
        kinds = [pa.bool_() if x.split()[1] == "boolean" else pa.int32() if x.split()[1] == "int" else pa.int64() for x in schema.split(", ")]
        return pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], kind) for k, kind in enumerate(kinds)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, []
        for batch in batches:
            found: list[tuple] = []
            cols = [batch.column(c).to_pylist() for c in ("key", "block", "with", "doc_id", "n", "c", "left")]
            for k, b, w, doc, n, c, left, data in zip(*cols, _views(batch.column("data"), np.uint8), strict=True):
                if (k, b, w) != key:
                    found += compare(key, held) if held else []
                    key, held = (k, b, w), []
                held.append(Member(doc, n, c, left, data.tobytes()))
            yield batch_of(found)
        yield batch_of(compare(key, held) if held else [])

    rows = groups.select(*[x.split()[0] for x in GROUP.split(", ")], "data")
    return rows.repartition("key", "block", "with").sortWithinPartitions("key", "block", "with").mapInArrow(run, schema)


def _resembling(x: Member, right: list[Member], sketches: np.ndarray, ids: np.ndarray, ns: np.ndarray, cs: np.ndarray, equal: int) -> np.ndarray:
    """Which of ``right`` lie in another component and leave the similarity possible, by size and by ``equal`` coordinates."""
    at = np.flatnonzero((cs != x.c) & (ids != x.doc_id) & (DENOMINATOR * np.minimum(ns, x.n) >= NUMERATOR * np.maximum(ns, x.n)))
    return at[(sketches[at] == np.frombuffer(x.data, np.uint32, BINS)).sum(axis=1) >= equal]


def _known(right: list[Member]) -> tuple:
    return np.stack([np.frombuffer(x.data, np.uint32, BINS) for x in right]), *(np.array([getattr(x, k) for x in right]) for k in ("doc_id", "n", "c"))


def _alike(equal: int) -> Callable[[tuple, list[Member]], list[tuple]]:
    """Those members of a group that resemble one that they are compared with. data: the sketch."""

    def compare(key: tuple, held: list[Member]) -> list[tuple]:
        left, right = _sides(held)
        if not left:
            return []
        known, met = _known(right), set()
        for x in left:
            at = _resembling(x, right, *known, equal)
            met |= {(x.doc_id, x.left) for _ in at[:1]} | {(right[k].doc_id, right[k].left) for k in at}
        return [(*key, x.doc_id, x.n, x.c, x.left) for x in held if (x.doc_id, x.left) in met]

    return compare


def _linked(equal: int) -> Callable[[tuple, list[Member]], list[tuple]]:
    """The pairs of a group that are similar by their full sets. data: the sketch and the set."""
    of = lambda x: np.frombuffer(x.data, np.uint64, offset=4 * BINS)

    def compare(key: tuple, held: list[Member]) -> list[tuple]:
        left, right = _sides(held)
        if not left:
            return []
        known, found = _known(right), set()
        for x in left:
            found |= {(min(x.doc_id, right[k].doc_id), max(x.doc_id, right[k].doc_id)) for k in _resembling(x, right, *known, equal) if similar(of(x), of(right[k]))}
        return sorted(found)

    return compare


def across(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """Those pairs (a, b) that lie in different components."""
    of = lambda side: labels.select(F.col("id").alias(side), F.col("component").alias(f"c{side}"))
    named = pairs.join(of("a"), "a", "left").join(of("b"), "b", "left")
    return named.where(F.coalesce("ca", "a") != F.coalesce("cb", "b")).select("a", "b")


def near_duplicates(docs: DataFrame, equal: int = EQUAL) -> DataFrame:
    """Per row of ``docs``: doc_id, n_shingles, component_id (the smallest doc_id reachable by links), kept (doc_id = component_id).

    Null and empty texts, and texts without words, have no shingles, no links, and are kept. Rows that repeat a doc_id
    are the same document and get the same answer if their texts are equal. A row without a
    doc_id has no component (null) and is kept. Other columns are not read; an empty table gives no rows.
    equal: pairs with fewer equal coordinates are not compared exactly (0: every pair that shares a band is).
    """
    all_rows = scratch.keep(signed(docs), "signed")
    known = all_rows.where("n > 0 and doc_id is not null")
    classes = scratch.keep(known.groupBy("fa", "fb").agg(F.min("doc_id").alias("rep"), F.max("n").alias("n")), "classes")
    nodes = scratch.keep(known.join(classes.select(F.col("rep").alias("doc_id"), "fa", "fb"), ["doc_id", "fa", "fb"], "left_semi").dropDuplicates(["doc_id"]).select("doc_id", "n", "sketch", "bands"), "nodes")
    buckets = nodes.select(F.explode("bands").alias("key"), "doc_id", "n")
    leaders = buckets.groupBy("key").agg(F.min(F.struct("doc_id", "n")).alias("first"), F.count("*").alias("size")).where("size > 1")
    leaders = scratch.keep(leaders.select("key", F.col("first.doc_id").alias("leader"), F.col("first.n").alias("ln")), "leaders")
    star = buckets.join(leaders, "key").where("doc_id <> leader").where(close("n", "ln")).select(F.col("leader").alias("a"), F.col("doc_id").alias("b")).distinct()
    near = scratch.keep(possible(scratch.keep(star, "star"), nodes, equal), "near")
    # the nearest leader of each document first: what it joins need not be compared again
    best = near.groupBy("b").agg(F.max_by("a", F.struct("score", -F.col("a"))).alias("a")).select("a", "b")
    links = verified(best, docs)
    labels = components(links)
    rest = scratch.keep(across(near, labels), "across")
    if not rest.isEmpty():
        links = scratch.keep(links.union(verified(rest, docs)), "links")
        labels = components(links)
    more = scratch.keep(leftover(buckets, leaders.select("key", "leader"), labels, nodes, docs, equal), "more")
    if not more.isEmpty():
        labels = components(links.union(more))
    named = classes.join(labels.withColumnRenamed("id", "rep"), "rep", "left").select("fa", "fb", F.coalesce("component", "rep").alias("component"))
    out = all_rows.select("doc_id", "n", "fa", "fb").join(scratch.keep(named, "named"), ["fa", "fb"], "left")
    component = F.when(F.col("n") > 0, F.col("component")).otherwise(F.col("doc_id"))
    component = F.when(F.col("doc_id").isNotNull(), component)
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
