"""Operator 5: lexical retrieval packing.

Documents are dealt by content: each takes two of its words, drawn with weights that grow with
rarity by a hash that all documents share, so that two documents draw the same ones the likelier the more
rare words they have in common. Documents of a word go to one partition, a large partition to several, and
are sorted there; runs of them are the shards, each with its own BM25 inverted index. So a seed's
neighbours stand in its own shard or the next, wherever the tables had them. Each window of a shard is filled greedily: the document that begins it is the seed, and the index
returns the unused documents nearest to it, best first, until the window is full. The last of
them is cut there; what is left of it begins, and so seeds, the next window. A window that a shard leaves open keeps its seed, for which the next
shard of the partition is asked, so only a partition's end is short of a window; it becomes sequences of
powers of two, which need no padding.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bpe, words

WINDOW, END_ID = 2048, 1
#: Bytes of text in a shard, about; asking costs a seed time in proportion to its shard.
SHARD_BYTES = 3 << 19
#: Bytes of the table in a partition of the deal, about, where the session's number of shuffle partitions would make larger ones.
DEAL_BYTES = 64 << 20
#: Spark gives tables of unknown size a size above this.
UNKNOWN = 1 << 60
#: Words are counted for their rarity in so many cells (a power of two) of 8 bytes a worker.
CELLS = 1 << 18
K1, B = 1.2, 0.75
PIECES = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint"


class Index:
    """BM25 over the words (lower-cased) of one shard."""

    def __init__(self, w: words.Words):
        n = len(w.count)
        text = np.repeat(np.arange(n), w.count)
        self.terms, term = np.unique(w.hash, return_inverse=True)
        pair, tf = np.unique(term * n + text, return_counts=True) if len(term) else (np.zeros(0, np.int64),) * 2
        self.term, self.doc = pair // max(n, 1), pair % max(n, 1)
        df = np.bincount(self.term, minlength=len(self.terms))
        self.first = np.r_[0, np.cumsum(df)]
        idf = np.log1p((n - df + 0.5) / (df + 0.5))
        norm = K1 * (1 - B + B * w.count / max(w.count.mean() if n else 1, 1e-9))
        self.weight = idf[self.term] * tf * (K1 + 1) / (tf + norm[self.doc])
        order = np.argsort(self.doc, kind="stable")
        self.of_doc, self.at = self.term[order], np.searchsorted(self.doc[order], np.arange(n + 1))
        self.n = n

    def words(self, doc: int) -> np.ndarray:
        """The distinct words of a document, as hashes: a query for any shard."""
        return self.terms[self.of_doc[self.at[doc] : self.at[doc + 1]]]

    def scores(self, query: np.ndarray) -> np.ndarray:
        """BM25 of every document of this shard for the words of a query."""
        t = np.searchsorted(self.terms, query)
        t = t[t < len(self.terms)][self.terms[t[t < len(self.terms)]] == query[t < len(self.terms)]]
        begin, size = self.first[t], self.first[t + 1] - self.first[t]
        where = np.arange(size.sum()) + np.repeat(begin - np.cumsum(size) + size, size)
        return np.bincount(self.doc[where], self.weight[where], self.n)


class Draw:
    """Draws two words of each text; a worker counts the words it has met, so that rare ones are likelier."""

    def __init__(self):
        self.met, self.texts = np.zeros(CELLS, np.int64), 0

    def words(self, w: words.Words) -> tuple[np.ndarray, np.ndarray]:
        """Of each text, the hashes of the words drawn first and second; 0 where it has none."""
        cell = (w.hash % words.U(CELLS)).astype(np.int64)
        self.met += np.bincount(cell, minlength=CELLS)
        self.texts += len(w.count)
        even = ((words.mix(w.hash) >> words.U(11)).astype(np.float64) + 1) / 2.0**53
        rank = -np.log(even) / np.log1p(self.texts / self.met[cell])  # the least of exponential numbers falls on a word in proportion to its weight
        full = np.flatnonzero(w.count)
        drawn = []
        for _ in range(2):
            found = np.zeros(len(w.count), np.uint64)
            if len(full):
                least = np.repeat(np.minimum.reduceat(rank, w.first[:-1][full]), w.count[full])
                hit = np.flatnonzero((rank == least) & np.isfinite(rank))
                found[np.searchsorted(w.first, hit, "right") - 1] = w.hash[hit]
                rank[hit] = np.inf
            drawn.append(found.view(np.int64))
        return drawn[0], drawn[1]


def deal(docs: DataFrame) -> DataFrame:
    """doc_id and text of all rows, those that drew the same words side by side.

    Rebalancing splits a partition that one word makes large by the sizes that were written, so no share of
    rows under one word makes a long task. The order is total but for rows that are equal, so a task that
    runs again sees the same.
    """
    leaves = docs._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = [int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size())]
    parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), sum(s for s in sizes if s < UNKNOWN) // DEAL_BYTES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        draw = Draw()
        for batch in batches:
            for part in words.sliced(batch):
                first, second = draw.words(words.words_of(part, words.ALNUM))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(first), pa.array(second)], ["doc_id", "text", "first", "second"])

    drawn = docs.mapInArrow(run, "doc_id bigint, text string, first bigint, second bigint")
    return drawn.hint("rebalance", parts, F.col("first")).sortWithinPartitions("first", "second", "doc_id", "text").select("doc_id", "text")


class Packer:
    """Fills windows across the shards of one partition."""

    def __init__(self, window: int, first_sequence: int):
        self.window, self.sequence, self.used = window, first_sequence, 0
        self.open: list[list] = []
        self.seed: np.ndarray | None = None  # the words of the document that began the open window

    def put(self, doc: object, ids: np.ndarray, done: list[list]) -> bool:
        """Lay down a whole document; True if it ran over the end of a window. Full windows go to ``done``."""
        start, over = 0, False
        while start < len(ids):
            n = min(len(ids) - start, self.window - self.used)
            piece = ids[start : start + n]
            self.open.append([doc, start, n, zlib.crc32(np.ascontiguousarray(piece, "<u4")), len(ids), self.sequence, self.used, piece])
            start, self.used = start + n, self.used + n
            if self.used == self.window:
                done += self.open
                self.open, self.used, self.sequence, over = [], 0, self.sequence + 1, start < len(ids)
        return over

    def close(self) -> list[list]:
        """The open window as sequences of powers of two."""
        out, size = [], 0
        for doc, begin, n, _, total, _, _, ids in self.open:
            at = 0
            while at < n:
                if not size:
                    size, filled = 1 << (self.used.bit_length() - 1), 0
                k = min(n - at, size - filled)
                out.append([doc, begin + at, k, zlib.crc32(np.ascontiguousarray(ids[at : at + k], "<u4")), total, self.sequence, filled, ids[at : at + k]])
                at, filled, self.used = at + k, filled + k, self.used - k
                if filled == size:
                    size, self.sequence = 0, self.sequence + 1
        self.open = []
        return out


def order(index: Index, packer: Packer, docs: list, ids: list[np.ndarray]) -> list[list]:
    """Lay down all documents of a shard, the unused one nearest to the open window's seed first; the rows of full windows. Equal scores go by place."""
    done: list[list] = []
    unused = np.ones(len(docs), bool)
    near, at = None, 0
    for _ in range(len(docs)):
        if packer.seed is None:
            while not unused[at]:
                at += 1
            pick, packer.seed, near = at, index.words(at), None
        else:
            if near is None:
                near = np.where(unused, index.scores(packer.seed), -1.0)
            pick = int(near.argmax())
        unused[pick] = False
        if near is not None:
            near[pick] = -1.0
        if packer.put(docs[pick], ids[pick], done):  # its rest has begun the next window
            packer.seed, near = index.words(pick), None
        elif not packer.used:
            packer.seed, near = None, None
    return done


def encoded(enc: bpe.Texts, texts: pa.Array, end_id: int) -> list[np.ndarray]:
    """The ids of each text, and the end's."""
    flat, at = enc.batch(*words.text_buffer(texts))
    return np.split(np.insert(flat, at[1:], end_id), at[1:-1] + np.arange(1, len(at) - 1))


def pack(docs: DataFrame, tokenizer: str, window: int = WINDOW, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, and with ``with_ids`` its ``ids``.

    A document is the ids of its text and ``end_id``; null and empty texts are that id alone. Each id lies in one piece.
    Repeated ids and repeated rows are documents of their own, null ids are carried; other columns are not read; an empty table gives no rows. A sequence_id
    is the partition's number and a count, so a task that runs again gives the same rows. A worker holds one shard and its ids.
    """
    fields = PIECES + (", ids array<int>" if with_ids else "")

    def rows(found: list[list]) -> pa.RecordBatch:
        columns = list(zip(*found, strict=True)) if found else [[]] * 8
        made = [pa.array(c, pa.int64()) for c in columns[:7]]
        names = [x.split()[0] for x in fields.split(", ")]
        return pa.RecordBatch.from_arrays([*made, *([pa.array([x.astype(np.int32) for x in columns[7]], pa.list_(pa.int32()))] if with_ids else [])], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = bpe.opened(tokenizer)
        packer = Packer(window, TaskContext.get().partitionId() << 40)
        for batch in batches:
            for part in words.sliced(batch, limit=SHARD_BYTES):
                ids = encoded(enc, part.column("text"), end_id)
                yield rows(order(Index(words.words_of(part, words.ALNUM)), packer, part.column("doc_id").to_pylist(), ids))
        yield rows(packer.close())

    return deal(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")).mapInArrow(run, fields)
