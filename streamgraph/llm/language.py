"""Operator 8: language identification by language-bitmask n-gram filters.

Training: of a bounded sample of labelled documents, the character 4-grams (of UTF-8 bytes,
letters only) that most documents of a language hold. They go into bit-sliced Bloom filters: each slot
holds one bit per language, so the slots of an n-gram, AND-ed, give all languages that have it.
Prediction: every n-gram of a text is looked up; the popcounts per language, corrected for
each filter's false positives, decide.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import words

#: Labelled documents taken per language (about), n-grams kept per language, filter slots per n-gram, lookups.
TRAIN_DOCS, GRAMS, SLOTS, LOOKUPS = 4000, 12_000, 16, 2
#: A language with fewer labelled documents keeps n-grams that only one of them holds.
FEW_DOCS = 20
GRAM = 4
_FOLD = np.array([b if b >= 0x80 or 97 <= b <= 122 else b + 32 if 65 <= b <= 90 else 32 for b in range(256)], np.uint8)
_SEEDS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93], np.uint64)


def held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string")) % 4 == 2


def grams(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of all 4-grams in the texts: value and text; then per text, whether it has an ASCII letter and any byte above ASCII.

    Runs of what is no letter count as one space; every text begins and ends with one.
    """
    data, offsets = words.text_buffer(pc.utf8_lower(pc.fill_null(column.cast(pa.large_string()), "")))
    folded = _FOLD[data]
    text = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    keep = np.ones(len(folded), bool)
    if len(folded):
        keep[1:] = (folded[1:] != 32) | (folded[:-1] != 32) | (text[1:] != text[:-1])
    letters = np.zeros(len(folded) + 1, np.int64)
    np.cumsum(folded != 32, out=letters[1:])
    high = np.zeros(len(folded) + 1, np.int64)
    np.cumsum(folded >= 0x80, out=high[1:])
    has_high = high[offsets[1:]] > high[offsets[:-1]]
    has_ascii = (letters[offsets[1:]] - letters[offsets[:-1]]) > (high[offsets[1:]] - high[offsets[:-1]])
    folded, text = folded[keep], text[keep]
    n = np.bincount(text, minlength=len(offsets) - 1)
    out = np.full(len(folded) + 2 * len(n), 32, np.uint8)
    out[np.arange(len(folded)) + 2 * text + 1] = folded
    owner = np.repeat(np.arange(len(n)), n + 2)
    value = np.zeros(max(len(out) - GRAM + 1, 0), np.uint32)
    for k in range(GRAM):
        value |= out[k : len(value) + k].astype(np.uint32) << np.uint32(8 * k)
    inside = owner[: len(value)] == owner[GRAM - 1 :] if len(value) else np.zeros(0, bool)
    return value[inside], owner[: len(value)][inside], has_ascii, has_high


def slots(value: np.ndarray, bits: int) -> list[np.ndarray]:
    with np.errstate(over="ignore"):
        return [(words.mix(value.astype(np.uint64) * s) >> np.uint64(64 - bits)).astype(np.int64) for s in _SEEDS[:LOOKUPS]]


@dataclass
class Model:
    """``planes[p]``: a slot's bits for languages 8p to 8p + 7; ``false[l]``: the rate at which language l takes an n-gram that it hasn't."""

    languages: list[str]
    bits: int
    planes: list[np.ndarray]
    false: np.ndarray

    @classmethod
    def of(cls, languages: list[str], found: list[np.ndarray]) -> Model:
        bits = max(10, int(np.ceil(np.log2(SLOTS * max([1, *map(len, found)])))))
        planes = [np.zeros(1 << bits, np.uint8) for _ in range(0, max(len(languages), 1), 8)]
        for k, values in enumerate(found):
            for at in slots(values, bits):
                planes[k // 8][at] |= np.uint8(1 << (k % 8))
        false = [((planes[k // 8] >> np.uint8(k % 8)) & 1).mean() ** LOOKUPS for k in range(len(languages))]
        return cls(languages, bits, planes, np.array(false))

    def hits(self, value: np.ndarray, text: np.ndarray, n_texts: int) -> np.ndarray:
        """Per text and language the n-grams that the language has, corrected for false positives."""
        total = np.bincount(text, minlength=n_texts).astype(float)
        at = slots(value, self.bits)
        counts = np.zeros((n_texts, 8 * len(self.planes)))
        bit = ((np.arange(256)[:, None] >> np.arange(8)) & 1).astype(float)
        for p, plane in enumerate(self.planes):
            mask = plane[at[0]]
            for more in at[1:]:
                mask = mask & plane[more]
            counts[:, 8 * p : 8 * p + 8] = np.bincount(text * 256 + mask, minlength=256 * n_texts).reshape(n_texts, 256) @ bit
        counts = counts[:, : len(self.languages)]
        return np.maximum(0, (counts - total[:, None] * self.false) / (1 - self.false))


def train(labelled: DataFrame, train_docs: int = TRAIN_DOCS, n_grams: int = GRAMS) -> Model:
    """Fit on rows of (doc_id, text, lang): about ``train_docs`` of each language, chosen by a hash of doc_id; the bound is that parameter."""
    known = labelled.where("lang is not null and doc_id is not null")
    counts = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    languages = sorted(counts)
    if not languages:
        return Model.of([], [])
    share = F.create_map(*[F.lit(x) for k in languages for x in (k, min(1.0, train_docs / counts[k]))])
    number = F.create_map(*[F.lit(x) for i, k in enumerate(languages) for x in (k, i)])
    chosen = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < share[F.col("lang")] * 1_000_000)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in words.sliced(batch):
                value, text, *_ = grams(part.column("text"))
                lang = part.column("lang").to_numpy(zero_copy_only=False).astype(np.int64)
                once = np.unique(text.astype(np.uint64) << np.uint64(32) | value)  # a text counts once
                key = lang[(once >> np.uint64(32)).astype(np.int64)] << 32 | (once & np.uint64(0xFFFFFFFF)).astype(np.int64)
                key, n = np.unique(key, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(n, pa.int64())], ["key", "n"])

    held = chosen.select(number[F.col("lang")].cast("bigint").alias("lang"), "text").mapInArrow(count, "key bigint, n bigint")
    held = held.groupBy("key").agg(F.sum("n").alias("n")).withColumn("lang", F.shiftright("key", 32))
    held = held.where((F.col("n") >= 2) | F.col("lang").isin([i for i, k in enumerate(languages) if counts[k] < FEW_DOCS]))
    best = Window.partitionBy("lang").orderBy(F.desc("n"), "key")
    top = held.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= n_grams).select("key").toArrow()
    keys = top.column("key").to_numpy()
    return Model.of(languages, [(keys[keys >> 32 == k] & 0xFFFFFFFF).astype(np.uint32) for k in range(len(languages))])


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """Per row: doc_id, ``lang_pred`` and ``score``, the winner's share of all corrected hits.

    Texts that are null or have no letter: ``und``, 0. A text with letters of which no
    language has any n-gram: the first language by name, 0; so are ties decided. Without any
    learned language all are ``und``. Rows with null or repeated ids are predicted like any
    other; other columns are not read; an empty table gives no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # GRAMS and SLOTS bound its size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            for part in words.sliced(batch):
                value, text, has_ascii, has_high = grams(part.column("text"))
                letters = has_ascii.copy()
                for i in np.flatnonzero(has_high & ~has_ascii):
                    letters[i] = any(c.isalpha() for c in part.column("text")[int(i)].as_py())
                names, scores = ["und"] * part.num_rows, np.zeros(part.num_rows)
                if m.languages:
                    hits = m.hits(value, text, part.num_rows)
                    best, total = hits.argmax(axis=1), hits.sum(axis=1)
                    scores = np.where(letters & (total > 0), hits.max(axis=1) / np.where(total > 0, total, 1), 0.0)
                    names = [m.languages[b] if ok else "und" for b, ok in zip(best, letters, strict=True)]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(names, pa.string()), pa.array(scores)], ["doc_id", "lang_pred", "score"])

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(run, "doc_id bigint, lang_pred string, score double")


def identify(docs: DataFrame) -> DataFrame:
    """Train on the rows that are not held out and predict all: doc_id, held_out, lang_pred, score."""
    model = train(docs.where(~held_out(F.col("doc_id"))).select("doc_id", "text", "lang"))
    found = predict(docs, model)
    return found.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "lang_pred", "score")
