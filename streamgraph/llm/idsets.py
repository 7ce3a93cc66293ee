"""Rows of a table by a set of ids, without a shuffle of the table's other columns.

A bitmap of hashed ids, of bounded size, decides where rows are read; only rows that share a bit with an id, and
are few, meet the ids in a join. A fuller map saves less; results never depend on it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import scratch
from .columns import fresh

#: Bits of a map: sixteen for each id, and at most so many; its broadcast has MOST / 64 rows of two longs at most, whatever the input.
LEAST, MOST = 1 << 20, 1 << 26


def _bit(key: Column, bits: int) -> tuple[Column, Column]:
    slot = F.pmod(F.xxhash64(key), F.lit(bits))
    return F.shiftright(slot, 6), F.call_function("shiftleft", F.lit(1).cast("bigint"), (slot % 64).cast("int"))


def _marked(rows: DataFrame, ids: DataFrame, key: str, flag: str) -> DataFrame:
    """``rows`` with ``flag``: the row's id may be in ``ids`` (false: it is not)."""
    bits = min(MOST, max(LEAST, 1 << (16 * ids.count() - 1).bit_length()))
    at, bit = _bit(F.col(key).cast(ids.schema[key].dataType), bits)  # equal numbers of two types would hash apart
    word, held = fresh(rows, "word", "held")
    bitmap = scratch.keep(ids.groupBy(at.alias(word)).agg(F.bit_or(bit).alias(held)), "bitmap")
    joined = rows.withColumn(word, at).join(F.broadcast(bitmap), word, "left")
    return joined.withColumn(flag, F.col(key).isNotNull() & F.coalesce(F.col(held).bitwiseAND(bit) != 0, F.lit(False))).drop(word, held)


def split(rows: DataFrame, ids: DataFrame, key: str = "doc_id") -> tuple[DataFrame, DataFrame]:
    """(rows whose id may be in ``ids``, rows whose id is not): a join with the first is exact and shuffles little else than it keeps."""
    (flag,) = fresh(rows, "flag")
    marked = _marked(rows, ids, key, flag)
    return marked.where(flag).select(*rows.columns), marked.where(~F.col(flag)).select(*rows.columns)


def within(rows: DataFrame, ids: DataFrame, key: str = "doc_id") -> DataFrame:
    """The rows whose id is in ``ids``, a table of one column of distinct ids that has been written."""
    return split(rows, ids, key)[0].join(ids, key, "left_semi").select(*rows.columns)


def without(rows: DataFrame, ids: DataFrame, key: str = "doc_id") -> DataFrame:
    """The rows whose id is not in ``ids`` (as for ``within``), those without an id included."""
    likely, sure = split(rows, ids, key)
    spared = scratch.keep(likely.select(key).distinct().join(ids, key, "left_anti"), "spared")
    return sure if spared.isEmpty() else sure.unionByName(within(rows, spared, key))
