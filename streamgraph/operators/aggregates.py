"""Keyed aggregates; all combine before the shuffle."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def counts(df: DataFrame, *keys: str, out: str = "n") -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias(out))


def last_by_key(df: DataFrame, key: str, order: str) -> DataFrame:
    """The row with the greatest ``order`` of each key: last write wins. One shuffle of combined rows, no sort."""
    rest = [c for c in df.columns if c != key]
    latest = df.groupBy(key).agg(F.max_by(F.struct(*rest), order).alias("_r"))
    return latest.select(key, *[F.col(f"_r.{c}").alias(c) for c in rest]).select(*df.columns)


def merged_map(df: DataFrame, key: str, value: str, order: str, *group: str, out: str = "entries") -> DataFrame:
    """One map per group, later entries winning. A group's map is one value: group by what bounds it."""
    last = df.groupBy(*group, key).agg(F.max_by(value, order).alias(value))
    return last.groupBy(*group).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct(key, value)))).alias(out))


def grouped(df: DataFrame, function, schema: str, *keys: str) -> DataFrame:
    """A user's aggregate: ``function(keys, table)`` of each group's Arrow table gives a table of ``schema``. A group lies in one task, so
    it is for groups that are bounded; sums and the like belong in ``groupBy``, and running state in ``streaming.state``.
    """
    return df.groupBy(*keys).applyInArrow(function, schema)


def replicas(df: DataFrame, n: int) -> DataFrame:
    """``n`` copies of each row, numbered; a narrow operator."""
    return df.select("*", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(n - 1).cast("bigint"))).alias("replica"))
