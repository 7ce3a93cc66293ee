"""Row-wise operators: flat-map, projection, filters, captured errors."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import tokens

LINEAGE = ("root_id", "producer", "attempt")


def split_words(df: DataFrame, column: str, out: str = "word") -> DataFrame:
    """A row per token of ``column``; lineage columns are carried."""
    kept = [c for c in LINEAGE if c in df.columns]
    return df.select(*kept, F.explode(tokens(F.col(column))).alias(out))


def explode_map(df: DataFrame, column: str, key: str, value: str) -> DataFrame:
    rest = [c for c in df.columns if c != column]
    return df.select(*rest, F.explode(column).alias(key, value))


def without_nulls(df: DataFrame, *columns: str) -> DataFrame:
    return df.dropna(subset=list(columns) or None)


def having_field(df: DataFrame, column: str, path: str) -> DataFrame:
    """Rows whose JSON has a value at ``path`` (as in $.data.sobject)."""
    return df.where(F.get_json_object(column, path).isNotNull())


def derive(df: DataFrame, content: Column, key: Column | None = None) -> DataFrame:
    """A spin-off: lineage stays, content (and routing key) are replaced."""
    out = df.withColumn("content", content)
    return out if key is None else out.withColumn("key", key)


def captured(df: DataFrame, value: Column, error: str, required: str, whole_batch: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(rows with a value, dead letters with ``error``): a row fails if ``required`` is set and ``value`` is null.

    whole_batch: a column of batch numbers; one failed row then fails all rows of its batch (bounded frames only).
    """
    marked = df.withColumn("value", value).withColumn("_bad", F.col(required).isNotNull() & F.col("value").isNull())
    if whole_batch:
        failed = marked.where("_bad").select(whole_batch).distinct()
        good, bad = marked.join(failed, whole_batch, "left_anti"), marked.join(failed, whole_batch, "left_semi")
    else:
        good, bad = marked.where(~F.col("_bad")), marked.where("_bad")
    return good.drop("_bad"), bad.drop("_bad", "value").withColumn("error", F.lit(error))


def process(df: DataFrame, function: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """A user's operator over Arrow batches: any number of rows out for each in. Prefer column expressions where they do."""
    return df.mapInArrow(function, schema)


def shuffled(df: DataFrame, seed: int | None = None) -> DataFrame:
    """Rows in random order."""
    return df.orderBy(F.rand(seed))


def fan_in(*frames: DataFrame) -> DataFrame:
    """All rows of all producers of a stream; columns that some lack are null."""
    out = frames[0]
    for more in frames[1:]:
        out = out.unionByName(more, allowMissingColumns=True)
    return out


def difference(df: DataFrame, other: DataFrame, *on: str) -> DataFrame:
    """Rows without a partner: endpoints that are gone, records that are not yet acknowledged."""
    return df.join(other.select(*on).distinct(), list(on), "left_anti")
