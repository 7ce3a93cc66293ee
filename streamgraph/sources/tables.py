"""Tables and generators."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def table_stream(spark: SparkSession, folder: str, name: str, files_per_batch: int = 100) -> DataFrame:
    """The folder of a table as a stream of its files; NTZ timestamps are cast so that they can carry watermarks."""
    df = spark.readStream.schema(spark.read.parquet(f"{folder}/{name}.parquet").schema).option("maxFilesPerTrigger", files_per_batch).parquet(f"{folder}/{name}.parquet")
    return df.select(*[F.col(c).cast("timestamp").alias(c) if t == "timestamp_ntz" else F.col(c) for c, t in df.dtypes])


def sentences(spark: SparkSession, texts: Sequence[str], per_second: int = 1) -> DataFrame:
    """An endless stream of texts in turn: root_id, content."""
    lines = F.array(*[F.lit(t) for t in texts])
    rate = spark.readStream.format("rate").option("rowsPerSecond", per_second).load()
    return rate.select(F.col("value").cast("string").alias("root_id"), F.get(lines, (F.col("value") % len(texts)).cast("int")).alias("content"))
