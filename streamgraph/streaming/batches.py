"""Micro-batches: running counts and per-batch functions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..operators.aggregates import counts
from ..operators.rows import split_words


def word_counts(df: DataFrame, column: str = "text") -> DataFrame:
    """Running counts of words; the state store keeps them across restarts."""
    return counts(split_words(df, column), "word")


def each_batch(df: DataFrame, function: Callable[[DataFrame, int], None], checkpoint: str, seconds: float | None = None, mode: str = "append", name: str | None = None) -> StreamingQuery:
    """``function(batch, number)`` for every micro-batch; without ``seconds`` all that is there now, then an end.

    A batch that fails is given again with the same number after a restart, so functions should be idempotent.
    """
    writer = df.writeStream.outputMode(mode).foreachBatch(function).option("checkpointLocation", checkpoint)
    writer = writer.queryName(name) if name else writer
    return (writer.trigger(processingTime=f"{seconds} seconds") if seconds else writer.trigger(availableNow=True)).start()
