"""Completion of message trees in bounded tables: the XOR of all ack values of a tree is 0 when all is done.

128-bit values are two longs. Trees are keyed by (producer, root_id), so equal ids of two sources do not meet.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TIMEOUT = "INTERVAL 30 MINUTES"
KEYS = ("producer", "root_id")


def folded(control: DataFrame) -> DataFrame:
    """Per tree: xor_hi, xor_lo, failed, started, destination (the last known), status: success, failed or waiting."""
    trees = control.groupBy(*KEYS).agg(
        F.bit_xor(F.when(~F.col("is_fail"), F.col("ack_hi"))).alias("xor_hi"), F.bit_xor(F.when(~F.col("is_fail"), F.col("ack_lo"))).alias("xor_lo"), F.bool_or("is_fail").alias("failed"),
        F.min("ts").alias("started"), F.max_by("destination", F.when(F.col("destination").isNotNull(), F.col("seq"))).alias("destination"),
    )
    done = (F.coalesce("xor_hi", F.lit(0)) == 0) & (F.coalesce("xor_lo", F.lit(0)) == 0)
    return trees.withColumn("status", F.when(F.col("failed"), "failed").when(done, "success").otherwise("waiting"))


def with_timeouts(trees: DataFrame, now: Column, after: str = TIMEOUT) -> DataFrame:
    """Waiting trees whose first event is older than ``after`` become ``timeout``."""
    late = (F.col("status") == "waiting") & (now - F.col("started") > F.expr(after))
    return trees.withColumn("status", F.when(late, "timeout").otherwise(F.col("status")))


def lost(trees: DataFrame, processes: DataFrame) -> DataFrame:
    """Waiting trees whose destination is no longer registered; none while the registry is empty."""
    live = processes.select(F.col("process").alias("destination")).distinct()
    gone = trees.where("status = 'waiting' and destination is not null").join(live, "destination", "left_anti")
    return gone.join(live.limit(1).select(F.lit(True).alias("_any")), F.lit(True), "left_semi")
