"""Rules of partitioned sources: offsets to commit, throttling, shard leases."""

from __future__ import annotations

from enum import Enum

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import heartbeat

#: Seconds without a heartbeat after which a process counts as gone.
EVICT_S = 30

MAX_PER_PARTITION, MAX_TOTAL = 3000, 10_000


class OnFailure(Enum):
    """What becomes of a record that failed: it is given up, it holds its position until a replay succeeds, or the service gives it out again."""

    SKIP, REPLAY, REDELIVER = "skip", "replay", "redeliver"


def settled(status: Column, policy: OnFailure) -> Column:
    """Whether a record of that status (success, failed, or anything else: open) is done with, for ``commit_offsets`` and ``uncompleted``."""
    done = F.coalesce(status == "success", F.lit(False))
    return done | F.coalesce(status == "failed", F.lit(False)) if policy is OnFailure.SKIP else done


def again(records: DataFrame, status: str, policy: OnFailure) -> DataFrame:
    """The records that the engine itself has to process again, with ``attempt`` one higher; a service that redelivers needs no help."""
    rows = records.where(F.col(status) == "failed") if policy is OnFailure.REPLAY else records.limit(0)
    attempt = F.coalesce("attempt", F.lit(0)) if "attempt" in records.columns else F.lit(0)
    return rows.withColumn("attempt", (attempt + 1).cast("int"))


def acknowledged(records: DataFrame, status: str, policy: OnFailure) -> DataFrame:
    """The records whose receipts go back to the service: without a redelivery of failed ones, all that are settled."""
    return records.where(settled(F.col(status), policy))


def evicted(heartbeats: DataFrame, now: Column, after_s: int = EVICT_S) -> DataFrame:
    """(process, last_seen) of processes (process, ts) whose last heartbeat is more than ``after_s`` seconds before ``now``."""
    seen = heartbeats.groupBy("process").agg(F.max(heartbeat(F.col("ts"))).alias("last_seen"))
    return seen.where(F.col("last_seen") < heartbeat(now) - after_s)


def commit_offsets(records: DataFrame, partition: str, offset: str, done: Column) -> DataFrame:
    """(partition, commit): the smallest unfinished offset, or one past the largest."""
    return records.groupBy(partition).agg(F.coalesce(F.min(F.when(~done, F.col(offset))), F.max(offset) + 1).alias("commit"))


def uncompleted(records: DataFrame, partition: str, done: Column) -> DataFrame:
    return records.groupBy(partition).agg(F.count_if(~done).alias("uncompleted"))


def blocked(open_: DataFrame, per_partition: int = MAX_PER_PARTITION, total: int = MAX_TOTAL) -> DataFrame:
    """``open_`` (partition, uncompleted) with ``blocked``: more than the partition's limit, or in all more than the total one."""
    everything = open_.agg(F.sum("uncompleted").alias("_all"))
    joined = open_.join(F.broadcast(everything), F.lit(True))  # one row
    return joined.withColumn("blocked", (F.col("uncompleted") > per_partition) | (F.col("_all") > total)).drop("_all")


def shard_balance(leases: DataFrame, shard: str = "shard_id", worker: str = "worker_id") -> DataFrame:
    """Per worker: owned, optimum (shards // workers), and ``claimable``: shards of others that it may take.

    A live shard may be claimed if its owner has more than the optimum, or the claimer has none and the
    owner more than one, and the claimer is below the optimum.
    """
    owned = leases.where(F.col(worker).isNotNull()).groupBy(worker).agg(F.count_distinct(shard).alias("owned"))
    all_ = owned.agg(F.sum("owned").alias("shards"), F.count("*").alias("workers"), F.sum(F.when(F.col("owned") > 1, F.col("owned"))).alias("of_many"))
    optimum = F.floor(F.col("shards") / F.col("workers")).cast("bigint")
    known = owned.join(F.broadcast(all_), F.lit(True)).withColumn("optimum", optimum)  # one row
    above = known.agg(F.sum(F.when(F.col("owned") > F.col("optimum"), F.col("owned"))).alias("of_rich"))
    rows = known.join(F.broadcast(above), F.lit(True))  # one row
    own = lambda limit: F.when(F.col("owned") > limit, F.col("owned")).otherwise(0)
    rich = F.coalesce("of_rich", F.lit(0)) - own(F.col("optimum"))
    many = F.coalesce("of_many", F.lit(0)) - own(F.lit(1))
    claimable = F.when(F.col("owned") >= F.col("optimum"), 0).when(F.col("owned") == 0, F.greatest(rich, many)).otherwise(rich)
    return rows.select(worker, "owned", "optimum", claimable.cast("bigint").alias("claimable"))


def stale_leases(before: DataFrame, after: DataFrame) -> DataFrame:
    """Shards of two snapshots taken a timeout apart whose worker and heartbeat have not changed: free to claim."""
    old = before.select("shard_id", F.col("worker_id").alias("_w"), F.col("heartbeat").alias("_h"))
    return after.join(old, "shard_id").where(F.col("worker_id").eqNullSafe(F.col("_w")) & F.col("heartbeat").eqNullSafe(F.col("_h"))).drop("_w", "_h")


def can_claim(leases: DataFrame, stale: DataFrame, shard_id: str, worker_id: str) -> bool:
    """May this worker take this shard? A few aggregates over the lease table; an unknown shard is an error."""
    row = leases.where(F.col("shard_id") == shard_id).first()
    if row is None:
        raise LookupError(f"no lease for shard {shard_id}")
    if not stale.where(F.col("shard_id") == shard_id).isEmpty():
        return True
    live = leases.join(stale.select("shard_id"), "shard_id", "left_anti").where(F.col("worker_id").isNotNull())
    s = live.agg(F.count_if(F.col("worker_id") == worker_id).alias("mine"), F.count_if(F.col("worker_id") == row["worker_id"]).alias("owner"), F.count_distinct("worker_id").alias("workers")).first()
    workers = s["workers"] + (s["mine"] == 0)
    optimum = leases.count() // max(workers, 1)
    return (s["owner"] > optimum or s["mine"] == 0 and s["owner"] > 1) and s["mine"] < optimum


def batch_numbers(df: DataFrame, worker: str, order: str, limit: int) -> DataFrame:
    """``batch``: rows of each worker in order, ``limit`` to a batch."""
    from pyspark.sql.window import Window

    n = F.row_number().over(Window.partitionBy(worker).orderBy(order))
    return df.withColumn("batch", F.floor((n - 1) / limit).cast("bigint"))
