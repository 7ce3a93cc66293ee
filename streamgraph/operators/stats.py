"""Statistics of processes from their progress events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

ELIGIBLE = "duration_s is not null and (msg_type <> 'new_msg' or sender = 'ramp')"


def frequencies(control: DataFrame, process: str = "process_name", where: str = ELIGIBLE) -> DataFrame:
    """(process, observation, frequency): durations rounded half to even."""
    return control.where(where).groupBy(process, F.bround("duration_s", 0).alias("observation")).agg(F.count("*").alias("frequency"))


def rank_percentile(freq: DataFrame, by: str, percent: float = 95) -> DataFrame:
    """(by, percentile): the first observation with 1 + (observations below it) >= N * percent / 100, else the largest.

    The frequency table has a row per distinct observation, so its window stays small whatever the number of events.
    """
    if not 0 < percent <= 100:
        raise ValueError("percent must be above 0 and at most 100")
    before = Window.partitionBy(by).orderBy("observation").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(by)
    ranked = freq.withColumn("below", F.coalesce(F.sum("frequency").over(before), F.lit(0))).withColumn("total", F.sum("frequency").over(whole))
    hit = F.min(F.when(1 + F.col("below") >= F.col("total") * percent / 100, F.col("observation")))
    return ranked.groupBy(by).agg(F.coalesce(hit, F.max("observation")).alias("percentile"))


def averages(control: DataFrame, process: str = "process_name", where: str = ELIGIBLE) -> DataFrame:
    """(process, time_taken_s, total_frequency, avg_time_taken_s): the sum runs over all durations, the count over eligible ones."""
    out = control.groupBy(process).agg(F.sum("duration_s").alias("time_taken_s"), F.count_if(F.expr(where)).alias("total_frequency"))
    return out.withColumn("avg_time_taken_s", F.when(F.col("total_frequency") > 0, F.col("time_taken_s") / F.col("total_frequency")))


def minute_histogram(events: DataFrame, by: str, ts: str, now: Column, **counts: str) -> DataFrame:
    """(by, minute, a count per condition) over the 59 whole minutes up to ``now``, so that no two hours share a slot."""
    recent = events.where((F.col(ts) <= now) & (F.col(ts) > F.date_trunc("minute", now) - F.expr("INTERVAL 59 MINUTES")))
    return recent.groupBy(by, F.minute(ts).alias("minute")).agg(*[F.count_if(F.expr(c)).alias(k) for k, c in counts.items()])


def waiting(trees: DataFrame, processes: DataFrame) -> DataFrame:
    """(process, waiting): unfinished trees by their last destination, 0 for processes without any."""
    n = trees.where("status = 'waiting'").groupBy(F.col("destination").alias("process")).agg(F.count("*").alias("waiting"))
    return processes.select("process").distinct().join(n, "process", "left").fillna(0, ["waiting"])


def rollup(stats: DataFrame, name: str) -> DataFrame:
    """Per group (the name before ``-``): sums, and avg = time / frequency / processes, a frequency of 0 counting as 1."""
    out = stats.groupBy(F.substring_index(name, "-", 1).alias("group")).agg(
        F.sum("waiting").alias("waiting"), F.sum("time_taken_s").alias("time_taken_s"), F.sum("total_frequency").alias("total_frequency"), F.count("*").alias("processes")
    )
    return out.withColumn("avg_time_taken_s", F.col("time_taken_s") / F.greatest("total_frequency", F.lit(1)) / F.col("processes"))


def displayed(stats: DataFrame, name: str) -> DataFrame:
    """Groups by name, then processes by name: the order of a status page, which is small."""
    return stats.withColumn("group", F.substring_index(name, "-", 1)).orderBy("group", name)


def recent(failures: DataFrame, by: str, order: list[Column], n: int = 20) -> DataFrame:
    """The last ``n`` failures of each process, newest first, with their rank."""
    w = Window.partitionBy(by).orderBy(*order)
    return failures.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def percent_of_max(histogram: DataFrame, by: str, value: str) -> DataFrame:
    """``percent``: each bar against the largest of its process; 0 where all are 0."""
    top = F.max(value).over(Window.partitionBy(by))
    return histogram.withColumn("percent", F.when(top > 0, F.col(value) * 100.0 / top).otherwise(0.0))
