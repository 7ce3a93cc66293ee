"""Connected components of an edge table. A hub's edges meet its label in a sort-merge join, which adaptive execution splits where they are many; nothing is collected."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import scratch


def components(edges: DataFrame) -> DataFrame:
    """(id, component): the smallest id reachable, for every id of ``edges`` (a, b; longs without nulls). No edges: no rows.

    Each round every node takes the smallest label among its own and its neighbours', by an
    aggregation that combines before the shuffle, and then its label's label, which halves the
    way to go; it ends when nothing changes. Tables between rounds are written to the shared folder.
    """
    both = scratch.keep(edges.select("a", "b").union(edges.select(F.col("b"), F.col("a"))).where("a <> b").distinct(), "edges")
    labels = scratch.keep(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("id"), F.least("a", "m").alias("label")), "labels")
    while True:
        near = both.join(labels.withColumnRenamed("id", "b"), "b").groupBy("a").agg(F.min("label").alias("near"))
        own = labels.join(near.withColumnRenamed("a", "id"), "id")
        step = scratch.keep(own.select("id", F.col("label").alias("was"), F.least("label", "near").alias("label")), "step")
        jump = step.select(F.col("id").alias("label"), F.col("label").alias("root"))
        new = step.join(jump, "label", "left").select("id", "was", F.least("label", F.coalesce("root", "label")).alias("label"))
        new = scratch.keep(new, "labels")
        if new.where("was <> label").isEmpty():
            return new.select("id", F.col("label").alias("component"))
        labels = new.select("id", "label")
