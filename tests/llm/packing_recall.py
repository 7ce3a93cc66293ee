"""python -m tests.llm.packing_recall SF_DIR: of the documents nearest by BM25 over the whole table, the share that packing can reach from a seed.

Seeds are the documents whose id is divisible by 50; a seed reaches its own shard and the next of its partition. Prints the share for
the deal by content and for the table as it stands, for the nearest document, the nearest ten, and those with half of the seed's own score.
"""

from __future__ import annotations

import sys

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from streamgraph.llm import packing, words


def shards(rows: DataFrame) -> dict[int, tuple[int, int]]:
    """Partition and shard of each document."""
    found, table = {}, rows.select(F.spark_partition_id().alias("part"), "doc_id", "text").toArrow()
    part = np.asarray(table.column("part"))
    for p in np.unique(part):
        batch = table.filter(pa.array(part == p)).combine_chunks().to_batches()[0]
        for k, piece in enumerate(words.sliced(batch, limit=packing.SHARD_BYTES)):
            found |= dict.fromkeys(piece.column("doc_id").to_pylist(), (int(p), k))
    return found


def nearest(docs: DataFrame, top: int = 10) -> dict[int, tuple[list[int], list[int]]]:
    """Of each seed: the nearest documents, best first, and all that reach half of its score against itself."""
    batch = docs.select("doc_id", "text").toArrow().combine_chunks().to_batches()[0]
    ids = np.asarray(batch.column("doc_id"))
    index = packing.Index(words.words_of(batch, words.ALNUM))
    out = {}
    for seed in np.flatnonzero(ids % 50 == 0):
        score = index.scores(index.words(seed))
        own, score[seed] = score[seed], -1
        best = np.argsort(-score, kind="stable")[:top]
        out[int(ids[seed])] = ids[best[score[best] > 0]].tolist(), ids[score > max(own / 2, 0)].tolist()
    return out


def recall(near: dict[int, tuple[list[int], list[int]]], at: dict[int, tuple[int, int]]) -> list[float]:
    """The shares that are reached of the nearest, the ten nearest, and those with half of its score."""
    def reached(seed: int, others: list[int]) -> int:
        return sum(at[d][0] == at[seed][0] and 0 <= at[d][1] - at[seed][1] <= 1 for d in others)

    kinds = [{s: n[:1] for s, (n, _) in near.items()}, {s: n for s, (n, _) in near.items()}, {s: c for s, (_, c) in near.items()}]
    return [round(sum(reached(s, o) for s, o in k.items()) / max(sum(map(len, k.values())), 1), 3) for k in kinds]


if __name__ == "__main__":
    from pyspark.sql import SparkSession

    spark = SparkSession.builder.master("local[8]").config("spark.driver.memory", "12g").config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    docs = spark.read.parquet(f"{sys.argv[1]}/documents.parquet").select("doc_id", "text")
    near = nearest(docs)
    print("seeds", len(near), "pairs with half of a score", sum(len(c) for _, c in near.values()))
    print("dealt by content", recall(near, shards(packing.deal(docs))))
    print("as the table stands", recall(near, shards(docs)))
