"""The corpus pipeline: each stage calls one operator and works on all that its predecessor kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from streamgraph.llm import decontaminate, idsets, near_dedup, packing, quality, queries, repeats, scratch

#: By folder of tables: the run of the last stage that was called by hand. Its tables go when the next stage begins, which reads what that stage has returned.
_last: dict[str, scratch.Run] = {}


def _tables(spark: SparkSession, sf_dir: str) -> scratch.Run:
    """A run for the intermediate tables of a stage."""
    if sf_dir in _last:
        _last.pop(sf_dir).close()
    return _last.setdefault(sf_dir, scratch.run(spark))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go. Rows with null or repeated ids are judged each by their own text."""
    with _tables(spark, sf_dir):
        return quality.judge(docs, queries.table(spark, sf_dir, "labels")).where("kept").select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component stays, and one of the rows that repeat its id and text; rows without an id or without words stay."""
    with _tables(spark, sf_dir):
        gone = scratch.keep(near_dedup.near_duplicates(docs).where("not kept").select("doc_id").distinct(), "gone")
        repeated = scratch.keep(docs.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").select("doc_id"), "repeated")
        left = idsets.without(docs, gone)
        if repeated.isEmpty():
            return left
        return idsets.without(left, repeated).unionByName(idsets.within(left, repeated).dropDuplicates(["doc_id", "text"]))


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that occur before are cut out; documents that were nothing else go."""
    with _tables(spark, sf_dir):
        return repeats.without_repeats(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Contaminated documents go: each row by its own text, whose verdict is found where the row is read."""
    with _tables(spark, sf_dir):
        return decontaminate.clean(docs, queries.table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What is left, packed into training sequences."""
    with _tables(spark, sf_dir):
        return packing.pack(docs, queries.tokenizer())


STAGES = [
    ("quality rules", quality_rules),
    ("MinHash near-dedup", near_duplicates),
    ("suffix-array dedup", repeated_passages),
    ("benchmark decontamination", decontamination),
    ("packing", pack),
]

#: Sketches, suffix arrays and retrieval have no SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; between stages the rows are written as Parquet in the shared folder and read again."""
    docs = queries.table(spark, sf_dir, "documents")
    outputs = scratch.run(spark)
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            with outputs:
                docs = scratch.keep(docs, name.replace(" ", "-"))
    _last.pop(sf_dir, None)  # the last stage's tables stay for its result
    return docs
