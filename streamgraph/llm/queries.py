"""The queries of this subpackage, with production parameters over whole tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, decontaminate, html, language, licences, near_dedup, packing, quality, repeats, sql, token_counts


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer() -> str:
    """Where the 50k byte-level vocabulary lies; the box names it, the repository holds no copy."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.verdicts(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


#: Risk and level at which a table of a thousand documents proves rules in several strata.
LOOSE = 0.1, 0.2


def quality_cutoffs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cutoffs themselves, at a risk that small tables can prove, and how many documents each rejects beyond the base rules."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    judged = quality.verdicts(docs, labels, *LOOSE)
    cutoffs = quality.thresholds(judged, labels, *LOOSE).where("cutoff is not null")
    failed = judged.where(~F.col("base_failed")).select("stratum", F.explode("failed_signals").alias("signal")).groupBy("stratum", "signal").agg(F.count("*").alias("rejected"))
    return cutoffs.join(failed, ["stratum", "signal"], "left").na.fill(0, ["rejected"]).select("stratum", "signal", "cutoff", "rejected")


def op2_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"))


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.repeated_spans(table(spark, sf_dir, "documents"))


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer())


def op6_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(table(spark, sf_dir, "pages"))


def op7_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    own = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], turns.schema)
    return chat.digests(chat.format_chats(turns.unionByName(own)))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify(table(spark, sf_dir, "documents"))


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.best_matches(table(spark, sf_dir, "documents"))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"), tokenizer())


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality_rules": op1_quality_rules,
    "quality_cutoffs": quality_cutoffs,
    "op2_minhash_dedup": op2_minhash_dedup,
    "op3_suffix_dedup": op3_suffix_dedup,
    "op4_decontaminate": op4_decontaminate,
    "op5_packing": op5_packing,
    "op6_html_extract": op6_html_extract,
    "op7_chat_format": op7_chat_format,
    "op8_language_id": op8_language_id,
    "op9_license_scan": op9_license_scan,
    "op10_token_counts": op10_token_counts,
}

#: The others have no SQL (suffix spans, packing, extraction, prediction, token counts); tests/llm holds them against brute force.
ORACLES: dict[str, str] = {
    "op1_quality_rules": sql.quality_rules(),
    "quality_cutoffs": sql.quality_cutoffs(*LOOSE),
    "op2_minhash_dedup": sql.near_duplicates(),
    "op4_decontaminate": sql.decontamination(),
    "op7_chat_format": sql.chat_digests(),
    "op9_license_scan": sql.license_scan(),
}
