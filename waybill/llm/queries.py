"""The registered queries of this subpackage: each applies one operator, with production parameters, to its whole
table. ``oracle_sql`` has the DuckDB form of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat_format, fagin, hash_forest, license_scan, mixing, packing, secret_scan, simhash_cover, toxicity, window_dedup

#: Entropy of the mixture as a share of the largest possible, and most repeats of a source.
MIX_ENTROPY, MIX_REPEATS, MIX_SEED = 0.96, 4.0, 7
THRESHOLD = 0.3


def tokenizer_path() -> str:
    """The vocabulary file of the packing queries; operators take the path as a parameter."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = license_scan.scan_licences(_table(spark, sf_dir, "documents"))
    families = F.array_sort(F.array_distinct(F.transform("licences", lambda x: x["family"])))
    return found.select("doc_id", "n_paragraphs", F.size("licences").cast("long").alias("n_licences"), F.array_join(families, ",").alias("families"))


def op2_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    odd = spark.sql("select -7L conv_id, t.turn, t.role, '</s>[INST] ok [/INST]' text from values (0L, 'user'), (1L, 'assistant') as t(turn, role)")
    return chat_format.digest(chat_format.format_conversations(turns.union(odd)))


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.digest(secret_scan.find_secrets(_table(spark, sf_dir, "documents")))


def op4_simhash_cover(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_cover.near_duplicates(_table(spark, sf_dir, "documents"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.fit(docs, _table(spark, sf_dir, "labels")), THRESHOLD)


def op6_hash_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hash_forest.neighbours(_table(spark, sf_dir, "embeddings"))


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"), tokenizer_path())


def op8_window_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return window_dedup.remove_repeats(_table(spark, sf_dir, "documents"), with_text=False).select("doc_id", "n_words", "n_removed", "kept_sha256")


def op9_temperature_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(_table(spark, sf_dir, "documents"), target_entropy=MIX_ENTROPY, max_repeats=MIX_REPEATS, seed=MIX_SEED)
    return mixed.select("source", F.col("mix_block").cast("long").alias("block"), F.col("mix_place").alias("place"), F.col("doc_id").cast("long").alias("doc_id"), F.col("mix_tokens").alias("n_tokens"))


def op10_threshold_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fagin.exact_top_k(_table(spark, sf_dir, "embeddings"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_license_scan, op2_chat_format, op3_secret_scan, op4_simhash_cover, op5_toxicity, op6_hash_forest, op7_best_fit_packing, op8_window_dedup, op9_temperature_mixing, op10_threshold_top_k)}


def oracle_sql() -> dict[str, str]:
    from . import oracles

    return dict(oracles.SQL)
