"""The corpus pipeline: five stages from ``documents`` to packed training sequences, each a table between.

Odd input: null and empty texts pass all stages (a document of theirs is the end id alone); of repeated rows that share
the kept doc_id all stay, rows without a doc_id are kept; further columns come along up to the mixing. An empty
table gives an empty result. Each stage's docstring says what it decides, its operator's the rest.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from waybill.llm import mixing, packing, secret_scan, simhash_cover, toxicity
from waybill.llm.common import quoted, stage_table
from waybill.llm.queries import THRESHOLD, tokenizer_path

#: A source is repeated so often at most; the mixture is the least that shows every document once.
MAX_REPEATS = 2.0


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity classifier rejects go. It learns from the training fold of ``labels``."""
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.drop_toxic(docs, model, THRESHOLD)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: the one with the smallest id."""
    return simhash_cover.keep_one(docs)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets and the weak candidates that complementary parts confirm are masked; n_chars follows."""
    return secret_scan.redact(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Smaller sources are repeated until the flattest weights that the repetition limit allows are met."""
    return mixing.mix(docs, max_repeats=MAX_REPEATS).select(*quoted(docs.columns))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row a piece of each document copy: where its tokens lie in which sequence."""
    return packing.pack(docs, tokenizer_path())


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("secrets", redact_secrets),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: The trained model, XXH64 fingerprints and the tokenizer have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents`` of ``sf_dir``; each stage's result is written as Parquet and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stage_table(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
