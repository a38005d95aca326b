"""The corpus pipeline: toxicity, near duplicates, benchmark decontamination, mixing, training order."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from weftline.llm import decontaminate, jaccard, mixing, tokenorder, toxicity
from weftline.llm.common import Scratch, swept, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.drop_toxic(docs, table(spark, sf_dir, "labels"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard.drop_duplicates(docs, Scratch(spark))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.take(docs, Scratch(spark))


def training_order(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark)
    return tokenorder.materialise(docs, scratch.path("order"), scratch)


STAGES = [
    ("toxicity", drop_toxic),
    ("n-gram Jaccard join", drop_near_duplicates),
    ("benchmark decontamination", drop_contaminated),
    ("mixing sources to target weights", mix_sources),
    ("token-ID / binary output", training_order),
]
# Only the last two stages' counting is expressible in SQL; tests/llm compares the filtering stages with brute-force versions of them.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written as Parquet and read again by the next; what a stage wrote besides, and its input, is deleted after it."""
    scratch = Scratch(spark)
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        with swept():
            docs = scratch.write(stage(spark, docs, sf_dir), name.split()[0].replace("/", "-"))
        if before is not None:
            scratch.drop(before)
        before = docs
    return docs
