"""The queries of this subpackage: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from weftline.llm import ann, decontaminate, jaccard, langid, mixing, pii, quality, tokenorder, toxicity, urlfilter
from weftline.llm.common import Scratch, table


def op1_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlfilter.url_filters(table(spark, sf_dir, "pages"), Scratch(spark))


def op2_training_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark)
    return tokenorder.materialise(table(spark, sf_dir, "documents"), scratch.path("order"), scratch)


def op3_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find(table(spark, sf_dir, "documents"), Scratch(spark))
    return found.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_spans")


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixing(table(spark, sf_dir, "documents"), Scratch(spark))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.neighbours(table(spark, sf_dir, "embeddings"), Scratch(spark))


def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.near_duplicates(table(spark, sf_dir, "documents"), Scratch(spark))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.language_id(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_url_filters, op2_training_order, op3_personal_data, op4_mixing, op5_toxicity, op6_nearest, op7_jaccard_join, op8_quality, op9_decontamination, op10_language_id)}
ORACLE_SQL = {"op1_url_filters": urlfilter.ORACLE}
