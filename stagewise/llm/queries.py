"""The registered queries of this package: each applies one operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import alignment, complement, contamination, langid, licenses, lmscore, neardup, packing, quality, secrets, sharding, spelling, tiff
from .oracles import ORACLE_SQL


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir))


def op2_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.secret_spans(documents(spark, sf_dir)).drop("found")


def op4_rendezvous(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_rows(documents(spark, sf_dir))


def op5_tiff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tiff.stored_texts(documents(spark, sf_dir))


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    found = contamination.contamination(documents(spark, sf_dir), benchmark)
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def op8_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(documents(spark, sf_dir))


def op10_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lmscore.language_scores(documents(spark, sf_dir))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality")
    return quality.quality_scores(documents(spark, sf_dir), labels)


def op6_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.languages(documents(spark, sf_dir))


def op9_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.license_labels(documents(spark, sf_dir))


def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.alignments(documents(spark, sf_dir))


def op12_bestfit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return complement.pack_exactly(documents(spark, sf_dir))


def op13_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.spelling_variants(documents(spark, sf_dir))


QUERIES = {
    "op1_packing": op1_packing,
    "op2_secrets": op2_secrets,
    "op4_rendezvous": op4_rendezvous,
    "op5_tiff": op5_tiff,
    "op3_quality": op3_quality,
    "op6_langid": op6_langid,
    "op7_decontamination": op7_decontamination,
    "op8_neardup": op8_neardup,
    "op9_licenses": op9_licenses,
    "op10_lm": op10_lm,
    "op11_alignment": op11_alignment,
    "op12_bestfit": op12_bestfit,
    "op13_spelling": op13_spelling,
}

__all__ = ["ORACLE_SQL", "QUERIES"]
