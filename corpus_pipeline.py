"""A corpus pipeline of five stages over documents, each written and read again before the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stagewise import scratch
from stagewise.llm import contamination, neardup, packing, quality, secrets


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the attention model, fitted on the labels of these documents, does not reject.

    Null and empty texts are judged as one empty passage; without labels no document is far from a half, so
    all stay; repeated rows are judged alike; an empty table gives an empty one.
    """
    return quality.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality"))


def keep_one_copy(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the one with the smallest id, of each group of near-duplicates; texts without words all stay.

    Of rows that repeat an id the one with the least text stays; an empty table gives an empty one.
    """
    return neardup.first_of_each(docs)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark window occurs; null and empty texts stay, and all if the benchmark is empty."""
    return contamination.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def hide_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with each secret in a text replaced by its kind; n_chars follows the text, null texts stay null."""
    return secrets.redact(docs).withColumn("n_chars", F.length("text").cast("long"))


def pack_windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in windows of 4096 tokens.

    A null or empty text is its end token alone; repeated rows are packed each; an empty table gives no pieces.
    """
    return packing.pack(docs)


STAGES = [
    ("quality classifier", keep_quality),
    ("near-dedup", keep_one_copy),
    ("decontamination", drop_benchmark),
    ("secret scans", hide_secrets),
    ("packing", pack_windows),
]

#: Learned scores, inferred automata and the tokenizer have no SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = scratch.table(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
