"""Weighted rendezvous hashing of record keys over shards, with gapless slots inside each shard."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stagewise import scratch


def draw(keys: Sequence[Column], shard: int, weight: float) -> Column:
    """Cost of a record on a shard: an exponential variate with the shard's weight as its rate."""
    bits = F.shiftrightunsigned(F.xxhash64(*keys, F.lit(shard)), 11)
    return -F.log((bits + F.lit(0.5)) / F.lit(float(1 << 53))) / F.lit(float(weight))


def rendezvous(keys: Sequence[Column], weights: Sequence[float]) -> Column:
    """The shard with the least cost; ties go to the lowest shard.

    A shard added at the end can only win rows for itself: no other pair's cost changes.
    Null keys hash like any other value, so all-null keys share one shard.
    """
    if not weights or min(weights) <= 0:
        raise ValueError("weights must be positive, one for each shard")
    costs = [F.struct(draw(keys, i, w).alias("cost"), F.lit(i).alias("shard")) for i, w in enumerate(weights)]
    return F.array_min(F.array(*costs))


def shard_rows(
    df: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    weights: Sequence[float] = (1.0,) * 24,
    grown_weight: float = 1.0,
    buckets: int = 1024,
) -> DataFrame:
    """One row per input row: key, size, text_crc32, law, shard, slot, grown_shard.

    The key and the shard count alone decide the shard, so law is ``key``. ``size`` is the UTF-8
    length plus 8; a null text counts as empty; a null key is a key of its own; repeated rows get
    a slot each; an empty table gives no rows. ``slot`` numbers each shard's rows from 0 without
    gaps. Ranking is in two steps, so that no task ever holds a shard: rows are numbered within
    (shard, bucket of the hash of key and text), and the buckets' counts (at most shards x ``buckets`` rows,
    hence broadcast) give each bucket's first slot. Only rows that repeat both key and text share a bucket for certain.
    """
    scratch.not_among(key, ["size", "text_crc32", "law", "shard", "slot", "grown_shard"])
    at = rendezvous([F.col(key)], weights)
    bucket = F.pmod(F.xxhash64(F.col(key), F.col(text), F.lit("bucket")), F.lit(buckets)).cast("int")
    body = F.coalesce(F.encode(F.col(text).cast("string"), "UTF-8"), F.lit(b""))
    new = len(weights)
    rows = df.select(
        F.col(key).alias("key"),
        (F.octet_length(body) + F.lit(8)).cast("long").alias("size"),
        F.crc32(body).alias("text_crc32"),
        at.alias("best"),
        bucket.alias("bucket"),
    ).select(
        "key", "size", "text_crc32", "bucket",
        F.col("best.shard").alias("shard"),
        F.when(draw([F.col("key")], new, grown_weight) < F.col("best.cost"), F.lit(new))
        .otherwise(F.col("best.shard")).alias("grown_shard"),
    )
    counts = df.select(at["shard"].alias("shard"), bucket.alias("bucket")).groupBy("shard", "bucket").count()
    order = Window.partitionBy("shard").orderBy("bucket")
    firsts = counts.select("shard", "bucket", (F.sum("count").over(order) - F.col("count")).alias("first"))
    inside = Window.partitionBy("shard", "bucket").orderBy("key", "size", "text_crc32")
    return (
        rows.withColumn("rank", F.row_number().over(inside) - 1)
        .join(F.broadcast(firsts), ["shard", "bucket"])
        .select(
            F.col("key").alias(key), "size", "text_crc32", F.lit("key").alias("law"), "shard",
            (F.col("first") + F.col("rank")).cast("long").alias("slot"), "grown_shard",
        )
    )
