"""Intermediate tables in the folder that all executors share.

A written table cuts the lineage: a lost executor costs a re-read, not a recomputation.
"""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_written: list[tuple[SparkSession, str]] = []


def folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session. Where it is unset, local sessions, as in tests, take an own folder.

    On a cluster the executors have no common temporary folder, so the setting is required there.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = f"file://{tempfile.gettempdir()}/stagewise-scratch"
    return root.rstrip("/")


def not_among(key: str, taken: list[str]) -> None:
    """A key can't be called like a column that the result has beside it."""
    if key.lower() in {c.lower() for c in taken}:
        raise ValueError(f"the key column {key!r} has the name of a result column: rename it")


def fresh(df: DataFrame, name: str) -> str:
    """A column name that ``df`` doesn't have yet."""
    while name in df.columns:
        name += "_"
    return name


def table(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and return the table read back."""
    spark = df.sparkSession
    path = f"{folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _written.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


def release() -> None:
    """Delete every table written so far; results that still read them must be stored before."""
    while _written:
        spark, path = _written.pop()
        with contextlib.suppress(Exception):  # the session may have ended; the folder is scratch
            jvm = spark.sparkContext._jvm
            at = jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


atexit.register(release)
