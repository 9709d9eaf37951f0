"""Streams with state of their own: timers, evictions, deferral, and a batch that comes twice."""

import os
import shutil
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from stagewise.streaming import jobs
from stagewise.streaming import stateful as S

T0 = datetime(2024, 1, 1)
SCHEMA = "k long, kind string, minute int, done boolean, package string, status string"


def stream_of(spark, folder, batches):
    """A stream that brings one batch a file."""
    for i, rows in enumerate(batches):
        path = f"{folder}/in-{i}"
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(path)
        part = next(f for f in os.listdir(path) if f.endswith(".parquet"))
        os.makedirs(f"{folder}/in", exist_ok=True)
        shutil.copy(f"{path}/{part}", f"{folder}/in/{i}.parquet")
        os.utime(f"{folder}/in/{i}.parquet", (1_700_000_000 + i, 1_700_000_000 + i))
    s = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
    return s.withColumn("at", F.lit(T0) + F.make_dt_interval(mins=F.col("minute")))


def minutes(t):
    return (t - T0) / timedelta(minutes=1)


def run(spark, stream, folder):
    with S.state_store(spark):
        return jobs.run_once(stream, str(folder)).collect()


def sign(k, kind, minute, done=False):
    return (k, kind, minute, done, None, None)


SIGNS = [[sign(1, "slow", 0), sign(2, "fast", 0), sign(3, "fast", 0), sign(4, "fast", 0)], [sign(1, "fast", 25), sign(2, "slow", 8), sign(3, "x", 5, True), sign(4, "fast", 30)], [sign(9, "slow", 300)]]


@pytest.mark.parametrize("batches", [SIGNS, [sum(SIGNS, [])]])
def test_deadlines_by_kind(spark, tmp_path, batches):
    lost = S.lost_by_deadline(stream_of(spark, tmp_path, batches), "k", "kind", "at", F.col("done"), {"slow": 1800, "fast": 600}, 60, "1 minute")
    got = sorted((r.k, r.kind, minutes(r.began), minutes(r.last), minutes(r.deadline)) for r in run(spark, lost, tmp_path / "out"))
    # 1 is slow from its first sign on; 2 was kept alive once; 3 is done; 4 was lost twice, before and after it came back
    assert got == [(1, "slow", 0, 25, 55), (2, "fast", 0, 8, 18), (4, "fast", 0, 0, 10), (4, "fast", 30, 30, 40)]


def test_results_live_for_a_time(spark, tmp_path):
    row = lambda k, minute, asked: (k, None, minute, asked, None, None)
    s = stream_of(spark, tmp_path, [[row(1, 0, False), row(1, 5, True), row(2, 5, True)], [row(1, 30, True), row(3, 30, False), row(3, 35, False), row(3, 44, True)], [row(9, 300, True)]])
    got = run(spark, S.results_with_ttl(s, "k", "at", F.col("done"), F.col("minute"), 600, "1 minute"), tmp_path / "out")
    assert sorted((r.k, minutes(r.at), r.answer, r.value) for r in got) == [
        (1, 5, "FOUND", "0"), (1, 10, "EVICTED", "0"), (1, 30, "UNKNOWN", None), (2, 5, "UNKNOWN", None), (3, 44, "FOUND", "35"), (3, 45, "EVICTED", "35"), (9, 300, "UNKNOWN", None),
    ]


def test_inbox_defers_and_releases_in_order(spark, tmp_path):
    new = lambda k, minute, package=None, status=None: (k, None, minute, False, package, status)
    s = stream_of(spark, tmp_path, [
        [new(1, 0, "a"), new(1, 1, None, "FINALIZED"), new(1, 2, "z"), new(1, 3, "b")], [new(1, 4, "z"), new(1, 5, None, "PROCESSING"), new(1, 6, "c")],
        [new(1, 7, None, "DRAFT"), new(1, 8, "c"), new(1, 9, "a"), new(2, 9, "a")],
    ])
    got = run(spark, S.inbox(s, "k", "package", "status", "at"), tmp_path / "out")
    assert sorted((r.k, minutes(r.at), r.package, r.state) for r in got) == [
        (1, 0, "a", "APPLIED"), (1, 2, "z", "DEFERRED"), (1, 3, "b", "DEFERRED"), (1, 7, "b", "APPLIED"), (1, 7, "z", "APPLIED"), (1, 8, "c", "APPLIED"), (2, 9, "a", "APPLIED"),
    ]


@pytest.mark.parametrize("lost", ["commit", "none"])
def test_a_repeated_batch_keeps_all_rows(spark, tmp_path, lost):
    """5 rows, then 7 more (and 2 old ones); the second batch is pushed again after its commit was lost."""
    rows = [[sign(i, "p", i) for i in range(5)], [sign(i, "p", i) for i in range(3, 12)]]
    s = stream_of(spark, tmp_path, rows).select("k", "kind")
    folder = str(tmp_path / "sink")
    assert S.delivered(s, folder, "k").count() == 12
    if lost == "commit":
        for name in ("1", ".1.crc"):
            os.remove(f"{folder}/state/commits/{name}")
    got = S.delivered(s, folder, "k").collect()
    assert sorted(r.k for r in got) == list(range(12)) and {r.state for r in got} == {"DELIVERED"}


def test_an_entry_whose_process_is_not_final_is_cancelled(spark, tmp_path):
    s = stream_of(spark, tmp_path, [[sign(1, "a", 0), sign(2, "b", 0)], [sign(2, "b", 1), sign(1, "a", 1)]]).select("k", "kind")
    calls = []

    def final():
        calls.append(1)
        return spark.createDataFrame([("a",)] if len(calls) == 1 else [("a",), ("b",)], "kind string")

    got = S.delivered(s, str(tmp_path / "sink"), "k", "kind", final).collect()
    assert sorted((r.k, r.state) for r in got) == [(1, "DELIVERED"), (2, "CANCELLED"), (2, "DELIVERED")]
