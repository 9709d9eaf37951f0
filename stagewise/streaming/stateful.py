"""Keyed streams with state of their own: deadlines by timer, results with a time to live, an inbox that defers, a ledger.

Each key's state holds what is open now, so it is small; rows of a micro-batch are taken in the order of their
time, and what a timer would have done between two of them is done first. So the result is the same however the
stream is cut into batches, as long as rows come in the order of time across batches.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def state_store(spark: SparkSession) -> Iterator[None]:
    """Queries started inside keep their state in RocksDB, which timers and lists need; the setting is put back."""
    before = spark.conf.get(PROVIDER)
    spark.conf.set(PROVIDER, ROCKSDB)
    try:
        yield
    finally:
        spark.conf.set(PROVIDER, before)


def millis(t: pd.Timestamp) -> int:
    return t.value // 1_000_000


def in_order(batches: Iterator[pd.DataFrame], *order: str) -> list:
    """The rows of a key in this micro-batch, in order."""
    rows = pd.concat(list(batches))
    return list(rows.sort_values(list(order), kind="stable").itertuples(index=False))


class Deadlines(StatefulProcessor):
    """One open job a key: its first and last sign of life; lost if none comes for the time that its kind has."""

    def __init__(self, seconds: Mapping[str, int], default: int, job: str):
        self.seconds, self.default, self.job = dict(seconds), default, job

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getValueState("open", "kind string, began timestamp, last timestamp")

    def limit(self, kind: str, last: pd.Timestamp) -> pd.Timestamp:
        return last + pd.Timedelta(seconds=self.seconds.get(kind, self.default))

    def rows(self, key: tuple, lost: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame([(key[0], *r, self.limit(r[0], r[2])) for r in lost], columns=[self.job, "kind", "began", "last", "deadline"])

    def handleInputRows(self, key, rows, timerValues):
        now = tuple(self.open.get()) if self.open.exists() else None
        now = now and (now[0], pd.Timestamp(now[1]), pd.Timestamp(now[2]))
        lost = []
        for r in in_order(rows, "at", "done", "kind"):
            if now and self.limit(now[0], now[2]) < r.at:
                lost.append(now)
                now = None
            now = None if r.done else (now[0], now[1], r.at) if now else (r.kind, r.at, r.at)
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if now:
            self.open.update((now[0], now[1].to_pydatetime(), now[2].to_pydatetime()))
            self.handle.registerTimer(millis(self.limit(now[0], now[2])))
        else:
            self.open.clear()
        yield self.rows(key, lost)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        kind, began, last = self.open.get()
        self.open.clear()
        yield self.rows(key, [(kind, pd.Timestamp(began), pd.Timestamp(last))])

    def close(self) -> None:
        pass


def lost_by_deadline(stream: DataFrame, job: str, kind: str, time: str, done: Column, seconds: Mapping[str, int], default: int, delay: str) -> DataFrame:
    """(job, kind, began, last, deadline) of jobs that gave no sign of life for the time that their kind has.

    A job's kind is that of its first sign; every sign puts the deadline off; a done one ends the job without loss and
    the next sign opens another. A timer for each open job sweeps it once the watermark has passed its deadline.
    """
    rows = stream.withWatermark(time, delay).select(F.col(job), F.col(kind).alias("kind"), F.col(time).alias("at"), F.coalesce(done, F.lit(False)).alias("done"))
    out = f"`{job}` {stream.schema[job].dataType.simpleString()}, kind string, began timestamp, last timestamp, deadline timestamp"
    return rows.groupBy(job).transformWithStateInPandas(Deadlines(seconds, default, job), out, "Append", "EventTime")


class Results(StatefulProcessor):
    """The result of a key for a time after it came; requests are answered from it, a timer evicts it."""

    def __init__(self, ttl: int, key: str):
        self.ttl, self.key = pd.Timedelta(seconds=ttl), key

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getValueState("held", "at timestamp, value string")

    def handleInputRows(self, key, rows, timerValues):
        held = tuple(self.held.get()) if self.held.exists() else None
        held = held and (pd.Timestamp(held[0]), held[1])
        out = []
        for r in in_order(rows, "at", "asked", "value"):
            if held and held[0] + self.ttl < r.at:
                out.append((key[0], "EVICTED", held[0] + self.ttl, held[1]))
                held = None
            if not r.asked:
                held = (r.at, r.value)
            else:
                out.append((key[0], "FOUND" if held else "UNKNOWN", r.at, held[1] if held else None))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if held:
            self.held.update((held[0].to_pydatetime(), held[1]))
            self.handle.registerTimer(millis(held[0] + self.ttl))
        else:
            self.held.clear()
        yield pd.DataFrame(out, columns=[self.key, "answer", "at", "value"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        at, value = self.held.get()
        self.held.clear()
        yield pd.DataFrame([(key[0], "EVICTED", pd.Timestamp(at) + self.ttl, value)], columns=[self.key, "answer", "at", "value"])

    def close(self) -> None:
        pass


def results_with_ttl(stream: DataFrame, key: str, time: str, asked: Column, value: Column, ttl: int, delay: str) -> DataFrame:
    """(key, answer, at, value): FOUND or UNKNOWN for each request, EVICTED when a result's ``ttl`` seconds are over.

    A row is a result, or a request where ``asked``. A later result of a key replaces the one before and lives anew;
    of one moment a result comes before a request.
    """
    rows = stream.withWatermark(time, delay).select(F.col(key), F.col(time).alias("at"), F.coalesce(asked, F.lit(False)).alias("asked"), value.cast("string").alias("value"))
    out = f"`{key}` {stream.schema[key].dataType.simpleString()}, answer string, at timestamp, value string"
    return rows.groupBy(key).transformWithStateInPandas(Results(ttl, key), out, "Append", "EventTime")


# States of a process in which a package is put off, or left for the next time that it is sent.
FINAL_STATE, BUSY = "FINALIZED", ("PROCESSING", "COMPARING")


class Inbox(StatefulProcessor):
    """A process' state, the packages that it has seen and those that wait until it is open again."""

    def __init__(self, process: str):
        self.process = process

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.status = handle.getValueState("status", "status string")
        self.known = handle.getMapState("known", "package string", "state string")
        self.waiting = handle.getListState("waiting", "package string")

    def handleInputRows(self, key, rows, timerValues):
        status = self.status.get()[0] if self.status.exists() else None
        waiting = [w[0] for w in self.waiting.get()] if self.waiting.exists() else []
        out = []
        for r in in_order(rows, "at", "package", "status"):
            if pd.isna(r.package):
                status = r.status
                if status != FINAL_STATE and status not in BUSY:
                    out += [(key[0], p, "APPLIED", r.at) for p in waiting]
                    waiting = []
            elif status not in BUSY and not self.known.containsKey((r.package,)):
                state = "DEFERRED" if status == FINAL_STATE else "APPLIED"
                self.known.updateValue((r.package,), (state,))
                out.append((key[0], r.package, state, r.at))
                if state == "DEFERRED":
                    waiting.append(r.package)
        if status is not None:
            self.status.update((status,))
        if waiting:
            self.waiting.put([(p,) for p in waiting])
        else:
            self.waiting.clear()
        yield pd.DataFrame(out, columns=[self.process, "package", "state", "at"])

    def close(self) -> None:
        pass


def inbox(stream: DataFrame, process: str, package: str, status: str, time: str) -> DataFrame:
    """(process, package, state, at): what becomes of each package, each once.

    A row brings a package, or (with a null package) a process' new status. A package for a final process is
    DEFERRED and is APPLIED, in the order of arrival, as soon as the process is open again; one for a busy process is
    not recorded, so it is taken when it is sent again; any other one is APPLIED at once. A known package is ignored.
    """
    rows = stream.select(process, F.col(package).cast("string").alias("package"), F.col(status).cast("string").alias("status"), F.col(time).alias("at"))
    out = f"`{process}` {stream.schema[process].dataType.simpleString()}, package string, state string, at timestamp"
    return rows.groupBy(process).transformWithStateInPandas(Inbox(process), out, "Append", "None")


def delivered(stream: DataFrame, folder: str, key: str, process: str | None = None, final: Callable[[], DataFrame] | None = None) -> DataFrame:
    """(columns, state): the ledger of rows that a receiver gets, each key once: DELIVERED, or CANCELLED.

    Each micro-batch is one unit of the ledger, named by its number, and is replaced as a whole when Spark repeats
    it; its keys are held against the other units only, so a repeated batch finds its own keys free. A key whose
    process is not among the ``final`` ones (asked for at each push) is CANCELLED and may come again later; a
    delivered one is ignored from then on. Of rows with one key in a batch the least stays.
    """
    out, spark, columns = f"{folder}/ledger", stream.sparkSession, stream.columns
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in stream.schema)

    def ledger() -> DataFrame:
        return spark.read.schema(f"{schema}, state string, batch long").option("basePath", out).parquet(f"{out}/batch=*")

    def push(rows: DataFrame, batch: int) -> None:
        rows = rows.groupBy(key).agg(F.min(F.struct(*columns)).alias("_row")).select("_row.*")
        if batch:
            rows = rows.join(ledger().filter((F.col("batch") < batch) & (F.col("state") == "DELIVERED")).select(key), key, "left_anti")
        state = F.lit("DELIVERED")
        if final is not None:
            rows = rows.join(final().select(process).distinct().withColumn("_final", F.lit(True)), process, "left")
            state = F.when(F.col("_final"), "DELIVERED").otherwise("CANCELLED")
        rows.select(*columns, state.alias("state")).write.mode("overwrite").parquet(f"{out}/batch={batch}")

    stream.writeStream.option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).foreachBatch(push).start().awaitTermination()
    return ledger().drop("batch")
