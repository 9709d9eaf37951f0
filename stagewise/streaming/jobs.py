"""Streams of job results: idempotent intake, late results, barriers and throttles."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def once_each(stream: DataFrame, message: str, time: str, delay: str = "1 hour") -> DataFrame:
    """At-least-once delivery made exactly-once: repeats of a message within the delay are dropped."""
    return stream.withWatermark(time, delay).dropDuplicatesWithinWatermark([message])


def current_only(results: DataFrame, active: DataFrame, keys: list[str]) -> DataFrame:
    """Results for jobs that are still active under the same version; stale ones are dropped."""
    return results.join(active, keys, "left_semi")


def tumbling(stream: DataFrame, time: str, width: str, offset: str, delay: str, keys: list[str]) -> DataFrame:
    """Counts of each window that starts at the offset; state ends with the watermark."""
    return stream.withWatermark(time, delay).groupBy(F.window(time, width, width, offset), *keys).agg(F.count("*").alias("n"))


def sessions(stream: DataFrame, time: str, gap: str, delay: str, keys: list[str]) -> DataFrame:
    """An extension: activity sessions that end after a gap."""
    return stream.withWatermark(time, delay).groupBy(F.session_window(time, gap), *keys).agg(F.count("*").alias("n"))


def barrier(states: DataFrame, process: str, state: str, open_states: list[str]) -> DataFrame:
    """Processes none of whose files is still in an open state, with their number of files."""
    by = states.groupBy(process).agg(F.count_if(F.col(state).isin(open_states)).alias("open"), F.count("*").alias("files"))
    return by.filter("open = 0").select(process, "files")


def lost_jobs(stream: DataFrame, time: str, job: str, done: Column, deadline: str, delay: str) -> DataFrame:
    """(job, began, last): jobs that gave no sign of life for the deadline and were not done.

    Each sign extends the deadline, so a job's signs are a session that ends after a gap; it comes out once
    the watermark has passed its end.
    """
    by = stream.withWatermark(time, delay).groupBy(job, F.session_window(time, deadline)).agg(F.bool_or(done).alias("done"), F.min(time).alias("began"), F.max(time).alias("last"))
    return by.filter("NOT done").select(job, "began", "last")


# States of a job, and how often a failed one is sent again.
FINAL, MOST_RETRIES = ("DONE", "FAILED", "SUPERSEDED"), 2


def next_state(status: str, attempt: int, sign: str) -> tuple[str, int]:
    """State and attempt after a sign: a failure is retried a few times, a timeout never; a final state stays."""
    if status in FINAL:
        return status, attempt
    if sign == "FAILED" and attempt <= MOST_RETRIES:
        return "SENT", attempt + 1
    if sign in ("FAILED", "TIMEOUT"):
        return "FAILED", attempt
    return (sign if sign in FINAL else "SENT"), attempt


def lifecycles(stream: DataFrame, job: str, sign: str, order: str) -> DataFrame:
    """(job, status, attempt) after each micro-batch with a sign of the job; signs of a batch are taken in order."""
    import pandas as pd

    def advance(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        status, attempt = state.get if state.exists else ("SENT", 1)
        signs = pd.concat(list(batches)).sort_values(order, kind="stable")
        for s in signs[sign]:
            status, attempt = next_state(status, attempt, s)
        state.update((status, attempt))
        yield pd.DataFrame({job: [key[0]], "status": [status], "attempt": [attempt]})

    kind = stream.schema[job].dataType.simpleString()
    return stream.select(job, sign, order).groupBy(job).applyInPandasWithState(advance, f"`{job}` {kind}, status string, attempt int", "status string, attempt int", "update", "NoTimeout")


def due(outbox: DataFrame, delays: Sequence[int], now: Column, attempts: str = "attempts", created: str = "created") -> DataFrame:
    """Outbox rows whose turn has come: the first attempt at once, later ones after their delays in seconds, none after the last."""
    waits = F.array(*map(F.lit, (0, *delays)))
    at = F.col(created) + F.make_dt_interval(secs=F.get(waits, F.col(attempts)))
    return outbox.withColumn("due", at).filter((F.col(attempts) <= len(delays)) & (F.col("due") <= now))


def received(packages: DataFrame, known: DataFrame, finalised: DataFrame, package: str, process: str) -> DataFrame:
    """New packages with their state: DEFERRED while the process is finalised, else APPLIED; known ones don't come again."""
    fresh = packages.dropDuplicates([package]).join(known.select(package), package, "left_anti")
    marked = fresh.join(finalised.select(process).distinct().withColumn("_final", F.lit(True)), process, "left")
    return marked.withColumn("state", F.when(F.col("_final"), "DEFERRED").otherwise("APPLIED")).drop("_final")


def operations(audit: DataFrame, actor: str, time: str, phase: str, tie: str) -> DataFrame:
    """(actor, began, ended) of an append-only audit's two-phase entries: each start with the next entry if that is a finish."""
    w = Window.partitionBy(actor).orderBy(time, tie)
    rows = audit.withColumn("_next", F.lead(phase).over(w)).withColumn("_at", F.lead(time).over(w)).filter(F.col(phase) == "start")
    return rows.select(actor, F.col(time).alias("began"), F.when(F.col("_next") == "finish", F.col("_at")).alias("ended"))


def kept_results(results: DataFrame, now: Column, ttl: str, finished: str) -> DataFrame:
    """Results that are younger than their time to live; one that isn't finished stays."""
    return results.filter(F.col(finished).isNull() | (F.col(finished) > now - F.expr(f"INTERVAL {ttl}")))


def run_once(stream: DataFrame, folder: str, mode: str = "append", keys: Sequence[str] = ()) -> DataFrame:
    """Process what is there, then stop; the result is a written table under ``folder``, beside the state.

    A complete result replaces the table with each batch, an appended one grows it exactly once. Of an
    updated one the last row of each of ``keys`` counts; a batch that is repeated writes the same place.
    """
    out = f"{folder}/table"
    writer = stream.writeStream.option("checkpointLocation", f"{folder}/state").outputMode(mode).trigger(availableNow=True)
    if mode == "append":
        q = writer.format("parquet").option("path", out).start()
    elif mode == "update":
        writer.foreachBatch(lambda rows, batch: rows.write.mode("overwrite").parquet(f"{out}/batch={batch}")).start().awaitTermination()
        rows = stream.sparkSession.read.schema(f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in stream.schema)}, batch int").option("basePath", out).parquet(f"{out}/batch=*")
        last = F.max_by(F.struct(*(c for c in stream.columns if c not in keys)), "batch").alias("_last")
        return rows.groupBy(*keys).agg(last).select(*keys, "_last.*")
    else:
        q = writer.foreachBatch(lambda rows, _: rows.write.mode("overwrite").parquet(out)).start()
    q.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(out)
