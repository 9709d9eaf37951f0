"""Stream behaviour over the events table, run to the end of what is there."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stagewise import scratch
from stagewise.sources.documents import flow_layout
from stagewise.streaming import jobs, stateful

from .registry import Tables, query


def event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events file as a stream; a path pattern, as file streams read folders."""
    schema = Tables(spark, sf_dir).events.schema
    rows = spark.readStream.schema(schema).parquet(f"{sf_dir}/events.parque[t]")
    return rows.withColumn("at", F.col("ts").cast("timestamp"))


def own_folder(spark: SparkSession) -> str:
    return f"{scratch.folder(spark)}/stream-{uuid.uuid4().hex}"


def finished(stream: DataFrame, mode: str = "append", keys: tuple[str, ...] = ()) -> DataFrame:
    return jobs.run_once(stream, own_folder(stream.sparkSession), mode, keys)


@query("stm01_once_each", "SELECT count(DISTINCT event_id) messages FROM events")
def stm01(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = event_stream(spark, sf_dir)
    twice = s.withColumn("copy", F.explode(F.array(F.lit(1), F.lit(2))))
    return finished(jobs.once_each(twice, "event_id", "at")).agg(F.count("*").alias("messages"))


@query("stm05_late_results", "SELECT event_id FROM events WHERE user_id % 5 <> 2")
def stm05(spark: SparkSession, sf_dir: str) -> DataFrame:
    active = Tables(spark, sf_dir).events.filter("user_id % 5 <> 2").select("user_id").distinct()
    return finished(jobs.current_only(event_stream(spark, sf_dir), active, ["user_id"]).select("event_id"))


@query("stm04_barrier", "SELECT o_custkey, count(*) files FROM orders GROUP BY 1 HAVING count(*) FILTER (o_orderstatus IN ('O', 'P')) = 0")
def stm04(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs.barrier(Tables(spark, sf_dir).orders, "o_custkey", "o_orderstatus", ["O", "P"])


@query("stm10_weekly_windows", "SELECT strftime(date_trunc('week', ts + INTERVAL 3 HOUR) - INTERVAL 3 HOUR, '%Y-%m-%d %H:%M') AS start, event_type, count(*) n FROM events GROUP BY 1, 2")
def stm10(spark: SparkSession, sf_dir: str) -> DataFrame:
    # epoch is a Thursday: Monday 00:00 at UTC+3 is 3 days 21 hours later
    s = jobs.tumbling(event_stream(spark, sf_dir), "at", "7 days", "93 hours", "1 day", ["event_type"])
    rows = finished(s.select(F.date_format("window.start", "yyyy-MM-dd HH:mm").alias("start"), "event_type", "n"), "complete")
    return rows.select("start", "event_type", "n")


@query("stm09_login_throttle", """WITH f AS (SELECT *, ts - lag(ts, 4) OVER (PARTITION BY user_id ORDER BY ts, event_id) d FROM events WHERE event_type = 'error') SELECT user_id, count(*) FILTER (d <= INTERVAL 86400 SECOND) blocked FROM f GROUP BY 1""")
def stm09(spark: SparkSession, sf_dir: str) -> DataFrame:
    from stagewise.operators.relational import kth_previous

    e = kth_previous(Tables(spark, sf_dir).events.filter("event_type = 'error'"), ["user_id"], "ts", 4, ["ts", "event_id"])
    return e.groupBy("user_id").agg(F.count_if(F.col("ts") - F.col("kth_time") <= F.expr("INTERVAL '86400' SECOND")).alias("blocked"))


@query("stm06_outbox_due", "SELECT event_id, strftime(ts + to_seconds([60, 300, 900][(event_id % 3) + 1]), '%Y-%m-%d %H:%M:%S') due FROM events WHERE event_type <> 'purchase' AND ts + to_seconds([60, 300, 900][(event_id % 3) + 1]) <= TIMESTAMP '2024-01-20'")
def stm06(spark: SparkSession, sf_dir: str) -> DataFrame:
    delay = F.element_at(F.array(F.lit(60), F.lit(300), F.lit(900)), (F.col("event_id") % 3 + 1).cast("int"))
    e = Tables(spark, sf_dir).events.filter("event_type <> 'purchase'").withColumn("due", F.col("ts") + F.make_dt_interval(secs=delay))
    return e.filter(F.col("due") <= F.lit("2024-01-20").cast("timestamp_ntz")).select("event_id", F.date_format("due", "yyyy-MM-dd HH:mm:ss").alias("due"))


@query("src16_flow_layout", """WITH l AS (SELECT conv_id, turn, greatest(ceil(length(text) / 100), 1) n FROM conversations), s AS (SELECT *, sum(n) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) - n b FROM l) SELECT conv_id, turn, (floor(b / 50) + 1)::INT page, (b % 50)::INT line FROM s""")
def src16(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flow_layout(Tables(spark, sf_dir).conversations.select("conv_id", "turn", "text"), "conv_id", "turn", "text").select("conv_id", "turn", "page", "line")


@query("src17_cache_misses", "SELECT sha256(doc_id::VARCHAR) sha256 FROM documents WHERE doc_id % 3 <> 0")
def src17(spark: SparkSession, sf_dir: str) -> DataFrame:
    from stagewise.sources.documents import cache_misses

    d = Tables(spark, sf_dir).documents.select("doc_id", F.sha2(F.col("doc_id").cast("string"), 256).alias("sha256"))
    return cache_misses(d.select("sha256"), d.filter("doc_id % 3 = 0").select("sha256", F.lit("1").alias("version")), "1")


@query("src08_row_errors", "SELECT p_partkey AS row, unnest(list_filter([CASE WHEN p_size > 40 THEN 'size' END, CASE WHEN p_brand = 'Brand#11' THEN 'brand' END], lambda x: x IS NOT NULL)) error FROM part")
def src08(spark: SparkSession, sf_dir: str) -> DataFrame:
    from stagewise.sources.tabular import checked_rows

    rows = Tables(spark, sf_dir).part.withColumnRenamed("p_partkey", "row")
    return checked_rows(rows, {"size": F.col("p_size") <= 40, "brand": F.col("p_brand") != "Brand#11"})[1]


@query("src22_parameterised_sql", "SELECT o_orderkey FROM orders WHERE o_custkey BETWEEN 10 AND 40 AND o_orderstatus = 'F'")
def src22(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql("SELECT o_orderkey FROM {orders} WHERE o_custkey BETWEEN :low AND :high AND o_orderstatus = :status", args={"low": 10, "high": 40, "status": "F"}, orders=Tables(spark, sf_dir).orders)


@query("jsn02_contract_check", "SELECT event_id FROM events WHERE try_cast(json_extract(props, '$.k') AS BIGINT) IS NULL OR value IS NULL OR event_id % 11 = 0")
def jsn02(spark: SparkSession, sf_dir: str) -> DataFrame:
    body = F.when(F.col("event_id") % 11 == 0, F.lit("{broken")).otherwise(F.col("props"))
    return Tables(spark, sf_dir).events.filter(F.from_json(body, "k BIGINT")["k"].isNull() | F.col("value").isNull()).select("event_id")


SIGNS_SQL = "s AS (SELECT user_id, event_id, ts, row_number() OVER w i, CASE event_type WHEN 'error' THEN 'FAILED' WHEN 'purchase' THEN CASE WHEN event_id % 3 = 0 THEN 'DONE' ELSE 'SENT' END WHEN 'click' THEN CASE WHEN event_id % 5 = 0 THEN 'TIMEOUT' ELSE 'SENT' END ELSE 'SENT' END sign FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts))"


def sign_of() -> Column:
    kind, n = F.col("event_type"), F.col("event_id")
    return F.when(kind == "error", "FAILED").when((kind == "purchase") & (n % 3 == 0), "DONE").when((kind == "click") & (n % 5 == 0), "TIMEOUT").otherwise("SENT")


@query("stm02_lifecycle_stream", f"""WITH {SIGNS_SQL}, f AS (SELECT *, count(*) FILTER (sign = 'FAILED') OVER (PARTITION BY user_id ORDER BY i) fails FROM s),
  e AS (SELECT user_id, min(i) FILTER (sign IN ('DONE','TIMEOUT') OR (sign = 'FAILED' AND fails = 3)) stop FROM f GROUP BY 1)
  SELECT f.user_id, CASE WHEN max(stop) IS NULL THEN 'SENT' WHEN bool_or(i = stop AND sign = 'DONE') THEN 'DONE' ELSE 'FAILED' END status, 1 + least(2, count(*) FILTER (sign = 'FAILED' AND i <= coalesce(stop, i) AND NOT (i = stop AND fails = 3))) attempt
  FROM f JOIN e USING (user_id) GROUP BY 1""")
def stm02_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    signs = event_stream(spark, sf_dir).select("user_id", sign_of().alias("sign"), "at")
    return finished(jobs.lifecycles(signs, "user_id", "sign", "at"), "update", ("user_id",)).select("user_id", "status", "attempt")


@query("stm03_lost_sessions", """WITH g AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 12 HOUR THEN 0 ELSE 1 END opens FROM events),
  n AS (SELECT *, sum(opens) OVER (PARTITION BY user_id ORDER BY ts) n FROM g), s AS (SELECT user_id, n, min(ts) began, max(ts) AS last, bool_or(event_type = 'purchase') done FROM n GROUP BY 1, 2)
  SELECT user_id, strftime(began, '%Y-%m-%d %H:%M:%S') began, strftime(last, '%Y-%m-%d %H:%M:%S') AS last FROM s WHERE NOT done AND last + INTERVAL 12 HOUR <= (SELECT max(ts) FROM events) - INTERVAL 1 HOUR""")
def stm03_lost(spark: SparkSession, sf_dir: str) -> DataFrame:
    lost = jobs.lost_jobs(event_stream(spark, sf_dir), "at", "user_id", F.col("event_type") == "purchase", "12 hours", "1 hour")
    shown = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c)
    return finished(lost).select("user_id", shown("began"), shown("last"))


@query("stm06_snk07_delivered_once", "SELECT user_id || ':v' || (event_id % 4) AS key, CASE WHEN user_id % 3 = 0 THEN 'CANCELLED' ELSE 'DELIVERED' END state FROM events WHERE event_type = 'purchase' GROUP BY ALL")
def stm06_delivered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results pushed by process and version, each of which comes several times; those of open processes are cancelled."""
    s = event_stream(spark, sf_dir).filter("event_type = 'purchase'").withColumn("copy", F.explode(F.array(F.lit(1), F.lit(2))))
    keyed = s.select(F.concat(F.col("user_id").cast("string"), F.lit(":v"), (F.col("event_id") % 4).cast("string")).alias("key"), "user_id", "value")
    final = Tables(spark, sf_dir).events.filter("user_id % 3 <> 0").select("user_id")
    return stateful.delivered(keyed, own_folder(spark), "key", "user_id", lambda: final).select("key", "state").distinct()


def with_state(stream: DataFrame) -> DataFrame:
    with stateful.state_store(stream.sparkSession):
        return finished(stream)


def shown(column: str) -> Column:
    return F.date_format(column, "yyyy-MM-dd HH:mm:ss").alias(column)


LIMIT_SQL = "CASE {0} WHEN 'view' THEN INTERVAL 6 HOUR WHEN 'click' THEN INTERVAL 12 HOUR WHEN 'signup' THEN INTERVAL 24 HOUR ELSE INTERVAL 48 HOUR END"


@query("stm03_deadlines_by_kind", f"""WITH RECURSIVE o AS (SELECT user_id, ts, event_type kind, event_type = 'purchase' done, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_type = 'purchase', event_type) i FROM events),
  w AS (SELECT user_id, i, NOT done AS open, kind, ts AS began, ts AS last, NULL::VARCHAR lk, NULL::TIMESTAMP lb, NULL::TIMESTAMP ll FROM o WHERE i = 1 UNION ALL
    SELECT n.user_id, n.i, NOT n.done, CASE WHEN w.open AND NOT gone THEN w.kind ELSE n.kind END, CASE WHEN w.open AND NOT gone THEN w.began ELSE n.ts END, n.ts, CASE WHEN w.open AND gone THEN w.kind END, w.began, w.last
    FROM (SELECT w.*, w.last + {LIMIT_SQL.format("w.kind")} stop FROM w) w JOIN o n ON n.user_id = w.user_id AND n.i = w.i + 1 CROSS JOIN LATERAL (SELECT w.stop < n.ts AS gone)),
  lost AS (SELECT user_id, lk kind, lb began, ll AS last FROM w WHERE lk IS NOT NULL UNION ALL SELECT user_id, kind, began, last FROM w WHERE open AND i = (SELECT max(i) FROM o WHERE o.user_id = w.user_id) AND last + {LIMIT_SQL.format("kind")} < (SELECT max(ts) FROM events) - INTERVAL 1 HOUR)
  SELECT user_id, kind, strftime(began, '%Y-%m-%d %H:%M:%S') began, strftime(last, '%Y-%m-%d %H:%M:%S') AS last, strftime(last + {LIMIT_SQL.format("kind")}, '%Y-%m-%d %H:%M:%S') deadline FROM lost""")
def stm03_deadlines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Open jobs of users, each with the time of its first sign's kind; timers sweep those that went silent."""
    hour = 3600
    lost = stateful.lost_by_deadline(event_stream(spark, sf_dir), "user_id", "event_type", "at", F.col("event_type") == "purchase", {"view": 6 * hour, "click": 12 * hour, "signup": 24 * hour}, 48 * hour, "1 hour")
    return with_state(lost).select("user_id", "kind", shown("began"), shown("last"), shown("deadline"))


@query("stm11_results_with_ttl", """WITH e AS (SELECT user_id, ts, event_type <> 'purchase' asked, event_id::VARCHAR v, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_type <> 'purchase', event_id::VARCHAR) i, lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_type <> 'purchase', event_id::VARCHAR) next_ts FROM events),
  r AS (SELECT *, lead(ts) OVER (PARTITION BY user_id ORDER BY i) replaced FROM e WHERE NOT asked), q AS (SELECT e.user_id, e.ts, r.v, r.ts held FROM e ASOF LEFT JOIN r ON r.user_id = e.user_id AND e.i >= r.i WHERE e.asked),
  late AS (SELECT r.user_id, r.ts, r.v, (SELECT min(e.ts) FROM e WHERE e.user_id = r.user_id AND e.i > r.i AND e.ts > r.ts + INTERVAL 3 DAY) after FROM r WHERE replaced IS NULL OR replaced > ts + INTERVAL 3 DAY)
  SELECT user_id, CASE WHEN held + INTERVAL 3 DAY >= ts THEN 'FOUND' ELSE 'UNKNOWN' END answer, strftime(ts, '%Y-%m-%d %H:%M:%S') AS at, CASE WHEN held + INTERVAL 3 DAY >= ts THEN v END AS value FROM q
  UNION ALL SELECT user_id, 'EVICTED', strftime(ts + INTERVAL 3 DAY, '%Y-%m-%d %H:%M:%S'), v FROM late WHERE after IS NOT NULL OR ts + INTERVAL 3 DAY < (SELECT max(ts) FROM events) - INTERVAL 1 HOUR""")
def stm11_ttl(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user's last purchase is the result that other events ask for; it lives for three days."""
    rows = stateful.results_with_ttl(event_stream(spark, sf_dir), "user_id", "at", F.col("event_type") != "purchase", F.col("event_id"), 3 * 86_400, "1 hour")
    return with_state(rows).select("user_id", "answer", shown("at"), "value")


@query("stm07_deferring_inbox", """WITH e AS (SELECT user_id, ts, CASE WHEN event_type IN ('view', 'click') THEN 'p' || (event_id % 50) END p, CASE event_type WHEN 'signup' THEN 'FINALIZED' WHEN 'error' THEN 'PROCESSING' WHEN 'purchase' THEN 'DRAFT' END s FROM events),
  o AS (SELECT *, row_number() OVER w i FROM e WINDOW w AS (PARTITION BY user_id ORDER BY ts, p NULLS LAST, s)), n AS (SELECT *, last_value(s IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY i) now FROM o),
  a AS (SELECT user_id, p, min(i) i FROM n WHERE p IS NOT NULL AND now IS DISTINCT FROM 'PROCESSING' GROUP BY 1, 2), k AS (SELECT a.*, n.ts, n.now FROM a JOIN n USING (user_id, i)),
  f AS (SELECT k.user_id, k.p, min(n.i) i FROM k JOIN n ON n.user_id = k.user_id AND n.i > k.i AND n.s = 'DRAFT' WHERE k.now = 'FINALIZED' GROUP BY 1, 2)
  SELECT user_id, p package, CASE WHEN now = 'FINALIZED' THEN 'DEFERRED' ELSE 'APPLIED' END state, strftime(ts, '%Y-%m-%d %H:%M:%S') AS at FROM k UNION ALL SELECT f.user_id, f.p, 'APPLIED', strftime(n.ts, '%Y-%m-%d %H:%M:%S') FROM f JOIN n USING (user_id, i)""")
def stm07_inbox(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packages of a user, some sent again, between changes of the user's process."""
    kind = F.col("event_type")
    rows = event_stream(spark, sf_dir).select(
        "user_id", "at", F.when(kind.isin("view", "click"), F.concat(F.lit("p"), (F.col("event_id") % 50).cast("string"))).alias("package"),
        F.when(kind == "signup", "FINALIZED").when(kind == "error", "PROCESSING").when(kind == "purchase", "DRAFT").alias("status"),
    )
    return with_state(stateful.inbox(rows, "user_id", "package", "status", "at")).select("user_id", "package", "state", shown("at"))


@query("stm06_due_attempts", "SELECT event_id, strftime(ts + to_seconds([0, 60, 300, 900][(event_id % 5)::INT + 1]), '%Y-%m-%d %H:%M:%S') due FROM events WHERE event_id % 5 <= 3 AND ts + to_seconds([0, 60, 300, 900][(event_id % 5)::INT + 1]) <= TIMESTAMP '2024-01-20'")
def stm06_due(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = Tables(spark, sf_dir).events.select("event_id", F.col("ts").alias("created"), (F.col("event_id") % 5).cast("int").alias("attempts"))
    return jobs.due(rows, (60, 300, 900), F.lit("2024-01-20").cast("timestamp_ntz")).select("event_id", F.date_format("due", "yyyy-MM-dd HH:mm:ss").alias("due"))


@query("stm07_received_packages", "SELECT event_id package, CASE WHEN user_id % 4 = 1 THEN 'DEFERRED' ELSE 'APPLIED' END state FROM events WHERE event_id % 6 <> 0")
def stm07_received(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = Tables(spark, sf_dir).events.select(F.col("event_id").alias("package"), F.col("user_id").alias("process"))
    return jobs.received(e.unionByName(e), e.filter("package % 6 = 0"), e.filter("process % 4 = 1"), "package", "process").select("package", "state")


@query("stm08_audit_operations", """WITH a AS (SELECT user_id, ts, event_id, CASE WHEN event_type IN ('signup', 'view') THEN 'start' ELSE 'finish' END phase FROM events), n AS (SELECT *, lead(phase) OVER w nxt, lead(ts) OVER w AS next_ts FROM a WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
  SELECT user_id, strftime(ts, '%Y-%m-%d %H:%M:%S') began, CASE WHEN nxt = 'finish' THEN strftime(next_ts, '%Y-%m-%d %H:%M:%S') END ended FROM n WHERE phase = 'start'""")
def stm08(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The audit is appended to by a stream; operations are read from what was appended."""
    phase = F.when(F.col("event_type").isin("signup", "view"), "start").otherwise("finish")
    audit = finished(event_stream(spark, sf_dir).select("user_id", "at", "event_id", phase.alias("phase")))
    shown = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c)
    return jobs.operations(audit, "user_id", "at", "phase", "event_id").select("user_id", shown("began"), shown("ended"))


@query("stm11_kept_results", "SELECT event_id FROM events WHERE event_type = 'view' OR ts > TIMESTAMP '2024-01-25' - INTERVAL 7 DAY")
def stm11(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = Tables(spark, sf_dir).events.select("event_id", F.when(F.col("event_type") != "view", F.col("ts")).alias("finished"))
    return jobs.kept_results(rows, F.lit("2024-01-25").cast("timestamp_ntz"), "7 DAYS", "finished").select("event_id")


@query("stm12_incremental_update", """WITH o AS (SELECT o_custkey k, count(*) n, max(o_totalprice) top FROM orders WHERE o_orderkey % 2 = 0 GROUP BY 1), c AS (SELECT o_custkey k, count(*) n, max(o_totalprice) top FROM orders GROUP BY 1)
  SELECT c.k, c.n, c.top, o.k IS NULL OR o.n <> c.n AS recomputed FROM c LEFT JOIN o ON o.k = c.k""")
def stm12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """New files arrive: only the processes they belong to are computed again, the others are carried over."""
    from stagewise.operators.relational import recomputed

    orders = Tables(spark, sf_dir).orders.withColumnRenamed("o_custkey", "k")
    compute = lambda rows: rows.groupBy("k").agg(F.count("*").alias("n"), F.max("o_totalprice").alias("top"))
    before = compute(orders.filter("o_orderkey % 2 = 0"))
    return recomputed(before, orders, orders.filter("o_orderkey % 2 <> 0"), "k", compute)
