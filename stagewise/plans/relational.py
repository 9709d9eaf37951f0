"""Lists, lookups, rankings and reports over the relational tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stagewise.operators import relational as O

from .registry import Tables, query


def priority() -> Column:
    return F.when(F.col("o_orderpriority") == "1-URGENT", 0).when(F.col("o_orderpriority") == "2-HIGH", 1).otherwise(2)


@query("flt01_findings_list", """SELECT o_orderkey, o_orderstatus, o_orderpriority FROM orders WHERE o_orderstatus = 'O' AND o_orderpriority IN ('1-URGENT','2-HIGH') AND o_totalprice > 1000""")
def flt01(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = {"status": "O", "priorities": ["1-URGENT", "2-HIGH"], "least": 1000.0, "customer": None}
    given = [
        F.col("o_orderstatus") == wanted["status"], F.col("o_orderpriority").isin(wanted["priorities"]), F.col("o_totalprice") > wanted["least"],
        None if wanted["customer"] is None else F.col("o_custkey") == wanted["customer"],
    ]
    return Tables(spark, sf_dir).orders.filter(O.every(given)).select("o_orderkey", "o_orderstatus", "o_orderpriority")


@query("flt02_exists_fragment", "SELECT o_orderkey, o_orderstatus FROM orders WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R' AND l_quantity > 48)")
def flt02(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = Tables(spark, sf_dir)
    has = t.lineitem.filter((F.col("l_returnflag") == "R") & (F.col("l_quantity") > 48)).select(F.col("l_orderkey").alias("o_orderkey"))
    return t.orders.join(has, "o_orderkey", "left_semi").select("o_orderkey", "o_orderstatus")


@query("flt03_object_search", "SELECT c_custkey, c_name FROM customer WHERE (lower(c_name) LIKE '%12%' OR lower(c_mktsegment) LIKE '%build%') AND c_acctbal >= 0")
def flt03(spark: SparkSession, sf_dir: str) -> DataFrame:
    like = lambda c, x: F.lower(c).contains(x)
    return Tables(spark, sf_dir).customer.filter((like("c_name", "12") | like("c_mktsegment", "build")) & (F.col("c_acctbal") >= 0)).select("c_custkey", "c_name")


@query("flt04_filter_on_derived", "SELECT o_custkey, count(*) orders, count(*) FILTER (o_orderstatus='F') done FROM orders GROUP BY 1 HAVING count(*) FILTER (o_orderstatus='F') > count(*) / 2.0")
def flt04(spark: SparkSession, sf_dir: str) -> DataFrame:
    by = Tables(spark, sf_dir).orders.groupBy("o_custkey").agg(F.count("*").alias("orders"), F.count_if(F.col("o_orderstatus") == "F").alias("done"))
    return by.filter(F.col("done") > F.col("orders") / 2)


@query("flt05_matrix_list", "SELECT p_partkey, p_name FROM part WHERE p_brand = 'Brand#11' OR contains(lower(p_name), 'a') AND p_size > 40")
def flt05(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Tables(spark, sf_dir).part.filter((F.col("p_brand") == "Brand#11") | F.lower("p_name").contains("a") & (F.col("p_size") > 40)).select("p_partkey", "p_name")


@query("flt06_audit_list", "SELECT event_id, user_id, event_type FROM events WHERE event_type LIKE 'p%' AND ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-20'")
def flt06(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = lambda d: F.lit(d).cast("timestamp_ntz")
    return Tables(spark, sf_dir).events.filter(F.col("event_type").startswith("p") & (F.col("ts") >= at("2024-01-05")) & (F.col("ts") < at("2024-01-20"))).select("event_id", "user_id", "event_type")


@query("flt07_visible_notifications", """WITH n AS (SELECT event_id, CASE WHEN user_id % 3 = 0 THEN NULL ELSE user_id END owner, CASE WHEN event_type = 'view' THEN NULL ELSE event_type END aim FROM events)
  SELECT event_id FROM n WHERE owner = 7 OR (owner IS NULL AND (aim IS NULL OR aim = 'click'))""")
def flt07(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = Tables(spark, sf_dir).events.select("event_id", F.when(F.col("user_id") % 3 != 0, F.col("user_id")).alias("owner"), F.when(F.col("event_type") != "view", F.col("event_type")).alias("aim"))
    return n.filter((F.col("owner") == 7) | F.col("owner").isNull() & (F.col("aim").isNull() | (F.col("aim") == "click"))).select("event_id")


@query("flt08_effective_dated", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE CASE WHEN l_linenumber = 1 THEN NULL ELSE l_shipdate END IS NULL OR l_shipdate >= TIMESTAMP '1997-06-01'")
def flt08(spark: SparkSession, sf_dir: str) -> DataFrame:
    until = F.when(F.col("l_linenumber") != 1, F.col("l_shipdate"))
    return Tables(spark, sf_dir).lineitem.filter(until.isNull() | (until >= F.lit("1997-06-01").cast("timestamp_ntz"))).select("l_orderkey", "l_linenumber")


@query("flt12_repeated_titles", "SELECT p_partkey, p_type FROM part WHERE length(p_name) >= 8 AND p_type || p_brand IN (SELECT p_type || p_brand FROM part GROUP BY 1 HAVING count(*) <= 5)")
def flt12(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.count("*").over(Window.partitionBy("p_type", "p_brand"))
    return Tables(spark, sf_dir).part.withColumn("n", n).filter((F.length("p_name") >= 8) & (F.col("n") <= 5)).select("p_partkey", "p_type")


@query("flt14_excluded_reason", """SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber = 7 THEN 'duplicate' WHEN l_returnflag = 'A' THEN NULL WHEN l_linestatus = 'F' THEN 'superseded' WHEN l_discount > 0.09 THEN 'cancelled' WHEN l_tax > 0.07 THEN 'successor' END reason FROM lineitem""")
def flt14(spark: SparkSession, sf_dir: str) -> DataFrame:
    reason = (
        F.when(F.col("l_linenumber") == 7, "duplicate").when(F.col("l_returnflag") == "A", F.lit(None)).when(F.col("l_linestatus") == "F", "superseded")
        .when(F.col("l_discount") > 0.09, "cancelled").when(F.col("l_tax") > 0.07, "successor")
    )
    return Tables(spark, sf_dir).lineitem.select("l_orderkey", "l_linenumber", reason.alias("reason"))


@query("prj01_api_rows", """SELECT event_id, event_type action, CAST(json_extract(props, '$.k') AS BIGINT) reason, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') "at" FROM events""")
def prj01(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.from_json("props", "k BIGINT")["k"]
    return Tables(spark, sf_dir).events.select("event_id", F.col("event_type").alias("action"), k.alias("reason"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("at"))


@query("prj02_sort_keys", "SELECT o_orderkey, CASE o_orderpriority WHEN '1-URGENT' THEN 0 WHEN '2-HIGH' THEN 1 ELSE 2 END rank FROM orders")
def prj02(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Tables(spark, sf_dir).orders.select("o_orderkey", priority().alias("rank"))


@query("prj03_progress", """SELECT o_custkey, CASE WHEN count(*) FILTER (o_orderstatus='O') = count(*) THEN 0 WHEN count(*) FILTER (o_orderstatus='F') = count(*) THEN 100 ELSE 80 * count(*) FILTER (o_orderstatus<>'O') // count(*) END progress FROM orders GROUP BY 1""")
def prj03(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, open_, done = F.count("*"), F.count_if(F.col("o_orderstatus") == "O"), F.count_if(F.col("o_orderstatus") == "F")
    by = Tables(spark, sf_dir).orders.groupBy("o_custkey").agg(n.alias("n"), open_.alias("o"), done.alias("d"))
    return by.select("o_custkey", F.when(F.col("o") == F.col("n"), 0).when(F.col("d") == F.col("n"), 100).otherwise(F.floor(80 * (F.col("n") - F.col("o")) / F.col("n"))).cast("long").alias("progress"))


@query("prj04_card_assembly", "SELECT p_partkey, concat_ws('; ', nullif(p_brand, 'Brand#11'), CASE WHEN p_size > 25 THEN p_type END, p_name) card FROM part")
def prj04(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Tables(spark, sf_dir).part.select("p_partkey", F.concat_ws("; ", F.nullif("p_brand", F.lit("Brand#11")), F.when(F.col("p_size") > 25, F.col("p_type")), F.col("p_name")).alias("card"))


@query("join01_left_lookup", "SELECT l_orderkey, l_linenumber, p_name FROM lineitem LEFT JOIN part ON l_partkey = p_partkey AND p_size > 10")
def join01(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = Tables(spark, sf_dir)
    return t.lineitem.join(t.part.filter("p_size > 10"), F.col("l_partkey") == F.col("p_partkey"), "left").select("l_orderkey", "l_linenumber", "p_name")


@query("join02_decisions_in_range", """SELECT event_id, o_orderkey, c_mktsegment FROM events JOIN orders ON o_orderkey = event_id LEFT JOIN customer ON o_custkey = c_custkey
  WHERE ts >= TIMESTAMP '2024-01-08' AND ts < TIMESTAMP '2024-01-15'""")
def join02(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = Tables(spark, sf_dir)
    week = t.events.filter((F.col("ts") >= F.lit("2024-01-08").cast("timestamp_ntz")) & (F.col("ts") < F.lit("2024-01-15").cast("timestamp_ntz")))
    return week.join(t.orders, F.col("o_orderkey") == F.col("event_id")).join(t.customer, F.col("o_custkey") == F.col("c_custkey"), "left").select("event_id", "o_orderkey", "c_mktsegment")


@query("join03_latest_decision", "SELECT user_id, arg_max(event_type, (ts, event_id)) last_action, strftime(max(ts), '%Y-%m-%d') last_day FROM events GROUP BY 1")
def join03(spark: SparkSession, sf_dir: str) -> DataFrame:
    last = F.max(F.struct("ts", "event_id", "event_type"))
    return Tables(spark, sf_dir).events.groupBy("user_id").agg(last.alias("x")).select("user_id", F.col("x.event_type").alias("last_action"), F.date_format("x.ts", "yyyy-MM-dd").alias("last_day"))


@query("join04_objects_with_findings", "SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE o_custkey = c_custkey AND o_orderstatus = 'F' AND l_returnflag = 'R')")
def join04(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = Tables(spark, sf_dir)
    lines = t.lineitem.filter("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    hit = t.orders.filter("o_orderstatus = 'F'").join(lines, "o_orderkey", "left_semi").select(F.col("o_custkey").alias("c_custkey"))
    return t.customer.join(hit, "c_custkey", "left_semi").select("c_custkey")


@query("join05_name_lookup", "SELECT s_suppkey, n_name, r_name FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey")
def join05(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = Tables(spark, sf_dir)
    return t.supplier.join(t.nation, F.col("s_nationkey") == F.col("n_nationkey"), "left").join(t.region, F.col("n_regionkey") == F.col("r_regionkey"), "left").select("s_suppkey", "n_name", "r_name")


@query("join06_cumulative_versions", """WITH v AS (SELECT m, row_number() OVER (ORDER BY m) seq FROM (SELECT DISTINCT strftime(o_orderdate, '%Y-%m') m FROM orders)), i AS (SELECT v.seq, count(*) n FROM orders JOIN v ON v.m = strftime(o_orderdate, '%Y-%m') GROUP BY 1)
  SELECT v.seq version, sum(i.n)::BIGINT items FROM v JOIN i ON i.seq <= v.seq GROUP BY 1""")
def join06(spark: SparkSession, sf_dir: str) -> DataFrame:
    by = Tables(spark, sf_dir).orders.groupBy(F.date_format("o_orderdate", "yyyy-MM").alias("m")).agg(F.count("*").alias("n"))
    # what holds for every earlier version is a running sum over the few months, not a join of rows
    w = Window.orderBy("m")
    return by.select(F.row_number().over(w).cast("long").alias("version"), F.sum("n").over(w).alias("items"))


@query("join07_prioritised_match", """WITH f AS (SELECT p_partkey fk, p_name fname, p_brand fsha, p_type fpath FROM part WHERE p_partkey % 2 = 0), r AS (SELECT p_partkey rk, p_name rname, p_brand rsha, p_type rpath FROM part WHERE p_partkey % 10 = 1),
  m AS (SELECT fk, rk, 1 priority FROM f JOIN r ON fname = rname AND fsha = rsha UNION ALL SELECT fk, rk, 2 FROM f JOIN r ON fsha = rsha AND fpath = rpath UNION ALL SELECT fk, rk, 3 FROM f JOIN r ON fname = rname)
  SELECT fk, rk r_rk, priority FROM m QUALIFY row_number() OVER (PARTITION BY fk ORDER BY priority, rk) = 1""")
def join07(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = Tables(spark, sf_dir).part
    f = part.filter("p_partkey % 2 = 0").select(F.col("p_partkey").alias("fk"), F.col("p_name").alias("name"), F.col("p_brand").alias("sha"), F.col("p_type").alias("path"))
    r = part.filter("p_partkey % 10 = 1").select(F.col("p_partkey").alias("rk"), F.col("p_name").alias("name"), F.col("p_brand").alias("sha"), F.col("p_type").alias("path"))
    levels = [[("name", "name"), ("sha", "sha")], [("sha", "sha"), ("path", "path")], [("name", "name")]]
    return O.prioritised_match(f, r, levels, "fk", ["r_rk"]).select("fk", "r_rk", "priority")


@query("join08_revision_links", """WITH o AS (SELECT o_orderkey k, o_custkey c, CASE WHEN o_orderkey % 3 = 0 THEN o_orderkey - 1 END pred, lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) named FROM orders)
  SELECT o.k, coalesce(p.o_orderkey, named) predecessor FROM o LEFT JOIN orders p ON p.o_orderkey = o.pred""")
def join08(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = Tables(spark, sf_dir).orders
    named = F.lag("o_orderkey").over(Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey"))
    o = orders.select(F.col("o_orderkey").alias("k"), F.when(F.col("o_orderkey") % 3 == 0, F.col("o_orderkey") - 1).alias("pred"), named.alias("named"))
    return o.join(orders.select(F.col("o_orderkey").alias("pred"), F.lit(True).alias("there")), "pred", "left").select("k", F.coalesce(F.when(F.col("there"), F.col("pred")), "named").alias("predecessor"))


@query("join09_expected_missing", """WITH e AS (SELECT n_nationkey, n_name, n_nationkey % 3 how FROM nation) SELECT n_nationkey, n_name FROM e
  WHERE NOT EXISTS (SELECT 1 FROM supplier s WHERE s_nationkey % 2 = n_nationkey % 2 AND CASE how WHEN 0 THEN s_nationkey = n_nationkey WHEN 1 THEN contains(s_name, n_nationkey::VARCHAR) ELSE s_acctbal > 9900 END)""")
def join09(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = Tables(spark, sf_dir)
    e = t.nation.withColumn("how", F.col("n_nationkey") % 3)
    same = F.col("s_nationkey") % 2 == F.col("n_nationkey") % 2
    fits = F.when(F.col("how") == 0, F.col("s_nationkey") == F.col("n_nationkey")).when(F.col("how") == 1, F.col("s_name").contains(F.col("n_nationkey").cast("string"))).otherwise(F.col("s_acctbal") > 9900)
    return e.join(t.supplier, same & fits, "left_anti").select("n_nationkey", "n_name")


@query("join10_duplicate_content", """SELECT doc_id, first_value(doc_id) OVER (PARTITION BY md5(text) ORDER BY doc_id) original FROM documents QUALIFY count(*) OVER (PARTITION BY md5(text)) > 1""")
def join10(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = Tables(spark, sf_dir).documents.select("doc_id", F.md5(F.encode("text", "UTF-8")).alias("hash"))
    first = d.groupBy("hash").agg(F.min("doc_id").alias("original"), F.count("*").alias("n")).filter("n > 1")
    return d.join(first, "hash").select("doc_id", "original")


@query("join12_conflicting_ids", "SELECT e.event_id FROM events e WHERE EXISTS (SELECT 1 FROM events x WHERE x.user_id = e.user_id AND date_trunc('day', x.ts) = date_trunc('day', e.ts) AND x.value < e.value / 50 AND x.event_type <> e.event_type)")
def join12(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = Tables(spark, sf_dir).events.select("event_id", "user_id", F.date_trunc("day", "ts").alias("day"), "event_type", "value")
    x = e.select(F.col("user_id").alias("u"), F.col("day").alias("d"), F.col("event_type").alias("other"), F.col("value").alias("v"))
    on = (F.col("user_id") == F.col("u")) & (F.col("day") == F.col("d")) & (F.col("event_type") != F.col("other")) & (F.col("v") < F.col("value") / 50)
    return e.join(x, on, "left_semi").select("event_id")


@query("join16_section_pairs", """WITH d AS (SELECT lang, source, sum(n_chars)::BIGINT weight FROM documents GROUP BY ALL) SELECT a.source l, b.source r, a.lang, least(a.weight, b.weight) weight FROM d a JOIN d b ON a.lang = b.lang AND a.source < b.source""")
def join16(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = Tables(spark, sf_dir).documents.groupBy("lang", "source").agg(F.sum("n_chars").alias("weight"))
    a, b = d.select("lang", F.col("source").alias("l"), F.col("weight").alias("wl")), d.select("lang", F.col("source").alias("r"), F.col("weight").alias("wr"))
    return a.join(b, "lang").filter("l < r").select("l", "r", "lang", F.least("wl", "wr").alias("weight"))


@query("join20_best_page_pair", """WITH c AS (SELECT l_orderkey, l_suppkey, count(*) n FROM lineitem GROUP BY ALL) SELECT l_orderkey, l_suppkey, n covered FROM c QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY n DESC, l_suppkey) = 1""")
def join20(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = Tables(spark, sf_dir).lineitem.groupBy("l_orderkey", "l_suppkey").agg(F.count("*").alias("covered"))
    best = F.min(F.struct((-F.col("covered")).alias("less"), "l_suppkey"))
    return c.groupBy("l_orderkey").agg(best.alias("x")).select("l_orderkey", F.col("x.l_suppkey").alias("l_suppkey"), (-F.col("x.less")).alias("covered"))


@query("join24_labels_with_documents", "SELECT doc_id, quality, n_chars FROM labels JOIN documents USING (doc_id)")
def join24(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = Tables(spark, sf_dir)
    return t.labels.join(t.documents.select("doc_id", "n_chars"), "doc_id").select("doc_id", "quality", "n_chars")


@query("join26_known_packages", "SELECT event_id FROM events WHERE event_id NOT IN (SELECT event_id FROM events WHERE user_id % 4 = 1)")
def join26(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = Tables(spark, sf_dir).events
    return e.select("event_id").join(e.filter("user_id % 4 = 1").select("event_id"), "event_id", "left_anti")


@query("join33_prefix_names", """WITH n AS (SELECT DISTINCT lower(replace(p_name, ' ', '')) k FROM part), m AS (SELECT a.k, b.k longer FROM n a LEFT JOIN n b ON length(a.k) >= 8 AND length(b.k) > length(a.k) AND starts_with(b.k, a.k))
  SELECT k, coalesce(arg_max(longer, (length(longer), longer)), k) canonical FROM m GROUP BY 1""")
def join33(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = Tables(spark, sf_dir).part.select(F.lower(F.replace("p_name", F.lit(" "), F.lit(""))).alias("k")).distinct()
    # the first eight characters block the comparison
    a = n.filter(F.length("k") >= 8).withColumn("b", F.substring("k", 1, 8))
    longer = a.select(F.col("k").alias("longer"), "b")
    m = a.join(longer, "b").filter((F.length("longer") > F.length("k")) & F.startswith("longer", "k"))
    best = m.groupBy("k").agg(F.max(F.struct(F.length("longer").alias("n"), "longer")).alias("x"))
    return n.join(best, "k", "left").select("k", F.coalesce("x.longer", "k").alias("canonical"))


@query("agg04_weekly_report", """WITH d AS (SELECT *, json_extract(props, '$.k')::BIGINT k, strftime(date_trunc('week', ts + INTERVAL 3 HOUR), '%Y-%m-%d') AS week FROM events),
  l AS (SELECT * FROM d QUALIFY row_number() OVER (PARTITION BY week, user_id ORDER BY ts DESC, event_id DESC) = 1) SELECT week, event_type action, count(*) decisions, count(DISTINCT k) reasons FROM l GROUP BY 1, 2""")
def agg04(spark: SparkSession, sf_dir: str) -> DataFrame:
    week = F.date_format(F.date_trunc("week", F.col("ts") + F.expr("INTERVAL 3 HOURS")), "yyyy-MM-dd")
    d = Tables(spark, sf_dir).events.withColumn("k", F.from_json("props", "k BIGINT")["k"]).withColumn("week", week)
    last = O.first_per_group(d, ["week", "user_id"], [F.desc("ts"), F.desc("event_id")])
    return last.groupBy("week", F.col("event_type").alias("action")).agg(F.count("*").alias("decisions"), F.count_distinct("k").alias("reasons"))


@query("agg05_top_false_positives", """SELECT p_brand, count(*) FILTER (l_returnflag = 'R') rejections, round(count(*) FILTER (l_returnflag = 'R') / count(*), 3) fp_rate FROM lineitem JOIN part ON l_partkey = p_partkey
  GROUP BY 1 ORDER BY 2 DESC, 3 DESC, 1 LIMIT 10""")
def agg05(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = Tables(spark, sf_dir)
    by = t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey")).groupBy("p_brand").agg(F.count_if(F.col("l_returnflag") == "R").alias("rejections"), F.count("*").alias("n"))
    return by.select("p_brand", "rejections", F.round(F.col("rejections") / F.col("n"), 3).alias("fp_rate")).orderBy(F.desc("rejections"), F.desc("fp_rate"), "p_brand").limit(10)


@query("agg06_recommendations", """WITH c AS (SELECT p_type, p_brand, count(*) n, count(*) FILTER (l_returnflag='R') r FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL)
  SELECT p_type, p_brand, CASE WHEN r >= 2 AND r / n >= 0.5 THEN 'disable' WHEN r >= 2 AND r / n >= 0.3 THEN 'review' WHEN n >= 5 AND r / n >= 0.1 THEN 'watch' END advice FROM c WHERE r >= 2""")
def agg06(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = Tables(spark, sf_dir)
    c = t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey")).groupBy("p_type", "p_brand").agg(F.count("*").alias("n"), F.count_if(F.col("l_returnflag") == "R").alias("r")).filter("r >= 2")
    rate = F.col("r") / F.col("n")
    return c.select("p_type", "p_brand", F.when(rate >= 0.5, "disable").when(rate >= 0.3, "review").when((F.col("n") >= 5) & (rate >= 0.1), "watch").alias("advice"))


@query("agg07_status_from_counts", "SELECT o_custkey, CASE WHEN count(*) FILTER (o_orderstatus='P') > 0 THEN 'VERIFYING' WHEN count(*) FILTER (o_orderstatus='O') > 0 THEN 'READY' ELSE 'COMPLETED' END status FROM orders GROUP BY 1")
def agg07(spark: SparkSession, sf_dir: str) -> DataFrame:
    has = lambda s: F.bool_or(F.col("o_orderstatus") == s)
    return Tables(spark, sf_dir).orders.groupBy("o_custkey").agg(F.when(has("P"), "VERIFYING").when(has("O"), "READY").otherwise("COMPLETED").alias("status"))


@query("agg08_completeness", """WITH s AS (SELECT l_orderkey, l_linenumber % 3 stage, count(*) files, count(*) FILTER (l_returnflag='A') failed FROM lineitem GROUP BY ALL),
  i AS (SELECT l_orderkey, stage, files, failed, list_filter([CASE WHEN files < 2 THEN 'MISSING_FILE' END, CASE WHEN failed > 0 THEN 'UNREADABLE_FILE' END, CASE WHEN files > 2 THEN 'AMBIGUOUS_REVISION' END], lambda x: x IS NOT NULL) issues FROM s)
  SELECT l_orderkey, sum(files)::BIGINT files, sum(failed)::BIGINT failed, sum(len(issues))::BIGINT issues, max(CASE WHEN list_contains(issues,'UNREADABLE_FILE') THEN 3 WHEN list_contains(issues,'MISSING_FILE') THEN 2 WHEN len(issues) > 0 THEN 1 ELSE 0 END) worst FROM i GROUP BY 1""")
def agg08(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = Tables(spark, sf_dir).lineitem.groupBy("l_orderkey", (F.col("l_linenumber") % 3).alias("stage")).agg(F.count("*").alias("files"), F.count_if(F.col("l_returnflag") == "A").alias("failed"))
    issues = F.array_compact(F.array(F.when(F.col("files") < 2, "MISSING_FILE"), F.when(F.col("failed") > 0, "UNREADABLE_FILE"), F.when(F.col("files") > 2, "AMBIGUOUS_REVISION")))
    worst = F.when(F.array_contains("issues", "UNREADABLE_FILE"), 3).when(F.array_contains("issues", "MISSING_FILE"), 2).when(F.size("issues") > 0, 1).otherwise(0)
    i = s.withColumn("issues", issues).withColumn("worst", worst)
    return i.groupBy("l_orderkey").agg(F.sum("files").alias("files"), F.sum("failed").alias("failed"), F.sum(F.size("issues")).alias("issues"), F.max("worst").alias("worst"))


@query("agg15_mode_first_seen", "WITH c AS (SELECT l_orderkey, l_returnflag, count(*) n, min(l_linenumber) p FROM lineitem GROUP BY ALL) SELECT l_orderkey, arg_min(l_returnflag, (-n, p, l_returnflag)) mode FROM c GROUP BY 1")
def agg15(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = Tables(spark, sf_dir).lineitem.groupBy("l_orderkey", "l_returnflag").agg(F.count("*").alias("n"), F.min("l_linenumber").alias("p"))
    return c.groupBy("l_orderkey").agg(F.min(F.struct((-F.col("n")).alias("less"), "p", "l_returnflag")).alias("x")).select("l_orderkey", F.col("x.l_returnflag").alias("mode"))


@query("agg16_metadata_rollup", """WITH c AS (SELECT l_orderkey, count(*) n, max(l_linenumber) revision, strftime(max(l_shipdate), '%Y-%m-%d') latest FROM lineitem GROUP BY 1),
  m AS (SELECT l_orderkey, max(k) top FROM (SELECT l_orderkey, l_returnflag, count(*) k FROM lineitem GROUP BY ALL) GROUP BY 1) SELECT l_orderkey, revision, latest, round(0.5 + 0.4 * top / n, 2) confidence FROM c JOIN m USING (l_orderkey)""")
def agg16(spark: SparkSession, sf_dir: str) -> DataFrame:
    flags = Tables(spark, sf_dir).lineitem.groupBy("l_orderkey", "l_returnflag").agg(F.count("*").alias("k"), F.max("l_linenumber").alias("r"), F.max("l_shipdate").alias("d"))
    by = flags.groupBy("l_orderkey").agg(F.sum("k").alias("n"), F.max("k").alias("top"), F.max("r").alias("revision"), F.max("d").alias("d"))
    return by.select("l_orderkey", "revision", F.date_format("d", "yyyy-MM-dd").alias("latest"), F.round(0.5 + 0.4 * F.col("top") / F.col("n"), 2).alias("confidence"))


HASHED_SQL = "h AS (SELECT split, sha256(o_orderkey::VARCHAR) h FROM s), p AS (SELECT split, substr(h, 1, 2) a, substr(h, 3, 2) b, sha256(string_agg(h, '' ORDER BY h)) h FROM h GROUP BY 1, 2, 3), q AS (SELECT split, a, sha256(string_agg(h, '' ORDER BY b)) h FROM p GROUP BY 1, 2)"


@query("agg32_dataset_version", f"""WITH s AS (SELECT o_orderkey, o_custkey, CASE WHEN ('0x' || substr(sha256(o_custkey::VARCHAR), 1, 8))::BIGINT / 4294967296.0 < 0.7 THEN 'TRAIN' ELSE 'REST' END split FROM orders), {HASHED_SQL},
  d AS (SELECT split, sha256(string_agg(h, '' ORDER BY a)) digest FROM q GROUP BY 1) SELECT split, count(*) items, count(DISTINCT o_custkey) objects, any_value(digest) digest FROM s JOIN d USING (split) GROUP BY 1""")
def agg32(spark: SparkSession, sf_dir: str) -> DataFrame:
    from stagewise.operators.decisions import set_digest
    from stagewise.operators.learning import split_of

    s = Tables(spark, sf_dir).orders.withColumn("split", split_of(F.col("o_custkey"), (("TRAIN", 0.7), ("REST", 1.0))))
    counts = s.groupBy("split").agg(F.count("*").alias("items"), F.count_distinct("o_custkey").alias("objects"))
    return counts.join(set_digest(s, ["split"], F.col("o_orderkey")), "split")


@query("agg38_status_counters", "SELECT event_type, count(*) n, count(*) FILTER (value > 50) due, strftime(max(ts), '%Y-%m-%d %H:%M:%S') last_at FROM events GROUP BY 1")
def agg38(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Tables(spark, sf_dir).events.groupBy("event_type").agg(F.count("*").alias("n"), F.count_if(F.col("value") > 50).alias("due"), F.date_format(F.max("ts"), "yyyy-MM-dd HH:mm:ss").alias("last_at"))


@query("agg40_organisation_rollup", """SELECT l_orderkey, CASE WHEN count(*) FILTER (l_returnflag='A') >= 2 THEN 'stamp' WHEN count(*) FILTER (l_returnflag='R') > 0 THEN 'cover' WHEN count(*) FILTER (l_returnflag='A') = 1 THEN 'single' ELSE 'text' END source,
  CASE WHEN count(*) FILTER (l_returnflag='A') >= 2 THEN 0.9 WHEN count(*) FILTER (l_returnflag='R') > 0 THEN 0.8 WHEN count(*) FILTER (l_returnflag='A') = 1 THEN 0.6 ELSE 0.5 END::DOUBLE confidence FROM lineitem GROUP BY 1""")
def agg40(spark: SparkSession, sf_dir: str) -> DataFrame:
    stamps, covers = F.count_if(F.col("l_returnflag") == "A"), F.count_if(F.col("l_returnflag") == "R")
    pick = lambda a, b, c, d: F.when(stamps >= 2, a).when(covers > 0, b).when(stamps == 1, c).otherwise(d)
    return Tables(spark, sf_dir).lineitem.groupBy("l_orderkey").agg(pick("stamp", "cover", "single", "text").alias("source"), pick(0.9, 0.8, 0.6, 0.5).alias("confidence"))


@query("agg41_issue_collapse", """WITH c AS (SELECT o_custkey, o_orderstatus code, count(*) n, array_to_string(list_sort(list(o_orderkey))[1:5], ',') names FROM orders GROUP BY ALL) SELECT o_custkey, code, n, CASE WHEN n <= 3 THEN names ELSE n || ': ' || names END line FROM c""")
def agg41(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = F.array_join(F.slice(F.array_sort(F.collect_list("o_orderkey")), 1, 5).cast("array<string>"), ",")
    c = Tables(spark, sf_dir).orders.groupBy("o_custkey", F.col("o_orderstatus").alias("code")).agg(F.count("*").alias("n"), names.alias("names"))
    return c.select("o_custkey", "code", "n", F.when(F.col("n") <= 3, F.col("names")).otherwise(F.concat(F.col("n").cast("string"), F.lit(": "), "names")).alias("line"))


@query("agg43_object_list", """WITH l AS (SELECT * FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1), c AS (SELECT l_orderkey, count(*) lines, count(*) FILTER (l_returnflag='R') bad FROM lineitem GROUP BY 1)
  SELECT c_custkey, o_orderkey, coalesce(lines, 0) lines, CASE WHEN bad > 0 THEN 'RED' WHEN lines > 0 THEN 'GREEN' ELSE 'YELLOW' END indicator FROM customer LEFT JOIN l ON o_custkey = c_custkey LEFT JOIN c ON l_orderkey = o_orderkey""")
def agg43(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = Tables(spark, sf_dir)
    last = O.first_per_group(t.orders.select("o_custkey", "o_orderkey", "o_orderdate"), ["o_custkey"], [F.desc("o_orderdate"), F.desc("o_orderkey")])
    c = t.lineitem.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("lines"), F.count_if(F.col("l_returnflag") == "R").alias("bad"))
    rows = t.customer.join(last, F.col("o_custkey") == F.col("c_custkey"), "left").join(c, "o_orderkey", "left")
    return rows.select("c_custkey", "o_orderkey", F.coalesce("lines", F.lit(0)).alias("lines"), F.when(F.col("bad") > 0, "RED").when(F.col("lines") > 0, "GREEN").otherwise("YELLOW").alias("indicator"))


@query("agg44_hint_scores", "SELECT l_suppkey, l_partkey, max(l_quantity) score FROM lineitem GROUP BY 1, 2")
def agg44(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Tables(spark, sf_dir).lineitem.groupBy("l_suppkey", "l_partkey").agg(F.max("l_quantity").alias("score"))


@query("win01_latest_process", "SELECT o_custkey, o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1")
def win01(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.first_per_group(Tables(spark, sf_dir).orders.select("o_custkey", "o_orderkey", "o_orderdate"), ["o_custkey"], [F.desc("o_orderdate"), F.desc("o_orderkey")]).select("o_custkey", "o_orderkey")


@query("win03_latest_approved", "SELECT o_orderstatus, arg_max(o_orderkey, (o_orderdate, o_orderkey)) latest FROM orders GROUP BY 1")
def win03(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Tables(spark, sf_dir).orders.groupBy("o_orderstatus").agg(F.max_by("o_orderkey", F.struct("o_orderdate", "o_orderkey")).alias("latest"))


@query("win04_next_version", "SELECT l_orderkey, max(l_linenumber) + 1 next_version FROM lineitem GROUP BY 1")
def win04(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Tables(spark, sf_dir).lineitem.groupBy("l_orderkey").agg((F.max("l_linenumber") + 1).alias("next_version"))


@query("win05_last_in_week", "SELECT week, user_id, event_type FROM (SELECT *, strftime(date_trunc('week', ts + INTERVAL 3 HOUR), '%Y-%m-%d') AS week FROM events) QUALIFY row_number() OVER (PARTITION BY week, user_id ORDER BY ts DESC, event_id DESC) = 1")
def win05(spark: SparkSession, sf_dir: str) -> DataFrame:
    week = F.date_format(F.date_trunc("week", F.col("ts") + F.expr("INTERVAL 3 HOURS")), "yyyy-MM-dd")
    return O.first_per_group(Tables(spark, sf_dir).events.withColumn("week", week), ["week", "user_id"], [F.desc("ts"), F.desc("event_id")]).select("week", "user_id", "event_type")


@query("win08_context_carry", """WITH c AS (SELECT conv_id, turn, CASE WHEN role = 'user' THEN length(text) END v FROM conversations), w AS (SELECT *, last_value(v IGNORE NULLS) OVER o lv, last_value(CASE WHEN v IS NOT NULL THEN turn END IGNORE NULLS) OVER o lt FROM c WINDOW o AS (PARTITION BY conv_id ORDER BY turn))
  SELECT conv_id, turn, CASE WHEN turn - lt <= 4 THEN lv END context FROM w""")
def win08(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = Tables(spark, sf_dir).conversations.select("conv_id", "turn", F.when(F.col("role") == "user", F.length("text")).cast("long").alias("v"))
    return O.carried_forward(c, ["conv_id"], "turn", "v", 4, "context").select("conv_id", "turn", "context")


@query("win09_running_number", "SELECT l_suppkey, l_orderkey, l_linenumber, 'FREE-' || lpad((row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber))::VARCHAR, 6, '0') code FROM lineitem WHERE l_returnflag = 'R'")
def win09(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = Tables(spark, sf_dir).lineitem.filter("l_returnflag = 'R'").select("l_suppkey", "l_orderkey", "l_linenumber")
    return O.numbered(rows, ["l_suppkey"], ["l_orderkey", "l_linenumber"], "n").select("l_suppkey", "l_orderkey", "l_linenumber", F.concat(F.lit("FREE-"), F.lpad(F.col("n").cast("string"), 6, "0")).alias("code"))


@query("win11_adjacent_pairs", "SELECT conv_id, turn, role, lead(role) OVER (PARTITION BY conv_id ORDER BY turn) next_role FROM conversations QUALIFY next_role IS NOT NULL")
def win11(spark: SparkSession, sf_dir: str) -> DataFrame:
    after = F.lead("role").over(Window.partitionBy("conv_id").orderBy("turn"))
    return Tables(spark, sf_dir).conversations.select("conv_id", "turn", "role", after.alias("next_role")).filter("next_role IS NOT NULL")


@query("win12_block_windows", """WITH c AS (SELECT conv_id, turn, text a, lead(text, 1) OVER w b, lead(text, 2) OVER w c FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn))
  SELECT conv_id, turn, CASE WHEN contains(a, 'the') THEN 1 WHEN contains(concat_ws(' ', a, b), 'the') THEN 2 WHEN contains(concat_ws(' ', a, b, c), 'the') THEN 3 END width FROM c""")
def win12(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("conv_id").orderBy("turn")
    c = Tables(spark, sf_dir).conversations.select("conv_id", "turn", F.col("text").alias("a"), F.lead("text", 1).over(w).alias("b"), F.lead("text", 2).over(w).alias("c"))
    has = lambda *x: F.contains(F.concat_ws(" ", *x), F.lit("the"))
    return c.select("conv_id", "turn", F.when(has("a"), 1).when(has("a", "b"), 2).when(has("a", "b", "c"), 3).alias("width"))


@query("win13_rightmost_cell", "SELECT l_orderkey, arg_max(l_partkey, (l_extendedprice, l_linenumber)) cell FROM lineitem WHERE l_quantity > 5 GROUP BY 1")
def win13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Tables(spark, sf_dir).lineitem.filter("l_quantity > 5").groupBy("l_orderkey").agg(F.max_by("l_partkey", F.struct("l_extendedprice", "l_linenumber")).alias("cell"))


@query("win14_budget", "SELECT source, doc_id FROM documents QUALIFY row_number() OVER (PARTITION BY source ORDER BY n_chars > 2000, doc_id) <= 5")
def win14(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.first_per_group(Tables(spark, sf_dir).documents.select("source", "doc_id", "n_chars"), ["source"], [F.col("n_chars") > 2000, "doc_id"], 5).select("source", "doc_id")


@query("win15_systematic_sample", "SELECT source, doc_id FROM (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) n FROM documents) WHERE n % 7 = 1")
def win15(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.numbered(Tables(spark, sf_dir).documents.select("source", "doc_id"), ["source"], ["doc_id"], "n").filter("n % 7 = 1").select("source", "doc_id")


@query("win16_hash_sample", "SELECT doc_id FROM documents ORDER BY sha256(doc_id::VARCHAR) LIMIT 50")
def win16(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Tables(spark, sf_dir).documents.select("doc_id").orderBy(F.sha2(F.col("doc_id").cast("string"), 256)).limit(50)


@query("win17_successors", "SELECT o_orderkey, lead(o_orderkey) OVER w successor, lag(o_orderkey) OVER w predecessor FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)")
def win17(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    return Tables(spark, sf_dir).orders.select("o_orderkey", F.lead("o_orderkey").over(w).alias("successor"), F.lag("o_orderkey").over(w).alias("predecessor"))


@query("win18_kth_previous", "SELECT event_id, coalesce(ts - lag(ts, 4) OVER (PARTITION BY user_id ORDER BY ts, event_id) <= INTERVAL 900 SECOND, false) blocked FROM events WHERE event_type = 'error'")
def win18(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = O.kth_previous(Tables(spark, sf_dir).events.filter("event_type = 'error'"), ["user_id"], "ts", 4, ["ts", "event_id"])
    return e.select("event_id", F.coalesce(F.col("ts") - F.col("kth_time") <= F.expr("INTERVAL '900' SECOND"), F.lit(False)).alias("blocked"))


@query("srt01_page_with_total", "SELECT o_orderkey, (SELECT count(*) FROM orders WHERE o_orderstatus = 'P') total FROM orders WHERE o_orderstatus = 'P' ORDER BY o_orderkey LIMIT 20 OFFSET 20")
def srt01(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.page(Tables(spark, sf_dir).orders.filter("o_orderstatus = 'P'").select("o_orderkey"), ["o_orderkey"], 20, 20)


@query("srt02_findings_order", "SELECT o_orderkey FROM orders ORDER BY o_orderstatus <> 'P', CASE o_orderpriority WHEN '1-URGENT' THEN 0 WHEN '2-HIGH' THEN 1 ELSE 2 END, o_totalprice DESC, o_orderkey LIMIT 100")
def srt02(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Tables(spark, sf_dir).orders.orderBy(F.col("o_orderstatus") != "P", priority(), F.desc("o_totalprice"), "o_orderkey").limit(100).select("o_orderkey")


@query("srt03_alphabetical_priority", "SELECT o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY CASE o_orderpriority WHEN '1-URGENT' THEN 'HIGH' WHEN '2-HIGH' THEN 'MEDIUM' ELSE 'LOW' END, o_orderkey) place FROM orders")
def srt03(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.when(F.col("o_orderpriority") == "1-URGENT", "HIGH").when(F.col("o_orderpriority") == "2-HIGH", "MEDIUM").otherwise("LOW")
    return O.numbered(Tables(spark, sf_dir).orders, ["o_custkey"], [name, "o_orderkey"], "place").select("o_orderkey", F.col("place").cast("long").alias("place"))


@query("srt05_top_k_per_group", "SELECT l_suppkey, l_orderkey, l_linenumber FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber) <= 12")
def srt05(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.first_per_group(Tables(spark, sf_dir).lineitem.select("l_suppkey", "l_orderkey", "l_linenumber", "l_extendedprice"), ["l_suppkey"], [F.desc("l_extendedprice"), "l_orderkey", "l_linenumber"], 12).drop("l_extendedprice")


@query("srt09_quota_selection", """WITH d AS (SELECT source, doc_id, row_number() OVER w n, sum(n_chars) OVER (w ROWS UNBOUNDED PRECEDING) s FROM documents WINDOW w AS (PARTITION BY source ORDER BY n_chars, doc_id)) SELECT source, doc_id FROM d WHERE n <= 40 AND s <= 20000""")
def srt09(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.within_quota(Tables(spark, sf_dir).documents.select("source", "doc_id", "n_chars"), ["source"], ["n_chars", "doc_id"], "n_chars", 20000, 40).select("source", "doc_id")


@query("set01_candidate_union", "SELECT l_partkey, l_suppkey FROM lineitem WHERE l_quantity > 45 UNION SELECT l_partkey, l_suppkey FROM lineitem WHERE l_discount > 0.08")
def set01(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = Tables(spark, sf_dir).lineitem
    return rows.filter("l_quantity > 45 OR l_discount > 0.08").select("l_partkey", "l_suppkey").distinct()


@query("set05_matrix_diff", """WITH a AS (SELECT p_partkey k, p_brand b, p_size s FROM part WHERE p_partkey % 5 <> 0), b AS (SELECT p_partkey k, p_brand b, CASE WHEN p_partkey % 7 = 0 THEN p_size + 1 ELSE p_size END s FROM part WHERE p_partkey % 4 <> 0)
  SELECT coalesce(a.k, b.k) k, CASE WHEN a.k IS NULL THEN 'added' WHEN b.k IS NULL THEN 'absent' WHEN a.b IS NOT DISTINCT FROM b.b AND a.s IS NOT DISTINCT FROM b.s THEN 'unchanged' ELSE 'updated' END change FROM a FULL JOIN b ON a.k = b.k""")
def set05(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = Tables(spark, sf_dir).part.select(F.col("p_partkey").alias("k"), F.col("p_brand").alias("b"), F.col("p_size").alias("s"))
    new = part.filter("k % 4 <> 0").withColumn("s", F.when(F.col("k") % 7 == 0, F.col("s") + 1).otherwise(F.col("s")))
    return O.differences(part.filter("k % 5 <> 0"), new, "k", ["b", "s"])


@query("set06_page_pair_override", "SELECT p_partkey, p_size FROM part WHERE p_partkey % 3 <> 0 UNION ALL SELECT p_partkey, p_size + 100 FROM part WHERE p_partkey % 3 = 0")
def set06(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = Tables(spark, sf_dir).part.select("p_partkey", "p_size")
    return O.replaced(part, part.filter("p_partkey % 3 = 0").withColumn("p_size", F.col("p_size") + 100), ["p_partkey"])


@query("set08_distinct_findings", "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F' UNION SELECT o_orderkey FROM orders WHERE o_totalprice > 200000 UNION SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R'")
def set08(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = Tables(spark, sf_dir)
    return t.orders.filter("o_orderstatus = 'F' OR o_totalprice > 200000").select("o_orderkey").union(t.lineitem.filter("l_returnflag = 'R'").select("l_orderkey")).distinct()


@query("set09_in_one_not_other", "SELECT DISTINCT l_suppkey, l_partkey FROM lineitem a WHERE l_linenumber % 3 = 1 AND NOT EXISTS (SELECT 1 FROM lineitem b WHERE b.l_suppkey = a.l_suppkey AND b.l_partkey = a.l_partkey AND b.l_linenumber % 3 = 2)")
def set09(spark: SparkSession, sf_dir: str) -> DataFrame:
    stage = lambda k: F.bool_or(F.col("l_linenumber") % 3 == k)
    by = Tables(spark, sf_dir).lineitem.groupBy("l_suppkey", "l_partkey").agg(stage(1).alias("a"), stage(2).alias("b"))
    return by.filter("a AND NOT b").select("l_suppkey", "l_partkey")


@query("set10_hash_mismatch", """WITH a AS (SELECT o_custkey k, count(*) n FROM orders WHERE o_orderkey % 2 = 0 GROUP BY 1), b AS (SELECT o_custkey k, count(*) n FROM orders WHERE o_orderkey % 2 = 1 GROUP BY 1) SELECT coalesce(a.k, b.k) k FROM a FULL JOIN b ON a.k = b.k WHERE a.n IS DISTINCT FROM b.n""")
def set10(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = Tables(spark, sf_dir).orders.groupBy(F.col("o_custkey").alias("k"))
    return o.agg(F.count_if(F.col("o_orderkey") % 2 == 0).alias("a"), F.count_if(F.col("o_orderkey") % 2 == 1).alias("b")).filter("a <> b").select("k")


@query("set11_expected_documents", "SELECT o_custkey k, 'registry' origin FROM orders WHERE o_orderstatus = 'P' UNION SELECT c_custkey, 'explicit' FROM customer WHERE c_acctbal < 0")
def set11(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = Tables(spark, sf_dir)
    listed = t.orders.filter("o_orderstatus = 'P'").select(F.col("o_custkey").alias("k"), F.lit("registry").alias("origin"))
    return listed.unionByName(t.customer.filter("c_acctbal < 0").select(F.col("c_custkey").alias("k"), F.lit("explicit").alias("origin"))).distinct()


@query("dat01_iso_week", "SELECT event_id, extract(isoyear FROM ts + INTERVAL 3 HOUR) iso_year, extract(week FROM ts + INTERVAL 3 HOUR) iso_week FROM events")
def dat01(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = F.col("ts") + F.expr("INTERVAL 3 HOURS")
    return Tables(spark, sf_dir).events.select("event_id", F.extract(F.lit("YEAROFWEEK"), at).cast("long").alias("iso_year"), F.weekofyear(at).cast("long").alias("iso_week"))


@query("dat03_retry_delays", "SELECT event_id, strftime(ts + to_seconds([60, 300, 900][(event_id % 3) + 1]), '%Y-%m-%d %H:%M:%S') next_try FROM events")
def dat03(spark: SparkSession, sf_dir: str) -> DataFrame:
    delay = F.element_at(F.array(F.lit(60), F.lit(300), F.lit(900)), (F.col("event_id") % 3 + 1).cast("int"))
    return Tables(spark, sf_dir).events.select("event_id", F.date_format(F.col("ts") + F.make_dt_interval(secs=delay), "yyyy-MM-dd HH:mm:ss").alias("next_try"))
