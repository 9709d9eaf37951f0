"""Reports, exports, state changes and the remaining classifiers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stagewise.functions import text as T
from stagewise.operators import decisions as D
from stagewise.operators import reconcile as R
from stagewise.operators import relational as O

from .core import EXTRACTIONS_SQL, WITH_VERDICTS, extractions, verdicts
from .registry import Tables, query


@query("flt09_readable_pages", "SELECT doc_id FROM documents WHERE n_chars >= 300 AND doc_id % 4 <> 0")
def flt09(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = Tables(spark, sf_dir).documents.select("doc_id", (F.col("doc_id") % 4 == 0).alias("is_drawing"), F.when(F.col("n_chars") < 300, "LOW_QUALITY").otherwise("OK").alias("quality"))
    return d.filter(~F.col("is_drawing") & (F.col("quality") != "LOW_QUALITY")).select("doc_id")


@query("flt10_title_block_ext16", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_quantity / 50 BETWEEN 0.5 AND 1 AND l_tax * 12.5 BETWEEN 0.68 AND 1")
def flt10(spark: SparkSession, sf_dir: str) -> DataFrame:
    x, y = F.col("l_quantity") / 50, F.col("l_tax") * 12.5
    return Tables(spark, sf_dir).lineitem.filter(x.between(0.5, 1) & y.between(0.68, 1)).select("l_orderkey", "l_linenumber")


@query("cmp04_mark_tokens", r"""WITH m AS (SELECT p_partkey, regexp_extract_all(upper(p_type || p_size || '-AP7, X, ' || p_brand), '[A-Z]{2,5}[0-9]*') f, regexp_extract_all(regexp_replace(upper(p_type || p_size || '-AP7, X, ' || p_brand), '[^A-Z0-9]+', '  ', 'g'), '(?:^| )[A-Z]{2,5}[0-9]*(?: |$)') g FROM part),
  t AS (SELECT p_partkey, list_transform(g, lambda x: trim(x)) g FROM m) SELECT p_partkey, array_to_string(list_sort(list_distinct(list_concat(g, list_transform(g, lambda x: regexp_replace(x, '[0-9]+$', ''))))), ',') marks FROM t""")
def cmp04(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.concat("p_type", F.col("p_size").cast("string"), F.lit("-AP7, X, "), "p_brand")
    return Tables(spark, sf_dir).part.select("p_partkey", F.array_join(T.marks(name), ",").alias("marks"))


@query("cmp13_text_comparator", r"SELECT c.conv_id, c.turn, regexp_replace(lower(regexp_replace(c.text, '\s+', ' ', 'g')), '^[\s.,;:-]+|[\s.,;:-]+$', '', 'g') <> regexp_replace(lower(regexp_replace(d.text, '\s+', ' ', 'g')), '^[\s.,;:-]+|[\s.,;:-]+$', '', 'g') hit FROM conversations c JOIN conversations d ON d.conv_id = c.conv_id AND d.turn = c.turn + 1")
def cmp13(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = Tables(spark, sf_dir).conversations.select("conv_id", "turn", "text")
    d = c.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("after"))
    return c.join(d, ["conv_id", "turn"]).select("conv_id", "turn", T.changed_text(F.col("text"), F.col("after")).alias("hit"))


@query("cmp22_worst_status", "SELECT l_orderkey, greatest(max(CASE l_returnflag WHEN 'A' THEN 3 WHEN 'R' THEN 2 ELSE 1 END), max(CASE l_linestatus WHEN 'F' THEN 2 ELSE 1 END)) worst FROM lineitem GROUP BY 1")
def cmp22(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = F.when(F.col("l_returnflag") == "A", 3).when(F.col("l_returnflag") == "R", 2).otherwise(1)
    b = F.when(F.col("l_linestatus") == "F", 2).otherwise(1)
    return Tables(spark, sf_dir).lineitem.groupBy("l_orderkey").agg(D.worst(F.max(a), F.max(b)).alias("worst"))


@query("cmp24_decision_state", "SELECT user_id, CASE arg_max(event_type, (ts, event_id)) WHEN 'click' THEN 'CONFIRMED_VIOLATION' WHEN 'view' THEN 'NEGATIVE_VERIFIED' WHEN 'error' THEN 'CLARIFICATION_REQUIRED' ELSE 'PENDING' END state, count(*) decisions, count(*) FILTER (event_type = 'view') rejections FROM events GROUP BY 1")
def cmp24(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("event_type")
    action = F.when(kind == "click", "CONFIRM").when(kind == "view", "REJECT").when(kind == "error", "CLARIFY")
    return D.decision_states(Tables(spark, sf_dir).events.withColumn("action", action), "user_id", "action", ["ts", "event_id"])


@query("cmp25_split_checks", "SELECT o_orderkey || '#' || part AS child FROM (SELECT o_orderkey, unnest(CASE o_orderstatus WHEN 'P' THEN ['a', 'b'] WHEN 'O' THEN [o_orderpriority] ELSE [] END) part FROM orders)")
def cmp25(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = F.col("o_orderstatus")
    parts = F.when(status == "P", F.array(F.lit("a"), F.lit("b"), F.lit("a"))).when(status == "O", F.array("o_orderpriority"))
    return D.split_children(Tables(spark, sf_dir).orders, "o_orderkey", parts).select("child")


@query("cmp26_finalisable", f"{WITH_VERDICTS} SELECT object_id, count(*) FILTER (verdict = 'CANDIDATE') = 0 allowed FROM verdicts GROUP BY 1")
def cmp26(spark: SparkSession, sf_dir: str) -> DataFrame:
    return verdicts(Tables(spark, sf_dir)).groupBy("object_id").agg((F.count_if(F.col("verdict") == R.CANDIDATE) == 0).alias("allowed"))


@query("agg19_union_of_sets", "SELECT l_suppkey, array_to_string(list_sort(list(DISTINCT p_type)), ',') types FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1")
def agg19(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = Tables(spark, sf_dir)
    rows = t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey"))
    return rows.groupBy("l_suppkey").agg(F.array_join(F.array_sort(F.collect_set("p_type")), ",").alias("types"))


@query("agg29_extraction_metrics", f"""WITH {EXTRACTIONS_SQL}, g AS (SELECT param, count(*) FILTER (value > 25 AND NOT bad) tp, count(*) FILTER (value > 25 AND bad) fp, count(*) FILTER (value <= 25 AND l_linenumber = 1) fn FROM ext GROUP BY 1) SELECT param, tp, fp, fn, round(tp / nullif(tp + fp, 0), 4) "precision", round(tp / nullif(tp + fn, 0), 4) recall FROM g""")
def agg29(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, v = extractions(Tables(spark, sf_dir)), F.col("value") > 25
    g = e.groupBy("param").agg(F.count_if(v & ~F.col("bad")).alias("tp"), F.count_if(v & F.col("bad")).alias("fp"), F.count_if(~v & (F.col("l_linenumber") == 1)).alias("fn"))
    return g.withColumn("precision", F.round(F.try_divide(F.col("tp"), F.col("tp") + F.col("fp")), 4)).withColumn("recall", F.round(F.try_divide(F.col("tp"), F.col("tp") + F.col("fn")), 4))


@query("agg42_report_tables", f"{WITH_VERDICTS} SELECT 'priority' section, priority line, count(*) n FROM verdicts GROUP BY 2 UNION ALL SELECT 'verdict', verdict, count(*) FROM verdicts GROUP BY 2")
def agg42(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = F.array(F.struct(F.lit("priority").alias("section"), F.col("priority").alias("line")), F.struct(F.lit("verdict").alias("section"), F.col("verdict").alias("line")))
    return verdicts(Tables(spark, sf_dir)).select(F.explode(rows).alias("x")).groupBy("x.section", "x.line").agg(F.count("*").alias("n"))


@query("set07_snk02_submission", f"""{WITH_VERDICTS} SELECT object_id, param code, verdict FROM verdicts WHERE verdict IN ('CANDIDATE', 'NEGATIVE_VERIFIED') UNION ALL
  SELECT object_id, 'FREE-' || lpad((row_number() OVER (PARTITION BY object_id ORDER BY param, rule_key))::VARCHAR, 3, '0'), 'SUSPICION' FROM verdicts WHERE verdict = 'MISSING_EVIDENCE'""")
def set07(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = verdicts(Tables(spark, sf_dir)).select("object_id", "param", "rule_key", "verdict")
    checks = v.filter(F.col("verdict").isin(R.CANDIDATE, R.NEGATIVE)).select("object_id", F.col("param").alias("code"), "verdict")
    free = O.numbered(v.filter(F.col("verdict") == R.MISSING), ["object_id"], ["param", "rule_key"], "n")
    return checks.unionByName(free.select("object_id", F.concat(F.lit("FREE-"), F.lpad(F.col("n").cast("string"), 3, "0")).alias("code"), F.lit("SUSPICION").alias("verdict")))


@query("snk01_gold_records", f"""{WITH_VERDICTS} SELECT '{{"code":"' || param || '","label":"' || CASE verdict WHEN 'CANDIDATE' THEN 'POSITIVE' ELSE 'NEGATIVE' END || '","object":' || object_id || ',"point":"' || rule_key || '"}}' line FROM verdicts WHERE verdict IN ('CANDIDATE', 'NEGATIVE_VERIFIED')""")
def snk01(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = verdicts(Tables(spark, sf_dir)).filter(F.col("verdict").isin(R.CANDIDATE, R.NEGATIVE))
    label = F.when(F.col("verdict") == R.CANDIDATE, "POSITIVE").otherwise("NEGATIVE")
    return v.select(F.to_json(F.struct(F.col("param").alias("code"), label.alias("label"), F.col("object_id").alias("object"), F.col("rule_key").alias("point"))).alias("line"))


@query("snk04_xml_rows", """SELECT '<check id="' || o_orderkey || '"><status>' || o_orderstatus || ' &lt;&amp;&gt; ' || o_orderkey || '</status></check>' line FROM orders""")
def snk04(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = F.concat("o_orderstatus", F.lit(" <&> "), F.col("o_orderkey").cast("string"))
    return Tables(spark, sf_dir).orders.select(D.xml_element("check", {"id": F.col("o_orderkey")}, {"status": status}).alias("line"))


@query("str02_keys", r"SELECT p_partkey, regexp_replace(replace(lower(trim(regexp_replace('- ' || p_name || ' .–', '\s+', ' ', 'g'))), 'ё', 'е'), '^[\s.,;:–-]+|[\s.,;:–-]+$', '', 'g') k FROM part")
def str02(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Tables(spark, sf_dir).part.select("p_partkey", T.key(F.concat(F.lit("- "), "p_name", F.lit(" .–"))).alias("k"))


@query("str17_canonical_numbers", "SELECT l_orderkey, l_linenumber, regexp_replace(regexp_replace(l_discount::DECIMAL(6,3)::VARCHAR, '(\\.[0-9]*?)0+$', '\\1'), '\\.$', '') n FROM lineitem")
def str17(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Tables(spark, sf_dir).lineitem.select("l_orderkey", "l_linenumber", T.canonical_number(F.concat(F.lit("00"), F.translate(F.col("l_discount").cast("decimal(6,3)").cast("string"), ".", ","))).alias("n"))


@query("str28_free_topics_str29", "SELECT doc_id, CASE WHEN regexp_matches(lower(text), 'licen[sc]e') THEN 'LICENCE' WHEN regexp_matches(lower(text), 'password|token') THEN 'SECRET' WHEN regexp_matches(text, '[A-Z]{5,}!!') THEN 'SHOUT' ELSE 'OTHER' END topic FROM documents")
def str28(spark: SparkSession, sf_dir: str) -> DataFrame:
    topic = F.when(F.lower("text").rlike("licen[sc]e"), "LICENCE").otherwise(T.first_match(F.col("text"), [("(?i)password|token", "SECRET"), ("[A-Z]{5,}!!", "SHOUT")], "OTHER"))
    return Tables(spark, sf_dir).documents.select("doc_id", topic.alias("topic"))


@query("dat04_date_like_numbers", "SELECT l_orderkey, l_linenumber, regexp_matches(strftime(l_shipdate, '%d.%m.%Y'), '^\\d{1,2}\\.\\d{1,2}\\.\\d{4}$') is_date, regexp_matches(l_partkey::VARCHAR, '^(19|20)\\d\\d$') is_year FROM lineitem")
def dat04(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = F.date_format("l_shipdate", "dd.MM.yyyy").rlike(r"^\d{1,2}\.\d{1,2}\.\d{4}$")
    return Tables(spark, sf_dir).lineitem.select("l_orderkey", "l_linenumber", day.alias("is_date"), F.col("l_partkey").cast("string").rlike(r"^(19|20)\d\d$").alias("is_year"))


@query("srt04_suspicions_order", "SELECT o_custkey, o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority, o_totalprice DESC, o_orderkey) = 1")
def srt04(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.first_per_group(Tables(spark, sf_dir).orders.select("o_custkey", "o_orderkey", "o_orderpriority", "o_totalprice"), ["o_custkey"], ["o_orderpriority", F.desc("o_totalprice"), "o_orderkey"]).select("o_custkey", "o_orderkey")


@query("stm02_job_lifecycle", "SELECT user_id, count(*) FILTER (event_type = 'error') failures, CASE WHEN count(*) FILTER (event_type = 'error') > 2 THEN 'FAILED' WHEN count(*) FILTER (event_type = 'purchase') > 0 THEN 'DONE' ELSE 'SENT' END state FROM events GROUP BY 1")
def stm02(spark: SparkSession, sf_dir: str) -> DataFrame:
    by = Tables(spark, sf_dir).events.groupBy("user_id").agg(F.count_if(F.col("event_type") == "error").alias("failures"), F.bool_or(F.col("event_type") == "purchase").alias("done"))
    return by.select("user_id", "failures", F.when(F.col("failures") > 2, "FAILED").when(F.col("done"), "DONE").otherwise("SENT").alias("state"))


@query("stm03_lost_jobs", "WITH e AS (SELECT *, lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) nxt FROM events) SELECT event_id FROM e WHERE nxt IS NULL OR nxt - ts > INTERVAL 1 DAY")
def stm03(spark: SparkSession, sf_dir: str) -> DataFrame:
    after = F.lead("ts").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    e = Tables(spark, sf_dir).events.withColumn("nxt", after)
    return e.filter(F.col("nxt").isNull() | (F.col("nxt") - F.col("ts") > F.expr("INTERVAL '1' DAY"))).select("event_id")
