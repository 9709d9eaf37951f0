"""Metrics, acceptance checks, the scorer and its features."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stagewise.operators import learning as L
from stagewise.operators.decisions import incompleteness
from stagewise.operators.reconcile import CANDIDATE, NEGATIVE

from .core import WITH_VERDICTS, verdicts
from .registry import Tables, query

JUDGED_SQL = "WITH j AS (SELECT lang, source, quality = 1 t, n_chars > 1000 p, doc_id FROM labels JOIN documents USING (doc_id)), c AS (SELECT {k} count(*) FILTER (t AND p) tp, count(*) FILTER (NOT t AND p) fp, count(*) FILTER (t AND NOT p) fn, count(*) FILTER (NOT t AND NOT p) tn FROM j {g})"
RATES_SQL = """round(coalesce(tp / nullif(tp + fp, 0), 0), 4) "precision", round(coalesce(tp / nullif(tp + fn, 0), 0), 4) recall, round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0), 4) f1,
  round(coalesce((tp + tn) / nullif(tp + fp + fn + tn, 0), 0), 4) accuracy, round(coalesce(fp / nullif(fp + tn, 0), 0), 4) false_positive_rate"""


def judged(t: Tables) -> DataFrame:
    d = t.documents.select("doc_id", "lang", "source", "n_chars")
    return t.labels.join(d, "doc_id").select("doc_id", "lang", "source", (F.col("quality") == 1).alias("t"), (F.col("n_chars") > 1000).alias("p"))


@query("agg23_confusion", f"{JUDGED_SQL.format(k='', g='')} SELECT tp, fp, fn, tn, {RATES_SQL} FROM c")
def agg23(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.confusion(judged(Tables(spark, sf_dir)), F.col("t"), F.col("p"))


@query("agg24_per_category", f"{JUDGED_SQL.format(k='lang,', g='GROUP BY lang')} SELECT lang, tp, fp, fn, tn, {RATES_SQL} FROM c")
def agg24(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.confusion(judged(Tables(spark, sf_dir)), F.col("t"), F.col("p"), ["lang"])


@query("agg24_total_and_categories", f"{JUDGED_SQL.format(k='lang,', g='GROUP BY GROUPING SETS ((lang), ())')} SELECT coalesce(lang, 'ALL') lang, tp, fp, fn, tn FROM c")
def agg24_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    count = lambda c: F.count_if(c)
    t, p = F.col("t"), F.col("p")
    rows = judged(Tables(spark, sf_dir)).rollup("lang").agg(count(t & p).alias("tp"), count(~t & p).alias("fp"), count(t & ~p).alias("fn"), count(~t & ~p).alias("tn"))
    return rows.withColumn("lang", F.coalesce("lang", F.lit("ALL")))


@query("agg25_bootstrap_interval")
def agg25(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.poisson_interval(judged(Tables(spark, sf_dir)), F.col("t"), F.col("p"), "doc_id")


@query("agg26_macro_f1", """WITH j AS (SELECT lang t, CASE WHEN n_chars % 3 = 0 THEN 'en' ELSE lang END p FROM documents), k AS (SELECT DISTINCT t k FROM j),
  c AS (SELECT k, count(*) FILTER (t = k AND p = k) tp, count(*) FILTER (t <> k AND p = k) fp, count(*) FILTER (t = k AND p <> k) fn FROM j, k GROUP BY 1) SELECT round(avg(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0)), 4) macro_f1, sum(tp)::BIGINT correct FROM c""")
def agg26(spark: SparkSession, sf_dir: str) -> DataFrame:
    j = Tables(spark, sf_dir).documents.select(F.col("lang").alias("t"), F.when(F.col("n_chars") % 3 == 0, "en").otherwise(F.col("lang")).alias("p"))
    sides = j.select(F.explode(F.array(F.struct(F.col("t").alias("k"), F.lit(1).alias("is_t"), F.lit(0).alias("is_p"), (F.col("t") == F.col("p")).cast("int").alias("ok")), F.struct(F.col("p").alias("k"), F.lit(0).alias("is_t"), F.lit(1).alias("is_p"), F.lit(0).alias("ok")))).alias("x")).select("x.*")
    by = sides.groupBy("k").agg(F.sum("is_t").alias("truth"), F.sum("is_p").alias("said"), F.sum("ok").alias("tp")).filter("truth > 0")
    f1 = F.coalesce(F.try_divide(2 * F.col("tp"), F.col("truth") + F.col("said")), F.lit(0.0))
    return by.agg(F.round(F.avg(f1), 4).alias("macro_f1"), F.sum("tp").alias("correct"))


@query("agg27_localisation", """WITH g AS (SELECT l_orderkey k, l_linenumber n, l_quantity / 60 x, l_tax * 5 y FROM lineitem WHERE l_linenumber % 2 = 0), p AS (SELECT l_orderkey k, l_linenumber + 1 n, l_quantity / 60 + 0.1 x, l_tax * 5 + 0.1 y FROM lineitem WHERE l_linenumber % 2 = 1)
  SELECT count(*) pairs, count(*) FILTER (p.x BETWEEN g.x AND g.x + 0.2 AND p.y BETWEEN g.y AND g.y + 0.3) centred FROM g JOIN p USING (k, n)""")
def agg27(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = Tables(spark, sf_dir).lineitem.select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("n"), (F.col("l_quantity") / 60).alias("x"), (F.col("l_tax") * 5).alias("y"))
    g = rows.filter("n % 2 = 0")
    p = rows.filter("n % 2 = 1").select("k", (F.col("n") + 1).alias("n"), (F.col("x") + 0.1).alias("px"), (F.col("y") + 0.1).alias("py"))
    inside = F.col("px").between(F.col("x"), F.col("x") + 0.2) & F.col("py").between(F.col("y"), F.col("y") + 0.3)
    return g.join(p, ["k", "n"]).agg(F.count("*").alias("pairs"), F.count_if(inside).alias("centred"))


@query("agg28_gold_score", f"""{WITH_VERDICTS}, g AS (SELECT *, n % 3 = 0 gold, n % 2 = 0 eligible FROM verdicts) SELECT count(*) FILTER (gold AND eligible AND verdict = 'CANDIDATE') tp, count(*) FILTER (gold AND eligible AND verdict <> 'CANDIDATE') fn,
  count(*) FILTER (NOT gold AND verdict = 'CANDIDATE') fp, count(*) FILTER (NOT gold AND verdict = 'NEGATIVE_VERIFIED') tn FROM g""".replace("points.*, params.*", "points.*, direction, percent, absolute, below"))
def agg28(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = verdicts(Tables(spark, sf_dir)).select("verdict", "PD_n", "RD_n", "ID_n")
    n = F.col("PD_n") + F.col("RD_n") + F.col("ID_n")
    gold, eligible, hit = n % 3 == 0, n % 2 == 0, F.col("verdict") == CANDIDATE
    return v.agg(F.count_if(gold & eligible & hit).alias("tp"), F.count_if(gold & eligible & ~hit).alias("fn"), F.count_if(~gold & hit).alias("fp"), F.count_if(~gold & (F.col("verdict") == NEGATIVE)).alias("tn"))


@query("agg31_calibration", "SELECT source, count(*) n, round(avg((quality = 1)::INT), 4) rate FROM labels JOIN documents USING (doc_id) GROUP BY 1")
def agg31(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged(Tables(spark, sf_dir)).groupBy("source").agg(F.count("*").alias("n"), F.round(F.avg(F.col("t").cast("int")), 4).alias("rate"))


@query("agg36_visual_coverage", "SELECT l_shipdate::DATE::VARCHAR AS day, count(*) possible, count(*) FILTER (l_tax > 0.02) checked, count(*) FILTER (l_tax > 0.02) < count(*) AS limited FROM lineitem GROUP BY 1")
def agg36(spark: SparkSession, sf_dir: str) -> DataFrame:
    by = Tables(spark, sf_dir).lineitem.groupBy(F.date_format("l_shipdate", "yyyy-MM-dd").alias("day")).agg(F.count("*").alias("possible"), F.count_if(F.col("l_tax") > 0.02).alias("checked"))
    return by.withColumn("limited", F.col("checked") < F.col("possible"))


@query("agg39_experiment_metrics", "WITH d AS (SELECT l_suppkey s, l_partkey p, avg(l_quantity) q FROM lineitem GROUP BY ALL) SELECT s, round(median(q), 4) median, round(stddev_samp(q), 4) deviation, round(avg(q), 4) mean FROM d GROUP BY 1")
def agg39(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = Tables(spark, sf_dir).lineitem.groupBy(F.col("l_suppkey").alias("s"), "l_partkey").agg(F.avg("l_quantity").alias("q"))
    return d.groupBy("s").agg(F.round(F.median("q"), 4).alias("median"), F.round(F.stddev_samp("q"), 4).alias("deviation"), F.round(F.avg("q"), 4).alias("mean"))


@query("cmp30_acceptance", f"""{JUDGED_SQL.format(k='', g='')}, m AS (SELECT {RATES_SQL} FROM c) SELECT 'precision' metric, "precision" AS "value", 0.9 bound, "precision" >= 0.9 passed FROM m UNION ALL SELECT 'recall', recall, 0.8, recall >= 0.8 FROM m
  UNION ALL SELECT 'f1', f1, 0.85, f1 >= 0.85 FROM m UNION ALL SELECT 'false_positive_rate', false_positive_rate, 0.1, false_positive_rate <= 0.1 FROM m""")
def cmp30(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.acceptance(L.confusion(judged(Tables(spark, sf_dir)), F.col("t"), F.col("p")))


@query("cmp27_scorer_probability", """SELECT l_orderkey, l_linenumber, round(1 / (1 + exp(-(0.8 * least(abs(ln(l_quantity / 25)), 6) - 1.2 * least(abs(l_quantity - 25) / 25, 5) + 0.4 * (l_returnflag = 'A')::INT - 0.3))), 6) p FROM lineitem""")
def cmp27(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = F.col("l_quantity")
    features = [L.log_ratio(F.lit(25.0), q), L.relative_delta(F.lit(25.0), q), *L.one_hot(F.col("l_returnflag"), ["A"])]
    return Tables(spark, sf_dir).lineitem.select("l_orderkey", "l_linenumber", F.round(L.probability(features, [0.8, -1.2, 0.4], -0.3), 6).alias("p"))


@query("arr02_feature_vectors", "SELECT l_orderkey, l_linenumber, array_to_string([(l_returnflag = 'A')::INT, (l_returnflag = 'N')::INT, (l_returnflag = 'R')::INT], ',') v FROM lineitem")
def arr02(spark: SparkSession, sf_dir: str) -> DataFrame:
    hot = F.array(*(c.cast("int").cast("string") for c in L.one_hot(F.col("l_returnflag"), ["A", "N", "R"])))
    return Tables(spark, sf_dir).lineitem.select("l_orderkey", "l_linenumber", F.array_join(hot, ",").alias("v"))


@query("udf13_newton_training")
def newton(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = judged(Tables(spark, sf_dir)).select(F.col("t").cast("int").alias("y"), F.col("p").cast("double").alias("long"), (F.col("lang") == "en").cast("double").alias("english"))
    weights, bias = L.newton_sums(rows, ["long", "english"], "y")
    return spark.createDataFrame([("long", round(weights[0], 6)), ("english", round(weights[1], 6)), ("bias", round(bias, 6))], "feature string, weight double")


@query("cmp28_gold_incompleteness", "SELECT o_orderkey, list_filter([CASE WHEN o_totalprice < 1000 THEN 'label' END, CASE WHEN n < 2 THEN 'sources' END, CASE WHEN NOT pages THEN 'pages' END], lambda x: x IS NOT NULL)[1] reason FROM orders JOIN (SELECT l_orderkey, count(*) n, bool_and(l_linenumber < 6) pages FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey")
def cmp28(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = Tables(spark, sf_dir)
    by = t.lineitem.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("n"), F.bool_and(F.col("l_linenumber") < 6).alias("pages"))
    return t.orders.join(by, "o_orderkey").select("o_orderkey", incompleteness(F.col("o_totalprice") >= 1000, F.col("n") >= 2, F.col("pages")).alias("reason"))


@query("cmp29_submission_mapping", f"""{WITH_VERDICTS} SELECT object_id, param, rule_key, CASE verdict WHEN 'CANDIDATE' THEN 'VIOLATION' WHEN 'NEGATIVE_VERIFIED' THEN 'NO_VIOLATION' WHEN 'MISSING_EVIDENCE' THEN CASE WHEN pd_n = 0 THEN 'PD_MISSING' ELSE 'RD_MISSING' END ELSE 'NOT_EVALUATED' END violation_label,
  CASE priority WHEN 'HIGH' THEN 'CRITICAL' ELSE 'WARNING' END criticality FROM verdicts""")
def cmp29(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.col("verdict")
    label = F.when(v == CANDIDATE, "VIOLATION").when(v == NEGATIVE, "NO_VIOLATION").when(v == "MISSING_EVIDENCE", F.when(F.col("PD_n") == 0, "PD_MISSING").otherwise("RD_MISSING")).otherwise("NOT_EVALUATED")
    return verdicts(Tables(spark, sf_dir)).select("object_id", "param", "rule_key", label.alias("violation_label"), F.when(F.col("priority") == "HIGH", "CRITICAL").otherwise("WARNING").alias("criticality"))
