"""Smaller operators: orders, formats, parsers and intake states."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stagewise.functions import text as T
from stagewise.operators import decisions as D
from stagewise.operators import reconcile as R
from stagewise.operators import relational as O

from .registry import Tables, query


@query("win02_latest_registry", "SELECT l_suppkey, arg_max(l_orderkey, (l_shipdate, l_orderkey)) latest FROM lineitem GROUP BY 1")
def win02(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Tables(spark, sf_dir).lineitem.groupBy("l_suppkey").agg(F.max_by("l_orderkey", F.struct("l_shipdate", "l_orderkey")).alias("latest"))


@query("srt07_stage_order_srt08", "SELECT l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_orderkey ORDER BY CASE l_linenumber % 3 WHEN 1 THEN 0 WHEN 2 THEN 1 ELSE 2 END, l_linenumber, l_partkey, l_suppkey, l_extendedprice) place FROM lineitem")
def srt07(spark: SparkSession, sf_dir: str) -> DataFrame:
    stage = F.when(F.col("l_linenumber") % 3 == 1, "PD").when(F.col("l_linenumber") % 3 == 2, "RD").otherwise("ID")
    rows = O.numbered(Tables(spark, sf_dir).lineitem, ["l_orderkey"], [R.stage_rank(stage), "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"], "place")
    return rows.select("l_orderkey", "l_linenumber", F.col("place").cast("long").alias("place"))


@query("dsl02_kleene_logic_dsl03_dsl04", """WITH v(x) AS (VALUES (true), (false), (NULL)) SELECT coalesce(a.x::VARCHAR, '') a, coalesce(b.x::VARCHAR, '') b, (a.x AND b.x)::VARCHAR both_true, (a.x OR b.x)::VARCHAR either, (NOT a.x)::VARCHAR negated,
  (a.x = b.x)::VARCHAR equal, (a.x IS NOT NULL)::VARCHAR there, NULL::VARCHAR ordered FROM v a, v b""")
def dsl02(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The truth table of rules as they are read and compiled, over two staged values."""
    from stagewise.functions import rules

    states = (True, False, None)
    value = "struct<num:double,str:string,bool:boolean>"
    rows = spark.createDataFrame([((None, None, a), (None, None, b)) for a in states for b in states], f"`A.PD` {value}, `B.RD` {value}")
    asked = {"both_true": "A.PD and B.RD", "either": "A.PD or B.RD", "negated": "not A.PD", "equal": "A.PD == B.RD", "there": "exists(A.PD)", "ordered": "A.PD < B.RD"}
    shown = lambda c: F.coalesce(F.col(c)["bool"].cast("string"), F.lit(""))
    return rows.select(shown("`A.PD`").alias("a"), shown("`B.RD`").alias("b"), *(rules.compile_tree(rules.Reader(t).whole()).cast("string").alias(n) for n, t in asked.items()))


@query("str06_only_numbers", "SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN NULL ELSE p_size + 0.5 END \"value\" FROM part")
def str06(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = F.col("p_size").cast("string")
    cell = F.when(F.col("p_partkey") % 3 == 0, F.concat(size, F.lit(".05.2024"))).when(F.col("p_partkey") % 3 == 1, F.concat(size, F.lit(",5 м2"))).otherwise(F.concat(size, F.lit(".5")))
    return Tables(spark, sf_dir).part.select("p_partkey", T.only_number(cell).alias("value"))


@query("str22_document_code", "SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'ЖС-РД-' || (270000 + p_partkey) || '-АР' WHEN 1 THEN NULL WHEN 2 THEN 'НВС-2025.03-4.2-КР' || p_size END code FROM part")
def str22(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The document's code among dates, numbers and shorter marks."""
    k, size = F.col("p_partkey"), F.col("p_size").cast("string")
    code = F.when(k % 4 == 0, F.concat(F.lit("ЖС-РД-"), (k + 270000).cast("string"), F.lit("-АР"))).when(k % 4 == 2, F.concat(F.lit("НВС-2025.03-4.2-КР"), size)).otherwise(F.lit("без шифра"))
    return Tables(spark, sf_dir).part.select("p_partkey", T.document_code(F.concat(F.lit("от 12.05.2024, лист АР-1, шифр "), code, F.lit(", стадия П"))).alias("code"))


@query("str27_registry_parsers", """SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'APPROVED' WHEN 'P' THEN 'DRAFT' ELSE 'UNKNOWN' END approval, CASE WHEN o_orderpriority LIKE '%URGENT' THEN true WHEN o_orderpriority LIKE '%LOW' THEN false END signed FROM orders""")
def str27(spark: SparkSession, sf_dir: str) -> DataFrame:
    state, priority = F.col("o_orderstatus"), F.col("o_orderpriority")
    word = F.when(state == "F", " Утверждён,").when(state == "P", "Проект").otherwise("на рассмотрении")
    sign = F.when(priority.endswith("URGENT"), "Подписано УКЭП").when(priority.endswith("LOW"), "Не подписан").otherwise("?")
    return Tables(spark, sf_dir).orders.select("o_orderkey", T.approval(word).alias("approval"), T.signed(sign).alias("signed"))


@query("str20_mojibake_repair", "SELECT s_suppkey, CASE WHEN s_suppkey % 2 = 0 THEN 'План этажа ' || s_suppkey || '.pdf' ELSE s_name END AS name FROM supplier")
def str20(spark: SparkSession, sf_dir: str) -> DataFrame:
    broken = F.lit("План этажа ".encode("cp866").decode("mac_cyrillic"))
    name = F.when(F.col("s_suppkey") % 2 == 0, F.concat(broken, F.col("s_suppkey").cast("string"), F.lit(".pdf"))).otherwise(F.col("s_name"))
    return Tables(spark, sf_dir).supplier.select("s_suppkey", T.repaired_name(name).alias("name"))


@query("cmp16_signed_delta", "SELECT o_orderkey, CASE WHEN o_totalprice >= 100000 THEN '+' ELSE '' END || printf('%.2f', o_totalprice - 100000) delta FROM orders")
def cmp16(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Tables(spark, sf_dir).orders.select("o_orderkey", F.format_string("%+.2f", F.col("o_totalprice") - 100000).alias("delta"))


@query("cmp21_upload_status", """SELECT l_orderkey, CASE WHEN bool_or(l_returnflag = 'A') THEN 'FAILED' WHEN count(DISTINCT l_linenumber % 3) = 3 THEN 'COMPLETE' ELSE 'PARTIALLY_LOADED' END status FROM lineitem GROUP BY 1""")
def cmp21(spark: SparkSession, sf_dir: str) -> DataFrame:
    stage = F.element_at(F.array(*map(F.lit, ("ID", "PD", "RD"))), F.col("l_linenumber") % 3 + 1)
    by = Tables(spark, sf_dir).lineitem.groupBy("l_orderkey").agg(F.bool_or(F.col("l_returnflag") == "A").alias("failed"), F.collect_set(stage).alias("present"))
    return by.select("l_orderkey", D.upload_status(F.col("failed"), F.col("present"), F.array(*map(F.lit, R.STAGES))).alias("status"))


@query("cmp31_model_states", """SELECT o_orderkey, CASE WHEN o_orderkey = max(o_orderkey) FILTER (o_orderstatus = 'F') OVER (PARTITION BY o_custkey) THEN 'APPROVED' WHEN o_orderstatus = 'F' THEN 'ROLLED_BACK' WHEN o_orderstatus = 'O' THEN 'PENDING' ELSE 'REJECTED' END state FROM orders""")
def cmp31(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = F.col("o_orderstatus")
    return D.model_states(Tables(spark, sf_dir).orders, "o_custkey", "o_orderkey", status == "F", status != "O").select("o_orderkey", "state")


@query("cmp31_registered_models", """WITH m AS (SELECT o_orderkey n, 'm-' || o_custkey v, o_orderkey % 11 = 0 bad, o_orderkey % 30 > 24 unknown, o_orderkey % 3 > 0 differ FROM orders)
  SELECT n, CASE WHEN bad THEN 'BAD_VERSION' WHEN n > min(n) FILTER (NOT (bad OR unknown OR differ)) OVER (PARTITION BY v) THEN 'MODEL_EXISTS' WHEN unknown THEN 'DATASET_UNKNOWN' WHEN differ THEN 'DATASET_HASH_MISMATCH' END error FROM m""")
def cmp31_registered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Models named after customers, trained on versions named after nations; of every three one lacks a hash and one has another."""
    t, k = Tables(spark, sf_dir), F.col("o_orderkey")
    train, test = (lambda n: F.md5(n.cast("string"))), (lambda n: F.md5(F.concat(F.lit("t"), n.cast("string"))))
    n = F.col("n_nationkey")
    datasets = t.nation.select(F.concat(F.lit("d"), n.cast("string")).alias("version"), F.create_map(F.lit("TRAIN"), train(n), F.lit("TEST"), test(n)).alias("split_hashes"))
    of = k % 30
    split = F.when(k % 3 == 1, F.create_map(F.lit("TRAIN"), train(of))).otherwise(F.create_map(F.lit("TEST"), F.when(k % 3 == 0, test(of)).otherwise("other"), F.lit("TRAIN"), train(of)))
    name = F.concat(F.when(k % 11 == 0, "no name ").otherwise(" "), F.lit("m-"), F.col("o_custkey").cast("string"), F.lit(" "))
    models = t.orders.select(k.alias("n"), name.alias("model_version"), F.concat(F.lit("d"), of.cast("string")).alias("dataset_version"), split.alias("split_hashes"))
    return D.registered_models(models, datasets, "n").select("n", "error")


@query("stm07_deferred_packages", """SELECT event_id, CASE WHEN ts < max(CASE WHEN event_type = 'purchase' THEN ts END) OVER (PARTITION BY user_id) THEN 'APPLIED' ELSE 'DEFERRED' END state FROM events""")
def stm07(spark: SparkSession, sf_dir: str) -> DataFrame:
    open_until = F.max(F.when(F.col("event_type") == "purchase", F.col("ts"))).over(Window.partitionBy("user_id"))
    return Tables(spark, sf_dir).events.withColumn("until", open_until).select("event_id", F.when(F.col("ts") < F.col("until"), "APPLIED").otherwise("DEFERRED").alias("state"))


@query("arr01_interval_union", """WITH s AS (SELECT DISTINCT l_orderkey k, l_quantity::INT a, l_quantity::INT + 5 b FROM lineitem), m AS (SELECT *, max(b) OVER (PARTITION BY k ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) p FROM s),
  g AS (SELECT *, sum((p IS NULL OR a > p)::INT) OVER (PARTITION BY k ORDER BY a, b ROWS UNBOUNDED PRECEDING) g FROM m) SELECT k, min(a) low, max(b) high FROM g GROUP BY k, g""")
def arr01(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = F.col("l_quantity").cast("int")
    s = Tables(spark, sf_dir).lineitem.select(F.col("l_orderkey").alias("k"), a.alias("a"), (a + 5).alias("b")).distinct()
    w = Window.partitionBy("k").orderBy("a", "b")
    m = s.withColumn("p", F.max("b").over(w.rowsBetween(Window.unboundedPreceding, -1)))
    new = (F.col("p").isNull() | (F.col("a") > F.col("p"))).cast("int")
    return m.withColumn("g", F.sum(new).over(w.rowsBetween(Window.unboundedPreceding, 0))).groupBy("k", "g").agg(F.min("a").alias("low"), F.max("b").alias("high")).drop("g")
