"""The comparison of staged values: adapter tables and the queries over them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stagewise.operators import reconcile as R
from stagewise.operators.relational import carried_over, first_per_group

from .registry import Tables, query

# One parameter for each brand; the brand's number picks the trigger's shape and the priority.
PARAMS_SQL = """params AS (
  SELECT code, n, CASE n % 5 WHEN 2 THEN 'down' WHEN 3 THEN 'up' ELSE 'any' END direction,
    CASE WHEN n % 5 = 0 THEN 10.0::DOUBLE END percent, CASE WHEN n % 5 = 1 THEN 5.0::DOUBLE END absolute,
    CASE WHEN n % 5 = 4 THEN 3.0::DOUBLE END below, CASE n % 3 WHEN 0 THEN 'HIGH' WHEN 1 THEN 'MEDIUM' ELSE 'LOW' END priority
  FROM (SELECT DISTINCT p_brand code, CAST(substr(p_brand, 7) AS INT) n FROM part))"""
EXTRACTIONS_SQL = """ext AS (
  SELECT l_suppkey object_id, p_brand param, p_type rule_key, CASE l_linenumber % 3 WHEN 1 THEN 'PD' WHEN 2 THEN 'RD' ELSE 'ID' END stage,
    l_quantity value, l_returnflag = 'A' AND l_quantity > 45 bad, l_orderkey, l_linenumber FROM lineitem JOIN part ON l_partkey = p_partkey)"""
POINTS_SQL = """points AS (
  SELECT object_id, param, rule_key, min(value) FILTER (stage='PD') pd_min, max(value) FILTER (stage='PD') pd_max, count(*) FILTER (stage='PD') pd_n,
    min(value) FILTER (stage='RD') rd_min, max(value) FILTER (stage='RD') rd_max, count(*) FILTER (stage='RD') rd_n,
    min(value) FILTER (stage='ID') id_min, max(value) FILTER (stage='ID') id_max, count(*) FILTER (stage='ID') id_n,
    count(*) FILTER (bad) n_bad, count(*) n FROM ext GROUP BY ALL)"""


def _hit_sql(a: str) -> str:
    return f"""CASE WHEN {a} IS NULL THEN NULL WHEN below IS NOT NULL THEN {a} < below - 1e-9 WHEN pd_min IS NULL THEN NULL
      WHEN abs({a} - pd_min) <= 0.5 + 1e-9 THEN false WHEN (direction='down' AND {a} > pd_min) OR (direction='up' AND {a} < pd_min) THEN false
      WHEN percent IS NOT NULL THEN abs({a} - pd_min) / abs(pd_min) * 100 > percent + 1e-9 WHEN absolute IS NOT NULL THEN abs({a} - pd_min) > absolute + 1e-9 ELSE true END"""


VERDICTS_SQL = f"""hits AS (SELECT points.*, params.*, {_hit_sql('rd_min')} rd_hit, {_hit_sql('id_min')} id_hit FROM points LEFT JOIN params ON param = code),
verdicts AS (SELECT *, CASE WHEN n_bad > 0 THEN 'NOT_COMPARABLE' WHEN pd_n = 0 AND below IS NULL THEN 'MISSING_EVIDENCE' WHEN rd_n = 0 AND id_n = 0 THEN 'MISSING_EVIDENCE'
    WHEN pd_min <> pd_max THEN 'CLARIFICATION_REQUIRED' WHEN rd_min <> rd_max OR id_min <> id_max THEN 'CLARIFICATION_REQUIRED'
    WHEN coalesce(rd_hit, false) OR coalesce(id_hit, false) THEN 'CANDIDATE' ELSE 'NEGATIVE_VERIFIED' END verdict,
    CASE WHEN rd_hit THEN 'RD' WHEN id_hit THEN 'ID' WHEN rd_n > 0 THEN 'RD' WHEN id_n > 0 THEN 'ID' END actual_stage FROM hits)"""
WITH_POINTS = f"WITH {PARAMS_SQL}, {EXTRACTIONS_SQL}, {POINTS_SQL}"
WITH_VERDICTS = f"{WITH_POINTS}, {VERDICTS_SQL}"
KEYS = ["object_id", "param", "rule_key"]


def params(t: Tables) -> DataFrame:
    n = F.substring("p_brand", 7, 100).cast("int")
    shape = lambda k, x: F.when(F.col("n") % 5 == k, F.lit(x))
    return t.part.select(F.col("p_brand").alias("code"), n.alias("n")).distinct().select(
        "code", "n", F.coalesce(shape(2, "down"), shape(3, "up"), F.lit("any")).alias("direction"), shape(0, 10.0).alias("percent"),
        shape(1, 5.0).alias("absolute"), shape(4, 3.0).alias("below"), F.lit(None).cast("double").alias("above"), F.lit(0).alias("places"),
        F.when(F.col("n") % 3 == 0, "HIGH").when(F.col("n") % 3 == 1, "MEDIUM").otherwise("LOW").alias("priority"),
    )


def extractions(t: Tables) -> DataFrame:
    stage = F.when(F.col("l_linenumber") % 3 == 1, "PD").when(F.col("l_linenumber") % 3 == 2, "RD").otherwise("ID")
    lines = t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_returnflag")
    return lines.join(t.part.select("p_partkey", "p_brand", "p_type"), F.col("l_partkey") == F.col("p_partkey")).select(
        F.col("l_suppkey").alias("object_id"), F.col("p_brand").alias("param"), F.col("p_type").alias("rule_key"), stage.alias("stage"),
        F.col("l_quantity").alias("value"), ((F.col("l_returnflag") == "A") & (F.col("l_quantity") > 45)).alias("bad"), "l_orderkey", "l_linenumber",
    )


def points(t: Tables) -> DataFrame:
    return R.control_points(extractions(t), KEYS)


def verdicts(t: Tables) -> DataFrame:
    return R.verdicts(points(t), params(t))


@query("agg01_verdict_counters", f"""{WITH_VERDICTS} SELECT priority, count(DISTINCT param) params, count(*) checks,
  count(*) FILTER (verdict='CANDIDATE') candidates, count(*) FILTER (verdict='NEGATIVE_VERIFIED') negatives, count(*) FILTER (verdict='MISSING_EVIDENCE') missing,
  count(*) FILTER (verdict='NOT_COMPARABLE') not_comparable, count(*) FILTER (verdict='CLARIFICATION_REQUIRED') clarifications, count(*) FILTER (verdict='NOT_APPLICABLE') not_applicable
  FROM verdicts GROUP BY priority""")
def agg01(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.counters(verdicts(Tables(spark, sf_dir)), keys=["priority"])


@query("agg01_global_counters", f"{WITH_VERDICTS} SELECT count(DISTINCT param) params, count(*) checks, count(*) FILTER (verdict='CANDIDATE') candidates FROM verdicts")
def agg01_global(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.counters(verdicts(Tables(spark, sf_dir))).select("params", "checks", "candidates")


@query("agg02_compliance_agg03_light", f"""{WITH_VERDICTS}, c AS (SELECT object_id, count(*) FILTER (verdict='NEGATIVE_VERIFIED') negatives, count(*) FILTER (verdict='CANDIDATE') candidates,
  count(*) FILTER (verdict='CLARIFICATION_REQUIRED') open_checks, count(*) checks FROM verdicts GROUP BY 1)
  SELECT object_id, CASE WHEN negatives + candidates > 0 THEN floor(negatives / (negatives + candidates) * 1000 + 0.5) / 10 END compliance_percent,
  CASE WHEN candidates > 0 THEN 'RED' WHEN open_checks > 0 OR checks = 0 THEN 'YELLOW' ELSE 'GREEN' END indicator FROM c""")
def agg02(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = R.counters(verdicts(Tables(spark, sf_dir)), keys=["object_id"])
    return c.select("object_id", R.compliance(F.col("negatives"), F.col("candidates")).alias("compliance_percent"), R.light(F.col("candidates"), F.col("clarifications"), F.col("checks")).alias("indicator"))


@query("agg12_point_groups", f"{WITH_POINTS} SELECT object_id, param, rule_key, pd_min, pd_max, pd_n, rd_min, rd_max, rd_n, id_min, id_max, id_n, n_bad, n FROM points")
def agg12(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = points(Tables(spark, sf_dir))
    return p.select(*KEYS, *(F.col(f"{s}_{x}").alias(f"{s.lower()}_{x}") for s in R.STAGES for x in ("min", "max", "n")), "n_bad", "n")


@query("agg13_stage_comparison", f"""WITH {EXTRACTIONS_SQL} SELECT object_id, param, string_agg(stage || ':' || n, ',' ORDER BY CASE stage WHEN 'PD' THEN 0 WHEN 'RD' THEN 1 ELSE 2 END) stages
  FROM (SELECT object_id, param, stage, count(*) n FROM ext GROUP BY ALL) GROUP BY 1, 2""")
def agg13(spark: SparkSession, sf_dir: str) -> DataFrame:
    by = extractions(Tables(spark, sf_dir)).groupBy("object_id", "param", "stage").agg(F.count("*").alias("n"))
    rows = F.array_sort(F.collect_list(F.struct(R.stage_rank(F.col("stage")).alias("rank"), "stage", "n")))
    return by.groupBy("object_id", "param").agg(rows.alias("rows")).select("object_id", "param", F.array_join(F.transform("rows", lambda r: F.concat(r["stage"], F.lit(":"), r["n"])), ",").alias("stages"))


@query("cmp07_verdicts", f"{WITH_VERDICTS} SELECT object_id, param, rule_key, verdict, CASE WHEN verdict IN ('CANDIDATE','NEGATIVE_VERIFIED') THEN 'COMPLETE' ELSE verdict END completeness FROM verdicts")
def cmp07(spark: SparkSession, sf_dir: str) -> DataFrame:
    return verdicts(Tables(spark, sf_dir)).select(*KEYS, "verdict", "completeness")


@query("cmp08_chosen_pair", f"""{WITH_VERDICTS} SELECT object_id, param, rule_key, actual_stage,
  CASE actual_stage WHEN 'RD' THEN rd_min - pd_min WHEN 'ID' THEN id_min - pd_min END delta FROM verdicts WHERE verdict = 'CANDIDATE'""")
def cmp08(spark: SparkSession, sf_dir: str) -> DataFrame:
    return verdicts(Tables(spark, sf_dir)).filter(F.col("verdict") == R.CANDIDATE).select(*KEYS, "actual_stage", "delta")


@query("cmp09_number_comparator", f"""WITH {PARAMS_SQL}, pairs AS (SELECT l_orderkey, l_linenumber, p_brand code, l_quantity rd_min, p_size::DOUBLE pd_min FROM lineitem JOIN part ON l_partkey = p_partkey)
  SELECT l_orderkey, l_linenumber, {_hit_sql('rd_min')} hit FROM pairs JOIN params USING (code)""")
def cmp09(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = Tables(spark, sf_dir)
    rows = t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey")).join(params(t), F.col("p_brand") == F.col("code"))
    hit = R.number_hit(F.col("p_size").cast("double"), F.col("l_quantity"), *map(F.col, ("direction", "percent", "absolute", "below", "above", "places")))
    return rows.select("l_orderkey", "l_linenumber", hit.alias("hit"))


@query("cmp10_enum_comparator", """WITH s AS (SELECT ['1-URGENT','2-HIGH','3-MEDIUM','4-NOT SPECIFIED','5-LOW'] scale),
  o AS (SELECT o_orderkey, o_custkey, o_orderpriority a, lag(o_orderpriority) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) e, o_custkey % 3 d FROM orders)
  SELECT o_orderkey, CASE WHEN list_position(scale, e) IS NULL OR list_position(scale, a) IS NULL THEN NULL
    ELSE list_position(scale, a) <> list_position(scale, e) AND NOT (d = 0 AND list_position(scale, a) > list_position(scale, e)) AND NOT (d = 1 AND list_position(scale, a) < list_position(scale, e)) END hit
  FROM o, s WHERE e IS NOT NULL""")
def cmp10(spark: SparkSession, sf_dir: str) -> DataFrame:
    before = F.lag("o_orderpriority").over(Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey"))
    o = Tables(spark, sf_dir).orders.withColumn("e", before).filter("e IS NOT NULL")
    scale = F.array(*map(F.lit, ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")))
    direction = F.when(F.col("o_custkey") % 3 == 0, "down").when(F.col("o_custkey") % 3 == 1, "up").otherwise("any")
    return o.select("o_orderkey", R.enum_hit(scale, F.col("e"), F.col("o_orderpriority"), direction).alias("hit"))


@query("cmp11_boolean_comparator", """WITH o AS (SELECT o_orderkey, o_orderstatus = 'F' a, lag(o_orderstatus = 'F') OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) e, o_custkey % 3 d FROM orders)
  SELECT o_orderkey, e <> a AND NOT (d = 0 AND a) AND NOT (d = 1 AND NOT a) hit FROM o WHERE e IS NOT NULL""")
def cmp11(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = F.col("o_orderstatus") == "F"
    o = Tables(spark, sf_dir).orders.withColumn("a", a).withColumn("e", F.lag("a").over(Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey"))).filter("e IS NOT NULL")
    direction = F.when(F.col("o_custkey") % 3 == 0, "down").when(F.col("o_custkey") % 3 == 1, "up").otherwise("any")
    return o.select("o_orderkey", R.boolean_hit(F.col("e"), F.col("a"), direction).alias("hit"))


@query("cmp12_coordinate_comparator", """SELECT a.vec_id, sqrt(list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda x: (x[1]::DOUBLE - x[2]::DOUBLE) * (x[1]::DOUBLE - x[2]::DOUBLE)))) > 11.0 + 1e-9 hit
  FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1""")
def cmp12(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = Tables(spark, sf_dir).embeddings.select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    after = vectors.select((F.col("vec_id") - 1).alias("vec_id"), F.col("v").alias("w"))
    return vectors.join(after, "vec_id").select("vec_id", R.shift_hit(F.col("v"), F.col("w"), F.lit(11.0)).alias("hit"))


@query("cmp02_required_stages", """SELECT p_partkey, list_filter([CASE WHEN p_size % 2 = 0 THEN 'PD' END, CASE WHEN p_size % 3 = 0 THEN 'RD' END, CASE WHEN p_size % 5 = 0 THEN 'ID' END], lambda x: x IS NOT NULL)[1] reference,
  len(list_filter([CASE WHEN p_size % 2 = 0 THEN 'PD' END, CASE WHEN p_size % 3 = 0 THEN 'RD' END, CASE WHEN p_size % 5 = 0 THEN 'ID' END], lambda x: x IS NOT NULL)) stages FROM part""")
def cmp02(spark: SparkSession, sf_dir: str) -> DataFrame:
    source = lambda k: F.when(F.col("p_size") % k == 0, F.col("p_name")).otherwise(F.lit("  "))
    stages = R.required_stages(source(2), source(3), source(5))
    return Tables(spark, sf_dir).part.select("p_partkey", F.get(stages, F.lit(0)).alias("reference"), F.size(stages).cast("long").alias("stages"))


@query("cmp03_applicability", f"""WITH {PARAMS_SQL}, marks AS (SELECT l_suppkey object_id, list(DISTINCT p_type) marks FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1),
  own AS (SELECT p_brand code, list(DISTINCT p_type) own FROM part WHERE p_size > 47 GROUP BY 1)
  SELECT s_suppkey object_id, code, CASE WHEN own IS NULL OR marks IS NULL OR list_has_any(own, marks) THEN 'APPLICABLE' ELSE 'NOT_APPLICABLE' END applicability
  FROM supplier CROSS JOIN params LEFT JOIN own USING (code) LEFT JOIN marks ON s_suppkey = object_id""")
def cmp03(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = Tables(spark, sf_dir)
    marks = extractions(t).select("object_id", F.col("rule_key").alias("mark")).distinct().groupBy("object_id").agg(F.collect_set("mark").alias("marks"))
    own = t.part.filter("p_size > 47").groupBy(F.col("p_brand").alias("code")).agg(F.collect_set("p_type").alias("own"))
    every = t.supplier.select(F.col("s_suppkey").alias("object_id")).crossJoin(params(t).select("code"))  # objects x a matrix of fixed size
    known = every.join(own, "code", "left").join(marks, "object_id", "left")
    fits = F.col("own").isNull() | F.col("marks").isNull() | F.arrays_overlap("own", "marks")
    return known.select("object_id", "code", F.when(fits, "APPLICABLE").otherwise(R.NOT_APPLICABLE).alias("applicability"))


@query("cmp05_missing_outcome", f"""WITH {PARAMS_SQL}, {EXTRACTIONS_SQL}, want AS (SELECT s_suppkey object_id, code param, unnest(['PD','RD','ID']) stage FROM supplier, params)
  SELECT w.object_id, w.param, count(*) missing_stages FROM want w WHERE NOT EXISTS (SELECT 1 FROM ext e WHERE e.object_id = w.object_id AND e.param = w.param AND e.stage = w.stage AND NOT e.bad) GROUP BY 1, 2""")
def cmp05(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = Tables(spark, sf_dir)
    want = t.supplier.select(F.col("s_suppkey").alias("object_id")).crossJoin(params(t).select(F.col("code").alias("param")))  # objects x a matrix of fixed size
    want = want.withColumn("stage", F.explode(F.array(*map(F.lit, R.STAGES))))
    have = extractions(t).filter("not bad").select("object_id", "param", "stage")
    return want.join(have, ["object_id", "param", "stage"], "left_anti").groupBy("object_id", "param").agg(F.count("*").alias("missing_stages"))


@query("cmp06_unplaced_guard", """WITH e AS (SELECT l_suppkey object_id, p_brand param, CASE WHEN p_size % 2 = 0 THEN p_type END rule_key, l_linenumber % 3 s FROM lineitem JOIN part ON l_partkey = p_partkey),
  g AS (SELECT object_id, param, rule_key, count(DISTINCT s) stages FROM e GROUP BY ALL)
  SELECT object_id, param, stages FROM g WHERE rule_key IS NULL AND stages > 1 AND EXISTS (SELECT 1 FROM g h WHERE h.object_id = g.object_id AND h.param = g.param AND h.rule_key IS NOT NULL)""")
def cmp06(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = Tables(spark, sf_dir)
    keyed = t.part.select(F.col("p_partkey").alias("l_partkey"), F.when(F.col("p_size") % 2 == 0, F.col("p_type")).alias("rule_key"), F.col("p_brand").alias("param"))
    rows = t.lineitem.join(keyed, "l_partkey").select(
        F.col("l_suppkey").alias("object_id"), "param", "rule_key", F.element_at(F.array(*map(F.lit, ("ID", "PD", "RD"))), F.col("l_linenumber") % 3 + 1).alias("stage"),
        F.col("l_quantity").alias("value"), F.lit(False).alias("bad"),
    )
    found = R.unplaced(R.control_points(rows, KEYS), ["object_id", "param"], "rule_key")
    return found.select("object_id", "param", sum((F.col(f"{s}_n") > 0).cast("long") for s in R.STAGES).alias("stages"))


@query("cmp14_code_sets", """WITH s AS (SELECT l_orderkey, list(DISTINCT p_type) FILTER (l_linenumber % 2 = 1) e, list(DISTINCT p_type) FILTER (l_linenumber % 2 = 0) a FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1)
  SELECT l_orderkey, len(list_filter(e, lambda x: len(list_filter(a, lambda y: starts_with(x, y) OR starts_with(y, x))) = 0)) lost,
  len(list_filter(a, lambda x: len(list_filter(e, lambda y: starts_with(x, y) OR starts_with(y, x))) = 0)) added FROM s WHERE e IS NOT NULL AND a IS NOT NULL""")
def cmp14(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = Tables(spark, sf_dir)
    rows = t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey"))
    odd = lambda k: F.collect_set(F.when(F.col("l_linenumber") % 2 == k, F.col("p_type")))
    sets = rows.groupBy("l_orderkey").agg(odd(1).alias("e"), odd(0).alias("a")).filter((F.size("e") > 0) & (F.size("a") > 0))
    count = lambda x, y: F.size(R.missing_codes(F.col(x), F.col(y))).cast("long")
    return sets.select("l_orderkey", count("e", "a").alias("lost"), count("a", "e").alias("added"))


@query("cmp17_finding_keys", f"{WITH_POINTS} SELECT object_id, param, rule_key, sha1(object_id || '|' || param || '|' || coalesce(rule_key, '')) finding_key FROM points")
def cmp17(spark: SparkSession, sf_dir: str) -> DataFrame:
    return points(Tables(spark, sf_dir)).select(*KEYS, R.finding_key(*map(F.col, KEYS)).alias("finding_key"))


@query("cmp20_incremental_plan", f"""WITH {PARAMS_SQL}, own AS (SELECT p_brand code, CASE CAST(substr(p_brand, 7) AS INT) % 3 WHEN 1 THEN 'PD' WHEN 2 THEN 'RD' ELSE 'ID' END stage, p_size || ' ' || p_type mark FROM part),
  changed AS (SELECT DISTINCT CASE l_linenumber % 3 WHEN 1 THEN 'PD' WHEN 2 THEN 'RD' ELSE 'ID' END stage, p_size || ' ' || p_type mark FROM lineitem JOIN part ON l_partkey = p_partkey
    WHERE l_shipdate > (SELECT max(l_shipdate) FROM lineitem) - INTERVAL 20 DAY)
  SELECT DISTINCT code FROM own JOIN changed USING (stage, mark)""")
def cmp20(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the files of the last twenty days of shipping change."""
    t = Tables(spark, sf_dir)
    n = F.substring("p_brand", 7, 100).cast("int") % 3
    stage = lambda k: F.when(k == 1, "PD").when(k == 2, "RD").otherwise("ID")
    mark = F.concat_ws(" ", "p_size", "p_type")
    own = t.part.groupBy(F.col("p_brand").alias("code"), stage(n).alias("stage")).agg(F.collect_set(mark).alias("marks"))
    last = t.lineitem.agg(F.max("l_shipdate").alias("last"))
    lines = t.lineitem.join(F.broadcast(last), F.col("l_shipdate") > F.expr("last - INTERVAL 20 DAYS")).join(t.part, F.col("l_partkey") == F.col("p_partkey"))
    changed = lines.groupBy("l_orderkey", stage(F.col("l_linenumber") % 3).alias("stage")).agg(F.collect_set(mark).alias("marks"))
    return R.affected(own, changed)


@query("cmp23_carry_over", f"""{WITH_POINTS}, prev AS (SELECT object_id || '|' || param || '|' || rule_key key, (n % 2)::VARCHAR sig, 'D' || (n % 3) decision FROM points WHERE object_id % 3 <> 0),
  fresh AS (SELECT object_id || '|' || param || '|' || rule_key key, (n % 4)::VARCHAR sig FROM points WHERE object_id % 3 <> 1)
  SELECT f.key, f.sig, CASE WHEN p.sig = f.sig THEN p.decision END decision, coalesce(p.sig <> f.sig, false) evidence_changed, false carried FROM fresh f LEFT JOIN prev p USING (key)
  UNION ALL SELECT key, sig, decision, false, true FROM prev WHERE key NOT IN (SELECT key FROM fresh)""")
def cmp23(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = points(Tables(spark, sf_dir)).withColumn("key", F.concat_ws("|", *KEYS))
    prev = p.filter("object_id % 3 <> 0").select("key", (F.col("n") % 2).cast("string").alias("sig"), F.concat(F.lit("D"), F.col("n") % 3).alias("decision"))
    fresh = p.filter("object_id % 3 <> 1").select("key", (F.col("n") % 4).cast("string").alias("sig"), F.lit(None).cast("string").alias("decision"))
    return carried_over(prev, fresh, "key", "sig", "decision").select("key", "sig", "decision", "evidence_changed", "carried")


@query("cmp01_revision_roles", """WITH f AS (SELECT l_orderkey, l_linenumber, CASE WHEN l_returnflag = 'A' THEN true WHEN l_returnflag = 'R' THEN false END auth, l_linestatus = 'F' approved FROM lineitem),
  g AS (SELECT *, count(*) FILTER (auth) OVER w na, count(*) FILTER (approved) OVER w np, count(*) OVER w n FROM f WINDOW w AS (PARTITION BY l_orderkey))
  SELECT l_orderkey, l_linenumber, CASE WHEN n = 1 THEN 'ACTUAL' WHEN na = 1 THEN CASE WHEN auth THEN 'ACTUAL' ELSE 'SUPERSEDED' END
    WHEN np = 1 THEN CASE WHEN approved THEN 'ACTUAL' ELSE 'SUPERSEDED' END ELSE 'CONFLICT' END "role",
    CASE WHEN n = 1 THEN 'single' WHEN na = 1 THEN 'authoritative' WHEN np = 1 THEN 'approved' ELSE 'ambiguous' END reason FROM g""")
def cmp01(spark: SparkSession, sf_dir: str) -> DataFrame:
    auth = F.when(F.col("l_returnflag") == "A", True).when(F.col("l_returnflag") == "R", False)
    files = Tables(spark, sf_dir).lineitem.select("l_orderkey", "l_linenumber", auth.alias("auth"), (F.col("l_linestatus") == "F").alias("approved"))
    return R.revision_roles(files, ["l_orderkey"], "auth", "approved").select("l_orderkey", "l_linenumber", "role", "reason")


@query("agg09_ambiguous_revisions", """SELECT l_orderkey, count(*) files, count(*) FILTER (l_linestatus = 'F') approved FROM lineitem GROUP BY 1
  HAVING count(*) >= 2 AND count(*) FILTER (l_linestatus = 'F') <> 1 AND count(*) FILTER (l_returnflag = 'A') <> 1""")
def agg09(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = Tables(spark, sf_dir).lineitem.select("l_orderkey", (F.col("l_returnflag") == "A").alias("auth"), (F.col("l_linestatus") == "F").alias("approved"))
    found = R.revision_roles(files, ["l_orderkey"], "auth", "approved").filter("role = 'CONFLICT'")
    return found.groupBy("l_orderkey").agg(F.count("*").alias("files"), F.count_if("approved").alias("approved"))


@query("agg11_scenario", """WITH s AS (SELECT l_orderkey, bool_or(l_linenumber % 3 = 1) pd, bool_or(l_linenumber % 3 = 2) rd, bool_or(l_linenumber % 3 = 0) idd FROM lineitem GROUP BY 1)
  SELECT l_orderkey, CASE WHEN pd AND rd AND idd THEN 'FULL' WHEN pd AND rd THEN 'PD_RD_ONLY' WHEN pd AND idd THEN 'PD_ID_ONLY' WHEN rd AND idd THEN 'RD_ID_ONLY' ELSE 'SINGLE_ONLY' END scenario FROM s""")
def agg11(spark: SparkSession, sf_dir: str) -> DataFrame:
    has = lambda k: F.bool_or(F.col("l_linenumber") % 3 == k)
    by = Tables(spark, sf_dir).lineitem.groupBy("l_orderkey").agg(has(1).alias("pd"), has(2).alias("rd"), has(0).alias("id"))
    return by.select("l_orderkey", R.scenario(F.col("pd"), F.col("rd"), F.col("id")).alias("scenario"))


@query("agg20_coverage", f"""WITH {EXTRACTIONS_SQL} SELECT l_orderkey document, count(*) "values", count(DISTINCT rule_key) keys, count(*) FILTER (bad) suspicious,
  array_to_string(list_sort(list(value))[1:3], ',') samples FROM (SELECT l_orderkey, rule_key, bad, value::INT value FROM ext) GROUP BY 1""")
def agg20(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = extractions(Tables(spark, sf_dir))
    samples = F.array_join(F.slice(F.array_sort(F.collect_list(F.col("value").cast("int"))), 1, 3).cast("array<string>"), ",")
    return e.groupBy(F.col("l_orderkey").alias("document")).agg(F.count("*").alias("values"), F.count_distinct("rule_key").alias("keys"), F.count_if("bad").alias("suspicious"), samples.alias("samples"))


@query("agg21_coverage_summary", f"""WITH {EXTRACTIONS_SQL}, d AS (SELECT DISTINCT param, stage, object_id FROM ext),
  s AS (SELECT param, count(DISTINCT object_id) FILTER (stage='PD') pd, count(DISTINCT object_id) FILTER (stage='RD') rd, count(DISTINCT object_id) FILTER (stage='ID') idd FROM d GROUP BY 1),
  b AS (SELECT param, count(*) both_stages FROM (SELECT param, object_id FROM d WHERE stage IN ('PD','RD') GROUP BY ALL HAVING count(*) = 2) GROUP BY 1)
  SELECT param, pd, rd, idd id_objects, coalesce(both_stages, 0) both_stages FROM s LEFT JOIN b USING (param)""")
def agg21(spark: SparkSession, sf_dir: str) -> DataFrame:
    by = extractions(Tables(spark, sf_dir)).groupBy("param", "object_id").agg(*(F.bool_or(F.col("stage") == s).alias(s) for s in R.STAGES))
    return by.groupBy("param").agg(F.count_if("PD").alias("pd"), F.count_if("RD").alias("rd"), F.count_if("ID").alias("id_objects"), F.count_if(F.col("PD") & F.col("RD")).alias("both_stages"))


@query("agg21_not_found", f"""WITH {PARAMS_SQL}, {EXTRACTIONS_SQL} SELECT s_suppkey object_id, code param FROM supplier, params WHERE NOT EXISTS (SELECT 1 FROM ext WHERE object_id = s_suppkey AND param = code AND stage = 'PD' AND value > 45)""")
def agg21_not_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = Tables(spark, sf_dir)
    want = t.supplier.select(F.col("s_suppkey").alias("object_id")).crossJoin(params(t).select(F.col("code").alias("param")))
    return want.join(extractions(t).filter("stage = 'PD' AND value > 45"), ["object_id", "param"], "left_anti")


@query("agg22_shared_values", f"WITH {EXTRACTIONS_SQL} SELECT l_orderkey, value, count(DISTINCT param) params FROM ext GROUP BY 1, 2 HAVING count(DISTINCT param) >= 3")
def agg22(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extractions(Tables(spark, sf_dir)).groupBy("l_orderkey", "value").agg(F.count_distinct("param").alias("params")).filter("params >= 3")


@query("agg33_evidence_signature", "SELECT l_orderkey, string_agg(l_partkey || ':' || l_linenumber, '|' ORDER BY l_partkey || ':' || l_linenumber) signature FROM lineitem GROUP BY 1")
def agg33(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = F.array_sort(F.collect_list(F.concat_ws(":", "l_partkey", "l_linenumber")))
    return Tables(spark, sf_dir).lineitem.groupBy("l_orderkey").agg(F.array_join(parts, "|").alias("signature"))


@query("agg34_manifest_hash", "SELECT o_custkey, sha256(string_agg(h, chr(10) ORDER BY h)) manifest FROM (SELECT o_custkey, sha256(o_orderkey::VARCHAR) h FROM orders) GROUP BY 1")
def agg34(spark: SparkSession, sf_dir: str) -> DataFrame:
    hashes = F.array_sort(F.collect_list(F.sha2(F.col("o_orderkey").cast("string"), 256)))
    return Tables(spark, sf_dir).orders.groupBy("o_custkey").agg(F.sha2(F.array_join(hashes, "\n"), 256).alias("manifest"))


@query("cmp32_split_assignment", """SELECT c_custkey, CASE WHEN x < 0.7 THEN 'TRAIN' WHEN x < 0.85 THEN 'VALIDATION' ELSE 'HIDDEN_TEST' END split
  FROM (SELECT c_custkey, ('0x' || substr(sha256(c_name), 1, 8))::BIGINT / 4294967296.0 x FROM customer)""")
def cmp32(spark: SparkSession, sf_dir: str) -> DataFrame:
    from stagewise.operators.learning import split_of

    return Tables(spark, sf_dir).customer.select("c_custkey", split_of(F.col("c_name")).alias("split"))


@query("flt11_own_section", f"""WITH {EXTRACTIONS_SQL}, h AS (SELECT *, value > 40 hit FROM ext), a AS (SELECT *, bool_or(hit) OVER (PARTITION BY object_id, param, stage) any_hit FROM h)
  SELECT object_id, param, stage, l_orderkey, l_linenumber FROM a WHERE hit OR NOT any_hit""")
def flt11(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = extractions(Tables(spark, sf_dir)).withColumn("hit", F.col("value") > 40)
    rows = rows.withColumn("any_hit", F.bool_or("hit").over(Window.partitionBy("object_id", "param", "stage")))
    return rows.filter("hit OR NOT any_hit").select("object_id", "param", "stage", "l_orderkey", "l_linenumber")


@query("win07_extremum_per_key", f"""WITH {EXTRACTIONS_SQL} SELECT object_id, param, stage, arg_min(value, value * 1000000000 + l_orderkey * 10 + l_linenumber) thinnest, arg_min(l_orderkey, value * 1000000000 + l_orderkey * 10 + l_linenumber) at_order FROM ext GROUP BY 1, 2, 3""")
def win07(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = extractions(Tables(spark, sf_dir))
    least = F.min(F.struct("value", "l_orderkey", "l_linenumber"))
    return rows.groupBy("object_id", "param", "stage").agg(least.alias("x")).select("object_id", "param", "stage", F.col("x.value").alias("thinnest"), F.col("x.l_orderkey").alias("at_order"))


@query("win06_first_by_position", f"""WITH {EXTRACTIONS_SQL} SELECT object_id, param, rule_key, value FROM ext QUALIFY row_number() OVER (PARTITION BY object_id, param, rule_key ORDER BY l_orderkey, l_linenumber) = 1""")
def win06(spark: SparkSession, sf_dir: str) -> DataFrame:
    return first_per_group(extractions(Tables(spark, sf_dir)), KEYS, ["l_orderkey", "l_linenumber"]).select(*KEYS, "value")
