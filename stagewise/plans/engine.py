"""The whole comparison over the test tables: kinds of values, revisions, presence, extraction order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stagewise.operators import engine as E

from .registry import Tables, query

# One parameter for each brand; its number picks the kind of value, the stages and the trigger.
MATRIX_SQL = """m AS (SELECT code, n, CASE WHEN n % 6 <> 5 THEN ['number','enum','boolean','string'][n % 4 + 1] ELSE 'string' END data_type, CASE WHEN n % 6 = 5 THEN CASE WHEN n % 12 = 5 THEN 'any' ELSE 'lost' END END codes, CASE WHEN n % 8 = 7 THEN ['m1', 'm2'] END own,
  CASE n % 3 WHEN 0 THEN ['PD','RD','ID'] WHEN 1 THEN ['PD','RD'] ELSE ['RD','ID'] END stages,
  CASE n % 5 WHEN 2 THEN 'down' WHEN 3 THEN 'up' ELSE 'any' END direction, n % 7 <> 6 parsed,
  CASE WHEN n % 5 = 0 THEN 10.0::DOUBLE END percent, CASE WHEN n % 5 = 1 THEN 0.5::DOUBLE END absolute, CASE WHEN n % 5 = 4 THEN 30.0::DOUBLE END below
  FROM (SELECT DISTINCT p_brand code, CAST(substr(p_brand, 7) AS INT) n FROM part))"""
VALUES_SQL = """x AS (SELECT l_suppkey object_id, p_brand param, CASE WHEN p_size % 11 <> 0 THEN p_size % 5 END point,
  CASE WHEN l_linenumber % 3 = 1 THEN 'PD' WHEN l_linenumber % 3 = 2 OR l_suppkey % 7 = 0 THEN 'RD' ELSE 'ID' END stage,
  l_orderkey * 10 + l_linenumber pos, l_quantity num, CASE WHEN CAST(substr(p_brand, 7) AS INT) % 6 = 5 THEN ['П1, B2','П1,В2.1','П1','ПЕ, В2','ПЕ3, В2','В2, П1','нет'][l_partkey % 7 + 1] ELSE ['AIR','FOB','MAIL','RAIL','REG AIR','SHIP','TRUCK'][l_partkey % 7 + 1] END str, l_linestatus = 'F' flag,
  CASE WHEN l_suppkey % 3 = 0 THEN 'мм' WHEN l_suppkey % 3 = 1 THEN 'см' END unit, l_linenumber % 2 places,
  l_returnflag = 'A' AND l_quantity > 48 bad, l_orderkey % 97 = 0 conflict FROM lineitem JOIN part ON l_partkey = p_partkey)"""
PRESENT_SQL = "present AS (SELECT object_id, list(DISTINCT stage) present, CASE WHEN object_id % 10 <> 0 THEN ['m' || (object_id % 4)] END marks FROM x GROUP BY 1)"


def listed_sql(text: str) -> str:
    """The codes of a text, or null."""
    codes = f"list_transform(string_split({text}, ','), lambda z: translate(replace(z, ' ', ''), 'BE', 'ВЕ'))"
    return f"CASE WHEN {text} <> 'нет' THEN {codes} END"


def absent_sql(own: str, other: str) -> str:
    bare = lambda x, y: f"({x} IN ('ВЕ', 'ПЕ') AND regexp_full_match({y}, {x} || '[0-9]+([.][0-9]+)*'))"
    like = f"(starts_with(q, o || '.') OR starts_with(o, q || '.') OR {bare('q', 'o')} OR {bare('o', 'q')})"
    return f"list_filter({own}, lambda q: NOT list_contains({other}, q) AND len(list_filter({other}, lambda o: {like} AND NOT list_contains({own}, o))) = 0)"


ABSENT = {"lost": absent_sql("ec", "ac"), "added": absent_sql("ac", "ec")}
# The comparison written a second time, value by value.
OUTCOMES_SQL = f"""WITH {MATRIX_SQL}, {VALUES_SQL}, {PRESENT_SQL},
  shown AS (SELECT x.*, m.*, CASE data_type WHEN 'number' THEN printf('%.1f', num) WHEN 'boolean' THEN CASE WHEN flag THEN 'F' ELSE 'O' END ELSE str END shown FROM x JOIN m ON param = code WHERE list_contains(stages, stage)),
  s AS (SELECT object_id, param, point, stage, count(DISTINCT shown) kinds, min(pos) pos, arg_min({{'num': num, 'str': str, 'shown': shown, 'flag': flag, 'unit': unit, 'places': places}}, pos) v FROM shown GROUP BY ALL),
  pt AS (SELECT object_id, param, point, bool_or(bad) bad, bool_or(conflict) conflict FROM shown GROUP BY ALL),
  pairs AS (SELECT a.object_id, a.param, a.point, a.stage, a.pos, a.v.num - e.v.num delta, m.*, e.v IS NULL no_e, a.v.num an, e.v.num en, list_position(['AIR','FOB','MAIL','RAIL','REG AIR','SHIP'], a.v.str) ai,
      list_position(['AIR','FOB','MAIL','RAIL','REG AIR','SHIP'], e.v.str) ei, a.v.flag af, e.v.flag ef, a.v.str atext, e.v.str etext, a.v.shown ashown, e.v.shown eshown, {listed_sql('a.v.str')} ac, {listed_sql('e.v.str')} ec,
      0.5 / 10 ** least(a.v.places, e.v.places) tolerance, CASE coalesce(a.v.unit, e.v.unit) WHEN 'мм' THEN 10.0 ELSE 1.0 END factor
    FROM s a JOIN m ON a.param = m.code LEFT JOIN s e ON e.object_id = a.object_id AND e.param = a.param AND e.point IS NOT DISTINCT FROM a.point AND e.stage = stages[1] WHERE a.stage <> stages[1]),
  sets AS (SELECT *, {ABSENT['lost']} lost, {ABSENT['added']} added FROM pairs),
  hits AS (SELECT *, CASE WHEN codes IS NOT NULL AND ac IS NOT NULL AND ec IS NOT NULL THEN len(lost) > 0 OR (codes = 'any' AND len(added) > 0) ELSE CASE data_type
      WHEN 'number' THEN CASE WHEN NOT parsed THEN NULL WHEN below IS NOT NULL THEN an < below * factor - 1e-9 WHEN no_e THEN NULL WHEN abs(an - en) <= tolerance + 1e-9 THEN false
        WHEN (direction = 'down' AND an > en) OR (direction = 'up' AND an < en) THEN false WHEN percent IS NOT NULL THEN abs(an - en) / abs(en) * 100 > percent + 1e-9
        WHEN absolute IS NOT NULL THEN abs(an - en) > absolute * factor + 1e-9 ELSE true END
      WHEN 'enum' THEN CASE WHEN no_e OR NOT parsed OR ai IS NULL OR ei IS NULL THEN NULL ELSE ai <> ei AND NOT (direction = 'down' AND ai > ei) AND NOT (direction = 'up' AND ai < ei) END
      WHEN 'boolean' THEN CASE WHEN no_e THEN NULL ELSE ef <> af AND NOT (direction = 'down' AND af) AND NOT (direction = 'up' AND NOT af) END
      ELSE CASE WHEN no_e THEN NULL ELSE atext <> etext END END END hit,
      CASE WHEN codes IS NOT NULL THEN nullif(concat_ws('; ', nullif(array_to_string(list_transform(lost, lambda z: '−' || z), ', '), ''), nullif(array_to_string(list_transform(added, lambda z: '+' || z), ', '), '')), '') END changed FROM sets),
  h AS (SELECT object_id, param, point, count(*) actuals, bool_or(hit IS NULL) unlike, bool_or(hit) any_hit, coalesce(arg_min({{'stage': stage, 'shown': ashown, 'changed': changed}}, pos) FILTER (hit), arg_min({{'stage': stage, 'shown': ashown, 'changed': changed}}, pos)) c, min(eshown) eshown,
      string_agg(stage || '=' || ashown || CASE WHEN hit THEN '!' ELSE '' END, ' ' ORDER BY list_position(['PD','RD','ID'], stage)) compared,
      CASE WHEN bool_or(hit) THEN arg_min(delta, pos) FILTER (hit) ELSE arg_min(delta, pos) END delta FROM hits GROUP BY ALL),
  ek AS (SELECT object_id, param, point, max(kinds) kinds, bool_or(stage = stages[1]) has_e FROM s JOIN m ON param = code GROUP BY ALL),
  pl AS (SELECT object_id, param, bool_or(point IS NOT NULL) placed FROM shown GROUP BY ALL),
  v AS (SELECT pt.object_id, pt.param, pt.point, CASE WHEN own IS NOT NULL AND marks IS NOT NULL AND NOT list_has_any(own, marks) THEN 'NOT_APPLICABLE' WHEN conflict THEN 'CLARIFICATION_REQUIRED' WHEN bad THEN 'NOT_COMPARABLE'
      WHEN NOT has_e AND below IS NULL THEN CASE WHEN list_contains(present, stages[1]) THEN 'NOT_COMPARABLE' ELSE 'MISSING_EVIDENCE' END
      WHEN actuals IS NULL THEN CASE WHEN list_has_any(present, stages[2:]) THEN 'NOT_COMPARABLE' ELSE 'MISSING_EVIDENCE' END
      WHEN pt.point IS NULL AND placed AND actuals + has_e::INT > 1 THEN 'CLARIFICATION_REQUIRED' WHEN kinds > 1 THEN 'CLARIFICATION_REQUIRED' WHEN unlike THEN 'NOT_COMPARABLE' WHEN any_hit THEN 'CANDIDATE' ELSE 'NEGATIVE_VERIFIED' END verdict, h.c.stage actual_stage, h.c.shown actual, h.c.changed, h.eshown expected, h.compared, h.delta
    FROM pt JOIN m ON pt.param = code JOIN present USING (object_id) JOIN pl ON pl.object_id = pt.object_id AND pl.param = pt.param JOIN ek ON ek.object_id = pt.object_id AND ek.param = pt.param AND ek.point IS NOT DISTINCT FROM pt.point
    LEFT JOIN h ON h.object_id = pt.object_id AND h.param = pt.param AND h.point IS NOT DISTINCT FROM pt.point)"""
MODES = ("AIR", "FOB", "MAIL", "RAIL", "REG AIR", "SHIP", "TRUCK")
SCALE = MODES[:-1]


SYSTEMS = ("П1, B2", "П1,В2.1", "П1", "ПЕ, В2", "ПЕ3, В2", "В2, П1", "нет")


def mode() -> Column:
    return F.element_at(F.array(*map(F.lit, MODES)), (F.col("l_partkey") % 7 + 1).cast("int"))


def matrix(t: Tables) -> DataFrame:
    n = F.col("n")
    pick = lambda k, *cases: F.element_at(F.array(*cases), (n % k + 1).cast("int"))
    stages = lambda *s: F.array(*map(F.lit, s))
    return t.part.select(F.col("p_brand").alias("code"), F.substring("p_brand", 7, 100).cast("int").alias("n")).distinct().select(
        "code", F.when(n % 6 != 5, pick(4, *map(F.lit, ("number", "enum", "boolean", "string")))).otherwise("string").alias("data_type"), F.when(n % 12 == 5, "any").when(n % 6 == 5, "lost").alias("codes"),
        F.when(n % 8 == 7, F.array(F.lit("m1"), F.lit("m2"))).alias("own"), pick(3, stages("PD", "RD", "ID"), stages("PD", "RD"), stages("RD", "ID")).alias("stages"),
        F.when(n % 5 == 2, "down").when(n % 5 == 3, "up").otherwise("any").alias("direction"), (n % 7 != 6).alias("parsed"), F.when(n % 5 == 0, 10.0).alias("percent"),
        F.when(n % 5 == 1, 0.5).alias("absolute"), F.when(n % 5 == 4, 30.0).alias("below"), F.lit(None).cast("double").alias("above"), F.lit("см").alias("trigger_unit"),
        F.lit(None).cast("string").alias("unit"), F.array(*map(F.lit, SCALE)).alias("scale"),
    )


def values(t: Tables) -> DataFrame:
    n = F.substring("p_brand", 7, 100).cast("int")
    line, kind = F.col("l_linenumber"), F.when(n % 6 != 5, n % 4).otherwise(3)
    text = F.when(n % 6 != 5, mode()).otherwise(F.element_at(F.array(*map(F.lit, SYSTEMS)), (F.col("l_partkey") % 7 + 1).cast("int")))
    stage = F.when(line % 3 == 1, "PD").when((line % 3 == 2) | (F.col("l_suppkey") % 7 == 0), "RD").otherwise("ID")
    shown = F.when(kind == 0, F.format_string("%.1f", F.col("l_quantity").cast("double"))).when(kind == 2, F.col("l_linestatus")).otherwise(text)
    return t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey")).select(
        F.col("l_suppkey").alias("object_id"), F.col("p_brand").alias("param"), F.when(F.col("p_size") % 11 != 0, F.col("p_size") % 5).alias("point"), stage.alias("stage"),
        (F.col("l_orderkey") * 10 + line).alias("pos"), shown.alias("shown"), F.when(kind == 0, F.col("l_quantity").cast("double")).alias("num"), text.alias("str"),
        (F.col("l_linestatus") == "F").alias("flag"), F.lit(None).cast("array<double>").alias("coords"),
        F.when(F.col("l_suppkey") % 3 == 0, "мм").when(F.col("l_suppkey") % 3 == 1, "см").alias("unit"), (line % 2).alias("places"),
        ((F.col("l_returnflag") == "A") & (F.col("l_quantity") > 48)).alias("bad"), (F.col("l_orderkey") % 97 == 0).alias("conflict"),
    )


def presence(x: DataFrame) -> DataFrame:
    by = x.groupBy("object_id").agg(F.collect_set("stage").alias("present"))
    return by.withColumn("marks", F.when(F.col("object_id") % 10 != 0, F.array(F.concat(F.lit("m"), (F.col("object_id") % 4).cast("string")))))


def found(t: Tables) -> DataFrame:
    x = values(t)
    return E.outcomes(x, matrix(t), presence(x))


@query("cmp07_outcomes", f"{OUTCOMES_SQL} SELECT object_id, param, point, verdict, CASE WHEN verdict IN ('CANDIDATE','NEGATIVE_VERIFIED') THEN 'COMPLETE' ELSE verdict END completeness FROM v")
def cmp07_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All six outcomes occur: applicability by marks, the guard of values without a place, sets, numbers, scales, flags, texts."""
    return found(Tables(spark, sf_dir)).select("object_id", "param", "point", "verdict", "completeness")


@query("cmp07_compared_values", f"""{OUTCOMES_SQL} SELECT v.object_id, v.param, v.point, v.expected, v.actual, v.changed, v.compared FROM v WHERE verdict IN ('CANDIDATE','NEGATIVE_VERIFIED')""")
def cmp07_compared(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What was held against what: the pair shown, the systems lost and added, and one comparison for each stage."""
    rows = found(Tables(spark, sf_dir)).filter("completeness = 'COMPLETE'")
    compared = F.array_join(F.transform("comparisons", lambda c: F.concat(c["stage"], F.lit("="), c["value"], F.when(c["triggered"], "!").otherwise(""))), " ")
    return rows.select("object_id", "param", "point", "expected", "actual", "changed", compared.alias("compared"))


@query("cmp14_system_sets", f"""WITH {MATRIX_SQL}, {VALUES_SQL}, t AS (SELECT DISTINCT str FROM x JOIN m ON code = param WHERE codes IS NOT NULL AND str <> 'нет'), c AS (SELECT a.str e, b.str a, {listed_sql('a.str')} ec, {listed_sql('b.str')} ac FROM t a JOIN t b ON true)
  SELECT e, a, len({ABSENT['lost']}) > 0 lost_any, len({ABSENT['lost']}) + len({ABSENT['added']}) > 0 changed_any FROM c""")
def cmp14_systems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every two sets of systems that occur, by the two rules: only losses count, or any change."""
    from stagewise.operators import reconcile as R

    t = Tables(spark, sf_dir)
    texts = values(t).join(matrix(t).filter("codes IS NOT NULL").select(F.col("code").alias("param")), "param").filter("str <> 'нет'").select("str").distinct()
    pairs = texts.withColumnRenamed("str", "e").crossJoin(F.broadcast(texts.withColumnRenamed("str", "a")))  # the seven texts of SYSTEMS
    lists = [R.code_list(F.col(c)) for c in "ea"]
    return pairs.select("e", "a", R.codes_hit(*lists, F.lit("lost")).alias("lost_any"), R.codes_hit(*lists, F.lit("any")).alias("changed_any"))


@query("cmp08_pair_in_extraction_order", f"""{OUTCOMES_SQL} SELECT v.object_id, v.param, v.point, v.actual_stage, CASE WHEN data_type = 'number' THEN v.delta END delta FROM v JOIN m ON param = code
  WHERE verdict IN ('CANDIDATE','NEGATIVE_VERIFIED')""")
def cmp08_pair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return found(Tables(spark, sf_dir)).filter("completeness = 'COMPLETE'").select("object_id", "param", "point", "actual_stage", "delta")


@query("agg01_outcome_counters", f"""{OUTCOMES_SQL} SELECT count(DISTINCT param) params, count(*) checks, count(*) FILTER (verdict='CANDIDATE') candidates, count(*) FILTER (verdict='NEGATIVE_VERIFIED') negatives,
  count(*) FILTER (verdict='MISSING_EVIDENCE') missing, count(*) FILTER (verdict='NOT_COMPARABLE') not_comparable, count(*) FILTER (verdict='CLARIFICATION_REQUIRED') clarifications, count(*) FILTER (verdict='NOT_APPLICABLE') not_applicable FROM v""")
def agg01_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    from stagewise.operators.reconcile import counters

    return counters(found(Tables(spark, sf_dir)))


@query("cmp05_missing_verdicts", f"""WITH {MATRIX_SQL}, {VALUES_SQL}, {PRESENT_SQL}, grid AS (SELECT s_suppkey object_id, code, stages FROM supplier, m)
  SELECT object_id, code param, CASE WHEN len(list_filter(stages, lambda z: NOT coalesce(list_contains(present, z), false))) > 0 THEN 'MISSING_EVIDENCE' ELSE 'NOT_COMPARABLE' END verdict
  FROM grid LEFT JOIN present USING (object_id) WHERE NOT EXISTS (SELECT 1 FROM x WHERE x.object_id = grid.object_id AND x.param = grid.code AND x.flag AND list_contains(grid.stages, x.stage))""")
def cmp05_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = Tables(spark, sf_dir)
    x = values(t)
    grid = t.supplier.select(F.col("s_suppkey").alias("object_id")).crossJoin(F.broadcast(matrix(t).select(F.col("code").alias("param"), "stages")))  # objects x a matrix of fixed size
    return E.missing_outcomes(grid, x.filter("flag"), presence(x))


FILES_SQL = """f AS (SELECT l_orderkey owner, l_linenumber file_id, CASE WHEN l_linenumber < 7 THEN ['PD','RD'][l_partkey % 2 + 1] END stage, CASE WHEN l_suppkey % 5 > 0 THEN 'd_' || (l_suppkey % 2) END document_code,
  ['APPROVED','SUPERSEDED','UNKNOWN','CANCELLED','FOR_CONSTRUCTION','UNKNOWN','UNKNOWN'][l_quantity::INT % 7 + 1] approval,
  CASE WHEN l_returnflag = 'A' AND l_quantity > 20 THEN true WHEN l_returnflag = 'R' AND l_quantity > 40 THEN false END authoritative, CASE WHEN l_partkey % 7 = 2 AND l_quantity > 30 THEN 'listed as void' END excluded,
  CASE WHEN l_partkey % 7 = 3 THEN l_linenumber - 1 END predecessor_id, CASE WHEN l_partkey % 7 = 6 AND l_quantity > 35 THEN l_linenumber + 1 END successor_id FROM lineitem),
  early AS (SELECT *, CASE WHEN stage IS NULL THEN 'UNRESOLVED' WHEN NOT authoritative THEN 'SUPERSEDED' WHEN authoritative IS NULL AND (excluded IS NOT NULL OR approval IN ('SUPERSEDED','CANCELLED')) THEN 'SUPERSEDED'
    WHEN NOT coalesce(authoritative, false) AND (EXISTS (SELECT 1 FROM f g WHERE g.owner = f.owner AND g.predecessor_id = f.file_id) OR EXISTS (SELECT 1 FROM f g JOIN f h ON h.owner = g.owner AND g.file_id = h.successor_id WHERE h.owner = f.owner AND h.file_id = f.file_id)) THEN 'SUPERSEDED' END gone FROM f),
  g AS (SELECT owner, stage, document_code, count(*) n, count(*) FILTER (authoritative) na, count(*) FILTER (approval IN ('APPROVED','FOR_CONSTRUCTION')) np FROM early WHERE gone IS NULL AND document_code IS NOT NULL GROUP BY ALL)"""


def files(t: Tables) -> DataFrame:
    q, kind, flag, line = F.col("l_quantity"), F.col("l_partkey") % 7, F.col("l_returnflag"), F.col("l_linenumber")
    pick = lambda cases, at: F.element_at(F.array(*map(F.lit, cases)), (at + 1).cast("int"))
    return t.lineitem.select(
        F.col("l_orderkey").alias("owner"), line.alias("file_id"), F.when(line < 7, pick(("PD", "RD"), F.col("l_partkey") % 2)).alias("stage"),
        F.when(F.col("l_suppkey") % 5 > 0, F.concat(F.lit("d_"), F.col("l_suppkey") % 2)).alias("document_code"),
        pick(("APPROVED", "SUPERSEDED", "UNKNOWN", "CANCELLED", "FOR_CONSTRUCTION", "UNKNOWN", "UNKNOWN"), q.cast("int") % 7).alias("approval"),
        F.when((flag == "A") & (q > 20), True).when((flag == "R") & (q > 40), False).alias("authoritative"), F.when((kind == 2) & (q > 30), "listed as void").alias("excluded"),
        F.when(kind == 3, line - 1).alias("predecessor_id"), F.when((kind == 6) & (q > 35), line + 1).alias("successor_id"),
    )


@query("cmp01_selected_files", f"""WITH {FILES_SQL} SELECT e.owner, file_id, coalesce(gone, CASE WHEN coalesce(n, 1) < 2 THEN 'ACTUAL' WHEN na = 1 THEN CASE WHEN authoritative THEN 'ACTUAL' ELSE 'SUPERSEDED' END
  WHEN np = 1 THEN CASE WHEN approval IN ('APPROVED','FOR_CONSTRUCTION') THEN 'ACTUAL' ELSE 'SUPERSEDED' END ELSE 'CONFLICT' END) "role" FROM early e LEFT JOIN g ON g.owner = e.owner AND g.stage = e.stage AND g.document_code = e.document_code""")
def cmp01_selected(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.selected_files(files(Tables(spark, sf_dir)), ["owner"]).select("owner", "file_id", "role")


@query("agg09_agg10_conflicts", f"WITH {FILES_SQL} SELECT owner, stage, upper(replace(document_code, '_', '-')) code, n files FROM g WHERE n >= 2 AND na <> 1 AND np <> 1")
def agg09_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.ambiguous_revisions(files(Tables(spark, sf_dir)), ["owner"])


@query("cmp16_delta_text", """SELECT p_partkey, printf('%+g', (p_size * 137 - 2500)::DOUBLE / 8) || CASE WHEN p_size % 3 > 0 THEN printf(' (%+.2f %%)', (p_size * 137 - 2500)::DOUBLE / 8 / (p_size % 3 * 40) * 100) ELSE '' END delta FROM part""")
def cmp16_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    diff, base = (F.col("p_size") * 137 - 2500).cast("double") / 8, (F.col("p_size") % 3 * 40).cast("double")
    return Tables(spark, sf_dir).part.select("p_partkey", E.signed_delta(diff, base).alias("delta"))


VERSION_SQL = """p AS (SELECT o_orderkey::VARCHAR k, NULL::VARCHAR parent, o_orderpriority param, o_orderstatus sig, CASE WHEN o_orderkey % 2 = 0 THEN 'CONFIRM' END decision FROM orders WHERE o_orderkey % 3 <> 0),
  c AS (SELECT k || '#a' k, k parent, param, sig, 'REJECT' decision FROM p WHERE sig = 'P'), before AS (SELECT * FROM p UNION ALL SELECT * FROM c),
  f AS (SELECT o_orderkey::VARCHAR k, NULL::VARCHAR parent, o_orderpriority param, CASE WHEN o_orderkey % 5 = 0 THEN 'X' ELSE o_orderstatus END sig FROM orders WHERE o_orderkey % 3 <> 1 AND o_orderpriority IN ('1-URGENT', '3-MEDIUM'))"""


@query("join25_next_version", f"""WITH {VERSION_SQL}, m AS (SELECT f.k, f.parent, f.param, f.sig, CASE WHEN p.sig = f.sig THEN p.decision END decision, CASE WHEN p.sig = f.sig THEN 'same' WHEN p.sig IS NOT NULL THEN 'changed' ELSE 'new' END origin FROM f LEFT JOIN p USING (k))
  SELECT *, 'carried' origin FROM before WHERE param NOT IN ('1-URGENT', '3-MEDIUM') UNION ALL SELECT * FROM m UNION ALL SELECT c.*, 'same' FROM c WHERE parent IN (SELECT k FROM m WHERE origin = 'same')""")
def join25(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A second run of the checks of two priorities after new files came; children of split checks go along."""
    from stagewise.operators import decisions as D

    o = Tables(spark, sf_dir).orders
    n, key = F.col("o_orderkey"), F.col("o_orderkey").cast("string")
    none = F.lit(None).cast("string")
    p = o.filter(n % 3 != 0).select(key.alias("k"), none.alias("parent"), F.col("o_orderpriority").alias("param"), F.col("o_orderstatus").alias("sig"), F.when(n % 2 == 0, "CONFIRM").alias("decision"))
    c = p.filter("sig = 'P'").select(F.concat("k", F.lit("#a")).alias("k"), F.col("k").alias("parent"), "param", "sig", F.lit("REJECT").alias("decision"))
    urgent = F.col("o_orderpriority").isin("1-URGENT", "3-MEDIUM")
    f = o.filter((n % 3 != 1) & urgent).select(key.alias("k"), none.alias("parent"), F.col("o_orderpriority").alias("param"), F.when(n % 5 == 0, "X").otherwise(F.col("o_orderstatus")).alias("sig"), none.alias("decision"))
    affected = o.filter(urgent).select(F.col("o_orderpriority").alias("param"))
    return D.next_version(p.unionByName(c), f, affected, "k", "parent", "param", "sig", "decision")


@query("flt15_decidable", "SELECT o_orderkey FROM orders WHERE o_orderstatus IN ('F', 'P')")
def flt15(spark: SparkSession, sf_dir: str) -> DataFrame:
    from stagewise.operators import decisions as D

    return D.guarded(Tables(spark, sf_dir).orders.filter("o_orderstatus <> 'O'"), "o_orderstatus", ["F", "P"], "no decision can be taken").select("o_orderkey")
