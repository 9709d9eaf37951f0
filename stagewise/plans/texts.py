"""Scalar functions over the text tables, and the rule language over staged values."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stagewise.functions import rules, text, triggers

from .core import EXTRACTIONS_SQL, KEYS, extractions
from .registry import Tables, query


# Every kind of white space, as the pattern language of the SQL has no class for it.
SPACES = r"[\t-\r \x{0085}\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"


@query("str01_collapse", f"SELECT doc_id, trim(regexp_replace(translate(text, '{text.DASHES}', '{'-' * len(text.DASHES)}'), '{SPACES}', ' ', 'g')) collapsed FROM documents")
def str01(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Tables(spark, sf_dir).documents.select("doc_id", text.collapse(F.col("text")).alias("collapsed"))


@query("str03_lookalike", "SELECT p_partkey, translate(upper(p_name), 'АВЕКМНОРСТХУ', 'ABEKMHOPCTXY') k FROM part")
def str03(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Tables(spark, sf_dir).part.select("p_partkey", text.lookalike(F.col("p_name")).alias("k"))


@query("str04_norm_code", r"SELECT s_suppkey, replace(regexp_replace(upper(coalesce(s_name, '')), '[\s_]+', '-', 'g'), 'Ё', 'Е') code FROM supplier")
def str04(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Tables(spark, sf_dir).supplier.select("s_suppkey", text.norm_code(F.col("s_name")).alias("code"))


GAPS = r" \x{00A0}\x{2007}\x{2009}\x{202F}"


@query("str05_first_number", rf"""SELECT doc_id, try_cast(replace(regexp_replace(regexp_extract(replace(text, '−', '-'), '[-+]?\d{{1,3}}(?:[{GAPS}]\d{{3}})+(?:[.,]\d+)?|[-+]?\d+(?:[.,]\d+)?'), '[{GAPS}]', '', 'g'), ',', '.') AS DOUBLE) first_number FROM documents""")
def str05(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Tables(spark, sf_dir).documents.select("doc_id", text.number(F.col("text")).alias("first_number"))


@query("str07_decimals", "SELECT l_orderkey, l_linenumber, l_partkey, length(regexp_extract(l_extendedprice::VARCHAR, '[.,]([0-9]+)', 1)) places, length(regexp_extract(l_quantity::INT::VARCHAR, '[.,]([0-9]+)', 1)) whole FROM lineitem")
def str07(spark: SparkSession, sf_dir: str) -> DataFrame:
    price, whole = F.col("l_extendedprice").cast("decimal(18,6)").cast("string"), F.col("l_quantity").cast("int").cast("string")
    shown = F.regexp_replace(price, r"(\.\d+?)0+$", "$1")
    return Tables(spark, sf_dir).lineitem.select("l_orderkey", "l_linenumber", "l_partkey", text.decimals(shown).cast("long").alias("places"), text.decimals(whole).cast("long").alias("whole"))


@query("str13_shingles", r"""WITH w AS (SELECT doc_id, regexp_extract_all(lower(text), '\p{L}+') w FROM documents), s AS (SELECT DISTINCT doc_id, unnest(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i+3], ' '))) s FROM w) SELECT doc_id, count(*) shingles FROM s GROUP BY 1""")
def str13(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = F.regexp_extract_all(F.lower("text"), F.lit(r"\p{L}+"), F.lit(0))
    d = Tables(spark, sf_dir).documents.select("doc_id", words.alias("w"))
    return d.select("doc_id", F.size(F.array_distinct(text.shingles(F.col("w"), 4))).cast("long").alias("shingles")).filter("shingles > 0")


@query("str15_character_error", "SELECT p_partkey, levenshtein(p_name, p_type) distance, round(levenshtein(p_name, p_type) / greatest(length(p_name), 1), 4) cer FROM part")
def str15(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.levenshtein("p_name", "p_type")
    return Tables(spark, sf_dir).part.select("p_partkey", d.cast("long").alias("distance"), F.round(d / F.greatest(F.length("p_name"), F.lit(1)), 4).alias("cer"))


@query("str18_readable", r"""WITH c AS (SELECT doc_id, len(regexp_extract_all(text, '\p{L}')) l, len(regexp_extract_all(text, '\p{Cyrillic}')) c, len(regexp_extract_all(text, '\p{Latin}')) t FROM documents) SELECT doc_id, NOT (l >= 80 AND l - c - t > 0 AND c < 0.5 * l) readable FROM c""")
def str18(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Tables(spark, sf_dir).documents.select("doc_id", text.readable(F.col("text")).alias("readable"))


@query("str19_language", r"""WITH c AS (SELECT conv_id, turn, len(regexp_extract_all(text, '\p{Cyrillic}')) a, len(regexp_extract_all(text, '[A-Za-z]')) b FROM conversations) SELECT conv_id, turn, CASE WHEN a + b > 0 THEN CASE WHEN a >= 0.8 * (a + b) THEN 'ru' WHEN b >= 0.8 * (a + b) THEN 'en' ELSE 'mixed' END END language FROM c""")
def str19(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Tables(spark, sf_dir).conversations.select("conv_id", "turn", text.language(F.col("text")).alias("language"))


@query("str21_stage_from_name", "SELECT p_partkey, CASE WHEN regexp_matches(p_type, 'STEEL|BRASS') THEN 'PD' WHEN regexp_matches(p_type, 'COPPER') THEN 'RD' WHEN regexp_matches(p_type, 'TIN|NICKEL') THEN 'ID' END stage FROM part")
def str21(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Tables(spark, sf_dir).part.select("p_partkey", text.first_match(F.col("p_type"), [("STEEL|BRASS", "PD"), ("COPPER", "RD"), ("TIN|NICKEL", "ID")]).alias("stage"))


@query("str26_ungrounded_numbers_set03", r"""WITH n AS (SELECT d.doc_id, regexp_extract_all(d.text, '\d+(?:[.,]\d+)?') a, regexp_extract_all(coalesce(x.text, ''), '\d+(?:[.,]\d+)?') b FROM documents d LEFT JOIN documents x ON x.doc_id = d.doc_id + 1) SELECT doc_id, len(list_distinct(list_filter(a, lambda v: NOT list_contains(b, v)))) missing FROM n""")
def str26(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = Tables(spark, sf_dir).documents.select("doc_id", "text")
    x = d.select((F.col("doc_id") - 1).alias("doc_id"), F.col("text").alias("source"))
    return d.join(x, "doc_id", "left").select("doc_id", F.size(text.ungrounded(F.col("text"), [F.coalesce("source", F.lit(""))])).cast("long").alias("missing"))


@query("str30_excerpt", """WITH c AS (SELECT conv_id, turn, text, sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) - length(text) before FROM conversations) SELECT conv_id, turn, substr(text, 1, (300 - before)::BIGINT) part FROM c WHERE before < 300""")
def str30(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    w = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, 0)
    c = Tables(spark, sf_dir).conversations.withColumn("before", F.sum(F.length("text")).over(w) - F.length("text")).filter("before < 300")
    return c.select("conv_id", "turn", F.substring("text", F.lit(1), (F.lit(300) - F.col("before")).cast("int")).alias("part"))


@query("str33_elevation_marks", r"SELECT doc_id, len(list_distinct(regexp_extract_all(text, '[-+]\d+[.,]\d{3}'))) marks FROM documents")
def str33(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Tables(spark, sf_dir).documents.select("doc_id", F.size(text.elevation_marks(F.col("text"))).cast("long").alias("marks"))


@query("str23_dates_and_marks", r"""SELECT page_id, len(regexp_extract_all(html, '<a ')) links, lower(regexp_extract(url, 'https?://([^/?#]+)', 1)) host, regexp_extract(url, 'https?://[^/]+(/[^?#]*)', 1) path FROM pages""")
def str23(spark: SparkSession, sf_dir: str) -> DataFrame:
    host, path = F.lower(F.regexp_extract("url", r"https?://([^/?#]+)", 1)), F.regexp_extract("url", r"https?://[^/]+(/[^?#]*)", 1)
    return Tables(spark, sf_dir).pages.select("page_id", F.regexp_count("html", F.lit("<a ")).cast("long").alias("links"), host.alias("host"), path.alias("path"))


@query("src15_tag_strip", r"SELECT page_id, length(regexp_replace(regexp_replace(html, '<[^<>]*>', ' ', 'g'), '[ \t\n\r]+', ' ', 'g')) plain FROM pages")
def src15(spark: SparkSession, sf_dir: str) -> DataFrame:
    plain = F.regexp_replace(F.regexp_replace("html", "<[^<>]*>", " "), r"[ \t\n\r]+", " ")
    return Tables(spark, sf_dir).pages.select("page_id", F.length(plain).cast("long").alias("plain"))


@query("dat02_date_cascade", "SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') parsed FROM orders")
def dat02(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = F.col("o_orderdate").cast("date")
    form = F.when(F.col("o_orderkey") % 3 == 0, F.date_format(day, "yyyy-MM-dd")).when(F.col("o_orderkey") % 3 == 1, F.date_format(day, "d.M.yyyy")).otherwise(F.datediff(day, F.lit("1899-12-30").cast("date")).cast("string"))
    return Tables(spark, sf_dir).orders.select("o_orderkey", F.date_format(text.any_date(form), "yyyy-MM-dd").alias("parsed"))


@query("mth01_unit_conversion", """SELECT l_orderkey, l_linenumber, round(CASE l_linenumber % 3 WHEN 0 THEN l_quantity / 1000 WHEN 1 THEN l_quantity / 100 ELSE l_quantity END, 6) metres FROM lineitem""")
def mth01(spark: SparkSession, sf_dir: str) -> DataFrame:
    from stagewise.operators.reconcile import length_in

    unit = F.element_at(F.array(F.lit("мм"), F.lit("см"), F.lit("м")), F.col("l_linenumber") % 3 + 1)
    return Tables(spark, sf_dir).lineitem.select("l_orderkey", "l_linenumber", F.round(length_in(F.col("l_quantity"), unit, F.lit("м")), 6).alias("metres"))


BOX_SQL = "WITH b AS (SELECT l_orderkey k, l_linenumber n, l_quantity / 60 x0, l_tax * 5 y0, l_quantity / 60 + 0.2 x1, l_tax * 5 + 0.3 y1 FROM lineitem)"


def boxes(t: Tables) -> DataFrame:
    x, y = F.col("l_quantity") / 60, F.col("l_tax") * 5
    return t.lineitem.select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("n"), x.alias("x0"), y.alias("y0"), (x + 0.2).alias("x1"), (y + 0.3).alias("y1"))


@query("mth02_iou", f"""{BOX_SQL}, p AS (SELECT a.k, a.n, b.n m, greatest(least(a.x1, b.x1) - greatest(a.x0, b.x0), 0) * greatest(least(a.y1, b.y1) - greatest(a.y0, b.y0), 0) i, (a.x1 - a.x0) * (a.y1 - a.y0) s, (b.x1 - b.x0) * (b.y1 - b.y0) u FROM b a JOIN b ON a.k = b.k AND a.n < b.n)
  SELECT k, n, m, round(i / (s + u - i), 6) iou FROM p WHERE i > 0""")
def mth02(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = boxes(Tables(spark, sf_dir))
    c = b.select("k", F.col("n").alias("m"), *(F.col(x).alias(f"b_{x}") for x in ("x0", "y0", "x1", "y1")))
    one, two = [F.col(x) for x in ("x0", "y0", "x1", "y1")], [F.col(f"b_{x}") for x in ("x0", "y0", "x1", "y1")]
    return b.join(c, "k").filter("n < m").filter(text.overlap(one, two) > 0).select("k", "n", "m", F.round(text.iou(one, two), 6).alias("iou"))


@query("mth05_homography", "SELECT l_orderkey, l_linenumber, round((1.01 * l_quantity + 0.02 * l_tax + 3) / (0.001 * l_quantity + 0.002 * l_tax + 1), 6) x, round((0.03 * l_quantity + 0.98 * l_tax - 2) / (0.001 * l_quantity + 0.002 * l_tax + 1), 6) y FROM lineitem")
def mth05(spark: SparkSession, sf_dir: str) -> DataFrame:
    x, y = text.projected([1.01, 0.02, 3.0, 0.03, 0.98, -2.0, 0.001, 0.002, 1.0], F.col("l_quantity"), F.col("l_tax"))
    return Tables(spark, sf_dir).lineitem.select("l_orderkey", "l_linenumber", F.round(x, 6).alias("x"), F.round(y, 6).alias("y"))


@query("mth06_clamped_box", "SELECT l_orderkey, l_linenumber, round(greatest(0, least(1, (l_quantity - 10) / 30)), 6) x FROM lineitem")
def mth06(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Tables(spark, sf_dir).lineitem.select("l_orderkey", "l_linenumber", F.round(text.clamped(F.col("l_quantity") - 10, F.lit(30.0)), 6).alias("x"))


@query("map01_mean_confidence_agg37", "SELECT p_partkey, round((p_size / 50 + p_retailprice / 2000) / 2, 6) mean FROM part")
def map01(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = F.create_map(F.lit("size"), F.col("p_size") / 50, F.lit("price"), F.col("p_retailprice") / 2000)
    values = F.map_values(m)
    return Tables(spark, sf_dir).part.select("p_partkey", F.round(F.aggregate(values, F.lit(0.0), lambda a, x: a + x) / F.size(values), 6).alias("mean"))


@query("jsn01_json_default", "SELECT event_id, coalesce(try_cast(json_extract(props, '$.k') AS BIGINT), -1) k FROM events")
def jsn01(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Tables(spark, sf_dir).events.select("event_id", F.coalesce(F.from_json("props", "k BIGINT")["k"], F.lit(-1)).alias("k"))


@query("snk03_canonical_json", """SELECT o_orderkey, '{"key":' || o_orderkey || ',"priority":"' || o_orderpriority || '","status":"' || o_orderstatus || '"}' line FROM orders""")
def snk03(spark: SparkSession, sf_dir: str) -> DataFrame:
    row = F.struct(F.col("o_orderkey").alias("key"), F.col("o_orderpriority").alias("priority"), F.col("o_orderstatus").alias("status"))
    return Tables(spark, sf_dir).orders.select("o_orderkey", F.to_json(row).alias("line"))


#: Three rules over two brands, with their twins in SQL below.
RULES = [
    ("R1", "Brand#11.PD > 20 and exists(Brand#11.RD)", "Brand#11.RD >= Brand#11.PD"),
    ("R2", "exists(Brand#12.PD) or exists(Brand#12.ID)", "not missing(Brand#12.RD)"),
    ("R3", "Brand#13.PD != Brand#13.RD", "Brand#13.PD < 30 or Brand#13.RD < 30"),
]


@query("dsl05_rule_points", f"""WITH {EXTRACTIONS_SQL}, g AS (SELECT object_id, rule_key, param, stage, CASE WHEN min(value) = max(value) THEN min(value) END v FROM ext GROUP BY ALL),
  w AS (SELECT object_id, rule_key, max(v) FILTER (param='Brand#11' AND stage='PD') a, max(v) FILTER (param='Brand#11' AND stage='RD') b, max(v) FILTER (param='Brand#12' AND stage='PD') c, max(v) FILTER (param='Brand#12' AND stage='RD') d,
    max(v) FILTER (param='Brand#12' AND stage='ID') e, max(v) FILTER (param='Brand#13' AND stage='PD') f, max(v) FILTER (param='Brand#13' AND stage='RD') h FROM g GROUP BY 1, 2)
  SELECT object_id, rule_key, 'R1' rule FROM w WHERE a > 20 AND b IS NOT NULL AND (b >= a) = false UNION ALL SELECT object_id, rule_key, 'R2' FROM w WHERE (c IS NOT NULL OR e IS NOT NULL) AND d IS NULL
  UNION ALL SELECT object_id, rule_key, 'R3' FROM w WHERE f <> h AND (f < 30 OR h < 30) = false""")
def dsl05(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = extractions(Tables(spark, sf_dir))
    values = e.select("object_id", "rule_key", F.col("param").alias("code"), "stage", F.col("value").alias("num"), F.lit(None).cast("string").alias("str"), F.lit(None).cast("boolean").alias("bool"))
    return rules.fired(values, RULES, ["object_id", "rule_key"])


TRIGGERS = [
    ("T1", "Понижение класса", None, None), ("T2", "Дельта > 1%", None, None), ("T3", "Расхождение > 0.5 м", None, None), ("T4", "Ширина < 0.9 м", None, None),
    ("T5", "Увеличение", None, None), ("T6", "Высота менее 1.5-1.8 м", None, None), ("T7", "Прочее", 2.0, 5.0),
]


@query("cmp15_trigger_table", """SELECT * FROM (VALUES ('T1','down',true,NULL::DOUBLE,NULL::DOUBLE,NULL::DOUBLE,NULL::DOUBLE,NULL::VARCHAR), ('T2','any',true,1.0,NULL,NULL,NULL,NULL), ('T3','any',true,NULL,0.5,NULL,NULL,'м'), ('T4','any',true,NULL,NULL,0.9,NULL,'м'),
  ('T5','up',true,NULL,NULL,NULL,NULL,NULL), ('T6','any',true,NULL,NULL,1.5,NULL,'м'), ('T7','any',true,NULL,NULL,2.0,5.0,NULL)) t(code, direction, parsed, percent, absolute, below, above, unit)""")
def cmp15(spark: SparkSession, sf_dir: str) -> DataFrame:
    return triggers.trigger_table(spark, TRIGGERS)


@query("cmp18_rule_groups", r"SELECT p_partkey, trim(replace(regexp_replace(regexp_replace(lower(trim(regexp_replace(p_name || ' (' || p_size || '-' || p_partkey || ')', '\s+', ' ', 'g'))), '([0-9])\s*[-,/]\s*([0-9])', '\1.\2', 'g'), '\s*([()])\s*', ' \1', 'g'), ' )', ')')) g FROM part")
def cmp18(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.concat("p_name", F.lit(" ("), F.col("p_size").cast("string"), F.lit("-"), F.col("p_partkey").cast("string"), F.lit(")"))
    return Tables(spark, sf_dir).part.select("p_partkey", text.rule_group(label).alias("g"))


@query("agg35_parse_fingerprint", r"SELECT source, count(*) pages, sum(len(regexp_extract_all(text, '\n')) + 1)::BIGINT blocks, bit_xor(('0x' || substr(md5(text), 1, 15))::BIGINT) fingerprint FROM documents GROUP BY 1")
def agg35(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = F.conv(F.substring(F.md5(F.encode("text", "UTF-8")), 1, 15), 16, 10).cast("long")
    return Tables(spark, sf_dir).documents.groupBy("source").agg(F.count("*").alias("pages"), F.sum(F.regexp_count("text", F.lit("\n")) + 1).alias("blocks"), F.bit_xor(h).alias("fingerprint"))


@query("agg14_quality_rollup_ext15", """WITH q AS (SELECT *, CASE WHEN n_chars < 50 THEN 'ABSTAIN' WHEN n_chars < 300 THEN 'LOW_QUALITY' ELSE 'OK' END q, doc_id // 100 file FROM documents) SELECT file, count(*) pages, count(*) FILTER (q='LOW_QUALITY') low, count(*) FILTER (q='ABSTAIN') abstain,
  coalesce(string_agg(doc_id::VARCHAR, ',' ORDER BY doc_id) FILTER (q='LOW_QUALITY'), '') low_pages, round(avg(least(n_chars, 1000) / 1000), 6) confidence FROM q GROUP BY 1""")
def agg14(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = F.when(F.col("n_chars") < 50, "ABSTAIN").when(F.col("n_chars") < 300, "LOW_QUALITY").otherwise("OK")
    low = F.array_join(F.array_sort(F.collect_list(F.when(F.col("q") == "LOW_QUALITY", F.col("doc_id")))).cast("array<string>"), ",")
    # a list of pages is as long as its file: here, a hundred pages
    return Tables(spark, sf_dir).documents.withColumn("q", q).groupBy(F.floor(F.col("doc_id") / 100).alias("file")).agg(
        F.count("*").alias("pages"), F.count_if(F.col("q") == "LOW_QUALITY").alias("low"), F.count_if(F.col("q") == "ABSTAIN").alias("abstain"), low.alias("low_pages"),
        F.round(F.avg(F.least("n_chars", F.lit(1000)) / 1000), 6).alias("confidence"),
    )
