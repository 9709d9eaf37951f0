"""Similarity joins, assignments, boxes and extraction."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stagewise.functions import text as T
from stagewise.operators import extract as E
from stagewise.operators import matching as M

from .registry import Tables, query
from .texts import BOX_SQL, boxes

WORDS = r"\p{L}+"
SHINGLES_SQL = r"""w AS (SELECT doc_id, regexp_extract_all(lower(text), '\p{L}+') w FROM documents),
  s AS (SELECT doc_id, list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i+3], ' '))) s FROM w WHERE len(w) >= 4), k AS (SELECT min(doc_id) doc_id, s FROM (SELECT doc_id, list_sort(s) s FROM s WHERE len(s) >= 15) GROUP BY s),
  e AS (SELECT doc_id, unnest(s) g FROM k), v AS (SELECT a.doc_id a, b.doc_id b, count(*) i FROM e a JOIN e b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
  j AS (SELECT a, b, i, len(x.s) n, len(y.s) m FROM v JOIN k x ON x.doc_id = a JOIN k y ON y.doc_id = b)"""


def words() -> Column:
    return F.regexp_extract_all(F.lower("text"), F.lit(WORDS), F.lit(0))


@query("join13_shingle_pairs", f"WITH {SHINGLES_SQL} SELECT a, b, i votes, round(i / (n + m - i), 6) jaccard FROM j WHERE i / (n + m - i) >= 0.5")
def join13(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = M.shingle_pairs(Tables(spark, sf_dir).documents.select("doc_id", "text"), "doc_id", words())
    return found.select("a", "b", "votes", F.round("jaccard", 6).alias("jaccard"))


def greedy_sql(edges: str, block: str, a: str, b: str, order: str) -> str:
    """Common tables ``picked``: the edges that a walk in order takes, block by block, as ends are still free."""
    return f"""ranked AS (SELECT *, row_number() OVER (PARTITION BY {block} ORDER BY {order}) i FROM {edges}),
  walk AS (SELECT DISTINCT {block}, 0::BIGINT i, []::BIGINT[] ua, []::BIGINT[] ub, false AS won FROM ranked UNION ALL
    SELECT w.{block}, r.i, CASE WHEN list_contains(ua, r.{a}) OR list_contains(ub, r.{b}) THEN ua ELSE list_append(ua, r.{a}) END, CASE WHEN list_contains(ua, r.{a}) OR list_contains(ub, r.{b}) THEN ub ELSE list_append(ub, r.{b}) END,
      NOT (list_contains(ua, r.{a}) OR list_contains(ub, r.{b})) FROM walk w JOIN ranked r ON r.{block} = w.{block} AND r.i = w.i + 1),
  picked AS (SELECT r.* FROM walk w JOIN ranked r USING ({block}, i) WHERE won)"""


@query("join13_equal_sets", f"WITH {SHINGLES_SQL} SELECT doc_id, min(doc_id) OVER (PARTITION BY list_sort(s)) AS first FROM s WHERE len(s) >= 15")
def join13_equal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which text stands for each text in the pairs: the first one with the same shingles."""
    return M.same_sets(M.shingle_sets(Tables(spark, sf_dir).documents, "doc_id", words()), "doc_id", "s")


@query("join14_greedy_pairs", f"""WITH RECURSIVE {SHINGLES_SQL}, edges AS (SELECT lang, a, b, i / (n + m - i) jaccard FROM j JOIN documents ON doc_id = a WHERE i / (n + m - i) >= 0.5),
  {greedy_sql('edges', 'lang', 'a', 'b', 'jaccard DESC, a, b')} SELECT lang, a, b, round(jaccard, 6) jaccard FROM picked""")
def join14(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = Tables(spark, sf_dir).documents.select("doc_id", "text", "lang")
    found = M.shingle_pairs(d, "doc_id", words()).join(d.select(F.col("doc_id").alias("a"), "lang"), "a")
    return M.greedy_pairs(found, ["lang"], "a", "b", ["jaccard", "a", "b"], [True, False, False]).select("lang", "a", "b", F.round("jaccard", 6).alias("jaccard"))


@query("flt13_stop_shingles", r"WITH w AS (SELECT doc_id, list_distinct(regexp_extract_all(lower(text), '\p{L}+')) w FROM documents), e AS (SELECT doc_id, unnest(w) g FROM w) SELECT g word, count(*) documents FROM e GROUP BY 1 HAVING count(*) > greatest(50, (SELECT count(*) FROM documents) // 10)")
def flt13(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = Tables(spark, sf_dir).documents
    total = d.agg((F.count("*") / 10).cast("long").alias("tenth"))
    by = d.select("doc_id", F.explode(F.array_distinct(words())).alias("word")).groupBy("word").agg(F.count("*").alias("documents"))
    return by.crossJoin(total).filter(F.col("documents") > F.greatest(F.lit(50), F.col("tenth"))).select("word", "documents")


@query("agg17_idf", "WITH m AS (SELECT DISTINCT l_orderkey k, p_brand m FROM lineitem JOIN part ON l_partkey = p_partkey) SELECT m, round(ln((SELECT count(DISTINCT k) FROM m) / count(*)), 6) idf FROM m GROUP BY 1")
def agg17(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = Tables(spark, sf_dir)
    m = t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey")).select(F.col("l_orderkey").alias("k"), F.col("p_brand").alias("m"))
    return M.inverse_frequency(m, "k", "m").select("m", F.round("idf", 6).alias("idf"))


@query("agg18_weighted_jaccard", """WITH m AS (SELECT DISTINCT l_orderkey k, l_partkey m FROM lineitem), i AS (SELECT m, ln((SELECT count(DISTINCT k) FROM m) / count(*)) idf FROM m GROUP BY 1), r AS (SELECT k, m, idf FROM m JOIN i USING (m)), w AS (SELECT k, sum(idf) w FROM r GROUP BY 1),
  s AS (SELECT a.k a, b.k b, count(*) n, sum(a.idf) s FROM r a JOIN r b ON a.m = b.m AND a.k < b.k GROUP BY 1, 2 HAVING count(*) >= 2 AND sum(a.idf) >= 3) SELECT a, b, round(s / (x.w + y.w - s), 6) score FROM s JOIN w x ON x.k = a JOIN w y ON y.k = b""")
def agg18(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = Tables(spark, sf_dir).lineitem.select(F.col("l_orderkey").alias("k"), F.col("l_partkey").alias("m"))
    return M.weighted_jaccard(m, M.inverse_frequency(m, "k", "m"), "k", "m").select("a", "b", F.round("score", 6).alias("score"))


ANCHORS_SQL = """v AS (SELECT vec_id, embedding::DOUBLE[] v FROM embeddings), o AS (SELECT label, min(vec_id) id FROM embeddings GROUP BY 1), a AS (SELECT label, v FROM o JOIN v ON id = vec_id),
  c AS (SELECT vec_id, label, round(list_cosine_similarity(v.v, a.v), 6) s FROM v, a)"""


def owned(t: Tables) -> DataFrame:
    """(vec_id, owner, similarity): the label whose anchor, its first vector, is nearest to each vector."""
    v = t.embeddings.select("vec_id", "label", F.col("embedding").cast("array<double>").alias("v"))
    anchors = t.embeddings.groupBy("label").agg(F.min("vec_id").alias("vec_id")).join(v.drop("label"), "vec_id").select(F.col("label").alias("owner"), F.col("v").alias("a"))
    return M.nearest_anchor(v.select("vec_id", "v"), anchors, "vec_id", "v", "owner", "a")


@query("join27_cosine_owner", f"WITH {ANCHORS_SQL} SELECT vec_id, arg_max(label, (s, -label)) owner, max(s) similarity FROM c GROUP BY 1 HAVING max(s) >= 0.1")
def join27(spark: SparkSession, sf_dir: str) -> DataFrame:
    return owned(Tables(spark, sf_dir)).filter("similarity >= 0.1")


@query("join28_exclusive_labels", f"""WITH {ANCHORS_SQL}, w AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY s DESC, label) = 1)
  SELECT label, vec_id, s FROM w QUALIFY row_number() OVER (PARTITION BY label ORDER BY s DESC, vec_id) = 1""")
def join28(spark: SparkSession, sf_dir: str) -> DataFrame:
    best = owned(Tables(spark, sf_dir)).groupBy("owner").agg(F.max(F.struct("similarity", (-F.col("vec_id")).alias("less"))).alias("m"))
    return best.select(F.col("owner").alias("label"), (-F.col("m.less")).alias("vec_id"), F.col("m.similarity").alias("s"))


@query("join11_matched_points")
def join11(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = Tables(spark, sf_dir)
    stage = F.element_at(F.array(F.lit("ID"), F.lit("PD"), F.lit("RD")), F.col("l_linenumber") % 3 + 1)
    label = F.concat(F.when(F.col("l_linenumber") % 3 == 1, "Помещение ").otherwise("пом. "), (F.col("p_size") % 9).cast("string"), F.when(F.col("l_linenumber") % 2 == 0, "-").otherwise("."), (F.col("p_partkey") % 7).cast("string"))
    rows = t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey")).select(F.col("l_suppkey").alias("object_id"), F.col("p_brand").alias("param"), stage.alias("stage"), T.rule_group(label).alias("label"))
    return M.match_points(rows.distinct(), ["object_id", "param"]).groupBy("object_id", "param", "point").agg(F.count_distinct("stage").alias("stages"), F.count_distinct("label").alias("labels"))


@query("join15_sheet_pairs")
def join15(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sheets of two stages in one discipline, by title or by weighted shared marks (here, the orders they are in)."""
    t = Tables(spark, sf_dir)
    sheets = t.part.select(F.concat_ws(" ", "p_brand", "p_type").alias("block"), F.col("p_partkey").alias("sheet"), F.col("p_name").alias("title"), (F.col("p_partkey") % 2).alias("side"))
    marks = t.lineitem.select(F.col("l_partkey").alias("sheet"), F.col("l_orderkey").alias("mark")).distinct()
    return M.sheet_pairs(sheets, marks).select("block", "a", "b", "score")


@query("join17_nearest_label", f"""{BOX_SQL}, p AS (SELECT a.k, a.n, b.n m, sqrt((a.x0 - b.x0) ** 2 + (a.y0 - b.y0) ** 2) d FROM b a JOIN b ON a.k = b.k AND a.n <> b.n)
  SELECT k, n, arg_min(m, (d, m)) nearest, round(min(d), 6) distance FROM p WHERE d <= 0.3 GROUP BY 1, 2""")
def join17(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = boxes(Tables(spark, sf_dir))
    other = b.select("k", F.col("n").alias("m"), F.col("x0").alias("ox"), F.col("y0").alias("oy"))
    joined = b.join(other, "k").filter("n <> m").withColumn("d", F.sqrt((F.col("x0") - F.col("ox")) ** 2 + (F.col("y0") - F.col("oy")) ** 2)).filter("d <= 0.3")
    return joined.groupBy("k", "n").agg(F.min(F.struct("d", "m")).alias("x")).select("k", "n", F.col("x.m").alias("nearest"), F.round("x.d", 6).alias("distance"))


@query("join18_within_radius", f"{BOX_SQL} SELECT a.k, a.n, count(*) near FROM b a JOIN b ON a.k = b.k AND a.n <> b.n AND b.y0 >= a.y0 AND sqrt((a.x0 - b.x0) ** 2 + (a.y0 - b.y0) ** 2) <= 0.25 GROUP BY 1, 2")
def join18(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = boxes(Tables(spark, sf_dir))
    other = b.select("k", F.col("n").alias("m"), F.col("x0").alias("ox"), F.col("y0").alias("oy"))
    near = (F.col("n") != F.col("m")) & (F.col("oy") >= F.col("y0")) & (F.sqrt((F.col("x0") - F.col("ox")) ** 2 + (F.col("y0") - F.col("oy")) ** 2) <= 0.25)
    return b.join(other, "k").filter(near).groupBy("k", "n").agg(F.count("*").alias("near"))


@query("join21_box_overlap", f"""{BOX_SQL}, p AS (SELECT a.k, a.n, b.x0 c, greatest(least(a.x1, b.x1) - greatest(a.x0, b.x0), 0) * greatest(least(a.y1, b.y1) - greatest(a.y0, b.y0), 0) i, (a.x1 - a.x0) * (a.y1 - a.y0) s FROM b a JOIN b ON a.k = b.k AND a.n <> b.n)
  SELECT k, n, round(min(c), 6) confidence FROM p WHERE i >= 0.3 * s GROUP BY 1, 2""")
def join21(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = boxes(Tables(spark, sf_dir))
    names = ("x0", "y0", "x1", "y1")
    c = b.select("k", F.col("n").alias("m"), *(F.col(x).alias(f"b_{x}") for x in names))
    one, two = [F.col(x) for x in names], [F.col(f"b_{x}") for x in names]
    return b.join(c, "k").filter("n <> m").filter(T.overlap(one, two) >= 0.3 * T.area(one)).groupBy("k", "n").agg(F.round(F.min("b_x0"), 6).alias("confidence"))


@query("join32_inflated_boxes", f"{BOX_SQL} SELECT k, n FROM b a WHERE EXISTS (SELECT 1 FROM b WHERE b.k = a.k AND b.n <> a.n AND b.x0 <= a.x1 + 0.05 AND b.x1 >= a.x0 - 0.05 AND b.y0 <= a.y1 + 0.05 AND b.y1 >= a.y0 - 0.05)")
def join32(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = boxes(Tables(spark, sf_dir)).alias("a")
    c = boxes(Tables(spark, sf_dir)).alias("c")
    near = [F.col("a.k") == F.col("c.k"), F.col("a.n") != F.col("c.n")]
    for x, y in (("x0", "x1"), ("y0", "y1")):
        near += [F.col(f"c.{x}") <= F.col(f"a.{y}") + 0.05, F.col(f"c.{y}") >= F.col(f"a.{x}") - 0.05]
    return b.join(c, near, "left_semi").select("k", "n")


@query("join22_gold_match", """WITH g AS (SELECT l_orderkey o, l_linenumber n, l_partkey code, l_suppkey loc FROM lineitem WHERE l_linenumber % 2 = 0), s AS (SELECT l_orderkey o, l_partkey code, l_suppkey loc FROM lineitem WHERE l_linenumber % 2 = 1)
  SELECT o, n, EXISTS (SELECT 1 FROM s WHERE s.o = g.o AND (s.code = g.code OR s.loc % 10 = g.loc % 10)) matched FROM g""")
def join22(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = Tables(spark, sf_dir).lineitem.select(F.col("l_orderkey").alias("o"), F.col("l_linenumber").alias("n"), F.col("l_partkey").alias("code"), F.col("l_suppkey").alias("loc"))
    by = rows.filter("n % 2 = 1").groupBy("o").agg(F.collect_set("code").alias("codes"), F.collect_set(F.col("loc") % 10).alias("locs"))
    hit = F.array_contains("codes", F.col("code")) | F.array_contains("locs", F.col("loc") % 10)
    return rows.filter("n % 2 = 0").join(by, "o", "left").select("o", "n", F.coalesce(hit, F.lit(False)).alias("matched"))


@query("join29_pair_queue", """WITH a AS (SELECT l_orderkey k, l_linenumber n, l_suppkey s, l_quantity q FROM lineitem WHERE l_linenumber % 3 = 1), b AS (SELECT l_orderkey k, l_linenumber m, l_suppkey s2, l_quantity q2 FROM lineitem WHERE l_linenumber % 3 <> 1)
  SELECT k, n, m FROM a JOIN b USING (k) QUALIFY row_number() OVER (PARTITION BY k ORDER BY s <> s2, abs(q - q2), n, m) <= 3""")
def join29(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = Tables(spark, sf_dir).lineitem
    a = rows.filter("l_linenumber % 3 = 1").select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("n"), F.col("l_suppkey").alias("s"), F.col("l_quantity").alias("q"))
    b = rows.filter("l_linenumber % 3 <> 1").select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("m"), F.col("l_suppkey").alias("s2"), F.col("l_quantity").alias("q2"))
    from stagewise.operators.relational import first_per_group

    return first_per_group(a.join(b, "k"), ["k"], [F.col("s") != F.col("s2"), F.abs(F.col("q") - F.col("q2")), "n", "m"], 3).select("k", "n", "m")


@query("join30_word_set_twins", r"""WITH w AS (SELECT doc_id, list_distinct(regexp_extract_all(lower(text), '\p{L}+')) w FROM documents), k AS (SELECT * FROM w WHERE len(w) > 0)
  SELECT a.doc_id a, b.doc_id b, round(len(list_intersect(a.w, b.w)) / (len(a.w) + len(b.w) - len(list_intersect(a.w, b.w))), 6) jaccard FROM k a JOIN k b ON a.doc_id < b.doc_id AND len(a.w) * 5 >= len(b.w) * 4 AND len(b.w) * 5 >= len(a.w) * 4
  WHERE a.w <> b.w AND len(list_intersect(a.w, b.w)) * 5 >= (len(a.w) + len(b.w) - len(list_intersect(a.w, b.w))) * 4
    AND a.doc_id = (SELECT min(doc_id) FROM k x WHERE list_sort(x.w) = list_sort(a.w)) AND b.doc_id = (SELECT min(doc_id) FROM k x WHERE list_sort(x.w) = list_sort(b.w))""")
def join30(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = Tables(spark, sf_dir).documents.select("doc_id", F.explode(F.array(F.sort_array(F.array_distinct(words())))).alias("w"))
    return M.set_twins(d, "doc_id", "w", 0.8).select("a", "b", F.round("jaccard", 6).alias("jaccard"))


ROOMS_SQL = """r AS (SELECT DISTINCT l_suppkey s, l_partkey p FROM lineitem), z AS (SELECT s, count(*) n FROM r GROUP BY 1),
  c AS (SELECT a.s a, b.s b, count(*) shared FROM r a JOIN r b ON a.p = b.p AND a.s < b.s GROUP BY 1, 2 HAVING count(*) >= 2),
  e AS (SELECT 0 block, a, b, shared, shared + CASE WHEN x.s_nationkey = y.s_nationkey THEN 1000 ELSE 0 END + CASE WHEN x.s_name LIKE '%7%' AND y.s_name LIKE '%7%' THEN 5 ELSE 0 END score, round(shared / least(n.n, m.n), 9) AS share
    FROM c JOIN supplier x ON x.s_suppkey = a JOIN supplier y ON y.s_suppkey = b JOIN z n ON n.s = a JOIN z m ON m.s = b WHERE NOT (shared = n.n AND shared = m.n))"""


def room_sheets(t: Tables) -> tuple[DataFrame, DataFrame]:
    sheets = t.supplier.select(F.col("s_suppkey").alias("sheet"), F.col("s_nationkey").alias("system"), F.col("s_name").contains("7").alias("equipment"))
    return sheets, t.lineitem.select(F.col("l_suppkey").alias("sheet"), F.col("l_partkey").alias("room")).distinct()


@query("join31_shared_rooms", f"WITH {ROOMS_SQL} SELECT a, b, shared, score, share FROM e")
def join31(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.room_pairs(*room_sheets(Tables(spark, sf_dir))).select("a", "b", "shared", "score", F.round("share", 9).alias("share"))


@query("join31_assigned_sheets", f"WITH RECURSIVE {ROOMS_SQL}, {greedy_sql('e', 'block', 'a', 'b', 'score DESC, share DESC, a, b')} SELECT a, b, score FROM picked")
def join31_assigned(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = M.room_pairs(*room_sheets(Tables(spark, sf_dir))).withColumn("share", F.round("share", 9))
    return M.greedy_pairs(pairs, [], "a", "b", ["score", "share", "a", "b"], [True, True, False, False]).select("a", "b", "score")


@query("str14_changed_numbers_ext19", "SELECT p_partkey, p_size || '>' || (p_size + 1) change FROM part WHERE p_partkey % 3 = 0 UNION ALL SELECT p_partkey, '2,5>3,5' FROM part WHERE p_partkey % 4 = 1")
def str14(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two versions of a sentence for each part; of some, a number or two are not the same."""
    k, size = F.col("p_partkey"), F.col("p_size")
    sentence = lambda n, m: F.concat(F.lit("the wall between the rooms has a width of "), n.cast("string"), F.lit(" mm over its whole length and a height of "), m, F.lit(" m above the floor level of the house"))
    pairs = Tables(spark, sf_dir).part.select("p_partkey", sentence(size, F.lit("2,5")).alias("x"), sentence(size + F.when(k % 3 == 0, 1).otherwise(0), F.when(k % 4 == 1, "3,5").otherwise("2,5")).alias("y"))
    return M.number_changes(pairs, "x", "y").select("p_partkey", F.explode("changes").alias("change"))


@query("str16_token_sort_ratio")
def str16(spark: SparkSession, sf_dir: str) -> DataFrame:
    score = M.text_score("token_sort_ratio")
    return Tables(spark, sf_dir).part.select("p_partkey", F.round(score(F.col("p_name"), F.col("p_type")), 4).alias("score"))


@query("agg30_word_error")
def agg30(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = Tables(spark, sf_dir).conversations
    pairs = c.withColumn("after", F.lead("text").over(Window.partitionBy("conv_id").orderBy("turn"))).filter("after IS NOT NULL")
    return pairs.select("role", M.text_score("wer")(F.col("text"), F.col("after")).alias("w")).groupBy("role").agg(F.round(F.avg("w"), 6).alias("wer"))


@query("win10_bands", f"""{BOX_SQL.replace('WITH', 'WITH RECURSIVE')}, o AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY y0, n) i FROM b),
  walk AS (SELECT k, i, y0, y1, 0 band FROM o WHERE i = 1 UNION ALL SELECT o.k, o.i, CASE WHEN apart THEN o.y0 ELSE w.y0 END, CASE WHEN apart THEN o.y1 ELSE w.y1 END, band + apart::INT
    FROM walk w JOIN o ON o.k = w.k AND o.i = w.i + 1, LATERAL (SELECT greatest(least(o.y1, w.y1) - greatest(o.y0, w.y0), 0) / greatest(least(o.y1 - o.y0, w.y1 - w.y0), 1e-12) < 0.4 apart))
  SELECT k, max(band) + 1 bands FROM walk GROUP BY 1""")
def win10(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = boxes(Tables(spark, sf_dir)).select("k", "n", "y0", "y1")
    return M.banded(b, ["k"], "y0", "y1", ["y0", "n"]).groupBy("k").agg((F.max("band") + 1).alias("bands"))


@query("ext17_box_suppression", f"""{BOX_SQL.replace('WITH', 'WITH RECURSIVE')}, s AS (SELECT b.*, l_discount score FROM b JOIN lineitem ON k = l_orderkey AND n = l_linenumber),
  o AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY score DESC, n, x0, y0) i FROM s),
  walk AS (SELECT k, i, [{{'x0': x0, 'y0': y0, 'x1': x1, 'y1': y1}}] kept FROM o WHERE i = 1 UNION ALL
    SELECT o.k, o.i, CASE WHEN len(list_filter(kept, lambda q: greatest(least(q.x1, o.x1) - greatest(q.x0, o.x0), 0) * greatest(least(q.y1, o.y1) - greatest(q.y0, o.y0), 0) /
      ((q.x1 - q.x0) * (q.y1 - q.y0) + (o.x1 - o.x0) * (o.y1 - o.y0) - greatest(least(q.x1, o.x1) - greatest(q.x0, o.x0), 0) * greatest(least(q.y1, o.y1) - greatest(q.y0, o.y0), 0)) >= 0.4)) > 0
      THEN kept ELSE list_append(kept, {{'x0': o.x0, 'y0': o.y0, 'x1': o.x1, 'y1': o.y1}}) END FROM walk w JOIN o ON o.k = w.k AND o.i = w.i + 1)
  SELECT k, arg_max(len(kept), i) kept FROM walk GROUP BY 1""")
def ext17(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = Tables(spark, sf_dir)
    b = boxes(t).join(t.lineitem.select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("n"), F.col("l_discount").alias("score")), ["k", "n"])
    return M.kept_boxes(b, ["k"], ["x0", "y0", "x1", "y1"], "score", ["n"]).groupBy("k").agg(F.count("*").alias("kept"))


def construction_pages(t: Tables) -> DataFrame:
    """Sentences with values made from the order lines, so that every rule has something to find."""
    q, n = F.col("l_quantity").cast("int"), F.col("l_linenumber")
    cases = [
        ("Полезная площадь здания составляет {} м2", q * 10), ("Отметка нуля соответствует абсолютной отметке {} м", q + 100), ("Расход воды составляет {} м3/сут", q),
        ("Дверь шириной {} м", F.format_number(q / 20, 2)), ("Толщина плиты {} мм", q * 25), ("Бетон класса В{}", F.element_at(F.array(F.lit("25"), F.lit("30"), F.lit("35")), (q % 3 + 1))),
    ]
    text = F.lit("")
    for i, (form, value) in enumerate(cases):
        before, after = form.split("{}")
        text = F.when(n % len(cases) == i, F.concat(F.lit(before), value.cast("string"), F.lit(after))).otherwise(text)
    return t.lineitem.select(F.col("l_orderkey").alias("doc_id"), n.alias("page"), text.alias("text"))


@query("ext01_rule_values", """WITH v AS (SELECT l_orderkey doc_id, l_linenumber page, l_linenumber % 6 c, l_quantity::INT q FROM lineitem)
  SELECT doc_id, page, 'useful_area' code, q * 10.0::DOUBLE "value" FROM v WHERE c = 0 AND q * 10 >= 100 UNION ALL SELECT doc_id, page, 'zero_level', q + 100.0::DOUBLE FROM v WHERE c = 1
  UNION ALL SELECT doc_id, page, 'daily_flow', q::DOUBLE FROM v WHERE c = 2 UNION ALL SELECT doc_id, page, 'door_width', q / 20 FROM v WHERE c = 3 AND q / 20 BETWEEN 0.5 AND 5 UNION ALL SELECT doc_id, page, 'slab_thickness', q * 25.0::DOUBLE FROM v WHERE c = 4 AND q * 25 >= 300""")
def ext01(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.rule_values(construction_pages(Tables(spark, sf_dir))).select("doc_id", "page", "code", "value")


@query("ext09_chosen_values", """WITH v AS (SELECT l_orderkey doc_id, l_linenumber % 6 c, l_quantity::INT q, l_linenumber * 1000 + l_quantity::INT n FROM lineitem) SELECT doc_id, 'slab_thickness' code, min(q * 25.0::DOUBLE) "value" FROM v WHERE c = 4 AND q * 25 >= 300 GROUP BY 1
  UNION ALL SELECT doc_id, 'door_width', min(q / 20) FROM v WHERE c = 3 AND q / 20 BETWEEN 0.5 AND 5 GROUP BY 1 UNION ALL SELECT doc_id, 'daily_flow', max(q::DOUBLE) FROM v WHERE c = 2 GROUP BY 1
  UNION ALL SELECT doc_id, 'useful_area', arg_min(q * 10.0::DOUBLE, n) FROM v WHERE c = 0 AND q * 10 >= 100 GROUP BY 1 UNION ALL SELECT doc_id, 'zero_level', arg_min(q + 100.0::DOUBLE, n) FROM v WHERE c = 1 GROUP BY 1""")
def ext09(spark: SparkSession, sf_dir: str) -> DataFrame:
    values = E.rule_values(construction_pages(Tables(spark, sf_dir)))
    return E.chosen_values(values).select("doc_id", "code", "value")


@query("ext08_concrete_class_str08", "SELECT l_orderkey doc_id, l_linenumber page, ['B25', 'B30', 'B35'][l_quantity::INT % 3 + 1] class FROM lineitem WHERE l_linenumber % 6 = 5")
def ext08(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = construction_pages(Tables(spark, sf_dir))
    return p.select("doc_id", "page", F.explode(E.concrete_classes(F.col("text"))).alias("class"))


@query("ext04_tables_before_text", """WITH v AS (SELECT l_orderkey d, l_linenumber n, l_returnflag = 'A' AS is_table, l_quantity::INT q FROM lineitem), a AS (SELECT *, bool_or(is_table) OVER (PARTITION BY d) any_table FROM v) SELECT d, max(q) area FROM a WHERE is_table OR NOT any_table GROUP BY 1""")
def ext04(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = Tables(spark, sf_dir).lineitem.select(F.col("l_orderkey").alias("d"), (F.col("l_returnflag") == "A").alias("t"), F.col("l_quantity").cast("int").alias("q"))
    return v.groupBy("d").agg(F.coalesce(F.max(F.when(F.col("t"), F.col("q"))), F.max("q")).alias("area"))


# A page of each part in two versions: three blocks; every few words one that only this part has, so that pages are like their own version alone.
OWN_SQL = "translate(p_partkey::VARCHAR, '0123456789', 'абвгдежзик')"
REVISED_SQL = f"""p AS (SELECT p_partkey a, p_size n, {OWN_SQL} w, p_partkey % 7 <> 3 paired FROM part)"""


def page_versions(t: Tables) -> DataFrame:
    k, n = F.col("p_partkey"), F.col("p_size")
    own = F.translate(k.cast("string"), "0123456789", "абвгдежзик")
    fill = lambda form, *values: F.format_string(form.replace("@", "%1$s"), own, *values)
    levels = " ".join(f"@ {x} м" for x in ("0,1", "1,2", "2,3", "3,4", "4,6", "5,7", "6,8", "7,9", "8,1", "9,2", "10,3", "11,4"))

    def side(i: int) -> DataFrame:
        width, flow = n + F.when((k % 3 == 0) & F.lit(i == 1), 1).otherwise(0), n % 9 + F.when((k % 4 == 1) & F.lit(i == 1), 1).otherwise(0)
        about = F.when((k % 5 == 2) & F.lit(i == 1), " примерно").otherwise("")
        blocks = [
            F.concat(fill("Проём @ стены @ этажа @ ширина @ составляет %2$d мм @ на всю @ длину", width), about), fill(f"отметки {levels}"),
            fill("расход @ воды @ здания @ равен %2$d,5 м3/сут @ подписано @ в @ срок %3$d.10.2022 @ лист %4$d", flow, F.lit(10 + i), k + i),
        ]
        rows = t.part.select(F.lit(i).alias("side"), k.alias("page"), F.array(*(F.struct(b.alias("text"), F.array(F.lit(0.0), F.lit(float(j)), F.lit(1.0), F.lit(j + 0.9)).alias("bbox")) for j, b in enumerate(blocks))).alias("blocks"))
        return rows if i == 0 else rows.filter("page % 7 <> 3")

    return side(0).unionByName(side(1))


@query("ext19_revised_pages", f"""WITH {REVISED_SQL} SELECT a, n::VARCHAR AS before, (n + 1)::VARCHAR AS after, 'мм' unit, length('Проём  стены  этажа  ширина  составляет ') + 4 * length(w) a_start, 0.0::DOUBLE a_top FROM p WHERE paired AND a % 3 = 0
  UNION ALL SELECT a, n % 9 || ',5', (n % 9 + 1) || ',5', 'м3/сут', length('Проём  стены  этажа  ширина  составляет  мм  на всю  длину') + 6 * length(w) + length(n::VARCHAR) + 1 + length('отметки  0,1 м  1,2 м  2,3 м  3,4 м  4,6 м  5,7 м  6,8 м  7,9 м  8,1 м  9,2 м  10,3 м  11,4 м') + 12 * length(w) + 1 + length('расход  воды  здания  равен ') + 3 * length(w), 2.0::DOUBLE FROM p WHERE paired AND a % 4 = 1""")
def ext19_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages matched, aligned and compared: changed widths and flows, not the dates and sheet numbers that changed too."""
    from stagewise.operators.revised import revised_pages

    return revised_pages(page_versions(Tables(spark, sf_dir))).select("a", "before", "after", "unit", "a_start", F.get("a_box", F.lit(1)).alias("a_top"))
