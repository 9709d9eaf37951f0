"""Lexicon, units, outlets, reading order, tables and labels over the test tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stagewise.functions import lexicon as L
from stagewise.functions import rules
from stagewise.functions import text as T
from stagewise.operators import layout as O

from .registry import Tables, query
from .similarity import greedy_sql

# Units as they are written after a number, and their classes.
UNIT_TEXTS = (
    (" м2 площади", "area"), (" куб. м/сут", "flow_day"), ("мм", "len_mm"), (" м", "len"), (" шт.", "count"), ("%", "pct"), (" тыс. руб.", "money"), (" попугаев", "none"), (" м3/ч", "flow_h"), (" л/с", "flow_ls"), (" Гкал/ч", "heat"),
    (" мм2", "area_mm"), (" м3 грунта", "vol"), (" кВт", "power"), ("‰", "permille"), (" минут", "min"), (" суток", "days"), (" А", "amp"), (" кВт·ч/м2", "specific"), (" Вт/(м·°С)", "conductivity"), (" м2·°С/Вт", "resistance"),
)


def one_of(key: str, *texts: Column) -> Column:
    """One of the texts, by the row's number."""
    return F.element_at(F.array(*texts), (F.col(key) % len(texts) + 1).cast("int"))


def chosen(cases: tuple, at: int, key: str) -> Column:
    """The text of one of the cases, by the row's number."""
    return F.element_at(F.array(*(F.lit(c[at]) for c in cases)), (F.col(key) % len(cases) + 1).cast("int"))


@query("str09_str10_elements", """SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'Фундаментная плита' WHEN 1 THEN 'Вертикальные конструкции' || CASE WHEN p_size % 2 = 1 THEN ' подземной части' ELSE '' END WHEN 2 THEN 'Ростверк' END element FROM part""")
def str10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Works on a numbered element, in a form of its name; a negative level makes it one below ground, other names are none."""
    k, n = F.col("p_partkey").cast("string"), F.col("p_size").cast("string")
    level = F.when(F.col("p_size") % 2 == 1, F.concat(F.lit("-"), n, F.lit(".500"))).otherwise(F.concat(F.lit("+"), n, F.lit(".500")))
    text = one_of("p_partkey", F.concat(F.lit("бетонирование фундаментной плиты № "), k), F.concat(F.lit("армирование колонн и наружных стен на отм. "), level), F.concat(F.lit("участок "), k, F.lit(" ростверка")), F.concat(F.lit("стенд № "), k, F.lit(" для плитки")))
    return Tables(spark, sf_dir).part.select("p_partkey", L.element(text).alias("element"))


@query("str11_systems", """SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'В' || p_size || '.' || b || ',В' || p_size || '.' || (b + 10) WHEN 1 THEN 'П' || p_size || ',ВЕ' WHEN 2 THEN 'П' || p_size || '.' || b || ',П' || p_size || '.' || (b + 10) ELSE 'ВЕ' || p_size END systems FROM (SELECT *, p_partkey % 9 + 1 b FROM part)""")
def str11(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Marks made of a row's numbers: short numbers after a comma or a space belong to the last whole one, letters may be Latin."""
    n, b = F.col("p_size").cast("string"), (F.col("p_partkey") % 9 + 1).cast("string")
    c = (F.col("p_partkey") % 9 + 11).cast("string")
    text = one_of("p_partkey", F.concat(F.lit("B"), n, F.lit("."), b, F.lit(","), c), F.concat(F.lit("П"), n, F.lit("/ВЕ")), F.concat(F.lit("П"), n, F.lit("."), b, F.lit(", "), n, F.lit("."), c), F.concat(F.lit("BE"), n, F.lit("; комната "), b))
    return Tables(spark, sf_dir).part.select("p_partkey", F.array_join(L.systems(text), ",").alias("systems"))


@query("str25_project_codes", """SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'ЖС-РД-' || p_partkey WHEN 1 THEN 'П-2025-' || p_size || '-' || p_partkey WHEN 2 THEN 'НВС-' || p_partkey || '.03' END project FROM part""")
def str25(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Document codes made of a row's numbers, with stage and section, with a section alone, with a volume, and without a section."""
    k, n = F.col("p_partkey").cast("string"), F.col("p_size").cast("string")
    code = one_of("p_partkey", F.concat(F.lit("ЖС-РД-"), k, F.lit("-П-АР")), F.concat(F.lit("П-2025-"), n, F.lit("-"), k, F.lit("-КЖ02")), F.concat(F.lit("НВС-"), k, F.lit(".03-"), n, F.lit(".2-КР2")), F.concat(F.lit("1-П-"), k))
    return Tables(spark, sf_dir).part.select("p_partkey", L.project_code(code).alias("project"))


@query("str31_units", f"""WITH t AS (SELECT p_partkey, p_size, {[c[1] for c in UNIT_TEXTS]}[p_partkey % {len(UNIT_TEXTS)} + 1] unit FROM part) SELECT p_partkey, nullif(unit, 'none') unit, CASE WHEN unit <> 'none' THEN p_size + 0.5 END AS value FROM t""")
def str31(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A number in a phrase, with the class of the unit behind it; without a known unit it is no quantity."""
    phrase = F.concat(F.lit("показатель "), F.col("p_size").cast("string"), F.lit(",5"), chosen(UNIT_TEXTS, 0, "p_partkey"))
    unit = L.unit_after(F.regexp_extract(phrase, r"\d+,\d+(.*)$", 1))
    return Tables(spark, sf_dir).part.select("p_partkey", unit.alias("unit"), F.when(unit.isNotNull(), T.number(F.regexp_extract(phrase, r"(\d+,\d+)", 1))).alias("value"))


@query("str31_roots", r"SELECT doc_id, len(list_distinct(list_transform(regexp_extract_all(lower(text), '[а-яa-z]{3,}'), lambda w: substr(w, 1, 4)))) roots FROM documents")
def str31_roots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Tables(spark, sf_dir).documents.select("doc_id", F.size(L.beginnings(F.col("text"), 4)).cast("long").alias("roots"))


@query("ext10_outlets", """WITH p AS (SELECT p_partkey k, p_partkey % 10 document, p_partkey % 20 + 1 n, p_size + 50 d FROM part),
  f AS (SELECT document, 'Выпуск К1-' || n outlet, d FROM p WHERE k % 3 = 0 UNION ALL SELECT document, 'Выпуски К2', unnest([d, d + 10, d + 20]) FROM p WHERE k % 3 = 1 UNION ALL SELECT document, 'Выпуск К2-' || n, d FROM p WHERE k % 3 = 2)
  SELECT document, outlet, max(d)::DOUBLE diameter FROM f GROUP BY 1, 2""")
def ext10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each outlet of a document the greatest diameter: by mark, listed after the word itself, not the sleeve's or a riser's."""
    n, d = (F.col("p_partkey") % 20 + 1).cast("string"), F.col("p_size") + 50
    shown = lambda x: x.cast("string")
    text = one_of(
        "p_partkey", F.concat(F.lit("Выпуск К1-"), n, F.lit(" Ø"), shown(d), F.lit("; стояк К2-6 Ø250")),
        F.concat(F.lit("три выпуска дождевой канализации диаметрами "), shown(d), F.lit(", "), shown(d + 10), F.lit(" мм и "), shown(d + 20), F.lit(" мм")),
        F.concat(F.lit("Выпуск "), n, F.lit("-К2 Ø"), shown(d), F.lit(" в стальном футляре Ø"), shown(d + 150)),
    )
    pages = Tables(spark, sf_dir).part.select((F.col("p_partkey") % 10).alias("document"), F.explode(L.outlet_values(text)).alias("x"))
    return pages.groupBy("document", F.col("x.key").alias("outlet")).agg(F.max("x.diameter").alias("diameter"))


@query("dsl07_unknown_codes", "SELECT 'a' AS rule, 'Brand#99' code UNION ALL SELECT 'c', 'Brand#77'")
def dsl07(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules that refer to codes which the matrix lacks; the matrix has one row for each code."""
    codes = [r[0] for r in Tables(spark, sf_dir).part.select("p_brand").distinct().collect()]
    given = [("a", "Brand#13.PD > Brand#99.RD", "true"), ("b", "exists(Brand#13.PD)", "not Brand#5.RD = 1"), ("c", "missing(Brand#77.ID)", "Brand#13.PD > 1")]
    found = rules.unknown_codes(given, codes)
    return spark.createDataFrame([(r, c) for r, cs in found.items() for c in cs], "rule string, code string")


# Eighty words a page.
WORDS_SQL = "w AS (SELECT event_id // 80 page, event_id n, event_type AS text, event_id * 37 % 1000 / 1000.0 x0, (event_id * 37 % 1000 + length(event_type) * 8) / 1000.0 x1, (event_id * 53 % 997) / 997.0 y0, (event_id * 53 % 997) / 997.0 + 0.01 + event_id % 3 * 0.004 y1 FROM events)"


def words(t: Tables) -> DataFrame:
    n = F.col("event_id")
    y0 = (n * 53 % 997) / 997.0
    return t.events.select(
        F.floor(n / 80).alias("page"), n.alias("n"), F.col("event_type").alias("text"), ((n * 37 % 1000) / 1000.0).alias("x0"), ((n * 37 % 1000 + F.length("event_type") * 8) / 1000.0).alias("x1"),
        y0.alias("y0"), (y0 + 0.01 + n % 3 * 0.004).alias("y1"),
    )


BANDS_SQL = f"""{WORDS_SQL}, o AS (SELECT *, (y0 + y1) / 2 mid, y1 - y0 h, row_number() OVER (PARTITION BY page ORDER BY (y0 + y1) / 2, x0, n) i FROM w),
  walk AS (SELECT page, i, n, x0, mid, h, 0 band FROM o WHERE i = 1 UNION ALL SELECT o.page, o.i, o.n, o.x0, CASE WHEN abs(o.mid - k.mid) > least(o.h, k.h) / 2 THEN o.mid ELSE k.mid END, CASE WHEN abs(o.mid - k.mid) > least(o.h, k.h) / 2 THEN o.h ELSE k.h END,
    band + CASE WHEN abs(o.mid - k.mid) > least(o.h, k.h) / 2 THEN 1 ELSE 0 END FROM walk k JOIN o ON o.page = k.page AND o.i = k.i + 1)"""


@query("srt06_reading_order", f"WITH RECURSIVE {BANDS_SQL} SELECT page, n, band, row_number() OVER (PARTITION BY page ORDER BY band, x0, n) - 1 place FROM walk")
def srt06(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.reading_order(words(Tables(spark, sf_dir)), ["page"]).select("page", "n", "band", "place")


@query("ext14_rebuilt_tables")
def ext14(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.tables_of_words(words(Tables(spark, sf_dir)), ["page"]).select("page", "band", "column", "text")


CELLS_SQL = "c AS (SELECT l_orderkey page, l_linenumber AS row, l_suppkey * 1000 + l_partkey k, l_quantity::INT q, l_linenumber * 100000 + l_suppkey * 1000 + l_partkey AS line FROM lineitem)"


def cells(t: Tables) -> DataFrame:
    """A row of three cells for each order line: name, value and a unit that is no number. Lines stand below each other by their number, so that no two share a row, whatever their keys."""
    q, line = F.col("l_quantity").cast("int"), F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_suppkey", "l_partkey", "l_quantity"))
    name = F.when(q % 3 == 0, "Строительного объёма здания, м3").when(q % 3 == 1, "Объём строительных отходов по видам, всего, в год").otherwise("Прочее")
    cell = lambda x, text: F.struct(F.lit(x).alias("x0"), F.lit(x + 0.1).alias("x1"), text.alias("text"))
    rows = t.lineitem.withColumn("line", line).select(F.col("l_orderkey").alias("page"), F.col("line").alias("y0"), (F.col("line") + 0.9).alias("y1"), F.explode(F.array(cell(0.1, name), cell(0.4, q.cast("string")), cell(0.8, F.lit("м2 по проекту")))).alias("c"))
    return rows.select("page", "y0", "y1", "c.*")


@query("ext02_named_rows", f"WITH {CELLS_SQL} SELECT page, q::VARCHAR AS value, count(*) n FROM c WHERE q % 3 = 0 GROUP BY 1, 2")
def ext02(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = O.named_rows(cells(Tables(spark, sf_dir)), ["page"], ["строительный объем"])
    return found.groupBy("page", "value").agg(F.count("*").alias("n"))


@query("ext03_room_schedule", "SELECT p_brand AS table_id, p_partkey AS row, (100 + p_partkey % 900)::VARCHAR AS number, p_size + 0.5 area FROM part WHERE p_partkey % 4 <> 0 AND p_brand NOT LIKE '%1' AND p_brand IN (SELECT p_brand FROM part GROUP BY 1 HAVING avg((p_partkey % 4 <> 0)::INT) >= 0.6)")
def ext03(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table for each brand: number, name, area; some rows lack the area and some tables have no numbers."""
    k, no_numbers = F.col("p_partkey"), F.col("p_brand").endswith("1")
    number = F.when(no_numbers, F.col("p_name")).otherwise((100 + k % 900).cast("string"))
    area = F.when(k % 4 == 0, F.lit("-")).otherwise(F.concat(F.col("p_size").cast("string"), F.lit(",5")))
    cell = lambda c, text: F.struct(F.lit(c).alias("column"), text.alias("text"))
    rows = Tables(spark, sf_dir).part.select(F.col("p_brand").alias("table_id"), k.alias("row"), F.explode(F.array(cell(0, number), cell(1, F.col("p_name")), cell(2, area))).alias("c"))
    return O.room_schedule(rows.select("table_id", "row", "c.*"), ["table_id"])


FLOORS_SQL = """r AS (SELECT l_suppkey t, l_linenumber f, l_partkey k, row_number() OVER (PARTITION BY l_suppkey, l_linenumber ORDER BY l_partkey) i, (l_partkey % 50 + 10) * 4 + 1 q FROM (SELECT DISTINCT l_suppkey, l_linenumber, l_partkey FROM lineitem WHERE l_linenumber <= 4))"""


@query("ext03_floor_totals", f"""WITH {FLOORS_SQL}, f AS (SELECT t, f, count(*) rooms, sum(q) / 4.0 area FROM r GROUP BY ALL), n AS (SELECT *, row_number() OVER (PARTITION BY t ORDER BY f) - 1 floor FROM f)
  SELECT t, floor, rooms, area, area + CASE WHEN t % 3 = 0 AND f = 2 THEN 1 ELSE 0 END total, NOT (t % 3 = 0 AND f = 2) agrees FROM n UNION ALL SELECT t, -1, sum(rooms), sum(area), sum(area), true FROM f GROUP BY 1""")
def ext03_floors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A schedule for each supplier: rooms by floor, a sum of a section among them, floors' totals (some wrong), the building's total."""
    k, f = F.col("l_partkey"), F.col("l_linenumber")
    rooms = Tables(spark, sf_dir).lineitem.filter("l_linenumber <= 4").select(F.col("l_suppkey").alias("t"), f.alias("f"), k.alias("k")).distinct()
    rooms = rooms.withColumn("i", F.row_number().over(Window.partitionBy("t", "f").orderBy("k"))).withColumn("q", (F.col("k") % 50 + 10) * 4 + 1)
    shown = lambda q: F.regexp_replace(F.format_string("%.2f", q / 4.0), r"\.", ",")
    line = lambda at, number, name, area: F.struct(at.cast("long").alias("row"), number.alias("number"), F.lit(name).alias("name"), shown(area).alias("area"))
    at = F.col("f") * 10_000_000
    own = rooms.select("t", F.explode(F.array_compact(F.array(
        line(at + F.col("i") * 10, F.concat(F.col("f").cast("string"), F.lit("-"), (F.col("i") % 1000).cast("string")), "Кабинет", F.col("q")),
        F.when(F.col("i") % 5 == 2, line(at + F.col("i") * 10 - 5, F.lit(""), "Итого раздел", F.lit(4_000_000))),
    ))).alias("x"))
    floors = rooms.groupBy("t", "f").agg(F.sum("q").alias("q"))
    wrong = F.when((F.col("t") % 3 == 0) & (F.col("f") == 2), 4).otherwise(0)
    totals = floors.select("t", line(at + 9_000_000, F.lit(""), "Итого по этажу", F.col("q") + wrong).alias("x"))
    whole = floors.groupBy("t").agg(F.sum("q").alias("q")).select("t", line(F.lit(90_000_000), F.lit(""), "Итого по зданию", F.col("q")).alias("x"))
    cell = lambda c, name: F.struct(F.lit(c).alias("column"), F.col(f"x.{name}").alias("text"))
    cells = own.unionByName(totals).unionByName(whole).select("t", "x.row", F.explode(F.array(cell(0, "number"), cell(1, "name"), cell(2, "area"))).alias("c")).select("t", "row", "c.*")
    return O.floor_schedule(cells, ["t"])[1].select("t", "floor", "rooms", "area", "total", "agrees")


GRADES, NAMES = ("B15", "B20", "B22.5", "B25", "B30"), ("Ростверк", "Лестницы", "Фундаментная плита", "Бетонная подготовка")
CLASSES_SQL = f"""c AS (SELECT l_orderkey doc_id, l_linenumber page, {list(GRADES)}[l_partkey % 5 + 1] class, {list(NAMES)}[l_suppkey % 4 + 1] element, l_quantity::INT % 4 way, l_orderkey % 3 = 0 act FROM (SELECT * FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_suppkey, l_quantity) = 1)),
  o AS (SELECT *, last_value(CASE WHEN way <> 3 THEN {{'page': page, 'element': element}} END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY page) w FROM c)"""


@query("ext08_classes_by_element", f"""WITH {CLASSES_SQL} SELECT doc_id, page, element, class, CASE way WHEN 2 THEN 'text' ELSE 'table' END AS method FROM o WHERE way <> 3
  UNION ALL SELECT doc_id, page, w.element, class, 'context' FROM o WHERE way = 3 AND act AND page - w.page <= 4""")
def ext08_elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page of each order line with a class of concrete: its element stands in its row, above it, before it, or only on an earlier page of an act."""
    from stagewise.operators.extract import element_classes

    forms = ("ростверка", "лестничных маршей", "фундаментной плиты", "бетонной подготовки")
    pick = lambda words, at: F.element_at(F.array(*map(F.lit, words)), (at + 1).cast("int"))
    way, act = F.col("l_quantity").cast("int") % 4, F.col("l_orderkey") % 3 == 0
    lines = Tables(spark, sf_dir).lineitem.groupBy("l_orderkey", "l_linenumber").agg(F.min(F.struct("l_partkey", "l_suppkey", "l_quantity")).alias("m")).select("l_orderkey", "l_linenumber", "m.*")
    rows = lines.select(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("page"), way.alias("way"), act.alias("act"), pick([g.replace("B", "В").replace(".", ",") for g in GRADES], F.col("l_partkey") % 5).alias("grade"), pick(forms, F.col("l_suppkey") % 4).alias("form"))
    box = lambda x, y, text: F.struct(F.lit(x).alias("x0"), F.lit(y).alias("y0"), F.lit(x + 0.9).alias("x1"), F.lit(y + 0.8).alias("y1"), text.alias("text"))
    some = lambda *boxes: F.array_compact(F.array(*boxes))
    cells = some(
        F.when(F.col("way") == 0, box(0.0, 2.0, F.concat(F.lit("Устройство "), F.col("form")))), F.when(F.col("way") == 0, box(1.0, 2.0, F.lit("м3"))),
        F.when(F.col("way") != 2, box(2.0, 2.0, F.concat(F.lit("бетон "), F.col("grade"), F.lit(" F150")))),
    )
    blocks = some(
        F.when(F.col("act"), box(0.0, 0.0, F.lit("АКТ освидетельствования скрытых работ"))), F.when(F.col("way") == 1, box(2.0, 1.0, F.concat(F.lit("Спецификация элементов "), F.col("form")))),
        F.when(F.col("way") == 2, box(0.0, 4.0, F.concat(F.lit("Для "), F.col("form"), F.lit(" принят бетон класса "), F.col("grade"), F.lit(", бетон тяжёлый")))),
        F.when(F.col("way") == 0, box(5.0, 5.0, F.concat(F.lit("Работы по устройству "), F.col("form")))),
    )
    one = lambda what: rows.select("doc_id", "page", F.explode(what).alias("b")).select("doc_id", "page", "b.*")
    return element_classes(one(cells), one(blocks))


@query("ext11_room_systems", """SELECT l_orderkey page, l_partkey room, min(l_suppkey % 9) FILTER (true) AS system FROM lineitem GROUP BY 1, 2""")
def ext11(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The system mark nearest to each room number of a page; marks stand at a distance of their number."""
    from stagewise.operators.matching import nearest

    line = Tables(spark, sf_dir).lineitem
    rooms = line.select(F.col("l_orderkey").alias("page"), F.col("l_partkey").alias("room"), F.col("l_partkey").cast("double").alias("x"), F.lit(0.0).alias("y")).distinct()
    marks = line.select(F.col("l_orderkey").alias("page"), F.concat(F.lit("В"), (F.col("l_suppkey") % 9).cast("string")).alias("text"), F.col("l_partkey").cast("double").alias("ox"), ((F.col("l_suppkey") % 9) / 100).alias("oy"))
    marks = marks.select("page", F.explode(L.systems(F.col("text"))).alias("mark"), "ox", "oy")
    found = nearest(rooms, marks, ["page"], "x", "y", "ox", "oy", F.col("mark"), 0.5, "room")
    return found.select("page", "room", F.substring("nearest", 2, 9).cast("int").alias("system"))


def labels(t: Tables, side: int) -> DataFrame:
    """Labels on two aligned sheets for each user: the second side is shifted a little, some texts differ, some moved far."""
    n = F.col("event_id")
    x, y = (n * 29 % 100) / 100.0, (n * 71 % 101) / 101.0
    move = F.when((n % 10 == 3) & F.lit(side == 1), 0.025).otherwise(0.002 * side)
    text = F.when((n % 7 == 2) & F.lit(side == 1), F.concat("event_type", F.lit("*"))).otherwise(F.col("event_type"))
    return t.events.select(F.floor(n / 2000).alias("sheet"), n.alias("n"), F.lit("mark").alias("kind"), (x + move).alias("x"), y.alias("y"), F.concat(text, n.cast("string")).alias("text"))


# Equal texts stand for each other wherever they moved to; what is left pairs off by distance, and stands in one place by chance at times.
@query("join19_changed_labels", f"""WITH RECURSIVE l AS (SELECT event_id // 2000 sheet, event_id n, event_id * 29 % 100 / 100.0::DOUBLE x, event_id * 71 % 101 / 101.0::DOUBLE y, CASE WHEN event_id % 10 = 3 THEN 0.025::DOUBLE ELSE 0.002::DOUBLE END move FROM events WHERE event_id % 7 = 2),
  edges AS (SELECT a.sheet, a.n a, b.n b, round(abs(a.x - (b.x + b.move)) + abs(a.y - b.y), 9) distance FROM l a JOIN l b ON a.sheet = b.sheet AND abs(a.x - (b.x + b.move)) <= 0.015 AND abs(a.y - b.y) <= 0.015),
  {greedy_sql('edges', 'sheet', 'a', 'b', 'distance, a, b')} SELECT sheet, a, b FROM picked""")
def join19(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = Tables(spark, sf_dir)
    return O.changed_labels(labels(t, 0), labels(t, 1), ["sheet"]).select("sheet", "a", "b")


@query("join23_line_errors")
def join23(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of a conversation as reference lines; as read, some lost letters and one in nine is missing."""
    c = Tables(spark, sf_dir).conversations.select(F.col("conv_id").alias("page"), F.col("turn").alias("n"), "text")
    lost = (F.col("page") * 100 + F.col("n")) % 9 == 0
    read = c.filter(~lost).select("page", "n", F.when(F.col("n") % 2 == 0, F.regexp_replace("text", "a", "")).otherwise(F.col("text")).alias("text"))
    return O.line_errors(c, read, ["page"])


@query("str32_salvaged_lists", "SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 1 ELSE 2 END items, event_id % 7 AS first FROM events")
def str32(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers with a JSON list in prose; of a third of them the list breaks off in its second object."""
    n = F.col("event_id")
    item = lambda v: F.to_json(F.struct(v.alias("k"), F.lit('a "b} {c').alias("t")))
    whole = F.concat(F.lit("Вот список: ["), item(n % 7), F.lit(", "), item(n % 5))
    answer = F.when(n % 3 == 0, whole.substr(F.lit(1), F.length(whole) - 4)).otherwise(F.concat(whole, F.lit("] Готово.")))
    rows = Tables(spark, sf_dir).events.select("event_id", T.salvaged(answer, "k BIGINT, t STRING").alias("x"))
    return rows.select("event_id", F.size("x").alias("items"), F.get("x", F.lit(0))["k"].alias("first"))


@query("ext16_title_blocks", """WITH b AS (SELECT l_orderkey page, l_linenumber n, l_quantity / 50 x, l_tax * 12.5 y FROM lineitem) SELECT page, count(*) words FROM b WHERE x BETWEEN 0.5 AND 1 AND y BETWEEN 0.68 AND 1 GROUP BY 1""")
def ext16(spark: SparkSession, sf_dir: str) -> DataFrame:
    x, y = F.col("l_quantity") / 50, F.col("l_tax") * 12.5
    words = Tables(spark, sf_dir).lineitem.select(F.col("l_orderkey").alias("page"), F.col("l_linenumber").alias("n"), F.lit("слово").alias("text"), x.alias("x0"), y.alias("y0"), x.alias("x1"), y.alias("y1"))
    return O.region_text(words, ["page"]).select("page", F.regexp_count("text", F.lit("слово")).cast("long").alias("words"))


@query("ext18_equipment_gap", """WITH e AS (SELECT l_suppkey % 4 page, l_partkey room, l_quantity x, l_tax * 100 y, l_linenumber % 3 s FROM lineitem), r AS (SELECT page, room, min(x) x, min(y) y FROM e GROUP BY 1, 2)
  SELECT page, room FROM r WHERE EXISTS (SELECT 1 FROM e WHERE e.page = r.page AND s = 1 AND sqrt((e.x - r.x) ** 2 + (e.y - r.y) ** 2) <= 0.9) AND NOT EXISTS (SELECT 1 FROM e WHERE e.page = r.page AND s = 2 AND sqrt((e.x - r.x) ** 2 + (e.y - r.y) ** 2) <= 0.9)""")
def ext18(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = Tables(spark, sf_dir).lineitem.select((F.col("l_suppkey") % 4).alias("page"), F.col("l_partkey").alias("room"), F.col("l_quantity").alias("x"), (F.col("l_tax") * 100).alias("y"), (F.col("l_linenumber") % 3).alias("s"))
    rooms = e.groupBy("page", "room").agg(F.min("x").alias("x"), F.min("y").alias("y"))
    return O.equipment_gap(rooms, e.filter("s = 1"), e.filter("s = 2"), ["page"], 0.9)


@query("ext12_fallback_values", """WITH v AS (SELECT vec_id, label, embedding::DOUBLE[] v FROM embeddings), a AS (SELECT label, v FROM v WHERE vec_id IN (SELECT min(vec_id) FROM embeddings GROUP BY label)),
  c AS (SELECT v.vec_id, a.label, round(list_cosine_similarity(v.v, a.v), 6) s FROM v, a), w AS (SELECT * FROM c WHERE s >= 0.1 QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY s DESC, label) = 1),
  f AS (SELECT vec_id % 20 doc_id, label, s, vec_id, vec_id % 13 + CASE WHEN vec_id % 4 = 0 THEN 0.5 ELSE 0 END x, CASE WHEN vec_id % 3 = 0 THEN 'len' END u FROM w WHERE NOT (vec_id % 20 = 7 AND label % 2 = 0))
  SELECT doc_id, 'p' || label code, arg_max(x, (s, -vec_id)) AS value, max(s) similarity FROM f WHERE u IS NOT DISTINCT FROM CASE WHEN label % 2 = 0 THEN 'len' END AND x BETWEEN 1 AND 10 AND (label % 3 <> 0 OR x = floor(x)) GROUP BY 1, 2""")
def ext12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors as candidates of twenty documents; each label's first vector stands for a parameter."""
    from stagewise.operators.extract import fallback_values

    t = Tables(spark, sf_dir)
    k, label = F.col("vec_id"), F.col("label")
    v = t.embeddings.select("vec_id", "label", F.col("embedding").cast("array<double>").alias("vector"))
    anchors = t.embeddings.groupBy("label").agg(F.min("vec_id").alias("vec_id")).join(v.drop("label"), "vec_id")
    code = F.concat(F.lit("p"), label.cast("string"))
    params = anchors.select(code.alias("code"), "vector", F.when(label % 2 == 0, "len").alias("unit"), F.lit(1.0).alias("low"), F.lit(10.0).alias("high"), (label % 3 == 0).alias("integer"))
    candidates = v.select((k % 20).alias("doc_id"), k.alias("id"), "vector", ((k % 13) + F.when(k % 4 == 0, 0.5).otherwise(0.0)).alias("value"), F.when(k % 3 == 0, "len").alias("unit"))
    found = v.select(F.lit(7).cast("long").alias("doc_id"), "label").distinct().filter("label % 2 = 0").select("doc_id", code.alias("code"))
    return fallback_values(candidates, found, params, least=0.1)


FACTS = (
    "Абсолютная отметка пола 120,5 м. Относительная отметка 0,000 соответствует абсолютной отметке 134,2 м", "Расход горячей воды 12,5 м3/сут. Расход воды на полив 90 м3/сут. Общий расход горячей воды 14 м3/сут; Хозяйственно-питьевой расход 30 м3/сут",
    "Ширина двери 1,2 м. Двери эвакуационные 0,9 м. Дверь шкафа 0,3 м",
)


@query("ext05_ext06_ext07_facts", """SELECT p_partkey doc_id, x.code, x.key, x."value", x.raws FROM part, (VALUES (0, 'zero_level', NULL, 134.2, '134,2'), (1, 'daily_flow', 'Т3', 14.0, '12,5, 14'), (1, 'daily_flow', 'В1', 30.0, '30'), (2, 'door_width', NULL, 0.9, '0,9, 1,2')) x(n, code, key, "value", raws) WHERE p_partkey % 3 = x.n""")
def ext05(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentences of which some are about other things: the level that isn't of zero, water for the garden, a cupboard's door."""
    from stagewise.operators import extract as X

    pages = Tables(spark, sf_dir).part.select(F.col("p_partkey").alias("doc_id"), F.lit(1).alias("page"), F.element_at(F.array(*map(F.lit, FACTS)), (F.col("p_partkey") % 3 + 1).cast("int")).alias("text"))
    return X.chosen_values(X.rule_values(pages)).select("doc_id", "code", "key", "value", "raws")


# A line for each event, seven a page, of ten pixels a character, read in four tiles: two columns and two rows that overlap by 160 pixels.
@query("ext17_seams", """WITH l AS (SELECT event_id // 7 page, event_id % 7 + 1 n, 100 + 20 * (event_id * 37 % 21) x, 50 + 2 * (event_id * 13 % 39) size, sha256(event_id::VARCHAR) || sha256('x' || event_id) t FROM events)
  SELECT page, n AS line, x::DOUBLE x0, (x + 10 * size)::DOUBLE x1, substr(t, 1, size::INT) AS text FROM l""")
def ext17_seams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines cut by the seams of tiles come back whole, each once."""
    c = F.col
    e, k = c("event_id"), c("event_id").cast("string")
    lines = Tables(spark, sf_dir).events.select(
        F.floor(e / 7).alias("page"), (e % 7 + 1).alias("line"), (100 + 20 * (e * 37 % 21)).alias("x"), (50 + 2 * (e * 13 % 39)).cast("int").alias("size"), F.concat(F.sha2(k, 256), F.sha2(F.concat(F.lit("x"), k), 256)).alias("t"),
    )
    tiles = F.array(*(F.struct(F.lit(x).alias("x0"), F.lit(y).alias("y0"), F.lit(x + 1000).alias("x1"), F.lit(y + 280).alias("y1")) for x in (0, 840) for y in (0, 120)))
    seen = lines.select("*", F.posexplode(tiles).alias("tile", "b")).withColumn("y", 40 * c("line"))
    first, last = F.greatest(F.ceil((c("b.x0") - c("x")) / 10), F.lit(0)), F.least(F.floor((c("b.x1") - c("x")) / 10), c("size"))
    seen = seen.withColumn("from", first).withColumn("to", last).filter("to > from AND y >= b.y0 AND y < b.y1")
    pieces = seen.select(
        "page", (c("line") * 4 + c("tile")).alias("n"), (c("x") + 10 * c("from")).alias("x0"), c("y").alias("y0"), (c("x") + 10 * c("to")).alias("x1"), F.least(c("y") + 20, c("b.y1")).alias("y1"),
        F.substring("t", (c("from") + 1).cast("int"), (c("to") - c("from")).cast("int")).alias("text"), (0.9 - c("tile") / 100).alias("confidence"),
        *(c(f"b.{s}").alias(f"tile_{s}") for s in ("x0", "y0", "x1", "y1")), F.lit(1840).alias("width"), F.lit(400).alias("height"),
    )
    return O.stitched_lines(pieces, ["page"]).select("page", F.round(c("y0") / 40).cast("long").alias("line"), "x0", "x1", "text")


# Rooms of a sheet stand in rows a tenth of it apart, marks above them and a little aside; hundredths and thousandths, so none is as far as a limit.
SCHEME_SQL = """e AS (SELECT event_id // 40 doc, event_id // 20 % 2 page, event_id n, event_id * 31 % 101 a, event_id * 17 % 89 b FROM events),
  r AS (SELECT doc, page, n, 'r' || a % 30 room, a % 7 = 0 chamber, a / 100.0::DOUBLE x, (10 * (1 + n % 3) + b % 3) / 100.0::DOUBLE y FROM e),
  m AS (SELECT doc, page, n, (a + b % 7 - 3) / 100.0::DOUBLE + 0.004 x, (10 * (n % 4) + b % 5) / 100.0::DOUBLE + 0.003 y, CASE b % 3 WHEN 0 THEN ['П' || b % 9] WHEN 1 THEN ['П' || b % 9, 'В1'] ELSE ['П1'] END systems FROM e),
  f AS (SELECT m.*, (SELECT min(y) FROM r WHERE r.doc = m.doc AND r.page = m.page AND r.y > m.y) AS row FROM m),
  a AS (SELECT f.doc, f.page, f.n, arg_min(r.room, {'d': round(abs(r.x - f.x), 9), 'n': r.n}) room FROM f JOIN r ON r.doc = f.doc AND r.page = f.page AND r.y >= f.row AND r.y - f.row < 0.025 AND abs(r.x - f.x) < 0.03 WHERE f.row - f.y <= 0.12 GROUP BY ALL),
  b AS (SELECT m.doc, m.page, m.n, arg_min(r.room, {'d': round(abs(r.x - m.x), 9), 'n': r.n}) room FROM m JOIN r ON r.doc = m.doc AND r.page = m.page AND r.chamber WHERE len(list_filter(m.systems, lambda s: s[1] <> 'П')) = 0 AND NOT EXISTS (FROM a WHERE a.doc = m.doc AND a.page = m.page AND a.n = m.n) GROUP BY ALL),
  u AS (SELECT DISTINCT doc, page, room, unnest(systems) s FROM (FROM a UNION ALL FROM b) JOIN m USING (doc, page, n)),
  g AS (SELECT doc, room, page, count(*) c FROM u GROUP BY ALL),
  t AS (SELECT doc, room, arg_max(page, {'c': c, 'p': -page}) page FROM g GROUP BY ALL),
  k AS (SELECT doc, room, arg_max(chamber, {'p': -page, 'n': -n}) chamber FROM r GROUP BY ALL)"""


@query("ext11_scheme_systems", f"""WITH {SCHEME_SQL} SELECT doc, room, t.page, chamber, string_agg(DISTINCT s, ',' ORDER BY s) systems FROM u JOIN k USING (doc, room) JOIN t USING (doc, room) WHERE NOT chamber OR s[1] = 'П' GROUP BY ALL""")
def ext11_scheme(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Systems of each room of a document from the marks above the rows of its schemes."""
    c = F.col
    n = c("event_id")
    e = Tables(spark, sf_dir).events.select(F.floor(n / 40).alias("doc"), (F.floor(n / 20) % 2).alias("page"), n.cast("long").alias("n"), (n * 31 % 101).alias("a"), (n * 17 % 89).alias("b"))
    rooms = e.select("doc", "page", "n", F.concat(F.lit("r"), (c("a") % 30).cast("string")).alias("room"), (c("a") % 7 == 0).alias("chamber"), (c("a") / 100).alias("x"), ((10 * (1 + c("n") % 3) + c("b") % 3) / 100).alias("y"))
    mark = F.concat(F.lit("П"), (c("b") % 9).cast("string"))
    text = F.when(c("b") % 3 == 0, mark).when(c("b") % 3 == 1, F.concat(mark, F.lit(" B1"))).otherwise("П1")
    marks = e.select("doc", "page", "n", L.systems(text).alias("systems"), ((c("a") + c("b") % 7 - 3) / 100 + 0.004).alias("x"), ((10 * (c("n") % 4) + c("b") % 5) / 100 + 0.003).alias("y"))
    assigned = O.scheme_marks(rooms, marks, ["doc", "page"])
    return O.room_systems(assigned, marks, rooms, ["doc"], "page").select("doc", "room", "page", "chamber", F.array_join("systems", ",").alias("systems"))
