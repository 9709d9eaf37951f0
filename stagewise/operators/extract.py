"""Values of parameters in page texts, by rules given as a table."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stagewise.functions.text import first_match, lookalike

NUMBER = r"(\d+(?:[.,]\d+)?)"


@dataclass(frozen=True)
class Rule:
    """Text around a value (one group), the plausible range and which of several values counts.

    All is looked for within a sentence: one that has ``exclude`` or lacks ``require`` gives no value, and
    ``keys`` (name, pattern) say what the value belongs to, by the first pattern that the sentence has.
    """

    code: str
    pattern: str
    low: float
    high: float
    pick: str = "first"  # first, min or max of a document
    exclude: str | None = None
    require: str | None = None
    keys: tuple[tuple[str, str], ...] = ()


# Words that introduce a value, what rules it out, what it belongs to, and plausible ranges.
WATER_SYSTEMS = (("В1", r"(?iU)хозяйственно|питьев"), ("Т3", r"(?iU)горяч"), ("К1", r"(?iU)водоотвед|канализац|сток"))
RULES = (
    Rule("useful_area", rf"(?iU)полезн\w*\s+площад\w*[^\d]{{0,40}}{NUMBER}", 100, 1e7),
    Rule("zero_level", rf"(?iU)отметк\w*[^\d]{{0,60}}{NUMBER}\s*м\b", 20, 500, require=r"(?iU)нул[яюе]|0[.,]000"),
    Rule("daily_flow", rf"(?iU)расход[^\d]{{0,80}}{NUMBER}\s*м3/сут", 0, 1e6, "max", r"(?iU)пожаротуш|полив|подпитк", keys=WATER_SYSTEMS),
    Rule("door_width", rf"(?iU)двер\w*[^\d]{{0,40}}{NUMBER}\s*м\b", 0.5, 5, "min"),
    Rule("slab_thickness", rf"(?iU)(?:плит|ростверк)\w*[^\d]{{0,40}}{NUMBER}\s*мм", 300, 4000, "min"),
    Rule("outlet_diameter", rf"(?iU)выпуск\w*[^\d]{{0,40}}{NUMBER}\s*мм", 50, 1000, "max"),
)
SENTENCE = r"(?<=[.;!?])\s+(?=[\p{Lu}«\"])"


def rule_values(pages: DataFrame, rules: Sequence[Rule] = RULES, document: str = "doc_id", page: str = "page", text: str = "text") -> DataFrame:
    """(document, page, code, place, raw, value, key): all that each rule finds, in order.

    All rules read a page once; a document's choice among values is :func:`chosen_values`.
    """
    none = F.expr("CAST(array() AS array<struct<code:string,place:int,raw:string,value:double,key:string>>)")
    sentences = F.split(F.col(text), SENTENCE)

    def values_of(r: Rule):
        key = lambda s: first_match(s, [(pattern, name) for name, pattern in r.keys]) if r.keys else F.lit(None).cast("string")

        def of(s):
            fits = F.lit(True)
            if r.exclude:
                fits = fits & ~s.rlike(r.exclude)
            if r.require:
                fits = fits & s.rlike(r.require)
            found = F.transform(F.regexp_extract_all(s, F.lit(r.pattern), F.lit(1)), lambda v: F.struct(v.alias("raw"), key(s).alias("key")))
            return F.when(fits, found).otherwise(F.slice(found, 1, 0))

        values = F.flatten(F.transform(sentences, of))
        named = F.transform(values, lambda v, i: F.struct(F.lit(r.code).alias("code"), i.alias("place"), v["raw"].alias("raw"), F.translate(v["raw"], ",", ".").cast("double").alias("value"), v["key"].alias("key")))
        return F.coalesce(F.filter(named, lambda x: x["value"].between(r.low, r.high)), none)

    every = F.flatten(F.array(*map(values_of, rules)))
    return pages.select(document, page, F.explode(every).alias("x")).select(document, page, "x.*")


def chosen_values(values: DataFrame, rules: Sequence[Rule] = RULES, document: str = "doc_id", page: str = "page") -> DataFrame:
    """One value for each document, code and key: the first, the least or the greatest, ties by place and value.

    ``raws`` joins the distinct values as they stand, from the least. One aggregation.
    """
    way = F.create_map(*(x for r in rules for x in (F.lit(r.code), F.lit({"first": 0.0, "min": 1.0, "max": -1.0}[r.pick]))))
    order = F.struct((F.element_at(way, F.col("code")) * F.col("value")).alias("w"), F.col(page).alias("p"), "place", "value", "raw")
    raws = F.array_join(F.transform(F.array_sort(F.collect_set(F.struct("value", "raw"))), lambda x: x["raw"]), ", ")
    best = values.groupBy(document, "code", "key").agg(F.min(order).alias("m"), raws.alias("raws"))
    return best.select(document, "code", "key", F.col("m.value").alias("value"), F.col("m.raw").alias("raw"), F.col("m.p").alias(page), "raws")


def fallback_values(candidates: DataFrame, found: DataFrame, params: DataFrame, document: str = "doc_id", least: float = 0.5) -> DataFrame:
    """(document, code, value, similarity): for parameters without a value of a rule, the candidate nearest in meaning.

    ``candidates`` has document, id, vector, value and unit; ``params`` has code, vector, unit, low, high and
    integer. Each candidate goes to its nearest parameter only; its unit must be the parameter's, its value
    plausible and, if asked, whole; a document keeps one value of a parameter. Ties go to the least id.
    """
    from .matching import nearest_anchor

    numbered = params.withColumn("n", F.row_number().over(Window.orderBy("code")))  # a matrix of fixed size
    owner = nearest_anchor(candidates, numbered.select(F.col("n").alias("owner"), F.col("vector").alias("anchor")), "id", "vector", "owner", "anchor").filter(F.col("similarity") >= least)
    known = candidates.drop("vector").join(owner, "id").join(F.broadcast(numbered.select(F.col("n").alias("owner"), "code", F.col("unit").alias("wanted"), "low", "high", "integer")), "owner")
    fits = F.col("unit").eqNullSafe(F.col("wanted")) & F.col("value").between(F.col("low"), F.col("high")) & (~F.col("integer") | (F.col("value") == F.floor("value")))
    free = known.filter(fits).join(found.select(document, "code"), [document, "code"], "left_anti")
    best = free.groupBy(document, "code").agg(F.max(F.struct("similarity", (-F.col("id")).alias("less"), "value")).alias("m"))
    return best.select(document, "code", F.col("m.value").alias("value"), F.col("m.similarity").alias("similarity"))


# Strength classes of concrete.
CONCRETE = (
    "B3.5", "B5", "B7.5", "B10", "B12.5", "B15", "B20", "B22.5", "B25", "B27.5", "B30", "B35", "B40", "B45", "B50", "B55", "B60",
)


def concrete_classes(text):
    """The known strength classes that a text names, in order, each once; a small letter before a number is a preposition."""
    found = F.regexp_extract_all(text, F.lit(r"(?<![\p{L}\d])[BВ]\s?\d{1,3}(?:[.,]5)?(?![\d\p{L}])"), F.lit(0))
    return F.array_distinct(F.filter(F.transform(found, lambda x: F.translate(F.regexp_replace(lookalike(x), r"\s", ""), ",", ".")), lambda x: x.isin(*CONCRETE)))


# A strength class as written, what heads a specification and what names an act, and how far a name reaches:
# cells to the left, characters before, pages after.
GRADE = r"(?<![\p{L}\d])[BВ]\s?\d{1,3}(?:[.,]5)?(?![\d\p{L}])"
SPECIFICATION, ACT = r"(?iU)специфика\w*\s+(?:материал|элемент)", r"[АA][КK][ТT]\s+(?:№\s*\S+\s+)?освидетельствования"
CELLS_LEFT, CHARACTERS_BEFORE, PAGES_AFTER = 4, 220, 4


def element_classes(cells: DataFrame, blocks: DataFrame, document: str = "doc_id", page: str = "page") -> DataFrame:
    """(document, page, element, class, method): which element each strength class belongs to, once a page.

    ``cells`` and ``blocks`` have document, page, x0, y0, x1, y1 and text. The name nearest to a class counts: in its
    cell, in the few cells before it in its row, in the lowest specification title above it in its column (``table``),
    or in the sentence before it in a text (``text``). A page without any takes the element that the last pages of
    an act named (``context``): from the first page on that names an act.
    """
    from stagewise import scratch
    from stagewise.functions import lexicon as L

    from .matching import banded

    keys = [document, page]
    once = lambda c: F.explode(F.array(c))  # noqa: E731  a filter on the column does not name it a second time
    box = ["x0", "y0", "x1", "y1"]
    rows = banded(cells.select(*keys, *box, "text"), keys, "y0", "y1", ["y0", "x0"])
    before = F.array_join(F.collect_list("text").over(Window.partitionBy(*keys, "band").orderBy("x0", "y0").rowsBetween(-CELLS_LEFT, -1)), " ")
    graded = rows.withColumn("before", before).withColumn("class", F.explode(concrete_classes(F.col("text")))).withColumn("near", once(F.coalesce(L.element(F.col("text")), L.element(F.col("before")))))
    graded = scratch.table(graded.select(*keys, *box, "class", "near"), "graded")
    titles = blocks.filter(F.col("text").rlike(SPECIFICATION)).select(*keys, F.col("x0").alias("tx0"), F.col("x1").alias("tx1"), F.col("y1").alias("ty"), once(L.element(F.col("text"))).alias("title")).filter("title IS NOT NULL")
    named = graded.filter("near IS NOT NULL").select(*keys, F.col("near").alias("element"), "class")
    alone = graded.filter("near IS NULL").join(titles, keys).filter((F.col("ty") <= F.col("y1")) & (F.col("tx0") <= F.col("x1")) & (F.col("tx1") >= F.col("x0")))
    by_title = alone.groupBy(*keys, *box, "class").agg(F.max_by("title", F.struct("ty", "title")).alias("element")).select(*keys, "element", "class")

    found = F.regexp_extract_all("text", F.lit(GRADE), F.lit(0))
    parts = F.split("text", GRADE)
    start = lambda i: F.aggregate(F.slice(F.transform(F.arrays_zip(parts.alias("p"), found.alias("m")), lambda x: F.length(F.concat(x["p"], F.coalesce(x["m"], F.lit(""))))), F.lit(1), i), F.lit(0), lambda n, x: n + x) + F.length(F.get(parts, i))
    heads = F.transform(found, lambda m, i: F.struct(m.alias("m"), F.col("text").substr(F.greatest(start(i) - CHARACTERS_BEFORE + 1, F.lit(1)), F.least(start(i), F.lit(CHARACTERS_BEFORE))).alias("head")))
    in_text = blocks.filter(F.col("text").rlike(GRADE)).select(*keys, F.explode(heads).alias("h"))
    in_text = in_text.select(*keys, "h", F.explode(concrete_classes(F.col("h.m"))).alias("class")).select(*keys, once(L.element(F.col("h.head"))).alias("element"), "class").filter("element IS NOT NULL")
    own = named.unionByName(by_title).withColumn("method", F.lit("table")).unionByName(in_text.withColumn("method", F.lit("text")))
    own = scratch.table(own.groupBy(*keys, "element", "class").agg(F.min("method").alias("method")), "own")

    none = F.lit(None)
    texts = blocks.withColumn("named", once(L.element(F.col("text")))).select(*keys, "x0", "y0", "text", "named")
    texts = texts.unionByName(cells.select(*keys).distinct().select(*keys, none.cast("double").alias("x0"), none.cast("double").alias("y0"), F.lit("").alias("text"), none.cast("string").alias("named")))
    pages = texts.groupBy(*keys).agg(F.bool_or(F.col("text").rlike(ACT)).alias("act"), F.min(F.when(F.col("named").isNotNull(), F.struct("y0", "x0", "named"))).alias("n"))
    so_far = Window.partitionBy(document).orderBy(page).rowsBetween(Window.unboundedPreceding, 0)
    pages = pages.withColumn("in_act", F.max("act").over(so_far)).withColumn("last", F.last(F.when(F.col("in_act") & F.col("n").isNotNull(), F.struct(F.col(page).alias("at"), F.col("n.named").alias("element"))), True).over(so_far))
    pages = pages.filter(F.col("in_act") & (F.col(page) - F.col("last.at") <= PAGES_AFTER)).select(*keys, F.col("last.element").alias("element"))
    pages = pages.join(own.select(*keys).distinct(), keys, "left_anti")
    every = cells.select(*keys, "text").unionByName(blocks.select(*keys, "text")).select(*keys, F.explode(concrete_classes(F.col("text"))).alias("class")).distinct()
    return own.unionByName(every.join(pages, keys).select(*keys, "element", "class", F.lit("context").alias("method")))
