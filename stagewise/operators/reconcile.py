"""The reconciliation core: control points over stages, comparators and the verdict cascade."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

STAGES = ("PD", "RD", "ID")
EPS = 1e-9

# Verdicts of a check.
NEGATIVE, CANDIDATE, MISSING = "NEGATIVE_VERIFIED", "CANDIDATE", "MISSING_EVIDENCE"
NOT_COMPARABLE, CLARIFY, NOT_APPLICABLE = "NOT_COMPARABLE", "CLARIFICATION_REQUIRED", "NOT_APPLICABLE"
# Metres in a unit of length.
LENGTHS = {"мм": 0.001, "см": 0.01, "м": 1.0}


def stage_rank(stage: Column) -> Column:
    """PD, RD, ID as 0, 1, 2; anything else last."""
    at = F.array_position(F.array(*map(F.lit, STAGES)), stage)
    return F.when(at > 0, at - 1).otherwise(F.lit(len(STAGES))).cast("int")


def required_stages(*sources: Column) -> Column:
    """Stages with a source text that isn't blank, in order; the first is the reference."""
    return F.array_compact(F.array(*(F.when(F.trim(s) != "", F.lit(n)) for n, s in zip(STAGES, sources, strict=True))))


def length_in(value: Column, unit: Column, target: Column) -> Column:
    """A length in the target unit; other units stay as they are."""
    table = F.create_map(*(x for k, v in LENGTHS.items() for x in (F.lit(k), F.lit(v))))
    a, b = F.element_at(table, unit), F.element_at(table, target)
    return F.when(a.isNotNull() & b.isNotNull() & (unit != target), value * a / b).otherwise(value)


def rounding_step(places: Column) -> Column:
    """Half of the last of so many decimal places."""
    return F.lit(0.5) * F.pow(F.lit(10.0), -places)


def number_hit(
    expected: Column, actual: Column, direction: Column, percent: Column, absolute: Column, below: Column, above: Column, places: Column,
) -> Column:
    """Whether a number triggers; null if it can't be compared.

    A limit is tested on the actual value alone. Else the difference must exceed the rounding of the
    coarser value and go the trigger's way, and then the relative or the absolute threshold, if any.
    """
    diff = actual - expected
    wrong_way = ((direction == "down") & (diff > 0)) | ((direction == "up") & (diff < 0))
    relative = F.when(expected == 0, F.lit(float("inf"))).otherwise(F.abs(diff) / F.abs(expected) * 100)
    return (
        F.when(actual.isNull(), F.lit(None).cast("boolean"))
        .when(below.isNotNull() | above.isNotNull(), F.coalesce(actual < below - EPS, F.lit(False)) | F.coalesce(actual > above + EPS, F.lit(False)))
        .when(expected.isNull(), F.lit(None).cast("boolean"))
        .when(F.abs(diff) <= rounding_step(places) + EPS, F.lit(False))
        .when(wrong_way, F.lit(False))
        .when(percent.isNotNull(), relative > percent + EPS)
        .when(absolute.isNotNull(), F.abs(diff) > absolute + EPS)
        .otherwise(F.lit(True))
    )


def enum_hit(scale: Column, expected: Column, actual: Column, direction: Column) -> Column:
    """Steps along an ordered scale; null if a value isn't on it."""
    e, a = F.array_position(scale, expected), F.array_position(scale, actual)
    steps = a - e
    return F.when((e == 0) | (a == 0), F.lit(None).cast("boolean")).otherwise(
        (steps != 0) & ~((direction == "down") & (steps > 0)) & ~((direction == "up") & (steps < 0))
    )


def boolean_hit(expected: Column, actual: Column, direction: Column) -> Column:
    """A changed flag; ``down`` is from there to not there."""
    return (expected != actual) & ~((direction == "down") & actual) & ~((direction == "up") & ~actual)


def shift_hit(expected: Column, actual: Column, absolute: Column) -> Column:
    """Euclidean distance of coordinate vectors over the limit (0 if none); null if they don't fit."""
    square = F.aggregate(F.zip_with(expected, actual, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)
    fits = (F.size(expected) == F.size(actual)) & (F.size(expected) >= 2)
    return F.when(fits, F.sqrt(square) > F.coalesce(absolute, F.lit(0.0)) + EPS)


def missing_codes(expected: Column, actual: Column) -> Column:
    """Codes expected and not found; a code also counts as found if one is the other with a suffix."""
    same = lambda x, y: (x == y) | F.startswith(x, y) | F.startswith(y, x)
    return F.filter(expected, lambda x: ~F.exists(actual, lambda y: same(x, y)))


# A ventilation system's code: supply or exhaust, natural ones also without a number.
SYSTEM_CODE, NATURAL = r"^(?:[ВП]Е(?:\d+(?:\.\d+)*)?|[ВП]\d+(?:\.\d+)*|[ВП])$", ("ВЕ", "ПЕ")
DRAWN_CODE, MEANT_CODE = "BE", "ВЕ"


def code_list(text: Column) -> Column:
    """The different system codes that a text lists between commas; null if any part is none."""
    parts = F.transform(F.split(text, ","), lambda x: F.translate(F.upper(F.regexp_replace(x, r"\s+", "")), DRAWN_CODE, MEANT_CODE))
    return F.when(F.forall(parts, lambda x: x.rlike(SYSTEM_CODE)), F.array_distinct(parts))


def absent_codes(own: Column, other: Column) -> Column:
    """Codes of ``own`` that ``other`` hasn't, neither as such nor as the whole or a part of a group or a natural one with its number.

    A code of ``other`` that stands in ``own`` by itself is that one's partner and nobody else's.
    """
    number = r"^\d+(?:\.\d+)*$"
    bare = lambda x, y: x.isin(*NATURAL) & F.startswith(y, x) & F.substring(y, F.lit(3), F.length(y)).rlike(number)
    like = lambda x, y: F.startswith(x, F.concat(y, F.lit("."))) | F.startswith(y, F.concat(x, F.lit("."))) | bare(x, y) | bare(y, x)
    return F.filter(own, lambda x: ~F.array_contains(other, x) & ~F.exists(other, lambda y: like(x, y) & ~F.array_contains(own, y)))


def codes_hit(expected: Column, actual: Column, mode: Column) -> Column:
    """Whether a set of systems changed: ``any`` change counts, or only that some are ``lost``; null if either is no set."""
    lost, added = absent_codes(expected, actual), absent_codes(actual, expected)
    return F.when(expected.isNotNull() & actual.isNotNull(), (F.size(lost) > 0) | ((mode == "any") & (F.size(added) > 0)))


def codes_delta(expected: Column, actual: Column) -> Column:
    """``−П2, −В1; +В3``: what was lost and what was added; null without a change."""
    signed = lambda codes, sign: F.array_join(F.transform(codes, lambda x: F.concat(F.lit(sign), x)), ", ")
    text = F.array_join(F.filter(F.array(signed(absent_codes(expected, actual), "−"), signed(absent_codes(actual, expected), "+")), lambda x: x != ""), "; ")
    return F.nullif(text, F.lit(""))


def control_points(extractions: DataFrame, keys: Sequence[str], stage: str = "stage", value: str = "value", bad: str = "bad") -> DataFrame:
    """One row per control point: for each stage least and greatest value and count, and bad rows.

    A stage is ambiguous iff its least and greatest differ, so no set of values is ever gathered and
    the one shuffle carries partial aggregates.
    """
    of = lambda s: F.when(F.col(stage) == s, F.col(value))
    aggregates = [x for s in STAGES for x in (F.min(of(s)).alias(f"{s}_min"), F.max(of(s)).alias(f"{s}_max"), F.count(of(s)).alias(f"{s}_n"))]
    return extractions.groupBy(*keys).agg(*aggregates, F.count_if(F.col(bad)).alias("n_bad"), F.count("*").alias("n"))


def verdicts(points: DataFrame, params: DataFrame, param: str = "param") -> DataFrame:
    """Adds ``verdict``, ``completeness``, the chosen ``actual_stage`` and ``delta`` to control points.

    ``params`` has code, direction, percent, absolute, below, above, places, priority. The first stage
    is the reference. Of the two actual stages the first that triggers is chosen, else the first there is.
    """
    p = points.join(params, points[param] == params["code"], "left").drop("code")
    e, limited = F.col("PD_min"), F.col("below").isNotNull() | F.col("above").isNotNull()
    hit = {s: number_hit(e, F.col(f"{s}_min"), *map(F.col, ("direction", "percent", "absolute", "below", "above", "places"))) for s in ("RD", "ID")}
    ambiguous = lambda s: F.col(f"{s}_min") != F.col(f"{s}_max")
    no_actual = (F.col("RD_n") == 0) & (F.col("ID_n") == 0)
    any_hit = F.coalesce(hit["RD"], F.lit(False)) | F.coalesce(hit["ID"], F.lit(False))
    verdict = (
        F.when(F.col("n_bad") > 0, NOT_COMPARABLE)
        .when((F.col("PD_n") == 0) & ~limited, MISSING)
        .when(no_actual, MISSING)
        .when(F.coalesce(ambiguous("PD"), F.lit(False)), CLARIFY)
        .when(F.coalesce(ambiguous("RD"), F.lit(False)) | F.coalesce(ambiguous("ID"), F.lit(False)), CLARIFY)
        .when(any_hit, CANDIDATE)
        .otherwise(NEGATIVE)
    )
    chosen = F.when(F.coalesce(hit["RD"], F.lit(False)), "RD").when(F.coalesce(hit["ID"], F.lit(False)), "ID").when(F.col("RD_n") > 0, "RD").when(F.col("ID_n") > 0, "ID")
    p = p.withColumn("verdict", verdict).withColumn("actual_stage", chosen)
    return p.withColumn("completeness", F.when(F.col("verdict").isin(MISSING, NOT_COMPARABLE, CLARIFY), F.col("verdict")).otherwise("COMPLETE")).withColumn(
        "delta", F.when(F.col("actual_stage") == "RD", F.col("RD_min") - e).when(F.col("actual_stage") == "ID", F.col("ID_min") - e)
    )


def unplaced(points: DataFrame, keys: Sequence[str], rule_key: str) -> DataFrame:
    """Points without a rule key, over more than one stage, whose group also has points with one."""
    w = Window.partitionBy(*keys)
    stages = sum((F.col(f"{s}_n") > 0).cast("int") for s in STAGES)
    return points.withColumn("_keyed", F.max(F.col(rule_key).isNotNull()).over(w)).filter(F.col(rule_key).isNull() & F.col("_keyed") & (stages > 1)).drop("_keyed")


def finding_key(*parts: Column) -> Column:
    """sha1 of the parts joined by bars; null parts count as empty, not as absent."""
    return F.sha1(F.encode(F.concat_ws("|", *(F.coalesce(p.cast("string"), F.lit("")) for p in parts)), "UTF-8"))


def counters(df: DataFrame, verdict: str = "verdict", code: str = "param", keys: Sequence[str] = ()) -> DataFrame:
    """Distinct codes and one conditional count for each verdict; without keys always one row."""
    names = {"candidates": CANDIDATE, "negatives": NEGATIVE, "missing": MISSING, "not_comparable": NOT_COMPARABLE, "clarifications": CLARIFY, "not_applicable": NOT_APPLICABLE}
    return df.groupBy(*keys).agg(
        F.count_distinct(code).alias("params"), F.count("*").alias("checks"), *(F.count_if(F.col(verdict) == v).alias(n) for n, v in names.items())
    )


def compliance(negatives: Column, positives: Column) -> Column:
    """Percent of negatives, to one place with halves up; null without any."""
    total = negatives + positives
    return F.when(total > 0, F.floor(negatives / total * 1000 + 0.5) / 10)


def light(positives: Column, open_: Column, total: Column) -> Column:
    """Red if anything is confirmed, yellow if anything is open or nothing was checked, else green."""
    return F.when(positives > 0, "RED").when((open_ > 0) | (total == 0), "YELLOW").otherwise("GREEN")


def revision_roles(files: DataFrame, group: Sequence[str], authoritative: str, approved: str) -> DataFrame:
    """ACTUAL, SUPERSEDED or CONFLICT of each file of a revision group, and the reason.

    The only authoritative file supersedes the rest, else the only approved one does; a file alone is
    actual, and other groups are in conflict. Unknown authority is not false. Counts are partial
    aggregates joined back, so a large group needs no task of its own.
    """
    is_auth, is_approved = F.coalesce(F.col(authoritative), F.lit(False)), F.coalesce(F.col(approved), F.lit(False))
    sizes = files.groupBy(*group).agg(F.count("*").alias("_n"), F.count_if(is_auth).alias("_auth"), F.count_if(is_approved).alias("_approved"))
    keep = F.when(F.col("_n") == 1, True).when(F.col("_auth") == 1, is_auth).when(F.col("_approved") == 1, is_approved)
    reason = F.when(F.col("_n") == 1, "single").when(F.col("_auth") == 1, "authoritative").when(F.col("_approved") == 1, "approved").otherwise("ambiguous")
    rows = files.join(sizes, list(group))
    return rows.withColumn("role", F.when(keep, "ACTUAL").when(keep.isNull(), "CONFLICT").otherwise("SUPERSEDED")).withColumn("reason", reason).drop("_n", "_auth", "_approved")


def scenario(pd: Column, rd: Column, id_: Column) -> Column:
    """Which stages a set has."""
    count = pd.cast("int") + rd.cast("int") + id_.cast("int")
    return (
        F.when(count == 3, "FULL").when(pd & rd, "PD_RD_ONLY").when(pd & id_, "PD_ID_ONLY").when(rd & id_, "RD_ID_ONLY")
        .when(count == 1, "SINGLE_ONLY").otherwise("PARTIALLY_LOADED")
    )


def affected(params: DataFrame, changed: DataFrame, stage: str = "stage", marks: str = "marks") -> DataFrame:
    """Params to recompute for changed files: ``FULL`` if a file's stage is unknown, else those of a
    stage with an unreadable file and those that share a mark with a file of their stage."""
    wide = changed.filter(F.col(stage).isNotNull() & (F.coalesce(F.size(marks), F.lit(0)) == 0)).select(stage).distinct()
    by_mark = changed.select(stage, F.explode(marks).alias("mark")).distinct()
    unknown = changed.filter(F.col(stage).isNull()).limit(1)
    rows = params.withColumn("mark", F.explode_outer("marks"))
    hit = rows.join(by_mark, [stage, "mark"], "left_semi").select("code")
    hit = hit.union(params.join(wide, stage, "left_semi").select("code"))
    hit = hit.union(params.join(unknown.select(F.lit(True).alias("_any")), how="left_semi").select("code"))
    return hit.distinct()
