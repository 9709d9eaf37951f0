"""The whole comparison: files chosen among revisions, values compared by their kind, an outcome for every point.

Everything is expressed over aggregates of a control point: of each stage its first value in the order of
extraction, the least and greatest shown form (which differ iff the stage is ambiguous) and counts. No
point's values are ever gathered, however many there are.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stagewise.functions import text as T

from . import reconcile as R

# Approval states that leave a file out, and those that make it the one to compare with.
LEFT_OUT, REFERENCE = ("SUPERSEDED", "CANCELLED"), ("APPROVED", "FOR_CONSTRUCTION")
#: Columns of an extracted value, beside its keys, stage, position, ``bad`` and ``conflict``.
VALUE = ("num", "str", "flag", "coords", "unit", "places")
#: Columns of a matrix row that :func:`value_hit` reads; ``codes`` (any or lost) makes a text a set of systems.
PARAM = ("data_type", "parsed", "direction", "percent", "absolute", "below", "above", "trigger_unit", "unit", "scale", "codes")


def selected_files(files: DataFrame, owner: Sequence[str]) -> DataFrame:
    """Adds ``role`` and ``reason`` to files: which revision of each document is compared.

    ``files`` has the owner columns, file_id, stage, document_code, approval, authoritative (three
    states: unknown isn't false), excluded (a reason or null), predecessor_id and successor_id.

    - Without a known stage: UNRESOLVED.
    - Not authoritative: SUPERSEDED; of unknown authority: so if excluded or LEFT_OUT.
    - With a successor among the owner's files, unless authoritative: SUPERSEDED.
    - Of the others of one stage and document the only authoritative one stays, else the only one
      in REFERENCE, else all are in CONFLICT; a file alone, or without a code, is ACTUAL.
    """
    owner = list(owner)
    auth = F.col("authoritative")
    known = files.select(*owner, F.col("file_id").alias("_next"))
    links = files.filter("predecessor_id IS NOT NULL").select(*owner, F.col("predecessor_id").alias("file_id"))
    by_successor = files.select(*owner, "file_id", F.col("successor_id").alias("_next")).join(known, [*owner, "_next"], "left_semi").select(*owner, "file_id")
    replaced = links.unionByName(by_successor).distinct().withColumn("_replaced", F.lit(True))
    rows = files.join(replaced, [*owner, "file_id"], "left")
    out_by_status = auth.isNull() & (F.col("excluded").isNotNull() | F.coalesce(F.col("approval").isin(*LEFT_OUT), F.lit(False)))
    early = (
        F.when(~F.coalesce(F.col("stage").isin(*R.STAGES), F.lit(False)), F.struct(F.lit("UNRESOLVED").alias("role"), F.lit("stage unknown").alias("reason")))
        .when(~auth, F.struct(F.lit("SUPERSEDED").alias("role"), F.lit("excluded by hand").alias("reason")))
        .when(out_by_status, F.struct(F.lit("SUPERSEDED").alias("role"), F.coalesce("excluded", "approval").alias("reason")))
        .when(F.col("_replaced") & ~F.coalesce(auth, F.lit(False)), F.struct(F.lit("SUPERSEDED").alias("role"), F.lit("has a successor").alias("reason")))
    )
    rows = rows.withColumn("_early", early)
    group = [*owner, "stage", "_code"]
    rows = rows.withColumn("_code", F.nullif(T.norm_code(F.col("document_code")), F.lit("")))
    is_auth, is_reference = F.coalesce(auth, F.lit(False)), F.coalesce(F.col("approval").isin(*REFERENCE), F.lit(False))
    sizes = rows.filter("_early IS NULL AND _code IS NOT NULL").groupBy(*group).agg(
        F.count("*").alias("_n"), F.count_if(is_auth).alias("_auth"), F.count_if(is_reference).alias("_reference"),
    )
    rows = rows.join(sizes, group, "left")
    alone = F.coalesce(F.col("_n"), F.lit(1)) < 2
    keep = F.when(F.col("_auth") == 1, is_auth).when(F.col("_reference") == 1, is_reference)
    why = F.when(F.col("_auth") == 1, "authoritative").when(F.col("_reference") == 1, "approved").otherwise("ambiguous")
    role = F.when(alone | keep, "ACTUAL").when(keep.isNull(), "CONFLICT").otherwise("SUPERSEDED")
    return rows.select(
        *files.columns, F.coalesce(F.col("_early.role"), role).alias("role"),
        F.when(F.col("_early").isNotNull(), F.col("_early.reason")).when(alone, "single").otherwise(why).alias("reason"),
    )


def ambiguous_revisions(files: DataFrame, owner: Sequence[str]) -> DataFrame:
    """The (owner, stage, code, files) groups of :func:`selected_files` that are in conflict."""
    found = selected_files(files, owner).filter("role = 'CONFLICT'")
    return found.groupBy(*owner, "stage", T.norm_code(F.col("document_code")).alias("code")).agg(F.count("*").alias("files"))


def value_hit(p: dict[str, Column], e: Column, a: Column) -> Column:
    """Whether an actual value triggers against the expected one (null if there is none); null if they can't be compared.

    ``p`` has data_type, parsed, direction, percent, absolute, below, above, trigger_unit, unit and
    scale, and perhaps codes; values are structs of VALUE. Two sets of systems are compared as such. A number that is no number on both sides is compared as text;
    a limit needs no expected value; thresholds are converted to the values' unit.
    """
    null = F.lit(None).cast("boolean")
    numeric = p["data_type"].isin("number", "coordinate")
    shift = F.when(p["data_type"] == "coordinate", R.shift_hit(e["coords"], a["coords"], p["absolute"]))
    as_text = a["num"].isNull() & (e.isNull() | e["num"].isNull())
    unit = F.coalesce(a["unit"], e["unit"], p["unit"])
    converted = [R.length_in(p[k], p["trigger_unit"], unit) for k in ("absolute", "below", "above")]
    places = F.least(e["places"], a["places"])
    number = F.when(e.isNotNull() & e["num"].isNull(), null).otherwise(
        R.number_hit(e["num"], a["num"], p["direction"], p["percent"], *converted, F.coalesce(places, F.lit(0)))
    )
    same_text = T.key(e["str"]) == T.key(a["str"])
    sets = R.codes_hit(R.code_list(e["str"]), R.code_list(a["str"]), p["codes"])
    return (
        F.when(p["codes"].isNotNull() & sets.isNotNull(), sets)
        .when(numeric & a["num"].isNull() & shift.isNotNull(), shift)
        .when(numeric & ~as_text, F.when(p["parsed"], number))
        .when(e.isNull(), null)
        .when((p["data_type"] == "enum") & (F.size(p["scale"]) > 0), F.when(p["parsed"], R.enum_hit(p["scale"], e["str"], a["str"], p["direction"])))
        .when(p["data_type"] == "boolean", R.boolean_hit(e["flag"], a["flag"], p["direction"]))
        .otherwise(~same_text)
    )


def staged_points(extractions: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row per control point: of each stage its first value by ``pos``, least and greatest shown form; flags of all."""
    at = lambda s, x: F.when(F.col("stage") == s, x)
    value = F.struct("pos", "stage", *VALUE, "shown")
    parts = [x for s in R.STAGES for x in (F.min(at(s, value)).alias(s), F.min(at(s, F.col("shown"))).alias(f"{s}_lo"), F.max(at(s, F.col("shown"))).alias(f"{s}_hi"))]
    return extractions.groupBy(*keys).agg(*parts, F.bool_or("bad").alias("bad"), F.bool_or("conflict").alias("conflict"))


def outcomes(extractions: DataFrame, matrix: DataFrame, presence: DataFrame, owner: str = "object_id", param: str = "param", point: str = "point") -> DataFrame:
    """One row per control point: keys, verdict, completeness, expected, actual, actual_stage, delta, changed, comparisons.

    ``extractions`` has the keys, stage, pos, shown, bad, conflict and VALUE; ``matrix`` has code,
    stages (the required ones, the first is the reference) and PARAM (codes may lack); ``presence`` has the owner's
    ``present`` stages. Values of other stages than required don't count. Null points are one point of their parameter.

    - A matrix row with ``own`` marks of which the owner's ``marks`` (a column of ``presence``) have none is
      NOT_APPLICABLE; without marks on either side it applies.
    - A null point that could be compared while its parameter also has points with a place is not: it isn't known
      which place its values belong to, so it is CLARIFICATION_REQUIRED.
    - The pair shown (``expected`` and ``actual`` as they stand, ``delta`` of numbers, ``changed`` of sets) is the
      first one that triggers, else the first, in the order of extraction; ``comparisons`` has one for each actual
      stage, in the stages' order: (stage, value, delta, triggered).
    """
    for name, kind, at in (("codes", "string", "m"), ("own", "array<string>", "m"), ("marks", "array<string>", "p")):
        if at == "m" and name not in matrix.columns:
            matrix = matrix.withColumn(name, F.lit(None).cast(kind))
        if at == "p" and name not in presence.columns:
            presence = presence.withColumn(name, F.lit(None).cast(kind))
    rules = matrix.withColumnRenamed("code", param)
    rows = extractions.join(rules.select(param, "stages"), param).filter(F.array_contains("stages", F.col("stage"))).drop("stages")
    points = staged_points(rows, [owner, param, point]).join(rules, param).join(presence, owner, "left")
    p = {c: F.col(c) for c in PARAM}
    ref = F.get("stages", F.lit(0))
    pick = lambda suffix: F.coalesce(*(F.when(ref == s, F.col(f"{s}{suffix}")) for s in R.STAGES))
    spread = lambda s: F.coalesce(F.col(f"{s}_lo") != F.col(f"{s}_hi"), F.lit(False))
    points = points.withColumn("e", pick("")).withColumn("placed", F.max(F.col(point).isNotNull()).over(Window.partitionBy(owner, param)))
    # the hit of each stage is a column of its own, so that no expression of all kinds is repeated
    for s in R.STAGES:
        points = points.withColumn(f"{s}_hit", F.when(F.col(s).isNotNull() & (ref != s), value_hit(p, F.col("e"), F.col(s))))
    tried = (F.when((ref != s) & F.col(s).isNotNull(), F.struct(F.col(f"{s}.pos").alias("pos"), F.lit(s).alias("stage"), F.col(f"{s}.num").alias("num"), F.col(f"{s}.str").alias("str"), F.col(f"{s}.shown").alias("shown"), F.col(f"{s}_hit").alias("hit"))) for s in R.STAGES)
    points = points.withColumn("by_stage", F.array_compact(F.array(*tried)))
    points = points.withColumn("tried", F.array_sort("by_stage"))
    limit_only = F.col("below").isNotNull() | F.col("above").isNotNull()
    missing = lambda stages: F.coalesce(F.size(F.array_intersect(stages, F.col("present"))) == 0, F.lit(True))
    others = F.filter("stages", lambda s: s != ref)
    first = F.coalesce(F.get(F.filter("tried", lambda x: x["hit"]), F.lit(0)), F.get("tried", F.lit(0)))
    verdict = (
        F.when(~F.coalesce(F.arrays_overlap("own", "marks"), F.lit(True)), R.NOT_APPLICABLE)
        .when(F.col("conflict"), R.CLARIFY)
        .when(F.col("bad"), R.NOT_COMPARABLE)
        .when(F.col("e").isNull() & ~limit_only, F.when(missing(F.array(ref)), R.MISSING).otherwise(R.NOT_COMPARABLE))
        .when(F.size("tried") == 0, F.when((F.size(others) > 0) & missing(others), R.MISSING).otherwise(R.NOT_COMPARABLE))
        .when(F.col(point).isNull() & F.col("placed") & (F.size("tried") + F.col("e").isNotNull().cast("int") > 1), R.CLARIFY)
        .when(spread("PD") | spread("RD") | spread("ID"), R.CLARIFY)
        .when(F.exists("tried", lambda x: x["hit"].isNull()), R.NOT_COMPARABLE)
        .when(F.exists("tried", lambda x: x["hit"]), R.CANDIDATE)
        .otherwise(R.NEGATIVE)
    )
    done = points.withColumn("verdict", verdict).withColumn("chosen", F.when(F.col("verdict").isin(R.CANDIDATE, R.NEGATIVE), first))
    delta = lambda a: a["num"] - F.col("e.num")
    changed = R.codes_delta(R.code_list(F.col("e.str")), R.code_list(F.col("chosen.str")))
    compared = F.transform("by_stage", lambda a: F.struct(a["stage"].alias("stage"), a["shown"].alias("value"), delta(a).alias("delta"), a["hit"].alias("triggered")))
    whole = F.col("chosen").isNotNull()
    return done.select(
        owner, param, point, "verdict", F.when(whole, "COMPLETE").otherwise(F.col("verdict")).alias("completeness"),
        F.when(whole, F.col("e.shown")).alias("expected"), F.col("chosen.shown").alias("actual"), F.col("chosen.stage").alias("actual_stage"), delta(F.col("chosen")).alias("delta"),
        F.when(F.col("codes").isNotNull(), changed).alias("changed"), F.when(whole, compared).alias("comparisons"),
    )


def missing_outcomes(grid: DataFrame, extractions: DataFrame, presence: DataFrame, owner: str = "object_id", param: str = "param") -> DataFrame:
    """(owner, param, verdict) of the grid's parameters without a value in any required stage.

    ``grid`` has the owner, the parameter and its ``stages``. A required stage without documents makes it
    MISSING_EVIDENCE, else the value is NOT_COMPARABLE.
    """
    stages = grid.select(owner, param, F.explode("stages").alias("stage"))
    found = stages.join(extractions.select(owner, param, "stage"), [owner, param, "stage"], "left_semi").select(owner, param)
    lost = grid.join(found, [owner, param], "left_anti").join(presence, owner, "left")
    absent = F.size(F.array_except("stages", F.coalesce("present", F.expr("CAST(array() AS array<string>)")))) > 0
    return lost.select(owner, param, F.when(absent, R.MISSING).otherwise(R.NOT_COMPARABLE).alias("verdict"))


def formatted(value: Column, digits: int = 6) -> Column:
    """A number with at most so many significant digits and no trailing zeros: 12.5, 1e+06."""
    size = F.floor(F.log10(F.abs(value)))
    rounded = F.when(value == 0, F.lit(0.0)).otherwise(F.round(value / F.pow(F.lit(10.0), size - digits + 1)) * F.pow(F.lit(10.0), size - digits + 1))
    size = F.when(rounded == 0, F.lit(0)).otherwise(F.floor(F.log10(F.abs(rounded) * (1 + 1e-15))))
    trim = lambda t: F.regexp_replace(F.regexp_replace(t, r"(\.\d*?)0+$", "$1"), r"\.$", "")
    plain = trim(F.format_string("%.12f", rounded))
    power = F.concat(F.when(size < 0, "-").otherwise("+"), F.lpad(F.abs(size).cast("string"), 2, "0"))
    wide = F.concat(trim(F.format_string("%.5f", rounded / F.pow(F.lit(10.0), size))), F.lit("e"), power)
    return F.when((size < -4) | (size >= digits), wide).otherwise(plain)


def signed_delta(diff: Column, base: Column) -> Column:
    """A difference with its sign and, unless the base is nothing or 0, its percentage, halves to even: ``+2.5 (+10.00 %)``."""
    sign = F.when(diff < 0, "-").otherwise("+")
    percent = F.when(base != 0, F.concat(F.lit(" ("), F.format_string("%+.2f", F.bround(diff / base * 100, 2)), F.lit(" %)")))
    return F.concat(sign, formatted(F.abs(diff)), F.coalesce(percent, F.lit("")))
