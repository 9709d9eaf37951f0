"""Decisions about checks, states of uploads and models, and what is exported of them."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# A decision and the state that a check takes by it.
STATES = {"CONFIRM": "CONFIRMED_VIOLATION", "REJECT": "NEGATIVE_VERIFIED", "CLARIFY": "CLARIFICATION_REQUIRED"}


def upload_status(failed: Column, present: Column, expected: Column) -> Column:
    """FAILED if any file of it failed, COMPLETE with all expected stages, else PARTIALLY_LOADED."""
    return F.when(failed, "FAILED").when(F.size(F.array_except(expected, present)) == 0, "COMPLETE").otherwise("PARTIALLY_LOADED")


def worst(*ranks: Column) -> Column:
    """The worse of statuses by rank; unknown ones (null) don't count."""
    return F.greatest(*ranks) if len(ranks) > 1 else ranks[0]


def decision_states(events: DataFrame, check: str, action: str, order: Sequence[str], states: Mapping[str, str] = STATES) -> DataFrame:
    """(check, state, decisions, rejections): the state by the last decision, PENDING if it is none of these.

    The order must be total. Events are folded as partial aggregates, however many a check has.
    """
    table = F.create_map(*(F.lit(x) for kv in states.items() for x in kv))
    by = events.groupBy(check).agg(
        F.max_by(F.coalesce(F.col(action), F.lit("")), F.struct(*order)).alias("_last"), F.count("*").alias("decisions"), F.count_if(F.col(action) == "REJECT").alias("rejections"),
    )
    return by.select(check, F.coalesce(F.element_at(table, F.col("_last")), F.lit("PENDING")).alias("state"), "decisions", "rejections")


def split_children(checks: DataFrame, key: str, parts: Column) -> DataFrame:
    """A child check for each part, keyed ``key#part``; the parent's columns stay. Without parts there is no child."""
    rows = checks.withColumn("_part", F.explode(F.array_distinct(parts)))
    return rows.withColumn("child", F.concat_ws("#", F.col(key).cast("string"), F.col("_part").cast("string"))).drop("_part")


def model_states(models: DataFrame, line: str, number: str, accepted: Column, decided: Column) -> DataFrame:
    """Adds ``state``: of a line of models the last accepted one is APPROVED, earlier ones ROLLED_BACK, others PENDING or REJECTED."""
    last = models.filter(accepted).groupBy(line).agg(F.max(number).alias("_last"))
    state = F.when(accepted, F.when(F.col(number) == F.col("_last"), "APPROVED").otherwise("ROLLED_BACK")).when(~decided, "PENDING").otherwise("REJECTED")
    return models.join(last, line, "left").withColumn("state", state).drop("_last")


def registered_models(models: DataFrame, datasets: DataFrame, at: str) -> DataFrame:
    """Adds ``error`` to registrations (model_version, dataset_version, split_hashes) in the order of ``at``; null is accepted.

    BAD_VERSION: no name of 1 to 64 letters, digits, dots, dashes and underscores; MODEL_EXISTS: accepted before;
    DATASET_UNKNOWN: not among ``datasets`` (version, split_hashes); DATASET_HASH_MISMATCH: the parts' hashes are not
    the dataset's, key by key. A missing map is empty, a repeated dataset counts by its greatest hashes. Only the first
    accepted place of each version is joined back, so a version with very many registrations is in no one task.
    """
    hashes = lambda c: F.coalesce(F.array_sort(F.map_entries(c)), F.expr("CAST(array() AS array<struct<key:string,value:string>>)"))
    known = datasets.groupBy(F.col("version").alias("_dataset")).agg(F.max(hashes(F.col("split_hashes"))).alias("_hashes"))
    named = models.withColumn("_version", F.regexp_replace("model_version", r"^\s+|\s+$", "")).join(known, F.col("dataset_version") == F.col("_dataset"), "left")
    bad, unknown = ~F.coalesce(F.col("_version").rlike(r"^[\w.-]{1,64}$"), F.lit(False)), F.col("_dataset").isNull()
    differ = hashes(F.col("split_hashes")) != F.col("_hashes")
    first = named.filter(~bad & ~unknown & ~differ).groupBy(F.col("_version").alias("_named")).agg(F.min(at).alias("_first"))
    error = F.when(bad, "BAD_VERSION").when(F.col(at) > F.col("_first"), "MODEL_EXISTS").when(unknown, "DATASET_UNKNOWN").when(differ, "DATASET_HASH_MISMATCH")
    return named.join(first, F.col("_version") == F.col("_named"), "left").withColumn("error", error).drop("_version", "_dataset", "_hashes", "_named", "_first")


def set_digest(df: DataFrame, keys: Sequence[str], item: Column) -> DataFrame:
    """(keys, digest) of each group's set of items: a hash of 256 hashes, each of the items that begin with its byte.

    Items are ordered by their own hash, so no group is ever gathered whole.
    """
    h = F.sha2(item.cast("string"), 256)
    parts = df.select(*keys, h.alias("_h")).groupBy(*keys, F.substring("_h", 1, 2).alias("_byte"), F.substring("_h", 3, 2).alias("_next")).agg(F.sha2(F.array_join(F.array_sort(F.collect_list("_h")), ""), 256).alias("_h"))
    bytes_ = parts.groupBy(*keys, "_byte").agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_next", "_h"))), lambda x: x["_h"]), ""), 256).alias("_h"))
    return bytes_.groupBy(*keys).agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_byte", "_h"))), lambda x: x["_h"]), ""), 256).alias("digest"))


def escaped(text: Column) -> Column:
    """Text as it may stand in XML, within elements and attributes; null is empty."""
    out = F.coalesce(text.cast("string"), F.lit(""))
    for mark, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;")):
        out = F.replace(out, F.lit(mark), F.lit(name))
    return F.regexp_replace(out, r"[\x00-\x08\x0B\x0C\x0E-\x1F]", "")


def xml_element(name: str, attributes: Mapping[str, Column], children: Mapping[str, Column]) -> Column:
    """One element with attributes and text children, all escaped."""
    parts = [F.lit(f"<{name}")]
    for k, v in attributes.items():
        parts += [F.lit(f' {k}="'), escaped(v), F.lit('"')]
    parts.append(F.lit(">"))
    for k, v in children.items():
        parts += [F.lit(f"<{k}>"), escaped(v), F.lit(f"</{k}>")]
    return F.concat(*parts, F.lit(f"</{name}>"))


def canonical_json(**fields: Column) -> Column:
    """A JSON object with its names in order and nulls written, so that equal values are equal texts."""
    return F.to_json(F.struct(*(fields[k].alias(k) for k in sorted(fields))), {"ignoreNullFields": "false"})


def next_version(previous: DataFrame, fresh: DataFrame, affected: DataFrame, key: str, parent: str, param: str, signature: str, decision: str) -> DataFrame:
    """The checks of a new version, with ``origin``: carried, same, changed or new.

    Checks of parameters that aren't ``affected`` are carried over with all they have. Of the others the
    fresh ones count: where the earlier check has the same evidence its decision stays, and its split
    children (rows whose ``parent`` is its key) come along; where the evidence changed the decision is
    open again. Earlier checks that weren't found again are gone. All joins are on keys.
    """
    changed = affected.select(param).distinct()
    carried = previous.join(changed, param, "left_anti").withColumn("origin", F.lit("carried"))
    old = previous.join(changed, param, "left_semi")
    before = old.filter(F.col(parent).isNull()).select(key, F.col(signature).alias("_sig"), F.col(decision).alias("_decision"))
    met = fresh.join(before, key, "left")
    same = F.col("_sig").eqNullSafe(F.col(signature)) & F.col("_sig").isNotNull()
    origin = F.when(same, "same").when(F.col("_sig").isNotNull(), "changed").otherwise("new")
    checks = met.withColumn("origin", origin).withColumn(decision, F.when(same, F.col("_decision"))).drop("_sig", "_decision")
    children = old.filter(F.col(parent).isNotNull()).join(checks.filter("origin = 'same'").select(F.col(key).alias(parent)), parent, "left_semi").withColumn("origin", F.lit("same"))
    return carried.unionByName(checks.select(*carried.columns)).unionByName(children.select(*carried.columns))


def guarded(rows: DataFrame, state: str, allowed: Sequence[str], what: str) -> DataFrame:
    """The rows, if all are in an allowed state; the first one that isn't ends the job with ``what``."""
    message = F.concat(F.lit(f"{what}: state "), F.coalesce(F.col(state), F.lit("unknown")))
    ok = F.when(F.coalesce(F.col(state).isin(*allowed), F.lit(False)), True).otherwise(F.raise_error(message).cast("boolean"))
    return rows.filter(ok)


def incompleteness(label: Column, sources: Column, pages: Column) -> Column:
    """The first thing that a gold record lacks: label, sources of both sides, or their pages; null if nothing."""
    return F.when(~F.coalesce(label, F.lit(False)), "label").when(~F.coalesce(sources, F.lit(False)), "sources").when(~F.coalesce(pages, F.lit(False)), "pages")
