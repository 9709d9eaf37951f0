"""General relational operators: first per group, prioritised matching, differences, carry-over."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

Cols = Sequence[str | Column]


def every(conditions: Sequence[Column | None]) -> Column:
    """All given conditions; absent ones are no condition."""
    return reduce(lambda a, b: a & b, [c for c in conditions if c is not None], F.lit(True))


def first_per_group(df: DataFrame, keys: Cols, order: Cols, keep: int = 1) -> DataFrame:
    """The first ``keep`` rows of each group; the order should be total. Ranking is limited before the shuffle."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_rank", rank).filter(F.col("_rank") <= keep).drop("_rank")


def numbered(df: DataFrame, keys: Cols, order: Cols, name: str = "number") -> DataFrame:
    """Running number inside each group, from 1."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))


def prioritised_match(left: DataFrame, right: DataFrame, levels: Sequence[Sequence[tuple[str, str]]], key: str, order: Cols) -> DataFrame:
    """For each left row (by ``key``) the first right row of the first level that has one.

    Each level is a list of (left, right) column pairs, all equal. Levels are separate equi-joins put
    together, never one join with OR, which could only be a nested loop. ``priority`` is the level, from 1.
    Null keys match nothing. ``order`` names columns of the right side (``r_`` and the name) and makes it total: of right
    rows that are equal in a level's columns only the first one is joined, so rows that many share make no pairs.
    """
    found = None
    ranked = right.select([F.col(c).alias(f"r_{c}") for c in right.columns])
    for i, level in enumerate(levels, 1):
        on = every([F.col(f"l.{a}") == F.col(f"r.r_{b}") for a, b in level])
        first = first_per_group(ranked, [f"r_{b}" for _, b in level], order)
        one = left.alias("l").join(first.alias("r"), on).select("l.*", "r.*", F.lit(i).alias("priority"))
        found = one if found is None else found.unionByName(one)
    return first_per_group(found, [key], ["priority", *order])


def differences(old: DataFrame, new: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """(key, change): added, absent, updated or unchanged, null-safe."""
    a = old.select(key, F.struct(*columns).alias("_old"))
    b = new.select(key, F.struct(*columns).alias("_new"))
    return a.join(b, key, "full").select(
        key,
        F.when(F.col("_old").isNull(), "added").when(F.col("_new").isNull(), "absent")
        .when(F.col("_old").eqNullSafe(F.col("_new")), "unchanged").otherwise("updated").alias("change"),
    )


def carried_over(previous: DataFrame, fresh: DataFrame, key: str, signature: str, decision: str) -> DataFrame:
    """A new version: fresh rows with the earlier decision where the evidence is the same, and the
    earlier rows that were not recomputed. Changed evidence resets the decision and says so."""
    before = previous.select(key, F.col(signature).alias("_sig"), F.col(decision).alias("_decision"))
    same = F.col("_sig") == F.col(signature)
    joined = fresh.join(before, key, "left").select(
        *[c for c in fresh.columns if c != decision],
        F.when(same, F.col("_decision")).alias(decision),
        F.coalesce(F.col("_decision").isNotNull() & ~same, F.lit(False)).alias("evidence_changed"),
        F.lit(False).alias("carried"),
    )
    kept = previous.join(fresh.select(key), key, "left_anti").withColumn("evidence_changed", F.lit(False)).withColumn("carried", F.lit(True))
    return joined.unionByName(kept)


def replaced(base: DataFrame, patch: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of ``patch`` take the place of those with the same keys."""
    return base.join(patch.select(*keys).distinct(), list(keys), "left_anti").unionByName(patch)


def page(df: DataFrame, order: Cols, offset: int, limit: int) -> DataFrame:
    """One page of an ordered list, with the number of all rows."""
    return df.orderBy(*order).offset(offset).limit(limit).crossJoin(df.agg(F.count("*").alias("total")))


def within_quota(df: DataFrame, keys: Cols, order: Cols, size: str, quota: float, most: int) -> DataFrame:
    """Rows in order while at most ``most`` of a group and their sizes' sum fit the quota."""
    order_by = Window.partitionBy(*keys).orderBy(*order)
    rows = df.withColumn("_n", F.row_number().over(order_by)).withColumn("_sum", F.sum(size).over(order_by.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.filter((F.col("_n") <= most) & (F.col("_sum") <= quota)).drop("_n", "_sum")


def kth_previous(df: DataFrame, keys: Cols, time: str, k: int, order: Cols) -> DataFrame:
    """Adds ``kth_time``: the time of the k-th row before in its group, null if there is none."""
    return df.withColumn("kth_time", F.lag(time, k).over(Window.partitionBy(*keys).orderBy(*order)))


def carried_forward(df: DataFrame, keys: Cols, position: str, value: str, reach: int, name: str) -> DataFrame:
    """Adds the last known ``value`` at or before a row, if it is at most ``reach`` positions back."""
    w = Window.partitionBy(*keys).orderBy(position).rowsBetween(Window.unboundedPreceding, 0)
    at = F.last(F.when(F.col(value).isNotNull(), F.col(position)), ignorenulls=True).over(w)
    return df.withColumn(name, F.when(F.col(position) - at <= reach, F.last(value, ignorenulls=True).over(w)))


def recomputed(before: DataFrame, rows: DataFrame, changed: DataFrame, key: str, compute: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The results of ``compute`` over ``rows``, made anew only for the keys of ``changed``, with a flag ``recomputed``.

    All other results are taken from ``before``; the rows of the other keys are filtered out before any
    work on them.
    """
    keys = changed.select(key).distinct()
    fresh = compute(rows.join(keys, key, "left_semi")).withColumn("recomputed", F.lit(True))
    return fresh.unionByName(before.join(keys, key, "left_anti").withColumn("recomputed", F.lit(False)))
