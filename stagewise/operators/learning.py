"""Dataset splits, the logistic scorer, metrics, acceptance checks and resampled intervals."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, replace

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPLITS = (("TRAIN", 0.7), ("VALIDATION", 0.85), ("HIDDEN_TEST", 1.0))


def unit_hash(key: Column) -> Column:
    """The first 32 bits of sha256 as a number in [0, 1)."""
    return F.conv(F.substring(F.sha2(key.cast("string"), 256), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def split_of(key: Column, shares: Sequence[tuple[str, float]] = SPLITS, pinned: Column | None = None) -> Column:
    """The split of an object by its key alone, so that it never changes; ``pinned`` wins if not null."""
    x = unit_hash(key)
    out = F.lit(shares[-1][0])
    for name, upto in reversed(shares[:-1]):
        out = F.when(x < upto, name).otherwise(out)
    return F.coalesce(pinned, out) if pinned is not None else out


def log_ratio(expected: Column, actual: Column, cap: float = 6.0) -> Column:
    """|ln(actual / expected)|, capped; null if either isn't positive."""
    return F.when((expected > 0) & (actual > 0), F.least(F.abs(F.log(actual / expected)), F.lit(cap)))


def relative_delta(expected: Column, actual: Column, cap: float = 5.0) -> Column:
    return F.when(expected != 0, F.least(F.abs(actual - expected) / F.abs(expected), F.lit(cap)))


def one_hot(value: Column, names: Sequence[str]) -> list[Column]:
    return [F.when(value == n, F.lit(1.0)).otherwise(F.lit(0.0)) for n in names]


def probability(features: Sequence[Column], weights: Sequence[float], bias: float) -> Column:
    """Logistic model as a column: clipped at 35 on both sides; a null feature counts as 0."""
    z = F.lit(float(bias))
    for x, w in zip(features, weights, strict=True):
        z = z + F.coalesce(x, F.lit(0.0)) * F.lit(float(w))
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-F.greatest(F.lit(-35.0), F.least(F.lit(35.0), z))))


def newton(x: np.ndarray, y: np.ndarray, l2: float = 1.0, weights: np.ndarray | None = None, rounds: int = 50) -> tuple[np.ndarray, float]:
    """L2-penalised logistic regression by Newton's method; the bias isn't penalised."""
    a = np.hstack([x, np.ones((len(x), 1))])
    c = np.ones(len(y)) if weights is None else weights
    w = np.zeros(a.shape[1])
    penalty = np.full(len(w), l2)
    penalty[-1] = 1e-9
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -35, 35)))
        step = np.linalg.solve((a * (c * p * (1 - p))[:, None]).T @ a + np.diag(penalty), a.T @ (c * (p - y)) + penalty * w)
        w -= step
        if np.abs(step).max() < 1e-9:
            break
    return w[:-1], float(w[-1])


def newton_sums(df: DataFrame, features: Sequence[str], label: str, l2: float = 1.0, rounds: int = 25, weight: str | None = None) -> tuple[list[float], float]:
    """The same fit over a table of any size: each round is one aggregation to a matrix of fixed size."""
    c = F.lit(1.0) if weight is None else F.col(weight)
    names = [*features, None]
    value = lambda n: F.lit(1.0) if n is None else F.coalesce(F.col(n).cast("double"), F.lit(0.0))
    k = len(names)
    w = np.zeros(k)
    penalty = np.full(k, l2)
    penalty[-1] = 1e-9
    for _ in range(rounds):
        p = probability([value(n) for n in names], w.tolist(), 0.0)
        gradient = [F.sum(c * (p - F.col(label)) * value(n)) for n in names]
        pairs = [(i, j) for i in range(k) for j in range(i, k)]
        row = df.agg(*gradient, *(F.sum(c * p * (1 - p) * value(names[i]) * value(names[j])) for i, j in pairs)).first()
        if row[0] is None:
            break
        h = np.diag(penalty)
        for (i, j), v in zip(pairs, row[k:], strict=True):
            h[i, j] += v
            h[j, i] = h[i, j]
        step = np.linalg.solve(h, np.array(row[:k]) + penalty * w)
        w = w - step
        if np.abs(step).max() < 1e-9:
            break
    return w[:-1].tolist(), float(w[-1])


@dataclass(frozen=True)
class Scorer:
    """A logistic model by feature name: features are standardised, and an unknown one counts as its mean."""

    weights: dict[str, float]
    bias: float
    means: dict[str, float]
    scales: dict[str, float]
    threshold: float = 0.5

    def probability(self, features: Mapping[str, Column]) -> Column:
        """The model's probability over columns by name; features that the model doesn't know are passed over."""
        scaled = [(features[n] - self.means[n]) / self.scales[n] if n in features else F.lit(0.0) for n in self.weights]
        return probability(scaled, list(self.weights.values()), self.bias)


def train_scorer(df: DataFrame, features: Sequence[str], label: str, l2: float = 1.0, recall: float = 0.95) -> Scorer:
    """A scorer with classes of equal weight, and the highest threshold, 0.5 at most, that keeps the recall.

    One aggregation gives means, deviations and class counts, each Newton round another; no rows reach the
    driver. Null features count as their mean. With a class missing the weights are all 0.
    """
    y = F.col(label).cast("double")
    value = lambda n: F.col(n).cast("double")
    row = df.agg(F.count("*"), F.coalesce(F.sum(y), F.lit(0.0)), *(x for n in features for x in (F.avg(value(n)), F.stddev_pop(value(n))))).first()
    n, ones = row[0], row[1]
    means = {f: row[2 + 2 * i] or 0.0 for i, f in enumerate(features)}
    scales = {f: row[3 + 2 * i] or 1.0 for i, f in enumerate(features)}
    if not 0 < ones < n:
        return Scorer(dict.fromkeys(features, 0.0), 0.0, means, scales)
    scaled = df.select(
        F.when(y == 1, n / (2 * ones)).otherwise(n / (2 * (n - ones))).alias("_w"), y.alias("_y"),
        *(((F.coalesce(value(f), F.lit(means[f])) - means[f]) / scales[f]).alias(f) for f in features),
    )
    weights, bias = newton_sums(scaled, features, "_y", l2, weight="_w")
    scorer = Scorer(dict(zip(features, weights, strict=True)), bias, means, scales)
    missed = int((1 - recall) * ones)
    score = scorer.probability({f: value(f) for f in features})
    place = df.filter(y == 1).select(score.alias("s")).agg(F.percentile("s", missed / max(ones - 1, 1))).first()[0]
    return replace(scorer, threshold=float(min(place, 0.5)))


def confusion(df: DataFrame, truth: Column, predicted: Column, keys: Sequence[str] = ()) -> DataFrame:
    """tp, fp, fn, tn and from them precision, recall, f1, accuracy and false_positive_rate; 0/0 is 0."""
    c = df.groupBy(*keys).agg(
        F.count_if(truth & predicted).alias("tp"), F.count_if(~truth & predicted).alias("fp"), F.count_if(truth & ~predicted).alias("fn"), F.count_if(~truth & ~predicted).alias("tn"),
    )
    part = lambda a, b: F.round(F.coalesce(F.try_divide(a, b), F.lit(0.0)), 4)
    tp, fp, fn, tn = map(F.col, ("tp", "fp", "fn", "tn"))
    return c.select(
        *keys, tp, fp, fn, tn, part(tp, tp + fp).alias("precision"), part(tp, tp + fn).alias("recall"), part(2 * tp, 2 * tp + fp + fn).alias("f1"),
        part(tp + tn, tp + fp + fn + tn).alias("accuracy"), part(fp, fp + tn).alias("false_positive_rate"),
    )


# Acceptance thresholds of a model, as (metric, relation, bound).
ACCEPTANCE = (("precision", ">=", 0.90), ("recall", ">=", 0.80), ("f1", ">=", 0.85), ("false_positive_rate", "<=", 0.10))


def acceptance(metrics: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """One row for each metric with a bound: its value and whether it passes."""
    rows = F.array(*(F.struct(F.lit(m).alias("metric"), F.col(m).alias("value"), F.lit(b).alias("bound"), (F.col(m) >= b if r == ">=" else F.col(m) <= b).alias("passed")) for m, r, b in ACCEPTANCE))
    return metrics.select(*keys, F.explode(rows).alias("r")).select(*keys, "r.*")


def poisson_interval(df: DataFrame, truth: Column, predicted: Column, key: str, resamples: int = 200, level: float = 0.95) -> DataFrame:
    """Percentile interval of F1 over Poisson-weighted resamples, drawn from each row's key: one pass, no copies of rows."""
    # weight of a resample: the number of unit exponentials that fit into 1, from a hash
    u = (F.pmod(F.xxhash64(F.col(key), F.col("sample")), F.lit(1 << 30)) + 0.5) / (1 << 30)
    steps, total = [], 0.0
    for k in range(8):
        total += math.exp(-1) / math.factorial(k)
        steps.append(total)
    weight = sum((F.when(u > s, 1).otherwise(0) for s in steps), F.lit(0))
    rows = df.select(F.col(key), truth.alias("t"), predicted.alias("p")).withColumn("sample", F.explode(F.sequence(F.lit(1), F.lit(resamples))))
    sums = rows.withColumn("w", weight).groupBy("sample").agg(F.sum(F.when(F.col("t") & F.col("p"), F.col("w"))).alias("tp"), F.sum(F.when(F.col("t") | F.col("p"), F.col("w"))).alias("any"))
    f1 = sums.select(F.coalesce(F.try_divide(2 * F.col("tp"), F.col("tp") + F.col("any")), F.lit(0.0)).alias("f1"))
    return f1.agg(F.percentile("f1", (1 - level) / 2).alias("low"), F.percentile("f1", (1 + level) / 2).alias("high"))
