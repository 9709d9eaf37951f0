"""Best-fit packing by exact complements: combinations of lengths that fill a gap to the last token, then best fit."""

from __future__ import annotations

import zlib
from bisect import bisect_left
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stagewise import scratch
from .packing import word_ids

#: A length and a rank in one sorted number; no length has more pieces than this.
RANKS = 1 << 48


class SumIndex:
    """Which one, two or three lengths add up to a gap, under the counts of pieces that are still there.

    ``left[n]`` is the number of pieces of length n and only falls, so a combination that lacked a piece once
    is never looked at again: each list has a place from which it goes on.
    """

    def __init__(self, left: np.ndarray):
        self.left = left.tolist()
        self.lengths = np.flatnonzero(left)[::-1].tolist()
        live = np.flatnonzero(left)
        self.pairs: dict[int, list[tuple[int, int]]] = {}
        for a in live[::-1].tolist():  # the longest first, so that short pieces stay for later gaps
            for b in live[(live <= a) & (live + a < len(left))].tolist():
                self.pairs.setdefault(a + b, []).append((a, b))
        self.at = dict.fromkeys(self.pairs, 0)

    def there(self, *parts: int) -> bool:
        return all(map(self.left.__getitem__, parts)) and (len(set(parts)) == len(parts) or all(self.left[n] >= k for n, k in Counter(parts).items()))

    def single(self, gap: int, first: int) -> tuple[int, ...] | None:
        return (gap,) if gap > 0 and self.there(first, gap) else None

    def pair(self, gap: int, *held: int) -> tuple[int, ...] | None:
        found = self.pairs.get(gap)
        if found is None:
            return None
        while self.at[gap] < len(found) and not self.there(*found[self.at[gap]]):
            self.at[gap] += 1
        for i in range(self.at[gap], len(found)):
            if self.there(*held, *found[i]):
                return found[i]
        return None

    def take(self, parts: tuple[int, ...]) -> int:
        """As many copies of the combination as there are pieces for."""
        need = Counter(parts)
        times = min(self.left[n] // k for n, k in need.items())
        for n, k in need.items():
            self.left[n] -= times * k
        return times


def exact_patterns(index: SumIndex, window: int, most: int = 3) -> list[tuple[int, list[tuple[int, int]]]]:
    """(times, parts) of a piece and up to ``most`` others that fill a window, the longest pieces first."""
    out = []

    def use(*parts: int) -> None:
        out.append((index.take(parts), sorted(Counter(parts).items(), reverse=True)))

    for first in index.lengths:
        gap = window - first
        while index.left[first] and (rest := index.single(gap, first) or (index.pair(gap, first) if most > 1 else None)):
            use(first, *rest)
        for second in index.lengths if most > 2 else ():  # triples: a length and a pair that fill what it leaves
            if 3 * second < gap or not index.left[first]:
                break
            while second < gap - 1 and index.there(first, second) and (rest := index.pair(gap - second, first, second)):
                use(first, second, *rest)
    return out


def best_fit(left: list[int], window: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """(times, parts): what is left, longest first, each piece where it leaves least room; equal windows move together."""
    open_: dict[int, list[tuple[int, list]]] = {}
    for n in range(len(left) - 1, 0, -1):
        count = left[n]
        if not count:
            continue
        gaps = sorted(open_)
        for gap in gaps[bisect_left(gaps, n) :]:
            k, stay = gap // n, []
            for times, parts in open_.pop(gap):
                full = min(times, count // k)
                some = min(count - full * k, k - 1) if full < times else 0
                count -= full * k + some
                for t, placed in ((full, k), (int(some > 0), some)):
                    if t:
                        open_.setdefault(gap - placed * n, []).append((t, [*parts, (n, placed)]))
                if times - full - (some > 0):
                    stay.append((times - full - (some > 0), parts))
            if stay:
                open_.setdefault(gap, []).extend(stay)
        k = window // n
        for t, placed in ((count // k, k), (int(count % k > 0), count % k)):
            if t:
                open_.setdefault(window - placed * n, []).append((t, [(n, placed)]))
    return [p for ps in open_.values() for p in ps]


class Plan:
    """For each length and rank among the pieces of that length: the sequence and the place in it.

    Made from the number of pieces of each length alone, so it has the same size for any input: an exact
    combination ends when one of its lengths runs out, best fit splits at most two classes of windows a length,
    and no window holds more than sqrt(2 * window) different lengths. Triples can use up the short pieces that
    best fit would need later, so plans of up to three, two and one complements are made and the one with the
    fewest windows is kept, the one with most complements of equals.
    """

    def __init__(self, counts: np.ndarray, window: int):
        plans = []
        for most in (3, 2, 1):
            index = SumIndex(counts)
            plans.append(exact_patterns(index, window, most) + best_fit(index.left, window))
        patterns = min(plans, key=lambda plan: sum(times for times, _ in plan))
        next_rank, base, rows = [0] * len(counts), 0, []
        for times, parts in patterns:
            offset = 0
            for n, k in parts:
                rows.append((n * RANKS + next_rank[n], base, k, offset))
                next_rank[n] += times * k
                offset += n * k
            base += times
        self.sequences = base
        self.first, self.base, self.copies, self.offset = np.array(sorted(rows), np.int64).reshape(-1, 4).T.copy()

    def place(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.searchsorted(self.first, length * RANKS + rank, side="right") - 1
        since = length * RANKS + rank - self.first[at]
        return self.base[at] + since // self.copies[at], self.offset[at] + since % self.copies[at] * length


def pieces(df: DataFrame, tokenizer_path: str | None, end_id: int, window: int) -> DataFrame:
    """(_key, piece, start, length, ids_crc32, part, at): ``at`` counts the pieces of one length in one partition."""
    kind, end, width = df.schema["_key"].dataType, np.array([end_id], "<u4").tobytes(), window * 4
    names = ["_key", "piece", "start", "length", "ids_crc32", "part", "at"]

    def run(batches):
        from pyspark.sql.pandas.types import to_arrow_type

        part, ids, seen = TaskContext.get().partitionId(), word_ids(tokenizer_path), [0] * (window + 1)
        types = [to_arrow_type(kind), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()]
        for batch in batches:
            out = []
            for k, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                data = (ids.text(body) if body else b"") + end
                for i, at in enumerate(range(0, len(data), width)):
                    cut = data[at : at + width]
                    n = len(cut) // 4
                    out.append((k, i, at // 4, n, zlib.crc32(cut), part, seen[n]))
                    seen[n] += 1
            columns = zip(*out, strict=True) if out else [[]] * len(types)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)

    return df.mapInArrow(run, f"_key {kind.simpleString()}, piece int, start long, length long, ids_crc32 long, part int, at long")


def pack_exactly(df: DataFrame, key: str = "doc_id", text: str = "text", tokenizer_path: str | None = None, end_id: int = 0, window: int = 2048) -> DataFrame:
    """One row per piece: key, piece, start, length, ids_crc32, sequence_id, offset.

    A document is its tokens and ``end_id``; only one longer than ``window`` is cut, into whole windows and a rest.
    Pieces of one length are alike to the packing, so it is planned for the whole table from one number for each
    length: sums of one, two and three lengths are looked up for the gap beside each length, and combinations that
    fill it exactly are used up as often as there are pieces; what is left goes best fit, longest first. Each piece
    then finds its place by its rank among the pieces of its length: a count within its partition plus the counts
    of the partitions before. Only these counts meet in one place, at most ``window`` of them, and no group of
    pieces is ever gathered, however many have one length.

    A null or empty text is its end token alone; repeated rows are packed each; among pieces of one length the
    order of reading decides; an empty table gives no rows.
    """
    scratch.not_among(key, ["piece", "start", "length", "ids_crc32", "sequence_id", "offset"])
    source = df.select(F.col(key).alias("_key"), F.col(text).cast("string").alias("_text"))
    kind = source.schema["_key"].dataType.simpleString()
    cut = scratch.table(pieces(source, tokenizer_path, end_id, window), "pieces")
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    counts = cut.filter(F.col("length") < window).groupBy("length", "part").agg(F.count("*").alias("n"))
    counts = scratch.table(counts.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))), "piece-counts")
    sums = np.zeros(window, np.int64)
    for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect():
        sums[r["length"]] = r["n"]
    shared = df.sparkSession.sparkContext.broadcast(Plan(sums, window))
    names = ["_key", "piece", "start", "length", "ids_crc32"]

    def run(batches):
        for batch in batches:
            length, rank = (batch.column(c).to_numpy() for c in ("length", "rank"))
            sequence, offset = shared.value.place(length, rank)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(sequence * 2), pa.array(offset)], [*names, "sequence_id", "offset"])

    ddl = f"_key {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    ranked = cut.join(counts, ["length", "part"]).select(*names, (F.col("before") + F.col("at")).alias("rank"))
    whole = cut.filter(F.col("length") == window).select(*names, ((F.shiftleft(F.col("part").cast("long"), 32) + F.col("at")) * 2 + 1).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    return ranked.mapInArrow(run, ddl).unionByName(whole).withColumnRenamed("_key", key)
