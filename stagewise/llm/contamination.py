"""Benchmark decontamination: a broadcast hash set of test n-grams against windows of training words."""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stagewise import scratch
from .words import alnum_words, hashes

WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


#: Odd multiplier of the rolling hash of windows.
ROLL = 0x9E3779B97F4A7C15
#: A window set has at most this many bytes for each byte of item text, and for each item: a text of one-character
#: words has half a window a byte, of 8 bytes for the hash, 8 for the place, 4 for the length, 4 for the list of its
#: items and 4 to 12 in that list; the words themselves stand beside them.
BYTES_A_BYTE, BYTES_AN_ITEM = 20, 48


class Grams:
    """Windows of benchmark items as arrays: by length, sorted hashes, where the window's words stand, and its list of items.

    Words are kept once, as the items' normalised text, so a hit is verified on the words themselves. A window is one
    row however many items hold it, and windows of the same items share one list.
    """

    def __init__(self, items: list[tuple[str | None, bytes | None]], width: int):
        self.items = [i for i, _ in items]
        texts, at = [], 0
        found: dict[int, list[tuple[np.ndarray, ...]]] = {}
        for k, (_, text) in enumerate(items):
            words = alnum_words(text)
            if not words:
                continue
            n, ends = min(width, len(words)), np.cumsum([len(w) + 1 for w in words])
            starts = np.concatenate(([0], ends[:-1]))
            last = len(words) - n + 1
            found.setdefault(n, []).append((window_hashes(hashes(words), n), at + starts[:last], ends[n - 1 :] - 1 - starts[:last], np.full(last, k)))
            texts.append(b" ".join(words) + b" ")
            at += len(texts[-1])
        self.text = b"".join(texts)
        self.tables: dict[int, tuple[np.ndarray, ...]] = {}
        lists: dict[bytes, int] = {}
        for n, parts in found.items():
            h, where, size, item = (np.concatenate(x) for x in zip(*parts, strict=True))
            order = np.lexsort((item, h))
            h, where, size, item = h[order], where[order].astype(np.int64), size[order].astype(np.int32), item[order].astype(np.int32)
            rows, ids = self._windows(h, where, size, item, lists)
            self.tables[n] = h[rows], where[rows], size[rows], ids
        self.ends = np.cumsum([0, *(len(x) // 4 for x in lists)], dtype=np.int64)
        self.lists = np.frombuffer(b"".join(lists), np.int32) if lists else np.zeros(0, np.int32)

    def _windows(self, h, where, size, item, lists: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray]:
        """The first row of each different window, and the number of its list of items among ``lists``."""
        listed = lambda x: lists.setdefault(x.tobytes(), len(lists))
        starts = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1])))
        many = np.diff(np.append(starts, len(h))) > 1
        rows = starts[~many]
        alone, which = np.unique(item[rows], return_inverse=True)
        ids = np.array([listed(x) for x in alone], np.int32)[which]
        more_rows, more_ids = [], []
        for a, z in zip(starts[many].tolist(), np.append(starts, len(h))[1:][many].tolist(), strict=True):
            by_text: dict[bytes, list[int]] = {}
            for r in range(a, z):
                by_text.setdefault(self.text[where[r] : where[r] + size[r]], []).append(r)
            for same in by_text.values():
                more_rows.append(same[0])
                more_ids.append(listed(np.unique(item[same])))
        rows, ids = np.concatenate((rows, np.array(more_rows, np.int64))), np.concatenate((ids, np.array(more_ids, np.int32)))
        order = np.argsort(rows)
        return rows[order], ids[order]

    def size(self) -> int:
        return len(self.text) + self.ends.nbytes + self.lists.nbytes + sum(x.nbytes for t in self.tables.values() for x in t)

    def scan(self, text: bytes | None) -> tuple[int, np.ndarray, set[int]]:
        """Number of words, which of them lie in an occurring window, and the items met."""
        words = alnum_words(text)
        hit, met = np.zeros(len(words), bool), set()
        if not words or not self.tables:
            return len(words), hit, set()
        each = hashes(words)
        for n, (known, where, size, held) in self.tables.items():
            if len(words) < n:
                continue
            h = window_hashes(each, n)
            near = np.searchsorted(known, h)
            near[near == len(known)] = 0
            for i in np.flatnonzero(known[near] == h).tolist():
                window, at = None, int(near[i])
                while at < len(known) and known[at] == h[i]:
                    window = window or b" ".join(words[i : i + n])
                    if self.text[where[at] : where[at] + size[at]] == window:
                        hit[i : i + n] = True
                        met.add(int(held[at]))
                    at += 1
        return len(words), hit, {int(k) for m in met for k in self.lists[self.ends[m] : self.ends[m + 1]]}


def window_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """A hash of each run of ``n`` word hashes."""
    last = len(words) - n + 1
    h = np.zeros(last, np.uint64)
    for j in range(n):
        h *= np.uint64(ROLL)
        h += words[j : j + last]
    return h


def runs(hit: np.ndarray) -> list[tuple[int, int]]:
    edges = np.flatnonzero(np.diff(np.concatenate(([0], hit.view(np.int8), [0]))))
    return list(zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True))


def contamination(
    df: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id",
    item_text: str = "text", width: int = 10, most_bytes: int = 128 << 20,
) -> DataFrame:
    """One row per document: key, n_words, n_hit, n_items, items_sha256, contaminated, hit_runs.

    Words and windows as in the package's contract: runs of ``width`` item words; a shorter item is
    one window; null texts have no words; an item without words never occurs; repeated rows get a
    result each, repeated items count once for their id; empty tables give no rows or no hits.
    ``hit_runs`` lists the hit words as (start, end) in words.
    A broadcast window set has at most ``most_bytes``, by the measured text of its items; long items
    are cut between windows. A larger benchmark takes one pass over the documents for each set, one after another; each pass
    is a written table, and documents are told apart by key and digest of the text.
    """
    scratch.not_among(key, ["n_words", "n_hit", "n_items", "items_sha256", "contaminated", "hit_runs"])
    kind = df.schema[key].dataType.simpleString()
    source = df.select(F.col(key), F.col(text).cast("string").cast("binary"))
    span_type = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    ddl = f"`{key}` {kind}, _digest binary, n_words long, hit_runs array<struct<start:long,end:long>>, items array<string>"

    def scanned(shared, digest: bool) -> DataFrame:
        def run(batches):
            grams = shared.value
            for batch in batches:
                n_words, spans, met, digests = [], [], [], []
                for value in batch.column(1):
                    raw = value.as_buffer().to_pybytes() if value.is_valid else None
                    n, hit, items_met = grams.scan(raw)
                    n_words.append(n)
                    spans.append([{"start": a, "end": z} for a, z in runs(hit)] if items_met else [])
                    met.append(sorted({grams.items[i] for i in items_met if grams.items[i] is not None}))
                    digests.append(xxhash.xxh3_128_digest(raw or b"") if digest else None)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), pa.array(digests, pa.binary()), pa.array(n_words, pa.int64()), pa.array(spans, span_type), pa.array(met, pa.list_(pa.string()))],
                    [key, "_digest", "n_words", "hit_runs", "items"],
                )

        return source.mapInArrow(run, ddl)

    parts = benchmark_parts(benchmark, item, item_text, most_bytes, width)
    if len(parts) == 1:
        found = scanned(broadcast_grams(parts[0], width), False)
    else:
        every, more = None, None
        for part in parts:
            shared = broadcast_grams(part, width)
            now = scratch.table(scanned(shared, True), "contamination")
            shared.unpersist(blocking=True)
            every = now if every is None else every
            hits = now.filter(F.size("items") > 0)
            more = hits if more is None else more.unionByName(hits)
        more = more.groupBy(F.col(key).alias("_k"), F.col("_digest").alias("_d")).agg(
            joined_runs(F.flatten(F.collect_set("hit_runs"))).alias("more_runs"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("more_items"),
        )
        found = every.join(more, F.col(key).eqNullSafe(F.col("_k")) & (F.col("_digest") == F.col("_d")), "left").select(
            F.col(key), "n_words", F.coalesce("more_runs", "hit_runs").alias("hit_runs"), F.coalesce("more_items", "items").alias("items")
        )
    n_hit = F.aggregate("hit_runs", F.lit(0).cast("long"), lambda a, r: a + r["end"] - r["start"])
    return found.select(
        F.col(key), "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"), "hit_runs",
    )


def joined_runs(spans):
    """The union of (start, end) runs as disjoint runs in order."""
    empty = F.expr("CAST(array() AS array<struct<start:bigint,end:bigint>>)")
    last = lambda a: F.element_at(a, -1)

    def add(a, r):
        apart = (F.size(a) == 0) | (F.get(a, F.size(a) - 1)["end"] < r["start"])
        grown = F.concat(
            F.slice(a, 1, F.greatest(F.size(a) - 1, F.lit(0))),
            F.array(F.struct(last(a)["start"].alias("start"), F.greatest(last(a)["end"], r["end"]).alias("end"))),
        )
        return F.when(apart, F.concat(a, F.array(F.struct(r["start"].alias("start"), r["end"].alias("end"))))).otherwise(grown)

    return F.aggregate(F.array_sort(spans), empty, add)


def pieces_of(text: bytes | None, width: int, most: int) -> list[bytes]:
    """A text as pieces of about ``most`` bytes at most that have each of its windows once, in order."""
    words = alnum_words(text)
    if text is None or len(text) <= most or len(words) <= width:
        return [text] if words else []
    ends = np.concatenate(([0], np.cumsum([len(w) + 1 for w in words])))
    out, at = [], 0
    while at + width <= len(words):
        to = max(int(np.searchsorted(ends, ends[at] + most, "right")) - 1, at + width)
        out.append(b" ".join(words[at:to]))
        at = to - width + 1
    return out


def benchmark_parts(benchmark: DataFrame, item: str, item_text: str, most_bytes: int, width: int) -> list[DataFrame]:
    """The items (i, t) in parts whose window sets each have at most ``most_bytes``.

    A small benchmark is one part as it is. Else items are cut into pieces that take an eighth of the bound at most and
    repeated ones go. Buckets by hash, 64 for each bound's worth, are measured and put together up to the bound; only
    a window longer than the bound by itself would go beyond it.
    """
    items = benchmark.select(F.col(item).cast("string").alias("i"), F.col(item_text).cast("string").cast("binary").alias("t"))
    cost = F.octet_length("t") * F.lit(BYTES_A_BYTE) + F.lit(BYTES_AN_ITEM)
    size = items.agg(F.coalesce(F.sum(cost), F.lit(0))).first()[0]
    if size <= most_bytes:
        return [items]
    most = max(most_bytes // 8 // BYTES_A_BYTE, 1)

    def run(batches):
        for batch in batches:
            cut = [(i, t) for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for t in pieces_of(text, width, most)]
            yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in cut], pa.string()), pa.array([t for _, t in cut], pa.binary())], ["i", "t"])

    pieces = scratch.table(items.mapInArrow(run, "i string, t binary").distinct(), "benchmark")
    bucket = F.pmod(F.xxhash64("i", "t"), F.lit(64 * -(-size // most_bytes)))
    parts, room = [], 0
    for b, cost_of in pieces.groupBy(bucket.alias("b")).agg(F.sum(cost).alias("s")).orderBy("b").collect():
        if not parts or cost_of > room:
            parts.append([b, b])
            room = most_bytes
        parts[-1][1], room = b, room - cost_of
    return [pieces.filter(bucket.between(lo, hi)) for lo, hi in parts] or [items]


def broadcast_grams(part: DataFrame, width: int):
    rows = [(r[0], bytes(r[1]) if r[1] is not None else None) for r in part.toLocalIterator()]
    return part.sparkSession.sparkContext.broadcast(Grams(rows, width))


def decontaminate(
    df: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text",
    mode: str = "documents", width: int = 10, most_bytes: int = 128 << 20,
) -> DataFrame:
    """The documents without benchmark passages: hit ``documents`` go, or hit ``spans`` are cut from the texts.

    ``documents`` drops every row with a hit word; ``spans`` replaces each run of hit words, with what
    stands between them, by one space. Each row is judged by its own text, so keys don't matter and
    nothing is shuffled; other columns stay. Null and empty texts are kept, an empty benchmark keeps
    all, an empty table gives none. A benchmark beyond ``most_bytes`` goes set by set: of documents,
    each set thins a written table of what the last one left; of spans, each adds its hits to it.
    """
    if mode not in ("documents", "spans"):
        raise ValueError("mode is documents or spans")

    def hits(shared):
        @F.arrow_udf("array<struct<start:long,end:long>>")
        def of(texts: pa.Array) -> pa.Array:
            grams = shared.value
            found = [[{"start": a, "end": z} for a, z in runs(grams.scan(t)[1])] for t in texts.to_pylist()]
            return pa.array(found, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))

        return of(F.col(text).cast("string").cast("binary"))

    hit, more = scratch.fresh(df, "_hit"), scratch.fresh(df, "_more")
    parts = benchmark_parts(benchmark, item, item_text, most_bytes, width)
    now = df
    for i, part in enumerate(parts):
        shared = broadcast_grams(part, width)
        if mode == "documents":
            now = now.withColumn(hit, hits(shared)).filter(F.size(hit) == 0).drop(hit)
        elif i == 0:
            now = now.withColumn(hit, hits(shared))
        else:
            now = now.withColumn(more, hits(shared)).withColumn(hit, joined_runs(F.concat(hit, more))).drop(more)
        if i + 1 < len(parts):
            now = scratch.table(now, "decontaminated")
            shared.unpersist(blocking=True)
    if mode == "documents":
        return now
    cut = F.pandas_udf(cut_runs, "string")
    return now.withColumn(text, F.when(F.size(hit) == 0, F.col(text)).otherwise(cut(F.col(text), F.col(hit)))).drop(hit)


def cut_runs(texts: pd.Series, spans: pd.Series) -> pd.Series:
    """Each text without its runs of words."""
    out = []
    for text, cuts in zip(texts, spans, strict=True):
        if text is None or cuts is None or not len(cuts):
            out.append(text)
            continue
        raw = text.encode()
        places = [m.span() for m in WORD.finditer(raw.lower())]
        parts, at = [], 0
        for r in cuts:
            parts.append(raw[at : places[r["start"]][0]])
            at = places[r["end"] - 1][1]
        out.append(b" ".join([*parts, raw[at:]]).decode())
    return pd.Series(out)
