"""Alignment of two tokenizers' tokens over the same bytes, as joins and windows over token rows."""

from __future__ import annotations

import hashlib
import json
import re
from collections import Counter
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stagewise import scratch
from .lmscore import commonest
from .packing import byte_characters

#: Distinct units that a task counts before it emits them, and units that it encodes in one go.
AT_ONCE, ENCODED = 300_000, 2048
#: Units, and tokens of those without a number, in a partition of texts.
IN_PARTITION = 1_000_000
#: UTF-8 of white space, by Unicode's property and Python's; where such a character is beside a space, no cut is known.
WIDE = rb"(?:\xc2[\x85\xa0]|\xe1\x9a\x80|\xe2\x80[\x80-\x8a\xa8\xa9\xaf]|\xe2\x81\x9f|\xe3\x80\x80)"
BESIDE = [re.compile(x) for x in (rb" [\t-\r\x1c-\x20]", rb"[\t-\r\x1c-\x1f] ")]
BESIDE_WIDE = [re.compile(x) for x in (b" " + WIDE, WIDE + b" ", rb"\A" + WIDE, WIDE + rb"\Z")]
SPACES = b" \t\n\x0b\x0c\r\x1c\x1d\x1e\x1f"
#: In a text with a space before it: a space between two other characters.
CUT = re.compile(r"(?<=\S)(?= \S)")
#: Of some units: tokens as twice their id, and one more for B, the byte of its unit where each ends, and how many tokens each unit has.
LISTS = ["tokens", "ends", "sizes"]
LIST_DDL = ", ".join(f"{n} array<int>" for n in LISTS)
#: Where tokens end, as in ``aligned``: the unit, the byte in it and whose tokens end there, and the link before it.
INFO = ["places", "links"]
# Fixed value: how byte-level pre-tokenizers cut a text.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


class Tokenizers:
    """The byte-level tokenizer A and the piece tokenizer B, with the bytes of each token."""

    def __init__(self, path_a: str | None, path_b: str | None):
        import sentencepiece
        import tiktoken

        if path_a is None or path_b is None:
            import public_tokenizers

            path_a, path_b = path_a or public_tokenizers.path("byte_bpe_50k.json"), path_b or public_tokenizers.path("piece_bpe_32k.model")
        with open(path_a, encoding="utf-8") as f:
            rules = json.load(f)
        back = {chr(shown): byte for byte, shown in byte_characters().items()}
        ranks = {bytes(map(back.__getitem__, token)): i for token, i in rules["model"]["vocab"].items() if i not in {t["id"] for t in rules["added_tokens"]}}
        merges = [m if isinstance(m, str) else " ".join(m) for m in rules["model"]["merges"]]
        in_order = [rules["model"]["vocab"][m.replace(" ", "")] for m in merges]
        plain = rules["normalizer"] is None and rules["pre_tokenizer"]["type"] == "ByteLevel" and rules["pre_tokenizer"]["use_regex"] and not rules["pre_tokenizer"]["add_prefix_space"]
        if not plain or in_order != sorted(in_order):
            raise ValueError(f"{path_a} is not a byte-level tokenizer whose ids rise with its merges")
        self.a = tiktoken.Encoding("a", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        self.a_len = np.zeros(max(ranks.values()) + 1, np.int32)
        self.a_len[list(ranks.values())] = [len(token) for token in ranks]
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.b_len = np.array([len(x) for x in self.b_bytes], np.int32)
        #: A cuts before each single space; B does unless a piece goes on after a word's end.
        self.cuts_at_spaces = not any("▁" in p.lstrip("▁") for p in pieces)

    def encode(self, unit: str) -> tuple[list[int], list[int]] | None:
        """Ids of A and B over a space and the unit; None if B's bytes differ from that. A never changes a byte."""
        a, b = self.a.encode_ordinary(" " + unit), self.b.encode(unit)
        return (a, b) if b"".join(map(self.b_bytes.__getitem__, b)) == (" " + unit).encode() else None

    def flat(self, units: list[str]) -> tuple[np.ndarray, ...] | None:
        """(unit, token, bytes) of all units, A's tokens of a unit before B's; None if a unit has no tokens.

        Units without white space at their ends are encoded in one go, as both tokenizers cut between them.
        """
        parts = []
        apart = [i for i, u in enumerate(units) if not u or u[0].isspace() or u[-1].isspace()]
        joined = sorted(set(range(len(units))) - set(apart))
        for at in range(0, len(joined), ENCODED):
            some = joined[at : at + ENCODED]
            text = " " + " ".join([units[i] for i in some])
            ends = np.cumsum([1 + len(units[i].encode()) for i in some])
            a, b = self.a.encode_ordinary(text), self.b.encode(text[1:])
            found = []
            for side, ids, lengths in ((0, a, self.a_len), (1, b, self.b_len)):
                ids = np.array(ids, np.int32)
                n = lengths[ids]
                stop = np.cumsum(n)
                where = np.searchsorted(ends, stop)
                found.append((where, ids * 2 + side, n, np.isin(ends, stop).all()))
            if not self.cuts_at_spaces or not all(f[3] for f in found) or b"".join(map(self.b_bytes.__getitem__, b)) != text.encode():
                apart += some
                continue
            numbers = np.array(some)
            parts += [(numbers[where], ids, n) for where, ids, n, _ in found]
        for i in apart:
            found = self.encode(units[i])
            if found is None:
                return None
            for side, ids, lengths in ((0, found[0], self.a_len), (1, found[1], self.b_len)):
                ids = np.array(ids, np.int32)
                parts.append((np.full(len(ids), i), ids * 2 + side, lengths[ids]))
        if not parts:
            return np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0, np.int32)
        unit, tokens, n = (np.concatenate(x) for x in zip(*parts, strict=True))
        order = np.lexsort((tokens & 1, unit))
        return unit[order], tokens[order], n[order]

    def columns(self, rows: list[list[str]]) -> tuple[list[pa.Array], np.ndarray]:
        """LISTS of the units of each row, as Arrow arrays, and which rows have a unit without tokens: these have none at all."""
        counts = np.array([len(r) for r in rows], np.int64)
        bad = np.zeros(len(rows), bool)
        found = self.flat([u for r in rows for u in r])
        if found is None:
            bad = np.array([any(self.encode(u) is None for u in r) for r in rows])
            counts[bad] = 0
            found = self.flat([u for r, b in zip(rows, bad, strict=True) for u in r if not b])
        unit, tokens, n = found
        sizes = np.bincount(unit, minlength=int(counts.sum()))
        last = np.cumsum(counts)
        offsets = np.concatenate(([0], np.cumsum(sizes)))[np.concatenate(([0], last))]
        runs = np.flatnonzero(np.diff(unit * 2 + (tokens & 1), prepend=-1))  # a unit's tokens of one side
        stop = np.cumsum(n, dtype=np.int64)
        ends = stop - np.repeat((stop - n)[runs], np.diff(runs, append=len(unit)))
        lists = ((offsets, tokens), (offsets, ends), (np.concatenate(([0], last)), sizes))
        return [pa.ListArray.from_arrays(*(pa.array(x.astype(np.int32)) for x in y)) for y in lists], bad


@lru_cache(2)
def tokenizers(path_a: str | None, path_b: str | None) -> Tokenizers:
    """One per worker process; paths are resolved where the files are read."""
    return Tokenizers(path_a, path_b)


def units_of(text: bytes | None, cuts_at_spaces: bool = True) -> list[bytes]:
    """The parts of a space and the text, each without its first space, between places where both tokenizers cut.

    Such a place is a space that has a character other than white space on both sides.
    """
    if not text:
        return []
    if not cuts_at_spaces:
        return [text]
    beside = text[:1] in SPACES or text[-1:] in SPACES or any(p.search(text) for p in BESIDE)
    if not beside and (text.isascii() or not any(p.search(text) for p in BESIDE_WIDE)):
        return text.split(b" ")
    return [part[1:].encode() for part in CUT.split(" " + text.decode("utf-8", "replace"))]


def aligned(units: DataFrame, key: str) -> DataFrame:
    """(key, INFO) of the units in each row of (key, LISTS); both sides of a unit have the same bytes.

    The sides meet at equal ends: grouped by unit and end, a token of A and B's with its end are one row, as by a full
    outer equi-join, and ``units`` is dealt by the key, so no token is shuffled. Between two neighbouring ends of
    either side lies one token of A and one of B, the next ones that end: these are the links, each pair of overlapping
    tokens once. In the order of falling ends they are the last ones met. ``links`` holds A's id times 2^32 plus B's;
    ``places`` beside it the unit times 2^33, four times the end, and 1 where a token of A ends, 2 where one of B, 3 for
    a cut. The last end of a unit is a cut, so nothing is carried from one unit into the next.
    """
    of_unit = F.flatten(F.transform("sizes", lambda n, i: F.array_repeat(i, n))).alias("of_unit")
    rows = units.select(key, F.explode(F.arrays_zip("tokens", "ends", of_unit)).alias("x"))
    place = F.shiftleft(F.col("x.of_unit").cast("long"), 33) + F.shiftleft(F.col("x.ends").cast("long"), 2)
    rows = rows.select(key, place.alias("place"), F.shiftright("x.tokens", 1).alias("id"), F.col("x.tokens").bitwiseAND(1).alias("side"))
    met = rows.groupBy(key, "place").agg(*(F.max(F.when(F.col("side") == i, F.col("id"))).alias(n) for i, n in enumerate("ab")))
    falling = Window.partitionBy(key).orderBy(F.desc("place")).rowsBetween(Window.unboundedPreceding, 0)
    link = F.shiftleft(F.last("a", True).over(falling).cast("long"), 32) + F.last("b", True).over(falling)
    ending = F.when(F.col("a").isNull(), 2).when(F.col("b").isNull(), 1).otherwise(3)
    return met.select(key, (F.col("place") + ending).alias("place"), link.alias("link")).groupBy(key).agg(F.collect_list("place").alias("places"), F.collect_list("link").alias("links"))


def common_units(df: DataFrame, cuts: bool, most: int, longest: int, paths: tuple) -> DataFrame:
    """(number, unit, LISTS): frequent units of all texts, ``most`` of ``longest`` bytes at most, numbered from 0.

    They are found by counts of what a task meets at least twice at a time. A unit that is missed so is looked up less
    quickly, not otherwise.
    """

    def run(batches):
        counts: Counter = Counter()

        def rows():
            often = {k.decode("utf-8", "replace"): n for k, n in counts.items() if n > 1 and len(k) <= longest}
            counts.clear()
            return pa.RecordBatch.from_arrays([pa.array(list(often), pa.string()), pa.array(list(often.values()), pa.int64())], ["unit", "c"])

        for batch in batches:
            for text in batch.column(0).to_pylist():
                counts.update(units_of(text, cuts))
                if len(counts) >= AT_ONCE:
                    yield rows()
        yield rows()

    def encode(batches):
        held = tokenizers(*paths)
        for batch in batches:
            units = batch.column(0).to_pylist()
            lists, bad = held.columns([[u] for u in units])
            good = pa.array(~bad)
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(good), *(x.filter(good) for x in lists)], ["unit", *LISTS])

    counted = scratch.table(df.select("_text").mapInArrow(run, "unit string, c long").groupBy("unit").agg(F.sum("c").alias("c")), "unit-counts")
    good = scratch.table(commonest(counted, most).select("unit").mapInArrow(encode, f"unit string, {LIST_DDL}"), "common-units")
    units = sorted(good.select("unit").toArrow()["unit"].to_pylist())
    numbers = pa.table({"number": pa.array(range(len(units)), pa.int64()), "unit": pa.array(units, pa.string())})
    return scratch.table(df.sparkSession.createDataFrame(numbers).join(good, "unit"), "numbered-units")


def unit_numbers(df: DataFrame, common: dict[bytes, int], cuts: bool, paths: tuple) -> DataFrame:
    """(row, _key, units, LISTS): each text as the numbers of its units in order, -1 - k for the k-th one, from 0, that has no number.

    LISTS are those units' tokens. All are empty for a text without units or with bytes that B changes.
    """
    shared = df.sparkSession.sparkContext.broadcast(common)

    def run(batches):
        number, held = shared.value.get, tokenizers(*paths)
        for batch in batches:
            for first in range(0, batch.num_rows, 512):
                some, units, rare = batch.slice(first, 512), [], []
                for text in some.column(2).to_pylist():
                    parts = units_of(text, cuts)
                    n = np.fromiter((number(p, -1) for p in parts), np.int32, len(parts))
                    at = np.flatnonzero(n < 0)
                    n[at] = -1 - np.arange(len(at), dtype=np.int32)
                    units.append(n)
                    rare.append([parts[i].decode("utf-8", "replace") for i in at.tolist()])
                lists, bad = held.columns(rare)
                units = [n[:0] if b else n for n, b in zip(units, bad, strict=True)]
                yield pa.RecordBatch.from_arrays([some.column(0), some.column(1), pa.array(units, pa.list_(pa.int32())), *lists], ["row", "_key", "units", *LISTS])

    kind = df.schema["_key"].dataType.simpleString()
    return df.select(F.monotonically_increasing_id().alias("row"), "_key", "_text").mapInArrow(run, f"row long, _key {kind}, units array<int>, {LIST_DDL}")


@lru_cache(1)
def shown_ids(n: int) -> list[str]:
    """The ids below n with nothing, a comma, a bar and a semicolon behind."""
    return [f"{i}{mark}" for mark in ("", ",", "|", ";") for i in range(n)]


class Aligned:
    """What aligned units hold, one after another: strings of groups, counts, and links. Rows come from ``aligned``."""

    def __init__(self, places: pa.ListArray, links: pa.ListArray):
        row = np.repeat(np.arange(len(places)), places.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
        place, link = (x.flatten().to_numpy(zero_copy_only=False).astype(np.int64) for x in (places, links))
        order = np.lexsort((place, row))
        row, place, self.links = row[order], place[order], link[order]
        first = np.flatnonzero((np.diff(row, prepend=-1) != 0) | (np.diff(place >> 33, prepend=-1) != 0))
        self.starts, self.sizes = first, np.diff(first, append=len(row))
        sides = [(place >> i & 1).astype(bool) for i in range(2)]
        cut = sides[0] & sides[1]
        self.counts = np.stack([np.add.reduceat(x, first, dtype=np.int64) for x in (*sides, cut)], 1) if len(first) else np.zeros((0, 3), np.int64)
        group = np.cumsum(cut) - cut
        where = np.concatenate([group[side] * 2 + i for i, side in enumerate(sides)])
        order = np.argsort(where, kind="stable")
        where, ids = where[order], np.concatenate((self.links[sides[0]] >> 32, self.links[sides[1]] & 0xFFFFFFFF))[order]
        after = np.append(where[1:], -1)
        mark = np.where(after == where, 1, np.where(after >> 1 == where >> 1, 2, 3))
        stops = np.cumsum(self.counts[:, 0] + self.counts[:, 1])
        mark[stops - 1] = 0
        most = max(1 << 16, 1 << int(ids.max(initial=0)).bit_length())
        shown = list(map(shown_ids(most).__getitem__, (mark * most + ids).tolist()))
        stops = stops.tolist()
        self.groups = ["".join(shown[i:j]) for i, j in zip([0, *stops[:-1]], stops, strict=True)] if stops else []

    def links_of(self, at: np.ndarray) -> np.ndarray:
        """The links of some units, one after another."""
        sizes = self.sizes[at]
        before = np.cumsum(sizes) - sizes
        return self.links[np.repeat(self.starts[at] - before, sizes) + np.arange(sizes.sum())]


def aligned_texts(texts: DataFrame, common: Aligned) -> DataFrame:
    """(row, _key, n_a, n_b, n_groups, n_links, groups_sha256, pairs, times) of texts with units.

    A text's units without a number are aligned where the text is: it is shuffled once, into partitions of about
    IN_PARTITION units and tokens. Then each text is put together from its units' results, in their order; ``times``
    is how often it has each of its ``pairs`` of ids linked.
    """
    size = texts.agg(F.coalesce(F.sum(F.size("tokens") + F.size("units")), F.lit(0))).first()[0]
    n = max(int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // IN_PARTITION))
    texts = texts.filter(F.size("units") > 0).repartition(n, "row")
    rare = aligned(texts.select("row", *LISTS), "row")
    rows = texts.select("row", "_key", "units").join(rare.hint("merge"), "row", "left").select("row", "_key", "units", *INFO)
    shared = texts.sparkSession.sparkContext.broadcast(common)
    names = ["row", "_key", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs", "times"]

    def run(batches):
        known = shared.value
        for batch in batches:
            own = Aligned(batch.column(3), batch.column(4))
            first, out = 0, []
            for units in batch.column(2):
                u = units.values.to_numpy()
                here = slice(first, first + np.count_nonzero(u < 0))
                shown = [known.groups[x] if x >= 0 else own.groups[first - 1 - x] for x in u.tolist()]
                usual = u[u >= 0]
                counts = known.counts[usual].sum(0) + own.counts[here].sum(0)
                links = np.concatenate((known.links_of(usual), own.links_of(np.arange(here.start, here.stop))))
                pairs, times = np.unique(links, return_counts=True)
                out.append((*counts.tolist(), len(links), hashlib.sha256(";".join(shown).encode()).hexdigest(), pairs, times))
                first = here.stop
            columns = list(zip(*out, strict=True)) if out else [[]] * 7
            arrays = [pa.array(c, t) for c, t in zip(columns, (*[pa.int64()] * 4, pa.string(), pa.list_(pa.int64()), pa.list_(pa.int64())), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *arrays], names)

    kind = texts.schema["_key"].dataType.simpleString()
    return rows.mapInArrow(run, f"row long, _key {kind}, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs array<long>, times array<long>")


def link_sums(texts: DataFrame, most_broadcast: int) -> DataFrame:
    """(row, n_best, count_sum): over each text's links, how many texts have the pair of ids, and whether no pair of that A id is in more.

    The counts of the commonest pairs are broadcast; the others are joined.
    """
    counts = scratch.table(texts.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count("*").alias("c")), "pair-counts")
    a = F.shiftright("pair", 32).cast("int").alias("a")
    best = counts.groupBy(a).agg(F.max("c").alias("best"))  # no more rows than A has ids
    scored = counts.select("pair", "c", a).join(F.broadcast(best), "a").select("pair", "c", (F.col("c") == F.col("best")).cast("long").alias("is_best"))
    links = texts.select("row", F.explode(F.arrays_zip("pairs", "times")).alias("x")).select("row", F.col("x.pairs").alias("pair"), F.col("x.times").alias("times"))
    found = links.join(F.broadcast(commonest(scored, most_broadcast)), "pair", "left")
    other = found.filter("c IS NULL").select("row", "pair", "times").join(scored, "pair")
    sums = (F.sum(F.col("is_best") * F.col("times")).alias("n_best"), F.sum(F.col("c") * F.col("times")).alias("count_sum"))
    parts = found.filter("c IS NOT NULL").groupBy("row").agg(*sums).unionByName(other.groupBy("row").agg(*sums))
    return parts.groupBy("row").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))


def alignments(
    df: DataFrame, key: str = "doc_id", text: str = "text", path_a: str | None = None, path_b: str | None = None,
    frequent: int = 1 << 18, longest: int = 64, most_broadcast: int = 1 << 17,
) -> DataFrame:
    """One row per text: key, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    Both tokenizers cut before a single space between other characters, so a text is a row of units that start there,
    and what lies in a unit is the same wherever it stands. Units' tokens become rows, lengths are summed up in
    windows, the sides meet on unit and end, running counts of common ends are the groups and neighbouring ends the
    links (``aligned``). Frequent units, at most ``frequent`` of at most ``longest`` bytes, are aligned once and
    broadcast; the others are aligned in their texts, which are put together from them. A pair of ids is counted once for each row whose text has it
    linked, so repeated rows count each.

    Null and empty texts, and those whose bytes a tokenizer changes, have zeros and an empty digest and count
    for no pair. An empty table gives no rows. With a B that has pieces across spaces a text is one unit.
    """
    scratch.not_among(key, ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"])
    source = df.select(F.col(key).alias("_key"), F.col(text).cast("string").cast("binary").alias("_text"))
    paths = (path_a, path_b)
    cuts = tokenizers(*paths).cuts_at_spaces
    units = common_units(source, cuts, frequent, longest, paths)
    held = units.select("number", "unit").toArrow()
    numbers = {u.encode(): n for n, u in zip(held["number"].to_pylist(), held["unit"].to_pylist(), strict=True)}
    texts = scratch.table(unit_numbers(source, numbers, cuts, paths), "unit-numbers")
    found = aligned(units.repartition("number"), "number").toArrow().sort_by("number")
    common = Aligned(*(found[c].combine_chunks() for c in INFO))
    done = scratch.table(aligned_texts(texts, common), "aligned-texts")
    sums = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum"]
    counted = done.drop("pairs", "times").join(link_sums(done, most_broadcast), "row")
    zeros = texts.filter(F.size("units") == 0).select(F.col("_key").alias(key), *(F.lit(0).cast("long").alias(c) for c in sums), F.lit("").alias("groups_sha256"))
    return counted.select(F.col("_key").alias(key), *(F.col(c).cast("long").alias(c) for c in sums), "groups_sha256").unionByName(zeros)
