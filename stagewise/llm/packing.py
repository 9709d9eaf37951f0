"""Bounded-space online packing of tokenised documents into fixed windows."""

from __future__ import annotations

import json
import re
import zlib
from bisect import bisect_left, insort
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stagewise import scratch

#: A word of these characters alone has the same pieces under ``re`` as under the tokenizer's own
#: rules: composed Latin letters, ASCII and common marks; no special token, no odd digit.
PLAIN = re.compile("[!-~¡-±´-¸º»¿-įı-ſ]+")
PIECE = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_]+|\d|(?:[^\w\s]|_)+")
#: ``str.split`` cuts at these, the tokenizer does not.
SEPARATORS = re.compile("[\x1c-\x1f]")
KEPT_WORDS = 300_000

# The tokenizer rules under which words can be encoded one by one and plain ones cut by PIECE.
NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]}
PRE_TOKENIZER = {"type": "Sequence", "pretokenizers": [
    {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
    {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
]}


class WordIds(dict):
    """Token ids (little-endian unsigned 32-bit) of each white-space separated word, made once.

    No token spans white space under a tokenizer that drops it, so a text's ids are its words' ids.
    Only a file with the rules NORMALIZER and PRE_TOKENIZER is known to do so; with any other one whole
    texts are encoded.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        super().__init__()
        self.whole = Tokenizer.from_file(path)
        self.model = self.whole.model
        self.byte_chars = byte_characters()
        with open(path, encoding="utf-8") as f:
            rules = json.load(f)
        special = all(t["content"].startswith("<|") for t in rules.get("added_tokens") or [])
        self.by_word = special and rules.get("normalizer") == NORMALIZER and rules.get("pre_tokenizer") == PRE_TOKENIZER

    def encode(self, text: str) -> bytes:
        return np.array(self.whole.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def __missing__(self, word: str) -> bytes:
        if len(self) >= KEPT_WORDS:
            self.clear()
        if "<|" in word or not PLAIN.fullmatch(word):
            ids = self.encode(word)
        elif (low := word.lower()) == word and (low.isalpha() or len(PIECE.findall(low)) == 1):
            shown = low if low.isascii() else low.encode().decode("latin-1").translate(self.byte_chars)
            ids = b"".join([t.id.to_bytes(4, "little") for t in self.model.tokenize(shown)])
        else:  # words differ in case and marks more than their pieces do
            ids = b"".join(map(self.__getitem__, PIECE.findall(low)))
        self[word] = ids
        return ids

    def text(self, text: str) -> bytes:
        if not self.by_word or SEPARATORS.search(text):
            return self.encode(text)
        return b"".join(map(self.__getitem__, text.split()))


def byte_characters() -> dict[int, int]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {b: b for b in shown} | {b: 256 + i for i, b in enumerate(hidden)}


@lru_cache(2)
def word_ids(path: str | None) -> WordIds:
    """One per worker process; the path is resolved where the file is read."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("word_bpe_49k.json")
    return WordIds(path)


class OpenWindows:
    """At most ``limit`` open windows; a closed one is a list of (offset, piece) in order."""

    def __init__(self, size: int, limit: int):
        self.size, self.limit = size, limit
        self.rooms: list[tuple[int, int]] = []  # (free tokens, window), sorted
        self.held: dict[int, list[tuple[int, tuple]]] = {}
        self.made = 0

    def place(self, length: int, piece: tuple) -> tuple[int, list] | None:
        """Put the piece where it leaves least room; returns a window that had to be closed for it."""
        closed = None
        at = bisect_left(self.rooms, (length, -1))
        if at < len(self.rooms):
            room, window = self.rooms.pop(at)
        else:
            if len(self.rooms) >= self.limit:
                closed = self.close(0)
            room, window = self.size, self.made
            self.made += 1
            self.held[window] = []
        self.held[window].append((self.size - room, piece))
        if room > length:
            insort(self.rooms, (room - length, window))
            return closed
        full = (window, self.held.pop(window))
        if closed is None:
            return full
        raise AssertionError("a piece that closes a window opened its own and cannot fill it")

    def close(self, at: int) -> tuple[int, list]:
        _, window = self.rooms.pop(at)
        return window, self.held.pop(window)


def pack(
    df: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    tokenizer_path: str | None = None,
    end_id: int = 2,
    window: int = 4096,
    open_windows: int = 64,
    merged_parts: int = 8,
    keep_ids: bool = False,
) -> DataFrame:
    """One row per piece: key, start, length, ids_crc32, doc_tokens, sequence_id, offset (and ``ids``).

    A document's tokens and ``end_id`` are cut into whole windows and a rest. Each partition keeps
    ``open_windows`` windows open and puts a rest where it fits best; when none fits, the fullest is
    closed. What is open at a partition's end is packed again with the leftovers of ``merged_parts``
    partitions, longest first, so such a group has at most ``merged_parts * open_windows`` windows
    whatever the input's size. Of windows with equal room the oldest takes the piece, of leftovers of one
    length the one of the first partition and window goes first. A null or empty text is its end token
    alone; repeated rows are packed each; an empty table gives no rows. Pieces, not texts, are shuffled, and only the leftovers.
    """
    scratch.not_among(key, ["start", "length", "ids_crc32", "doc_tokens", "ids", "sequence_id", "offset"])
    asked, key = key, "_key"
    df = df.select(F.col(asked).alias(key), F.col(text).alias("_text"))
    text = "_text"
    kind = df.schema[key].dataType.simpleString()
    columns = "start long, length long, ids_crc32 long, doc_tokens long" + (", ids binary" if keep_ids else "")
    names = [key, *(c.split()[0] for c in columns.split(", "))]
    ddl = f"`{key}` {kind}, {columns}, part int, window long, offset long, open boolean"
    end = np.array([end_id], "<u4").tobytes()
    width = window * 4

    def run(batches):
        from pyspark.sql.pandas.types import to_arrow_type

        part, ids, bins = TaskContext.get().partitionId(), word_ids(tokenizer_path), OpenWindows(window, open_windows)
        key_type = to_arrow_type(df_key_type)
        types = [key_type, *[pa.int64()] * 4, *[pa.binary()] * keep_ids]

        def rows(windows: list, is_open: bool):
            flat = [(w, o, p) for w, held in windows for o, p in held]
            if flat:
                cols = [pa.array(c, t) for c, t in zip(zip(*(p for _, _, p in flat), strict=True), types, strict=True)]
                n = len(flat)
                cols += [pa.array([part] * n, pa.int32()), pa.array([f[0] for f in flat], pa.int64()), pa.array([f[1] for f in flat], pa.int64()), pa.array([is_open] * n)]
                yield pa.RecordBatch.from_arrays(cols, [*names, "part", "window", "offset", "open"])

        for batch in batches:
            done = []
            for k, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                data = (ids.text(body) if body else b"") + end
                total = len(data) // 4
                for at in range(0, len(data), width):
                    piece = data[at : at + width]
                    n = len(piece) // 4
                    row = (k, at // 4, n, zlib.crc32(piece), total, *([piece] if keep_ids else []))
                    closed = bins.place(n, row) if n < window else (bins.made, [(0, row)])
                    if n == window:
                        bins.made += 1
                    if closed:
                        done.append(closed)
            yield from rows(done, False)
        yield from rows([bins.close(0) for _ in range(len(bins.rooms))], True)

    df_key_type = df.schema[key].dataType
    placed = scratch.table(df.select(F.col(key), F.col(text).cast("string")).mapInArrow(run, ddl), "packing")
    number = lambda part: F.shiftleft(part.cast("long"), 32)
    out = [F.col(c) for c in names]
    closed = placed.filter(~F.col("open")).select(*out, ((number(F.col("part")) + F.col("window")) * 2).alias("sequence_id"), "offset")

    def merge(table: pa.Table) -> pa.Table:
        lengths = table.column("length").to_numpy()
        start = table.column("start").to_numpy()
        order = np.lexsort((start, table.column("window").to_numpy(), table.column("part").to_numpy(), -lengths))
        bins = OpenWindows(window, len(order) + 1)
        at, windows = np.zeros(len(order), np.int64), np.zeros(len(order), np.int64)
        held = [full for i in order.tolist() if (full := bins.place(int(lengths[i]), (i,)))]
        for w, pieces in [*held, *bins.held.items()]:
            for offset, (i,) in pieces:
                at[i], windows[i] = offset, w
        first = table.column("group").to_numpy().astype(np.int64) << 32
        return table.select(names).append_column("sequence_id", pa.array((first + windows) * 2 + 1)).append_column("offset", pa.array(at))

    left = placed.filter("open").withColumn("group", F.floor(F.col("part") / merged_parts).cast("long"))
    merged = left.groupBy("group").applyInArrow(merge, f"`{key}` {kind}, {columns}, sequence_id long, offset long")
    return closed.unionByName(merged).withColumnRenamed(key, asked)


def sequences(pieces: DataFrame, key: str = "doc_id", window: int = 4096, pad_id: int = 0) -> DataFrame:
    """Training rows from pieces packed with ``keep_ids``: padded ids and each piece's document.

    One group is one window, so at most ``window`` tokens meet.
    """

    def build(ids: tuple, table: pa.Table) -> pa.Table:
        table = table.sort_by("offset")
        data = np.frombuffer(b"".join(table.column("ids").to_pylist()), "<u4").astype(np.int32)
        return pa.table({
            "sequence_id": pa.array([ids[0].as_py()], pa.int64()),
            "input_ids": pa.array([np.pad(data, (0, window - len(data)), constant_values=pad_id)], pa.list_(pa.int32())),
            "tokens": pa.array([len(data)], pa.int32()),
            "lengths": pa.array([table.column("length").to_pylist()], pa.list_(pa.int64())),
            "keys": pa.array([[str(k) for k in table.column(key).to_pylist()]], pa.list_(pa.string())),
        })

    return pieces.groupBy("sequence_id").applyInArrow(build, "sequence_id long, input_ids array<int>, tokens int, lengths array<long>, keys array<string>")


def padding(pieces: DataFrame, window: int = 4096) -> DataFrame:
    """One row: sequences, tokens and the share of the windows that is padding."""
    used = pieces.groupBy("sequence_id").agg(F.sum("length").alias("used"))
    return used.agg(
        F.count("*").alias("sequences"), F.sum("used").alias("tokens"),
        (1 - F.sum("used") / (F.count("*") * window)).alias("padding"),
    )
