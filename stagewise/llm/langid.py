"""Language identification, word first: known words by their frequency, others by ever shorter n-grams."""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stagewise import scratch
from .lmscore import remainder

#: a-z and every byte of a non-ASCII character; all else is a space.
LETTERS = bytes(b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
ASCII_LETTER = re.compile("[A-Za-z]")
LONGEST = 5
#: Words whose place a worker keeps, and words that it looks up in one go.
KEPT_WORDS, AT_ONCE = 200_000, 1 << 18


def letter_words(text: str) -> list[bytes]:
    return text.lower().encode("utf-8", "replace").translate(LETTERS).split()


def has_letter(text: str | None) -> bool:
    return bool(text) and (bool(ASCII_LETTER.search(text)) or any(c.isalpha() for c in text))


def grams(word: bytes, n: int) -> list[str]:
    """Character n-grams of the word between two bars; of one character, without the bars."""
    w = word.decode("utf-8", "replace")
    w = w if n == 1 else f"|{w}|"
    return [w[i : i + n] for i in range(len(w) - n + 1)]


def hashed(items: list[str]) -> np.ndarray:
    return np.fromiter((xxhash.xxh3_64_intdigest(x.encode("utf-8", "replace")) for x in items), np.uint64, len(items))


class Backoff:
    """Log-frequencies per language of words and n-grams, by their 64-bit hashes; a worker keeps the places of words met."""

    def __init__(self, languages: list[str], tables: dict[int, tuple[np.ndarray, np.ndarray]]):
        """``tables``: of words at 0 and of n-grams at n, sorted hashes and a row of values for each."""
        self.languages, self.tables = languages, tables
        self.place: dict[bytes, int] = {}
        self.rows = np.zeros((0, len(languages)), np.float32)

    def __reduce__(self):
        return Backoff, (self.languages, self.tables)

    @classmethod
    def of(cls, languages: list[str], tables: dict[int, dict[str, np.ndarray]]) -> Backoff:
        out = {}
        for n, values in tables.items():
            h = hashed(list(values))
            order = np.argsort(h)
            out[n] = h[order], np.array(list(values.values()), np.float32).reshape(len(h), len(languages))[order]
        return cls(languages, out)

    def known(self, n: int, items: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Which items the table of length n has, and these ones' rows."""
        h, values = self.tables[n]
        if not len(h) or not items:
            return np.zeros(len(items), bool), np.zeros((0, len(self.languages)), np.float32)
        found = hashed(items)
        at = np.minimum(np.searchsorted(h, found), len(h) - 1)
        ok = h[at] == found
        return ok, values[at[ok]]

    def vectors(self, words: list[bytes]) -> np.ndarray:
        """A row for each word: its own, else the mean of its known n-grams of the greatest length that has any, else zeros."""
        out = np.zeros((len(words), len(self.languages)), np.float32)
        texts = [w.decode("utf-8", "replace") for w in words]
        ok, values = self.known(0, texts)
        out[ok] = values
        left = np.flatnonzero(~ok)
        for n in range(LONGEST, 0, -1):
            if not len(left):
                break
            parts = [grams(words[i], n) for i in left]
            owner = np.repeat(np.arange(len(left)), [len(p) for p in parts])
            ok, values = self.known(n, [g for p in parts for g in p])
            owner = owner[ok]
            count = np.bincount(owner, minlength=len(left))
            for k in range(len(self.languages)):
                total = np.bincount(owner, values[:, k], len(left))
                out[left[count > 0], k] = (total[count > 0] / count[count > 0]).astype(np.float32)
            left = left[count == 0]
        return out

    def places(self, words: list[bytes]) -> np.ndarray:
        new = list(set(words).difference(self.place))
        if new and len(self.place) + len(new) > KEPT_WORDS:
            self.place, new = {}, list(set(words))
            self.rows = self.rows[:0]
        if new:
            self.place |= zip(new, range(len(self.rows), len(self.rows) + len(new)))
            self.rows = np.concatenate((self.rows, self.vectors(new)))
        return np.fromiter(map(self.place.__getitem__, words), np.int64, len(words))

    def rows_of(self, words: list[bytes]) -> np.ndarray:
        at = self.places(words)  # may make new rows
        return self.rows[at]

    def sums(self, words: list[bytes]) -> np.ndarray:
        total = np.zeros(len(self.languages))
        for at in range(0, len(words), AT_ONCE):
            total += self.rows_of(words[at : at + AT_ONCE]).sum(0, dtype=np.float64)
        return total

    def predictions(self, texts: list[str | None]) -> list[tuple[str, float]]:
        """The likeliest language and its posterior of each text."""
        out: list[tuple[str, float]] = [("und", 0.0)] * len(texts)
        if not self.languages:
            return out
        held: list[tuple[int, list[bytes]]] = []

        def settle() -> None:
            if not held:
                return
            sizes = [len(w) for _, w in held]
            if len(held) == 1:
                totals = self.sums(held[0][1])[None]
            else:
                rows = self.rows_of([w for _, ws in held for w in ws])
                totals = np.add.reduceat(rows, np.concatenate(([0], np.cumsum(sizes)[:-1])), axis=0, dtype=np.float64)
            p = np.exp(totals - totals.max(1, keepdims=True))
            best = p.argmax(1)
            for (i, _), b, share in zip(held, best.tolist(), (p.max(1) / p.sum(1)).tolist(), strict=True):
                out[i] = self.languages[b], share
            held.clear()

        size = 0
        for i, text in enumerate(texts):
            if not has_letter(text):
                continue
            words = letter_words(text)
            if not words:  # letters that lower-casing or encoding takes away
                continue
            if held and size + len(words) > AT_ONCE:
                settle()
                size = 0
            held.append((i, words))
            size += len(words)
        settle()
        return out

    def predict(self, text: str | None) -> tuple[str, float]:
        return self.predictions([text])[0]


def learn(df: DataFrame, text: str, lang: str) -> Backoff:
    """Every word and n-gram of the rows with its count in each language; the rows are the bounded sample."""

    def run(batches):
        for batch in batches:
            words: dict[str, Counter] = {}
            for value, name in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words.setdefault(name, Counter()).update(letter_words(value))
            for name, counted in words.items():
                for n in range(LONGEST + 1):
                    out: Counter = Counter()
                    for w, c in counted.items():
                        for g in grams(w, n) if n else [w.decode("utf-8", "replace")]:
                            out[g] += c
                    h = hashed(list(out)).view(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array([name] * len(out), pa.string()), pa.array([n] * len(out), pa.int32()), pa.array(h), pa.array(list(out.values()), pa.int64())], ["name", "n", "h", "c"])

    counted = df.select(text, lang).mapInArrow(run, "name string, n int, h long, c long").groupBy("n", "h", "name").agg(F.sum("c").alias("c"))
    got = counted.toArrow()
    names = got["name"].to_pylist()
    languages = sorted(set(names))
    number = {name: i for i, name in enumerate(languages)}
    lang_no = np.fromiter(map(number.__getitem__, names), np.int64, len(names))
    n, h, c = got["n"].to_numpy(), got["h"].to_numpy().view(np.uint64), got["c"].to_numpy()
    tables = {}
    for length in range(LONGEST + 1):
        own = n == length
        items, where = np.unique(h[own], return_inverse=True)
        total = np.bincount(lang_no[own], c[own], len(languages))
        values = np.tile(np.log(0.5 / (total + 0.5 * max(len(items), 1))), (len(items), 1))
        values[where, lang_no[own]] += np.log(c[own] / 0.5 + 1)
        tables[length] = items, values.astype(np.float32)
    return Backoff(languages, tables)


def sample_of(labelled: DataFrame, key: str, text: str, lang: str, rows_per_language: int, bytes_per_language: int) -> DataFrame:
    """(text, lang): whole rows, chosen by their key's hash so that about the stated rows and bytes of a language are expected."""
    sizes = labelled.groupBy(F.col(lang).alias("_lang")).agg(F.count("*").alias("_rows"), F.sum(F.octet_length(F.col(text).cast("string"))).alias("_bytes"))
    share = F.least(F.lit(1.0), F.lit(float(rows_per_language)) / F.col("_rows"), F.lit(float(bytes_per_language)) / F.greatest("_bytes", F.lit(1)))
    shares = F.broadcast(sizes.select("_lang", share.alias("_share")))
    draw = F.pmod(F.xxhash64(F.col(key), F.lit("sample")), F.lit(1 << 30)) / F.lit(float(1 << 30))
    return (
        labelled.join(shares, F.col(lang) == F.col("_lang")).filter(draw < F.col("_share"))
        .select(F.col(text).cast("string").alias("text"), F.col(lang).cast("string").alias("lang"))
    )


def languages(
    df: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    lang: str = "lang",
    modulus: int = 5,
    held_out: int = 0,
    rows_per_language: int = 1500,
    bytes_per_language: int = 8 << 20,
) -> DataFrame:
    """One row per document: key, held_out, lang_pred, score.

    Learns from rows with text and language whose key's crc32 leaves another remainder than
    ``held_out``. The classifier is fitted on a sample of them, whole rows drawn by their key's hash:
    of each language about ``rows_per_language`` and ``bytes_per_language`` at most; every word and
    n-gram of the sample is kept. A known word counts by its log frequency; an unseen one by the mean
    of its known n-grams of the greatest length that has any. Languages are taken to be few.
    ``score`` is the winner's posterior over the learned languages; ties go to the first by name. A
    text that is null or has no letter is ``und`` with score 0, as is every text if nothing could be
    learned. Repeated rows get a result each, an empty table none.
    """
    scratch.not_among(key, ["held_out", "lang_pred", "score"])
    kind = df.schema[key].dataType.simpleString()
    df = df.select(F.col(key), F.col(text), F.col(lang))
    labelled = df.filter(F.col(lang).isNotNull() & F.col(text).isNotNull() & (remainder(key, modulus) != held_out))
    model = learn(sample_of(labelled, key, text, lang, rows_per_language, bytes_per_language), "text", "lang")
    shared = df.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m = shared.value
        for batch in batches:
            found = m.predictions(batch.column(2).to_pylist())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())],
                [key, "held_out", "lang_pred", "score"],
            )

    source = df.select(F.col(key), (remainder(key, modulus) == held_out).alias("held_out"), F.col(text).cast("string"))
    return source.mapInArrow(run, f"`{key}` {kind}, held_out boolean, lang_pred string, score double")
