"""Spelling variants: words at one edit from each other by forward and backward minimal automata, and their main forms."""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stagewise import scratch

#: Distinct words that a task counts before it emits them.
AT_ONCE = 200_000
#: Letters at each end of a word by which words first meet. Words are long enough for one half to hold that many.
ENDS = 3
#: A group: words of ``length`` and ``length + 1`` code points (0: of any) with ``key`` as their first ``left`` and last ``right`` ones.
GROUP = ["length", "left", "right", "back", "key"]
ROW_DDL = "length int, `left` int, `right` int, back boolean, key string, word string, n long"


class Automaton:
    """The minimal acyclic automaton of sorted distinct words, which numbers them in that order.

    Each edge carries how many words come before the ones that it leads to, so the sum along a word's path is its
    number and no word is stored.
    """

    def __init__(self, words: Iterable[str]):
        self.final: list[bool] = []
        self.size: list[int] = []
        self.edges: list[dict[str, tuple[int, int]]] = []
        self._known: dict[tuple, int] = {}
        path: list[tuple[list, list]] = [([], [False])]  # states that may still grow: (letter, state) edges, final
        last = ""
        for word in words:
            same = 0
            while same < len(last) and same < len(word) and last[same] == word[same]:
                same += 1
            self._close(path, last, same)
            path += [([], [False]) for _ in range(len(word) - same)]
            path[-1][1][0] = True
            last = word
        self._close(path, last, 0)
        self.start = self._state(*path[0])
        del self._known

    def _close(self, path: list, word: str, keep: int) -> None:
        while len(path) > keep + 1:
            state = self._state(*path.pop())
            path[-1][0].append((word[len(path) - 1], state))

    def _state(self, edges: list, final: list) -> int:
        """The one state with these edges."""
        kind = (final[0], *edges)
        if kind not in self._known:
            self._known[kind] = len(self.edges)
            before, out = int(final[0]), {}
            for letter, to in edges:
                out[letter] = (to, before)
                before += self.size[to]
            self.edges.append(out)
            self.size.append(before)
            self.final.append(final[0])
        return self._known[kind]

    def follow(self, state: int, number: int, word: str, at: int) -> int | None:
        """The number of the word that goes on with ``word[at:]``."""
        edges = self.edges
        for letter in word[at:]:
            edge = edges[state].get(letter)
            if edge is None:
                return None
            state, number = edge[0], number + edge[1]
        return number if self.final[state] else None

    def with_one_error(self, word: str, low: int, high: int) -> Iterator[tuple[int, int, str, bool]]:
        """(number, place, letter, longer) of words that share exactly ``place`` first letters, ``low <= place < high``,
        and then have one other letter (or, longer, one more), and the rest of ``word``."""
        state, number = self.start, 0
        for at in range(min(high, len(word) + 1)):
            letter = word[at] if at < len(word) else ""
            if at >= low:
                for other, (to, before) in self.edges[state].items():
                    if other != letter:
                        if letter and (found := self.follow(to, number + before, word, at + 1)) is not None:
                            yield found, at, other, False
                        if (found := self.follow(to, number + before, word, at)) is not None:
                            yield found, at, other, True
            edge = self.edges[state].get(letter)
            if edge is None:
                return
            state, number = edge[0], number + edge[1]


def near_in_group(words: list[str], length: int, left: int, right: int, back: bool) -> Iterator[tuple[int, int]]:
    """Pairs of places in ``words``, all of one group, of words one edit apart that this group answers for.

    A pair is answered for by where its shorter word u first differs: from ``len(u) // 2`` on by the forward group of
    its first half, before by the backward one of its second half; parts of a group by the part's own range.
    """
    shown = [w[::-1] for w in words] if back else words
    order = sorted(range(len(words)), key=shown.__getitem__)
    automaton = Automaton(shown[i] for i in order)
    for i, word in enumerate(words):
        n = len(word)
        if length and n != length:
            continue
        low, high = left, n - right if right else n + 1
        if not length:
            low, high = (0, n // 2) if back else (n // 2, n + 1)
        if not back:
            for number, _, _, longer in automaton.with_one_error(word, low, high):
                if longer or i < order[number]:
                    yield i, order[number]
            continue
        for number, at, letter, longer in automaton.with_one_error(shown[i], n - high, n + 1):
            first = n - at if longer else n - 1 - at
            while longer and first < n and word[first] == letter:  # an added letter beside its like: later by the first difference
                first += 1
            if low <= first < high and (longer or i < order[number]):
                yield i, order[number]


def word_counts(df: DataFrame, rate: int, least: int) -> DataFrame:
    """(word, n): how often each word of at least ``least`` code points occurs in (_key, _text) rows.

    Where ``rate`` divides the crc32 of key and run, the run loses a letter.
    """
    runs = re.compile(f"[a-zÀ-ÿ]{{{least},}}")

    def run(batches):
        counts: Counter = Counter()

        def rows():
            out = pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], ["word", "n"])
            counts.clear()
            return out

        for batch in batches:
            for k, text in zip(batch.column(0), batch.column(1), strict=True):
                if not text.is_valid:
                    continue
                begin = zlib.crc32(f"{k.as_py() or ''}:".encode())
                for word, n in Counter(runs.findall(text.as_py().lower().decode("utf-8", "replace"))).items():
                    h = zlib.crc32(word.encode(), begin)
                    if h % rate == 0:
                        at = h % len(word)
                        word = word[:at] + word[at + 1 :]
                        if len(word) < least:
                            continue
                    counts[word] += n
                if len(counts) >= AT_ONCE:
                    yield rows()
        yield rows()

    return df.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def parts_of(rows: DataFrame) -> DataFrame:
    """The rows of groups in two smaller groups each, in which together each of their pairs is answered for once."""
    size, length = F.length("word"), F.col("length")
    lengths = F.when(length == 0, F.array(size, size - 1)).otherwise(F.array(length))
    rows = rows.withColumn("length_", F.explode(lengths)).filter((length > 0) | (F.col("length_") > 2 * ENDS))
    half = F.floor(F.col("length_") / 2).cast("int")
    middle = F.when(length == 0, half).otherwise(F.col("left") + F.floor((length - F.col("left") - F.col("right")) / 2)).cast("int")
    rows = rows.withColumn("middle", middle).withColumn("later", F.explode(F.when(length == 0, F.array(~F.col("back"))).otherwise(F.array(F.lit(True), F.lit(False)))))
    rows = rows.select(
        F.col("length_").alias("length"),
        F.when(F.col("later"), F.col("middle")).otherwise(F.col("left") * (length > 0).cast("int")).alias("left"),
        F.when(F.col("later"), F.col("right") * (length > 0).cast("int")).otherwise(F.col("length_") - F.col("middle")).alias("right"),
        (~F.col("later")).alias("back"), "word", "n",
    )
    key = F.concat(F.substring("word", F.lit(1), F.col("left")), F.lit("-"), F.when(F.col("right") > 0, F.substring("word", -F.col("right"), F.col("right"))).otherwise(""))
    return rows.select("length", "left", "right", "back", key.alias("key"), "word", "n")


def grouped(words: DataFrame, most: int) -> tuple[list[DataFrame], int]:
    """Tables of (GROUP, word, n) whose groups have at most ``most`` words or can't be divided, and their number of rows.

    Words meet by their first and by their last ENDS letters. A group that is too large is cut by its words' lengths
    and whole halves, then again and again in the middle of what its words don't share. At one free letter it ends:
    such a group has no more words than the alphabet has letters, twice.
    """
    ends = [(False, F.substring("word", 1, ENDS)), (True, F.substring("word", -ENDS, ENDS))]
    zero = F.lit(0)
    rows = words.select(F.explode(F.array(*(F.struct(zero.alias("length"), zero.alias("left"), zero.alias("right"), F.lit(b).alias("back"), k.alias("key")) for b, k in ends))).alias("g"), "word", "n").select("g.*", "word", "n")
    small, total = [], 0
    while True:
        rows = scratch.table(rows, "spelling-groups")
        divisible = (F.col("length") == 0) | (F.col("length") - F.col("left") - F.col("right") > 1)
        large = scratch.table(rows.groupBy(*GROUP).count().filter((F.col("count") > most) & divisible).drop("count"), "large-groups")
        total += rows.count()
        if large.isEmpty():
            return [*small, rows], total
        small.append(rows.join(large, GROUP, "left_anti"))
        rows = parts_of(rows.join(large, GROUP, "left_semi"))


def near_words(words: DataFrame, most: int = 50_000, in_task: int = 25_000) -> DataFrame:
    """(word, n_near, best): for words that have a near one, how many, and the near word with the largest n as (-n, word)."""
    parts, total = grouped(words, most)

    def near(group: tuple, held: list) -> pa.RecordBatch:
        names, n = [h[0] for h in held], [h[1] for h in held]
        count, best = [0] * len(held), [None] * len(held)
        for a, b in near_in_group(names, *group[:4]):
            for x, y in ((a, b), (b, a)):
                count[x] += 1
                rank = (-n[y], names[y])
                if best[x] is None or rank < best[x]:
                    best[x] = rank
        at = [i for i, c in enumerate(count) if c]
        return pa.RecordBatch.from_arrays([
            pa.array([names[i] for i in at], pa.string()), pa.array([count[i] for i in at], pa.int64()),
            pa.array([best[i][0] for i in at], pa.int64()), pa.array([best[i][1] for i in at], pa.string()),
        ], ["word", "n_near", "minus", "other"])

    def run(batches):
        now, held = None, []
        for batch in batches:
            for r in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if r[:5] != now:
                    if len(held) > 1:
                        yield near(now, held)
                    now, held = r[:5], []
                held.append(r[5:])
        if len(held) > 1:
            yield near(now, held)

    rows = parts[0]
    for part in parts[1:]:
        rows = rows.unionByName(part)
    rows = rows.repartition(1 + total // in_task, *GROUP).sortWithinPartitions(*GROUP)
    found = rows.select(*GROUP, "word", "n").mapInArrow(run, "word string, n_near long, minus long, other string")
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), F.min(F.struct("minus", "other")).alias("best"))


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of (word, root) steps: each step followed to its end, twice as far in each round.

    A step multiplies the count, so a chain has fewer steps than the largest count has digits.
    """
    now = scratch.table(forms, "forms")
    while True:
        then = now.select(F.col("word").alias("root"), F.col("root").alias("further"))
        found = now.join(then, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved"))
        found = scratch.table(found, "roots")
        now = found.select("word", "root")
        if found.filter("moved").isEmpty():
            return now


def spelling_variants(
    df: DataFrame, key: str = "doc_id", text: str = "text", rate: int = 31, least: int = 7, seen: int = 2, times: int = 10, most: int = 50_000
) -> DataFrame:
    """One row per word: word, form, root, n, n_near, form_n.

    Words are runs of letters (A-Z, a-z, U+00C0 to U+00FF; A-Z in lower case) of at least ``least`` code points that
    occur at least ``seen`` times in the whole table, after a letter is lost where ``rate`` divides the crc32 of
    ``<key>:<run>``. Near words differ by one letter added, lost or replaced. A word's form is the near word that
    occurs most (of equal ones the first in code-point order), if it does so ``times`` as often.

    One error leaves one half of a word as it is. So words that share their first letters are put into a forward
    automaton and those that share their last ones into a backward one; each word is followed exactly through a half
    and then with one error. A pair is owned by the half that holds its first difference, so none is found twice.
    Groups of more than ``most`` words are divided until they fit (see ``grouped``).

    A null or empty text has no words; a null key counts as an empty one; every row counts, also repeated ones; an
    empty table gives no rows. ``least`` is 2 * ENDS at least.
    """
    if least < 2 * ENDS:
        raise ValueError(f"words of fewer than {2 * ENDS} letters may share neither end")
    source = df.select(F.col(key).cast("string").alias("_key"), F.col(text).cast("string").cast("binary").alias("_text"))
    words = scratch.table(word_counts(source, rate, least).filter(F.col("n") >= seen), "words")
    near = near_words(words, most)
    all_ = words.join(near, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(-F.col("best.minus") >= times * F.col("n"), F.col("best")).alias("best"))
    all_ = scratch.table(all_.select("word", F.col("best.other").alias("form"), "n", "n_near", (-F.col("best.minus")).alias("form_n")), "variants")
    found = roots(all_.filter("form IS NOT NULL").select("word", F.col("form").alias("root")))
    return all_.join(found, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
