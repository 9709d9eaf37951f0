"""Spelling variants against brute force."""

import random
import re
import zlib
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from stagewise.llm.spelling import Automaton, grouped, near_in_group, spelling_variants


@given(st.sets(st.text("abcé", max_size=8), max_size=80))
@settings(max_examples=150, deadline=None)
def test_automaton_numbers_words_and_is_minimal(words):
    words = sorted(words)
    a = Automaton(words)
    assert [a.follow(a.start, 0, w, 0) for w in words] == list(range(len(words)))
    assert a.follow(a.start, 0, "zz", 0) is None
    tails = {tuple(sorted(w[len(p) :] for w in words if w.startswith(p))) for w in words for p in (w[:i] for i in range(len(w) + 1))}
    assert len(a.edges) == max(len(tails), 1)  # as many states as there are different sets of tails


def one_edit(a: str, b: str) -> bool:
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(a == b[:i] + b[i + 1 :] for i in range(len(b)))


@given(st.sets(st.text("ab", min_size=7, max_size=10), max_size=60))
@settings(max_examples=150, deadline=None)
def test_each_pair_has_one_owner(words):
    words = sorted(words)
    want = sorted((a, b) for i, a in enumerate(words) for b in words[i + 1 :] if one_edit(a, b))
    got = [p for back in (False, True) for p in near_in_group(words, 0, 0, 0, back)]
    assert sorted(tuple(sorted((words[a], words[b]))) for a, b in got) == want


def plain(rows, rate=31, least=7, seen=2, times=10):
    counts = Counter()
    for key, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if key is None else key}:{run}".encode())
            if h % rate == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    n = {w: c for w, c in counts.items() if len(w) >= least and c >= seen}
    near = {w: [v for v in n if one_edit(w, v)] for w in n}
    form = {}
    for w in n:
        best = min(((-n[v], v) for v in near[w]), default=None)
        form[w] = best[1] if best and -best[0] >= times * n[w] else None

    def root(w):
        return root(form[w]) if form[w] else w

    return {(w, form[w], root(w), n[w], len(near[w]), n[form[w]] if form[w] else None) for w in n}


def texts(seed=1):
    r = random.Random(seed)
    base = ["reconcile", "inspector", "àÿ×÷éèêë", "Straßenbahn", "documents", "aaaaaaaa", "abababab", "Überschrift", "x" * 20]
    rows = []
    for key in range(160):
        words = []
        for _ in range(r.randrange(60)):
            w = r.choice(base)
            if r.random() < 0.3:
                i = r.randrange(len(w) + 1)
                w = r.choice([w[:i] + r.choice("abéÀ") + w[i:], w[:i] + w[i + 1 :], w[:i] + r.choice("abéÀ") + w[i + 1 :]])
            words.append(w)
        rows.append((key, r.choice([" ", "-", "1"]).join(words)))
    return [*rows, rows[3], (None, "Nullkeyword Nullkeyword Nullkeywort"), (900, None), (901, ""), (902, "documents " * 30_000), (903, "documentz " * 100 + "documentzz " * 5)]


@pytest.mark.parametrize("most", [50_000, 40])
def test_same_as_brute_force(spark, most):
    rows = texts()
    df = spark.createDataFrame(rows, "word long, text string").withColumn("n", F.lit("clash"))
    got = spelling_variants(df, key="word", most=most).collect()
    assert len(got) == len({r.word for r in got})
    assert {tuple(r) for r in got} == plain(rows)
    assert any(r.root not in (r.form, r.word) for r in got)  # a chain of two steps


def test_given_documents(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(60)
    rows = [(r.doc_id, r.text) for r in df.collect()]
    assert {tuple(r) for r in spelling_variants(spark.createDataFrame(rows, "doc_id long, text string")).collect()} == plain(rows)


def test_large_groups_are_divided(spark):
    """All words share their first and last letters; no group stays above the bound but where one letter is free."""
    words = sorted({f"abcde{x}{y}{z}vwxyz" for x in "abcdefghij" for y in "abcdefghij" for z in "abcdefghij"})
    parts, total = grouped(spark.createDataFrame([(w, 2) for w in words], "word string, n long"), 50)
    rows = [r for part in parts for r in part.collect()]
    assert len(rows) <= total
    sizes = Counter((r.length, r.left, r.right, r.back, r.key) for r in rows)
    assert all(n <= 50 or g[0] - g[1] - g[2] <= 1 for g, n in sizes.items())
    pairs = [tuple(sorted((held[a], held[b]))) for g in sizes for held in [[r.word for r in rows if (r.length, r.left, r.right, r.back, r.key) == g]] for a, b in near_in_group(held, *g[:4])]
    assert sorted(pairs) == sorted((a, b) for i, a in enumerate(words) for b in words[i + 1 :] if one_edit(a, b))


def test_empty_table_and_short_words(spark):
    df = spark.createDataFrame([], "doc_id int, text string")
    assert spelling_variants(df).collect() == []
    with pytest.raises(ValueError):
        spelling_variants(df, least=5)
