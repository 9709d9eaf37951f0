"""Exact-complement packing: plans against brute force, and every piece in one place."""

import zlib
from collections import Counter, defaultdict
from itertools import combinations_with_replacement

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from stagewise.llm.complement import Plan, SumIndex, best_fit, exact_patterns, pack_exactly

WINDOW = 40


def counted(lengths, window=WINDOW):
    return np.bincount(np.array(lengths, np.int64), minlength=window)


def placed(lengths, window=WINDOW):
    """Windows of a plan, as lists of (offset, length)."""
    plan, seen, held = Plan(counted(lengths, window), window), Counter(), defaultdict(list)
    for n in lengths:
        sequence, offset = plan.place(np.array([n]), np.array([seen[n]]))
        held[int(sequence[0])].append((int(offset[0]), n))
        seen[n] += 1
    return plan, held


@given(st.lists(st.integers(1, WINDOW - 1), max_size=200))
@settings(max_examples=150, deadline=None)
def test_windows_are_gapless_and_full_at_most(lengths):
    plan, held = placed(lengths)
    assert len(held) == plan.sequences <= sum(t for t, _ in best_fit(counted(lengths).tolist(), WINDOW)) + 1
    for pieces in held.values():
        at = 0
        for offset, n in sorted(pieces):
            assert offset == at
            at += n
        assert at <= WINDOW


@given(st.lists(st.integers(1, WINDOW - 1), max_size=60), st.integers(1, 3))
@settings(max_examples=100, deadline=None)
def test_no_complement_is_left(lengths, most):
    """After the exact stage no piece has up to ``most`` others that fill its window, by trying all."""
    index = SumIndex(counted(lengths))
    patterns = exact_patterns(index, WINDOW, most)
    assert all(sum(n * k for n, k in parts) == WINDOW for _, parts in patterns)
    assert Counter(lengths) == Counter({n: k for n, k in enumerate(index.left) if k}) + sum((Counter({n: k * t for n, k in parts}) for t, parts in patterns), Counter())
    live = [n for n, k in enumerate(index.left) if k]
    for size in range(2, most + 2):
        for parts in combinations_with_replacement(live, size):
            assert sum(parts) != WINDOW or any(index.left[n] < k for n, k in Counter(parts).items())


def one_by_one(lengths, window):
    """Best fit of single pieces, longest first."""
    rooms = []
    for n in sorted(lengths, reverse=True):
        fitting = [r for r in rooms if r >= n]
        if fitting:
            rooms.remove(min(fitting))
            rooms.append(min(fitting) - n)
        else:
            rooms.append(window - n)
    return sorted(rooms)


@given(st.lists(st.integers(1, WINDOW - 1), max_size=120))
@settings(max_examples=150, deadline=None)
def test_best_fit_in_classes_is_best_fit_one_by_one(lengths):
    got = [WINDOW - sum(n * k for n, k in parts) for times, parts in best_fit(counted(lengths).tolist(), WINDOW) for _ in range(times)]
    assert sorted(got) == one_by_one(lengths, WINDOW)


@pytest.mark.parametrize("window", [2048, 16])
def test_pieces_hold_the_documents(spark, sf_dir, window):
    import public_tokenizers
    from tokenizers import Tokenizer

    rows = [(1, None), (2, ""), (2, ""), (None, "no key"), (5, "word " * 3000), (6, "Ünïcödé — 漢字 ́ ß x1y22"), (7, "x" * 300_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("part", F.lit("clash"))
    if window == 2048:
        df = df.select("doc_id", "text").unionByName(spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").cast("long") + 100, "text").toDF("doc_id", "text"))
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = Counter()
    for r in df.select("doc_id", "text").collect():
        ids = [*tokenizer.encode(r.text or "", add_special_tokens=False).ids, 0]
        for i, at in enumerate(range(0, len(ids), window)):
            cut = np.array(ids[at : at + window], "<u4")
            want[r.doc_id, i, at, len(cut), zlib.crc32(cut.tobytes())] += 1
    got = pack_exactly(df.repartition(3), window=window).collect()
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    held = defaultdict(list)
    for r in got:
        held[r.sequence_id].append((r.offset, r.length))
    for pieces in held.values():
        ends = [0, *(o + n for o, n in sorted(pieces))]
        assert [o for o, _ in sorted(pieces)] == ends[:-1] and ends[-1] <= window
    tokens = sum(r.length for r in got)
    assert len(held) <= max(-(-tokens // window), sum(2 * r.length > window for r in got)) * 1.02 + 1


def test_empty_table_and_key_names(spark):
    df = spark.createDataFrame([(1, "a b")], "at int, text string")
    assert pack_exactly(df.limit(0), key="at").collect() == []
    assert [(r.at, r.length, r.offset) for r in pack_exactly(df, key="at").collect()] == [(1, 3, 0)]
    with pytest.raises(ValueError):
        pack_exactly(df.withColumnRenamed("at", "piece"), key="piece")
