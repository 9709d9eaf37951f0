"""Parts of the language model against plain versions."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from stagewise.llm import lmscore, logbilinear


@pytest.mark.parametrize("rows", [12, 500])
def test_steps_of_a_whole_table_and_of_distinct_rows(rows):
    r = np.random.default_rng(2)
    table = r.standard_normal((rows, 3)).astype(np.float32)
    plain, sums = table.astype(float), np.full((rows, 3), 1e-3)
    descent = logbilinear.Descent(table, 40)
    assert descent.whole == (rows == 12)
    for n in (40, 40, 7, 1, 40):
        at, grad = r.integers(0, rows, n), r.standard_normal((n, 3)).astype(np.float32)
        descent.step(at, grad, 0.15)
        for i in set(at.tolist()):
            g = grad[at == i].astype(float).sum(0)
            sums[i] += g * g
            plain[i] -= 0.15 * g / np.sqrt(sums[i])
    assert np.abs(table - plain).max() < 1e-5


def test_frequent_tokens_whose_hashes_begin_alike():
    r = np.random.default_rng(4)
    known = np.unique(np.concatenate((np.arange(50, dtype=np.uint64), np.uint64(2**64 - 1) - np.arange(9, dtype=np.uint64), r.integers(0, 2**64, 300, dtype=np.uint64))))
    for some in (known, known[:50], known[:1], known[:0]):
        s = lmscore.Scorer(some, np.arange(1, len(some) + 1), 20, 10**6)
        asked = np.concatenate((known, known + np.uint64(60), r.integers(0, 2**64, 300, dtype=np.uint64), [np.uint64(lmscore.END)]))
        k, at, ok = s.classes(asked)
        place = {h: i for i, h in enumerate(s.known.tolist())}
        assert ok.tolist() == [h in place for h in asked.tolist()] and (s.known[at[ok]] == asked[ok]).all()
        assert k.tolist() == [int(s.klass[place[h]]) if h in place else s.end if h == lmscore.END else s.other for h in asked.tolist()]


def test_counts_and_units_of_texts_longer_than_a_run(spark):
    # the runs that are counted, or numbered, in one go end inside a batch of rows and before a long text
    rows = [(i, t) for i, t in enumerate([None, "", "a b a", "c " * 500_000 + "d", "a", "B b"] * 5)]
    df = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    counts = {r.h: r.c for r in lmscore.token_counts(df.select(F.col("text").cast("binary"))).collect()}
    number = lambda w: int(lmscore.hashes([w]).view(np.int64)[0])
    assert counts == {number(b"a"): 15, number(b"b"): 15, number(b"c"): 2_500_000, number(b"d"): 5, int(np.uint64(lmscore.END).view(np.int64)): 30}
    top = np.array(list(counts), np.int64).view(np.uint64)
    scorer = lmscore.Scorer(top, np.array(list(counts.values())), 4, sum(counts.values()))
    units = lmscore.training_units(df.select(F.xxhash64("doc_id"), F.col("text").cast("binary")), scorer, sum(counts.values()))
    k = np.concatenate([np.frombuffer(r.k, np.int32) for r in units.collect()])
    assert len(k) == 2_500_065 and (k == scorer.klass[np.flatnonzero(scorer.known == np.uint64(number(b"c") % 2**64))[0]]).sum() == 2_500_000
    assert (k == scorer.end).sum() == 30
