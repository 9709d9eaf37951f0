"""Plans stay short, as the driver holds the text and metrics of each."""

import re

import pytest

from stagewise import scratch
from stagewise.llm import alignment, neardup
from stagewise.llm.components import components


@pytest.fixture
def exchanges(monkeypatch):
    """Exchanges in the plan of each table that is written, by its name."""
    found, write = {}, scratch.table

    def table(df, name):
        plan = df._jdf.queryExecution().executedPlan().toString()
        found[name] = max(found.get(name, 0), len(re.findall(r"Exchange ", plan)))
        return write(df, name)

    monkeypatch.setattr(scratch, "table", table)
    return found


def test_rounds_of_components_are_short_plans(spark, exchanges):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (7, 7)], "a long, b long")
    assert sorted(map(tuple, components(edges).collect())) == [(i, 0) for i in range(41)] + [(100, 100), (101, 100)]
    assert exchanges and max(exchanges.values()) <= 8


def test_near_duplicates_are_short_plans(spark, exchanges):
    words = [f"w{i}" for i in range(60)]
    rows = [(i, " ".join([*words[:40], f"x{i}"])) for i in range(8)] + [(20, " ".join(words[::-1])), (21, " ".join([*words[::-1], "y"])), (30, "alone with these six other words"), (31, None)]
    got = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {r.doc_id: r.component_id for r in got.collect()} == dict.fromkeys(range(8), 0) | {20: 20, 21: 20, 30: 30, 31: 31}
    assert max(exchanges.values()) <= 11


def test_tokens_are_aligned_in_one_window(spark, monkeypatch):
    """Sorts and windows over tokens took most of the time: sides meet by a grouping, one window finds the links."""
    plans, write = {}, scratch.table

    def table(df, name):
        plans[name] = df._jdf.queryExecution().executedPlan().toString()
        return write(df, name)

    monkeypatch.setattr(scratch, "table", table)
    rows = [(1, "some words and 漢字 ß"), (2, "some other wordsandmore"), (3, None)]
    got = alignment.alignments(spark.createDataFrame(rows, "doc_id long, text string"), frequent=2)
    assert {r.doc_id: r.n_groups > 0 for r in got.collect()} == {1: True, 2: True, 3: False}
    assert len(re.findall(r"[ -] Window ", plans["aligned-texts"])) == 1
