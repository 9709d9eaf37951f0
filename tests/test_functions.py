import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import Row
from pyspark.sql import functions as F

from stagewise.functions import rules, text, triggers
from stagewise.operators import matching as M


@pytest.mark.parametrize(
    ("words", "want"),
    [
        ("Снижение на величину > 3%", {"direction": "down", "percent": 3.0}),
        ("Смещение оси > 0,2 м", {"direction": "any", "absolute": 0.2, "unit": "м"}),
        ("Проход менее 1,1 м", {"below": 1.1, "unit": "м"}),
        ("Порог > 0.02 м", {"above": 0.02, "unit": "м"}),
        ("Увеличение или уменьшение толщины", {"direction": "any", "parsed": True}),
        ("Завышение (риск снижения запаса)", {"direction": "up"}),
        ("Ничего", {"parsed": False}),
        ("Замена на материал с более высокой массой", {"direction": "up"}),
    ],
)
def test_triggers(words, want):
    got = triggers.parse(words)
    assert {k: getattr(got, k) for k in want} == want


def test_matrix_bounds_fill_in():
    t = triggers.with_bounds(triggers.parse("Прочее"), 1.0, None)
    assert (t.parsed, t.below, t.above) == (True, 1.0, None)


def values(spark, rows):
    return spark.createDataFrame([(1, *r) for r in rows], "point int, code string, stage string, num double, str string, bool boolean")


def test_rules_three_valued(spark):
    v = values(spark, [("A", "PD", 10.0, None, None), ("A", "RD", 5.0, None, None), ("B", "PD", None, "Да", None), ("C", "PD", 1.0, None, None), ("C", "PD", 2.0, None, None)])
    fires = {
        "below": ("A.PD > 1", "A.RD >= A.PD"), "text": ('B.PD == "да"', "exists(B.RD)"), "unknown": ("D.PD > 1 or A.PD > 1", "D.PD > 1"),
        "ambiguous": ("exists(A.PD)", "exists(C.PD)"), "kinds": ("A.PD == B.PD or A.PD = 10", "not (A.PD != 10,0)"),
    }
    got = {r.rule for r in rules.fired(v, [(k, *x) for k, x in fires.items()], ["point"]).collect()}
    assert got == {"below", "text", "ambiguous"}


def test_bad_rules_are_skipped():
    good, bad = rules.compile_rules([("x", "A.PD >", "B.PD"), ("y", "exists(3)", "true"), ("z", "A.PD § 1", "true")])
    assert not good and set(bad) == {"x", "y", "z"}


def one(spark, column, value):
    return spark.createDataFrame([Row(x=value)], "x string").select(column(F.col("x"))).first()[0]


@pytest.mark.parametrize(
    ("f", "value", "want"),
    [
        (text.number, "площадь 1 234,5 м2", 1234.5), (text.number, "−3", -3.0), (text.only_number, "12.05.2024", None), (text.only_number, "1 200,5 м2", 1200.5), (text.only_number, "007", None),
        (text.rule_group, "Помещение № 1-09 ( Б )", "пом. 1.09 (б)"), (text.rule_group, None, None), (text.norm_code, "аб_в  1ё", "АБ-В-1Е"), (text.decimals, "3 009,40 м2", 2), (text.decimals, "18", 0),
        (text.canonical_number, "007,50", "7.5"), (text.canonical_number, "10,0", "10"), (text.to_boolean, "Да.", True), (text.to_boolean, "-", False), (text.to_boolean, "?", None),
        (text.language, "Привет мир", "ru"), (text.language, "123", None), (text.nfc, "é", "é"),
    ],
)
def test_text(spark, f, value, want):
    assert one(spark, f, value) == want


word = st.text("абвгдежз", min_size=1, max_size=9)


@given(word, word)
def test_similarity_is_symmetric(a, b):
    assert M.ratio(a, b) == M.ratio(b, a)
    assert M.same_form(a, b) == M.same_form(b, a)
    assert M.ratio(a, a) == 100


def test_similar_labels():
    assert M.similar("пом. 1.09 кухня", "пом. 1.09")
    assert not M.similar("пом. 1.09", "пом. 1.10")
    assert M.similar("стены в грунте", "стена в грунте")
    assert not M.similar("балки кровли", "балки")


def test_changed_numbers():
    a = "the slab is 200 mm thick over the whole of the first floor of the building"
    assert M.changed_numbers(a, a.replace("200", "250")) == ["200>250"]
    assert M.changed_numbers(a, "something else") == []
    assert M.changed_numbers(None, a) == []
