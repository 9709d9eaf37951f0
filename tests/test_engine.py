"""The comparison engine, revisions, decisions and the scorer on small cases with values of their own."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from stagewise.operators import decisions as D
from stagewise.operators import engine as E
from stagewise.operators import learning as L
from stagewise.operators import matching as M
from stagewise.operators import reconcile as R

VALUES = "object_id int, param string, point string, stage string, pos int, shown string, num double, str string, flag boolean, coords array<double>, unit string, places int, bad boolean, conflict boolean"
MATRIX = (
    "code string, data_type string, stages array<string>, direction string, parsed boolean, percent double, absolute double, below double, above double, trigger_unit string, unit string, scale array<string>"
)


def value(param, stage, pos, num=None, text=None, flag=None, coords=None, unit=None, places=0, bad=False, conflict=False, point="p"):
    shown = next(str(x) for x in (num, text, flag, coords) if x is not None)
    return (1, param, point, stage, pos, shown, num, text, flag, coords, unit, places, bad, conflict)


def rule(code, kind="number", stages=("PD", "RD", "ID"), direction="any", parsed=True, percent=None, absolute=None, below=None, above=None, trigger_unit=None, scale=None):
    return (code, kind, list(stages), direction, parsed, percent, absolute, below, above, trigger_unit, None, scale)


@pytest.fixture(scope="module")
def outcome(spark):
    def run(rows, rules, present=("PD", "RD", "ID")):
        found = E.outcomes(spark.createDataFrame(rows, VALUES), spark.createDataFrame(rules, MATRIX), spark.createDataFrame([(1, list(present))], "object_id int, present array<string>"))
        return {r.param: r for r in found.collect()}

    return run


def test_cascade(outcome):
    rows = [
        value("conflict", "PD", 1, 1.0, conflict=True), value("conflict", "RD", 2, 9.0), value("bad", "PD", 3, 1.0), value("bad", "RD", 4, 9.0, bad=True), value("no_expected", "RD", 5, 3.0), value("no_actual", "PD", 6, 3.0),
        value("two_expected", "PD", 7, 1.0), value("two_expected", "PD", 8, 2.0), value("two_expected", "RD", 9, 1.0), value("two_actual", "PD", 10, 1.0), value("two_actual", "ID", 11, 1.0), value("two_actual", "ID", 12, 2.0),
        value("unparsed", "PD", 13, 1.0), value("unparsed", "RD", 14, 2.0), value("same", "PD", 15, 10.0), value("same", "RD", 16, 10.4), value("limit", "RD", 17, 2.0), value("text", "PD", 18, text="Кирпич "), value("text", "RD", 19, text="кирпич."),
        value("number_as_text", "PD", 20, text="зал"), value("number_as_text", "RD", 21, text="склад"), value("number_lost", "PD", 22, 4.0), value("number_lost", "RD", 23, text="много"),
    ]
    rules = [rule(c) for c in ("conflict", "bad", "no_expected", "no_actual", "two_expected", "two_actual", "same", "number_as_text", "number_lost")] + [rule("unparsed", parsed=False), rule("limit", below=3.0), rule("text", "string")]
    got = {k: r.verdict for k, r in outcome(rows, rules).items()}
    assert got == {
        "conflict": R.CLARIFY, "bad": R.NOT_COMPARABLE, "no_expected": R.NOT_COMPARABLE, "no_actual": R.NOT_COMPARABLE, "two_expected": R.CLARIFY, "two_actual": R.CLARIFY, "unparsed": R.NOT_COMPARABLE,
        "same": R.NEGATIVE, "limit": R.CANDIDATE, "text": R.NEGATIVE, "number_as_text": R.CANDIDATE, "number_lost": R.NOT_COMPARABLE,
    }


def test_absent_documents_are_missing_evidence(outcome):
    rows = [value("a", "RD", 1, 3.0), value("b", "PD", 2, 3.0), value("c", "PD", 3, 3.0)]
    got = {k: r.verdict for k, r in outcome(rows, [rule("a"), rule("b"), rule("c", stages=("PD", "RD"))], present=("RD",)).items()}
    assert got == {"a": R.MISSING, "b": R.NOT_COMPARABLE, "c": R.NOT_COMPARABLE}
    assert outcome([value("b", "PD", 2, 3.0)], [rule("b")], present=("PD",))["b"].verdict == R.MISSING


def test_kinds_units_and_directions(outcome):
    rows, rules = [], []

    def case(name, before, after, **options):
        kind = options.pop("kind", "number")
        rows.append(value(name, "PD", len(rows), **before))
        rows.append(value(name, "RD", len(rows), **after))
        rules.append(rule(name, kind, **options))

    case("within", {"num": 100.0}, {"num": 109.0}, percent=10.0)
    case("beyond", {"num": 100.0}, {"num": 111.0}, percent=10.0)
    case("from_zero", {"num": 0.0}, {"num": 5.0}, percent=10.0)
    case("wrong_way", {"num": 100.0}, {"num": 150.0}, direction="down")
    case("converted", {"num": 1000.0, "unit": "мм"}, {"num": 1040.0, "unit": "мм"}, absolute=5.0, trigger_unit="см")
    case("converted_hit", {"num": 1000.0, "unit": "мм"}, {"num": 1060.0, "unit": "мм"}, absolute=5.0, trigger_unit="см")
    case("precise", {"num": 1.50, "places": 2}, {"num": 1.52, "places": 2})
    case("coarse", {"num": 1.5, "places": 1}, {"num": 1.52, "places": 2})
    case("grade", {"text": "B30"}, {"text": "B25"}, kind="enum", direction="down", scale=["B20", "B25", "B30"])
    case("unknown_grade", {"text": "B30"}, {"text": "B99"}, kind="enum", scale=["B20", "B25", "B30"])
    case("lost", {"flag": True}, {"flag": False}, kind="boolean", direction="down")
    case("moved", {"coords": [0.0, 0.0]}, {"coords": [3.0, 4.0]}, kind="coordinate", absolute=5.0)
    case("moved_far", {"coords": [0.0, 0.0]}, {"coords": [3.0, 4.1]}, kind="coordinate", absolute=5.0)
    got = {k: r.verdict for k, r in outcome(rows, rules).items()}
    hits = {k for k, v in got.items() if v == R.CANDIDATE}
    assert hits == {"beyond", "from_zero", "converted_hit", "precise", "grade", "lost", "moved_far"} and got["unknown_grade"] == R.NOT_COMPARABLE


def test_pair_in_the_order_of_extraction(outcome):
    rows = [value("x", "PD", 1, 10.0), value("x", "ID", 2, 12.0), value("x", "RD", 3, 15.0), value("y", "PD", 4, 10.0), value("y", "ID", 5, 10.0), value("y", "RD", 6, 12.0)]
    got = outcome(rows, [rule("x"), rule("y")])
    assert (got["x"].actual_stage, got["x"].delta) == ("ID", 2.0) and (got["y"].actual_stage, got["y"].delta) == ("RD", 2.0)


def test_selected_files(spark):
    schema = "owner int, file_id string, stage string, document_code string, approval string, authoritative boolean, excluded string, predecessor_id string, successor_id string"
    rows = [
        (1, "nostage", None, "A", None, None, None, None, None), (1, "out", "PD", "B", None, False, None, None, None), (1, "void", "PD", "B", "CANCELLED", None, None, None, None), (1, "void_kept", "PD", "C", "CANCELLED", True, None, None, None),
        (1, "old", "RD", "D", "APPROVED", None, None, None, None), (1, "new", "RD", "D", None, None, None, "old", None), (1, "old2", "RD", "E", None, None, None, None, "new2"), (1, "new2", "RD", "E-2", None, None, None, None, None),
        (1, "auth", "ID", "f 1", None, True, None, None, None), (1, "other", "ID", "F-1", "APPROVED", None, None, None, None), (1, "p", "ID", "G", "APPROVED", None, None, None, None), (1, "q", "ID", "G", "DRAFT", None, None, None, None),
        (1, "r", "ID", "H", None, None, None, None, None), (1, "s", "ID", "H", None, None, None, None, None), (1, "t", "ID", "K", "APPROVED", True, None, None, None), (1, "u", "ID", "K", None, True, None, None, None), (1, "gone", "ID", "L", None, None, None, None, "elsewhere"),
    ]
    got = {r.file_id: r.role for r in E.selected_files(spark.createDataFrame(rows, schema), ["owner"]).collect()}
    assert got == {
        "nostage": "UNRESOLVED", "out": "SUPERSEDED", "void": "SUPERSEDED", "void_kept": "ACTUAL", "old": "SUPERSEDED", "new": "ACTUAL", "old2": "SUPERSEDED", "new2": "ACTUAL", "auth": "ACTUAL", "other": "SUPERSEDED",
        "p": "ACTUAL", "q": "SUPERSEDED", "r": "CONFLICT", "s": "CONFLICT", "t": "ACTUAL", "u": "SUPERSEDED", "gone": "ACTUAL",
    }


def test_greedy_pairs_as_one_by_one(spark):
    r = np.random.default_rng(1)
    edges = sorted({(int(b), int(x), int(y)) for b, x, y in zip(r.integers(0, 3, 300), r.integers(0, 15, 300), r.integers(0, 15, 300), strict=True)})
    rows = [(b, x, y, float(r.integers(0, 5))) for b, x, y in edges]
    got = {(q.block, q.a, q.b) for q in M.greedy_pairs(spark.createDataFrame(rows, "block int, a int, b int, score double"), ["block"], "a", "b", ["score", "a", "b"], [True, False, False]).collect()}
    want, ends = set(), set()
    for b, x, y, _ in sorted(rows, key=lambda e: (-e[3], e[1], e[2])):
        if ("a", b, x) not in ends and ("b", b, y) not in ends:
            ends |= {("a", b, x), ("b", b, y)}
            want.add((b, x, y))
    assert got == want


def test_merged_labels():
    assert M.merged_labels([("пом. 1.1", {"PD"}), ("пом. 1.1 кухня", {"RD"}), ("пом. 1.2", {"RD"})]) == {"пом. 1.1": "пом. 1.1", "пом. 1.1 кухня": "пом. 1.1", "пом. 1.2": "пом. 1.2"}
    got = M.merged_labels([("стена подземной части", {"PD"}), ("стены надземной части", {"RD"}), ("стены подземной части", {"RD"})])
    assert got["стены подземной части"] == "стена подземной части" and got["стены надземной части"] == "стены надземной части"
    assert M.merged_labels([("ось а", {"PD"}), ("ось б", {"RD"})]) == {"ось а": "ось а", "ось б": "ось б"}


def test_weighted_jaccard_against_all_pairs(spark):
    r = np.random.default_rng(2)
    rows = sorted({(int(k), int(m)) for k, m in zip(r.integers(0, 40, 500), r.zipf(1.4, 500) % 60, strict=True)})
    marks = spark.createDataFrame(rows, "k int, m int")
    idf = {x.m: x.idf for x in M.inverse_frequency(marks, "k", "m").collect()}
    sets = {}
    for k, m in rows:
        sets.setdefault(k, set()).add(m)
    w = lambda s: sum(idf[m] for m in s)
    want = {(a, b): w(sets[a] & sets[b]) / w(sets[a] | sets[b]) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) >= 2 and w(sets[a] & sets[b]) >= 3}
    got = {(x.a, x.b): x.score for x in M.weighted_jaccard(marks, M.inverse_frequency(marks, "k", "m"), "k", "m").collect()}
    assert got.keys() == want.keys() and all(abs(got[p] - want[p]) < 1e-9 for p in want) and want


def test_scorer_balances_and_scales(spark):
    r = np.random.default_rng(3)
    x = r.standard_normal((400, 2)) * [1.0, 1000.0] + [0.0, 5000.0]
    y = (x[:, 0] + (x[:, 1] - 5000) / 1000 + r.standard_normal(400) * 0.3 > 1.2).astype(int)
    df = spark.createDataFrame([(float(a), float(b), int(c)) for (a, b), c in zip(x, y, strict=True)], "a double, b double, y int")
    model = L.train_scorer(df, ["a", "b"], "y", recall=0.9)
    z = (x - x.mean(0)) / x.std(0)
    w, bias = L.newton(z, y, weights=np.where(y == 1, 400 / (2 * y.sum()), 400 / (2 * (400 - y.sum()))))
    assert np.allclose([model.weights["a"], model.weights["b"], model.bias], [*w, bias], atol=1e-6)
    kept = df.filter("y = 1").filter(model.probability({"a": F.col("a"), "b": F.col("b")}) >= model.threshold - 1e-12).count()
    assert kept >= 0.9 * y.sum() and model.threshold <= 0.5
    assert L.train_scorer(df.filter("y = 1"), ["a"], "y").weights == {"a": 0.0}


def test_digest_of_a_set_has_no_order(spark):
    one = spark.createDataFrame([("k", i) for i in range(500)], "k string, x int")
    two = spark.createDataFrame([("k", i) for i in reversed(range(500))], "k string, x int").repartition(3)
    a, b, c = (D.set_digest(df, ["k"], F.col("x")).first().digest for df in (one, two, one.filter("x > 0")))
    assert a == b != c


def test_escaping(spark):
    row = spark.createDataFrame([("<a&\"b'>\x01",)], "t string").select(D.xml_element("e", {"x": F.col("t")}, {"y": F.col("t")}).alias("x"), D.canonical_json(b=F.lit(None).cast("int"), a=F.lit(1)).alias("j")).first()
    from xml.etree import ElementTree

    e = ElementTree.fromstring(row.x)
    assert e.get("x") == e.find("y").text == "<a&\"b'>" and row.j == '{"a":1,"b":null}'


def test_guard_names_the_state(spark):
    df = spark.createDataFrame([(1, "OPEN"), (2, "FINAL")], "i int, s string")
    assert D.guarded(df.filter("i = 1"), "s", ["OPEN"], "closed").count() == 1
    with pytest.raises(Exception, match="closed: state FINAL"):
        D.guarded(df, "s", ["OPEN"], "closed").collect()


def test_applicability_guard_sets_and_comparisons(spark):
    rows = [
        value("off", "PD", 1, 1.0), value("off", "RD", 2, 9.0), value("on", "PD", 3, 1.0), value("on", "RD", 4, 9.0), value("on", "ID", 5, 1.0), value("loose", "PD", 6, 1.0, point=None), value("loose", "RD", 7, 9.0, point=None),
        value("loose", "PD", 8, 1.0), value("loose", "RD", 9, 1.0), value("whole", "PD", 10, 1.0, point=None), value("whole", "RD", 11, 9.0, point=None), value("half", "PD", 12, 1.0, point=None), value("half", "PD", 13, 1.0),
        value("any", "PD", 14, text="П1, B2"), value("any", "RD", 15, text="п1,В2, В3.1"), value("lost", "PD", 16, text="П1, ПЕ, В12"), value("lost", "RD", 17, text="П1, ПЕ4, В12.1"), value("lost2", "PD", 18, text="П1, В2"), value("lost2", "RD", 19, text="П1"),
        value("taken", "PD", 20, text="П2, П3"), value("taken", "RD", 21, text="П2, П2.1"), value("words", "PD", 22, text="есть"), value("words", "RD", 23, text="П1"),
    ]
    codes = {"any": "any", "lost": "lost", "lost2": "lost", "taken": "any", "words": "any"}
    rules = [(*rule(c, "string" if c in codes else "number"), codes.get(c), own) for c, own in [("off", ["x"]), ("on", ["x", "y"]), *((c, None) for c in ("loose", "whole", "half", *codes))]]
    present = spark.createDataFrame([(1, ["PD", "RD", "ID"], ["y"])], "object_id int, present array<string>, marks array<string>")
    got = {(r.param, r.point): r for r in E.outcomes(spark.createDataFrame(rows, VALUES), spark.createDataFrame(rules, f"{MATRIX}, codes string, own array<string>"), present).collect()}
    assert {k: r.verdict for k, r in got.items()} == {
        ("off", "p"): R.NOT_APPLICABLE, ("on", "p"): R.CANDIDATE, ("loose", None): R.CLARIFY, ("loose", "p"): R.NEGATIVE, ("whole", None): R.CANDIDATE, ("half", None): R.NOT_COMPARABLE, ("half", "p"): R.NOT_COMPARABLE,
        ("any", "p"): R.CANDIDATE, ("lost", "p"): R.NEGATIVE, ("lost2", "p"): R.CANDIDATE, ("taken", "p"): R.CANDIDATE, ("words", "p"): R.CANDIDATE,
    }
    on = got["on", "p"]
    assert (on.expected, on.actual, on.actual_stage, on.delta) == ("1.0", "9.0", "RD", 8.0)
    assert [tuple(c) for c in on.comparisons] == [("RD", "9.0", 8.0, True), ("ID", "1.0", 0.0, False)]
    assert [got[c, "p"].changed for c in codes] == ["+В3.1", None, "−В2", "−П3; +П2.1", None]
    assert got["off", "p"].expected is None and got["off", "p"].comparisons is None
