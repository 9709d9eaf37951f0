import numpy as np
from pyspark.sql import functions as F

from stagewise.operators import learning as L
from stagewise.operators import matching as M
from stagewise.operators import reconcile as R
from stagewise.operators import relational as O


def test_greedy_pairs_are_one_to_one(spark):
    rng = np.random.default_rng(1)
    rows = [(0, int(a), int(b), float(s)) for a, b, s in zip(rng.integers(0, 9, 80), rng.integers(0, 9, 80), rng.random(80), strict=True)]
    df = spark.createDataFrame(rows, "block int, a int, b int, s double")
    got = M.greedy_pairs(df, ["block"], "a", "b", ["s", "a", "b"], [True, False, False]).collect()
    assert len({r.a for r in got}) == len(got) == len({r.b for r in got})
    assert max(r[3] for r in rows) == max(r.s for r in got)


def test_bands_anchor_on_first_row(spark):
    rows = [(1, 0, 0.0, 1.0), (1, 1, 0.5, 1.5), (1, 2, 0.9, 1.9), (1, 3, 3.0, 4.0)]
    got = M.banded(spark.createDataFrame(rows, "p int, i int, t double, b double"), ["p"], "t", "b", ["t"]).orderBy("i").collect()
    assert [r.band for r in got] == [0, 0, 1, 2]


def test_box_suppression(spark):
    rows = [(1, 0.0, 0.0, 1.0, 1.0, 0.5), (1, 0.1, 0.0, 1.1, 1.0, 0.9), (1, 5.0, 5.0, 6.0, 6.0, 0.1)]
    got = M.kept_boxes(spark.createDataFrame(rows, "p int, x0 double, y0 double, x1 double, y1 double, s double"), ["p"], ["x0", "y0", "x1", "y1"], "s", ["x0"]).collect()
    assert sorted(r.s for r in got) == [0.1, 0.9]


def test_points_match_over_stages_only(spark):
    rows = [("o", "пом. 1.09", "PD"), ("o", "пом. 1.09 кухня", "RD"), ("o", "пом. 1.10", "RD"), ("o", "стены", "PD"), ("o", "стена", "PD")]
    got = {r.label: r.point for r in M.match_points(spark.createDataFrame(rows, "o string, label string, stage string"), ["o"]).collect()}
    assert got["пом. 1.09 кухня"] == got["пом. 1.09"] != got["пом. 1.10"]
    assert got["стены"] != got["стена"]


def test_number_comparator(spark):
    rows = [(100.0, 100.4, "any", None, None), (100.0, 90.0, "up", None, None), (100.0, 90.0, "down", 5.0, None), (0.0, 3.0, "any", 50.0, None), (None, 2.0, "any", None, 3.0), (None, 2.0, "any", None, None)]
    df = spark.createDataFrame(rows, "e double, a double, d string, p double, low double")
    hit = R.number_hit(F.col("e"), F.col("a"), F.col("d"), F.col("p"), F.lit(None).cast("double"), F.col("low"), F.lit(None).cast("double"), F.lit(0))
    assert [r[0] for r in df.select(hit).collect()] == [False, False, True, True, True, None]


def test_revision_roles_keep_unknown_apart(spark):
    rows = [("a", 1, True, None), ("a", 2, None, True), ("b", 1, None, True), ("b", 2, None, False), ("c", 1, None, None), ("d", 1, True, None), ("d", 2, True, None)]
    df = spark.createDataFrame(rows, "g string, i int, auth boolean, ok boolean")
    got = {(r.g, r.i): r.role for r in R.revision_roles(df, ["g"], "auth", "ok").collect()}
    assert got == {("a", 1): "ACTUAL", ("a", 2): "SUPERSEDED", ("b", 1): "ACTUAL", ("b", 2): "SUPERSEDED", ("c", 1): "ACTUAL", ("d", 1): "CONFLICT", ("d", 2): "CONFLICT"}


def test_carry_over(spark):
    prev = spark.createDataFrame([("a", "1", "D"), ("b", "1", "D"), ("c", "1", "D")], "k string, sig string, dec string")
    fresh = spark.createDataFrame([("a", "1", None), ("b", "2", None), ("n", "1", None)], "k string, sig string, dec string")
    got = {r.k: (r.dec, r.evidence_changed, r.carried) for r in O.carried_over(prev, fresh, "k", "sig", "dec").collect()}
    assert got == {"a": ("D", False, False), "b": (None, True, False), "n": (None, False, False), "c": ("D", False, True)}


def test_newton_on_a_table_is_newton_on_arrays(spark):
    rng = np.random.default_rng(2)
    x = rng.standard_normal((200, 2))
    y = (x @ [1.5, -0.7] + rng.standard_normal(200) > 0.2).astype(float)
    w, b = L.newton(x, y)
    df = spark.createDataFrame([(float(p), float(q), float(r)) for (p, q), r in zip(x, y, strict=True)], "p double, q double, y double")
    w2, b2 = L.newton_sums(df, ["p", "q"], "y")
    assert np.allclose([*w, b], [*w2, b2], atol=1e-6)


def test_confusion_of_nothing(spark):
    got = L.confusion(spark.createDataFrame([], "t boolean, p boolean"), F.col("t"), F.col("p")).first()
    assert (got.tp, got.precision, got.f1) == (0, 0.0, 0.0)


def test_registered_models(spark):
    from stagewise.operators import decisions

    good, datasets = {"TRAIN": "a", "TEST": "b"}, [("d1", {"TEST": "b", "TRAIN": "a"}), ("d2", None)]
    models = [
        (1, "m", "d3", good), (2, "m", "d1", {"TRAIN": "a"}), (3, " m ", "d1", good), (4, "m", "d3", good), (5, "m", "d1", good), (6, "a b", "d1", good), (7, None, "d1", good),
        (8, "n", "d2", None), (9, "x" * 65, "d1", good), (10, "o", None, good), (11, "p", "d1", {"TRAIN": "a", "TEST": "c"}), (12, "", "d1", good),
    ]
    kind = "n int, model_version string, dataset_version string, split_hashes map<string,string>"
    known = spark.createDataFrame(datasets, "version string, split_hashes map<string,string>")
    got = {r.n: r.error for r in decisions.registered_models(spark.createDataFrame(models, kind), known, "n").collect()}
    bad, exists, unknown, differ = "BAD_VERSION", "MODEL_EXISTS", "DATASET_UNKNOWN", "DATASET_HASH_MISMATCH"
    assert got == {1: unknown, 2: differ, 3: None, 4: exists, 5: exists, 6: bad, 7: bad, 8: None, 9: bad, 10: unknown, 11: differ, 12: bad}
    assert decisions.registered_models(spark.createDataFrame([], kind), known, "n").count() == 0
