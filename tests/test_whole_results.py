"""Nothing is cut: all links, all values, whole texts and all rows."""

import random

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from stagewise.operators import extract, layout
from stagewise.operators import matching as M


@given(st.text("abc", max_size=30), st.text("abcd", max_size=30))
@settings(max_examples=300, deadline=None)
def test_common_run(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        old, row[0] = row[:], 0
        for j, y in enumerate(b, 1):
            row[j] = old[j - 1] + 1 if x == y else max(old[j], row[j - 1])
    assert M.common_run(a, b) == row[-1]


def test_a_family_of_near_copies_keeps_all_its_links(spark):
    base = [f"w{i}" for i in range(60)]
    rows = [(i, " ".join([*base[:i % 50], f"own{i}", *base[i % 50 :]])) for i in range(120)]
    found = M.shingle_pairs(spark.createDataFrame(rows, "id int, text string"), "id", F.split("text", " "))
    assert found.count() == 120 * 119 // 2


def test_the_greatest_of_many_values(spark):
    text = " ".join(f"Расход воды составляет {i} м3/сут." for i in range(1, 31))
    values = extract.rule_values(spark.createDataFrame([(1, 1, text)], "doc_id int, page int, text string"))
    assert values.count() == 30
    assert [r.value for r in extract.chosen_values(values).collect()] == [30.0]


def test_sheets_without_a_common_word_meet(spark):
    r = random.Random(5)
    title = lambda: " ".join("".join(r.choice("abcdef") for _ in range(r.randrange(1, 7))) for _ in range(r.randrange(1, 4)))
    rows = [("x", side, 100 * side + i, title()) for side in (0, 1) for i in range(25)]
    sheets = spark.createDataFrame(rows, "block string, side int, sheet int, title string")
    got = M.sheet_pairs(sheets, spark.createDataFrame([], "sheet int, mark int"), top=50).collect()
    edges = sorted((-round(M.token_sort_ratio(a[3], b[3]), 4), a[2], b[2]) for a in rows if not a[1] for b in rows if b[1] and M.token_sort_ratio(a[3], b[3]) >= 60)
    taken, want = set(), set()
    for score, a, b in edges:
        if a not in taken and b not in taken:
            taken |= {a, b}
            want.add((a, b, -score))
    assert {(g.a, g.b, g.score) for g in got} == want
    words = {r[2]: set(r[3].split()) for r in rows}
    assert any(not words[a] & words[b] for a, b, _ in want)


def test_line_errors_of_whole_lines(spark):
    r = random.Random(2)
    line = lambda n: "".join(r.choice("abcdefgh ") for _ in range(n))
    reference = [(1, i, line(r.choice([3, 20, 400]))) for i in range(20)]
    read = [(p, n, "".join(c for c in t if r.random() > 0.35)) for p, n, t in reference if n % 6]
    spark_rows = lambda rows: spark.createDataFrame(rows, "page int, n int, text string")
    got = layout.line_errors(spark_rows(reference), spark_rows(read), ["page"]).first()
    edges = sorted((-round(M.ratio(a[2], b[2]), 6), a[1], b[1], a[2], b[2]) for a in reference for b in read if M.ratio(a[2], b[2]) >= 40)
    used_a, used_b, wrong = set(), set(), {}
    for _, a, b, x, y in edges:
        if a not in used_a and b not in used_b:
            used_a.add(a)
            used_b.add(b)
            row = list(range(len(y) + 1))
            for i, p in enumerate(x, 1):
                old, row[0] = row[:], i
                for j, q in enumerate(y, 1):
                    row[j] = min(old[j] + 1, row[j - 1] + 1, old[j - 1] + (p != q))
            wrong[a] = row[-1]
    assert (got.errors, got.characters) == (sum(wrong.get(n, len(t)) for _, n, t in reference), sum(len(t) for _, _, t in reference))


def test_outlets_with_several_diameters(spark):
    from stagewise.functions import lexicon as L

    rows = [("два выпуска бытовой канализации диаметрами 100, 150 мм и 200 мм",), ("выпуск К2-3 диаметром 110, в футляре диаметром 300",), ("выпуск К1 Ø160",)]
    got = [[(x.key, x.diameter) for x in r.v] for r in spark.createDataFrame(rows, "t string").select(L.outlet_values(F.col("t")).alias("v")).collect()]
    assert got == [[("Выпуски К1", 100.0), ("Выпуски К1", 150.0), ("Выпуски К1", 200.0)], [("Выпуск К2-3", 110.0)], [("Выпуски К1", 160.0)]]


def test_further_units(spark):
    from stagewise.functions import lexicon as L

    cases = {" А на фазу": "amp", " а также": None, " кВт·ч/м2 в год": "specific", " Вт/(м·°С)": "conductivity", " м2·°С/Вт": "resistance", " м2": "area", " кВт": "power", " м": "len"}
    rows = spark.createDataFrame([(t,) for t in cases], "t string").select("t", L.unit_after(F.col("t")).alias("u")).collect()
    assert {r.t: r.u for r in rows} == cases


def test_classes_belong_to_the_nearest_element(spark):
    cell = lambda page, row, x, text: (1, page, float(x), float(row), x + 0.9, row + 0.8, text)
    cells = [
        cell(1, 1, 0, "Ростверк"), cell(1, 1, 1, "м3"), cell(1, 1, 2, "В25 F150"), cell(1, 2, 0, "Лестничные марши В30"), cell(1, 3, 2, "В35"), cell(1, 4, 8, "В40"), cell(2, 1, 0, "В20"),
        cell(5, 1, 0, "Бетон В22,5"), cell(9, 1, 0, "В15"), cell(12, 1, 0, "В10"),
    ]
    block = lambda page, y, x0, x1, text: (1, page, float(x0), float(y), float(x1), y + 0.5, text)
    blocks = [
        block(1, 0, 0, 5, "Спецификация элементов фундаментной плиты"), block(1, 0, 6, 7, "План"), block(3, 0, 0, 9, "Плита перекрытия из бетона класса В25, бетонная подготовка из бетона B7,5; и B12.5."), block(3, 1, 0, 9, "Бетон В60 без места"),
        block(4, 0, 0, 9, "АКТ № 7 освидетельствования скрытых работ"), block(4, 1, 0, 9, "Устройство обвязочной балки"),
    ]
    box = "doc_id int, page int, x0 double, y0 double, x1 double, y1 double, text string"
    got = {(r.page, r.element, r["class"], r.method) for r in extract.element_classes(spark.createDataFrame(cells, box), spark.createDataFrame(blocks, box)).collect()}
    assert got == {
        (1, "Ростверк", "B25", "table"), (1, "Лестницы", "B30", "table"), (1, "Фундаментная плита", "B35", "table"), (3, "Плиты перекрытия", "B25", "text"), (3, "Бетонная подготовка", "B7.5", "text"),
        (3, "Бетонная подготовка", "B12.5", "text"), (5, "Обвязочная балка", "B22.5", "context"),
    }


def test_floors_and_their_totals(spark):
    rows, n = [], 0

    def line(*texts):
        nonlocal n
        rows.extend(("t", n, c, x) for c, x in enumerate(texts))
        n += 1

    for floor in (1, 2):
        for i in range(1, 5):
            line(f"{floor}-0{i}", "Кабинет", f"{10 * i},50")
        if floor == 1:
            line("", "Итого раздел", "60,00")
            line("1-09", "Холл", "12,00")
        line("", "Итого по этажу", "114,00" if floor == 1 else "100,00")
    line("", "Итого по зданию", "214,00")
    rooms, floors = layout.floor_schedule(spark.createDataFrame(rows, "t string, row int, column int, text string"), ["t"])
    assert sorted((r.floor, r.number) for r in rooms.collect()) == [(0, f"1-0{i}") for i in (1, 2, 3, 4, 9)] + [(1, f"2-0{i}") for i in range(1, 5)]
    got = {r.floor: (r.rooms, r.area, r.total, r.agrees) for r in floors.collect()}
    assert got[0] == (5, 114.0, 114.0, True) and got[1] == (4, 102.0, 100.0, False)
    assert got[-1] == (9, 216.0, 214.0, False)


def test_an_element_is_looked_for_in_a_text_that_is_named_once(spark):
    from stagewise.functions import lexicon as L

    texts = ["Устройство фундаментной плиты", "Пилоны, колонны и стены на отм. -3.300", "Стены подвала", None, "", "лестничных железобетонных маршей", "плитка", "ростверковый"]
    got = [r.e for r in spark.createDataFrame([(t,) for t in texts], "t string").select(L.element(F.col("t")).alias("e")).collect()]
    assert got == ["Фундаментная плита", "Вертикальные конструкции подземной части", "Стены подвала", None, None, "Лестницы", None, None]
    assert str(L.element(F.col("named_text"))).count("named_text") <= 2


def test_equal_places_make_no_pairs(spark):
    from tests.plans import most_rows

    e = spark.range(4000).selectExpr("0 AS page", "id AS room", "CAST(id % 5 AS DOUBLE) AS x", "CAST(id % 3 AS DOUBLE) AS y")
    found = layout.equipment_gap(e, e.filter("room % 5 < 3"), e.filter("room % 5 < 2"), ["page"], 0.9)
    assert most_rows(found, "Join") <= 4000
    assert {r.room for r in found.collect()} == {i for i in range(4000) if i % 5 == 2}


def test_right_rows_that_many_share_make_no_pairs(spark):
    from stagewise.operators import relational as R
    from tests.plans import most_rows

    left, right = (spark.range(n).selectExpr(f"id AS {k}", f"{name} AS name", "'s' AS sha") for n, k, name in ((3000, "fk", "'n'"), (2000, "rk", "CASE WHEN id % 2 = 1 THEN 'n' ELSE 'm' END")))
    found = R.prioritised_match(left, right, [[("name", "name"), ("sha", "sha")], [("sha", "sha")]], "fk", ["r_rk"])
    assert most_rows(found, "Join") <= 3000
    assert {(r.r_rk, r.priority) for r in found.collect()} == {(1, 1)}


def test_digests_of_equal_sets_are_made_once(spark):
    asked = spark.sparkContext.accumulator(0)

    def count(x):
        asked.add(1)
        return x

    d = spark.createDataFrame([(1, "a b"), (2, "b a"), (3, "c")], "id int, t string").select("id", F.split(F.udf(count)("t"), " ").alias("s"))
    assert {(r.id, r.first) for r in M.same_sets(d, "id", "s").collect()} == {(1, 1), (2, 1), (3, 3)}
    assert asked.value <= 6


def test_order_lines_with_large_keys_stand_in_rows_of_their_own(spark, tmp_path):
    from stagewise.plans import registry

    kind = "l_orderkey long, l_linenumber int, l_suppkey long, l_partkey long, l_quantity double"
    spark.createDataFrame([(1, 2, 100, 7, 3.0), (1, 1, 200, 7, 6.0), (1, 1, 200, 7, 6.0), (1, 3, 0, 7, 4.0)], kind).write.parquet(f"{tmp_path}/lineitem.parquet")
    assert {(r.value, r.n) for r in registry.queries()["ext02_named_rows"](spark, str(tmp_path)).collect()} == {("3", 1), ("6", 2)}


def test_keys_with_one_common_mark_are_not_shuffled_as_pairs(spark):
    from tests.plans import most_rows

    marks = spark.range(400).selectExpr("id AS k", "explode(array(id DIV 20, 100 + id % 20)) AS m")
    marks = marks.unionByName(spark.createDataFrame([(900, 500), (900, 501), (901, 500), (901, 501)], "k long, m long"))
    found = M.weighted_jaccard(marks, M.inverse_frequency(marks, "k", "m"), "k", "m")
    assert most_rows(found, "HashAggregate") <= 1000
    assert [(r.a, r.b, round(r.score, 9)) for r in found.collect()] == [(900, 901, 1.0)]


def test_labels_of_small_parameters_go_to_python_together(spark):
    rows = [(o, f"{kind} {n}", s) for o in range(40) for n in (1, 2) for kind, s in (("Помещение", "PD"), ("помещ.", "RD"), ("Зал", "ID"))]
    found = M.match_points(spark.createDataFrame(rows, "o int, label string, stage string"), ["o"])
    assert "FlatMapGroupsInPandas" not in found._jdf.queryExecution().executedPlan().toString()
    assert {(r.label, r.point) for r in found.collect()} == {(l, p) for n in (1, 2) for l, p in M.merged_labels([(f"{k} {n}", {s}) for k, s in (("Зал", "ID"), ("Помещение", "PD"), ("помещ.", "RD"))]).items()}


def test_whole_sets_go_only_where_first_items_allow_it(spark, monkeypatch):
    r = random.Random(7)
    base = [[f"{f}-{i}" for i in range(40)] for f in range(6)]
    sets = {i: sorted({x for x in base[i % 6] if r.random() > 0.03 * (i % 8)} | {f"own{i}-{j}" for j in range(i % 5)} | {"all", "every"}) for i in range(90)}
    sets |= {100 + i: sorted({"all", "every"} | {f"{i}.{j}" for j in range(30)}) for i in range(60)}
    written, table = {}, M.scratch.table
    monkeypatch.setattr(M.scratch, "table", lambda df, name: written.setdefault(name, table(df, name)))
    d = spark.createDataFrame(list(sets.items()), "id int, w array<string>")
    got = {(x.a, x.b): (x.shared, round(x.jaccard, 9)) for x in M.set_twins(d, "id", "w", 0.5).collect()}
    first = {}
    for i, w in sets.items():
        first.setdefault(tuple(w), i)
    both = lambda a, b: len(set(sets[a]) & set(sets[b]))
    of = {(a, b): (both(a, b), round(both(a, b) / len(set(sets[a]) | set(sets[b])), 9)) for a in first.values() for b in first.values() if a < b}
    assert got == {k: v for k, v in of.items() if v[1] >= 0.5}
    assert written["pairs"].count() <= 2 * len(got)


def test_equal_titles_are_compared_once(spark):
    from tests.plans import most_rows

    sheets = spark.range(600).selectExpr("'x' AS block", "CAST(id % 2 AS INT) AS side", "id AS sheet", "concat('план этажа ', id DIV 2 % 3) AS title")
    kept = []
    greedy, M.greedy_pairs = M.greedy_pairs, lambda df, *a: kept.append(df) or df
    try:
        M.sheet_pairs(sheets, spark.createDataFrame([], "sheet long, mark int"))
    finally:
        M.greedy_pairs = greedy
    assert most_rows(kept[0], "Join") <= 300 * 36
    names = {r.sheet: (r.side, r.title) for r in sheets.collect()}
    for a in (0, 202, 598):
        likest = sorted((-round(M.token_sort_ratio(names[a][1], t), 4), b) for b, (side, t) in names.items() if side)[:12]
        assert sorted((-r.score, r.b) for r in kept[0].filter(f"a = {a}").collect()) == likest
