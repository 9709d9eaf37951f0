"""Registries, matrices, archives, layouts and job states on small cases."""

import io
import zipfile

import pytest
from pyspark.sql import functions as F

from stagewise.functions import lexicon as L
from stagewise.functions import rules
from stagewise.operators import layout as O
from stagewise.sources import intake as I
from stagewise.sources import tabular
from stagewise.streaming import jobs


def test_sheet_header_and_kinds(spark):
    rows = spark.createDataFrame([(0, ["Реестр документов", None]), (1, ["Имя файла", "Стадия", "Хеш"]), (2, ["a.pdf", " ПД ", ""]), (3, ["b.pdf"])], "row int, cells array<string>")
    got = I.mapped_sheet(rows).orderBy("row").collect()
    assert [(r.row, r.file_name, r.doc_stage, r.sha256) for r in got] == [(2, "a.pdf", "ПД", None), (3, "b.pdf", None, None)]
    with pytest.raises(ValueError):
        I.read_registry(spark, "/nowhere/registry.docx")


def test_every_fault_of_a_row_and_the_whole_registry(spark):
    names = list(I.ALIASES)
    row = lambda **k: (k.pop("row"), *(k.get(n) for n in names))
    df = spark.createDataFrame([row(row=1, file_name="a", doc_stage="рд", approval_date="01.02.2024"), row(row=2, doc_stage="x", sha256="y", approval_date="z"), row(row=3, title="t")], "row long, " + ", ".join(f"{n} string" for n in names))
    good, errors = I.registry_rows(df)
    assert [(r.row, r.doc_stage, str(r.approval_date)) for r in good.collect()] == [(1, "RD", "2024-02-01")]
    assert {(r.row, r.error) for r in errors.collect()} == {(2, "sha256"), (2, "doc_stage"), (2, "approval_date"), (3, "file_name")}
    assert I.accepted(good, errors)[0].count() == 0 and I.accepted(good, errors.limit(0))[0].count() == 1


def test_matrix_import(spark):
    current = spark.createDataFrame([("a", 1), ("b", 2), ("c", 3)], "code string, x int")
    new = spark.createDataFrame([("b", 2), ("c", 9), ("d", 4)], "code string, x int")
    merged, report = I.upserted(current, new)
    assert {(r.code, r.x) for r in merged.collect()} == {("a", 1), ("b", 2), ("c", 9), ("d", 4)}
    assert {r.code: r.change for r in report.collect()} == {"a": "absent", "b": "unchanged", "c": "updated", "d": "added"}
    assert I.invalid_keys(new).isEmpty() and I.invalid_keys(new.unionByName(new.limit(1))).count() == 1


def zipped(**files: bytes) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, body in files.items():
            z.writestr(name.replace("__", "/"), body)
    return out.getvalue()


def test_archives_and_their_limits(spark):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("../evil", b"x")
    df = spark.createDataFrame([("ok", zipped(a=b"1", b__c=b"22")), ("big", zipped(a=b"1" * 100)), ("many", zipped(a=b"", b=b"", c=b"")), ("evil", out.getvalue()), ("no", b"zip"), ("null", None)], "path string, content binary")
    got = I.unzipped(df, most_entries=2, most_entry=50).collect()
    assert {(r.path, r.name, r.size) for r in got if not r.error} == {("ok", "a", 1), ("ok", "b/c", 2)}
    assert {r.path for r in got if r.error} == {"big", "many", "evil", "no", "null"}


def one(spark, column, text):
    return spark.createDataFrame([(text,)], "t string").select(column(F.col("t"))).first()[0]


def test_names_in_any_form(spark):
    assert one(spark, L.element, "монтаж стены подвала") == "Стены подвала" and one(spark, L.element, "стенд") is None and one(spark, L.element, None) is None
    assert one(spark, L.element, "вертикальные монолитные конструкции, отм. -3,150") == "Вертикальные конструкции подземной части"
    assert one(spark, lambda t: L.contains(t, ("лестничные марши",)), "устройство лестничных сборных маршей") is True
    assert one(spark, lambda t: L.contains(t, ("лестничные марши",)), "лестничных очень больших маршей") is False
    assert one(spark, L.systems, None) == [] and one(spark, L.systems, "B1.2,3 / x / 1.4") == ["В1.2", "В1.3"]
    assert one(spark, L.unit_in_label, "Площадь застройки, м²") == "area" and one(spark, L.label_suffix, "а б в г д е ж з и :") == "б в г д е ж з и"


def test_outlets(spark):
    got = one(spark, L.outlet_values, "Выпуск 3-К2 Ø160; выпуски бытовой канализации Ду100 в футляре Ø325. Стояк К1 Ø110")
    assert [(r.key, r.diameter) for r in got] == [("Выпуск К2-3", 160.0), ("Выпуски К1", 100.0)]


def test_rule_precedence():
    read = lambda t: rules.Reader(t).whole()
    a, b, c = (rules.Ref(x, "PD") for x in "ABC")
    assert read("not A.PD = 1 and B.PD or C.PD") == ("or", ("and", ("not", ("compare", "==", a, 1.0)), ("truth", b)), ("truth", c))
    assert read("A.PD or B.PD and (C.PD or not true)")[0] == "or"
    for bad in ("(A.PD > 1) > 2", "A.PD > 1 > 2", "A.PD B.PD", "exists A.PD", "()", "", "not"):
        with pytest.raises(rules.RuleError):
            read(bad)
    assert rules.unknown_codes([("r", "A.PD > B.RD", "true")], ["A"]) == {"r": ["B"]}


def test_words_become_a_table(spark):
    rows = [(1, "a", 0.0), (2, "b", 0.05), (3, "10", 0.5), (4, "c", 0.01), (5, "20", 0.52)]
    df = spark.createDataFrame([(0, n, t, x, (0.0 if n < 4 else 0.5) + n * 1e-3, x + 0.04, (0.0 if n < 4 else 0.5) + 0.1) for n, t, x in rows], "page int, n int, text string, x0 double, y0 double, x1 double, y1 double")
    got = {(r.band, r.column): r.text for r in O.tables_of_words(df, ["page"]).collect()}
    assert got == {(0, 0): "a b", (0, 1): "10", (1, 0): "c", (1, 1): "20"}


def test_job_states():
    walk = lambda *signs: __import__("functools").reduce(lambda s, x: jobs.next_state(*s, x), signs, ("SENT", 1))
    assert walk("FAILED", "FAILED", "DONE") == ("DONE", 3) and walk("FAILED", "FAILED", "FAILED", "DONE") == ("FAILED", 3)
    assert walk("TIMEOUT", "DONE") == ("FAILED", 1) and walk("SUPERSEDED", "FAILED") == ("SUPERSEDED", 1)


def test_damaged_archives_end_no_job(spark):
    """Every archive with one byte changed gives its files or one error row."""
    good = zipped(a=b"one " * 60, b__c=b"two " * 60)
    rows = [(str(i), bytes([*good[:i], good[i] ^ 0xFF, *good[i + 1 :]])) for i in range(0, len(good), 3)]
    got = I.unzipped(spark.createDataFrame(rows, "path string, content binary").repartition(4)).collect()
    assert {r.path for r in got} == {p for p, _ in rows}
    for p, _ in rows:
        mine = [r for r in got if r.path == p]
        assert all(r.error is None for r in mine) or (len(mine) == 1 and mine[0].error and mine[0].content is None)


def registry_of(spark, folder, kind, **files):
    folder.mkdir()
    for name, body in files.items():
        (folder / f"{name}.{kind}").write_bytes(body if isinstance(body, bytes) else body.encode())
    return I.read_registry(spark, str(folder), kind)


def test_registry_headers_lines_and_damage(spark, tmp_path):
    late = "\n" * 11 + "file_name;stage\na;RD\n"
    rows = registry_of(
        spark, tmp_path / "c", "csv", a='Title, with, commas\n\nFile name;Stage;note\n"two\nlines";RD;x\nb;??;\n;;\n', b="sha256,stage\n" + "0" * 64 + ",PD\n", c=late, d=b"\xff\xfe\x00 no text", e="", f=b"PK\x03\x04 torn",
    )
    name = F.regexp_extract("path", r"(\w+)\.csv", 1).alias("file")
    assert {(r.file, r.row, r.file_name, r.doc_stage) for r in rows.filter("error IS NULL").select(name, "row", "file_name", "doc_stage").collect()} == {("a", 4, "two\nlines", "RD"), ("a", 6, "b", "??"), ("b", 2, None, "PD")}
    assert {(r.file, r.row) for r in rows.filter("error IS NOT NULL").select(name, "row").collect()} == {(f, 0) for f in "cdf"}
    errors = I.registry_rows(rows)[1].collect()
    assert sorted((r.row, r.error) for r in errors) == [(0, "file")] * 3 + [(6, "doc_stage")]


def test_json_registries(spark, tmp_path):
    rows = registry_of(spark, tmp_path / "j", "json", a='{"files": [{"File Name": "a", "x": {}}, 7], "expected": [{"doc_stage": "РД", "title": "t"}, {"title": "no stage"}]}', b='[{"file_name": "b", "revision": 2}]', c='{"file_name": "c"}\n\n{"sha256": "d"}', d='{"file_name": ')
    got = {(r.path[-6], r.row, r.file_name, r.sha256, r.revision, r.error is None) for r in rows.collect()}
    assert got == {("a", 1, "a", None, None, True), ("a", 2, None, None, None, True), ("b", 1, "b", None, "2", True), ("c", 1, "c", None, None, True), ("c", 3, None, "d", None, True), ("d", 0, None, None, None, False)}
    found, errors = I.read_expected(spark, str(tmp_path / "j"))
    assert [(r.row, r.doc_stage, r.title) for r in found.collect()] == [(1, "RD", "t")] and [(r.row, r.error) for r in errors.collect()] == [(2, "doc_stage")]


def test_damaged_sheets_are_rows(spark, tmp_path):
    (tmp_path / "s").mkdir()
    (tmp_path / "s" / "a.xlsx").write_bytes(b"PK\x03\x04 torn")
    (tmp_path / "s" / "b.xlsx").write_bytes(zipped(xl__worksheets__sheet1_xml=b"").replace(b"sheet1_xml", b"sheet1.xml"))
    got = tabular.read_sheets(spark, str(tmp_path / "s")).collect()
    assert len(got) == 2 and all(r.error and r.cells is None for r in got)


def test_a_matrix_with_repeated_codes_is_refused(spark):
    current = spark.createDataFrame([("a", 1)], "code string, x int")
    merged, report = I.upserted(current, spark.createDataFrame([("b", 1), ("b", 2), (None, 3), ("c", 4)], "code string, x int"))
    assert [tuple(r) for r in merged.collect()] == [("a", 1)] and {tuple(r) for r in report.collect()} == {("b", "invalid"), (None, "invalid")}


def test_archives_of_many_documents_are_whole(spark, tmp_path):
    from stagewise.plans import registry

    spark.range(7 * 5002).selectExpr("id AS doc_id", "CASE WHEN id % 5 > 0 THEN CAST(id AS string) END AS text").filter("doc_id % 7 IN (0, 3)").write.parquet(f"{tmp_path}/documents.parquet")
    got = registry.queries()["src21_archives"](spark, str(tmp_path)).groupBy("path").agg(F.count("*").alias("n"), F.count_distinct("name").alias("names")).collect()
    assert {(r.path, r.n, r.names) for r in got} == {("a0.zip", 5002, 5002), ("a3.zip", 1, 0)}
