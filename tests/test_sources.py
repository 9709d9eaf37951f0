import io
import zipfile

from pyspark.sql import functions as F

from stagewise.sources import documents, tabular


def workbook(rows):
    cells = "".join(
        f'<row r="{i}">' + "".join(f'<c r="{chr(65 + j)}{i}" t="inlineStr"><is><t>{v}</t></is></c>' for j, v in enumerate(row) if v is not None) + "</row>" for i, row in enumerate(rows, 1)
    )
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet xmlns="x"><sheetData>{cells}</sheetData></worksheet>')
    return out.getvalue()


def test_csv(spark, tmp_path):
    (tmp_path / "r.csv").write_text('﻿имя;код\n"a ""b"";c"; 1 \n;\n"two\nlines";2\n', encoding="utf-8")
    got = tabular.read_csv(spark, str(tmp_path / "r.csv")).collect()
    assert [tuple(r) for r in got] == [('a "b";c', "1"), ("two\nlines", "2")]
    assert got[0].__fields__ == ["имя", "код"]


def test_header_and_errors(spark):
    at, names = tabular.find_header([["Реестр"], ["Имя файла", "Стадия", "?"], ["a.pdf", "ПД"]], {"file_name": ["имя файла"], "stage": ["стадия"]})
    assert (at, names) == (1, {0: "file_name", 1: "stage"})
    df = spark.createDataFrame([(1, "PD"), (2, "??")], "row int, stage string")
    good, errors = tabular.checked_rows(df, {"stage": F.col("stage").isin("PD", "RD", "ID")})
    assert [r.row for r in good.collect()] == [1] and [tuple(r) for r in errors.collect()] == [(2, "stage")]


def test_sheets(spark, tmp_path):
    (tmp_path / "r.xlsx").write_bytes(workbook([["a", None, "c"], ["1"]]))
    got = tabular.read_sheets(spark, str(tmp_path / "r.xlsx")).orderBy("row").collect()
    assert [r.cells for r in got] == [["a", None, "c"], ["1"]]
    spark.dataSource.register(tabular.SpreadsheetSource)
    assert spark.read.format("sheet").load(str(tmp_path / "r.xlsx")).count() == 2


def test_json_forms(spark, tmp_path):
    for name, body in {"a.json": '[{"n": "x"}, {"n": "y"}]', "b.json": '{"files": [{"n": "x"}, {"n": "y"}]}', "c.jsonl": '{"n": "x"}\n{"n": "y"}\n'}.items():
        (tmp_path / name).write_text(body)
        assert sorted(r.n for r in tabular.read_json(spark, str(tmp_path / name), "n:string").collect()) == ["x", "y"], name


def test_blocks(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "d.docx", "w") as z:
        z.writestr("word/document.xml", '<w:d xmlns:w="w"><w:p><w:t>one </w:t><w:t>line</w:t></w:p><w:p/><w:tbl><w:p><w:t>cell</w:t></w:p></w:tbl></w:d>')
    (tmp_path / "e.xml").write_text('<a x="1"><b>text</b></a>')
    (tmp_path / "f.xml").write_text("<broken")
    got = documents.read_blocks(spark, str(tmp_path)).collect()
    by = {}
    for r in sorted(got, key=lambda r: (r.path, r.block)):
        by.setdefault(r.path[-6:], []).append(r.text or r.error)
    assert by == {"d.docx": ["one line", "cell"], "/e.xml": ["/a@x: 1", "/a/b: text"], "/f.xml": ["ParseError"]}


def word_file(body, **parts):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="w"><w:body>{body}</w:body></w:document>')
        for name, text in parts.items():
            z.writestr(f"word/{name}.xml", f'<w:hdr xmlns:w="w">{text}</w:hdr>')
    return out.getvalue()


def test_word_pages(spark):
    p = lambda t, more="": f"<w:p>{more}<w:r><w:t>{t}</w:t></w:r></w:p>"
    c = lambda t, more="": f"<w:tc>{more}{t}</w:tc>"
    stamp = f"<w:tbl><w:tr>{c(p('sheet'))}{c(p('7'))}</w:tr></w:tbl>"
    wide = '<w:tcPr><w:gridSpan w:val="2"/></w:tcPr>'
    grid = f"<w:tbl><w:tr>{c(p('a'), wide)}{c(p('b'))}</w:tr><w:tr>{c('')}{c('')}</w:tr><w:tr>{c(p('c') + stamp)}</w:tr></w:tbl>"
    files = {
        "a": word_file(p("x" * 101) + f"<w:sdt><w:sdtContent>{grid}</w:sdtContent></w:sdt>" + p("") + p("end", "<w:pPr><w:pageBreakBefore/></w:pPr>"), header1=p("top") + stamp, footer1=p("top")),
        "b": word_file(p("y" * 4900) + "<w:tbl>" + f"<w:tr>{c(p('1'))}</w:tr>" * 3 + "</w:tbl>" + p("z" * 9000)),
        "c": b"no archive", "d": word_file("")[:-30], "e": None, "f": word_file("<w:tbl/>"),
        "g": word_file(f"<w:tbl><w:tr>{c(p('a'), wide.replace('2', 'two'))}</w:tr></w:tbl>"),
    }
    got = {}
    for r in documents.word_pages(spark.createDataFrame(list(files.items()), "path string, content binary")).collect():
        got.setdefault(r.path, []).append(r.error or (r.page, r.line, r.kind, r.table, r.row, r.column, r.span, r.text[:7]))
    none = (None,) * 4
    assert got["a"] == [
        (1, 0, "title_block", *none, "top"), (1, 1, "title_block", *none, "sheet 7"), (1, 2, "text", *none, "x" * 7),
        (1, 4, "row", 0, 0, None, None, "a b"), (1, 4, "cell", 0, 0, 0, 2, "a"), (1, 4, "cell", 0, 0, 2, 1, "b"),
        (1, 5, "row", 0, 1, None, None, "c sheet"), (1, 5, "cell", 0, 1, 0, 1, "c sheet"), (2, 0, "text", *none, "end"),
    ]
    assert [x[:6] for x in got["b"] if x[2] != "row"] == [(1, 0, "text", *none[:3]), (1, 49, "cell", 0, 0, 0), (2, 0, "cell", 0, 0, 0), (2, 1, "cell", 0, 1, 0), (3, 0, "text", *none[:3])]
    assert got["c"] == got["d"] == got["e"] == ["BadZipFile"] and "f" not in got and got["g"] == ["ValueError"]
