"""Registries and matrices from CSV, JSON, JSON lines and spreadsheets, with errors kept by row."""

from __future__ import annotations

import csv
import io
import json
import re
import struct
import zipfile
import zlib
from collections.abc import Iterator, Mapping, Sequence
from xml.etree import ElementTree

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

DELIMITERS = (";", "\t", ",")
HEADER_ROWS = 10


def delimiter_of(line: str) -> str:
    """The delimiter that a line has most of; the first of DELIMITERS on a tie."""
    return max(DELIMITERS, key=line.count)


def read_csv(spark: SparkSession, path: str, delimiter: str | None = None, header: bool = True) -> DataFrame:
    """Quoted CSV with or without a byte-order mark; all columns text, trimmed; blank rows go."""
    if delimiter is None:
        first = spark.read.text(path).limit(1).collect()
        delimiter = delimiter_of(first[0][0]) if first else ","
    df = spark.read.csv(path, sep=delimiter, header=header, multiLine=True, quote='"', escape='"', encoding="UTF-8", inferSchema=False)
    df = df.toDF(*(c.replace("﻿", "").strip() for c in df.columns))
    df = df.select(*(F.nullif(F.trim(F.col(f"`{c}`")), F.lit("")).alias(c) for c in df.columns))
    return df.filter(F.coalesce(*(F.col(f"`{c}`") for c in df.columns)).isNotNull())


def find_header(rows: Sequence[Sequence[str | None]], aliases: Mapping[str, Sequence[str]]) -> tuple[int, dict[int, str]]:
    """The first of the leading rows that names most known columns, and its columns' names."""
    known = {plain_name(a): name for name, names in aliases.items() for a in (name, *names)}
    best = (-1, {})
    for i, row in enumerate(rows[:HEADER_ROWS]):
        found = {j: known[plain_name(c)] for j, c in enumerate(row) if c and plain_name(c) in known}
        if len(found) > len(best[1]):
            best = (i, found)
    return best


def plain_name(text: str) -> str:
    return re.sub(r"[^\w]+", "", text.casefold().replace("ё", "е"))


def read_json(spark: SparkSession, path: str, schema: str, roots: Sequence[str] = ("files", "registry")) -> DataFrame:
    """Rows of a JSON array, of JSON lines, or of an array under one of ``roots``."""
    raw = spark.read.text(path, wholetext=True).select(F.trim("value").alias("v"))
    listed = [F.from_json("v", f"array<struct<{schema}>>")]
    listed += [F.get_json_object("v", f"$.{r}") for r in roots]
    array = F.coalesce(F.when(F.startswith("v", F.lit("[")), listed[0]), *(F.from_json(x, f"array<struct<{schema}>>") for x in listed[1:]))
    lines = spark.read.text(path).select(F.from_json("value", f"struct<{schema}>").alias("r"), F.get_json_object("value", f"$.{roots[0]}").isNull().alias("single"))
    whole = raw.select(F.explode(F.filter(array, lambda x: x.isNotNull())).alias("r")).select("r.*")
    names = StructType.fromDDL(schema.replace(":", " ")).names
    any_value = F.coalesce(*(F.col(f"r.{n}").cast("string") for n in names)).isNotNull()
    single = lines.filter(F.col("single") & any_value).select("r.*")
    first = spark.read.text(path).limit(1).collect()
    text = first[0][0].lstrip("﻿ ").lstrip() if first else ""
    return whole if text.startswith("[") or any(f'"{r}"' in text for r in roots) or text == "{" else single


def checked_rows(df: DataFrame, checks: Mapping[str, Column], number: str = "row") -> tuple[DataFrame, DataFrame]:
    """(good rows, errors): every failed check of every row by row number; a check that is null passes."""
    errors = F.array_compact(F.array(*(F.when(~c, F.lit(name)) for name, c in checks.items())))
    marked = df.withColumn("errors", errors)
    return marked.filter(F.size("errors") == 0).drop("errors"), marked.filter(F.size("errors") > 0).select(number, F.explode("errors").alias("error"))


def sheet_rows(data: bytes) -> list[list[str | None]]:
    """The first sheet's cells: shared and inline strings, sparse columns filled with nulls."""
    tag = lambda e: e.tag.rpartition("}")[2]
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        names = z.namelist()
        shared = []
        if "xl/sharedStrings.xml" in names:
            root = ElementTree.fromstring(z.read("xl/sharedStrings.xml"))
            shared = ["".join(t.text or "" for t in si.iter() if tag(t) == "t") for si in root if tag(si) == "si"]
        sheets = sorted((n for n in names if re.fullmatch(r"xl/worksheets/sheet\d+\.xml", n)), key=lambda n: int(re.findall(r"\d+", n)[0]))
        if not sheets:
            return []
        rows = []
        for row in (e for e in ElementTree.fromstring(z.read(sheets[0])).iter() if tag(e) == "row"):
            cells: dict[int, str | None] = {}
            for c in (e for e in row if tag(e) == "c"):
                letters = re.match(r"[A-Z]+", c.get("r") or "")
                at = sum((ord(x) - 64) * 26**i for i, x in enumerate(reversed(letters[0]))) - 1 if letters else len(cells)
                value = next((e.text for e in c.iter() if tag(e) in ("v",)), None)
                if c.get("t") == "s" and value is not None:
                    value = shared[int(value)]
                elif c.get("t") == "inlineStr":
                    value = "".join(e.text or "" for e in c.iter() if tag(e) == "t")
                cells[at] = value
            rows.append([cells.get(i) for i in range(max(cells, default=-1) + 1)])
        return rows


#: What a damaged ZIP, XML, JSON or text raises while it is read.
DAMAGED = (ValueError, zipfile.BadZipFile, zlib.error, EOFError, KeyError, IndexError, OSError, struct.error, NotImplementedError, RuntimeError, SyntaxError)
#: Rows that a task hands on at a time.
AT_ONCE = 10_000


def kind_of(data: bytes, named: str) -> str:
    """xlsx, json or csv by what a file holds; its name decides only between kinds of text."""
    if data[:4] == b"PK\x03\x04":
        return "xlsx"
    start = data.removeprefix(b"\xef\xbb\xbf").lstrip()[:1]
    return "json" if start in (b"{", b"[") and named in ("json", "jsonl", "xlsx") else "csv" if named != "xlsx" else "unknown"


def csv_records(text: str) -> Iterator[tuple[int, list[str]]]:
    """(line, cells) of quoted CSV: the delimiter is the one that most of the leading lines have most of."""
    leading = text.split("\n")[:HEADER_ROWS]
    delimiter = max(DELIMITERS, key=lambda d: (sum(delimiter_of(line) == d and d in line for line in leading), -DELIMITERS.index(d)))
    reader = csv.reader(io.StringIO(text, newline=""), delimiter=delimiter)
    began = 1
    for cells in reader:
        yield began, cells
        began = reader.line_num + 1


def json_records(text: str, roots: Sequence[str]) -> Iterator[tuple[int, dict]]:
    """(number, record) of an array, of the first list under one of ``roots``, or of a record in each line."""
    try:
        whole = json.loads(text)
    except ValueError:
        whole = None
    if isinstance(whole, dict):
        whole = next((whole[r] for r in roots if isinstance(whole.get(r), list)), [whole])
    if whole is not None:
        yield from enumerate(whole if isinstance(whole, list) else [], 1)
        return
    for i, line in enumerate(text.split("\n"), 1):
        if line.strip():
            yield i, json.loads(line)


def named_records(data: bytes, named: str, aliases: Mapping[str, Sequence[str]], anchors: Sequence[str], roots: Sequence[str]) -> Iterator[tuple[int, dict[str, str]]]:
    """(line or number, values by known name) of a file; of several columns of one name the first value counts.

    The header of a table is the first of its ten leading rows that names one of ``anchors``; without one the file
    is no table of this kind. A record that is no object has no values.
    """
    known = {plain_name(a): name for name, names in aliases.items() for a in (name, *names)}
    kind = kind_of(data, named)
    if kind == "unknown":
        raise ValueError("neither a sheet nor text")
    if kind == "json":
        for i, record in json_records(data.decode("utf-8-sig"), roots):
            out: dict[str, str] = {}
            for k, v in record.items() if isinstance(record, dict) else ():
                name = known.get(plain_name(k))
                if name and v is not None and not isinstance(v, (dict, list)):
                    out.setdefault(name, v if isinstance(v, str) else json.dumps(v))
            yield i, out
        return
    records = enumerate(sheet_rows(data), 1) if kind == "xlsx" else csv_records(data.decode("utf-8-sig"))
    columns: list[str | None] | None = None
    for i, (line, cells) in enumerate(records):
        if columns is None:
            names = [known.get(plain_name(c)) if c else None for c in cells]
            if any(n in anchors for n in names):
                columns = names
            elif i + 1 >= HEADER_ROWS:
                break
            continue
        out = {}
        for name, cell in zip(columns, cells, strict=False):
            if name and cell and cell.strip():
                out.setdefault(name, cell.strip())
        if out:
            yield line, out
    if columns is None:
        raise ValueError("no header in the leading rows")


def read_records(spark: SparkSession, path: str, named: str, aliases: Mapping[str, Sequence[str]], anchors: Sequence[str], roots: Sequence[str] = ("files", "registry")) -> DataFrame:
    """(path, row, error, known columns) of all files at ``path``: ``row`` is the line of a CSV or JSON-lines file, the row of a
    sheet, the number in a list; a file that can't be read, or has no header, is one row 0 with its error.

    A file is read by one task, record by record; such files are written by people, so they fit.
    """
    names = list(aliases)

    def run(batches):
        import pandas as pd

        for batch in batches:
            for at, data in zip(batch["path"], batch["content"], strict=True):
                rows: list[tuple] = []
                try:
                    for line, values in named_records(bytes(data), named, aliases, anchors, roots):
                        rows.append((at, line, None, *(values.get(n) for n in names)))
                        if len(rows) >= AT_ONCE:
                            yield pd.DataFrame(rows, columns=["path", "row", "error", *names])
                            rows = []
                except DAMAGED as e:
                    rows.append((at, 0, f"{type(e).__name__}: {e}", *[None] * len(names)))
                yield pd.DataFrame(rows, columns=["path", "row", "error", *names])

    ddl = "path string, row long, error string, " + ", ".join(f"`{n}` string" for n in names)
    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, ddl)


class SpreadsheetSource(DataSource):
    """``spark.read.format("sheet")`` over an .xlsx path that workers can open: row number and cells."""

    @classmethod
    def name(cls) -> str:
        return "sheet"

    def schema(self) -> str:
        return "row int, cells array<string>"

    def reader(self, schema: StructType) -> DataSourceReader:
        path = self.options["path"]

        class Reader(DataSourceReader):
            def partitions(self):
                return [InputPartition(path)]

            def read(self, partition):
                with open(partition.value.removeprefix("file://"), "rb") as f:
                    try:
                        rows = sheet_rows(f.read())
                    except DAMAGED as e:
                        raise ValueError(f"{partition.value} is no readable sheet: {e}") from e
                yield from enumerate(rows)

        return Reader()


def read_sheets(spark: SparkSession, path: str) -> DataFrame:
    """(path, row, cells, error) of the first sheets of all files at ``path``, in any store that Spark reads.

    A damaged file is one row without a number and cells, with its error.
    """

    def run(batches):
        import pandas as pd

        for batch in batches:
            for p, data in zip(batch["path"], batch["content"], strict=True):
                try:
                    out = [(p, i, cells, None) for i, cells in enumerate(sheet_rows(bytes(data)))]
                except DAMAGED as e:
                    out = [(p, None, None, f"{type(e).__name__}: {e}")]
                yield pd.DataFrame(out, columns=["path", "row", "cells", "error"]).astype({"row": "Int32"})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "path string, row int, cells array<string>, error string")
