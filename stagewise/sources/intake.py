"""Intake of registries, matrices, labels, parsed documents and archives: read, mapped, checked, merged."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator, Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stagewise.functions import text as T

from .tabular import DAMAGED, checked_rows, find_header, plain_name, read_csv, read_records

# Registry columns and the other names that they have, without case, marks and spaces.
ALIASES = {
    "file_id": ("fileid", "идентификаторфайла", "idфайла", "кодфайла"),
    "file_name": ("filename", "имяфайла", "исходноеимя", "исходноеимяфайла", "наименованиефайла", "файл", "originalname", "relativepath", "sourcerelativepath"),
    "sha256": ("sha256", "sha", "хеш", "хэш", "контрольнаясумма", "hash", "sourcesha256"),
    "object_id": ("objectid", "идентификаторобъекта", "надзорноедело", "object"),
    "doc_stage": ("docstage", "stage", "стадия"),
    "discipline": ("discipline", "раздел", "марка", "разделмарка", "разделмаркакомплекта", "section"),
    "document_code": ("documentcode", "code", "шифр", "шифрдокумента", "шифркомплекта"),
    "revision": ("revision", "редакция", "изменение", "изм", "номерредакции"),
    "approval_status": ("approvalstatus", "статусутверждения", "статус"),
    "approval_date": ("approvaldate", "датаутверждения", "датавыдачи", "дата"),
    "predecessor_id": ("predecessorid", "predecessor", "предшественник", "заменяет", "предыдущаяредакция"),
    "successor_id": ("successorid", "successor", "преемник", "замененана", "следующаяредакция"),
    "title": ("title", "наименование", "название", "наименованиедокумента"),
}
# Names of stages and of approval states.
STAGE_NAMES = {"pd": "PD", "пд": "PD", "rd": "RD", "рд": "RD", "id": "ID", "ид": "ID"}
APPROVALS = ("DRAFT", "APPROVED", "FOR_CONSTRUCTION", "SUPERSEDED", "CANCELLED")
# How a registry's file is called.
REGISTRY_NAME = r"(?iU)(?:^|/)(?:document_)?(?:registry|manifest|реестр|перечень)[^/]*\.(?:csv|tsv|json|jsonl|xlsx)$"
SHOWN_ERRORS = 50


def looks_like_registry(path: Column) -> Column:
    """Whether a file is a registry by its name; null is none."""
    return F.coalesce(T.nfc(path).rlike(REGISTRY_NAME), F.lit(False))


def mapped(df: DataFrame, aliases: Mapping[str, Sequence[str]] = ALIASES) -> DataFrame:
    """The known columns by their own names; of several columns of one name the first value counts, missing ones are null."""
    known = {plain_name(a): name for name, names in aliases.items() for a in (name, *names)}
    found: dict[str, list[Column]] = {n: [] for n in aliases}
    for c in df.columns:
        found.get(known.get(plain_name(c), ""), []).append(F.col(f"`{c}`").cast("string"))
    return df.select(*(F.coalesce(*found[n], F.lit(None).cast("string")).alias(n) for n in aliases))


def mapped_sheet(rows: DataFrame, aliases: Mapping[str, Sequence[str]] = ALIASES, leading: int = 10) -> DataFrame:
    """(row, known columns) of a sheet's (row, cells): the header is the best of the leading rows, which alone reach the driver."""
    head = [r["cells"] for r in rows.orderBy("row").limit(leading).collect()]
    at, places = find_header(head, aliases)
    by_name = {name: j for j, name in reversed(places.items())}
    cell = lambda n: F.nullif(F.trim(F.get("cells", F.lit(by_name[n]))), F.lit("")) if n in by_name else F.lit(None).cast("string")
    return rows.filter(F.col("row") > at).select("row", *(cell(n).alias(n) for n in aliases))


# A row with one of these names is a registry's header.
ANCHORS = ("file_name", "sha256", "file_id")
EXPECTED = {"doc_stage": (), "discipline": (), "document_code": (), "title": ()}


def read_registry(spark: SparkSession, path: str, kind: str | None = None, aliases: Mapping[str, Sequence[str]] = ALIASES) -> DataFrame:
    """(path, row, error, known columns) of registries as csv, json, jsonl or xlsx: by the path's ending if ``kind`` isn't given, and by content.

    The header is looked for in the ten leading rows; ``row`` is the place in the file (see ``read_records``). A
    damaged file, or one without a header, is a row 0 with an error; an empty file has no rows.
    """
    kind = kind or path.rstrip("/").rpartition(".")[2].lower()
    if kind not in ("csv", "tsv", "json", "jsonl", "xlsx"):
        raise ValueError(f"a registry is csv, json, jsonl or xlsx, not {kind!r}")
    return read_records(spark, path, kind, aliases, ANCHORS)


def read_expected(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(expected documents, errors by row) of the ``expected`` lists of JSON registries; other files have none.

    Stages get their own names; an unknown or missing one is an error of its entry.
    """
    lists = spark.read.format("binaryFile").load(path).select("path", F.decode("content", "UTF-8").alias("text"))
    fields = ", ".join(f"{n}: string" for n in EXPECTED)
    rows = lists.select("path", F.posexplode(F.from_json(F.get_json_object("text", "$.expected"), f"array<struct<{fields}>>")).alias("at", "e"))
    stages = F.create_map(*(F.lit(x) for kv in STAGE_NAMES.items() for x in kv))
    stage = F.element_at(stages, F.lower(F.trim("e.doc_stage")))
    found = rows.select("path", (F.col("at") + 1).cast("long").alias("row"), stage.alias("doc_stage"), *(F.col(f"e.{n}").alias(n) for n in list(EXPECTED)[1:]))
    return found.filter("doc_stage IS NOT NULL"), found.filter("doc_stage IS NULL").select("path", "row", F.lit("doc_stage").alias("error"))


def registry_rows(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(good rows, errors by row): values in their own form, every fault of every row kept; a file that couldn't be read is a fault of its row 0."""
    stage, approval = F.lower(F.trim("doc_stage")), F.upper(F.trim("approval_status"))
    stages = F.create_map(*(F.lit(x) for kv in STAGE_NAMES.items() for x in kv))
    date = T.any_date(F.trim("approval_date"))
    given = rows.select(
        *(c for c in rows.columns if c not in ("doc_stage", "approval_status", "approval_date", "sha256")), F.lower(F.trim("sha256")).alias("sha256"),
        F.element_at(stages, stage).alias("doc_stage"), F.when(approval.isin(*APPROVALS), approval).alias("approval_status"), date.alias("approval_date"),
        stage.alias("_stage"), approval.alias("_approval"), F.col("approval_date").alias("_date"),
    )
    checks = {"file": F.col("error").isNull()} if "error" in rows.columns else {}
    checks |= {
        "sha256": F.col("sha256").rlike("^[0-9a-f]{64}$"),
        "doc_stage": F.col("_stage").isNull() | F.col("doc_stage").isNotNull(),
        "approval_status": F.col("_approval").isNull() | F.col("approval_status").isNotNull(),
        "approval_date": F.col("_date").isNull() | F.col("approval_date").isNotNull(),
        "file_name": F.col("file_name").isNotNull() | F.col("sha256").isNotNull() | (F.col("error").isNotNull() if "error" in rows.columns else F.lit(False)),
    }
    good, errors = checked_rows(given, checks)
    return good.drop("_stage", "_approval", "_date", "error"), errors


def accepted(good: DataFrame, errors: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A registry counts as a whole: with any error no row is taken, and the first errors are shown."""
    shown = errors.orderBy("row", "error").limit(SHOWN_ERRORS)
    return (good if errors.isEmpty() else good.limit(0)), shown


def read_matrix(spark: SparkSession, path: str, lists: Sequence[str] = ("enum_values", "regulations"), numbers: Sequence[str] = ("min_value", "max_value")) -> DataFrame:
    """A matrix CSV with its lists split at bars and its bounds as numbers; blanks are null."""
    df = read_csv(spark, path)
    for c in lists:
        if c in df.columns:
            df = df.withColumn(c, F.filter(F.transform(F.split(c, r"\|"), lambda x: F.trim(x)), lambda x: x != ""))
    for c in numbers:
        if c in df.columns:
            df = df.withColumn(c, T.number(F.col(c)))
    return df


def upserted(current: DataFrame, incoming: DataFrame, key: str = "code") -> tuple[DataFrame, DataFrame]:
    """(merged table, report): incoming rows win, absent ones stay; the report has added, updated, unchanged and absent by key.

    Keys that repeat in the incoming table, or are null, make the import invalid: nothing is taken, and the report has
    these keys alone, as invalid.
    """
    invalid = invalid_keys(incoming, key)
    if not invalid.isEmpty():
        return current, invalid.select(key, F.lit("invalid").alias("change"))
    columns = [c for c in current.columns if c != key]
    old = current.select(key, F.struct(*columns).alias("_old"))
    new = incoming.select(key, F.struct(*(F.col(c).cast(current.schema[c].dataType).alias(c) for c in columns)).alias("_new"))
    both = old.join(new, key, "full")
    change = F.when(F.col("_old").isNull(), "added").when(F.col("_new").isNull(), "absent").when(F.col("_old").eqNullSafe(F.col("_new")), "unchanged").otherwise("updated")
    return both.select(key, F.coalesce("_new", "_old").alias("_row")).select(key, "_row.*"), both.select(key, change.alias("change"))


def invalid_keys(incoming: DataFrame, key: str = "code") -> DataFrame:
    """(key, rows): keys that repeat or are null; none means that the import can go on."""
    return incoming.groupBy(key).agg(F.count("*").alias("rows")).filter((F.col("rows") > 1) | F.col(key).isNull())


def merged_cache(kept: DataFrame, incoming: DataFrame, keys: Sequence[str] = ("sha256", "version")) -> DataFrame:
    """The incoming entries that the cache lacks, each once: appending them again adds nothing."""
    return incoming.dropDuplicates(list(keys)).join(kept.select(*keys), list(keys), "left_anti")


def corpus_summary(files: DataFrame) -> DataFrame:
    """(extension, files, bytes, newest) of listed files: path, length and modificationTime, as ``binaryFile`` gives them."""
    extension = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))
    return files.groupBy(extension.alias("extension")).agg(F.count("*").alias("files"), F.sum("length").alias("bytes"), F.max("modificationTime").alias("newest"))


def listed_files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """(path, length, modificationTime) of all files below a folder; contents aren't read."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(path).select("path", "length", "modificationTime")


def read_labels(spark: SparkSession, path: str, splits: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(labels, broken lines) of JSON lines with id, label and perhaps split; ``splits`` (id, split) has the last word."""
    lines = spark.read.text(path).filter(F.trim("value") != "").select("value", F.from_json("value", "id string, label string, split string").alias("r"))
    good = lines.filter("r.id IS NOT NULL AND r.label IS NOT NULL").select("r.*")
    if splits is not None:
        index = splits.select(F.col("id").cast("string").alias("id"), F.col("split").alias("_split"))
        good = good.join(index, "id", "left").select("id", "label", F.coalesce("_split", "split").alias("split"))
    return good, lines.filter("r.id IS NULL OR r.label IS NULL").select("value")


PARSED = "file_id string, pages array<struct<number:int,blocks:array<struct<text:string,bbox:array<double>>>,tables:array<struct<cells:array<struct<row:int,column:int,text:string>>>>,quality:string>>"


def parsed_blocks(documents: DataFrame, body: str = "body") -> tuple[DataFrame, DataFrame]:
    """(blocks, cells) of parsed documents as JSON text: one row each, with file, page and place; broken JSON gives none."""
    pages = documents.select(F.from_json(body, PARSED).alias("d")).select("d.file_id", F.explode("d.pages").alias("p"))
    blocks = pages.select("file_id", F.col("p.number").alias("page"), F.col("p.quality").alias("quality"), F.posexplode("p.blocks").alias("place", "b")).select("file_id", "page", "quality", "place", "b.text", "b.bbox")
    tables = pages.select("file_id", F.col("p.number").alias("page"), F.posexplode("p.tables").alias("table", "t"))
    return blocks, tables.select("file_id", "page", "table", F.explode("t.cells").alias("c")).select("file_id", "page", "table", "c.*")


def unzipped(archives: DataFrame, most_entries: int = 5000, most_entry: int = 1 << 30, most_total: int = 2 << 30) -> DataFrame:
    """(path, name, size, content, error) of the files in ZIP archives (path, content).

    Sizes are held against the limits before anything is unpacked; an archive that breaks one, is damaged
    or has a name that leads out of it gives one row with the error and no files. Folders aren't rows. An archive is
    checked whole and then unpacked entry by entry, so a task holds one entry at a time.
    """

    def entries(path: str, data: bytes) -> Iterator[tuple]:
        with zipfile.ZipFile(io.BytesIO(data)) as z:
            infos = [i for i in z.infolist() if not i.is_dir()]
            if len(infos) > most_entries:
                raise ValueError("too many entries")
            if any(i.file_size > most_entry for i in infos) or sum(i.file_size for i in infos) > most_total:
                raise ValueError("entries are too large")
            if any(i.filename.startswith("/") or ".." in i.filename.replace("\\", "/").split("/") for i in infos):
                raise ValueError("a name leads out of the archive")
            if damaged := z.testzip():  # reads all in small blocks
                raise ValueError(f"{damaged} is damaged")
            for i in infos:
                yield path, i.filename, i.file_size, z.read(i), None

    def run(batches):
        import pandas as pd

        columns = ["path", "name", "size", "content", "error"]
        for batch in batches:
            for path, data in zip(batch["path"], batch["content"], strict=True):
                try:
                    for entry in entries(path, bytes(data or b"")):
                        yield pd.DataFrame([entry], columns=columns)
                except DAMAGED as e:
                    yield pd.DataFrame([(path, None, None, None, str(e) or type(e).__name__)], columns=columns)

    return archives.select("path", "content").mapInPandas(run, "path string, name string, size long, content binary, error string")
