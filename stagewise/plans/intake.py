"""Intake queries: the tables are written as files of the kinds that are read, then read back by the operators."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stagewise import scratch
from stagewise.sources import intake as I

from .registry import Tables, query


def place(spark: SparkSession, ending: str) -> str:
    return f"{scratch.folder(spark)}/intake-{uuid.uuid4().hex}.{ending}"


REGISTRY_SQL = """r AS (SELECT p_partkey, p_name || '.pdf' file_name, CASE WHEN p_size % 5 = 0 THEN 'nohash' ELSE sha256(p_partkey::VARCHAR) END sha, ['ПД','rd','ИД','xx'][p_size % 4 + 1] stage,
  CASE WHEN p_size % 6 = 0 THEN 'LOST' ELSE 'APPROVED' END approval, CASE WHEN p_size % 7 = 0 THEN '31.31.2024' ELSE '05.02.2024' END dated FROM part)"""


def written_registry(t: Tables, kind: str) -> str:
    size = F.col("p_size")
    rows = t.part.select(
        F.concat("p_name", F.lit(".pdf")).alias("Имя файла"), F.when(size % 5 == 0, "nohash").otherwise(F.sha2(F.col("p_partkey").cast("string"), 256)).alias("Хеш"),
        F.element_at(F.array(*map(F.lit, ("ПД", "rd", "ИД", "xx"))), size % 4 + 1).alias("Стадия"), F.when(size % 6 == 0, "LOST").otherwise("APPROVED").alias("Статус"),
        F.when(size % 7 == 0, "31.31.2024").otherwise("05.02.2024").alias("Дата утверждения"), F.col("p_partkey").cast("string").alias("Шифр"),
    )
    path = place(t.spark, kind)
    if kind == "csv":
        rows.write.csv(path, header=True, sep=";")
    else:
        names = {"Имя файла": "file_name", "Хеш": "sha256", "Стадия": "stage", "Статус": "approval_status", "Дата утверждения": "approval_date", "Шифр": "code"}
        rows.withColumnsRenamed(names).write.json(path)
    return path


ERRORS_SQL = f"""WITH {REGISTRY_SQL}, e AS (SELECT unnest(list_filter([CASE WHEN sha = 'nohash' THEN 'sha256' END, CASE WHEN stage = 'xx' THEN 'doc_stage' END, CASE WHEN approval = 'LOST' THEN 'approval_status' END,
  CASE WHEN dated = '31.31.2024' THEN 'approval_date' END], lambda x: x IS NOT NULL)) error FROM r) SELECT error, count(*) n FROM e GROUP BY 1"""


@query("src06_src10_registry_errors", ERRORS_SQL)
def src06(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A registry as CSV with the names of its own language: dispatch, delimiter, header mapping, faults by row."""
    _, errors = I.registry_rows(I.read_registry(spark, written_registry(Tables(spark, sf_dir), "csv")))
    return errors.groupBy("error").agg(F.count("*").alias("n"))


@query("src07_src09_registry_rows", f"""WITH {REGISTRY_SQL} SELECT p_partkey::VARCHAR document_code, file_name, CASE stage WHEN 'ПД' THEN 'PD' WHEN 'rd' THEN 'RD' ELSE 'ID' END doc_stage, sha sha256, '2024-02-05' approved FROM r
  WHERE sha <> 'nohash' AND stage <> 'xx' AND approval <> 'LOST' AND dated <> '31.31.2024'""")
def src07(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same registry as JSON lines; the rows without a fault."""
    good, _ = I.registry_rows(I.read_registry(spark, written_registry(Tables(spark, sf_dir), "jsonl")))
    return good.select("document_code", "file_name", "doc_stage", "sha256", F.col("approval_date").cast("string").alias("approved"))


@query("src08_rejected_registry", f"WITH {REGISTRY_SQL} SELECT 0::BIGINT accepted_rows, least(50, (SELECT sum(n) FROM ({ERRORS_SQL})))::BIGINT shown_errors")
def src08_rejected(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, shown = I.accepted(*I.registry_rows(I.read_registry(spark, written_registry(Tables(spark, sf_dir), "csv"))))
    return rows.agg(F.count("*").alias("accepted_rows")).crossJoin(shown.agg(F.count("*").alias("shown_errors")))


@query("src08_errors_by_line", """WITH r AS (SELECT p_size, row_number() OVER (ORDER BY p_partkey) + 3 AS row FROM part) SELECT row, 'doc_stage' error FROM r WHERE p_size % 4 = 3 UNION ALL SELECT row, 'sha256' FROM r WHERE p_size % 5 = 0""")
def src08_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A registry with a title and a blank line above its header; an error names its line in the file."""
    size, quoted = F.col("p_size"), lambda c: F.concat(F.lit('"'), c, F.lit('"'))
    stage = F.element_at(F.array(*map(F.lit, ("ПД", "rd", "ИД", "xx"))), size % 4 + 1)
    line = F.concat_ws(";", quoted(F.concat("p_name", F.lit('; ""a"".pdf'))), stage, F.when(size % 5 == 0, "nohash").otherwise(F.sha2(F.col("p_partkey").cast("string"), 256)))
    head = spark.createDataFrame([(-3, "Реестр документов, лист 1, экз. 2, том 3"), (-2, ""), (-1, "Имя файла;Стадия;Хеш")], "n long, value string")
    path = place(spark, "csv")
    head.unionByName(Tables(spark, sf_dir).part.select(F.col("p_partkey").alias("n"), line.alias("value"))).coalesce(1).sortWithinPartitions("n").select("value").write.text(path)
    return I.registry_rows(I.read_registry(spark, path, "csv"))[1]


@query("src09_expected_documents", """SELECT p_brand discipline, CASE p_size % 3 WHEN 0 THEN 'PD' ELSE 'RD' END doc_stage, p_name title FROM part WHERE p_size % 3 <> 2""")
def src09_expected(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents that JSON registries (here, one for each brand) say should be there; unknown stages are errors."""
    stage = F.element_at(F.array(*map(F.lit, ("ПД", "rd", "??"))), F.col("p_size") % 3 + 1)
    entry = F.struct(F.col("p_brand").alias("discipline"), stage.alias("doc_stage"), F.col("p_name").alias("title"))
    path = place(spark, "json")
    Tables(spark, sf_dir).part.groupBy("p_brand").agg(F.to_json(F.struct(F.array().cast("array<string>").alias("files"), F.collect_list(entry).alias("expected"))).alias("value")).repartition("p_brand").write.partitionBy("p_brand").text(path)
    return I.read_expected(spark, path)[0].select("discipline", "doc_stage", "title")


@query("src11_rejected_import", "SELECT p_brand code, 'invalid' change FROM part WHERE p_size < 9 GROUP BY 1 HAVING count(*) > 1")
def src11_rejected(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A matrix that repeats codes is refused as a whole; the report names them."""
    rows = Tables(spark, sf_dir).part.select(F.col("p_brand").alias("code"), F.col("p_name").alias("title"), "p_size")
    return I.upserted(rows.dropDuplicates(["code"]), rows.filter("p_size < 9"))[1]


@query("src10_registry_names", "SELECT url, regexp_matches(url, '(?i)(?:^|/)(?:document_)?(?:registry|manifest|реестр|перечень)[^/]*\\.(?:csv|tsv|json|jsonl|xlsx)$') registry FROM (SELECT unnest([url || '/registry_' || page_id || '.csv', url]) url FROM pages)")
def src10(spark: SparkSession, sf_dir: str) -> DataFrame:
    urls = Tables(spark, sf_dir).pages.select(F.explode(F.array(F.concat("url", F.lit("/registry_"), F.col("page_id").cast("string"), F.lit(".csv")), F.col("url"))).alias("url"))
    return urls.select("url", I.looks_like_registry(F.col("url")).alias("registry"))


MATRIX_SQL = """cur AS (SELECT p_partkey::VARCHAR code, p_name title, p_size::DOUBLE min_value FROM part WHERE p_partkey % 5 <> 0),
  inc AS (SELECT p_partkey::VARCHAR code, CASE WHEN p_partkey % 7 = 0 THEN p_name || ' x' ELSE p_name END title, p_size::DOUBLE min_value FROM part WHERE p_partkey % 3 <> 0)"""


def matrices(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    part = Tables(spark, sf_dir).part
    current = part.filter("p_partkey % 5 <> 0").select(F.col("p_partkey").cast("string").alias("code"), F.col("p_name").alias("title"), F.col("p_size").cast("double").alias("min_value"))
    new = part.filter("p_partkey % 3 <> 0").select(F.col("p_partkey").alias("code"), F.when(F.col("p_partkey") % 7 == 0, F.concat("p_name", F.lit(" x"))).otherwise(F.col("p_name")).alias("title"), F.col("p_size").alias("min_value"))
    path = place(spark, "csv")
    new.write.csv(path, header=True)
    return current, I.read_matrix(spark, path)


@query("src11_matrix_import", f"""WITH {MATRIX_SQL} SELECT coalesce(cur.code, inc.code) code, CASE WHEN cur.code IS NULL THEN 'added' WHEN inc.code IS NULL THEN 'absent' WHEN cur.title = inc.title THEN 'unchanged' ELSE 'updated' END change
  FROM cur FULL JOIN inc ON cur.code = inc.code""")
def src11(spark: SparkSession, sf_dir: str) -> DataFrame:
    current, new = matrices(spark, sf_dir)
    return I.upserted(current, new)[1]


@query("src12_merged_matrix", f"WITH {MATRIX_SQL} SELECT coalesce(inc.code, cur.code) code, coalesce(inc.title, cur.title) title, coalesce(inc.min_value, cur.min_value) min_value FROM cur FULL JOIN inc ON cur.code = inc.code")
def src12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.upserted(*matrices(spark, sf_dir))[0]


@query("src18_cache_merge", "SELECT sha256(doc_id::VARCHAR) sha256 FROM documents WHERE doc_id % 4 = 1")
def src18(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An archive that has each entry twice is merged into a cache that has half of them, two times over."""
    d = Tables(spark, sf_dir).documents.select("doc_id", F.sha2(F.col("doc_id").cast("string"), 256).alias("sha256"), F.lit("1").alias("version"))
    kept, archive = d.filter("doc_id % 4 = 3").drop("doc_id"), d.filter("doc_id % 2 = 1").drop("doc_id")
    archive = archive.unionByName(archive)
    first = scratch.table(I.merged_cache(kept, archive), "cache")
    again = I.merged_cache(kept.unionByName(first), archive)
    return first.unionByName(again).select("sha256")


@query("src19_corpus_summary", "SELECT 'json' extension, count(DISTINCT source) files, (sum(length(source)) + 9 * count(*))::BIGINT bytes FROM (SELECT DISTINCT source FROM documents WHERE source IS NOT NULL) UNION ALL SELECT 'txt', count(DISTINCT lang), (sum(length(lang)) + count(*))::BIGINT FROM (SELECT DISTINCT lang FROM documents WHERE lang IS NOT NULL)")
def src19(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A folder with a file for each source and each language of the documents, by ending."""
    documents, path = Tables(spark, sf_dir).documents, place(spark, "folder")
    sources, langs = (documents.select(c).filter(f"{c} IS NOT NULL").distinct() for c in ("source", "lang"))
    sources.withColumn("n", F.col("source")).write.partitionBy("source").json(f"{path}/sources")
    langs.select(F.col("lang").alias("value"), F.col("lang").alias("of")).write.partitionBy("of").text(f"{path}/langs")
    return I.corpus_summary(I.listed_files(spark, path, "part-*")).select("extension", "files", "bytes")


@query("src20_labels", "SELECT doc_id::VARCHAR id, quality::VARCHAR AS label, CASE WHEN doc_id % 2 = 0 THEN 'TEST' ELSE 'TRAIN' END split FROM labels WHERE doc_id % 9 <> 0")
def src20(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels, path = Tables(spark, sf_dir).labels, place(spark, "jsonl")
    line = F.to_json(F.struct(F.col("doc_id").cast("string").alias("id"), F.col("quality").cast("string").alias("label"), F.lit("TRAIN").alias("split")))
    labels.select(F.when(F.col("doc_id") % 9 == 0, F.substring(line, 1, 9)).otherwise(line).alias("value")).write.text(path)
    return I.read_labels(spark, path, labels.filter("doc_id % 2 = 0").select(F.col("doc_id").alias("id"), F.lit("TEST").alias("split")))[0]


@query("src21_archives", "SELECT 'a' || (doc_id % 7) || '.zip' path, doc_id || '.txt' AS name, octet_length(encode(coalesce(text, ''))) size, sha256(coalesce(text, '')) digest FROM documents WHERE doc_id % 7 <> 3 UNION ALL SELECT 'a3.zip', NULL, NULL, NULL")
def src21(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents in seven archives, one of which is damaged.

    An archive comes in volumes of a thousand document numbers at most, so that none has more entries than are allowed and no
    task packs an archive whole; of the damaged one there is only the beginning of its first volume.
    """
    import pandas as pd

    def packed(rows: pd.DataFrame) -> pd.DataFrame:
        import io
        import zipfile

        out = io.BytesIO()
        with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
            for k, text in zip(rows["doc_id"], rows["text"], strict=True):
                z.writestr(f"{k}.txt", text or "")
        path = f"a{rows['part'].iloc[0]}.zip"
        return pd.DataFrame({"path": [path], "content": [out.getvalue()[:40] if path == "a3.zip" else out.getvalue()]})

    docs = Tables(spark, sf_dir).documents.select("doc_id", "text", (F.col("doc_id") % 7).alias("part"), F.floor(F.col("doc_id") / 7000).alias("volume"))
    there = docs.groupBy("part").agg(F.min("volume").alias("first"))
    docs = docs.join(F.broadcast(there), "part").filter("part <> 3 OR volume = first")
    archives = docs.groupBy("part", "volume").applyInPandas(packed, "path string, content binary")
    return I.unzipped(archives).select("path", "name", "size", F.sha2("content", 256).alias("digest"))


@query("src13_parsed_blocks", "SELECT conv_id::VARCHAR file_id, turn::INT + 1 page, text FROM conversations UNION ALL SELECT conv_id::VARCHAR, turn::INT + 1, 'cell ' || turn FROM conversations")
def src13(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parsed documents as JSON: a page for each turn, with a block and a table of one cell."""
    c = Tables(spark, sf_dir).conversations
    cell = F.struct(F.lit(0).alias("row"), F.lit(0).alias("column"), F.concat(F.lit("cell "), F.col("turn").cast("string")).alias("text"))
    page = F.struct((F.col("turn") + 1).alias("number"), F.array(F.struct("text")).alias("blocks"), F.array(F.struct(F.array(cell).alias("cells"))).alias("tables"))
    docs = c.groupBy("conv_id").agg(F.collect_list(page).alias("pages")).select(F.to_json(F.struct(F.col("conv_id").cast("string").alias("file_id"), "pages")).alias("body"))
    blocks, cells = I.parsed_blocks(docs)
    return blocks.select("file_id", "page", "text").unionByName(cells.select("file_id", "page", "text"))


@query("snk06_audit_csv", "SELECT event_id, event_type, props FROM events")
def snk06(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The audit as CSV, every value quoted, read back."""
    path = place(spark, "csv")
    Tables(spark, sf_dir).events.select("event_id", "event_type", "props").write.csv(path, header=True, quoteAll=True, escape='"')
    return spark.read.csv(path, header=True, escape='"', multiLine=True, schema="event_id long, event_type string, props string")


@query("snk08_metric_log", "SELECT event_type run, unnest(['count','mean','max']) AS name, unnest([count(*)::DOUBLE, round(avg(value), 6), max(value)]) AS value FROM events GROUP BY 1")
def snk08(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metrics of runs as a long table (run, name, value), written by run and read back."""
    by = Tables(spark, sf_dir).events.groupBy(F.col("event_type").alias("run")).agg(F.count("*").cast("double").alias("count"), F.round(F.avg("value"), 6).alias("mean"), F.max("value").alias("max"))
    path = place(spark, "parquet")
    by.unpivot("run", ["count", "mean", "max"], "name", "value").write.partitionBy("run").parquet(path)
    return spark.read.parquet(path).select("run", "name", "value")


# Line where the table begins: a title, then a text of as many lines as the order's number says, on a second page if the first is too short.
WORD_SQL = """o AS (SELECT o_orderkey k, o_orderkey % 50 + 1 p FROM orders), s AS (SELECT k, CASE WHEN p > 49 THEN p ELSE p + 1 END s, CASE WHEN p > 49 THEN 2 ELSE 1 END page FROM o),
  r AS (SELECT l_orderkey k, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_quantity, l_partkey) r, l_linenumber n, l_quantity::INT q, l_partkey part FROM lineitem),
  c AS (SELECT k, 0 r, 0 col, 1 span, 'line' t FROM s UNION ALL SELECT k, 0, 1, 2, 'amount' FROM s UNION ALL SELECT k, r, 0, 1, n::VARCHAR FROM r UNION ALL SELECT k, r, 1, 1, q::VARCHAR FROM r UNION ALL SELECT k, r, 2, 1, 'part ' || part FROM r),
  w AS (SELECT *, r >= greatest(50 - s, 1) AS beyond FROM c JOIN s USING (k))"""


@query("src14_word_pages", f"""WITH {WORD_SQL} SELECT k AS doc, page + beyond::INT page, CASE WHEN beyond THEN r - greatest(50 - s, 1) ELSE s + r END line, 'cell' kind, 0 AS "table", CASE WHEN beyond THEN r - greatest(50 - s, 1) ELSE r END AS "row", col AS "column", span, t AS text FROM w
  UNION ALL SELECT k, 1, 0, 'title_block', NULL, NULL, NULL, NULL, 'order ' || k FROM s UNION ALL SELECT k, page, CASE WHEN page = 2 THEN 0 ELSE 1 END, 'text', NULL, NULL, NULL, NULL, repeat('x', ((k % 50) * 100 + 1)::INT) FROM s""")
def src14(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each order as a word-processor file: a title in the header, a text of some lines, and its lines as a table with a wide head and nested tables."""
    from stagewise.sources.documents import word_pages

    def packed(head: str, body: str) -> bytes:
        import io
        import zipfile

        out = io.BytesIO()
        with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
            z.writestr("word/header1.xml", f'<w:hdr xmlns:w="w">{head}</w:hdr>')
            z.writestr("word/header2.xml", f'<w:hdr xmlns:w="w">{head}</w:hdr>')
            z.writestr("word/document.xml", f'<w:document xmlns:w="w"><w:body>{body}</w:body></w:document>')
        return out.getvalue()

    t = Tables(spark, sf_dir)
    shown = lambda c: F.concat(F.lit("<w:p><w:r><w:t>"), c.cast("string"), F.lit("</w:t></w:r></w:p>"))
    cell = lambda c, more="": F.concat(F.lit(f"<w:tc>{more}"), c, F.lit("</w:tc>"))
    inner = F.concat(F.lit("<w:tbl><w:tr>"), cell(shown(F.lit("part"))), cell(shown(F.col("l_partkey"))), F.lit("</w:tr></w:tbl>"))
    row = F.concat(F.lit("<w:tr>"), cell(shown(F.col("l_linenumber"))), cell(shown(F.col("l_quantity").cast("int"))), cell(inner), F.lit("</w:tr>"))
    rows = t.lineitem.groupBy("l_orderkey").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_quantity", "l_partkey", row.alias("r")))), lambda x: x["r"]), "").alias("rows"))
    top = F.concat(F.lit("<w:tr>"), cell(shown(F.lit("line"))), cell(shown(F.lit("amount")), '<w:tcPr><w:gridSpan w:val="2"/></w:tcPr>'), F.lit("</w:tr>"))
    k = F.col("o_orderkey")
    body = F.concat(shown(F.expr("repeat('x', CAST(o_orderkey % 50 * 100 + 1 AS INT))")), F.lit("<w:tbl>"), top, F.coalesce("rows", F.lit("")), F.lit("</w:tbl>"))
    texts = t.orders.join(rows, F.col("l_orderkey") == k, "left").select(k.cast("string").alias("path"), shown(F.concat(F.lit("order "), k.cast("string"))).alias("head"), body.alias("body"))
    files = texts.select("path", F.udf(packed, "binary", useArrow=True)("head", "body").alias("content"))
    return word_pages(files).filter("kind <> 'row'").select(F.col("path").cast("long").alias("doc"), "page", "line", "kind", "table", "row", "column", "span", "text")
