"""Every stage of the pipeline on odd tables: what its docstring states."""

import pytest

import corpus_pipeline

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
LONG = "lorem ipsum dolor sit amet consectetur adipiscing elit sed do eiusmod tempor incididunt ut labore et dolore magna aliqua"
ROWS = [
    (1, LONG, "en", "s", 1), (1, LONG, "en", "s", 1), (2, None, None, None, None), (3, "", "en", "s", 0), (4, LONG, "en", "s", 1), (5, "api_key = abcdefgh12345678 and the rest of the words", "en", "s", 1), (None, "a text without a key of its own here", "en", "s", 1),
    (6, "of benchmark items one two three four five six seven eight nine ten eleven", "en", "s", 1),
]


@pytest.fixture(scope="module")
def sf(spark, tmp_path_factory):
    """No labels; a benchmark with one item, a null and an empty one."""
    at = tmp_path_factory.mktemp("sf")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    spark.createDataFrame([(1, "one two three four five six seven eight nine ten eleven"), (2, None), (None, "")], "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    return str(at)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


WANT = {
    "quality classifier": [None, 1, 1, 2, 3, 4, 5, 6],
    "near-dedup": [None, 1, 2, 3, 5, 6],
    "decontamination": [None, 1, 1, 2, 3, 4, 5],
    "secret scans": [None, 1, 1, 2, 3, 4, 5, 6],
}


@pytest.mark.parametrize("at", range(5))
def test_odd_rows_and_empty_tables(spark, docs, sf, at):
    name, stage = corpus_pipeline.STAGES[at]
    got = stage(spark, docs, sf)
    if at == 4:
        assert sorted((r.doc_id for r in got.collect()), key=str) == sorted((r[0] for r in ROWS), key=str)
    else:
        assert got.columns == docs.columns
        rows = got.collect()
        assert sorted((r.doc_id for r in rows), key=str) == sorted(WANT[name], key=str)
        texts = {r.doc_id: r.text for r in rows}
        assert texts[2] is None and texts[3] == ""
        if name == "secret scans":
            assert "abcdefgh" not in texts[5] and texts[5].endswith("the rest of the words")
    assert stage(spark, docs.limit(0), sf).collect() == []
