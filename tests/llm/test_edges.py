"""Nulls, empty and long texts, repeated rows, empty tables and clashing columns, for every operator."""

import hashlib
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from stagewise.llm import contamination, langid, licenses, lmscore, neardup, packing, quality, secrets, sharding, tiff

ROWS = [
    (1, "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda"), (2, None), (3, ""), (4, " \n\t "), (5, "Ünïcödé — текст 漢字 ́ ß"), (6, "x" * 40_000), (7, "a b " * 6000),
    (1, "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda"), (None, "no key at all"), (None, None),
]
#: Columns that an operator might use itself.
CLASH = ["key", "row", "n", "words", "label", "c", "h", "_key", "size", "node", "component", "part", "window", "x"]


@pytest.fixture(scope="module")
def docs(spark):
    df = spark.createDataFrame(ROWS, "doc_id long, text string")
    return df.select("*", *(F.lit("?").alias(c) for c in CLASH), F.lit("en").alias("lang"), F.lit("s").alias("source"))


def operators(spark):
    labels = spark.createDataFrame([(1, 1), (3, 0), (7, 0), (None, 1), (6, None)], "doc_id long, quality int")
    benchmark = spark.createDataFrame([(1, ROWS[0][1]), (2, None), (None, "b a b"), (3, "")], "item_id long, text string")
    return {
        "packing": packing.pack, "secrets": secrets.secret_spans, "quality": lambda d: quality.quality_scores(d, labels), "sharding": sharding.shard_rows, "tiff": tiff.stored_texts,
        "langid": langid.languages, "contamination": lambda d: contamination.contamination(d, benchmark), "neardup": neardup.near_duplicates, "licenses": licenses.license_labels,
        "lmscore": lambda d: lmscore.language_scores(d, words=30),
    }


NAMES = ["packing", "secrets", "quality", "sharding", "tiff", "langid", "contamination", "neardup", "licenses", "lmscore"]


@pytest.mark.parametrize("name", NAMES)
def test_odd_rows(spark, docs, name):
    got = operators(spark)[name](docs).collect()
    if name != "packing":
        assert len(got) == len(ROWS)
    assert {r.doc_id for r in got} == {r[0] for r in ROWS}


@pytest.mark.parametrize("name", NAMES)
def test_empty_table(spark, docs, name):
    assert operators(spark)[name](docs.limit(0)).collect() == []


@pytest.mark.parametrize("name", ["packing", "neardup", "lmscore", "langid", "licenses", "secrets"])
@pytest.mark.parametrize("key", ["node", "part", "row", "words", "kept"])
def test_any_key_name(spark, name, key):
    call = {"packing": packing.pack, "neardup": neardup.near_duplicates, "lmscore": lambda d, **k: lmscore.language_scores(d, words=30, **k), "langid": langid.languages, "licenses": licenses.license_labels, "secrets": secrets.secret_spans}[name]
    df = spark.createDataFrame([(1, "a b c d e f", "en"), (2, "a b c d e f", "en")], f"{key} int, text string, lang string")
    if (name, key) == ("neardup", "kept"):
        with pytest.raises(ValueError):
            call(df, key=key)
    else:
        assert {r[key] for r in call(df, key=key).collect()} == {1, 2}


@pytest.mark.parametrize(("call", "key"), [(secrets.secret_spans, "spans"), (sharding.shard_rows, "size"), (tiff.stored_texts, "feature")])
def test_a_key_named_like_a_result_is_refused(spark, call, key):
    with pytest.raises(ValueError):
        call(spark.createDataFrame([(1, "a")], f"{key} int, text string"), key=key)


def test_first_of_each_has_a_defined_choice(spark):
    df = spark.createDataFrame([(1, "b", 1), (1, "a", 2), (1, "a", 1), (2, None, 5), (2, None, 4)], "doc_id int, text string, x int")
    assert sorted(map(tuple, neardup.first_of_each(df).collect())) == [(1, "a", 1), (2, None, 4)]


def test_defined_results(spark, docs):
    by = lambda df: {r.doc_id: r for r in df.collect()}
    ops = operators(spark)
    lang = by(ops["langid"](docs))
    assert lang[2].lang_pred == lang[3].lang_pred == lang[4].lang_pred == "und" and lang[5].lang_pred == "en"
    near = by(ops["neardup"](docs))
    assert near[3].n_shingles == 0 and near[3].component_id == 3 and near[3].kept and near[1].kept
    dirty = by(ops["contamination"](docs))
    assert dirty[1].contaminated and dirty[1].n_hit == 11 and not dirty[2].contaminated and dirty[7].n_hit > 0
    media = by(ops["tiff"](docs))
    assert media[2].payload_bytes == media[3].payload_bytes == 64 and media[6].n_bytes == 40_000
    scores = by(ops["lmscore"](docs))
    assert scores[2].n_tokens == scores[3].n_tokens == 1 and scores[7].n_tokens == 12_001


def test_first_of_each_keeps_columns_and_one_row(spark, docs):
    got = neardup.first_of_each(docs)
    assert got.columns == docs.columns
    assert sorted((r.doc_id for r in got.collect()), key=str) == sorted([1, 2, 3, 4, 5, 6, 7, None], key=str)


def test_sql_twins(spark, sf_dir):
    import duckdb

    from stagewise.llm import queries

    duck = duckdb.connect()
    for t in ("documents", "benchmark", "labels"):
        duck.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    for name, sql in queries.ORACLE_SQL.items():
        want = duck.sql(sql).df()
        got = queries.QUERIES[name](spark, sf_dir).select(*want.columns)
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.itertuples(index=False))), name


def test_sizes_sums_and_slots_of_shards(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    docs = docs.unionByName(spark.createDataFrame([(10**6, None), (10**6 + 1, "é\0")], "doc_id long, text string"))
    raw = {r.doc_id: (r.text or "").encode() for r in docs.collect()}
    got = sharding.shard_rows(docs).collect()
    assert {r.doc_id: (r.size, r.text_crc32) for r in got} == {k: (len(b) + 8, zlib.crc32(b)) for k, b in raw.items()}
    more = {r.doc_id: r.shard for r in sharding.shard_rows(docs, weights=[1.0] * 25).collect()}
    assert all(r.grown_shard == more[r.doc_id] and more[r.doc_id] in (r.shard, 24) for r in got)
    for s in range(24):
        own = sorted(r.slot for r in got if r.shard == s)
        assert own == list(range(len(own)))


def test_stored_texts_against_a_plain_version(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    docs = docs.unionByName(spark.createDataFrame([(10**6, None), (10**6 + 1, "x" * 64), (10**6 + 2, "é" * 600_000)], "doc_id long, text string"))
    raw = {r.doc_id: (r.text or "").encode() for r in docs.collect()}
    for r in tiff.stored_texts(docs).collect():
        payload = raw[r.doc_id] + b"\0" * (-len(raw[r.doc_id]) % 64 if raw[r.doc_id] else 64)
        media = tiff.write_pages([np.frombuffer(payload, np.uint8).reshape(-1, 64)[i : i + 16384] for i in range(0, len(payload) // 64, 16384)])
        assert (r.n_bytes, r.payload_bytes, r.tail_crc32) == (len(raw[r.doc_id]), len(payload), zlib.crc32(payload[-64:]))
        assert r.payload_sha256 == hashlib.sha256(payload).hexdigest() and (r.media_bytes, r.media_sha256) == (len(media), hashlib.sha256(media).hexdigest())
        assert f"mean={np.frombuffer(payload, np.uint8).mean():.4f}" in r.feature


def test_model_scores_token_by_token(spark, sf_dir, monkeypatch):
    taken = {}
    take = lmscore.Scorer.take
    monkeypatch.setattr(lmscore.Scorer, "take", lambda self, model, norm: (taken.update(scorer=self, model=model), take(self, model, norm))[1])
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    got = {r.doc_id: r for r in lmscore.language_scores(docs, words=40, frequent=300).collect()}
    texts = {r.doc_id: [*(r.text or "").encode().lower().split(), b" end"] for r in docs.collect()}
    learned = Counter(w for k, t in texts.items() if zlib.crc32(str(k).encode()) % 7 != 2 for w in t)
    s, m = taken["scorer"], taken["model"]
    number = lambda w: int(s.classes(np.array([xxhash.xxh3_64_intdigest(w)], np.uint64))[0][0])
    numbers = {w: number(w) for t in texts.values() for w in t}
    rare = [c for w, c in learned.items() if numbers[w] == s.other]
    for k in sorted(texts)[:40]:
        near = far = s.end
        total = 0.0
        for w in texts[k]:
            c = m.classes(np.array([far, near]), s.end)
            scores = (m.contexts[c[1]] @ m.near + m.contexts[c[0]] @ m.far) @ m.vectors.T + m.bias
            total += (scores[numbers[w]] - np.logaddexp.reduce(scores.astype(np.float64))) / np.log(10)
            if numbers[w] == s.other:
                total += np.log10((learned[w] + 1) / (sum(rare) + len(rare) + 1))
            far, near = near, numbers[w]
        assert abs(total - got[k].score) < 1e-3 * len(texts[k]), k


def test_many_copies_of_one_text(spark):
    r = np.random.default_rng(9)
    base = [f"w{i}" for i in r.integers(0, 400, 120)]
    near = [" ".join([*base[:i], "other", *base[i + 1 :]]) for i in range(0, 120, 2)]
    texts = [" ".join(base)] * 300 + near + ["alone in the world here"] * 50 + [None] * 40
    got = neardup.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")).collect()
    home = {x.doc_id: x.component_id for x in got}
    assert {home[i] for i in range(360)} == {0} and {home[i] for i in range(360, 410)} == {360} and all(home[i] == i for i in range(410, 450))
    assert sum(x.kept for x in got) == 42
