"""Alignment of two tokenizers against brute force over whole texts."""

import hashlib
import random
from collections import Counter, defaultdict
from functools import lru_cache

import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from stagewise.llm.alignment import INFO, LISTS, Aligned, aligned, alignments, tokenizers, units_of


@given(st.text(" \n\tab.'é  \x1c漢<|endoftext|>", max_size=40))
@settings(max_examples=400, deadline=None)
def test_units_are_cut_where_both_tokenizers_cut(text):
    t = tokenizers(None, None)
    assert t.cuts_at_spaces
    parts = [p.decode() for p in units_of(text.encode())]
    if not text:
        assert parts == []
        return
    assert "".join(" " + p for p in parts) == " " + text
    whole, split = t.encode(text), [t.encode(p) for p in parts]
    assert whole is not None and [sum((s[i] for s in split), []) for i in range(2)] == list(whole)
    unit, tokens, n = t.flat(parts)
    for i, (a, b) in enumerate(split):
        assert tokens[unit == i].tolist() == [x * 2 for x in a] + [x * 2 + 1 for x in b]
    assert n.tolist() == [(t.b_len if x % 2 else t.a_len)[x // 2] for x in tokens]
    assert whole[0] == a_tokenizer().encode(" " + text, add_special_tokens=False).ids


@lru_cache(1)
def a_tokenizer():
    """A as its own library reads it."""
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    return t


def upto(side, cuts):
    """The ids of a side that end at each cut and since the one before."""
    out, at = [], 0
    for cut in cuts:
        first = at
        while side[at][1] < cut:
            at += 1
        at += 1
        out.append(",".join(str(i) for _, _, i in side[first:at]))
    return out


def plain(rows):
    """By the definition, text by text."""
    t = tokenizers(None, None)
    links, out, docs = [], [], Counter()
    for _, text in rows:
        found = t.encode(text) if text else None
        pairs, groups, n = [], [], (0, 0)
        if found:
            spans = []
            for ids, lens in zip(found, (t.a_len, t.b_len), strict=True):
                at, side = 0, []
                for i, k in zip(ids, lens[ids].tolist(), strict=True):
                    side.append((at, at + k, i))
                    at += k
                spans.append(side)
            a, b = spans
            n = len(a), len(b)
            cuts = sorted({x[1] for x in a} & {x[1] for x in b})
            inside = [upto(side, cuts) for side in (a, b)]
            groups = ["|".join(g) for g in zip(*inside, strict=True)]
            j = 0
            for s, e, i in a:
                while j and b[j][0] >= s:
                    j -= 1
                while b[j][1] <= s:
                    j += 1
                while j < len(b) and b[j][0] < e:
                    pairs.append((i, b[j][2]))
                    j += 1
                j = min(j, len(b) - 1)
        links.append(pairs)
        docs.update(set(pairs))
        out.append((n, groups))
    best = defaultdict(int)
    for (a, _), c in docs.items():
        best[a] = max(best[a], c)
    return sorted((
        str(key), na, nb, len(groups), len(pairs), sum(docs[p] == best[p[0]] for p in pairs), sum(docs[p] for p in pairs),
        hashlib.sha256(";".join(groups).encode()).hexdigest() if groups else "",
    ) for (key, _), pairs, ((na, nb), groups) in zip(rows, links, out, strict=True))


ODD = [
    (1, None), (2, ""), (3, " "), (20, "a▁▁b c"), (4, "  two  spaces \n and\n\nlines \t"), (5, "a▁b is changed by B"), (6, "<|endoftext|> <s> </s> <0x41> it's"), (7, "Ünïcödé — 漢字 ́ ß 😀 \x00"),
    (8, "the same words the same words"), (8, "the same words the same words"), (None, "no key at all"), (9, "xyx" * 3000), (10, "the of and " * 8000), (11, "ends with a space "), (12, "　wide  spaces here"),
]


def same(df, rows, **options):
    got = alignments(df, **options)
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert sorted((str(r[0]), *r[1:]) for r in got.collect()) == plain(rows)


@pytest.mark.parametrize("frequent", [1 << 18, 6, 0])
def test_same_as_brute_force(spark, frequent):
    df = spark.createDataFrame(ODD, "doc_id long, text string").withColumn("u", F.lit("clash"))
    same(df.repartition(2), ODD, frequent=frequent, most_broadcast=min(frequent, 5))


def test_given_documents(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    same(df, [tuple(r) for r in df.collect()], frequent=500)


def test_empty_table_and_key_names(spark):
    df = spark.createDataFrame([(1, "a b")], "row int, text string")
    assert alignments(df.limit(0), key="row").collect() == []
    assert [r.row for r in alignments(df, key="row").collect()] == [1]
    with pytest.raises(ValueError):
        alignments(df.withColumnRenamed("row", "n_a"), key="n_a")


def test_units_side_by_side_in_a_row_stay_apart(spark):
    """Also if what was collected of a row comes in any order, and for rows without units."""
    t = tokenizers(None, None)
    rows = [["漢字", "ß", "wordsandmore", "x" * 70], [], ["ß"]]
    lists, bad = t.columns(rows)
    assert not bad.any()
    table = pa.table([pa.array(range(len(rows))), *lists], ["row", *LISTS])
    held = {r.row: list(zip(*(r[c] for c in INFO), strict=True)) for r in aligned(spark.createDataFrame(table), "row").collect()}
    assert sorted(held) == [0, 2]
    for seed in range(3):
        mixed = [random.Random(seed).sample(held[i], len(held[i])) if i in held else None for i in range(len(rows))]
        own = Aligned(*(pa.array([m and [x[i] for x in m] for m in mixed], pa.list_(pa.int64())) for i in range(2)))
        for i, unit in enumerate(u for r in rows for u in r):
            a, b = t.encode(unit)
            shown = own.groups[i].split(";")
            assert [",".join(g.split("|")[j] for g in shown) for j in range(2)] == [",".join(map(str, ids)) for ids in (a, b)]
            assert own.counts[i].tolist() == [len(a), len(b), len(shown)]
            assert own.sizes[i] == len(a) + len(b) - len(shown)
