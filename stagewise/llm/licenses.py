"""Licence scans with a positional rare-token index, in DataFrame operations alone."""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stagewise import scratch

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


@dataclass(frozen=True)
class Template:
    label: str
    text: str
    phrase: str  # mandatory: without it, however well the rest aligns, there is no label


# The phrases that name a licence on their own.
PHRASES = {
    "mit": "under the mit license",
    "apache-2": "apache license version 2",
    "cc-by-nc": "cc by nc",
}

# Notices of public licences, lower case, without punctuation; the last part is the mandatory phrase, a part of the text.
TEMPLATES = (
    Template("mit", "released under the mit license", "mit license"),
    Template("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", "permission is hereby granted free of charge"),
    Template("mit", "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement", "the software is provided as is without warranty of any kind"),
    Template("apache-2", "licensed under the apache license version 2 0", "apache license version 2"),
    Template("apache-2", "you may obtain a copy of the license at http www apache org licenses license 2 0", "apache org licenses license 2 0"),
    Template("apache-2", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied", "software distributed under the license is distributed on an as is basis"),
    Template("cc-by-nc", "licensed under cc by nc 4 0", "cc by nc"),
    Template("cc-by-nc", "creative commons attribution noncommercial 4 0 international license", "attribution noncommercial 4 0"),
    Template("cc-by-nc-sa", "creative commons attribution noncommercial sharealike 4 0 international license", "attribution noncommercial sharealike"),
    Template("cc-by-nd", "creative commons attribution noderivatives 4 0 international license", "attribution noderivatives"),
    Template("cc-by-sa", "creative commons attribution sharealike 4 0 international license", "attribution sharealike"),
    Template("cc-by", "creative commons attribution 4 0 international license", "commons attribution 4 0 international"),
    Template("cc0", "cc0 1 0 universal public domain dedication", "public domain dedication"),
    Template("gpl-3", "licensed under the gnu general public license version 3", "gnu general public license version 3"),
    Template("gpl-3", "under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version", "either version 3 of the license"),
    Template("gpl-2", "licensed under the gnu general public license version 2", "gnu general public license version 2"),
    Template("gpl-2", "under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version", "either version 2 of the license"),
    Template("lgpl", "licensed under the gnu lesser general public license", "gnu lesser general public license"),
    Template("agpl-3", "licensed under the gnu affero general public license version 3", "gnu affero general public license"),
    Template("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", "redistribution and use in source and binary forms"),
    Template("bsd", "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission", "used to endorse or promote products derived from this software"),
    Template("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0", "mozilla public license v 2 0"),
    Template("unlicense", "this is free and unencumbered software released into the public domain", "free and unencumbered software"),
    Template("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "for any purpose with or without fee"),
    Template("zlib", "altered source versions must be plainly marked as such and must not be misrepresented as being the original software", "altered source versions must be plainly marked as such"),
    Template("boost", "distributed under the boost software license version 1 0", "boost software license version 1 0"),
    Template("epl-2", "this program and the accompanying materials are made available under the terms of the eclipse public license 2 0", "eclipse public license 2 0"),
    Template("ofl", "this font software is licensed under the sil open font license version 1 1", "sil open font license"),
    Template("artistic-2", "licensed under the artistic license 2 0", "artistic license 2 0"),
    Template("psf-2", "licensed under the python software foundation license version 2", "python software foundation license"),
    Template("cddl", "subject to the terms of the common development and distribution license", "common development and distribution license"),
    Template("eupl", "licensed under the european union public licence v 1 2", "european union public licence"),
)

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: The letters beyond ASCII that lower-casing would turn into ASCII ones.
TO_ASCII = ("\u212a", "\u0130")
NO_PLACES = "CAST(array() AS array<struct<word:string,at:int>>)"


def vocabulary(templates: tuple[Template, ...], phrases: dict[str, str]) -> list[str]:
    """The words of the templates and phrases."""
    return sorted({w for t in templates for w in t.text.split()} | {w for p in phrases.values() for w in p.split()})


def phrase_at(template: Template) -> int:
    """Where in its template the mandatory phrase starts."""
    words, phrase = template.text.split(), template.phrase.split()
    return next(i for i in range(len(words) - len(phrase) + 1) if words[i : i + len(phrase)] == phrase)


def phrase_places(words: Column, places: Column, phrase: str) -> Column:
    """The places among ``places`` where the phrase's words stand one after another."""
    first, *rest = phrase.split()
    fits = lambda x: reduce(lambda a, b: a & b, (F.get(words, x["at"] + k + 1) == w for k, w in enumerate(rest)), x["word"] == first)
    return F.transform(F.filter(places, fits), lambda x: x["at"])


def scan_words(df: DataFrame, key: str, text: str, templates: tuple[Template, ...], phrases: dict[str, str]) -> DataFrame:
    """Per row: number of words, the vocabulary's words with their places, and the places of each phrase."""
    known = vocabulary(templates, phrases)
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    special = reduce(lambda a, b: a | b, (F.contains(body, F.lit(c)) for c in TO_ASCII))
    words = F.regexp_extract_all(F.when(special, F.translate(body, UPPER, UPPER.lower())).otherwise(F.lower(body)), F.lit(WORD), F.lit(0))
    rows = df.select(F.monotonically_increasing_id().alias("row"), F.col(key).alias("key"), words.alias("words"))
    at = F.filter(F.sequence(F.lit(0), F.size("words") - 1), lambda i: F.get("words", i).isin(known))
    places = F.transform(at, lambda i: F.struct(F.get("words", i).alias("word"), i.alias("at")))
    rows = rows.withColumn("places", F.when(F.size("words") > 0, places).otherwise(F.expr(NO_PLACES)))
    return rows.select(
        "row", "key", F.size("words").cast("long").alias("n_words"), "places",
        *(phrase_places(F.col("words"), F.col("places"), p).alias(f"base{k}") for k, p in enumerate(phrases.values())),
    )


def license_labels(
    df: DataFrame, key: str = "doc_id", text: str = "text", templates: tuple[Template, ...] = TEMPLATES,
    phrases: dict[str, str] = PHRASES, rarest: int = 8, lightest: float = 0.5, least: float = 0.5, most_broadcast: int = 1_000_000,
) -> DataFrame:
    """One row per input row: key, n_words, n_base, first_word, last_word, base_labels, labels, score.

    A word's weight is its inverse document frequency over the whole table. The index has, of each
    template, the positions of its ``rarest`` heaviest words, without those of less than ``lightest`` of
    the heaviest one's weight; all of a document's words in the index are looked up, and postings that
    agree on the template's place in the document are added up. A template whose share of its indexed
    weight is at least ``least`` at one place is a candidate; it gives its label if its mandatory phrase
    stands, word by word, where that place puts it. ``score`` is the greatest such share, 1 with a base
    phrase, else 0.

    Null and empty texts have no words and no labels; repeated rows get a result each, an empty table
    none; labels are a set, so ties don't matter. Only the vocabulary's frequencies, at most one row
    for each of its words, reach the driver. Broadcast are the index and the candidates, a few numbers each,
    if they are at most ``most_broadcast``, which is counted; else the rows' places are shuffled to them.
    All rows' findings are a written table, so texts are read once.
    """
    scratch.not_among(key, ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"])
    spark = df.sparkSession
    found = scratch.table(scan_words(df, key, text, templates, phrases), "licence-words")
    total = max(found.count(), 1)
    present = F.array_distinct(F.transform("places", lambda x: x["word"]))
    seen = {r["word"]: r["n"] for r in found.select(F.explode(present).alias("word")).groupBy("word").agg(F.count("*").alias("n")).collect()}
    weight = {w: math.log(1 + total / seen.get(w, 1)) for w in vocabulary(templates, phrases)}
    postings, full, phrase_words = [], [], []
    for i, t in enumerate(templates):
        words = t.text.split()
        own = sorted(range(len(words)), key=lambda p: (-weight[words[p]], p))[:rarest]
        own = [p for p in own if weight[words[p]] >= lightest * weight[words[own[0]]]]
        postings += [(words[p], i, p, weight[words[p]]) for p in own]
        full.append(sum(weight[words[p]] for p in own))
        start = phrase_at(t)
        phrase_words.append([(w, start + k) for k, w in enumerate(t.phrase.split())])
    index = F.broadcast(spark.createDataFrame(postings, "word string, template int, at_template int, weight double"))
    wholes, names = F.array(*map(F.lit, full)), F.array(*(F.lit(t.label) for t in templates))
    needed = F.array(*(F.array(*(F.struct(F.lit(w).alias("word"), F.lit(p).alias("at")) for w, p in own)) for own in phrase_words))
    indexed = sorted({w for w, *_ in postings})
    looked_up = (
        found.select("row", F.explode(F.filter("places", lambda x: x["word"].isin(indexed))).alias("x"))
        .select("row", F.col("x.word").alias("word"), F.col("x.at").alias("at")).join(index, "word")
    )
    aligned = looked_up.groupBy("row", "template", (F.col("at") - F.col("at_template")).alias("shift")).agg(F.sum(F.round("weight", 9).cast("decimal(20,9)")).cast("double").alias("got"))
    share = F.least(F.col("got") / F.get(wholes, F.col("template")), F.lit(1.0))
    candidates = aligned.withColumn("share", share).filter(F.col("share") >= least).select("row", "template", "shift", "share")
    candidates = scratch.table(candidates, "licence-candidates")
    candidates = F.broadcast(candidates) if candidates.count() <= most_broadcast else candidates
    own_phrase = F.get(needed, F.col("template"))
    standing = F.filter("places", lambda x: F.array_contains(own_phrase, F.struct(x["word"].alias("word"), (x["at"] - F.col("shift")).alias("at"))))
    labelled = (
        candidates.join(found.select("row", "places"), "row").filter(F.size(standing) == F.size(own_phrase))
        .groupBy("row").agg(F.array_sort(F.collect_set(F.get(names, F.col("template")))).alias("more"), F.max("share").alias("share"))
    )
    bases = [F.col(f"base{k}") for k in range(len(phrases))]
    every = F.concat(*bases)
    base_labels = F.array_sort(F.array_compact(F.array(*(F.when(F.size(b) > 0, F.lit(label)) for b, label in zip(bases, phrases, strict=True)))))
    return found.join(labelled, "row", "left").select(
        F.col("key").alias(key), "n_words", F.size(every).cast("long").alias("n_base"),
        F.array_min(every).cast("long").alias("first_word"), F.array_max(every).cast("long").alias("last_word"),
        F.array_join(base_labels, ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union(base_labels, F.coalesce("more", F.expr("CAST(array() AS array<string>)")))), ",").alias("labels"),
        F.when(F.size(every) > 0, F.lit(1.0)).otherwise(F.coalesce("share", F.lit(0.0))).alias("score"),
    )
