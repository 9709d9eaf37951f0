"""Scores of whole texts: an add-one unigram base over exact corpus counts, and a log-bilinear model."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stagewise import scratch
from .logbilinear import LN10, LogBilinear, improve, single_threaded, untrained
from .words import hashes, space_words

#: A word has no space, so no word has this hash by its spelling.
END = xxhash.xxh3_64_intdigest(b" end")
#: Tokens scored in one go, and those counted: fewer rows come from longer runs, which take 8 bytes a token.
AT_ONCE, COUNTED = 1 << 19, 1 << 21
#: Tokens of whole texts that a task trains on before its parameters go into the average.
UNIT = 1 << 21
#: Training tokens for each word that the model predicts by itself, and from which on it has more context classes.
TOKENS_A_WORD, MORE_CONTEXTS = 1 << 15, 1 << 28
#: Parameters are averaged as multiples of this, so that the sums don't depend on their order.
GRAIN = 2.0**-18


def remainder(key: str, modulus: int) -> Column:
    """crc32 of the key as text; a null key counts as empty text."""
    return F.crc32(F.encode(F.coalesce(F.col(key).cast("string"), F.lit("")), "UTF-8")) % modulus


def token_hashes(text: bytes | None) -> np.ndarray:
    words = space_words(text)
    h = np.empty(len(words) + 1, np.uint64)
    h[:-1], h[-1] = hashes(words), END
    return h


def token_counts(texts: DataFrame) -> DataFrame:
    """(h, c): how often each token hash occurs in the texts, ends included."""

    def run(batches):
        room, held = np.empty(COUNTED, np.uint64), 0

        def rows(some):
            some.sort()
            starts = np.flatnonzero(np.concatenate((np.ones(min(len(some), 1), bool), some[1:] != some[:-1])))
            return pa.RecordBatch.from_arrays([pa.array(some[starts].view(np.int64)), pa.array(np.diff(starts, append=len(some)))], ["h", "c"])

        for batch in batches:
            for value in batch.column(0):
                h = token_hashes(value.as_buffer().to_pybytes() if value.is_valid else None)
                if held + len(h) > COUNTED:
                    yield rows(room[:held])
                    held = 0
                if len(h) > COUNTED:
                    yield rows(h)
                else:
                    room[held : held + len(h)] = h
                    held += len(h)
        yield rows(room[:held])

    return texts.mapInArrow(run, "h long, c long").groupBy("h").agg(F.sum("c").alias("c"))


def commonest(counts: DataFrame, most: int) -> DataFrame:
    """The tokens above the least count step that leaves at most ``most`` of them.

    Steps are eighths of a doubling, so a histogram of a few hundred rows at most finds the bound and
    nothing is sorted; equal counts stay or go together.
    """
    step = F.floor(F.log2("c") * 8)
    sizes = {r["step"]: r["count"] for r in counts.groupBy(step.alias("step")).count().collect()}
    kept, bound = 0, max(sizes, default=0) + 1
    for at in sorted(sizes, reverse=True):
        kept += sizes[at]
        if kept > most:
            break
        bound = at
    return counts.filter(step >= bound)


class Scorer:
    """The frequent tokens' counts and words, and the model."""

    def __init__(self, frequent: np.ndarray, counts: np.ndarray, words: int, all_tokens: int):
        order = np.argsort(frequent)
        self.known, self.count = frequent[order], counts[order]
        # words by falling count, then the end, then all other words
        ranked = [i for i in np.lexsort((frequent, -counts)).tolist() if frequent[i] != END][:words]
        self.end, self.other = len(ranked), len(ranked) + 1
        by_place = np.full(len(frequent), self.other, np.int64)
        by_place[ranked] = np.arange(len(ranked))
        by_place[frequent == END] = self.end
        self.klass = by_place[order]
        # where the frequent tokens with each beginning of the hash start
        self.bits = np.uint64(64 - max(1, len(order).bit_length()))
        self.first = np.searchsorted(self.known >> self.bits, np.arange((1 << 64 - int(self.bits)) + 1, dtype=np.uint64)).astype(np.int32)
        self.log_count = np.log10(self.count + 1.0)
        self.word_counts = np.zeros(self.other + 1)
        np.add.at(self.word_counts, self.klass, self.count)
        self.word_counts[self.other] += all_tokens - self.count.sum()

    def classes(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Word number and place of each token, and whether it is a frequent one."""
        if not len(self.known):
            return np.where(h == END, self.end, self.other), np.zeros(len(h), np.int64), np.zeros(len(h), bool)
        bucket = (h >> self.bits).astype(np.int64)
        at = np.minimum(self.first.take(bucket), len(self.known) - 1)
        ok = self.known.take(at) == h
        left, on = np.flatnonzero(~ok), 1
        while len(left):
            place = self.first.take(bucket[left]) + on
            inside = place < self.first.take(bucket[left] + 1)
            left, place = left[inside], place[inside]
            found = self.known.take(place) == h[left]
            at[left[found]], ok[left[found]] = place[found], True
            left, on = left[~found], on + 1
        # an end that no training text has (no training text at all) is still the end
        return np.where(ok, self.klass[at], np.where(h == END, self.end, self.other)), at, ok

    def take(self, model: LogBilinear, norm: np.ndarray) -> None:
        self.model, self.norm = model, norm
        self.near, self.far = model.predicted()

    def log_probabilities(self, k: np.ndarray, block: int = 1 << 15) -> np.ndarray:
        """ln P of each word from the third on, given the two before."""
        m, c = self.model, self.model.classes(k, self.end)
        out = np.empty(len(k) - 2)
        for at in range(0, len(out), block):
            to = min(at + block, len(out))
            far, near, word = c[at:to], c[at + 1 : to + 1], k[at + 2 : to + 2]
            q = self.near.take(near, axis=0)
            q += self.far.take(far, axis=0)
            out[at:to] = np.einsum("ij,ij->i", q, m.vectors.take(word, axis=0)) + m.bias.take(word) - self.norm.take(far * self.norm.shape[1] + near)
        return out


def training_units(learn: DataFrame, scorer: Scorer, total: int) -> DataFrame:
    """(k): the word numbers of about UNIT tokens of whole texts, dealt by the hash of key and text: every training row is in one unit."""
    shared = learn.sparkSession.sparkContext.broadcast(scorer)

    def numbers(batches):
        def rows(batch, at, tokens):
            ends = np.cumsum([0, *map(len, tokens)]) * 4
            k = shared.value.classes(np.concatenate(tokens))[0].astype(np.int32)
            texts = pa.Array.from_buffers(pa.binary(), len(tokens), [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(k)])
            return pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(tokens)), texts], ["o", "k"])

        for batch in batches:
            at, tokens, held = 0, [], 0
            for i, v in enumerate(batch.column(1)):
                tokens.append(token_hashes(v.as_buffer().to_pybytes() if v.is_valid else None))
                held += len(tokens[-1])
                if held >= AT_ONCE or i + 1 == batch.num_rows:
                    yield rows(batch, at, tokens)
                    at, tokens, held = i + 1, [], 0

    def units(batches):
        parts, held = [], 0
        for batch in batches:
            for k in batch.column(1).to_pylist():
                parts.append(k)
                held += len(k) // 4
                if held >= UNIT:
                    yield pa.RecordBatch.from_arrays([pa.array([b"".join(parts)], pa.binary())], ["k"])
                    parts, held = [], 0
        if parts:
            yield pa.RecordBatch.from_arrays([pa.array([b"".join(parts)], pa.binary())], ["k"])

    n = max(1, -(-total // UNIT))
    dealt = learn.mapInArrow(numbers, "o long, k binary").repartitionById(n, F.pmod("o", F.lit(n)).cast("int")).sortWithinPartitions("o", "k")
    return scratch.table(dealt.mapInArrow(units, "k binary"), "training-units")


def averaged(units: DataFrame, model: LogBilinear, scorer: Scorer, seed: int, **options) -> LogBilinear:
    """The model after one pass over every unit: each is trained on from ``model``, and each row of the parameters
    becomes the mean of the units that moved it, weighted by how often they did. A task sums its units up, so what is
    shuffled grows with the tasks and not with the units."""
    spark, end, counts = units.sparkSession, scorer.end, scorer.word_counts
    shared = spark.sparkContext.broadcast((model, counts))
    v, c, d = len(model.vectors), len(model.contexts), model.near.shape[0]
    names = ["id", "n", *(f"x{i}" for i in range(d + 1))]

    def run(batches):
        single_threaded()
        sums, times = np.zeros((v + c + 2 * d, d + 1), np.int64), np.zeros(v + c + 2 * d, np.int64)
        for batch in batches:
            for value in batch.column(0):
                start, counts = shared.value
                m = LogBilinear(*(x.copy() for x in vars(start).values()))
                tokens = np.frombuffer(value.as_buffer(), np.int32)
                moved = improve(m, tokens, end, counts, seed=seed, **options)
                n = np.concatenate((moved["vectors"], moved["contexts"], np.full(2 * d, len(tokens), np.int32))).astype(np.int64)
                x = np.zeros((v + c + 2 * d, d + 1), np.float32)
                x[:, :d] = np.concatenate((m.vectors, m.contexts, m.near, m.far))
                x[:v, d] = m.bias
                sums += np.round(x / GRAIN).astype(np.int64) * n[:, None]
                times += n
        at = np.flatnonzero(times)
        if len(at):
            yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(times[at]), *(pa.array(np.ascontiguousarray(col)) for col in sums[at].T)], names)

    moved = units.mapInArrow(run, "id int, " + ", ".join(f"{name} long" for name in names[1:]))
    means = moved.groupBy("id").agg(*((F.sum(name) / F.sum("n")).alias(name) for name in names[2:])).toArrow()
    x = np.concatenate((np.column_stack((model.vectors, model.bias)), np.pad(np.concatenate((model.contexts, model.near, model.far)), ((0, 0), (0, 1)))))
    if means.num_rows:
        x[means["id"].to_numpy()] = np.stack([means[name].to_numpy() for name in names[2:]], 1) * GRAIN
    vectors, contexts, near, far = (np.ascontiguousarray(part) for part in np.split(x[:, :d].astype(np.float32), np.cumsum([v, c, d])))
    return LogBilinear(vectors, contexts, near, far, x[:v, d].astype(np.float32))


def normalisers(spark, model: LogBilinear) -> np.ndarray:
    """norm[far, near] of all pairs of context classes, some far classes a task."""
    shared, classes = spark.sparkContext.broadcast(model), len(model.contexts)

    def run(batches):
        for batch in batches:
            for f in batch.column(0).to_pylist():
                yield pa.RecordBatch.from_arrays([pa.array([f]), pa.array([shared.value.norms(f).tobytes()], pa.binary())], ["f", "x"])

    got = spark.range(0, classes, 1, max(1, min(classes, len(model.vectors) // 256))).mapInArrow(run, "f long, x binary").toArrow().sort_by("f")
    return np.stack([np.frombuffer(x, np.float32) for x in got["x"].to_pylist()])


def language_scores(
    df: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    modulus: int = 7,
    held_out: int = 2,
    frequent: int = 1 << 18,
    words: int = 1022,
    epochs: int = 2,
    seed: int = 3,
    d: int = 24,
    **options,
) -> DataFrame:
    """One row per document: key, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Tokens are lower-cased words and one end for each text; a null or empty text is an end alone;
    every row counts, also repeated ones. Learning takes the rows whose key's crc32 leaves another
    remainder than ``held_out``.

    Counts cover every training token. The commonest, ``frequent`` at most, are broadcast;
    each document's other tokens are summed up and joined with the count table by hash, so no
    vocabulary is ever held whole. Tokens are identified by 64-bit hashes.

    The log-bilinear model is fitted on every training row. It predicts the ``words`` commonest words,
    or one word for each TOKENS_A_WORD training tokens if those are more (the broadcast ones at most);
    the end; and any other word, which then is drawn by its training count plus one, all unseen words
    sharing one such draw. As contexts it tells the ``words`` commonest apart, more of them by the cube
    root of the tokens beyond MORE_CONTEXTS. Each of ``epochs`` rounds trains units of about UNIT tokens
    from the same parameters and averages these. Scores are normalised. With no training rows it is the
    untrained model; an empty table gives no rows. Of tokens with one count at the bound of the broadcast
    ones all or none are broadcast; among the predicted words the smaller hash goes first.
    """
    scratch.not_among(key, ["held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])
    spark, asked = df.sparkSession, key
    key, df, text = "_key", df.select(F.col(key).alias("_key"), F.col(text).alias("_text")), "_text"
    kind = df.schema[key].dataType.simpleString()
    body = F.col(text).cast("string").cast("binary")
    learn = df.filter(remainder(key, modulus) != held_out)
    counts = scratch.table(token_counts(learn.select(body)), "token-counts")
    total, distinct = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    top = commonest(counts, frequent).toArrow()
    scorer = Scorer(top["h"].to_numpy().view(np.uint64), top["c"].to_numpy(), max(words, total // TOKENS_A_WORD), total)
    contexts = min(scorer.end, int(words * max(1.0, (total / MORE_CONTEXTS) ** (1 / 3)))) + 2
    model = untrained(scorer.other + 1, contexts, scorer.word_counts, d, seed)
    units = training_units(learn.select(F.xxhash64(key, text), body), scorer, total)
    for i in range(epochs):
        model = averaged(units, model, scorer, seed + i, **options)
    scorer.take(model, normalisers(spark, model))
    in_classes = scorer.klass < scorer.end
    other_tokens = total - int(scorer.count[in_classes].sum()) - int(scorer.count[scorer.klass == scorer.end].sum())
    other_kinds = distinct - int(in_classes.sum()) - int((scorer.klass == scorer.end).sum())
    other_log = math.log10(other_tokens + other_kinds + 1)
    base_log = math.log10(total + distinct + 1)
    shared = spark.sparkContext.broadcast(scorer)

    def run(batches):
        s = shared.value

        def rows(batch, at, tokens):
            lengths = np.array([len(t) for t in tokens])
            starts = np.concatenate(([0], np.cumsum(lengths)[:-1]))
            h = np.concatenate(tokens)
            k, place, ok = s.classes(h)
            logs = np.where(ok, s.log_count[place] if len(s.log_count) else 0.0, 0.0)
            # two ends before each text
            padded = np.insert(k, np.repeat(starts, 2), s.end)
            word = np.ones(len(padded), bool)
            firsts = starts + 2 * np.arange(len(starts))
            word[firsts] = word[firsts + 1] = False
            probability = np.zeros(len(padded))
            probability[2:] = s.log_probabilities(padded)
            ln = np.add.reduceat(probability[word], starts)
            outside = k == s.other
            rare = np.flatnonzero(~ok & (h != END))
            owner = np.searchsorted(starts, rare, side="right") - 1
            lists_at = np.concatenate(([0], np.cumsum(np.bincount(owner, minlength=len(starts))))).astype(np.int32)
            return pa.RecordBatch.from_arrays([
                *(batch.column(c).slice(at, len(tokens)) for c in range(3)),
                pa.array(lengths.astype(np.int64)), pa.array(np.add.reduceat(ok.astype(np.int64), starts)),
                pa.array(np.add.reduceat(logs, starts)), pa.array(np.add.reduceat(np.where(outside, logs, 0.0), starts)),
                pa.array(np.add.reduceat(outside.astype(np.int64), starts)), pa.array(ln / LN10),
                pa.ListArray.from_arrays(pa.array(lists_at), pa.array(h[rare].view(np.int64))),
            ], names)

        for batch in batches:
            at, tokens, held = 0, [], 0
            for i, value in enumerate(batch.column(3)):
                tokens.append(token_hashes(value.as_buffer().to_pybytes() if value.is_valid else None))
                held += len(tokens[-1])
                if held >= AT_ONCE or i + 1 == batch.num_rows:
                    yield rows(batch, at, tokens)
                    at, tokens, held = i + 1, [], 0

    names = ["row", key, "held_out", "n_tokens", "frequent", "log_counts", "other_logs", "others", "model", "rare"]
    ddl = f"row long, `{key}` {kind}, held_out boolean, n_tokens long, frequent long, log_counts double, other_logs double, others long, model double, rare array<long>"
    source = df.select(F.monotonically_increasing_id().alias("row"), F.col(key), (remainder(key, modulus) == held_out).alias("held_out"), body)
    part = scratch.table(source.mapInArrow(run, ddl), "scores")
    rare = part.select("row", F.explode("rare").alias("h")).groupBy("row", "h").count()
    rare = rare.join(counts, "h").groupBy("row").agg(F.sum("count").alias("n"), F.sum(F.col("count") * F.log10(F.col("c") + 1)).alias("logs"))
    logs = F.coalesce("logs", F.lit(0.0))
    return part.drop("rare").join(rare, "row", "left").select(
        F.col(key).alias(asked), "held_out", "n_tokens", (F.col("frequent") + F.coalesce("n", F.lit(0))).alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"),
        (F.col("log_counts") + logs - F.col("n_tokens") * F.lit(base_log)).alias("base_score"),
        (F.col("model") + F.col("other_logs") + logs - F.col("others") * F.lit(other_log)).alias("score"),
    )
