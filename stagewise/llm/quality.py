"""Document quality by gated-attention multiple-instance learning over passages."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stagewise import scratch
from .lmscore import remainder
from .words import STEP, hashes, mix

PASSAGE_WORDS = 100
HASHED = 512
#: Byte classes: each ASCII mark its own; digits, upper and lower case, controls, and UTF-8 heads and tails.
CLASSES = np.zeros(256, np.int64)
_marks = [b for b in range(33, 127) if not chr(b).isalnum()]
for _b in range(256):
    CLASSES[_b] = (
        _marks.index(_b) if _b in _marks else len(_marks) + (
            0 if 48 <= _b <= 57 else 1 if 65 <= _b <= 90 else 2 if 97 <= _b <= 122 else 3 if _b < 128 else 4 if _b < 192 else 5 if _b < 224 else 6
        )
    )
N_CLASSES = len(_marks) + 7
SHAPE = 6
WIDTH = N_CLASSES + SHAPE + HASHED


def passages(text: bytes | None) -> np.ndarray:
    """One row of features for each passage of PASSAGE_WORDS words; a text without words has one row of zeros.

    Features: roots of the byte classes' shares; repetition inside the passage and against what the
    document had before, word lengths and fill; roots of the hashed lower-cased words' shares.
    """
    words = text.split() if text else []
    if not words:
        return np.zeros((1, WIDTH), np.float32)
    h = hashes([w.lower() for w in words])
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    first = np.zeros(len(h), bool)
    first[np.unique(h, return_index=True)[1]] = True
    again = np.concatenate(([False], h[1:] == h[:-1]))
    slot = (mix(h * STEP) >> np.uint64(55)).astype(np.int64)
    rows = -(-len(words) // PASSAGE_WORDS)
    out = np.zeros((rows, WIDTH), np.float32)
    for r in range(rows):
        at, to = r * PASSAGE_WORDS, min(len(words), (r + 1) * PASSAGE_WORDS)
        n = to - at
        x = np.frombuffer(b"".join(words[at:to]), np.uint8)
        out[r, :N_CLASSES] = np.sqrt(np.bincount(CLASSES[x], minlength=N_CLASSES) / len(x))
        out[r, N_CLASSES : N_CLASSES + SHAPE] = (
            len(set(h[at:to].tolist())) / n, first[at:to].mean(), again[at:to].mean(),
            np.log1p(lengths[at:to].mean()), np.log1p(lengths[at:to].max()), n / PASSAGE_WORDS,
        )
        out[r, N_CLASSES + SHAPE :] = np.sqrt(np.bincount(slot[at:to], minlength=HASHED) / n)
    return out


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


@dataclass
class Attention:
    """Encoder, gated attention and classifier; :meth:`score` takes passages of many documents at once."""

    mean: np.ndarray
    scale: np.ndarray
    p: dict[str, np.ndarray] = field(default_factory=dict)

    def start(self, hidden: int, gate: int, prior: float, seed: int) -> None:
        r = np.random.default_rng(seed)
        draw = lambda *s: (r.standard_normal(s) / np.sqrt(s[0])).astype(np.float32)
        zero = lambda n: np.zeros(n, np.float32)
        self.p = {
            "E": draw(len(self.mean), hidden), "e": zero(hidden), "V": draw(hidden, gate), "U": draw(hidden, gate), "w": draw(gate, 1)[:, 0],
            "c": draw(hidden, 1)[:, 0], "d": np.array([np.log(prior / (1 - prior))], np.float32),
        }

    def forward(self, x: np.ndarray, starts: np.ndarray) -> dict[str, np.ndarray]:
        p, x = self.p, (x - self.mean) / self.scale
        h = np.tanh(x @ p["E"] + p["e"])
        t, g = np.tanh(h @ p["V"]), sigmoid(h @ p["U"])
        s = (t * g) @ p["w"]
        sizes = np.diff(np.append(starts, len(x)))
        own = np.repeat(np.arange(len(starts)), sizes)
        a = np.exp(s - np.maximum.reduceat(s, starts)[own])
        a /= np.add.reduceat(a, starts)[own]
        z = np.add.reduceat(a[:, None] * h, starts)
        return {"x": x, "h": h, "t": t, "g": g, "a": a, "own": own, "z": z, "y": sigmoid(z @ p["c"] + p["d"])}

    def score(self, x: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each document's score and each passage's weight."""
        f = self.forward(x, starts)
        return f["y"], f["a"]

    def gradients(self, x: np.ndarray, starts: np.ndarray, label: np.ndarray, decay: float) -> dict[str, np.ndarray]:
        f, p = self.forward(x, starts), self.p
        dy = (f["y"] - label) / len(label)
        dz = dy[:, None] * p["c"]
        own, a, h, t, g = f["own"], f["a"], f["h"], f["t"], f["g"]
        da = (dz[own] * h).sum(1)
        ds = a * (da - np.add.reduceat(a * da, starts)[own])
        dt, dg = ds[:, None] * p["w"] * g * (1 - t * t), ds[:, None] * p["w"] * t * g * (1 - g)
        dh = a[:, None] * dz[own] + dt @ p["V"].T + dg @ p["U"].T
        de = dh * (1 - h * h)
        return {
            "E": f["x"].T @ de + decay * p["E"], "e": de.sum(0), "V": h.T @ dt, "U": h.T @ dg, "w": (t * g).T @ ds,
            "c": f["z"].T @ dy, "d": np.array([dy.sum()]),
        }


def moments(bags: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Mean and deviation of each feature over all passages, bag by bag."""
    n, total, squares = 0, np.zeros(WIDTH), np.zeros(WIDTH)
    for b in bags:
        x = b.astype(np.float64)
        n, total, squares = n + len(x), total + x.sum(0), squares + (x * x).sum(0)
    mean = total / n
    return mean.astype(np.float32), np.maximum(np.sqrt(np.maximum(squares / n - mean * mean, 0)), 0.01).astype(np.float32)


def fit(bags: list[np.ndarray], labels: np.ndarray, hidden: int = 24, gate: int = 12, epochs: int = 12, batch: int = 64, rate: float = 2e-3, decay: float = 2e-4, seed: int = 5) -> Attention:
    """Adam on the log loss of whole documents. With no rows, or of one label only, the prior is all it knows."""
    if not bags:
        m = Attention(np.zeros(WIDTH, np.float32), np.ones(WIDTH, np.float32))
        m.start(hidden, gate, 0.5, seed)
        return m
    m = Attention(*moments(bags))
    m.start(hidden, gate, float(np.clip(labels.mean(), 0.01, 0.99)), seed)
    r = np.random.default_rng(seed)
    first, second, step = {k: np.zeros_like(v) for k, v in m.p.items()}, {k: np.zeros_like(v) for k, v in m.p.items()}, 0
    for _ in range(epochs):
        order = r.permutation(len(bags))
        for at in range(0, len(order), batch):
            now = order[at : at + batch]
            sizes = np.array([len(bags[i]) for i in now])
            starts = np.concatenate(([0], np.cumsum(sizes)[:-1]))
            step += 1
            for k, g in m.gradients(np.concatenate([bags[i] for i in now]).astype(np.float32), starts, labels[now], decay).items():
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.999 * second[k] + 0.001 * g * g
                m.p[k] = (m.p[k] - rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    return m


def train_quality(df: DataFrame, labels: DataFrame, key: str, text: str, label: str, modulus: int, held_out: int, sample_rows: int, sample_passages: int) -> Attention:
    """Fit on labelled rows in the order of their key's hash, every passage of each.

    At most ``sample_rows`` keys and rows are taken, and only as many of these, in that order, as have
    ``sample_passages`` passages together; a row that has more by itself can't be among them. Both
    bounds are on what reaches the driver: passages are a kilobyte each.
    """
    usable = labels.filter(F.col(label).isNotNull() & F.col(key).isNotNull() & (remainder(key, modulus) != held_out))
    chosen = (
        usable.groupBy(F.col(key).alias("_key")).agg(F.max(label).cast("double").alias("_label"))
        .orderBy(F.xxhash64("_key"), "_key").limit(sample_rows)
    )
    rows = df.select(F.col(key).alias("_id"), F.col(text).cast("string").cast("binary").alias("_text")).join(F.broadcast(chosen), F.col("_id") == F.col("_key"))

    def run(batches):
        for batch in batches:
            for o, y, value in zip(*batch.columns, strict=True):
                x = passages(value.as_buffer().to_pybytes() if value.is_valid else None)
                if len(x) <= sample_passages:
                    raw = x.astype(np.float16).tobytes()
                    yield pa.RecordBatch.from_pylist([{"o": o.as_py(), "tie": xxhash.xxh3_64_intdigest(raw) >> 1, "y": y.as_py(), "n": len(x), "x": raw}], schema)

    schema = pa.schema([("o", pa.int64()), ("tie", pa.int64()), ("y", pa.float64()), ("n", pa.int64()), ("x", pa.binary())])
    encoded = scratch.table(rows.select(F.xxhash64("_key"), "_label", "_text").mapInArrow(run, "o long, tie long, y double, n long, x binary"), "passages")
    sizes = encoded.select("o", "tie", "n").orderBy("o", "tie").limit(sample_rows).toArrow()
    taken = int(np.searchsorted(np.cumsum(sizes["n"].to_numpy()), sample_passages, side="right"))
    if not taken:
        return fit([], np.zeros(0))
    o, tie = sizes["o"][taken - 1].as_py(), sizes["tie"][taken - 1].as_py()
    last = (F.col("o") < o) | ((F.col("o") == o) & (F.col("tie") <= tie))
    # equal rows beyond the last one taken are cut off by number
    got = encoded.filter(last).orderBy("o", "tie").limit(taken).toArrow()
    bags = [np.frombuffer(x, np.float16).reshape(-1, WIDTH) for x in got["x"].to_pylist()]
    return fit(bags, got["y"].to_numpy())


def quality_scores(
    df: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", threshold: float = 0.3,
    modulus: int = 5, held_out: int = 0, sample_rows: int = 4000, sample_passages: int = 40_000, model: Attention | None = None,
) -> DataFrame:
    """One row per document: key, held_out, score, predicted, n_passages, top_passage, top_weight.

    Every passage of the whole text is encoded and weighed; ``top_passage`` is the one with most
    weight. Labels are read only where the key's crc32 leaves another remainder than ``held_out``;
    of several labels for a key the greatest holds. Null and empty texts are one empty passage;
    repeated rows get a result each, an empty table none; without labels every score is near a half.
    The fit uses whole documents, at most ``sample_rows`` with at most ``sample_passages`` passages
    together (:func:`train_quality`); scoring has no limits.
    """
    scratch.not_among(key, ["held_out", "score", "predicted", "n_passages", "top_passage", "top_weight"])
    kind = df.schema[key].dataType.simpleString()
    model = model or train_quality(df, labels, key, text, label, modulus, held_out, sample_rows, sample_passages)

    def run(batches):
        for batch in batches:
            scores, counts, tops, weights = [], [], [], []

            def flush(bags):
                starts = np.concatenate(([0], np.cumsum([len(b) for b in bags])[:-1]))
                y, a = model.score(np.concatenate(bags), starts)
                scores.extend(y.tolist())
                for at, b in zip(starts.tolist(), bags, strict=True):
                    own = a[at : at + len(b)]
                    counts.append(len(b))
                    tops.append(int(own.argmax()))
                    weights.append(float(own.max()))

            bags, held = [], 0
            for value in batch.column(2):
                bags.append(passages(value.as_buffer().to_pybytes() if value.is_valid else None))
                held += len(bags[-1])
                if held >= 2048:
                    flush(bags)
                    bags, held = [], 0
            if bags:
                flush(bags)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(scores, pa.float64()), pa.array([int(s >= threshold) for s in scores], pa.int32()), pa.array(counts, pa.int64()), pa.array(tops, pa.int64()), pa.array(weights, pa.float64())],
                [key, "held_out", "score", "predicted", "n_passages", "top_passage", "top_weight"],
            )

    source = df.select(F.col(key), (remainder(key, modulus) == held_out).alias("held_out"), F.col(text).cast("string").cast("binary"))
    return source.mapInArrow(run, f"`{key}` {kind}, held_out boolean, score double, predicted int, n_passages long, top_passage long, top_weight double")


def score_column(model: Attention, text: str = "text"):
    """The score of a text column, for filters; null and empty texts are one empty passage."""

    @F.arrow_udf("double")
    def of(texts: pa.Array) -> pa.Array:
        out = []
        for value in texts.to_pylist():
            x = passages(value)
            out.append(float(model.score(x, np.zeros(1, np.int64))[0][0]))
        return pa.array(out, pa.float64())

    return of(F.col(text).cast("string").cast("binary"))


def keep_good(df: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", threshold: float = 0.3, modulus: int = 5, held_out: int = 0, sample_rows: int = 4000, sample_passages: int = 40_000) -> DataFrame:
    """The rows of ``df`` whose score reaches the threshold, with all columns; nothing is shuffled.

    Null and empty texts are judged as one empty passage, repeated rows alike; an empty table gives none.
    """
    model = train_quality(df, labels, key, text, label, modulus, held_out, sample_rows, sample_passages)
    return df.filter(score_column(model, text) >= threshold)
