"""A log-bilinear language model over words, trained in numpy by noise-contrastive estimation."""

from __future__ import annotations

import contextlib
import ctypes
from dataclasses import dataclass
from pathlib import Path

import numpy as np

LN10 = float(np.log(10))


def single_threaded() -> None:
    """One thread for numpy's small matrix products in this process: tasks already fill the cores.

    Spark asks for as many as an executor has cores. Where numpy has another library than its own, nothing is done.
    """
    for path in Path(np.__file__).parents[1].glob("numpy.libs/libscipy_openblas*"):
        with contextlib.suppress(AttributeError, OSError):
            ctypes.CDLL(str(path)).scipy_openblas_set_num_threads64_(1)


@dataclass
class LogBilinear:
    """Score of a word after two context classes: its bias plus the product of its vector and the predicted one.

    The predicted vector is the sum of the previous classes' vectors through a matrix for each
    place. The classes are the words themselves or, where there are more words than classes, the
    first of them, the end and one for all others (:meth:`classes`).
    """

    vectors: np.ndarray  # words x d, of the predicted word
    contexts: np.ndarray  # classes x d, of the previous words' classes
    near: np.ndarray  # d x d, for the class before
    far: np.ndarray  # d x d, for the one before that
    bias: np.ndarray

    def classes(self, k: np.ndarray, end: int) -> np.ndarray:
        """Context class of each word; the last two words are the end and any other word."""
        n = len(self.contexts)
        return k if n == len(self.vectors) else np.where(k < n - 2, k, np.where(k == end, n - 2, n - 1))

    def predicted(self) -> tuple[np.ndarray, np.ndarray]:
        """(near, far): each class's share of the predicted vector."""
        return self.contexts @ self.near, self.contexts @ self.far

    def norms(self, far: int, block: int = 1024) -> np.ndarray:
        """ln of the summed exponentials of all words' scores, for one far class and every near one."""
        near, fars = self.predicted()
        q = near + fars[far]
        top, total = np.full(len(q), -np.inf, np.float32), np.zeros(len(q))
        for at in range(0, len(self.vectors), block):
            s = q @ self.vectors[at : at + block].T + self.bias[at : at + block]
            new = np.maximum(top, s.max(1))
            s -= new[:, None]
            np.exp(s, out=s)
            total = total * np.exp(top - new) + s.sum(1)
            top = new
        return (np.log(total) + top).astype(np.float32)

    def tables(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(near, far, norm): ln P(w | f, n) = near[n, w] + far[f, w] - norm[f, n]."""
        near, far = self.predicted()
        norm = np.stack([self.norms(f) for f in range(len(far))])
        return (near @ self.vectors.T + self.bias).astype(np.float32), (far @ self.vectors.T).astype(np.float32), norm


def segments(tokens: np.ndarray, end: int, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows, real): runs of ``length + 2`` words, each after the first two predicted from the two before it.

    Texts close with an end each and start after two of them, so a second end follows each closing
    one; ``real`` marks the words that are predicted, which that end and the filling are not.
    """
    ends = np.flatnonzero(tokens == end)
    stream = np.insert(tokens, ends + 1, end)
    real = np.ones(len(stream), bool)
    real[ends + 1 + np.arange(len(ends))] = False
    fill = -len(stream) % length
    stream = np.concatenate(([end, end], stream, np.full(fill, end))).astype(np.int32)
    rows = np.lib.stride_tricks.sliding_window_view(stream, length + 2)[::length] if len(stream) > 2 else np.zeros((0, length + 2), np.int32)
    return rows, np.concatenate((real, np.zeros(fill, bool))).reshape(-1, length)


def untrained(words: int, classes: int, counts: np.ndarray, d: int = 24, seed: int = 3) -> LogBilinear:
    """Small random vectors, and as biases the unigram shares."""
    r = np.random.default_rng(seed)
    small = lambda *shape: (r.standard_normal(shape) * 0.1).astype(np.float32)
    p = (counts + 1.0) / (counts + 1.0).sum()
    return LogBilinear(small(words, d), small(classes, d), np.eye(d, dtype=np.float32), np.eye(d, dtype=np.float32) * np.float32(0.5), np.log(p).astype(np.float32))


class Descent:
    """AdaGrad steps of a table's rows."""

    def __init__(self, table: np.ndarray, most: int):
        """``most``: rows of a step, equal ones counted each."""
        self.table, self.sums = table, np.full_like(table, 1e-3)
        rows, self.width = table.shape
        #: With few rows more it is quicker to step through the whole table than to find the distinct ones.
        self.whole = rows <= 2 * most
        self.places, self.at = np.arange(max(rows if self.whole else 0, most)), np.zeros(0 if self.whole else rows, np.int64)
        self.cells = np.arange(len(self.places) * self.width).reshape(-1, self.width)

    def step(self, at: np.ndarray, grad: np.ndarray, rate: float) -> None:
        """One step of the rows ``at``, of which equal ones add up; a row without a gradient stays as it is."""
        if self.whole:
            g = np.bincount(self.cells.take(at, axis=0).ravel(), grad.ravel(), self.table.size).reshape(-1, self.width).astype(np.float32)
            x, rows = self.sums, slice(None)
            x += g * g
        else:
            # each row's gradients are summed up at the last of its places
            here = self.places[: len(at)]
            self.at[at] = here
            last = self.at.take(at)
            own = np.flatnonzero(last == here)
            g = np.bincount(self.cells.take(last, axis=0).ravel(), grad.ravel(), grad.size).reshape(-1, self.width).take(own, axis=0).astype(np.float32)
            rows = at.take(own)
            x = self.sums.take(rows, axis=0)
            x += g * g
            self.sums[rows] = x
        g *= rate
        g /= np.sqrt(x)
        self.table[rows] -= g


def improve(
    m: LogBilinear, tokens: np.ndarray, end: int, counts: np.ndarray, noise: int = 64, epochs: int = 1, batch: int = 1024,
    length: int = 32, rate: float = 0.15, seed: int = 3,
) -> dict[str, np.ndarray]:
    """Noise-contrastive estimation with AdaGrad, in place; each batch shares ``noise`` draws from the unigram counts.

    A batch has ``batch`` words in runs of ``length`` from anywhere in the tokens, so that a word's vector
    as a context serves the two words after it. Returns how often each word's and each class's vector was moved.
    """
    r = np.random.default_rng(seed)
    p = (counts + 1.0) / (counts + 1.0).sum()
    drawn = np.cumsum(p)
    lift = (np.log(p) + np.log(noise)).astype(np.float32)
    d = m.near.shape[0]
    out = np.column_stack((m.vectors, m.bias))  # the last column is the bias
    sums = {k: np.full_like(vars(m)[k], 1e-3) for k in ("near", "far")}
    moved = {"vectors": np.zeros(len(m.vectors), np.int32), "contexts": np.zeros(len(m.contexts), np.int32)}
    rows, real = segments(tokens, end, length)
    of_word = m.classes(np.arange(len(m.vectors)), end)
    step = max(1, batch // length)
    of_out, of_contexts = Descent(out, step * length + noise), Descent(m.contexts, step * (length + 1))
    for _ in range(epochs):
        order = r.permutation(len(rows))
        for start in range(0, len(order), step):
            here = order[start : start + step]
            now, ok = rows[here], real[here].ravel()
            word, n = now[:, 2:].ravel(), ok.size
            context = of_word.take(now[:, :-1].ravel())
            other = np.minimum(np.searchsorted(drawn, r.random(noise)), len(p) - 1)
            x = m.contexts.take(context, axis=0).reshape(-1, length + 1, d)
            x_near, x_far = x[:, 1:].reshape(n, d), x[:, :-1].reshape(n, d)
            q = np.ones((n, d + 1), np.float32)
            q[:, :d] = x_near @ m.near
            q[:, :d] += x_far @ m.far
            v_word, v_other = out.take(word, axis=0), out.take(other, axis=0)
            true = np.einsum("ij,ij->i", q, v_word) - lift[word]
            # sigmoid(s) = (1 + tanh(s / 2)) / 2, weighted by each word's share of the batch
            share = (ok * (0.5 / max(int(ok.sum()), 1))).astype(np.float32)
            false = q @ (v_other * np.float32(0.5)).T
            false -= lift[other] * np.float32(0.5)
            np.tanh(false, out=false)
            false += 1
            false *= share[:, None]
            g_true = (np.tanh(true * np.float32(0.5)) - 1) * share
            v_word *= g_true[:, None]
            dq = false @ v_other[:, :d]
            dq += v_word[:, :d]
            grad = np.empty((n + noise, d + 1), np.float32)
            np.multiply(q, g_true[:, None], out=grad[:n])
            np.matmul(false.T, q, out=grad[n:])
            grad_c = np.zeros(x.shape, np.float32)
            grad_c[:, 1:] = (dq @ m.near.T).reshape(-1, length, d)
            grad_c[:, :-1] += (dq @ m.far.T).reshape(-1, length, d)
            for name, side in (("near", x_near), ("far", x_far)):
                g = side.T @ dq
                sums[name] += g * g
                vars(m)[name][:] -= rate * g / np.sqrt(sums[name])
            drawn_or_met = np.concatenate((word, other))
            of_out.step(drawn_or_met, grad, rate)
            of_contexts.step(context, grad_c.reshape(-1, d), rate)
            # equal rows count once
            moved["vectors"][drawn_or_met] += 1
            moved["contexts"][context] += 1
    m.vectors, m.bias = np.ascontiguousarray(out[:, :d]), np.ascontiguousarray(out[:, d])
    return moved


def train(texts: list[np.ndarray], classes: int, end: int, counts: np.ndarray, d: int = 24, epochs: int = 3, seed: int = 3, **options) -> LogBilinear:
    """A model of these texts, every word a context class of its own."""
    m = untrained(classes, classes, counts, d, seed)
    improve(m, np.concatenate([np.append(t, end) for t in texts]) if texts else np.zeros(0, np.int64), end, counts, epochs=epochs, seed=seed, **options)
    return m
