"""Language ID by a bidirectional gated recurrent network over bytes.

Two GRUs read windows of ``WINDOW`` bytes in both directions; a softmax over both states labels every
byte position, and a document's probabilities are the mean over all its positions. The network is trained
here in numpy, by backpropagation through time with Adam, on windows of a bounded sample of documents.
Inference runs all windows of many documents side by side, one byte position at a time.

Defined results: a text that is null, empty or without a letter is ``und`` with score 0; without any
training row every document is ``und``; whole texts are read (the last window of a text overlaps the one
before, whose positions count once; shorter texts are filled up with spaces that don't count); documents
with a null id are labelled, held_out null; rows are independent, so repeated rows and ids are kept; an
empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import crc_mod, hash_sample, slices, table

WINDOW = 64
HIDDEN = 8
CHUNK = 2048


class Gru:
    """One direction: a table of byte contributions (3H x 256) and recurrent weights (3H x H); gates z, r, n."""

    def __init__(self, rng: np.random.Generator, h: int = HIDDEN):
        self.h = h
        self.table = (rng.standard_normal((3 * h, 256)) * 0.3).astype(np.float32)
        self.u = (rng.standard_normal((3 * h, h)) / np.sqrt(h)).astype(np.float32)

    def run(self, x: np.ndarray, tape: list | None = None) -> np.ndarray:
        """States (T, H, B) for bytes x (T, B)."""
        h, steps, width = self.h, *x.shape
        out = np.empty((steps, h, width), np.float32)
        state = np.zeros((h, width), np.float32)
        for t in range(steps):
            a = self.table.take(x[t], axis=1)
            rec = self.u @ state
            gates = a[: 2 * h]
            gates += rec[: 2 * h]
            # logistic function by way of tanh
            gates *= 0.5
            np.tanh(gates, out=gates)
            gates *= 0.5
            gates += 0.5
            z, r = gates[:h], gates[h:]
            n = r * rec[2 * h :]
            n += a[2 * h :]
            np.tanh(n, out=n)
            if tape is not None:
                tape.append((state, z, r, n, rec[2 * h :]))
            state = n + z * (state - n)
            out[t] = state
        return out

    def back(self, x: np.ndarray, tape: list, grad: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Gradients of the table and of u, from those of the states (T, H, B)."""
        h, steps, width = self.h, *x.shape
        d_in = np.empty((steps, 3 * h, width), np.float32)
        d_u = np.zeros_like(self.u)
        d_state = np.zeros((h, width), np.float32)
        for t in reversed(range(steps)):
            state, z, r, n, rec = tape[t]
            d = d_state + grad[t]
            d_n = d * (1 - z) * (1 - n * n)
            d_in[t, :h] = d * (state - n) * z * (1 - z)
            d_in[t, h : 2 * h] = d_n * rec * r * (1 - r)
            d_in[t, 2 * h :] = d_n
            d_rec = np.concatenate([d_in[t, : 2 * h], d_n * r])
            d_u += d_rec @ state.T
            d_state = d * z + self.u.T @ d_rec
        flat, to = d_in.transpose(1, 0, 2).reshape(3 * h, -1), x.ravel()
        d_table = np.stack([np.bincount(to, row, 256) for row in flat]).astype(np.float32)
        return d_table, d_u


class Network:
    """Both directions and the output layer; a few ten kilobytes."""

    def __init__(self, labels: list[str], seed: int = 5):
        rng = np.random.default_rng(seed)
        self.labels, self.forth, self.back = labels, Gru(rng), Gru(rng)
        self.w = (rng.standard_normal((len(labels), 2 * HIDDEN)) * 0.3).astype(np.float32)
        self.b = np.zeros((len(labels), 1), np.float32)

    def probabilities(self, x: np.ndarray, tapes: tuple[list, list] | None = None):
        """Softmax (T, L, B) for bytes x (T, B), and the states."""
        f = self.forth.run(x, tapes and tapes[0])
        g = self.back.run(x[::-1], tapes and tapes[1])[::-1]
        s = np.concatenate([f, g], axis=1)
        p = self.w @ s + self.b
        p -= p.max(axis=1, keepdims=True)
        np.exp(p, out=p)
        p /= p.sum(axis=1, keepdims=True)
        return p, s

    def step(self, x: np.ndarray, y: np.ndarray) -> tuple[float, list[np.ndarray]]:
        """Mean cross-entropy over all positions of windows x (T, B) of classes y, and the gradients of :meth:`weights`."""
        tapes: tuple[list, list] = ([], [])
        p, s = self.probabilities(x, tapes)
        steps, _, width = p.shape
        own = p[:, y, np.arange(width)]
        d = p.copy()
        d[:, y, np.arange(width)] -= 1
        d /= steps * width
        d_w = np.einsum("tlb,thb->lh", d, s, optimize=True)
        d_s = self.w.T @ d
        f = self.forth.back(x, tapes[0], d_s[:, :HIDDEN])
        g = self.back.back(x[::-1], tapes[1], d_s[::-1, HIDDEN:])
        return float(-np.log(own + 1e-9).mean()), [*f, *g, d_w, d.sum(axis=(0, 2))[:, None]]

    def weights(self) -> list[np.ndarray]:
        return [self.forth.table, self.forth.u, self.back.table, self.back.u, self.w, self.b]

    def classify(self, texts: list[bytes]) -> np.ndarray:
        """Mean label probabilities of each non-empty text (0 for empty ones)."""
        blocks, owner, first = [], [], []
        for i, t in enumerate(texts):
            raw = np.frombuffer(t, np.uint8)
            n = len(raw)
            if not n:
                continue
            if n < WINDOW:
                whole, tail = np.zeros((0, WINDOW), np.uint8), np.pad(raw, (0, WINDOW - n), constant_values=32)[None]
            else:
                whole, tail = raw[: n // WINDOW * WINDOW].reshape(-1, WINDOW), raw[n - WINDOW :][None]
            blocks.append(whole)
            owner += [i] * len(whole)
            first += [0] * len(whole)
            if n % WINDOW:
                blocks.append(tail)
                owner.append(i)
                first.append(WINDOW - n % WINDOW if n > WINDOW else -(WINDOW - n))
        out = np.zeros((len(texts), len(self.labels)))
        if not blocks:
            return out
        x, own, start = np.concatenate(blocks), np.array(owner), np.array(first)
        for at in range(0, len(x), CHUNK):
            p, _ = self.probabilities(x[at : at + CHUNK].T.astype(np.intp))
            o, st = own[at : at + CHUNK], start[at : at + CHUNK]
            odd = np.flatnonzero(st)
            for k in odd.tolist():
                p[: st[k] if st[k] > 0 else 0, :, k] = 0
                if st[k] < 0:
                    p[st[k] :, :, k] = 0
            sums = p.sum(axis=0, dtype=np.float64)
            for c in range(len(self.labels)):
                out[:, c] += np.bincount(o, sums[c], len(texts))
        return out / np.maximum(1, [len(t) for t in texts])[:, None]


def train(texts: list[bytes], langs: list[str], steps: int = 240, batch: int = 256, seed: int = 5) -> Network | None:
    """A network for the languages found; windows are drawn with equal chance for each language."""
    labels = sorted(set(langs))
    use = [(np.frombuffer(t, np.uint8), labels.index(x)) for t, x in zip(texts, langs, strict=True) if t]
    if not use:
        return None
    rng = np.random.default_rng(seed)
    by = [[t for t, y in use if y == k] for k in range(len(labels))]
    kinds = [k for k in range(len(labels)) if by[k]]
    net = Network(labels, seed)
    ws = net.weights()
    mean, square = [np.zeros_like(w) for w in ws], [np.zeros_like(w) for w in ws]
    for i in range(1, steps + 1):
        y = rng.choice(kinds, batch)
        x = np.empty((batch, WINDOW), np.intp)
        for k, c in enumerate(y):
            t = by[c][rng.integers(len(by[c]))]
            at = rng.integers(0, max(1, len(t) - WINDOW + 1))
            part = t[at : at + WINDOW]
            x[k, : len(part)] = part
            x[k, len(part) :] = 32
        _, grads = net.step(x.T.copy(), y)
        rate = 0.02 * min(1, i / 20) * (0.1 if i > 0.85 * steps else 1)
        size = np.sqrt(sum(float((g * g).sum()) for g in grads))
        for w, g, m, v in zip(ws, grads, mean, square, strict=True):
            g = g * min(1.0, 1.0 / (size + 1e-9))
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            w -= (rate * (m / (1 - 0.9**i)) / (np.sqrt(v / (1 - 0.99**i)) + 1e-7)).astype(np.float32)
    return net


def predict(docs: DataFrame, train_docs: int = 2000, hold_out: int = 4, held: int = 2) -> DataFrame:
    """(doc_id, lang_pred, score) of every row of ``docs``; learns from about ``train_docs`` rows outside the fold ``held``."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), F.col("lang").cast("string").alias("lang"))
    known = rows.filter((crc_mod(F.col("doc_id"), hold_out) != held) & F.col("lang").isNotNull() & (F.col("text") != ""))
    got = sorted((r.doc_id, r.text, r.lang) for r in hash_sample(known, "doc_id", train_docs).distinct().limit(2 * train_docs).collect())
    net = docs.sparkSession.sparkContext.broadcast(train([t.encode() for _, t, _ in got], [x for _, _, x in got]))

    def run(batches):
        n = net.value
        for b in batches:
            for part in slices(b, 1):
                texts = part.column(1).to_pylist()
                lettered = [n is not None and any(map(str.isalpha, t)) for t in texts]
                langs, scores = ["und"] * len(texts), [0.0] * len(texts)
                if n is not None:
                    p = n.classify([t.encode() if ok else b"" for t, ok in zip(texts, lettered, strict=True)])
                    best = p.argmax(axis=1)
                    for i in np.flatnonzero(lettered).tolist():
                        langs[i], scores[i] = n.labels[best[i]], min(1.0, float(p[i, best[i]]))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=["doc_id", "lang_pred", "score"])

    return rows.select("doc_id", "text").mapInArrow(run, "doc_id long, lang_pred string, score double")


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted language of every document."""
    out = predict(table(spark, sf_dir, "documents"))
    return out.select("doc_id", (crc_mod(F.col("doc_id"), 4) == 2).alias("held_out"), "lang_pred", "score")
