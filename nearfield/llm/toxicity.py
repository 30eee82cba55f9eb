"""Toxicity by compression distance: two zstandard dictionaries, one trained on toxic and one on ordinary text.

A text's words are cut into windows of ``WINDOW`` words. Each window is compressed with the toxic and with the
ordinary dictionary; by how many bytes the toxic one is shorter is the window's gain. A document's counts of windows
with a gain of at least 1, 2, ... bytes, and of at most -1, -2, ..., go into a logistic calibration that gives the
score, 0.5 being the calibrated threshold. Words are written with their first ``MARKED`` ASCII letters in upper case,
so that a match at a word's beginning is not one in its middle.

Both dictionaries come from zstandard's trainer in the same way. Most of toxic text is ordinary text, and what both
hold says nothing: so a common dictionary, trained on ordinary text, stands behind each of the two at the same
distance, and each is trained on the words of its kind of text that the other kind lacks and that the common one
leaves ``uncovered``. In ``rounds`` further trainings each learns from the words on which the two differ: the toxic
one from toxic words it gains on, the ordinary one from ordinary words that the toxic one would take. Two things about
the trainer matter here: it counts no matches in a sample's last eight bytes, and its last step cuts the end of the
content, where its best segments stand, to make room for a header; so samples are padded, and filler in front of the
first sample is what is cut (:func:`trained`).

Training uses about ``toxic_docs`` and ``ordinary_docs`` labelled documents (picked by a hash of their id; all, if
there are fewer), which bounds what the driver holds; near copies among them count once. The calibration is fitted on
features from dictionaries that did not see the document (cross-fitting), and its threshold is that of the highest F1
there, at the labels' own shares of both kinds. Scoring compresses every word of every text.

Defined results: null and empty texts have no window and get the score the calibration gives to no
evidence; documents with a null id are scored, with held_out null; rows are independent, so repeated rows
and ids are kept; without labels of both kinds every score is the share of toxic labels (0 if none); an
empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import crc_mod, hash_sample, slices, table

WORD = re.compile(rb"[a-z\x80-\xff]+")
WINDOW, MARKED = 3, 4
TAIL = b"#" * 64  # behind every window and in both dictionaries, so that no window is too short to compress
GAP = bytes(8)  # so that no match runs from the dictionary text into the tail
FILLER = bytes(range(1, 32))
LEVEL = 6
GAINS, LOSSES = 7, 3


def words_of(text: str) -> list[bytes]:
    """Words of a text in lower case, their beginnings marked."""
    return [w[:MARKED].upper() + w[MARKED:] for w in WORD.findall(text.lower().encode("utf-8", "replace"))]


def windows(words: list[bytes]) -> list[bytes]:
    """Runs of ``WINDOW`` words with their borders."""
    return [b" " + b" ".join(words[i : i + WINDOW]) + b" " for i in range(0, len(words), WINDOW)]


def trained(samples: list[bytes], size: int, segment: int = 16, head: int = 1024) -> bytes:
    """The last ``size`` bytes, which are the best, of the content of a dictionary trained on ``samples``."""
    filler = np.random.default_rng(0).integers(1, 32, max(64, sum(map(len, samples)) * head // size), np.uint8).tobytes()
    try:
        got = zstandard.train_dictionary(size + head, [filler, *samples], k=segment, d=6).as_bytes()
    except zstandard.ZstdError:  # too little text for the trainer
        return b"".join(samples)[:size]
    return got.rstrip(FILLER)[-size:]


def compressor(content: bytes) -> zstandard.ZstdCompressor:
    """Compressor with a dictionary of this content before the tail."""
    d = zstandard.ZstdCompressionDict(content + GAP + TAIL, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    d.precompute_compress(level=LEVEL)
    return zstandard.ZstdCompressor(level=LEVEL, dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False)


def lengths(c: zstandard.ZstdCompressor, parts: list[bytes]) -> np.ndarray:
    """Compressed length of each part with the tail."""
    out = np.empty(len(parts), np.int32)
    for at in range(0, len(parts), 16384):
        some = [x + TAIL for x in parts[at : at + 16384]]
        out[at : at + len(some)] = [len(x) for x in c.multi_compress_to_buffer(some)]
    return out


def without_copies(docs: list[list[bytes]], hashes: int = 8, same: int = 3) -> list[list[bytes]]:
    """Documents that don't share ``same`` of ``hashes`` least word hashes with one before: a text copied with small
    changes counts once in the statistics."""
    seen: dict[tuple[int, bytes], int] = {}
    out = []
    for d in docs:
        long = [w for w in set(d) if len(w) > 4] or d
        least = [(i, min(zlib.crc32(w, i).to_bytes(4, "big") + w for w in long)) for i in range(hashes)] if long else []
        met = Counter(seen[k] for k in least if k in seen)
        if met and max(met.values()) >= same:
            continue
        for k in least:
            seen.setdefault(k, len(out))
        out.append(d)
    return out


class Model:
    """Two dictionaries and a calibration; sent to executors whole (under a hundred kilobytes)."""

    def __init__(self, toxic: bytes, ordinary: bytes):
        self.toxic, self.ordinary = toxic, ordinary
        self.weights, self.mean, self.scale = np.zeros(1), np.zeros(1), np.ones(1)
        self._pair = None

    def __getstate__(self):
        return {**self.__dict__, "_pair": None}

    def gains(self, parts: list[bytes]) -> np.ndarray:
        """By how many bytes the toxic dictionary compresses each part better."""
        if self._pair is None:
            self._pair = compressor(self.ordinary), compressor(self.toxic)
        a, b = (lengths(c, parts) for c in self._pair)
        return a - b

    def features(self, docs: list[list[bytes]]) -> np.ndarray:
        """One row for each document, from the gains of its windows."""
        parts = [windows(d) for d in docs]
        sizes = np.array([len(p) for p in parts], np.int64)
        of = np.repeat(np.arange(len(docs)), sizes)
        g = self.gains([w for p in parts for w in p])
        wide = GAINS + LOSSES + 1
        counts = np.bincount(of * wide + np.clip(g, -LOSSES, GAINS) + LOSSES, minlength=len(docs) * wide).reshape(len(docs), wide)
        gained = counts[:, :LOSSES:-1].cumsum(axis=1)[:, ::-1]  # windows with a gain of at least 1, 2, ...
        lost = counts[:, :LOSSES].cumsum(axis=1)[:, ::-1]
        best = np.full((len(docs), 2), 0.0)
        order = np.lexsort((-g, of))
        first = np.cumsum(sizes) - sizes
        for k in range(2):
            some = sizes > k
            best[some, k] = g[order[first[some] + k]]
        return np.column_stack([np.log1p(gained), 20 * gained / np.maximum(1, sizes)[:, None], np.log1p(lost), np.log1p(sizes), best])

    def logits(self, x: np.ndarray) -> np.ndarray:
        """Calibrated evidence of feature rows; 0 is the threshold."""
        return np.column_stack([(x - self.mean) / self.scale, np.ones(len(x))]) @ self.weights

    def score(self, docs: list[list[bytes]]) -> np.ndarray:
        """Probability of label 1."""
        return 1 / (1 + np.exp(-np.clip(self.logits(self.features(docs)), -35, 35))) if docs else np.zeros(0)


def dictionaries(toxic: list[list[bytes]], ordinary: list[list[bytes]], size: int = 1024, common_size: int = 16384, uncovered: float = 0.6, rounds: int = 2) -> Model:
    """The pair of dictionaries of two sets of documents."""
    shared = ordinary[: max(1, len(ordinary) // 3)]
    rest = ordinary[len(shared) :] or shared
    common = trained([b" " + b" ".join(d) + b" " for d in shared], common_size)
    bad, good = ({w for d in docs for w in d} for docs in (toxic, ordinary))
    both = [*bad, *good]
    alone = [b" " + w + b" " for w in both]
    c = compressor(common)
    covered = lengths(c, alone) - lengths(c, [b""])[0]
    left = {w for w, x, n in zip(both, covered.tolist(), map(len, alone), strict=True) if n > 5 and x >= uncovered * n}

    def learned(docs: list[list[bytes]], use) -> bytes:
        """A dictionary from each document's words in ``use``, each word once."""
        return trained([b"  " + b"  ".join(ws) + b"  " for d in docs if (ws := [w for w in dict.fromkeys(d) if w in use])], size)

    m = Model(learned(toxic, left - good) + common, learned(rest, left - bad) + common)
    for _ in range(rounds):
        gain = dict(zip(both, m.gains(alone).tolist(), strict=True))
        m = Model(learned(toxic, {w for w in bad - good if gain[w] > 1}) + common, learned(rest, {w for w in good if gain[w] > 0}) + common)
    return m


def calibrate(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1.0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(mean, scale, weights) of a logistic regression whose 0 stands where F1 over the weighted rows is highest."""
    mean, scale = x.mean(0), x.std(0) + 1e-6
    x = np.column_stack([(x - mean) / scale, np.ones(len(x))])
    w = np.zeros(x.shape[1])
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -35, 35)))
        penalty = np.diag([ridge] * (len(w) - 1) + [1e-6])
        w -= np.linalg.solve((x.T * (p * (1 - p))) @ x + penalty, x.T @ (p - y) + penalty @ w)
    logit = x @ w
    order = np.argsort(-logit, kind="stable")
    logit, hit, size = logit[order], (y * weight)[order].cumsum(), weight[order].cumsum()
    f1 = 2 * hit / (size + (y * weight).sum())
    f1[:-1][logit[:-1] == logit[1:]] = -1  # no cut between equal values
    k = int(f1.argmax())
    w[-1] -= (logit[k] + logit[min(k + 1, len(logit) - 1)]) / 2
    return mean, scale, w


def train(toxic: list[str], ordinary: list[str], shares: tuple[int, int] | None = None, folds: int = 5) -> Model | None:
    """Dictionaries from all texts, calibration from features of unseen folds; None without both kinds. ``shares`` are
    the numbers of labels of both kinds that the texts stand for."""
    if len(toxic) < folds or len(ordinary) < folds:
        return None
    once: dict[bytes, bytes] = {}
    t, o = (without_copies([[once.setdefault(w, w) for w in words_of(x)] for x in xs]) for xs in (toxic, ordinary))
    if len(t) < folds or len(o) < folds:
        return None
    shares = shares or (len(t), len(o))
    rows, labels = [], []
    for k in range(folds):
        m = dictionaries([d for i, d in enumerate(t) if i % folds != k], [d for i, d in enumerate(o) if i % folds != k])
        for docs, y in ((t[k::folds], 1.0), (o[k::folds], 0.0)):
            rows.append(m.features(docs))
            labels += [y] * len(docs)
    y = np.array(labels)
    m = dictionaries(t, o)
    m.mean, m.scale, m.weights = calibrate(np.concatenate(rows), y, np.where(y == 1, shares[0] / len(t), shares[1] / len(o)))
    return m


def labelled_sample(docs: DataFrame, labels: DataFrame, toxic_docs: int, ordinary_docs: int, hold_out: int = 5) -> tuple[list[str], list[str], tuple[int, int]]:
    """Texts of at most so many labelled toxic and ordinary documents outside the held-out fold, and how many labels
    of both kinds there are."""
    ids = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
    ids = ids.filter(F.col("toxic").isin(0, 1) & (crc_mod(F.col("doc_id"), hold_out) != 0)).dropDuplicates(["doc_id"])
    shares = {r.toxic: r["count"] for r in ids.groupBy("toxic").count().collect()}
    few = hash_sample(ids.filter("toxic = 1"), "doc_id", toxic_docs).unionAll(hash_sample(ids.filter("toxic = 0"), "doc_id", ordinary_docs))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).filter("text IS NOT NULL")
    # one text for each id, however often it stands in the table
    got = texts.join(F.broadcast(few), "doc_id").groupBy("doc_id", "toxic").agg(F.min("text").alias("text")).collect()
    kinds = [[r.text for r in sorted(got, key=lambda r: r.doc_id) if r.toxic == y] for y in (1, 0)]
    return kinds[0], kinds[1], (shares.get(1, 0), shares.get(0, 0))


def score_documents(docs: DataFrame, labels: DataFrame, toxic_docs: int = 1000, ordinary_docs: int = 3000, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Columns ``keep`` of every row of ``docs``, and its score."""
    toxic, ordinary, shares = labelled_sample(docs, labels, toxic_docs, ordinary_docs)
    share = len(toxic) / max(1, len(toxic) + len(ordinary))
    model = docs.sparkSession.sparkContext.broadcast(train(toxic, ordinary, shares))
    rows = docs.select(*keep, F.coalesce(F.col("text").cast("string"), F.lit("")).alias("_text"))
    schema = rows.drop("_text").schema.add("score", "double")
    at = len(keep)

    def run(batches):
        m = model.value
        for b in batches:
            for part in slices(b, at):
                got = m.score([words_of(t) for t in part.column(at).to_pylist()]) if m else np.full(part.num_rows, share)
                yield pa.RecordBatch.from_arrays([*(part.column(i) for i in range(at)), pa.array(got)], names=schema.names)

    return rows.mapInArrow(run, schema)


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity score of every document."""
    out = score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return out.select("doc_id", (crc_mod(F.col("doc_id"), 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
