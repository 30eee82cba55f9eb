"""License scans by diagonal voting.

Every k-gram of a document's words is hashed (k = 3) and joined in Spark with the hashed k-grams of the
templates; a hit at document word p and template word t votes for the diagonal p - t. Votes are summed by
(document, template, diagonal), diagonals that differ by at most ``slack`` are merged to a run, runs that stand within
a template's length of each other to a candidate span, and spans with enough votes are verified against the words
themselves: a base phrase and a template of under ``SHORT`` words must stand there word by word; any other needs a
longest common subsequence of ``least_match`` of its words, in a stretch of which it is at least ``least_share``. Where
verified spans overlap, only the one most like its stretch keeps its label.

The template table is a fixed list (a few thousand k-grams), so it is broadcast. Candidate spans, a small
table, go back to the documents by a broadcast if their counted bytes are under 8 MB, else by a join.

Defined results: a null text is an empty one, with no words, null positions and empty labels; documents
are told apart by id and a 128-bit digest of the text, so null and repeated ids and repeated rows are kept
(equal rows get equal results); an empty table gives no rows; extra columns are ignored; texts of any
length are scanned whole.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import shared, slices, small, table
from .license_templates import BASE, TEMPLATES

K = 3
SHORT = 20
MULT = np.uint64(0x9E3779B97F4A7C15)
#: words of UTF-8 text in lower case: digits, a-z and every byte of a character beyond ASCII
WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def words_of(text: bytes) -> list[bytes]:
    """Words of UTF-8 text, A-Z lower-cased."""
    return WORD.findall(text.translate(LOWER))


class _Words(dict):
    """Hash of a word, kept for words met often; cleared when full."""

    def __missing__(self, w: bytes) -> int:
        if len(self) > 300_000:
            self.clear()
        h = self[w] = xxhash.xxh3_64_intdigest(w)
        return h


_HASHES = _Words()


def gram_hashes(words: list[bytes], k: int = K) -> np.ndarray:
    """Rolling hash of each k words in a row, as signed longs."""
    n = len(words) - k + 1
    if n < 1:
        return np.array([], np.int64)
    h = np.fromiter(map(_HASHES.__getitem__, words), np.uint64, len(words))
    with np.errstate(over="ignore"):
        out = h[:n].copy()
        for i in range(1, k):
            out = (out ^ (out >> np.uint64(29))) * MULT + h[i : i + n]
        out = (out ^ (out >> np.uint64(32))) * MULT
    return out.view(np.int64)


@lru_cache(1)
def template_list() -> list[tuple[str, bool, list[bytes]]]:
    """(label, is a base phrase, words) of each template, base phrases first."""
    return [(a, True, words_of(p.encode())) for a, p in BASE.items()] + [(a, False, words_of(t.encode())) for a, ts in TEMPLATES.items() for t in ts]


def key_of(doc_id: Column, text: Column) -> list[Column]:
    """Columns that tell documents apart for the join of spans."""
    return [doc_id.cast("long").alias("doc_id"), F.xxhash64(text).alias("k1"), F.xxhash64(F.lit("b"), text, F.length(text)).alias("k2")]


def gram_rows(docs: DataFrame, k: int = K) -> DataFrame:
    """(doc_id, k1, k2, pos, h): the hash of every word k-gram; repeated rows stay once each."""

    def run(batches):
        for b in batches:
            for part in slices(b, 3):
                hs = [gram_hashes(words_of(t or b""), k) for t in part.column(3).to_pylist()]
                lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, hs)]), pa.int32()), pa.array(np.concatenate(hs)))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), part.column(2), lists], names=["doc_id", "k1", "k2", "hs"])

    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(*key_of(F.col("doc_id"), text), text.cast("binary").alias("b"))
    return rows.mapInArrow(run, "doc_id long, k1 long, k2 long, hs array<long>").select("doc_id", "k1", "k2", F.posexplode("hs").alias("pos", "h"))


def candidate_spans(docs: DataFrame, slack: int = 3, least_votes: float = 0.3) -> DataFrame:
    """(doc_id, k1, k2, tpl, first, last): spans of document words that enough diagonal votes point to."""
    spark = docs.sparkSession
    tpl = [(i, int(p), int(h), base, max(1, len(w) - K + 1)) for i, (_, base, w) in enumerate(template_list()) for p, h in enumerate(gram_hashes(w))]
    tpl_df = F.broadcast(spark.createDataFrame(tpl, "tpl int, t int, h long, base boolean, grams int"))
    hits = gram_rows(docs).join(tpl_df, "h").withColumn("diag", F.col("pos") - F.col("t"))
    # a repeated row votes twice at the same places; distinct template places count once
    votes = hits.groupBy("doc_id", "k1", "k2", "tpl", "diag").agg(F.countDistinct("t").alias("votes"), F.min("pos").alias("lo"), F.max("pos").alias("hi"), F.first("base").alias("base"), F.first("grams").alias("grams"))
    line = Window.partitionBy("doc_id", "k1", "k2", "tpl").orderBy("diag")
    fresh = F.col("base") | F.coalesce(F.col("diag") - F.lag("diag").over(line) > slack, F.lit(True))
    runs = votes.withColumn("fresh", fresh.cast("int")).withColumn("run", F.sum("fresh").over(line))
    runs = runs.groupBy("doc_id", "k1", "k2", "tpl", "run").agg(F.sum("votes").alias("votes"), F.min("lo").alias("first"), F.max("hi").alias("last"), F.first("base").alias("base"), F.first("grams").alias("grams"))
    # text put in between the lines of a license parts its diagonal; what stands near together is one candidate
    along = Window.partitionBy("doc_id", "k1", "k2", "tpl").orderBy("first", "run")
    reach = F.max("last").over(along.rowsBetween(Window.unboundedPreceding, -1)) + F.col("grams")
    apart = F.col("base") | F.coalesce(F.col("first") > reach, F.lit(True))
    spans = runs.withColumn("apart", apart.cast("int")).withColumn("span", F.sum("apart").over(along))
    spans = spans.groupBy("doc_id", "k1", "k2", "tpl", "span").agg(F.sum("votes").alias("votes"), F.min("first").alias("first"), F.max("last").alias("last"), F.first("base").alias("base"), F.first("grams").alias("grams"))
    enough = F.when(F.col("base"), F.col("votes") == F.col("grams")).otherwise(F.col("votes") >= F.greatest(F.lit(1.0), least_votes * F.col("grams")))
    return spans.filter(enough).select("doc_id", "k1", "k2", F.struct("tpl", F.col("first").cast("int").alias("first"), F.col("last").cast("int").alias("last")).alias("span"))


def common_words(a: list[bytes], b: list[bytes]) -> int:
    """Length of the longest common subsequence, by bit-parallel rows (one big integer)."""
    where: dict[bytes, int] = {}
    for i, w in enumerate(b):
        where[w] = where.get(w, 0) | 1 << i
    full, row = (1 << len(b)) - 1, (1 << len(b)) - 1
    for w in a:
        m = where.get(w)
        if m is not None:
            x = row & m
            row = ((row + x) | (row - x)) & full
    return len(b) - row.bit_count()


def stretch(words: list[bytes], tpl: list[bytes]) -> tuple[int, int, int]:
    """(length of the longest common subsequence, first word, end) of the shortest stretch found that has it whole."""
    most = common_words(words, tpl)
    lo, hi = 0, len(words)  # the last start, then the first end, that leave it whole
    a, z = 0, len(words)
    while a < z:
        mid = (a + z + 1) // 2
        a, z = (mid, z) if common_words(words[mid:], tpl) == most else (a, mid - 1)
    lo = a
    a, z = lo, len(words)
    while a < z:
        mid = (a + z) // 2
        a, z = (a, mid) if common_words(words[lo:mid], tpl) == most else (mid + 1, z)
    return most, lo, a


def verify(words: list[bytes], spans: list[dict], least_match: float, least_share: float = 0.6) -> tuple[list[int], set[str], set[str], float]:
    """Places of base phrases, base labels, all labels and the best match among verified spans."""
    places, base_labels, labels, best = [], set(), set(), 0.0
    found = []
    for s in spans:
        label, base, tpl = template_list()[s["tpl"]]
        if base:
            if words[s["first"] : s["first"] + len(tpl)] == tpl:
                places.append(s["first"])
                base_labels.add(label)
                labels.add(label)
                best = 1.0
            continue
        lo = max(0, s["first"] - len(tpl))
        near = words[lo : s["last"] + K + len(tpl)]
        if len(tpl) < SHORT:
            found += [(1.0, 1.0, lo + i, lo + i + len(tpl), label) for i in range(len(near) - len(tpl) + 1) if near[i : i + len(tpl)] == tpl]
            continue
        match, a, z = stretch(near, tpl)
        alike = 2 * match / (len(tpl) + z - a)
        if match >= least_match * len(tpl) and alike >= least_share:
            found.append((alike, match / len(tpl), lo + a, lo + z, label))
    starts, ends = [], []  # of the spans taken, in order; none overlaps another
    for _, match, a, z, label in sorted(found, key=lambda f: (-f[0], -(f[3] - f[2]), f[2:])):
        i = bisect_left(starts, a)
        if (i == len(starts) or z <= starts[i]) and (i == 0 or ends[i - 1] <= a):
            starts.insert(i, a)
            ends.insert(i, z)
            labels.add(label)
            best = max(best, match)
    return places, base_labels, labels, best


def scan(docs: DataFrame, least_match: float = 0.8) -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score) of every document."""
    spans = shared(candidate_spans(docs).groupBy("doc_id", "k1", "k2").agg(F.sort_array(F.collect_list("span")).alias("spans")))
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(*key_of(F.col("doc_id"), text), text.cast("binary").alias("b"))
    s = small(spans, 64 + 16 * F.size("spans")).toDF("s_id", "s1", "s2", "spans")
    joined = rows.join(s, F.col("doc_id").eqNullSafe(F.col("s_id")) & (F.col("k1") == F.col("s1")) & (F.col("k2") == F.col("s2")), "left").select("doc_id", "b", "spans")

    def run(batches):
        for b in batches:
            for part in slices(b, 1):
                out = []
                for t, found in zip(part.column(1).to_pylist(), part.column(2).to_pylist(), strict=True):
                    words = words_of(t)
                    places, base, labels, best = verify(words, found or [], least_match)
                    out.append((len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(base)), ",".join(sorted(labels)), best))
                cols = list(zip(*out, strict=True))
                kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64()]
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], names=names)

    names = ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]
    return joined.mapInArrow(run, "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double")


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License phrases and labels of every document."""
    return scan(table(spark, sf_dir, "documents"))
