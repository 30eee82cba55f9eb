"""Homomorphic multiset fingerprints of documents, in Spark expressions only.

A text's paragraphs are its lines, a line of several sentences being cut behind each. Each paragraph
hashes to a wide vector and a text's fingerprint is the sum over its paragraphs: ``HASHES`` x 2 lanes of
32 bits modulo 2^32 decide equality, and ``SIGNS`` longs of two 31-bit counters count set hash bits,
from which the likeness of two multisets is estimated (cosine of the +-1 sums, standard error
1/sqrt(192), about 0.07). Order does not matter, and a paragraph is inserted or deleted by adding or
subtracting its vector (:func:`combine`), without the rest of the text. Each of the ``HASHES`` hashes is seeded by
its number before it reads the paragraph, so that paragraphs that agree in one do not agree in the others.

Defined results: a null text is an empty one, whose fingerprint is the zero vector; likeness of two
equal fingerprints is 1, of an empty and another text 0; rows with a null id have no next document (an
empty text stands for it); equal ids order by text; a single document is its own next; an empty table
gives no rows; extra columns are ignored. The counters hold 2^31 paragraphs, more than a text can have.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table

HASHES = 4
SIGNS = 96
LANE, SPREAD, KEEP = 31, 1 | 1 << 30, 1 | 1 << 31
LOW32 = (1 << 32) - 1


def paragraphs(text: Column) -> Column:
    """Array of a text's paragraphs."""
    return F.filter(F.split(text, r"[\n\r]+|(?<=[.!?]) +"), lambda p: p != "")


def _sum(xs: Column, term) -> Column:
    return F.aggregate(xs, F.lit(0).cast("long"), lambda a, x: a + term(x))


def vector(hashes: Column) -> Column:
    """struct<n, wide array<long>, signs array<long>> from an array of structs h0..h3 (longs)."""
    h = [f"h{i}" for i in range(HASHES)]
    wide = [_sum(hashes, lambda x, k=k, s=s: F.shiftrightunsigned(x[k], s).bitwiseAND(F.lit(LOW32))).bitwiseAND(F.lit(LOW32)) for k in h for s in (0, 32)]
    # two hash bits at a time, one to each 31-bit counter
    signs = [_sum(hashes, lambda x, k=k, s=s: (F.shiftrightunsigned(x[k], s).bitwiseAND(F.lit(3)) * F.lit(SPREAD)).bitwiseAND(F.lit(KEEP))) for k in h for s in range(0, 48, 2)]
    return F.struct(F.size(hashes).cast("long").alias("n"), F.array(*wide).alias("wide"), F.array(*signs).alias("signs"))


def hash_paragraphs(text: Column) -> Column:
    """Array of hash structs, input of :func:`vector`."""
    return F.transform(paragraphs(text), lambda p: F.struct(*(F.xxhash64(F.lit(i), p).alias(f"h{i}") for i in range(HASHES))))


def with_vector(df: DataFrame, text: str, out: str) -> DataFrame:
    """Adds the fingerprint vector of a text column; the hashes are made once in a step of their own."""
    return df.withColumn("_h", hash_paragraphs(F.col(text))).withColumn(out, vector(F.col("_h"))).drop("_h")


def combine(a: Column, b: Column, sign: int = 1) -> Column:
    """Vector of the multiset sum (sign 1: insertion) or difference (sign -1: deletion)."""
    return F.struct(
        (a["n"] + sign * b["n"]).alias("n"),
        F.zip_with(a["wide"], b["wide"], lambda x, y: F.pmod(x + sign * y, F.lit(1 << 32))).alias("wide"),
        F.zip_with(a["signs"], b["signs"], lambda x, y: x + sign * y).alias("signs"),
    )


def digest(v: Column) -> Column:
    """The vector as a string: 8 hex digits for each wide lane, 16 for each two counters."""
    wide = F.transform(v["wide"], lambda x: F.lpad(F.hex(x), 8, "0"))
    return F.lower(F.concat(F.array_join(wide, ""), F.array_join(F.transform(v["signs"], lambda x: F.lpad(F.hex(x), 16, "0")), "")))


def likeness(a: Column, b: Column) -> Column:
    """Estimated cosine of two paragraph multisets, from 0 to 1; 1 if the wide lanes are equal."""

    def dot(x, y):
        part = lambda v, i: F.shiftrightunsigned(v, LANE * i).bitwiseAND(F.lit((1 << LANE) - 1)).cast("double")
        terms = F.zip_with(x["signs"], y["signs"], lambda p, q: sum(((2 * part(p, i) - x["n"]) * (2 * part(q, i) - y["n"]) for i in range(2)), F.lit(0.0)))
        return F.aggregate(terms, F.lit(0.0), lambda s, t: s + t)

    size = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    cos = F.when(size > 0, F.least(F.lit(1.0), F.greatest(F.lit(0.0), dot(a, b) / F.greatest(size, F.lit(1e-9))))).otherwise(0.0)
    return F.when((a["n"] == b["n"]) & (a["wide"] == b["wide"]), F.lit(1.0)).otherwise(cos)


def with_next(docs: DataFrame, run_rows: int = 2048, max_runs: int = 1 << 16) -> DataFrame:
    """(doc_id, text, vec, next_text, next_vec): each document and the next by ascending id, cyclic.

    Ids are cut at approximate quantiles into runs of about ``run_rows``, a run is a window partition, and
    the first document of a run is also sent to the end of the run before. So the text is shuffled once
    and no task sees more than its runs. ``max_runs`` bounds the cut points held by the plan; beyond
    run_rows x max_runs documents the runs grow and spill.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    n, low = docs.agg(F.count("doc_id"), F.min("doc_id")).first()
    runs = max(1, min(max_runs, -(-n // run_rows)))
    cuts: list[int] = []
    if runs > 1:
        got = docs.agg(F.percentile_approx("doc_id", [i / runs for i in range(1, runs)], max(10_000, 4 * runs))).first()[0]
        cuts = sorted({c for c in got if c > low})
    bounds = F.array(*(F.lit(c).cast("long") for c in cuts)).cast("array<long>")
    steps = [1 << i for i in reversed(range(len(cuts).bit_length()))]
    run = F.lit(0)
    if cuts:
        # number of cuts up to the id, by bisection
        run = F.aggregate(F.array(*map(F.lit, steps)), F.lit(0), lambda p, s: F.when(F.get(F.lit(cuts).cast("array<long>"), p + s - 1) <= F.col("doc_id"), p + s).otherwise(p))
    put = lambda b, kind: F.array(F.struct(b.cast("int").alias("run"), F.lit(kind).alias("kind")))
    none = F.array().cast("array<struct<run:int,kind:int>>")
    is_cut = (run > 0) & (F.get(bounds, run - 1) == F.col("doc_id")) if cuts else F.lit(False)
    places = F.concat(put(run, 0), F.when(is_cut, put(run - 1, 1)).otherwise(none), F.when(F.col("doc_id") == F.lit(low), put(F.lit(len(cuts)), 2)).otherwise(none))
    alone = put(-1 - F.pmod(F.xxhash64("text"), F.lit(64)), 0)
    dealt = docs.select("doc_id", "text", F.inline(F.when(F.col("doc_id").isNull(), alone).otherwise(places)))
    line = Window.partitionBy("run").orderBy(F.col("kind") == 2, "doc_id", "text")
    out = with_vector(dealt, "text", "vec")
    out = out.withColumn("next_text", F.lead("text").over(line)).withColumn("next_vec", F.lead("vec").over(line)).filter("kind = 0")
    empty = vector(F.array().cast("array<struct<h0:long,h1:long,h2:long,h3:long>>"))
    return out.select(
        "doc_id", "text", "vec",
        F.when(F.col("doc_id").isNull(), "").otherwise(F.coalesce("next_text", F.lit(""))).alias("next_text"),
        F.when(F.col("doc_id").isNull(), empty).otherwise(F.coalesce("next_vec", empty)).alias("next_vec"),
    )


def fingerprint_documents(docs: DataFrame, text: str = "text", out: str = "fingerprint") -> DataFrame:
    """Adds the fingerprint string of a text column to ``docs``."""
    return with_vector(docs.withColumn("_t", F.coalesce(F.col(text).cast("string"), F.lit(""))), "_t", "_v").withColumn(out, digest(F.col("_v"))).drop("_t", "_v")


def op2_multiset_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document and of its half-replaced text, and their likeness."""
    rows = with_next(table(spark, sf_dir, "documents"))
    n = F.length("text").cast("long")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), (n - half).cast("int")), F.substring("next_text", F.lit(1), half))
    rows = with_vector(rows.withColumn("edited", edited), "edited", "edited_vec")
    return rows.select(
        "doc_id", n.alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"), digest(F.col("vec")).alias("fingerprint"), digest(F.col("edited_vec")).alias("edited_fingerprint"),
        likeness(F.col("vec"), F.col("edited_vec")).alias("near_edited"), likeness(F.col("vec"), F.col("next_vec")).alias("near_next"),
    )
