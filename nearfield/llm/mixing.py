"""Mixing sources to target weights by Sainte-Laguë apportionment of equal-token blocks.

Every source's documents are dealt to shards by a seeded hash; in a (source, shard) the words of its
documents, in seeded order, make one stream that is cut into blocks of ``block_words``. The mix's blocks
go to sources by highest quotients v / (2 s + 1), with v the source's target in blocks, and each source's
blocks go to its shards the same way. A (source, shard) with n blocks and a quota of q takes all of its
blocks q div n times and q mod n more, picked by a seeded systematic draw: block i is drawn where
((i + 1) r + u) div n exceeds (i r + u) div n. The draw is a closed form, so the words taken from a
document are computed in its own row, without making a row for each block.

Only sizes travel: the text is shuffled only if the caller asks for it. A source is cut in shards of about
``shard_docs`` documents by its own number of rows, so one with a third of all rows has the more shards. The driver
holds one row for each source; a source's quota goes to its shards in a task of that source, a row for each shard.

Defined results: null and empty texts have size 0 and give nothing; null is a source of its own, last in
order; repeated rows and ids are separate documents, and ids that are null or repeated are dealt by their texts;
one source has its target held at ``cap`` times its size, and an empty table gives no rows; extra columns are kept,
but those that bear the name of an added one are replaced.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Sequence

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import shared, table


def word_count(c: Column) -> Column:
    """Number of `[^\\x20\\x09-\\x0D]+` in a text; null: 0."""
    return F.coalesce(F.regexp_count(c, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(sizes: Sequence[int], weights: Sequence[float], share: float = 1.5, cap: float = 2.0) -> list[float]:
    """Share ``share`` times all sizes out by weight; a source stops at ``cap`` times its size and what is
    above is shared again by weight among the others until none is above. No size, no target."""
    out, free, left = [0.0] * len(sizes), [i for i, s in enumerate(sizes) if s > 0], share * sum(sizes)
    while free:
        total = sum(weights[i] for i in free)
        over = [i for i in free if left * weights[i] / total >= cap * sizes[i]]
        if not over:
            for i in free:
                out[i] = left * weights[i] / total
            break
        for i in over:
            out[i] = float(cap * sizes[i])
        left -= sum(out[i] for i in over)
        free = [i for i in free if i not in set(over)]
    return out


def sainte_lague(votes: Sequence[float], seats: int, most: Sequence[int] | None = None) -> list[int]:
    """Seats by highest quotients votes / (2 s + 1); ties to the earlier party; none above ``most``.

    Starts from the rounded proportional share, which differs from the result by a few seats, and moves
    single seats between the best and the worst quotients until the sum holds.
    """
    total = sum(votes)
    if total <= 0 or seats <= 0:
        return [0] * len(votes)
    most = most or [seats] * len(votes)
    got = [min(m, int(v * seats / total + 0.5)) for v, m in zip(votes, most, strict=True)]
    given = sum(got)
    up = [(-v / (2 * s + 1), i) for i, (v, s) in enumerate(zip(votes, got, strict=True)) if s < most[i] and v > 0]
    heapq.heapify(up)
    while given < seats and up:
        _, i = heapq.heappop(up)
        got[i] += 1
        given += 1
        if got[i] < most[i]:
            heapq.heappush(up, (-votes[i] / (2 * got[i] + 1), i))
    down = [(votes[i] / (2 * s - 1), -i) for i, s in enumerate(got) if s > 0] if given > seats else []
    heapq.heapify(down)
    while given > seats:
        _, i = heapq.heappop(down)
        got[-i] -= 1
        given -= 1
        if got[-i] > 0:
            heapq.heappush(down, (votes[-i] / (2 * got[-i] - 1), i))
    return got


#: Columns that :func:`mix` adds.
ADDED = ("size", "source_size", "target", "start", "stream", "blocks", "quota", "u", "taken")


def mix(
    docs: DataFrame, weights: Sequence[float] = (3, 1, 2), share: float = 1.5, cap: int = 2, block_words: int = 128,
    shard_docs: int = 1000, seed: int = 17, size: Column | None = None, tie: Column | None = None,
) -> DataFrame:
    """Adds to ``docs``: size, source_size, target, start, stream, blocks, quota, u, taken.

    ``weights`` repeat over the sources in code-point order, null last. start is the document's first
    word in its stream of ``stream`` words; with blocks, quota and u it fixes every block's count (:func:`times`).
    ``size`` and ``tie``, which tells documents of one id apart, come from the text unless they are given.
    """
    spark = docs.sparkSession
    seeded = lambda *c: F.xxhash64(F.lit(seed), *c)
    rows = docs.select(
        *(F.col(f"`{c}`") for c in docs.columns if c not in ADDED),
        F.col("source").cast("string").alias("__source"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")).alias("__id"),
        (word_count(F.col("text")) if size is None else size).alias("__size"), (F.xxhash64(F.col("text")) if tie is None else tie).alias("__tie"),
    )
    narrow = rows.select("__source", "__id", "__size", "__tie")
    narrow = shared(narrow) if size is None else narrow
    found = {r["__source"]: r for r in narrow.groupBy("__source").agg(F.count("*").alias("n"), F.sum("__size").alias("words")).collect()}
    order = sorted(found, key=lambda s: (s is None, s or ""))
    few = F.broadcast if len(order) <= 100_000 else lambda df: df
    names = few(spark.createDataFrame([(i, s, -(-found[s].n // shard_docs)) for i, s in enumerate(order)], "__s int, __name string, __shards long"))

    def dealt(df: DataFrame) -> DataFrame:
        shard = F.pmod(seeded("__id", "__tie"), F.greatest("__shards", F.lit(1)))
        return df.join(names, F.col("__source").eqNullSafe(F.col("__name")), "left").withColumn("__shard", shard)

    cells = shared(dealt(narrow).groupBy("__s", "__shard").agg(F.sum("__size").alias("words")))
    held = cells.withColumn("blocks", F.ceil(F.col("words") / block_words).cast("long"))
    have = {r["__s"]: r.blocks for r in held.groupBy("__s").agg(F.sum("blocks").alias("blocks")).collect()}
    sizes = [found[s].words for s in order]
    goal = targets(sizes, [weights[i % len(weights)] for i in range(len(order))], share, cap)
    votes = [have[i] * g / n if n else 0.0 for i, (g, n) in enumerate(zip(goal, sizes, strict=True))]
    quotas = sainte_lague(votes, round(sum(votes)), [cap * have[i] for i in range(len(order))])
    goals = few(spark.createDataFrame([(i, *x) for i, x in enumerate(zip(sizes, goal, quotas, strict=True))], "__s int, source_size long, target double, whole long"))

    def to_shards(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("__shard")
        n = part["blocks"].tolist()
        return part.assign(quota=sainte_lague(n, int(part["whole"].iloc[0]), [cap * x for x in n]))[["__s", "__shard", "source_size", "target", "stream", "blocks", "quota"]]

    plan = held.withColumnRenamed("words", "stream").join(goals, "__s").groupBy("__s").applyInPandas(to_shards, "__s int, __shard long, source_size long, target double, stream long, blocks long, quota long")
    joined = dealt(rows).join(plan, ["__s", "__shard"], "left")
    # rows of one id and text are alike, so their order does not matter
    line = Window.partitionBy("__s", "__shard").orderBy(seeded("__id", "__tie"), "__id", "__tie", "__size").rowsBetween(Window.unboundedPreceding, -1)
    out = joined.withColumn("size", F.col("__size")).withColumn("start", F.coalesce(F.sum("__size").over(line), F.lit(0)))
    out = out.withColumn("u", F.when(F.col("blocks") > 0, F.pmod(seeded("__s", "__shard", F.lit("draw")), F.col("blocks"))).otherwise(0))
    out = out.withColumn("taken", _taken(block_words))
    return out.select(*(F.col(f"`{c}`") for c in docs.columns if c not in ADDED), *ADDED)


def _taken(block_words: int) -> Column:
    start, end, b = F.col("start"), F.col("start") + F.col("size"), F.lit(block_words)
    n, u = F.greatest(F.col("blocks"), F.lit(1)), F.col("u")
    whole, r = F.floor(F.col("quota") / n), F.pmod("quota", n)

    def drawn(x):  # blocks drawn among the first x
        return F.floor((x * r + u) / n)

    first, last = F.floor(start / b), F.floor((end - 1) / b)
    picked = lambda i: drawn(i + 1) - drawn(i)
    inner = (drawn(last) - drawn(first + 1)) * b
    edges = picked(first) * ((first + 1) * b - start) + picked(last) * (end - last * b)
    extra = F.when(first == last, picked(first) * F.col("size")).otherwise(edges + inner)
    return F.when(F.col("size") > 0, whole * F.col("size") + extra).otherwise(0).cast("long")


def times(block: int, blocks: int, quota: int, u: int) -> int:
    """How often the mix takes a block."""
    r = quota % blocks
    return quota // blocks + ((block + 1) * r + u) // blocks - (block * r + u) // blocks


WORD = re.compile(r"[^\x20\x09-\x0D]+")


def taken_texts(text: str, start: int, block_words: int, blocks: int, quota: int, u: int) -> list[str]:
    """What the mix takes of a text: one text for each pass, the words of the blocks it takes that often.
    Words that stand together keep what stood between them; a gap becomes a line break."""
    spans = [m.span() for m in WORD.finditer(text)]
    if not spans:
        return []
    first, last = start // block_words, (start + len(spans) - 1) // block_words
    counts = [times(b, blocks, quota, u) for b in range(first, last + 1)]
    out = []
    for p in range(1, max(counts) + 1):
        if min(counts) >= p:
            out.append(text)
            continue
        parts, at = [], 0
        while at < len(counts):
            end = at
            while end < len(counts) and counts[end] >= p:
                end += 1
            if end > at:
                lo, hi = max(0, (first + at) * block_words - start), min(len(spans), (first + end) * block_words - start)
                parts.append(text[spans[lo][0] : spans[hi - 1][1]])
            at = max(end, at + 1)
        out.append("\n".join(parts))
    return out


def mixed_documents(docs: DataFrame, keep: tuple[str, ...] = ("doc_id", "lang", "source"), block_words: int = 128, **options) -> DataFrame:
    """The mix itself: rows (``keep``, text), one for each pass over a document that takes some of its words."""
    plan = mix(docs.select(*dict.fromkeys([*keep, "doc_id", "source", "text"])), block_words=block_words, **options)
    rows = plan.filter("taken > 0").select(*keep, F.col("text").cast("string").alias("_text"), "start", "blocks", "quota", F.col("u").cast("long").alias("u"))
    schema = T.StructType(docs.select(*keep).schema.fields + [T.StructField("text", T.StringType())])
    n = len(keep)

    def run(batches):
        for b in batches:
            rest = [b.column(n + i).to_pylist() for i in range(5)]
            got = [taken_texts(t, s, block_words, blocks, q, u) for t, s, blocks, q, u in zip(*rest, strict=True)]
            at = pa.array([i for i, g in enumerate(got) for _ in g], pa.int64())
            yield pa.RecordBatch.from_arrays([*(b.column(i).take(at) for i in range(n)), pa.array([t for g in got for t in g], pa.string())], names=schema.names)

    return rows.mapInArrow(run, schema)


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words the mix takes from every document."""
    sized = shared(table(spark, sf_dir, "documents").select("doc_id", "source", word_count(F.col("text")).alias("size"), F.xxhash64("text").alias("tie")))
    out = mix(sized, size=F.col("size"), tie=F.col("tie"))
    return out.select("doc_id", "size", "source_size", "target", "taken")
