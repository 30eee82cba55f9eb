"""Top-k of scores (row, score): exact, in partitions and lanes; order is score, then row, both descending."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .graph import cut
from .matrix import packet_segments, with_part


def ranked(df: DataFrame, k: int | None = None) -> DataFrame:
    """All rows, or the first k, in descending order."""
    out = df.orderBy(F.desc("score"), F.desc("row"))
    return out if k is None else out.limit(k)


def topk(scores: DataFrame, k: int, mode: str = "all", threshold: float | None = None) -> DataFrame:
    """The k best rows. Modes: all; nonnegative (scores under 0 never enter); positive (scores over ``threshold`` or 0)."""
    if mode == "nonnegative":
        scores = scores.filter("score >= 0")
    elif mode == "positive":
        scores = scores.filter(F.col("score") > (threshold or 0.0))
    return ranked(scores, k)


def padded(top: DataFrame, k: int) -> DataFrame:
    """Filled up to k rows with (0, 0.0)."""
    missing = top.agg((F.lit(k) - F.count("*")).alias("m")).select(F.explode(F.when(F.col("m") > 0, F.sequence(F.lit(1), F.col("m").cast("int"))).otherwise(F.array().cast("array<int>"))))
    return top.select("row", "score").unionAll(missing.select(F.lit(0).cast("long"), F.lit(0).cast(top.schema["score"].dataType)))


def per_row_topk(scores: DataFrame, k: int, by: str | list[str]) -> DataFrame:
    """The k best rows in each group of ``by``, with rank; Spark limits groups before the shuffle."""
    w = Window.partitionBy(by).orderBy(F.desc("score"), F.desc("row"))
    return scores.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def topk_partitioned(scores: DataFrame, rows: int, parts: int, keep: int, k: int) -> DataFrame:
    """Approximate top-k: the ``keep`` best of each contiguous part, merged; only positive scores."""
    few = per_row_topk(with_part(scores.filter("score > 0"), rows, parts), keep, "part")
    return ranked(few.select("row", "score"), k)


def topk_lanes(coo: DataFrame, scores: DataFrame, rows: int, parts: int, packet: int, lanes: int, keep: int, k: int) -> DataFrame:
    """As :func:`topk_partitioned`, the part cut into lanes: the j-th row that ends in a packet goes to lane j,
    rows beyond the last lane are lost, as in the design this simulates."""
    seg = packet_segments(coo, parts, packet, rows)
    last = seg.groupBy("part", "row").agg(F.max("packet").alias("packet"))
    lane = last.withColumn("lane", F.row_number().over(Window.partitionBy("part", "packet").orderBy("row")) - 1).filter(F.col("lane") < lanes)
    few = scores.filter("score > 0").join(lane.select("row", F.concat_ws("/", "part", "lane").alias("cell")), "row")
    return ranked(per_row_topk(few, keep, "cell").select("row", "score"), k)


def with_rank(df: DataFrame, by: str | None = None) -> DataFrame:
    """Adds rank from 1; for short lists such as results of a top-k."""
    w = (Window.partitionBy(by) if by else Window.partitionBy(F.lit(0))).orderBy(F.desc("score"), F.desc("row"))
    return df.withColumn("rank", F.row_number().over(w))


def rank_all(df: DataFrame) -> DataFrame:
    """Adds rank from 1 to any number of rows: sorted by ranges, numbered in each range, and moved on by the sizes of
    the ranges before, a row for each partition."""
    line = F.monotonically_increasing_id()
    parts = cut(df.repartitionByRange(F.desc("score"), F.desc("row")).sortWithinPartitions(F.desc("score"), F.desc("row")).withColumn("_line", line))
    place = F.shiftright("_line", 33)
    sizes = parts.groupBy(place.alias("_part")).agg(F.count("*").alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    numbered = parts.withColumn("_part", place).join(F.broadcast(sizes), "_part")
    return numbered.withColumn("rank", F.col("_before") + F.col("_line").bitwiseAND(F.lit((1 << 33) - 1)) + 1).drop("_part", "_line", "_before")


def size_check(top: DataFrame, k: int) -> DataFrame:
    """(used, missing): min(k, results) and how many results are missing."""
    return top.agg(F.least(F.lit(k).cast("long"), F.count("*")).alias("used"), F.greatest(F.lit(0).cast("long"), F.lit(k) - F.count("*")).alias("missing"))
