"""Sparse matrices as DataFrames (row BIGINT, col, val DOUBLE): order, symmetry, layout, norms."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

COO = ("row", "col", "val")


def num_rows(coo: DataFrame) -> int:
    """Rows as inferred from the largest index."""
    top = coo.agg(F.max("row")).first()[0]
    return 0 if top is None else int(top) + 1


def sort_coo(coo: DataFrame) -> DataFrame:
    """By row, then column."""
    return coo.orderBy("row", "col")


def undirect(coo: DataFrame) -> DataFrame:
    """Every entry off the diagonal also mirrored; repeats stay."""
    return coo.select(*COO).unionAll(coo.filter("row <> col").select(F.col("col").alias("row"), F.col("row").alias("col"), "val"))


def undirect_simple(coo: DataFrame) -> DataFrame:
    """Mirrored, without loops, each coordinate once (least value)."""
    return simple(undirect(coo))


def simple(coo: DataFrame) -> DataFrame:
    """Without loops, each coordinate once (least value)."""
    return coo.filter("row <> col").groupBy("row", "col").agg(F.min("val").alias("val"))


def transpose(coo: DataFrame) -> DataFrame:
    """Rows and columns swapped."""
    return coo.select(F.col("col").alias("row"), F.col("row").alias("col"), "val")


def csr(coo: DataFrame) -> DataFrame:
    """(row, entries array<struct<col, val>>), entries in column order."""
    return coo.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("col", "val"))).alias("entries"))


def csc(coo: DataFrame) -> DataFrame:
    """Column-grouped layout: :func:`csr` of the transpose."""
    return csr(transpose(coo))


def running_sum(df: DataFrame, key: str, value: str, out: str, bucket: int = 1 << 16) -> DataFrame:
    """Exclusive running sum of ``value`` in the order of a non-negative integer ``key``.

    Two levels: sums of ranges of ``bucket`` keys, whose own running sum is over a small table, and the
    running sum inside a range; no window over all rows.
    """
    b = df.withColumn("_b", F.expr(f"`{key}` div {bucket}"))
    sums = b.groupBy("_b").agg(F.sum(value).alias("_s"))
    before = Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("_o", F.coalesce(F.sum("_s").over(before), F.lit(0))).drop("_s")
    inner = Window.partitionBy("_b").orderBy(key).rowsBetween(Window.unboundedPreceding, -1)
    return b.join(sums, "_b").withColumn(out, F.col("_o") + F.coalesce(F.sum(value).over(inner), F.lit(0))).drop("_b", "_o")


def csr_pointers(coo: DataFrame, rows: int | None = None) -> DataFrame:
    """(row, degree, ptr) for every row, also empty ones; ptr is the first entry's position."""
    n = num_rows(coo) if rows is None else rows
    deg = coo.groupBy("row").agg(F.count("*").alias("degree"))
    every = coo.sparkSession.range(n).withColumnRenamed("id", "row").join(deg, "row", "left").withColumn("degree", F.coalesce("degree", F.lit(0)))
    return running_sum(every, "row", "degree", "ptr")


def pad_rows(coo: DataFrame, rows: int | None = None) -> DataFrame:
    """A zero on the diagonal of every empty row."""
    n = num_rows(coo) if rows is None else rows
    empty = coo.sparkSession.range(n).withColumnRenamed("id", "row").join(coo.select("row").distinct(), "row", "left_anti")
    return coo.select(*COO).unionAll(empty.select("row", F.col("row").cast(coo.schema["col"].dataType), F.lit(0.0)))


def with_part(df: DataFrame, rows: int, parts: int) -> DataFrame:
    """Adds part: the contiguous range of rows a row belongs to."""
    return df.withColumn("part", F.expr(f"row div {max(1, math.ceil(rows / parts))}"))


def partition_stats(coo: DataFrame, parts: int, packet: int, rows: int | None = None) -> DataFrame:
    """Entries, first and last row and packets of every non-empty part."""
    n = num_rows(coo) if rows is None else rows
    return with_part(coo, n, parts).groupBy("part").agg(
        F.count("*").alias("nnz"), F.min("row").alias("first_row"), F.max("row").alias("last_row"), F.ceil(F.count("*") / packet).cast("long").alias("packets"),
    )


def packet_segments(coo: DataFrame, parts: int, packet: int, rows: int | None = None) -> DataFrame:
    """(part, packet, row, entries, upto, starts): runs of a row inside packets of ``packet`` entries.

    upto counts the packet's entries up to and with this run; starts tells whether the row begins here.
    """
    n = num_rows(coo) if rows is None else rows
    # a row's place in its part follows from the degrees before it; no window goes over a part's entries
    degrees = with_part(running_sum(coo.groupBy("row").agg(F.count("*").alias("degree")), "row", "degree", "ptr"), n, parts)
    first = degrees.groupBy("part").agg(F.min("ptr").alias("_first"))
    at = degrees.join(first, "part").withColumn("_from", F.col("ptr") - F.col("_first")).withColumn("_to", F.col("_from") + F.col("degree"))
    p = F.lit(packet)
    runs = at.select("part", "row", "_from", "_to", F.explode(F.sequence(F.floor(F.col("_from") / p), F.floor((F.col("_to") - 1) / p))).alias("packet"))
    begin = F.col("packet") * p
    upto = F.least(F.col("_to"), begin + p) - begin
    return runs.select("part", "packet", "row", (upto - F.greatest(F.col("_from") - begin, F.lit(0))).alias("entries"), upto.alias("upto"), (begin <= F.col("_from")).alias("starts"))


def ones(coo: DataFrame) -> DataFrame:
    """All values 1."""
    return coo.select("row", "col", F.lit(1.0).alias("val"))


def row_l2(coo: DataFrame) -> DataFrame:
    """Rows of length 1; rows of zeros stay."""
    norm = F.sqrt(F.sum(F.col("val") * F.col("val")).over(Window.partitionBy("row")))
    return coo.select("row", "col", F.when(norm > 0, F.col("val") / F.greatest(norm, F.lit(1e-300))).otherwise(F.col("val")).alias("val"))


def _with_total(vec: DataFrame, total) -> DataFrame:
    return vec.crossJoin(vec.agg(total.alias("_t")))  # one row


def center(vec: DataFrame) -> DataFrame:
    """Vector (col, val) minus its mean."""
    return _with_total(vec, F.avg("val")).select("col", (F.col("val") - F.col("_t")).alias("val"))


def normalise(vec: DataFrame, sum_to_one: bool = False, l2: bool = True) -> DataFrame:
    """Vector (col, val) with sum 1 or else with length 1; the sum goes first if both are asked for."""
    if not (sum_to_one or l2):
        return vec.select("col", "val")
    total = F.sum("val") if sum_to_one else F.sqrt(F.sum(F.col("val") * F.col("val")))
    return _with_total(vec, total).select("col", (F.col("val") / F.col("_t")).alias("val"))


def count_differences(a: DataFrame, b: DataFrame, key: str, tol: float) -> DataFrame:
    """(errors): positions whose values differ by more than ``tol``; a missing value counts as 0."""
    j = a.select(key, F.col("val").alias("x")).join(b.select(key, F.col("val").alias("y")), key, "full")
    d = F.abs(F.coalesce("x", F.lit(0.0)) - F.coalesce("y", F.lit(0.0)))
    return j.agg(F.coalesce(F.sum((d > tol).cast("long")), F.lit(0)).alias("errors"))


def all_below(df: DataFrame, value: str, threshold: float) -> DataFrame:
    """(ok): whether every value is at most ``threshold``; true for none."""
    return df.agg(F.coalesce(F.every(F.col(value) <= threshold), F.lit(True)).alias("ok"))
