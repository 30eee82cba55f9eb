"""Products of a sparse matrix with dense vectors, as join and aggregation.

The vector side joins by column; adaptive execution broadcasts it when its measured size allows and
shuffles otherwise. Products are summed by row before the shuffle and after it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import fixed_product, quantise
from .matrix import num_rows


def spmv(coo: DataFrame, vec: DataFrame) -> DataFrame:
    """(row, score) of every row with an entry that meets the vector (col, val)."""
    q = vec.select("col", F.col("val").alias("_q"))
    return coo.join(q, "col").groupBy("row").agg(F.sum(F.col("val") * F.col("_q")).alias("score"))


def spmv_full(coo: DataFrame, vec: DataFrame, rows: int | None = None) -> DataFrame:
    """(row, score) of every row, 0 for those without entries."""
    n = num_rows(coo) if rows is None else rows
    every = coo.sparkSession.range(n).withColumnRenamed("id", "row")
    return every.join(spmv(coo, vec), "row", "left").select("row", F.coalesce("score", F.lit(0.0)).alias("score"))


def multi_spmv(coo: DataFrame, queries: DataFrame) -> DataFrame:
    """(query_id, row, score) for vectors (query_id, col, val)."""
    q = queries.select("query_id", "col", F.col("val").alias("_q"))
    return coo.join(q, "col").groupBy("query_id", "row").agg(F.sum(F.col("val") * F.col("_q")).alias("score"))


def spmv_fixed(coo: DataFrame, vec: DataFrame, width: int = 32) -> DataFrame:
    """(row, score BIGINT) in fixed point: each product truncated, then summed exactly."""
    q = vec.select("col", quantise(F.col("val"), width).alias("_q"))
    return coo.join(q, "col").groupBy("row").agg(F.sum(fixed_product(quantise(F.col("val"), width), F.col("_q"), width)).alias("score"))


def spmv_dense(vectors: DataFrame, query: list[float], vec_col: str = "embedding", id_col: str = "vec_id") -> DataFrame:
    """(row, score) for rows held as arrays: no join and no shuffle."""
    q = F.lit([float(x) for x in query])
    return vectors.select(F.col(id_col).alias("row"), F.aggregate(F.zip_with(F.col(vec_col), q, lambda a, b: a.cast("double") * b), F.lit(0.0), lambda s, x: s + x).alias("score"))


def axpb(vec: DataFrame, a: float, b: float) -> DataFrame:
    """a x + b."""
    return vec.select("col", (F.lit(a) * F.col("val") + F.lit(b)).alias("val"))


def dot(x: DataFrame, y: DataFrame) -> DataFrame:
    """(dot) of two vectors (col, val)."""
    return x.join(y.select("col", F.col("val").alias("_y")), "col").agg(F.coalesce(F.sum(F.col("val") * F.col("_y")), F.lit(0.0)).alias("dot"))


def squared_distance(x: DataFrame, y: DataFrame) -> DataFrame:
    """(dist): squared Euclidean distance of two vectors; missing positions are 0."""
    j = x.select("col", F.col("val").alias("_x")).join(y.select("col", F.col("val").alias("_y")), "col", "full")
    d = F.coalesce("_x", F.lit(0.0)) - F.coalesce("_y", F.lit(0.0))
    return j.agg(F.coalesce(F.sum(d * d), F.lit(0.0)).alias("dist"))
