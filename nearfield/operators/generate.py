"""Seeded random matrices, graphs, vectors and parameter grids; all made in parallel by row."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .matrix import normalise, row_l2


def random_matrix(spark: SparkSession, rows: int, cols: int, degree: int, distribution: str = "uniform", seed: int = 1, normalised: bool = True) -> DataFrame:
    """(row, col, val): entries of a row uniform in [degree/2, 1.5 degree] or gamma (shape 3, mean degree, at least 1);
    columns drawn with replacement, values U(0, 1), rows of length 1."""
    base = spark.range(rows).withColumnRenamed("id", "row")
    if distribution == "gamma":
        # a sum of three exponentials is gamma of shape 3
        g = sum((-F.log(1 - F.rand(seed + i)) for i in range(1, 3)), -F.log(1 - F.rand(seed))) * (degree / 3)
        n = F.greatest(F.lit(1), F.floor(g).cast("int"))
    elif distribution == "uniform":
        lo, hi = degree // 2, int(1.5 * degree)
        n = F.lit(lo) + F.floor(F.rand(seed) * (hi - lo + 1)).cast("int")
    else:
        raise ValueError(f"no such distribution: {distribution}")
    cells = base.withColumn("n", n).filter("n > 0").select("row", F.explode(F.sequence(F.lit(1), "n")))
    coo = cells.select("row", F.floor(F.rand(seed + 7) * cols).alias("col"), F.rand(seed + 8).alias("val"))
    return row_l2(coo) if normalised else coo


def parameter_grid(spark: SparkSession, **axes: list) -> DataFrame:
    """All combinations of the given values, a column for each name."""
    out = spark.range(1, numPartitions=1).withColumnRenamed("id", "_id")
    for name, values in axes.items():
        out = out.withColumn(name, F.explode(F.lit(values)))
    return out.drop("_id")


def query_vector(spark: SparkSession, cols: int, seed: int | None = 1, sum_to_one: bool = False, l2: bool = True) -> DataFrame:
    """(col, val): U(0, 1) or, without a seed, ones; normalised."""
    v = spark.range(cols).select(F.col("id").alias("col"), (F.lit(1.0) if seed is None else F.rand(seed)).alias("val"))
    return normalise(v, sum_to_one, l2)


def query_batch(spark: SparkSession, queries: int, cols: int, seed: int = 1) -> DataFrame:
    """(query_id, col, val): one random vector of length 1 for each query."""
    v = spark.range(queries).select(F.col("id").alias("query_id"), F.explode(F.sequence(F.lit(0), F.lit(cols - 1))).alias("col")).withColumn("val", F.rand(seed))
    norm = F.sqrt(F.sum(F.col("val") * F.col("val")).over(Window.partitionBy("query_id")))
    return v.withColumn("val", F.col("val") / norm)


def random_graph(spark: SparkSession, vertices: int, max_degree: int, avoid_loops: bool = True, seed: int = 1) -> DataFrame:
    """(src, dst): each vertex has under min(vertices, max_degree) draws of distinct targets."""
    top = min(vertices, max_degree)
    e = spark.range(vertices).select(F.col("id").alias("src"), F.floor(F.rand(seed) * top).cast("int").alias("n")).filter("n > 0")
    e = e.select("src", F.explode(F.sequence(F.lit(1), "n"))).select("src", F.floor(F.rand(seed + 1) * vertices).alias("dst"))
    return (e.filter("src <> dst") if avoid_loops else e).dropDuplicates()


def random_ints(spark: SparkSession, n: int, bound: int, seed: int = 1) -> DataFrame:
    """(value): n whole numbers under ``bound``."""
    return spark.range(n).select(F.floor(F.rand(seed) * bound).alias("value"))
