"""Graphs as edges (src, dst): degrees, weights, dangling vertices, PageRank, convergence."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def out_degree(edges: DataFrame) -> DataFrame:
    """(src, degree, targets): targets sorted."""
    return edges.groupBy("src").agg(F.count("*").alias("degree"), F.sort_array(F.collect_list("dst")).alias("targets"))


def weighted(edges: DataFrame) -> DataFrame:
    """Adds weight 1 / out-degree of the source."""
    return edges.withColumn("weight", F.lit(1.0) / F.count("*").over(Window.partitionBy("src")))


def dangling(edges: DataFrame, vertices: DataFrame) -> DataFrame:
    """Vertices (v) without an outgoing edge."""
    return vertices.join(edges.select(F.col("src").alias("v")).distinct(), "v", "left_anti")


def is_local(spark: SparkSession) -> bool:
    """Whether driver and executors are one process, so that a temporary folder is seen by all."""
    master = spark.sparkContext.master
    return master == "local" or master.startswith("local[")


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the folder of ``spark.checkpoint.dir`` and cut its lineage."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        folder = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not folder and not is_local(df.sparkSession):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="nearfield-"))
    return df.checkpoint(eager=True)


def pagerank(edges: DataFrame, vertices: DataFrame, alpha: float = 0.85, max_iter: int = 20, max_err: float = 0.0, cut_every: int = 5) -> tuple[DataFrame, int]:
    """(v, rank) and the rounds used. Each round: alpha A r + (1 - alpha) / N + alpha / N times the dangling mass;
    ends when the squared change is at most ``max_err`` (if over 0) or after ``max_iter`` rounds."""
    vertices = cut(vertices.select("v"))
    n = vertices.count()
    edges = cut(edges.select("src", "dst"))  # computed once; weights and dangling vertices both come from here
    w = cut(weighted(edges).repartition("src"))
    loose = cut(dangling(edges, vertices).withColumn("_loose", F.lit(True)))
    r = vertices.select("v", F.lit(1.0 / max(n, 1)).alias("rank"))
    for i in range(1, max_iter + 1):
        mass = r.join(loose, "v").agg(F.coalesce(F.sum("rank"), F.lit(0.0)).alias("_mass"))
        flow = w.join(r, w.src == r.v).groupBy("dst").agg(F.sum(F.col("weight") * F.col("rank")).alias("_in"))
        new = vertices.join(flow, vertices.v == flow.dst, "left").crossJoin(mass)
        new = new.select("v", (F.lit(alpha) * F.coalesce("_in", F.lit(0.0)) + F.lit((1 - alpha) / n) + F.lit(alpha / n) * F.col("_mass")).alias("rank"))
        if i % cut_every == 0 or max_err > 0:
            new = cut(new)
        if max_err > 0:
            err = new.join(r.withColumnRenamed("rank", "_old"), "v").agg(F.sum(F.pow(F.col("rank") - F.col("_old"), 2))).first()[0]
            if err is not None and err <= max_err:
                return new, i
        r = new
    return r, max_iter


def first_converged(errors: DataFrame, bound: float = 1e-5) -> DataFrame:
    """(graph, rounds): mean over vertices of the first iteration whose root error is at most ``bound``, without
    vertices that start there; ``errors`` has (graph, vertex, iteration, error)."""
    first = errors.filter(F.sqrt("error") <= bound).groupBy("graph", "vertex").agg(F.min("iteration").alias("first"))
    return first.filter("first > 0").groupBy("graph").agg(F.avg("first").alias("rounds"))


def error_curve(errors: DataFrame) -> DataFrame:
    """(graph, iteration, log_error): log10 of the median error of each iteration."""
    return errors.groupBy("graph", "iteration").agg(F.log10(F.median("error")).alias("log_error"))
