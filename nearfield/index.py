"""A matrix kept ready for many queries."""

from __future__ import annotations

import time

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.columns import half
from .functions.params import Params
from .operators import generate, matrix, spmv, topk
from .sources import mtx


class SimilarityIndex:
    """Set up once (values ignored or kept, quantised or not), then searched with vectors or batches of vectors."""

    def __init__(self, coo: DataFrame, params: Params | None = None):
        self.params = params or Params()
        began = time.perf_counter()
        coo = matrix.ones(coo) if self.params.ignore_values else coo.select(*matrix.COO)
        coo = coo.withColumn("val", half(F.col("val"))) if self.params.half else coo
        self.coo = coo.persist(StorageLevel.MEMORY_AND_DISK)
        self.rows = matrix.num_rows(self.coo)
        self.times = {"setup": time.perf_counter() - began}
        self.query: DataFrame | None = None
        self.result: DataFrame | None = None

    @classmethod
    def load(cls, spark: SparkSession, params: Params) -> SimilarityIndex:
        """The index of ``params.matrix``, a Matrix-Market file, or without one of a random matrix."""
        if params.matrix:
            coo = mtx.read_mtx(spark, params.matrix, params.zero_indexed, not params.ignore_values)
        else:
            coo = generate.random_matrix(spark, 1000 if params.use_sample else 100_000, 1024, 20, "uniform")
        return cls(coo, params)

    def reset(self, query: DataFrame) -> None:
        """A new query vector (col, val); what the last one found is dropped."""
        self.query = query.select("col", "val").persist(StorageLevel.MEMORY_AND_DISK)
        self.result = None

    def run(self) -> None:
        """Search with the query set; waits for the result, which stays on the executors. ``times`` has the seconds."""
        began = time.perf_counter()
        found = self.search(self.query) if self.params.impl == "exact" else self.search_approximate(self.query)
        self.result = found.persist(StorageLevel.MEMORY_AND_DISK)
        self.result.count()
        self.times["exec"] = time.perf_counter() - began

    def read_result(self) -> list[tuple[int, float]]:
        """The k results of the last run, best first."""
        began = time.perf_counter()
        got = [(r["row"], float(r["score"])) for r in topk.ranked(self.result).collect()]
        self.times["readback"] = time.perf_counter() - began
        return got

    def scores(self, query: DataFrame) -> DataFrame:
        """(row, score) for a vector (col, val)."""
        return spmv.spmv(self.coo, query)

    def search(self, query: DataFrame, k: int | None = None, mode: str = "all") -> DataFrame:
        """Exact top-k."""
        return topk.topk(self.scores(query), k or self.params.k, mode)

    def search_approximate(self, query: DataFrame, k: int | None = None) -> DataFrame:
        """Top-k of fixed-point scores from the best few of every part."""
        p = self.params
        s = spmv.spmv_fixed(self.coo, query, p.width)
        return topk.topk_partitioned(s, self.rows, p.parts, p.keep, k or p.k)

    def search_batch(self, queries: DataFrame, k: int | None = None) -> DataFrame:
        """(query_id, row, score, rank) for a batch of vectors (query_id, col, val)."""
        return topk.per_row_topk(spmv.multi_spmv(self.coo, queries), k or self.params.k, "query_id")

    def compare(self, query: DataFrame, k: int | None = None) -> DataFrame:
        """(hits, k, precision) of the approximate result against the exact one."""
        k = k or self.params.k
        exact, got = self.search(query, k, "nonnegative").select("row"), self.search_approximate(query, k).select("row")
        return exact.join(got, "row", "left_semi").agg(F.count("*").alias("hits")).withColumn("k", F.lit(k)).withColumn("precision", F.col("hits") / k)

    def partition(self, parts: int | None = None) -> DataFrame:
        """Statistics of the row parts."""
        return matrix.partition_stats(self.coo, parts or self.params.parts, self.params.packet, self.rows)

    def close(self) -> None:
        self.coo.unpersist()
