"""Result logs: CSV files whose cells hold lists and whose names hold the run's settings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Columns of each kind of log, in file order.
COLUMNS = {
    "fpga": "iteration error_idx error_val sw_full_time_ms sw_topk_time_ms hw_setup_time_ms hw_exec_time_ms hw_full_exec_time_ms readback_time_ms k sw_res_idx sw_res_val hw_res_idx hw_res_val".split(),
    "gpu": "iteration error_idx error_val sw_full_time_ms sw_topk_time_ms hw_setup_time_ms hw_spmv_only_time_ms hw_exec_time_ms readback_time_ms k sw_res_idx sw_res_val hw_res_idx hw_res_val".split(),
    "gpu_full": "iteration num_errors sw_time_ms hw_setup_time_ms hw_exec_time_ms".split(),
    "cpu": "iter rows cols nnz K exec_time_ms".split(),
    "convergence": "graph iteration log_error".split(),
}

#: One run's record: errors, times in milliseconds and the result's size, before its lists.
RECORD = T.StructType([T.StructField(c, T.LongType() if c in ("iteration", "error_idx", "error_val", "k") else T.DoubleType()) for c in COLUMNS["fpga"][:10]])

#: What the parts of a log's file name mean.
NAME_PARTS = {
    "fpga": "hardware rows cols distribution nnz bits cores mhz k iterations".split(),
    "gpu": "hardware rows cols distribution nnz impl half k iterations".split(),
    "gpu_full": "hardware rows cols distribution nnz impl half iterations".split(),
    "cpu": "hardware rows cols distribution nnz k iterations".split(),
}


def list_cell(c: Column, kind: str, sep: str = ";") -> Column:
    """A cell of numbers as an array; empty cells as empty arrays."""
    return F.transform(F.filter(F.split(c, sep), lambda x: F.trim(x) != ""), lambda x: F.trim(x).cast(kind))


def nested_cell(c: Column, kind: str) -> Column:
    """A cell of lists of lists: ``;`` between lists, ``|`` inside them."""
    return F.transform(F.filter(F.split(c, ";"), lambda x: x != ""), lambda x: list_cell(x, kind, r"\|"))


def _log_name() -> Column:
    """A log's name without its ending: the file's, or for a folder of Spark's part files the folder's."""
    steps = F.split(F.url_decode(F.col("_metadata.file_path")), "/")
    name = F.element_at(steps, -1)
    return F.regexp_replace(F.when(name.startswith("part-"), F.element_at(steps, -2)).otherwise(name), r"\.csv$", "")


def read_rank_log(spark: SparkSession, path: str) -> DataFrame:
    """(graph, iteration, time_ms, errors array<double>, vertices array<array<long>>) of logs of PageRank runs.

    Three layouts are told apart by their header: the cells ``errors`` and ``vertices`` may be missing, and the first
    column may be called iteration or iter. ``;`` parts lists and ``|`` lists inside them; graph is the file's name.
    """
    raw = spark.read.option("header", True).option("pathGlobFilter", "*.csv").csv(path)
    has = lambda c: F.col(c) if c in raw.columns else F.lit(None).cast("string")
    return raw.select(
        _log_name().alias("graph"), F.coalesce(has("iteration"), has("iter")).cast("long").alias("iteration"), has("time_ms").cast("double").alias("time_ms"),
        F.coalesce(list_cell(has("errors"), "double"), F.array().cast("array<double>")).alias("errors"), F.coalesce(nested_cell(has("vertices"), "long"), F.array().cast("array<array<bigint>>")).alias("vertices"),
    )


def read_log(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """All logs of a folder (``*.csv``), typed, with the settings from the file names."""
    raw = spark.read.option("header", True).option("pathGlobFilter", "*.csv").csv(path)
    out = raw
    for name in raw.columns:
        if name.endswith("_res_idx"):
            out = out.withColumn(name, list_cell(F.col(name), "long"))
        elif name.endswith("_res_val"):
            out = out.withColumn(name, list_cell(F.col(name), "double"))
        elif name == "graph":
            pass
        elif name in ("iteration", "iter", "error_idx", "error_val", "num_errors", "k", "K", "rows", "cols", "nnz"):
            out = out.withColumn(name, F.col(name).cast("long"))
        else:
            out = out.withColumn(name, F.col(name).cast("double"))
    parts = F.split(_log_name(), "_")
    names = NAME_PARTS.get(kind, [])
    return out.select("*", *(F.try_element_at(parts, F.lit(i + 1)).alias(f"file_{n}") for i, n in enumerate(names)))


def write_log(df: DataFrame, path: str, kind: str) -> None:
    """A log in file order with a header; arrays joined by ``;``."""
    types = dict(df.dtypes)
    cols = [F.array_join(F.col(c).cast("array<string>"), ";").alias(c) if types[c].startswith("array") else F.col(c) for c in COLUMNS[kind]]
    df.select(*cols).write.mode("overwrite").option("header", True).csv(path)
