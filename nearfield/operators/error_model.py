"""Expected precision of partitioned top-k: by simulation and in closed form."""

from __future__ import annotations

from fractions import Fraction
from math import comb

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .generate import parameter_grid


def closed_form(n: int, parts: int, k: int, keep: int) -> float:
    """1 if k <= keep; 0 if all parts together keep fewer than k; else 1 - parts * sum of C(n // parts, i) / C(n, k)
    over keep < i < min(n // parts, k). Exact integers until the last division."""
    if k <= keep:
        return 1.0
    if keep * parts < k:
        return 0.0
    size = n // parts
    return float(1 - parts * Fraction(sum(comb(size, i) for i in range(keep + 1, min(size, k))), comb(n, k)))


def closed_form_mean(n: int, parts: int, k: int, keep: int) -> float:
    """Mean of :func:`closed_form` over result lengths 1 to k."""
    return sum(closed_form(n, parts, i, keep) for i in range(1, k + 1)) / k


def closed_form_table(spark: SparkSession, n: int, parts: list[int], ks: list[int], keep: int = 8) -> DataFrame:
    """(parts, k, precision): the estimate for each combination; exact integers, on a handful of parameter rows."""
    rows = [(p, k, closed_form(n, p, k, keep)) for p in parts for k in ks]
    return spark.createDataFrame(rows, "parts int, k int, precision double")


def monte_carlo(spark: SparkSession, n: int, parts: list[int], ks: list[int], keep: int = 8, repeats: int = 10, seed: int = 1) -> DataFrame:
    """(parts, k, rep, errors, precision): random scores, the ``keep`` best of each part merged, missed items of the true top k.

    Scores of a repeat are shared by all settings. Parts are contiguous, the first n mod parts one longer.
    """
    scores = spark.range(repeats).withColumnRenamed("id", "rep").select("rep", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("i")).withColumn("score", F.rand(seed))
    true = scores.withColumn("r", F.row_number().over(Window.partitionBy("rep").orderBy(F.desc("score"), F.desc("i")))).filter(F.col("r") <= max(ks))
    settings = parameter_grid(spark, parts=parts)
    size, extra = F.floor(F.lit(n) / F.col("parts")), F.lit(n) % F.col("parts")
    part = F.when(F.col("i") < extra * (size + 1), F.floor(F.col("i") / (size + 1))).otherwise(extra + F.floor((F.col("i") - extra * (size + 1)) / F.greatest(size, F.lit(1))))
    # a true top item is found if fewer than keep better ones share its part: only the true top matters
    placed = true.crossJoin(settings).withColumn("part", part)
    within = placed.withColumn("w", F.row_number().over(Window.partitionBy("parts", "rep", "part").orderBy("r")))
    each = within.withColumn("k", F.explode(F.array(*map(F.lit, ks)))).filter("r <= k")
    out = each.groupBy("parts", "k", "rep").agg(F.sum((F.col("w") > keep).cast("long")).alias("errors"))
    return out.withColumn("precision", 1 - F.col("errors") / F.col("k"))


def mean_precision(runs: DataFrame) -> DataFrame:
    """(parts, k, precision, errors): means over repeats."""
    return runs.groupBy("parts", "k").agg(F.avg("precision").alias("precision"), F.avg("errors").alias("errors"))
