"""Statistics of benchmark runs: outliers, means, speed-ups, unpivoting, intervals, rooflines."""

from __future__ import annotations

import math
from functools import cache
from statistics import NormalDist

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

EXACT_DEGREES = 100


def student_share(t: float, degrees: int) -> float:
    """Share of Student's t within -t and t, by the finite sum for whole degrees of freedom."""
    angle = math.atan(t / math.sqrt(degrees))
    c, sine = math.cos(angle), math.sin(angle)
    odd = degrees % 2
    term, total = (c, 0.0) if odd else (1.0, 0.0)
    for k in range(odd, degrees - 1, 2):
        total += term
        term *= c * c * (k + 1) / (k + 2)
    return 2 / math.pi * (angle + sine * total) if odd else sine * total


@cache
def student_quantiles(level: float) -> tuple[float, ...]:
    """Two-sided quantiles of Student's t for 1 to ``EXACT_DEGREES`` degrees of freedom."""
    out = []
    for n in range(1, EXACT_DEGREES + 1):
        low, high = 0.0, 1.0
        while student_share(high, n) < level:
            high *= 2
        for _ in range(80):
            middle = (low + high) / 2
            low, high = (middle, high) if student_share(middle, n) < level else (low, middle)
        out.append((low + high) / 2)
    return tuple(out)


def student_quantile(degrees: Column, level: float = 0.95) -> Column:
    """Two-sided quantile of Student's t; beyond ``EXACT_DEGREES`` by its series in 1 / degrees, exact to 1e-10."""
    z = NormalDist().inv_cdf((1 + level) / 2)
    terms = (z, (z**3 + z) / 4, (5 * z**5 + 16 * z**3 + 3 * z) / 96, (3 * z**7 + 19 * z**5 + 17 * z**3 - 15 * z) / 384, (79 * z**9 + 776 * z**7 + 1482 * z**5 - 1920 * z**3 - 945 * z) / 92160)
    series = sum((F.lit(c) / F.pow(degrees.cast("double"), F.lit(float(i))) for i, c in enumerate(terms)), F.lit(0.0))
    exact = F.get(F.lit(list(student_quantiles(level))), (degrees - 1).cast("int"))
    return F.when(degrees <= EXACT_DEGREES, exact).otherwise(series)


def geometric_mean(c: Column) -> Column:
    """Aggregate: exp of the mean log."""
    return F.exp(F.avg(F.log(c)))


def within_sigma(df: DataFrame, value: str, sigma: float = 3.0, by: list[str] | None = None) -> DataFrame:
    """Rows whose population z-score is under ``sigma``, in all rows or in each group; a group without spread has no
    z-score and gives nothing."""
    keys = by or []
    stats = df.groupBy(*keys).agg(F.avg(value).alias("_m"), F.stddev_pop(value).alias("_s"))
    j = df.join(stats, keys) if keys else df.crossJoin(stats)  # one row of statistics
    return j.filter((F.col("_s") > 0) & (F.abs(F.col(value) - F.col("_m")) < sigma * F.col("_s"))).drop("_m", "_s")


def warm_mean(df: DataFrame, value: str, iteration: str, skip: int, by: list[str]) -> DataFrame:
    """(by, mean, sd): mean and population deviation after the first ``skip`` iterations; 0 if none is left."""
    v = F.when(F.col(iteration) >= skip, F.col(value))
    return df.groupBy(*by).agg(F.coalesce(F.avg(v), F.lit(0.0)).alias("mean"), F.coalesce(F.stddev_pop(v), F.lit(0.0)).alias("sd"))


def confidence(df: DataFrame, value: str, by: list[str]) -> DataFrame:
    """(by, mean, lower, upper): 95 % interval of the mean by Student's t; null bounds for a single row."""
    s = df.groupBy(*by).agg(F.count(value).alias("_n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("_s"))
    t = student_quantile(F.greatest(F.col("_n") - 1, F.lit(1)))
    half = F.when(F.col("_n") > 1, t * F.col("_s") / F.sqrt(F.col("_n").cast("double")))
    return s.select(*by, "mean", (F.col("mean") - half).alias("lower"), (F.col("mean") + half).alias("upper"))


def speedup(df: DataFrame, value: str, key: list[str], system: str, baseline: str) -> DataFrame:
    """Adds speedup: the baseline's median for the same key over the value, divided by the geometric mean of the
    baseline's own speed-ups, so that the baseline stands at 1."""
    base = df.filter(F.col(system) == baseline).groupBy(*key).agg(F.median(value).alias("_b"))
    raw = df.join(base, key).withColumn("_r", F.col("_b") / F.col(value))
    unit = raw.filter(F.col(system) == baseline).groupBy(*key).agg(geometric_mean(F.col("_r")).alias("_g"))
    return raw.join(unit, key).withColumn("speedup", F.col("_r") / F.col("_g")).drop("_b", "_r", "_g")


def ratio(df: DataFrame, slow: str, fast: str, out: str = "speedup") -> DataFrame:
    """Adds slow / fast."""
    return df.withColumn(out, F.col(slow) / F.col(fast))


def fill_missing(df: DataFrame, value: str, key: list[str], system: str, baseline: str) -> DataFrame:
    """Missing values taken from the baseline's rows of the same key, which must agree on one value."""
    base = df.filter((F.col(system) == baseline) & F.col(value).isNotNull()).groupBy(*key).agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"))
    one = base.withColumn("_fill", F.when(F.col("_lo") == F.col("_hi"), F.col("_lo")).otherwise(F.raise_error(F.lit("baseline values of a key differ")).cast(df.schema[value].dataType)))
    return df.join(one.select(*key, "_fill"), key, "left").withColumn(value, F.coalesce(value, "_fill")).drop("_fill")


def melt(df: DataFrame, ids: list[str], prefix_sep: str = "_") -> DataFrame:
    """Metric columns such as precision_10 → rows (ids, kind, size, value)."""
    values = [c for c in df.columns if c not in ids]
    long = df.unpivot([F.col(f"`{c}`") for c in ids], [F.col(f"`{c}`") for c in values], "name", "value")
    return long.select(*ids, F.substring_index("name", prefix_sep, 1).alias("kind"), F.substring_index("name", prefix_sep, -1).cast("int").alias("size"), "value")


def roofline(df: DataFrame, nnz: str, ms: str, bytes_per_s: float, peak: float, per_byte: float) -> DataFrame:
    """Adds throughput (nnz a second), and attainable: the lower of the peak and bandwidth times intensity."""
    return df.withColumn("throughput", F.col(nnz) / (F.col(ms) / 1000)).withColumn("attainable", F.least(F.lit(peak), F.lit(bytes_per_s * per_byte)))


def mapped(df: DataFrame, column: str, names: dict[str, str]) -> DataFrame:
    """Values replaced by a small map; others stay."""
    m = F.create_map(*(F.lit(x) for kv in names.items() for x in kv))
    return df.withColumn(column, F.coalesce(F.try_element_at(m, F.col(column)), F.col(column)))


def ordered_by_list(df: DataFrame, column: str, order: list[str], *then: str) -> DataFrame:
    """Sorted by a given order of categories, unknown ones last, then by other columns."""
    at = F.array_position(F.lit(order), F.col(column))
    return df.orderBy(F.when(at > 0, at).otherwise(len(order) + 1), *then)


def span(df: DataFrame, start: str, end: str) -> DataFrame:
    """(span): latest end minus earliest start."""
    return df.agg((F.max(end) - F.min(start)).alias("span"))


def numbered(df: DataFrame, by: list[str], order: list[str], out: str = "n") -> DataFrame:
    """Adds a row number from 0 in each group."""
    return df.withColumn(out, F.row_number().over(Window.partitionBy(*by).orderBy(*order)) - 1)


def set_sizes(a: DataFrame, b: DataFrame, item: str) -> DataFrame:
    """(both, only_a, only_b, either) of two sets of items."""
    j = a.select(item).distinct().withColumn("_a", F.lit(1)).join(b.select(item).distinct().withColumn("_b", F.lit(1)), item, "full")
    n = lambda c: F.count(F.when(c, 1))
    x, y = F.col("_a").isNotNull(), F.col("_b").isNotNull()
    return j.agg(n(x & y).alias("both"), n(x & ~y).alias("only_a"), n(~x & y).alias("only_b"), F.count("*").alias("either"))
