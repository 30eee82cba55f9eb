"""Quality of a ranked list against a reference list.

Lists are DataFrames (list_id, rank from 1, item, score); every metric groups by list_id. Results of a list
are at most a few hundred rows, so item pairs of one list are a small self-join on list_id.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def cut(lists: DataFrame, t: int) -> DataFrame:
    """The first t of each list."""
    return lists.filter(F.col("rank") <= t)


def precision_at(ref: DataFrame, got: DataFrame, bounds: list[int]) -> DataFrame:
    """(list_id, t, precision): share of the first t of the reference found in the first t of the other list."""
    hits = ref.select("list_id", "item", F.col("rank").alias("a")).join(got.select("list_id", "item", F.col("rank").alias("b")), ["list_id", "item"])
    at = hits.withColumn("at", F.greatest("a", "b"))
    every = ref.select("list_id").distinct().withColumn("t", F.explode(F.array(*map(F.lit, bounds))))
    joined = every.join(at.select("list_id", "at"), "list_id", "left")
    return joined.groupBy("list_id", "t").agg((F.coalesce(F.sum((F.col("at") <= F.col("t")).cast("long")), F.lit(0)) / F.col("t")).alias("precision"))


def ndcg(ref: DataFrame, got: DataFrame, relevance: str = "rank", t: int | None = None) -> DataFrame:
    """(list_id, ndcg), discount log2(rank + 1). By "rank", an item counts as many places as it stands before the end
    of the other list (of the reference's length), discounted by its reference rank; by "score", an item of the other
    list counts its reference score, discounted by its rank there. Items of one list only count 0."""
    if t is not None:
        ref, got = cut(ref, t), cut(got, t)
    n = ref.groupBy("list_id").agg(F.max("rank").alias("_n"))
    r = ref.join(n, "list_id").select("list_id", "item", "_n", F.col("rank").alias("_r"), F.col("score").alias("_s"))
    g = got.select("list_id", "item", F.col("rank").alias("_g"))
    own = F.col("_n") - F.col("_r") + 1.0 if relevance == "rank" else F.col("_s")
    ideal = r.groupBy("list_id").agg(F.sum(own / F.log2(F.col("_r") + 1.0)).alias("_ideal"))
    both = r.join(g, ["list_id", "item"])
    if relevance == "rank":
        gain = (F.col("_n") - F.col("_g") + 1.0) / F.log2(F.col("_r") + 1.0)
        both = both.filter("_g <= _n")
    else:
        gain = F.col("_s") / F.log2(F.col("_g") + 1.0)
    real = both.groupBy("list_id").agg(F.sum(gain).alias("_real"))
    return ideal.join(real, "list_id", "left").select("list_id", F.when(F.col("_ideal") != 0, F.coalesce("_real", F.lit(0.0)) / F.col("_ideal")).otherwise(0.0).alias("ndcg"))


def bounded_ndcg(ref: DataFrame, got: DataFrame, bounds: tuple[int, ...] = (10, 20, 50), relevance: str = "rank") -> DataFrame:
    """(list_id, t, ndcg) for each bound up to the length of the reference."""
    # as ndcg() of the lists cut at each bound, in one pass
    g = got.select("list_id", "item", F.col("rank").alias("_g"))
    both = ref.select("list_id", "item", F.col("rank").alias("_r"), F.col("score").alias("_s")).join(g, ["list_id", "item"], "left")
    sums = [F.max("_r").alias("_n")]
    for i, t in enumerate(bounds):
        own = t - F.col("_r") + 1.0 if relevance == "rank" else F.col("_s")
        gain = (t - F.col("_g") + 1.0) / F.log2(F.col("_r") + 1.0) if relevance == "rank" else F.col("_s") / F.log2(F.col("_g") + 1.0)
        inside = F.col("_r") <= t
        sums += [F.sum(F.when(inside, own / F.log2(F.col("_r") + 1.0))).alias(f"_ideal{i}"), F.sum(F.when(inside & (F.col("_g") <= t), gain)).alias(f"_real{i}")]
    value = lambda i: F.when(F.col(f"_ideal{i}") != 0, F.coalesce(f"_real{i}", F.lit(0.0)) / F.col(f"_ideal{i}")).otherwise(0.0)
    each = F.explode(F.array(*(F.struct(F.lit(t).alias("t"), value(i).alias("ndcg")) for i, t in enumerate(bounds)))).alias("_x")
    return both.groupBy("list_id").agg(*sums).select("list_id", "_n", each).filter("_n >= _x.t").select("list_id", "_x.t", "_x.ndcg")


def kendall_tau(ref: DataFrame, got: DataFrame) -> DataFrame:
    """(list_id, tau) over the union of both lists: (concordant - discordant) / sqrt(Cu) / sqrt(Cs), where Cu and Cs
    count the pairs fully ranked in the reference and in the other list; null if either has no pair."""
    u = ref.select("list_id", "item", F.col("rank").alias("a")).join(got.select("list_id", "item", F.col("rank").alias("b")), ["list_id", "item"], "full")
    x, y = u.toDF("list_id", "i", "ai", "bi"), u.toDF("list_id", "j", "aj", "bj")
    pairs = x.join(y, "list_id").filter("i < j")
    da, db = F.col("ai") - F.col("aj"), F.col("bi") - F.col("bj")
    s = pairs.groupBy("list_id").agg(
        F.sum(F.coalesce(F.signum(da * db), F.lit(0.0))).alias("s"), F.sum(da.isNotNull().cast("long")).alias("cu"), F.sum(db.isNotNull().cast("long")).alias("cs"),
    )
    return s.select("list_id", F.when((F.col("cu") > 0) & (F.col("cs") > 0), F.col("s") / F.sqrt(F.col("cu").cast("double")) / F.sqrt(F.col("cs").cast("double"))).alias("tau"))


def edit_distance(ref: DataFrame, got: DataFrame, t: int | None = None) -> DataFrame:
    """(list_id, distance): edit distance of the item sequences, each item of a list's union being one character.
    For lists whose union has at most 20,000 items."""
    if t is not None:
        ref, got = cut(ref, t), cut(got, t)
    both = ref.select("list_id", "item", "rank", F.lit(0).alias("side")).unionAll(got.select("list_id", "item", "rank", F.lit(1).alias("side")))
    code = both.withColumn("c", F.dense_rank().over(Window.partitionBy("list_id").orderBy("item")))
    word = lambda side: F.array_join(F.transform(F.sort_array(F.collect_list(F.when(F.col("side") == side, F.struct("rank", "c")))), lambda x: _char(x["c"])), "")
    return code.groupBy("list_id").agg(word(0).alias("a"), word(1).alias("b")).select("list_id", F.levenshtein("a", "b").alias("distance"))


def _char(c):
    # from U+4E00 upwards: one character each
    return F.decode(F.unhex(F.lpad(F.hex(c + 0x4E00), 4, "0")), "UTF-16BE")


def positional_errors(ref: DataFrame, got: DataFrame, bounds: tuple[int, ...]) -> DataFrame:
    """(list_id, t, errors): positions up to t whose items differ."""
    j = ref.select("list_id", "rank", F.col("item").alias("x")).join(got.select("list_id", "rank", F.col("item").alias("y")), ["list_id", "rank"])
    at = j.withColumn("t", F.explode(F.array(*map(F.lit, bounds)))).filter("rank <= t")
    return at.groupBy("list_id", "t").agg(F.sum((F.col("x") != F.col("y")).cast("long")).alias("errors"))


def errors_but_swaps(ref: DataFrame, got: DataFrame) -> DataFrame:
    """(list_id, errors): positions whose items differ, without those that mirror the difference before (the second
    half of a swap)."""
    j = ref.select("list_id", "rank", F.col("item").alias("x")).join(got.select("list_id", "rank", F.col("item").alias("y")), ["list_id", "rank"])
    w = Window.partitionBy("list_id").orderBy("rank")
    mirror = F.coalesce((F.lag("x").over(w) == F.col("y")) & (F.lag("y").over(w) == F.col("x")), F.lit(False))
    bad = j.filter("x <> y").withColumn("bad", (~mirror).cast("long")).groupBy("list_id").agg(F.sum("bad").alias("_e"))
    return j.select("list_id").distinct().join(bad, "list_id", "left").select("list_id", F.coalesce("_e", F.lit(0)).alias("errors"))


def value_errors(ref: DataFrame, got: DataFrame, tol: float = 1e-5) -> DataFrame:
    """(list_id, errors): positions whose scores differ by more than ``tol``."""
    j = ref.select("list_id", "rank", F.col("score").alias("x")).join(got.select("list_id", "rank", F.col("score").alias("y")), ["list_id", "rank"])
    return j.groupBy("list_id").agg(F.sum((F.abs(F.col("x") - F.col("y")) > tol).cast("long")).alias("errors"))


def mean_absolute_error(ref: DataFrame, got: DataFrame, bounds: tuple[int, ...] = (10, 20, 50)) -> DataFrame:
    """(list_id, t, mae): mean absolute difference of scores up to each bound."""
    j = ref.select("list_id", "rank", F.col("score").alias("x")).join(got.select("list_id", "rank", F.col("score").alias("y")), ["list_id", "rank"])
    at = j.withColumn("t", F.explode(F.array(*map(F.lit, bounds)))).filter("rank <= t")
    return at.groupBy("list_id", "t").agg(F.avg(F.abs(F.col("x") - F.col("y"))).alias("mae"))
