"""Catalogue, second part: ranking metrics, generators, error model, statistics, files and logs."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import columns as fc
from ..operators import batch_topk, error_model, generate, graph, matrix, rank_metrics, stats, topk
from ..operators.graph import is_local
from ..sources import mtx, result_logs
from .catalogue import E_SQL, G_SQL, L_SQL, T_SQL, _t, query, rounded, view_e, view_g, view_l, view_t

# --- ranking metrics: exact (32 bits) against approximate (8 bits) lists of the queries vec_id < 8 ------------

_TOP = 50


def _lists(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    e = view_e(spark, d)
    out = []
    for width in (32, 8):
        q = e.filter("row < 8").select(F.col("row").alias("list_id"), "col", fc.quantise(F.col("val"), width).alias("q"))
        s = e.join(q, "col").groupBy("list_id", "row").agg(F.sum(fc.fixed_product(fc.quantise(F.col("val"), width), F.col("q"), width)).alias("score"))
        top = topk.per_row_topk(s, _TOP, "list_id")
        out.append(top.select("list_id", "rank", F.col("row").alias("item"), (F.col("score") / float(1 << (width - 1))).alias("score")))
    return out[0], out[1]


def _list_sql(name: str, w: int, asked: str = "q.row < 8", most: int = _TOP) -> str:
    q = f"CAST(sign(val) * floor(abs(val) * {float(1 << (w - 1))}) AS BIGINT)"
    return (
        f"f{name} AS (SELECT row, col, {q} AS v FROM E), s{name} AS (SELECT q.row AS list_id, a.row AS item, CAST(sum((a.v * q.v) // {1 << (w - 1)}) AS BIGINT) AS score FROM f{name} a JOIN f{name} q ON a.col = q.col WHERE {asked} GROUP BY ALL), "
        f"{name} AS (SELECT list_id, item, rank, score / {float(1 << (w - 1))} AS score FROM (SELECT *, row_number() OVER (PARTITION BY list_id ORDER BY score DESC, item DESC) AS rank FROM s{name}) WHERE rank <= {most})"
    )


SWEEP = (8, 16, 32, 50, 75, 100)


def _swept(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """As :func:`_lists`, for queries that grow with the table and up to the largest bound."""
    lists = batch_topk.fixed_lists(_t(spark, d, "embeddings"), "row % 20 = 0", max(SWEEP), (32, 8))
    return lists[32], lists[8]


SWEEP_SQL = f"{E_SQL}, {_list_sql('A', 32, 'q.row % 20 = 0', 100)}, {_list_sql('B', 8, 'q.row % 20 = 0', 100)}, t AS (SELECT unnest({list(SWEEP)}) AS t)"
LISTS_SQL = f"{E_SQL}, {_list_sql('A', 32)}, {_list_sql('B', 8)}"


@query(f"WITH {LISTS_SQL}, t AS (SELECT unnest([8, 16, 32, 50]) AS t) SELECT l.list_id AS list_id, t.t AS t, (SELECT count(*) FROM A JOIN B ON A.list_id = B.list_id AND A.item = B.item WHERE A.list_id = l.list_id AND A.rank <= t.t AND B.rank <= t.t) / CAST(t.t AS DOUBLE) AS precision FROM (SELECT DISTINCT list_id FROM A) l, t")
def precision_at(spark, d):
    return rank_metrics.precision_at(*_lists(spark, d), [8, 16, 32, 50])


@query(f"WITH {SWEEP_SQL} SELECT l.list_id AS list_id, t.t AS t, coalesce(h.n, 0) / CAST(t.t AS DOUBLE) AS precision FROM (SELECT DISTINCT list_id FROM A) l CROSS JOIN t LEFT JOIN (SELECT A.list_id AS list_id, t, count(*) AS n FROM A JOIN B ON A.list_id = B.list_id AND A.item = B.item, t WHERE A.rank <= t AND B.rank <= t GROUP BY ALL) h ON h.list_id = l.list_id AND h.t = t.t")
def precision_sweep(spark, d):
    """All queries whose row is divisible by 20, up to 100 results."""
    return rank_metrics.precision_at(*_swept(spark, d), list(SWEEP))


@query(f"WITH {SWEEP_SQL}, i AS (SELECT list_id, t, sum((t - rank + 1) / log2(rank + 1.0)) AS i FROM A, t WHERE rank <= t GROUP BY ALL), r AS (SELECT A.list_id AS list_id, t, sum((t - B.rank + 1) / log2(A.rank + 1.0)) AS r FROM A JOIN B ON A.list_id = B.list_id AND A.item = B.item, t WHERE A.rank <= t AND B.rank <= t GROUP BY ALL) SELECT i.list_id AS list_id, i.t AS t, round(coalesce(r, 0) / i, 9) AS ndcg FROM i LEFT JOIN r ON i.list_id = r.list_id AND i.t = r.t WHERE i.t <= (SELECT count(*) FROM embeddings)")
def ndcg_sweep(spark, d):
    return rounded(rank_metrics.bounded_ndcg(*_swept(spark, d), bounds=SWEEP), "ndcg")


@query(f"WITH {LISTS_SQL}, i AS (SELECT list_id, sum(({_TOP} - rank + 1) / log2(rank + 1.0)) AS i FROM A GROUP BY ALL), r AS (SELECT A.list_id AS list_id, sum(({_TOP} - B.rank + 1) / log2(A.rank + 1.0)) AS r FROM A JOIN B ON A.list_id = B.list_id AND A.item = B.item GROUP BY ALL) SELECT i.list_id AS list_id, round(coalesce(r, 0) / i, 9) AS ndcg FROM i LEFT JOIN r ON i.list_id = r.list_id")
def ndcg_rank(spark, d):
    return rounded(rank_metrics.ndcg(*_lists(spark, d)), "ndcg")


@query(f"WITH {LISTS_SQL}, i AS (SELECT list_id, sum(score / log2(rank + 1.0)) AS i FROM A GROUP BY ALL), r AS (SELECT A.list_id AS list_id, sum(A.score / log2(B.rank + 1.0)) AS r FROM A JOIN B ON A.list_id = B.list_id AND A.item = B.item GROUP BY ALL) SELECT i.list_id AS list_id, round(coalesce(r, 0) / i, 9) AS ndcg FROM i LEFT JOIN r ON i.list_id = r.list_id")
def ndcg_value(spark, d):
    return rounded(rank_metrics.ndcg(*_lists(spark, d), relevance="score"), "ndcg")


@query(f"WITH {LISTS_SQL}, t AS (SELECT unnest([10, 20, 50]) AS t), i AS (SELECT list_id, t, sum((t - rank + 1) / log2(rank + 1.0)) AS i FROM A, t WHERE rank <= t GROUP BY ALL), r AS (SELECT A.list_id AS list_id, t, sum((t - B.rank + 1) / log2(A.rank + 1.0)) AS r FROM A JOIN B ON A.list_id = B.list_id AND A.item = B.item, t WHERE A.rank <= t AND B.rank <= t GROUP BY ALL) SELECT i.list_id AS list_id, i.t AS t, round(coalesce(r, 0) / i, 9) AS ndcg FROM i LEFT JOIN r ON i.list_id = r.list_id AND i.t = r.t")
def ndcg_bounded(spark, d):
    return rounded(rank_metrics.bounded_ndcg(*_lists(spark, d)), "ndcg")


@query(f"WITH {LISTS_SQL}, u AS (SELECT coalesce(A.list_id, B.list_id) AS list_id, coalesce(A.item, B.item) AS item, A.rank AS a, B.rank AS b FROM A FULL JOIN B ON A.list_id = B.list_id AND A.item = B.item), p AS (SELECT x.list_id AS list_id, x.a - y.a AS da, x.b - y.b AS db FROM u x JOIN u y ON x.list_id = y.list_id AND x.item < y.item) SELECT list_id, round(sum(coalesce(sign(da * db), 0)) / sqrt(count(da)) / sqrt(count(db)), 9) AS tau FROM p GROUP BY list_id")
def kendall(spark, d):
    return rounded(rank_metrics.kendall_tau(*_lists(spark, d)), "tau")


def _edit_sql(top: int) -> str:
    return f"WITH {LISTS_SQL}, u AS (SELECT list_id, item, dense_rank() OVER (PARTITION BY list_id ORDER BY item) AS c FROM (SELECT list_id, item FROM A WHERE rank <= {top} UNION SELECT list_id, item FROM B WHERE rank <= {top})), x AS (SELECT A.list_id AS list_id, string_agg(chr(CAST(c AS INTEGER)), '' ORDER BY rank) AS s FROM A JOIN u ON A.list_id = u.list_id AND A.item = u.item WHERE rank <= {top} GROUP BY ALL), y AS (SELECT B.list_id AS list_id, string_agg(chr(CAST(c AS INTEGER)), '' ORDER BY rank) AS s FROM B JOIN u ON B.list_id = u.list_id AND B.item = u.item WHERE rank <= {top} GROUP BY ALL) SELECT x.list_id AS list_id, CAST(levenshtein(x.s, y.s) AS INTEGER) AS distance FROM x JOIN y ON x.list_id = y.list_id"


@query(_edit_sql(50))
def edit_distance(spark, d):
    return rank_metrics.edit_distance(*_lists(spark, d))


@query(_edit_sql(20))
def edit_distance_20(spark, d):
    return rank_metrics.edit_distance(*_lists(spark, d), t=20)


@query(f"WITH {LISTS_SQL}, t AS (SELECT unnest([10, 20, 50]) AS t) SELECT A.list_id AS list_id, t, CAST(sum(CASE WHEN A.item <> B.item THEN 1 ELSE 0 END) AS BIGINT) AS errors FROM A JOIN B ON A.list_id = B.list_id AND A.rank = B.rank, t WHERE A.rank <= t GROUP BY ALL")
def positional_errors(spark, d):
    return rank_metrics.positional_errors(*_lists(spark, d), (10, 20, 50))


@query(f"WITH {LISTS_SQL}, j AS (SELECT A.list_id AS list_id, A.rank AS rank, A.item AS x, B.item AS y FROM A JOIN B ON A.list_id = B.list_id AND A.rank = B.rank), m AS (SELECT *, lag(x) OVER w AS px, lag(y) OVER w AS py FROM j WHERE x <> y WINDOW w AS (PARTITION BY list_id ORDER BY rank)) SELECT l.list_id AS list_id, count(m.rank) FILTER (WHERE NOT coalesce(px = y AND py = x, FALSE)) AS errors FROM (SELECT DISTINCT list_id FROM j) l LEFT JOIN m ON l.list_id = m.list_id GROUP BY ALL")
def swap_forgiving(spark, d):
    return rank_metrics.errors_but_swaps(*_lists(spark, d))


@query(f"WITH {LISTS_SQL} SELECT A.list_id AS list_id, CAST(sum(CASE WHEN abs(A.score - B.score) > 0.01 THEN 1 ELSE 0 END) AS BIGINT) AS errors FROM A JOIN B ON A.list_id = B.list_id AND A.rank = B.rank GROUP BY ALL")
def value_errors(spark, d):
    return rank_metrics.value_errors(*_lists(spark, d), tol=0.01)


@query(f"WITH {LISTS_SQL}, t AS (SELECT unnest([10, 20, 50]) AS t) SELECT A.list_id AS list_id, t, round(avg(abs(A.score - B.score)), 9) AS mae FROM A JOIN B ON A.list_id = B.list_id AND A.rank = B.rank, t WHERE A.rank <= t GROUP BY ALL")
def mae(spark, d):
    return rounded(rank_metrics.mean_absolute_error(*_lists(spark, d)), "mae")


# --- relational and statistical -----------------------------------------------------------------------------


@query(f"WITH {T_SQL} SELECT grp, iteration, time AS time_ms FROM T WHERE time > 10 AND iteration <> 0 AND NOT (iteration <= 2)")
def project_filter(spark, d):
    return view_t(spark, d).filter((F.col("time") > 10) & (F.col("iteration") != 0) & ~(F.col("iteration") <= 2)).select("grp", "iteration", F.col("time").alias("time_ms"))


@query("SELECT o_orderpriority AS p, count(*) AS n FROM orders WHERE o_orderstatus IN ('O', 'P') AND o_orderpriority NOT IN ('5-LOW') GROUP BY 1")
def isin_filter(spark, d):
    o = _t(spark, d, "orders")
    return o.filter(F.col("o_orderstatus").isin("O", "P") & ~F.col("o_orderpriority").isin("5-LOW")).groupBy(F.col("o_orderpriority").alias("p")).agg(F.count("*").alias("n"))


@query("SELECT c_nationkey AS nation, c_acctbal AS balance FROM customer UNION ALL SELECT s_nationkey, s_acctbal FROM supplier")
def union_all(spark, d):
    c = _t(spark, d, "customer").select(F.col("c_nationkey").alias("nation"), F.col("c_acctbal").alias("balance"))
    return c.unionByName(_t(spark, d, "supplier").select(F.col("s_nationkey").alias("nation"), F.col("s_acctbal").alias("balance")))


@query(f"WITH {T_SQL} SELECT grp, round(avg(time), 6) AS mean, round(exp(avg(ln(time + 1))), 6) AS gmean, round(median(time), 6) AS median FROM T WHERE time > -1 GROUP BY grp")
def means(spark, d):
    t = view_t(spark, d).filter("time > -1")
    out = t.groupBy("grp").agg(F.avg("time").alias("mean"), stats.geometric_mean(F.col("time") + 1).alias("gmean"), F.median("time").alias("median"))
    return rounded(out, "mean", "gmean", "median", digits=6)


@query("SELECT DISTINCT p_brand AS brand FROM part")
def distinct_sorted(spark, d):
    return _t(spark, d, "part").select(F.col("p_brand").alias("brand")).distinct().orderBy("brand")


@query("SELECT o_orderpriority AS p, o_orderstatus AS s, count(*) AS n, CASE o_orderstatus WHEN 'P' THEN 1 WHEN 'O' THEN 2 ELSE 3 END AS place FROM orders GROUP BY 1, 2")
def category_order(spark, d):
    n = _t(spark, d, "orders").groupBy(F.col("o_orderpriority").alias("p"), F.col("o_orderstatus").alias("s")).agg(F.count("*").alias("n"))
    at = F.array_position(F.lit(["P", "O"]), F.col("s"))
    return stats.ordered_by_list(n.withColumn("place", F.when(at > 0, at.cast("int")).otherwise(3)), "s", ["P", "O"], "p")


@query("SELECT p_partkey AS id, v.kind AS kind, v.size AS size, v.value AS value FROM part, LATERAL (VALUES ('size', 1, CAST(p_size AS DOUBLE)), ('price', 2, p_retailprice)) v(kind, size, value)")
def unpivot(spark, d):
    p = _t(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_size").cast("double").alias("size_1"), F.col("p_retailprice").alias("price_2"))
    return stats.melt(p, ["id"])


@query("SELECT c_custkey AS id, CASE WHEN c_acctbal < 0 THEN 0.0 ELSE c_acctbal END AS floor0, CASE WHEN c_mktsegment = 'BUILDING' THEN 'B' WHEN c_mktsegment = 'MACHINERY' THEN 'M' ELSE c_mktsegment END AS segment FROM customer")
def conditional_and_mapping(spark, d):
    c = _t(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.when(F.col("c_acctbal") < 0, 0.0).otherwise(F.col("c_acctbal")).alias("floor0"), F.col("c_mktsegment").alias("segment"))
    return stats.mapped(c, "segment", {"BUILDING": "B", "MACHINERY": "M"})


@query("SELECT p_partkey AS id, CASE WHEN length(p_name) > 12 THEN substr(p_name, 1, 9) || '...' ELSE p_name END AS short, split_part(p_type, ' ', 1) AS head, trim(p_brand) || '/' || replace(p_type, ' ', '_') AS label, CASE WHEN ltrim(reverse(CAST(p_size * 100 AS VARCHAR)), '0') = '1' THEN '10^' || CAST(length(CAST(p_size * 100 AS VARCHAR)) - length(ltrim(reverse(CAST(p_size * 100 AS VARCHAR)), '0')) AS VARCHAR) ELSE reverse(ltrim(reverse(CAST(p_size * 100 AS VARCHAR)), '0')) || '·10^' || CAST(length(CAST(p_size * 100 AS VARCHAR)) - length(ltrim(reverse(CAST(p_size * 100 AS VARCHAR)), '0')) AS VARCHAR) END AS exponent FROM part")
def string_functions(spark, d):
    p = _t(spark, d, "part")
    return p.select(
        F.col("p_partkey").alias("id"), fc.shorten(F.col("p_name"), 12).alias("short"), F.split("p_type", " ")[0].alias("head"),
        F.concat_ws("/", F.trim("p_brand"), F.regexp_replace("p_type", " ", "_")).alias("label"), fc.exponent_label(F.col("p_size") * 100).alias("exponent"),
    )


_RUNS = "r AS (SELECT o_orderpriority AS key, o_orderstatus AS system, o_totalprice AS time FROM orders)"


@query(f"WITH {_RUNS}, b AS (SELECT key, median(time) AS b FROM r WHERE system = 'O' GROUP BY key), q AS (SELECT r.key AS key, system, time, b / time AS s FROM r JOIN b ON r.key = b.key), g AS (SELECT key, exp(avg(ln(s))) AS g FROM q WHERE system = 'O' GROUP BY key) SELECT q.key AS key, system, round(exp(avg(ln(s / g))), 6) AS speedup FROM q JOIN g ON q.key = g.key GROUP BY ALL")
def speedup_baseline(spark, d):
    r = _t(spark, d, "orders").select(F.col("o_orderpriority").alias("key"), F.col("o_orderstatus").alias("system"), F.col("o_totalprice").alias("time"))
    s = stats.speedup(r, "time", ["key"], "system", "O")
    return rounded(s.groupBy("key", "system").agg(stats.geometric_mean(F.col("speedup")).alias("speedup")), "speedup", digits=6)


@query("SELECT l_orderkey AS o, l_linenumber AS n, l_extendedprice / l_quantity AS speedup FROM lineitem")
def column_ratio(spark, d):
    li = stats.ratio(_t(spark, d, "lineitem"), "l_extendedprice", "l_quantity")
    return li.select(F.col("l_orderkey").alias("o"), F.col("l_linenumber").alias("n"), "speedup")


@query("SELECT o_orderkey AS id FROM orders, (SELECT avg(o_totalprice) AS m, stddev_pop(o_totalprice) AS s FROM orders) WHERE abs(o_totalprice - m) < 1.5 * s")
def zscore_filter(spark, d):
    return stats.within_sigma(_t(spark, d, "orders"), "o_totalprice", 1.5).select(F.col("o_orderkey").alias("id"))


@query("SELECT o_orderkey AS id FROM orders JOIN (SELECT o_orderpriority AS p, avg(o_totalprice) AS m, stddev_pop(o_totalprice) AS s FROM orders GROUP BY 1) ON o_orderpriority = p WHERE abs(o_totalprice - m) < 1.5 * s")
def zscore_grouped(spark, d):
    return stats.within_sigma(_t(spark, d, "orders"), "o_totalprice", 1.5, ["o_orderpriority"]).select(F.col("o_orderkey").alias("id"))


#: Published two-sided 95 % quantiles of Student's t for 1 to 30 degrees of freedom, for the SQL alone.
PUBLISHED_T = (
    12.7062047, 4.3026527, 3.1824463, 2.7764451, 2.5705818, 2.4469119, 2.3646243, 2.3060041, 2.2621572, 2.2281389,
    2.2009852, 2.1788128, 2.1603687, 2.1447867, 2.1314495, 2.1199053, 2.1098156, 2.1009220, 2.0930241, 2.0859634,
    2.0796138, 2.0738731, 2.0686576, 2.0638986, 2.0595386, 2.0555294, 2.0518305, 2.0484071, 2.0452296, 2.0422725,
)
#: Fixed value: the normal quantile; beyond 30 the SQL uses the published expansion in 1 / degrees.
_Z = "1.959963984540054e0"
_T_SQL = f"""CASE WHEN n <= 31 THEN [{", ".join(map(str, PUBLISHED_T))}][n - 1] ELSE {_Z} + (power({_Z}, 3) + {_Z}) / (4 * (n - 1))
  + (5 * power({_Z}, 5) + 16 * power({_Z}, 3) + 3 * {_Z}) / (96 * power(n - 1, 2))
  + (3 * power({_Z}, 7) + 19 * power({_Z}, 5) + 17 * power({_Z}, 3) - 15 * {_Z}) / (384 * power(n - 1, 3))
  + (79 * power({_Z}, 9) + 776 * power({_Z}, 7) + 1482 * power({_Z}, 5) - 1920 * power({_Z}, 3) - 945 * {_Z}) / (92160 * power(n - 1, 4)) END"""


@query(f"WITH {T_SQL}, s AS (SELECT user_id, count(time) AS n, avg(time) AS m, stddev_samp(time) AS sd FROM T GROUP BY user_id), h AS (SELECT user_id, m, {_T_SQL} * sd / sqrt(n) AS half FROM s WHERE n > 1) SELECT user_id, round(m, 5) AS mean, round(m - half, 5) AS lower, round(m + half, 5) AS upper FROM h")
def ci_t(spark, d):
    t = view_t(spark, d)
    out = stats.confidence(t, "time", ["user_id"]).filter("lower IS NOT NULL")
    return rounded(out, "mean", "lower", "upper", digits=5)


@query(f"WITH {T_SQL} SELECT grp, round(coalesce(avg(time) FILTER (WHERE iteration >= 2), 0), 6) AS mean, round(coalesce(stddev_pop(time) FILTER (WHERE iteration >= 2), 0), 6) AS sd FROM T GROUP BY grp")
def warmup_mean(spark, d):
    return rounded(stats.warm_mean(view_t(spark, d), "time", "iteration", 2, ["grp"]), "mean", "sd", digits=6)


@query("WITH x AS (SELECT p_partkey AS id, p_brand AS key, s.system AS system, CASE WHEN s.system = 'cpu' THEN CAST(length(p_brand) AS DOUBLE) END AS value FROM part, (VALUES ('cpu'), ('gpu')) s(system)), b AS (SELECT key, min(value) AS f FROM x WHERE system = 'cpu' GROUP BY key) SELECT id, x.key AS key, system, coalesce(value, f) AS value FROM x LEFT JOIN b ON x.key = b.key")
def fill_missing(spark, d):
    p = _t(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("key"), F.explode(F.array(F.lit("cpu"), F.lit("gpu"))).alias("system"))
    x = p.withColumn("value", F.when(F.col("system") == "cpu", F.length("key").cast("double")))
    return stats.fill_missing(x, "value", ["key"], "system", "cpu")


@query("WITH a AS (SELECT DISTINCT c_nationkey AS k FROM customer WHERE c_acctbal > 5000), b AS (SELECT DISTINCT s_nationkey AS k FROM supplier) SELECT (SELECT count(*) FROM a WHERE k IN (SELECT k FROM b)) AS both, (SELECT count(*) FROM a WHERE k NOT IN (SELECT k FROM b)) AS only_a, (SELECT count(*) FROM b WHERE k NOT IN (SELECT k FROM a)) AS only_b, (SELECT count(*) FROM (SELECT k FROM a UNION SELECT k FROM b)) AS either")
def set_ops(spark, d):
    return stats.set_sizes(_t(spark, d, "customer").filter("c_acctbal > 5000").select(F.col("c_nationkey").alias("k")), _t(spark, d, "supplier").select(F.col("s_nationkey").alias("k")), "k")


@query("SELECT o_orderkey AS id, power(10.0, floor(log10(o_totalprice)) + CASE WHEN o_totalprice / power(10.0, floor(log10(o_totalprice)) + 1) > 0.5 THEN 1 ELSE 0 END) AS near FROM orders WHERE o_totalprice > 0")
def power_of_ten(spark, d):
    return _t(spark, d, "orders").filter("o_totalprice > 0").select(F.col("o_orderkey").alias("id"), fc.nearest_power_of_ten(F.col("o_totalprice")).alias("near"))


@query(f"WITH {G_SQL} SELECT count(*) AS edges, count(DISTINCT src) AS vertices, count(*) / CAST(count(DISTINCT src) * count(DISTINCT src) AS DOUBLE) AS sparsity FROM G")
def sparsity_ratio(spark, d):
    g = view_g(spark, d).agg(F.count("*").alias("edges"), F.countDistinct("src").alias("vertices"))
    return g.withColumn("sparsity", F.col("edges") / (F.col("vertices") * F.col("vertices")).cast("double"))


@query(f"WITH {T_SQL} SELECT grp, iteration, (iteration + 1) * 1000 / ((abs(time) + 1) / 1000) AS throughput, least(158.4e9, 422.4e9 * 0.171875) AS attainable FROM T")
def roofline(spark, d):
    t = view_t(spark, d).withColumns({"nnz": (F.col("iteration") + 1) * 1000, "ms": F.abs("time") + 1})
    return stats.roofline(t, "nnz", "ms", 422.4e9, 158.4e9, 11 / 64).select("grp", "iteration", "throughput", "attainable")


@query("SELECT max(event_id * 2 + 5) - min(event_id * 2) AS span FROM events")
def interval_span(spark, d):
    return stats.span(_t(spark, d, "events").select((F.col("event_id") * 2).alias("a"), (F.col("event_id") * 2 + 5).alias("b")), "a", "b")


@query("SELECT user_id, arg_max(event_id, event_id) AS last, row_number() OVER (ORDER BY user_id) - 1 AS n FROM events GROUP BY user_id")
def argmax_and_numbering(spark, d):
    g = _t(spark, d, "events").groupBy("user_id").agg(F.max_by("event_id", "event_id").alias("last"))
    return matrix.running_sum(g.withColumn("one", F.lit(1).cast("long")), "user_id", "one", "n").drop("one")


# --- generators and error model -----------------------------------------------------------------------------


@query("SELECT CAST(5000 AS BIGINT) AS n, TRUE AS degrees_ok, TRUE AS columns_ok, TRUE AS unit_rows, TRUE AS mean_ok, d AS distribution FROM (VALUES ('uniform'), ('gamma')) x(d)")
def gen_matrix(spark, d):
    out = None
    for name in ("uniform", "gamma"):
        r = generate.random_matrix(spark, 5000, 512, 20, name).groupBy("row").agg(F.count("*").alias("n"), F.min("col").alias("lo"), F.max("col").alias("hi"), F.sum(F.col("val") * F.col("val")).alias("sq"))
        low, high = (10, 30) if name == "uniform" else (1, 400)
        one = r.agg(
            F.count("*").alias("n"), F.every((F.col("n") >= low) & (F.col("n") <= high)).alias("degrees_ok"), F.every((F.col("lo") >= 0) & (F.col("hi") < 512)).alias("columns_ok"),
            F.every(F.abs(F.col("sq") - 1) < 1e-9).alias("unit_rows"), (F.abs(F.avg("n") - 20) < 1).alias("mean_ok"),
        ).withColumn("distribution", F.lit(name))
        out = one if out is None else out.unionAll(one)
    return out


@query("SELECT r.r AS rows, c.c AS cols, n.n AS degree, d.d AS distribution FROM (VALUES (5000000), (10000000), (15000000)) r(r), (VALUES (512), (1024)) c(c), (VALUES (20), (40)) n(n), (VALUES ('uniform'), ('gamma')) d(d)")
def param_grid(spark, d):
    return generate.parameter_grid(spark, rows=[5_000_000, 10_000_000, 15_000_000], cols=[512, 1024], degree=[20, 40], distribution=["uniform", "gamma"])


@query("SELECT CAST(1024 AS BIGINT) AS n, 1.0::DOUBLE AS length, 1.0::DOUBLE AS total")
def gen_vector(spark, d):
    a = generate.query_vector(spark, 1024, 3).agg(F.count("*").alias("n"), F.round(F.sum(F.col("val") * F.col("val")), 9).alias("length"))
    return a.crossJoin(generate.query_vector(spark, 1024, 3, sum_to_one=True).agg(F.round(F.sum("val"), 9).alias("total")))


@query("SELECT TRUE AS no_loops, TRUE AS distinct_targets, TRUE AS degrees_ok")
def gen_graph(spark, d):
    g = generate.random_graph(spark, 2000, 20).groupBy("src").agg(F.count("*").alias("n"), F.countDistinct("dst").alias("m"), F.max((F.col("src") == F.col("dst")).cast("int")).alias("loop"))
    return g.agg((F.max("loop") == 0).alias("no_loops"), F.every(F.col("n") == F.col("m")).alias("distinct_targets"), (F.max("n") < 20).alias("degrees_ok"))


@query()
def mc_error(spark, d):
    return error_model.mean_precision(error_model.monte_carlo(spark, 10_000, [8, 16, 32], [8, 16, 32, 50, 75, 100], 8, 5))


@query("SELECT parts, k, TRUE AS in_range, k <= 8 AS exact, TRUE AS better_with_parts FROM (VALUES (8), (16), (32)) p(parts), (VALUES (8), (16), (32), (50), (75), (100)) k(k)")
def mc_error_properties(spark, d):
    """What holds for any draw: shares between 0 and 1, no error up to the kept number, more parts no worse."""
    m = mc_error(spark, d)
    before = F.lag("precision").over(Window.partitionBy("k").orderBy("parts"))
    return m.withColumn("before", before).select("parts", "k", F.col("precision").between(0.0, 1.0).alias("in_range"), (F.col("k") <= 8).alias("exact"), (F.coalesce(F.col("precision") >= F.col("before") - 0.02, F.lit(True)) & ((F.col("k") > 8) | (F.col("precision") == 1))).alias("better_with_parts"))


def _choose(n: str, k: str) -> str:
    return f"exp(lgamma({n} + 1.0) - lgamma({k} + 1.0) - lgamma({n} - {k} + 1.0))"


_PRECISION = f"CASE WHEN k <= 8 THEN 1.0 WHEN 8 * parts < k THEN 0.0 ELSE 1 - parts * coalesce(list_sum(list_transform(range(9, least(1000 // parts, k)), lambda i: {_choose('(1000 // parts)', 'i')})), 0) / {_choose('1000', 'k')} END"


@query(f"SELECT parts, k, round({_PRECISION}, 6) AS precision FROM (VALUES (8), (16), (32)) p(parts), (VALUES (8), (16), (32), (50), (75), (100)) k(k)")
def closed_form(spark, d):
    return rounded(error_model.closed_form_table(spark, 1000, [8, 16, 32], [8, 16, 32, 50, 75, 100]), "precision", digits=6)


@query(f"SELECT parts, round(avg({_PRECISION}), 6) AS precision FROM (VALUES (8), (16), (32)) p(parts), (SELECT unnest(range(1, 101)) AS k) GROUP BY parts")
def closed_form_mean(spark, d):
    return rounded(spark.createDataFrame([(p, error_model.closed_form_mean(1000, p, 100, 8)) for p in (8, 16, 32)], "parts int, precision double"), "precision", digits=6)


@query("SELECT CAST(5000 AS BIGINT) AS n, TRUE AS in_range, TRUE AS all_met")
def gen_ints(spark, d):
    g = generate.random_ints(spark, 5000, 10)
    x = g.columns[-1]
    return g.agg(F.count("*").alias("n"), F.every((F.col(x) >= 0) & (F.col(x) < 10)).alias("in_range"), (F.countDistinct(x) == 10).alias("all_met"))


# --- files --------------------------------------------------------------------------------------------------


def _scratch(spark: SparkSession) -> str:
    """A new folder that all executors share, under ``spark.checkpoint.dir``; in local mode a temporary one, if none is set."""
    base = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not base and not is_local(spark):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return f"{base or tempfile.mkdtemp(prefix='nearfield-')}/files-{uuid.uuid4().hex}"


def _vertices(spark: SparkSession, d: str) -> tuple[int, int]:
    """Dimensions of the graph's matrix: the largest vertex and one more."""
    n = view_g(spark, d).agg(F.greatest(F.max("src"), F.max("dst"))).first()[0]
    return (0, 0) if n is None else (int(n) + 1, int(n) + 1)


@query(f"WITH {L_SQL} SELECT row, col, val FROM L")
def mtx_roundtrip(spark, d):
    coo, path = view_l(spark, d), f"{_scratch(spark)}/l.mtx"
    dims = coo.agg(F.max("row") + 1, F.max("col") + 1).first()
    mtx.write_mtx(coo, path, dims[0], dims[1], digits=17)
    return mtx.read_mtx(spark, path)


@query(f"WITH {G_SQL} SELECT src AS row, dst AS col, 1.0::DOUBLE AS val FROM G WHERE src <> dst")
def mtx_pattern(spark, d):
    path = f"{_scratch(spark)}/g.mtx"
    mtx.write_mtx(view_g(spark, d).select(F.col("src").cast("long").alias("row"), F.col("dst").cast("long").alias("col"), F.lit(1.0).alias("val")), path, *_vertices(spark, d), field="pattern")
    return mtx.read_mtx(spark, path, fast=True)


@query(f"WITH {G_SQL} SELECT CAST(src AS BIGINT) AS src, CAST(dst AS BIGINT) AS dst, 1.0 / count(*) OVER (PARTITION BY src) AS weight FROM G WHERE src <> dst")
def graph_load(spark, d):
    path = f"{_scratch(spark)}/g2.mtx"
    mtx.write_mtx(view_g(spark, d).select(F.col("src").cast("long").alias("row"), F.col("dst").cast("long").alias("col"), F.lit(1.0).alias("val")), path, *_vertices(spark, d), field="pattern")
    return mtx.load_graph(spark, path)


@query("SELECT event_id AS iteration, CAST(user_id AS BIGINT) AS error_idx, CAST(event_id AS VARCHAR) || ';' || CAST(user_id AS VARCHAR) AS ids, 2 * event_id + user_id AS total, 'hw' AS hardware, '512' AS cols, 'gamma' AS distribution FROM events")
def result_log(spark, d):
    e = _t(spark, d, "events")
    ids = F.array("event_id", "user_id")
    zero = F.lit(0.5)
    log = e.select(
        F.col("event_id").alias("iteration"), F.col("user_id").alias("error_idx"), F.lit(0).alias("error_val"),
        *(zero.alias(c) for c in ("sw_full_time_ms", "sw_topk_time_ms", "hw_setup_time_ms", "hw_exec_time_ms", "hw_full_exec_time_ms", "readback_time_ms")),
        F.lit(2).alias("k"), ids.alias("sw_res_idx"), F.transform(ids, lambda x: x * 1.0).alias("sw_res_val"), ids.alias("hw_res_idx"), F.transform(ids, lambda x: x * 2.0).alias("hw_res_val"),
    )
    path = f"{_scratch(spark)}/hw_1000_512_gamma_20_32_8_225_100_30.csv"
    result_logs.write_log(log, path, "fpga")
    back = result_logs.read_log(spark, path, "fpga")
    name = F.split(F.element_at(F.split(F.lit(path), "/"), -1), "_")
    return back.select(
        "iteration", "error_idx", F.array_join("sw_res_idx", ";").alias("ids"),
        (F.col("sw_res_idx")[0] + F.aggregate("hw_res_val", F.lit(0.0), lambda s, x: s + x).cast("long") / 2 + 0).cast("long").alias("total"),
        name[0].alias("hardware"), name[2].alias("cols"), name[3].alias("distribution"),
    )


@query(f"WITH {L_SQL}, n AS (SELECT max(row) + 1 AS rows FROM L), s AS (SELECT row, sum(val) AS v FROM L GROUP BY row) SELECT r.row AS row, CAST(0 AS BIGINT) AS col, coalesce(v, 0.0) AS val FROM (SELECT unnest(range((SELECT rows FROM n))) AS row) r LEFT JOIN s ON s.row = r.row")
def mtx_array(spark, d):
    """A dense file of one column: the totals of all rows, written and read back."""
    totals = view_l(spark, d).groupBy("row").agg(F.sum("val").alias("val")).withColumn("col", F.lit(0).cast("long"))
    path, rows = f"{_scratch(spark)}/dense.mtx", (totals.agg(F.max("row")).first()[0] or -1) + 1
    mtx.write_array(totals, path, rows, 1, digits=17)
    return mtx.read_mtx(spark, path)


def _log_cells(spark: SparkSession, d: str, kind: str) -> DataFrame:
    """Events as rows of a kind of log: numbers by the column's place, lists of two."""
    e = _t(spark, d, "events")
    cells = []
    for i, c in enumerate(result_logs.COLUMNS[kind]):
        if c.endswith("_res_idx"):
            cells.append(F.array("event_id", "user_id").alias(c))
        elif c.endswith("_res_val"):
            cells.append(F.array(F.col("event_id") * 0.5, F.lit(1.5)).alias(c))
        else:
            cells.append((F.col("event_id") * 10 + i).cast("double" if c.endswith("_ms") else "long").alias(c))
    return e.select(*cells)


def _log_back(spark: SparkSession, d: str, kind: str, file: str) -> DataFrame:
    path = f"{_scratch(spark)}/{file}"
    result_logs.write_log(_log_cells(spark, d, kind), path, kind)
    return result_logs.read_log(spark, path, kind)


def _log_sql(kind: str) -> str:
    cells = []
    for i, c in enumerate(result_logs.COLUMNS[kind]):
        if c.endswith("_res_idx"):
            cells.append(f"CAST(event_id AS VARCHAR) || ';' || CAST(user_id AS VARCHAR) AS {c}")
        elif c.endswith("_res_val"):
            cells.append(f"event_id * 0.5 + 1.5 AS {c}")
        else:
            cells.append(f"CAST(event_id * 10 + {i} AS {'DOUBLE' if c.endswith('_ms') else 'BIGINT'}) AS {c}")
    return f"SELECT {', '.join(cells)} FROM events"


def _log_view(df: DataFrame, kind: str) -> DataFrame:
    total = lambda c: F.aggregate(c, F.lit(0.0), lambda s, x: s + x)
    return df.select(*(F.array_join(c, ";").alias(c) if c.endswith("_res_idx") else total(c).alias(c) if c.endswith("_res_val") else F.col(c) for c in result_logs.COLUMNS[kind]))


@query(_log_sql("gpu"))
def result_log_gpu(spark, d):
    return _log_view(_log_back(spark, d, "gpu", "gpu_1000_512_gamma_20_csr_0_100_30.csv"), "gpu")


@query(_log_sql("gpu_full"))
def result_log_gpu_full(spark, d):
    return _log_view(_log_back(spark, d, "gpu_full", "gpu_1000_512_gamma_20_csr_0_30.csv"), "gpu_full")


@query(_log_sql("cpu"))
def result_log_cpu(spark, d):
    return _log_view(_log_back(spark, d, "cpu", "cpu_1000_512_gamma_20_100_30.csv"), "cpu")


@query("SELECT event_type AS graph, CAST(user_id AS BIGINT) AS iteration, round(log10(median(abs(value) + 1)), 6) AS log_error FROM events GROUP BY ALL")
def convergence_log(spark, d):
    """The error curve of each graph, written as a log and read back."""
    errors = _t(spark, d, "events").select(F.col("event_type").alias("graph"), F.col("user_id").cast("long").alias("iteration"), (F.abs("value") + 1).alias("error"))
    path = f"{_scratch(spark)}/convergence.csv"
    result_logs.write_log(graph.error_curve(errors), path, "convergence")
    return rounded(result_logs.read_log(spark, path, "convergence").select("graph", "iteration", F.col("log_error").cast("double").alias("log_error")), "log_error", digits=6)


@query("SELECT 'rank' AS graph, event_id AS iteration, event_id * 0.5 AS time_ms, event_id + 0.25 AS error_sum, CAST(2 AS BIGINT) AS lists, event_id + 2 * user_id + 7 AS vertex_sum FROM events")
def rank_log(spark, d):
    """A log of PageRank runs with lists of lists in its cells, read back."""
    e = _t(spark, d, "events")
    folder = _scratch(spark)
    cells = e.select(
        F.col("event_id").alias("iteration"), (F.col("event_id") * 0.5).alias("time_ms"), F.concat_ws(";", F.col("event_id").cast("string"), F.lit("0.25")).alias("errors"),
        F.concat(F.col("event_id").cast("string"), F.lit("|"), F.col("user_id").cast("string"), F.lit(";7|"), F.col("user_id").cast("string")).alias("vertices"),
    )
    cells.write.mode("overwrite").option("header", True).csv(f"{folder}/rank.csv")
    total = lambda c, zero: F.aggregate(c, zero, lambda s, x: s + x)
    return result_logs.read_rank_log(spark, f"{folder}/rank.csv").select(
        F.lit("rank").alias("graph"), "iteration", "time_ms", total("errors", F.lit(0.0)).alias("error_sum"), F.size("vertices").cast("long").alias("lists"), total(F.flatten("vertices"), F.lit(0).cast("long")).alias("vertex_sum"),
    )
