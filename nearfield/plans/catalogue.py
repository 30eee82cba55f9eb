"""Named queries over the test tables and the SQL each is held against.

Views: E embeddings as (row, col, val); L customers x parts by quantity; Q part sizes as a vector for L; G trade
between nations as edges; T event values as a timing log. Every query runs over its whole tables. Scores that
leave a query as floating point are rounded, because the order of a sum is not fixed.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import columns as fc
from ..operators import graph, matrix, spmv, topk

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

E_SQL = "E AS (SELECT vec_id AS row, unnest(range(len(embedding))) AS col, CAST(unnest(embedding) AS DOUBLE) AS val FROM embeddings)"
L_SQL = "L AS (SELECT o_custkey AS row, l_partkey AS col, l_quantity AS val FROM orders JOIN lineitem ON o_orderkey = l_orderkey)"
Q_SQL = "Q AS (SELECT p_partkey AS col, CAST(p_size AS DOUBLE) AS val FROM part)"
G_SQL = "G AS (SELECT DISTINCT c_nationkey AS src, s_nationkey AS dst FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON o_orderkey = l_orderkey JOIN supplier ON l_suppkey = s_suppkey)"
T_SQL = "T AS (SELECT event_type AS grp, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) - 1 AS iteration, value AS time, user_id FROM events)"
S_SQL = f"{E_SQL}, S AS (SELECT a.row, sum(a.val * q.val) AS score FROM E a JOIN (SELECT col, val FROM E WHERE row = 0) q ON a.col = q.col GROUP BY a.row)"


def query(sql: str | None = None):
    """Register a query under its function name."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def view_e(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "embeddings").select(F.col("vec_id").alias("row"), F.posexplode("embedding").alias("col", "val")).withColumns({"val": F.col("val").cast("double"), "col": F.col("col").cast("long")})


def view_l(spark: SparkSession, d: str) -> DataFrame:
    o, li = _t(spark, d, "orders"), _t(spark, d, "lineitem")
    return o.join(li, o.o_orderkey == li.l_orderkey).select(F.col("o_custkey").alias("row"), F.col("l_partkey").alias("col"), F.col("l_quantity").alias("val"))


def once_l(spark: SparkSession, d: str) -> DataFrame:
    """L written once, for queries that read it more than once."""
    return graph.cut(view_l(spark, d))


def view_q(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "part").select(F.col("p_partkey").alias("col"), F.col("p_size").cast("double").alias("val"))


def view_g(spark: SparkSession, d: str) -> DataFrame:
    c, o, li, s = (_t(spark, d, n) for n in ("customer", "orders", "lineitem", "supplier"))
    j = c.join(o, c.c_custkey == o.o_custkey).join(li, o.o_orderkey == li.l_orderkey).join(s, li.l_suppkey == s.s_suppkey)
    return j.select(F.col("c_nationkey").alias("src"), F.col("s_nationkey").alias("dst")).distinct()


def view_t(spark: SparkSession, d: str) -> DataFrame:
    e = _t(spark, d, "events")
    n = F.row_number().over(Window.partitionBy("event_type").orderBy("ts", "event_id")) - 1
    return e.select(F.col("event_type").alias("grp"), n.alias("iteration"), F.col("value").alias("time"), "user_id")


def first_vector(e: DataFrame) -> DataFrame:
    return e.filter("row = 0").select("col", "val")


def e_scores(spark: SparkSession, d: str) -> DataFrame:
    e = view_e(spark, d)
    return spmv.spmv(e, first_vector(e))


def rounded(df: DataFrame, *cols: str, digits: int = 9) -> DataFrame:
    return df.withColumns({c: F.round(F.col(c), digits) for c in cols})


# --- products and top-k -------------------------------------------------------------------------------------


@query(f"WITH {L_SQL}, {Q_SQL} SELECT L.row AS row, sum(L.val * Q.val) AS score FROM L JOIN Q ON L.col = Q.col GROUP BY L.row")
def spmv_coo(spark, d):
    return spmv.spmv(view_l(spark, d), view_q(spark, d))


@query(f"WITH {L_SQL}, {Q_SQL}, s AS (SELECT L.row AS row, sum(L.val * Q.val) AS score FROM L JOIN Q ON L.col = Q.col GROUP BY L.row), n AS (SELECT unnest(range((SELECT max(row) + 1 FROM L))) AS row) SELECT n.row AS row, coalesce(score, 0.0) AS score FROM n LEFT JOIN s ON n.row = s.row")
def spmv_full(spark, d):
    return spmv.spmv_full(once_l(spark, d), view_q(spark, d))


@query(f"WITH {S_SQL} SELECT row, round(score, 9) AS score FROM S ORDER BY S.score DESC, row DESC LIMIT 20")
def topk_exact(spark, d):
    return rounded(topk.topk(e_scores(spark, d), 20), "score")


@query(f"WITH {S_SQL} SELECT row, round(score, 9) AS score FROM S WHERE S.score >= 0 ORDER BY S.score DESC, row DESC LIMIT 20")
def topk_reference_nonneg(spark, d):
    return rounded(topk.topk(e_scores(spark, d), 20, "nonnegative"), "score")


@query(f"WITH {L_SQL}, {Q_SQL}, s AS (SELECT L.row AS row, sum(L.val * Q.val) AS score FROM L JOIN Q ON L.col = Q.col GROUP BY L.row), n AS (SELECT unnest(range((SELECT max(row) + 1 FROM L))) AS row), f AS (SELECT n.row AS row, coalesce(score, 0.0) AS score FROM n LEFT JOIN s ON n.row = s.row) SELECT row, score FROM f ORDER BY score DESC, row DESC LIMIT 100")
def topk_all_rows(spark, d):
    return topk.topk(spmv.spmv_full(once_l(spark, d), view_q(spark, d)), 100)


@query(f"WITH {S_SQL} SELECT row, round(score, 9) AS score FROM S WHERE S.score > 0.1")
def spmv_threshold(spark, d):
    return rounded(e_scores(spark, d).filter("score > 0.1"), "score")


@query(f"WITH {S_SQL} SELECT row, round(score, 9) AS score, row_number() OVER (ORDER BY S.score DESC, row DESC) AS rank FROM S")
def argsort_scores(spark, d):
    return rounded(topk.rank_all(e_scores(spark, d)), "score")


@query(f"WITH {S_SQL}, k AS (SELECT row, score FROM S ORDER BY score DESC, row DESC LIMIT 20) SELECT least(100, count(*)) AS used, greatest(0, 100 - count(*)) AS missing FROM k")
def topk_size_check(spark, d):
    return topk.size_check(topk.topk(e_scores(spark, d), 20), 100)


@query(f"WITH {E_SQL}, q AS (SELECT col, val FROM E WHERE row = 0) SELECT vec_id AS row, round(list_sum(list_transform(list_zip(embedding, (SELECT list(val ORDER BY col) FROM q)), lambda x: CAST(x[1] AS DOUBLE) * x[2])), 9) AS score FROM embeddings")
def spmv_dense(spark, d):
    q = _t(spark, d, "embeddings").filter("vec_id = 0").select("embedding").first()[0]
    return rounded(spmv.spmv_dense(_t(spark, d, "embeddings"), q), "score")


def _fixed_sql(w: int) -> str:
    q = lambda c: f"CAST(sign({c}) * floor(abs({c}) * {float(1 << (w - 1))}) AS BIGINT)"
    return f"{E_SQL}, f AS (SELECT row, col, {q('val')} AS v FROM E), s AS (SELECT a.row AS row, CAST(sum((a.v * q.v) // {1 << (w - 1)}) AS BIGINT) AS score FROM f a JOIN (SELECT col, v FROM f WHERE row = 0) q ON a.col = q.col GROUP BY a.row)"


def _fixed(width: int):
    def run(spark, d):
        e = view_e(spark, d)
        return topk.topk(spmv.spmv_fixed(e, first_vector(e), width), 20)

    run.__name__ = f"topk_fixed_w{width}"
    return query(f"WITH {_fixed_sql(width)} SELECT row, score FROM s ORDER BY score DESC, row DESC LIMIT 20")(run)


for _w in (32, 26, 21, 20):
    _fixed(_w)


@query(f"WITH {_fixed_sql(32)}, m AS (SELECT max(row) + 1 AS n FROM E), r AS (SELECT row, score, row_number() OVER (PARTITION BY row // CAST(ceil(n / 32.0) AS BIGINT) ORDER BY score DESC, row DESC) AS k FROM s, m WHERE score > 0) SELECT row, score FROM r WHERE k <= 8 ORDER BY score DESC, row DESC LIMIT 100")
def topk_partitioned(spark, d):
    e = view_e(spark, d)
    return topk.topk_partitioned(spmv.spmv_fixed(e, first_vector(e)), matrix.num_rows(e), 32, 8, 100)


@query(f"""WITH {L_SQL}, {Q_SQL}, s AS (SELECT L.row AS row, sum(L.val * Q.val) AS score FROM L JOIN Q ON L.col = Q.col GROUP BY L.row), m AS (SELECT max(row) + 1 AS n FROM L),
p AS (SELECT row, row // CAST(ceil(n / 32.0) AS BIGINT) AS part, row_number() OVER (PARTITION BY row // CAST(ceil(n / 32.0) AS BIGINT) ORDER BY row, col, val) - 1 AS i FROM L, m),
e AS (SELECT part, row, max(i // 11) AS packet FROM p GROUP BY part, row),
z AS (SELECT part, row, row_number() OVER (PARTITION BY part, packet ORDER BY row) - 1 AS lane FROM e),
k AS (SELECT s.row AS row, score, row_number() OVER (PARTITION BY part, lane ORDER BY score DESC, s.row DESC) AS k FROM s JOIN z ON s.row = z.row WHERE lane < 4 AND score > 0)
SELECT row, score FROM k WHERE k <= 8 ORDER BY score DESC, row DESC LIMIT 100""")
def topk_lanes(spark, d):
    coo = once_l(spark, d)
    return topk.topk_lanes(coo, spmv.spmv(coo, view_q(spark, d)), matrix.num_rows(coo), 32, 11, 4, 8, 100)


@query(f"WITH {E_SQL} SELECT a.query_id AS query_id, a.row AS row, round(a.score, 9) AS score, a.rank AS rank FROM (SELECT q.row AS query_id, b.row AS row, sum(b.val * q.val) AS score, row_number() OVER (PARTITION BY q.row ORDER BY sum(b.val * q.val) DESC, b.row DESC) AS rank FROM E b JOIN E q ON b.col = q.col WHERE q.row < 8 GROUP BY q.row, b.row) a WHERE a.rank <= 20")
def multi_spmv(spark, d):
    e = view_e(spark, d)
    s = spmv.multi_spmv(e, e.filter("row < 8").withColumnRenamed("row", "query_id"))
    return rounded(topk.per_row_topk(s, 20, "query_id"), "score")


@query(f"WITH {E_SQL} SELECT col, 2.0 * val + 0.5 AS val FROM E WHERE row = 0")
def axpb(spark, d):
    return spmv.axpb(first_vector(view_e(spark, d)), 2.0, 0.5)


@query(f"WITH {E_SQL} SELECT round(sum(a.val * b.val), 9) AS dot FROM E a JOIN E b ON a.col = b.col WHERE a.row = 0 AND b.row = 1")
def dot_product(spark, d):
    e = view_e(spark, d)
    return rounded(spmv.dot(first_vector(e), e.filter("row = 1").select("col", "val")), "dot")


@query(f"WITH {E_SQL} SELECT round(sum((a.val - b.val) * (a.val - b.val)), 9) AS dist FROM E a JOIN E b ON a.col = b.col WHERE a.row = 0 AND b.row = 1")
def squared_distance(spark, d):
    e = view_e(spark, d)
    return rounded(spmv.squared_distance(first_vector(e), e.filter("row = 1").select("col", "val")), "dist")


# --- numbers ------------------------------------------------------------------------------------------------

_Q32 = "CAST(sign(val) * floor(abs(val) * 2147483648.0) AS BIGINT)"


@query(f"WITH {E_SQL} SELECT row, col, {_Q32} AS q, {_Q32} // 4096 AS q20, CAST({_Q32} AS DOUBLE) / 2147483648.0 AS v FROM E")
def quantize(spark, d):
    q = fc.quantise(F.col("val"))
    return view_e(spark, d).select("row", "col", q.alias("q"), fc.requantise(q, 32, 20).alias("q20"), fc.dequantise(q).alias("v"))


@query(f"WITH {E_SQL} SELECT row, round(sum(CAST(val AS FLOAT) * CAST(val AS FLOAT)), 4) AS sq FROM E GROUP BY row")
def float_mode(spark, d):
    v = F.col("val").cast("float")
    return view_e(spark, d).groupBy("row").agg(F.round(F.sum((v * v).cast("double")), 4).alias("sq"))


_HALF_E = "greatest(floor(log2(CASE WHEN val <> 0 THEN abs(val) ELSE 1 END)), -14)"


@query(f"WITH {E_SQL} SELECT row, col, CASE WHEN val = 0 THEN 0.0 WHEN r > 65504 THEN sign(val) * CAST('inf' AS DOUBLE) ELSE sign(val) * r END AS val FROM (SELECT row, col, val, round_even(abs(val) / power(2.0, {_HALF_E} - 10), 0) * power(2.0, {_HALF_E} - 10) AS r FROM E)")
def half_mode(spark, d):
    return view_e(spark, d).select("row", "col", fc.half(F.col("val")).alias("val"))


# --- matrices -----------------------------------------------------------------------------------------------


@query(f"WITH {L_SQL} SELECT row, col, val, row_number() OVER (PARTITION BY row ORDER BY col, val) AS n FROM L")
def sort_coo(spark, d):
    return matrix.sort_coo(view_l(spark, d)).withColumn("n", F.row_number().over(Window.partitionBy("row").orderBy("col", "val")))


@query(f"WITH {G_SQL} SELECT src AS row, dst AS col, 1.0::DOUBLE AS val FROM G UNION ALL SELECT dst, src, 1.0::DOUBLE FROM G WHERE src <> dst")
def undirect(spark, d):
    return matrix.undirect(view_g(spark, d).select(F.col("src").alias("row"), F.col("dst").alias("col"), F.lit(1.0).alias("val")))


@query(f"WITH {G_SQL} SELECT DISTINCT row, col, 1.0::DOUBLE AS val FROM (SELECT src AS row, dst AS col FROM G UNION ALL SELECT dst, src FROM G) WHERE row <> col")
def undirect_dedupe(spark, d):
    return matrix.undirect_simple(view_g(spark, d).select(F.col("src").alias("row"), F.col("dst").alias("col"), F.lit(1.0).alias("val")))


@query(f"WITH {L_SQL} SELECT row, col, min(val) AS val FROM L WHERE row <> col GROUP BY row, col")
def remove_self_loops(spark, d):
    return matrix.simple(view_l(spark, d))


@query(f"WITH {L_SQL}, n AS (SELECT unnest(range((SELECT max(row) + 1 FROM L))) AS row), g AS (SELECT n.row AS row, count(L.row) AS degree FROM n LEFT JOIN L ON n.row = L.row GROUP BY n.row) SELECT row, degree, CAST(coalesce(sum(degree) OVER (ORDER BY row ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS ptr FROM g")
def csr_ptr(spark, d):
    return matrix.csr_pointers(once_l(spark, d))


@query(f"WITH {L_SQL} SELECT row, count(*) AS entries, string_agg(CAST(col AS VARCHAR), ';' ORDER BY col, val) AS cols FROM L GROUP BY row")
def csr_rows(spark, d):
    return matrix.csr(view_l(spark, d)).select("row", F.size("entries").cast("long").alias("entries"), F.array_join(F.transform("entries", lambda x: x["col"].cast("string")), ";").alias("cols"))


@query(f"WITH {L_SQL} SELECT col AS row, count(*) AS entries, string_agg(CAST(row AS VARCHAR), ';' ORDER BY row, val) AS cols FROM L GROUP BY col")
def transpose_csc(spark, d):
    return matrix.csc(view_l(spark, d)).select("row", F.size("entries").cast("long").alias("entries"), F.array_join(F.transform("entries", lambda x: x["col"].cast("string")), ";").alias("cols"))


@query(f"WITH {L_SQL} SELECT row, col, val FROM L UNION ALL SELECT r, r, 0.0::DOUBLE FROM (SELECT unnest(range((SELECT max(row) + 1 FROM L))) AS r) WHERE r NOT IN (SELECT row FROM L)")
def pad_rows(spark, d):
    return matrix.pad_rows(once_l(spark, d))


@query(f"WITH {L_SQL}, m AS (SELECT max(row) + 1 AS n FROM L) SELECT row // CAST(ceil(n / 32.0) AS BIGINT) AS part, count(*) AS nnz, min(row) AS first_row, max(row) AS last_row, CAST(ceil(count(*) / 11.0) AS BIGINT) AS packets FROM L, m GROUP BY 1")
def partition_stats(spark, d):
    return matrix.partition_stats(once_l(spark, d), 32, 11)


@query(f"""WITH {L_SQL}, m AS (SELECT max(row) + 1 AS n FROM L), p AS (SELECT row, row // CAST(ceil(n / 32.0) AS BIGINT) AS part, row_number() OVER (PARTITION BY row // CAST(ceil(n / 32.0) AS BIGINT) ORDER BY row, col, val) - 1 AS i FROM L, m),
g AS (SELECT part, i // 11 AS packet, row, count(*) AS entries FROM p GROUP BY ALL)
SELECT part, packet, row, entries, CAST(sum(entries) OVER (PARTITION BY part, packet ORDER BY row) AS BIGINT) AS upto, packet = min(packet) OVER (PARTITION BY part, row) AS starts FROM g""")
def packet_segments(spark, d):
    return matrix.packet_segments(once_l(spark, d), 32, 11)


@query(f"WITH {L_SQL} SELECT row, sum(1.0::DOUBLE) AS total FROM L GROUP BY row")
def ones(spark, d):
    return matrix.ones(view_l(spark, d)).groupBy("row").agg(F.sum("val").alias("total"))


@query(f"WITH {L_SQL} SELECT row, col, round(val / sqrt(sum(val * val) OVER (PARTITION BY row)), 9) AS val FROM L")
def row_l2(spark, d):
    return rounded(matrix.row_l2(view_l(spark, d)), "val")


@query(f"WITH {Q_SQL} SELECT col, round(val - (SELECT avg(val) FROM Q), 9) AS val FROM Q")
def center(spark, d):
    return rounded(matrix.center(view_q(spark, d)), "val")


@query(f"WITH {Q_SQL}, t AS (SELECT sum(val) AS s, sqrt(sum(val * val)) AS l FROM Q) SELECT col, round(val / s, 12) AS unit_sum, round(val / l, 12) AS unit_length FROM Q, t")
def vec_norm(spark, d):
    q = view_q(spark, d)
    a, b = matrix.normalise(q, sum_to_one=True).withColumnRenamed("val", "unit_sum"), matrix.normalise(q).withColumnRenamed("val", "unit_length")
    return rounded(a.join(b, "col"), "unit_sum", "unit_length", digits=12)


@query(f"WITH {E_SQL} SELECT CAST(sum(CASE WHEN abs(a.val - b.val) > 0.1 THEN 1 ELSE 0 END) AS BIGINT) AS errors FROM E a JOIN E b ON a.col = b.col WHERE a.row = 0 AND b.row = 1")
def array_equality(spark, d):
    e = view_e(spark, d)
    return matrix.count_differences(first_vector(e), e.filter("row = 1").select("col", "val"), "col", 0.1)


@query(f"WITH {E_SQL} SELECT bool_and(val <= 0.9) AS ok FROM E")
def all_below(spark, d):
    return matrix.all_below(view_e(spark, d), "val", 0.9)


# --- graphs -------------------------------------------------------------------------------------------------


@query(f"WITH {G_SQL} SELECT src, count(*) AS degree, string_agg(CAST(dst AS VARCHAR), ';' ORDER BY dst) AS targets FROM G GROUP BY src")
def out_degree(spark, d):
    return graph.out_degree(view_g(spark, d)).select("src", "degree", F.array_join(F.transform("targets", lambda x: x.cast("string")), ";").alias("targets"))


@query(f"WITH {G_SQL} SELECT src, dst, 1.0 / count(*) OVER (PARTITION BY src) AS weight FROM G")
def edge_weights(spark, d):
    return graph.weighted(view_g(spark, d))


def _upward(spark, d):
    return view_g(spark, d).filter("src < dst"), _t(spark, d, "nation").select(F.col("n_nationkey").alias("v"))


@query(f"WITH {G_SQL} SELECT n_nationkey AS v FROM nation WHERE n_nationkey NOT IN (SELECT src FROM G WHERE src < dst)")
def dangling(spark, d):
    return graph.dangling(*_upward(spark, d))


def _pagerank_sql(rounds: int) -> str:
    # every round is its own CTE, over the edges that go upwards (so that some vertices dangle)
    head = f"{G_SQL}, e AS (SELECT src, dst, 1.0 / count(*) OVER (PARTITION BY src) AS w FROM G WHERE src < dst), n AS (SELECT n_nationkey AS v FROM nation), c AS (SELECT CAST(count(*) AS DOUBLE) AS n FROM n), r0 AS (SELECT v, 1.0 / c.n AS rank FROM n, c)"
    for i in range(1, rounds + 1):
        p = f"r{i - 1}"
        head += f", r{i} AS (SELECT n.v AS v, 0.85 * coalesce((SELECT sum(e.w * {p}.rank) FROM e JOIN {p} ON e.src = {p}.v WHERE e.dst = n.v), 0.0) + 0.15 / c.n + 0.85 / c.n * coalesce((SELECT sum(rank) FROM {p} WHERE v NOT IN (SELECT src FROM e)), 0.0) AS rank FROM n, c)"
    return f"WITH {head} SELECT v, round(rank, 9) AS rank FROM r{rounds}"


@query(_pagerank_sql(6))
def pagerank(spark, d):
    return rounded(graph.pagerank(*_upward(spark, d), max_iter=6)[0], "rank")


_CONV = "c AS (SELECT event_type AS graph, user_id AS vertex, row_number() OVER (PARTITION BY event_type, user_id ORDER BY ts, event_id) - 1 AS iteration, abs(value) + 1e-3 AS v FROM events), k AS (SELECT graph, vertex, iteration, v * power(10.0, -2.0 * iteration) AS error FROM c)"


def _convergence(spark, d):
    n = F.row_number().over(Window.partitionBy("event_type", "user_id").orderBy("ts", "event_id")) - 1
    c = _t(spark, d, "events").select(F.col("event_type").alias("graph"), F.col("user_id").alias("vertex"), n.alias("iteration"), (F.abs("value") + 1e-3).alias("v"))
    return c.select("graph", "vertex", "iteration", (F.col("v") * F.pow(F.lit(10.0), -2.0 * F.col("iteration"))).alias("error"))


@query(f"WITH {_CONV}, f AS (SELECT graph, vertex, min(iteration) AS first FROM k WHERE sqrt(error) <= 0.05 GROUP BY ALL) SELECT graph, round(avg(first), 9) AS rounds FROM f WHERE first > 0 GROUP BY graph")
def convergence(spark, d):
    return rounded(graph.first_converged(_convergence(spark, d), 0.05), "rounds")


@query(f"WITH {_CONV} SELECT graph, iteration, round(log10(median(error)), 6) AS log_error FROM k GROUP BY ALL")
def convergence_curve(spark, d):
    return rounded(graph.error_curve(_convergence(spark, d)), "log_error", digits=6)
