"""Properties and micro-fixtures of the similarity engine, and every catalogue query against its SQL."""

import math
import os

import duckdb
import pytest
from pyspark.sql import functions as F

from nearfield.functions import columns as fc
from nearfield.functions.params import Params, parse
from nearfield.index import SimilarityIndex
from nearfield.operators import error_model, generate, graph, matrix, rank_metrics, spmv, stats, topk
from nearfield.plans import catalogue, catalogue_stats  # noqa: F401
from nearfield.sources import mtx, result_logs
from nearfield.streaming.query_stream import answer_stream

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        if os.path.exists(f"{SF}/{t}.parquet"):
            con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", list(catalogue.QUERIES))
def test_query_against_sql(spark, duck, name):
    got = catalogue.QUERIES[name](spark, SF)
    if name not in catalogue.ORACLE_SQL:
        assert got.count() > 0
        return
    want = duck.sql(catalogue.ORACLE_SQL[name])
    assert sorted(got.columns) == sorted(want.columns)
    cols = sorted(got.columns)
    rows = lambda xs: sorted((tuple(round(v, 6) if isinstance(v, float) else v for v in x) for x in xs), key=str)
    assert rows(tuple(r[c] for c in cols) for r in got.collect()) == rows(want.select(*cols).fetchall())


def coo_of(spark, rows):
    return spark.createDataFrame(rows, "row long, col long, val double")


@pytest.fixture(scope="module")
def small(spark):
    # empty row 1, a repeated coordinate, tied scores, negatives, last column unused
    return coo_of(spark, [(0, 0, 1.0), (0, 2, 2.0), (0, 2, 1.0), (2, 1, -4.0), (3, 0, 1.0), (3, 2, 3.0), (4, 1, 1.0)])


@pytest.fixture(scope="module")
def vec(spark):
    return spark.createDataFrame([(0, 1.0), (1, 2.0), (2, 0.5), (3, 9.0)], "col long, val double")


def pairs(df):
    return [(r[0], r[1]) for r in df.collect()]


def test_products_and_topk(spark, small, vec):
    assert sorted(pairs(spmv.spmv(small, vec))) == [(0, 2.5), (2, -8.0), (3, 2.5), (4, 2.0)]
    assert sorted(pairs(spmv.spmv_full(small, vec))) == [(0, 2.5), (1, 0.0), (2, -8.0), (3, 2.5), (4, 2.0)]
    s = spmv.spmv(small, vec)
    assert pairs(topk.topk(s, 2)) == [(3, 2.5), (0, 2.5)]
    assert pairs(topk.topk(s, 9, "nonnegative")) == [(3, 2.5), (0, 2.5), (4, 2.0)]
    assert pairs(topk.topk(s, 9, "positive", 2.0)) == [(3, 2.5), (0, 2.5)]
    assert len(pairs(topk.padded(topk.topk(s, 9, "nonnegative"), 6))) == 6
    # with as many kept as wanted, partitions lose nothing
    assert pairs(topk.topk_partitioned(s, 5, 2, 3, 3)) == [(3, 2.5), (0, 2.5), (4, 2.0)]
    assert pairs(topk.topk_partitioned(s, 5, 1, 1, 3)) == [(3, 2.5)]
    assert topk.topk(s.limit(0), 3).count() == 0


def test_layouts(spark, small):
    assert [tuple(r) for r in matrix.csr_pointers(small).orderBy("row").collect()] == [(0, 3, 0), (1, 0, 3), (2, 1, 3), (3, 2, 4), (4, 1, 6)]
    assert matrix.pad_rows(small).filter("row = 1 AND col = 1 AND val = 0").count() == 1
    assert matrix.undirect(coo_of(spark, [(0, 0, 1.0), (0, 1, 2.0)])).count() == 3
    assert sorted(pairs(matrix.undirect_simple(coo_of(spark, [(0, 0, 1.0), (0, 1, 2.0), (1, 0, 5.0)])).select("row", "col"))) == [(0, 1), (1, 0)]
    assert matrix.num_rows(small.limit(0)) == 0 and matrix.num_rows(small) == 5
    wide = matrix.running_sum(spark.range(1000).withColumn("v", F.lit(2)), "id", "v", "s", bucket=64)
    assert all(r.s == 2 * r.id for r in wide.collect())


def test_packets(spark):
    # a row over three packets, more rows than lanes in one packet
    coo = coo_of(spark, [(0, c, 1.0) for c in range(25)] + [(r, 0, 1.0) for r in range(1, 8)])
    seg = matrix.packet_segments(coo, 1, 11).orderBy("packet", "row").collect()
    assert [(r.packet, r.row, r.entries, r.upto, r.starts) for r in seg][:4] == [(0, 0, 11, 11, True), (1, 0, 11, 11, False), (2, 0, 3, 3, False), (2, 1, 1, 4, True)]
    s = coo.groupBy("row").agg(F.sum("val").alias("score"))
    assert topk.topk_lanes(coo, s, 8, 1, 11, 4, 8, 100).count() == 4  # rows past the fourth lane are lost


def test_numbers(spark):
    df = spark.createDataFrame([(x,) for x in (0.0, 1.0, -0.3, 0.1, 65504.0, 1e6, 6e-8, 2049.0)], "v double")
    import numpy as np

    for r in df.withColumn("h", fc.half(F.col("v"))).collect():
        with np.errstate(over="ignore"):
            assert r.h == float(np.float16(r.v))
    q = df.filter("abs(v) <= 1").select("v", fc.quantise(F.col("v"), 20).alias("q"), fc.requantise(fc.quantise(F.col("v"), 32), 32, 20).alias("r")).collect()
    assert all(x.q == x.r == math.trunc(x.v * 2**19) for x in q)
    labels = spark.createDataFrame([(10000,), (5000,), (123,), (7,)], "v long").select(fc.exponent_label(F.col("v"))).collect()
    assert [r[0] for r in labels] == ["10^4", "5·10^3", "123", "7"]
    assert [r[0] for r in spark.createDataFrame([(488.0,), (560.0,)], "v double").select(fc.nearest_power_of_ten(F.col("v"))).collect()] == [100.0, 1000.0]


def test_metrics_of_equal_and_other_lists(spark):
    a = spark.createDataFrame([(0, r, 10 - r, 1.0 / r) for r in range(1, 9)], "list_id long, rank int, item long, score double")
    assert rank_metrics.ndcg(a, a).first().ndcg == pytest.approx(1) and rank_metrics.ndcg(a, a, "score").first().ndcg == pytest.approx(1)
    assert rank_metrics.kendall_tau(a, a).first().tau == pytest.approx(1)
    assert rank_metrics.edit_distance(a, a).first().distance == 0 and rank_metrics.precision_at(a, a, [4]).first().precision == 1
    swapped = a.withColumn("rank", F.when(F.col("rank") == 1, 2).when(F.col("rank") == 2, 1).otherwise(F.col("rank")).cast("int"))
    assert rank_metrics.positional_errors(a, swapped, (8,)).first().errors == 2
    assert rank_metrics.errors_but_swaps(a, swapped).first().errors == 1  # the second half of a swap is forgiven
    turned = a.withColumn("rank", (9 - F.col("rank")).cast("int"))
    assert rank_metrics.kendall_tau(a, turned).first().tau == pytest.approx(-1)
    alone = a.filter("rank = 1")
    assert rank_metrics.kendall_tau(alone, alone).count() == 0 or rank_metrics.kendall_tau(alone, alone).first().tau is None


def test_pagerank_keeps_mass(spark):
    edges = spark.createDataFrame([(0, 1), (1, 2), (2, 0), (0, 3)], "src long, dst long")
    ranks, rounds = graph.pagerank(edges, spark.range(4).withColumnRenamed("id", "v"), max_iter=60, max_err=1e-14)
    assert rounds < 60 and ranks.agg(F.sum("rank")).first()[0] == pytest.approx(1)


def test_error_model(spark):
    assert error_model.closed_form(1000, 8, 8, 8) == 1 and error_model.closed_form(1000, 8, 65, 8) == 0
    rows = error_model.mean_precision(error_model.monte_carlo(spark, 2000, [7, 16], [8, 32], 8, 4)).collect()
    for r in rows:
        assert r.precision == 1.0 if r.k == 8 else r.precision > 0.9


def test_mtx_files(spark, small, tmp_path):
    p = str(tmp_path / "a.mtx")
    mtx.write_mtx(small, p, 5, 4, digits=17)
    assert mtx.read_header(spark, p) == mtx.Header("coordinate", "real", "general", 5, 4, 7)
    key = lambda df: sorted(map(tuple, df.select("row", "col", "val").collect()))
    assert key(mtx.read_mtx(spark, p)) == key(small)
    assert key(mtx.read_mtx(spark, p, zero_indexed=True)) == sorted((r + 1, c + 1, v) for r, c, v in key(small))
    odd = tmp_path / "b.mtx"
    # the size line is also an entry; blank and cut-off lines; a loop; a symmetric header
    odd.write_text("%%MatrixMarket MATRIX Coordinate Real Symmetric\n% note\n\n3 3 3\n3 3 3\n2 1 0.5\n\n1 ")
    assert key(mtx.read_mtx(spark, str(odd))) == [(0, 1, 0.5), (1, 0, 0.5), (2, 2, 3.0)]
    assert key(mtx.read_mtx(spark, str(odd), directed=1)) == [(1, 0, 0.5), (2, 2, 3.0)]
    assert key(mtx.read_mtx(spark, str(odd), fast=True)) == [(0, 1, 1.0), (1, 0, 1.0)]
    for text, code in (("", 12), ("%%MatrixMarket matrix", 12), ("%%Other matrix coordinate real general", 14), ("%%MatrixMarket matrix coordinate text general", 15)):
        with pytest.raises(mtx.MtxError) as e:
            mtx.parse_banner(text)
        assert e.value.code == code
    assert not mtx.Header("array", "pattern", "general").valid and mtx.Header("coordinate", "real", "general").valid
    for name, text in (("col_val", "1.5 2.5 3.5"), ("col_ptr", "0 1 1 3"), ("col_idx", "2 0 1")):
        (tmp_path / f"{name}.txt").write_text(text)
    assert key(mtx.read_csc_text(spark, str(tmp_path))) == [(0, 2, 2.5), (1, 2, 3.5), (2, 0, 1.5)]


def test_logs(spark):
    df = spark.createDataFrame([("1;2", "1|2;3", "")], "a string, b string, c string")
    r = df.select(result_logs.list_cell(F.col("a"), "long"), result_logs.nested_cell(F.col("b"), "long"), result_logs.list_cell(F.col("c"), "long")).first()
    assert (r[0], r[1], r[2]) == ([1, 2], [[1, 2], [3]], [])


def test_index_stream_and_params(spark, tmp_path):
    coo = generate.random_matrix(spark, 300, 32, 8, "gamma", seed=4)
    index = SimilarityIndex(coo, parse(["-k", "10", "--parts", "4", "--keep", "8"]))
    q = generate.query_vector(spark, 32, 5)
    exact = pairs(index.search(q))
    assert len(exact) == 10 and exact == sorted(exact, key=lambda x: (-x[1], -x[0]))
    assert index.compare(q).first().precision >= 0.8
    batch = generate.query_batch(spark, 3, 32)
    assert index.search_batch(batch, 4).count() == 12
    batch.write.parquet(str(tmp_path / "q"))
    got = []
    stream = spark.readStream.schema(batch.schema).parquet(str(tmp_path / "q"))
    answer_stream(coo, stream, 4, lambda df, _: got.extend(df.collect()), str(tmp_path / "ck")).awaitTermination(120)
    assert sorted((r.query_id, r.row) for r in got) == sorted((r.query_id, r.row) for r in index.search_batch(batch, 4).collect())
    assert Params().packet == 11 and Params(width=21).packet == 14 and Params(width=20).packet == 15
    index.close()


def test_missing_baseline_must_agree(spark):
    df = spark.createDataFrame([("a", "cpu", 1.0), ("a", "cpu", 2.0), ("a", "gpu", None)], "key string, system string, value double")
    with pytest.raises(Exception, match="differ"):
        stats.fill_missing(df, "value", ["key"], "system", "cpu").collect()


def test_student_quantiles(spark):
    published = {1: 12.706, 2: 4.303, 10: 2.228, 30: 2.042, 31: 2.040, 48: 2.011, 80: 1.990, 100: 1.984, 120: 1.980, 1000: 1.962}
    rows = spark.createDataFrame([(n,) for n in published], "n long").select("n", stats.student_quantile(F.col("n")).alias("t")).collect()
    assert {r.n: round(r.t, 3) for r in rows} == published
    assert abs(stats.student_quantiles(0.99)[9] - 3.169) < 1e-3


def test_rank_of_all_rows(spark):
    df = spark.range(5000).select(F.col("id").alias("row"), ((F.col("id") * 7919) % 501).cast("double").alias("score"))
    got = [(r["row"], r["rank"]) for r in topk.rank_all(df).orderBy("rank").collect()]
    want = sorted(((i * 7919) % 501, i) for i in range(5000))[::-1]
    assert got == [(i, n + 1) for n, (_, i) in enumerate(want)]
    assert topk.rank_all(df.limit(0)).count() == 0


def test_packet_segments_against_counting(spark):
    import random

    rng = random.Random(3)
    entries = sorted((rng.randrange(40), rng.randrange(50), 1.0) for _ in range(700))
    want, part_rows = [], math.ceil(40 / 7)
    for part in range(7):
        inside = [e[0] for e in entries if e[0] // part_rows == part]
        runs = {}
        for n, row in enumerate(inside):
            runs[n // 5, row] = runs.get((n // 5, row), 0) + 1
        seen, upto = set(), {}
        for (packet, row), count in runs.items():
            upto[packet] = upto.get(packet, 0) + count
            want.append((part, packet, row, count, upto[packet], row not in seen))
            seen.add(row)
    got = matrix.packet_segments(coo_of(spark, entries), 7, 5, 40).select("part", "packet", "row", "entries", "upto", "starts").collect()
    assert sorted(map(tuple, got)) == sorted(want)


def _file(tmp_path, name, text):
    path = tmp_path / name
    path.write_text(text)
    return str(path)


def test_dense_files(spark, tmp_path):
    got = lambda text, **o: sorted((r.row, r.col, r.val) for r in mtx.read_mtx(spark, _file(tmp_path, f"d{abs(hash(text))}.mtx", text), **o).collect())
    assert got("%%MatrixMarket matrix array real general\n% c\n2 3\n1\n2\n3 4\n\n5\n6\n") == [(0, 0, 1), (0, 1, 3), (0, 2, 5), (1, 0, 2), (1, 1, 4), (1, 2, 6)]
    lower = "%%MatrixMarket matrix array real symmetric\n3 3\n" + "\n".join("123456")
    want = {(0, 0): 1, (1, 0): 2, (2, 0): 3, (1, 1): 4, (2, 1): 5, (2, 2): 6}
    assert got(lower) == sorted({(r, c, float(v)) for (a, b), v in want.items() for r, c in ((a, b), (b, a))})
    skew = "%%MatrixMarket matrix array integer skew-symmetric\n3 3\n1\n2\n3\n"
    assert got(skew) == sorted([(1, 0, 1), (2, 0, 2), (2, 1, 3), (0, 1, -1), (0, 2, -2), (1, 2, -3)])
    assert got("%%MatrixMarket matrix array real general\n2 2\n1\n2\n3\n4\n", read_values=False) == [(i, j, 1.0) for i in (0, 1) for j in (0, 1)]


def test_short_and_impossible_files(spark, tmp_path):
    short = _file(tmp_path, "short.mtx", "%%MatrixMarket matrix coordinate real general\n3 3 3\n1 1 5\n2 2 6\n")
    assert mtx.read_mtx(spark, short).count() == 2
    with pytest.raises(mtx.MtxError) as e:
        mtx.read_mtx(spark, short, strict=True)
    assert e.value.code == mtx.PREMATURE_EOF
    for kind in ("array pattern general", "coordinate real hermitian", "coordinate pattern skew-symmetric"):
        with pytest.raises(mtx.MtxError) as e:
            mtx.read_header(spark, _file(tmp_path, "x.mtx", f"%%MatrixMarket matrix {kind}\n1 1 1\n1 1\n"))
        assert e.value.code == mtx.UNSUPPORTED_TYPE


def test_program_and_sweep(spark, tmp_path):
    from nearfield import run

    coo = generate.random_matrix(spark, 300, 64, 8)
    path = str(tmp_path / "some_matrix.mtx")
    mtx.write_mtx(coo, path, 300, 64, digits=17)
    log = run.run(spark, parse(["-m", path, "-t", "2", "-k", "5", "-i", "exact"])).collect()
    assert [r.iteration for r in log] == [0, 1] and all(r.error_idx == r.error_val == 0 and len(r.hw_res_idx) == 5 for r in log)
    assert log[0].sw_res_val != log[1].sw_res_val
    same = run.run(spark, parse(["-m", path, "-t", "2", "-k", "5", "-r", "-v", "-a", "-c", "4", "-g", "5"])).collect()
    assert same[0].hw_res_idx == same[1].hw_res_idx and same[0].hw_setup_time_ms > 0
    paths = run.sweep(spark, str(tmp_path), [path], {"k": [3, 5], "impl": ["exact"], "iterations": [1]})
    back = [result_logs.read_log(spark, p, "fpga").first() for p in paths]
    assert [(r.k, len(r.hw_res_idx), r.file_rows) for r in back] == [(3, 3, "some-matrix"), (5, 5, "some-matrix")]


def test_layouts_of_rank_logs(spark, tmp_path):
    old = _file(tmp_path, "g1.csv", "iter,time_ms\n1,2.5\n")
    new = _file(tmp_path, "g2.csv", "iteration,time_ms,errors,vertices\n3,1.5,0.5;0.25,1|2;3\n4,1.0,,\n")
    assert result_logs.read_rank_log(spark, old).collect() == [("g1", 1, 2.5, [], [])]
    assert result_logs.read_rank_log(spark, new).collect() == [("g2", 3, 1.5, [0.5, 0.25], [[1, 2], [3]]), ("g2", 4, 1.0, [], [])]


def test_entry_without_the_corpus_operators(tmp_path):
    import subprocess
    import sys
    from pathlib import Path

    code = (
        "import sys, importlib.abc\n"
        "class Gone(importlib.abc.MetaPathFinder):\n"
        "    def find_spec(self, name, path, target=None):\n"
        "        if name.split('.')[0] in ('ahocorasick', 'zstandard'): raise ImportError(name)\n"
        "sys.meta_path.insert(0, Gone())\n"
        "import __spark_entry__ as e\n"
        "assert 'topk_exact' in e.queries() and 'op6_bpe' not in e.queries() and 'pipeline' not in e.oracle_sql()\n"
    )
    subprocess.run([sys.executable, "-c", code], cwd=Path(__file__).resolve().parent.parent, check=True)
