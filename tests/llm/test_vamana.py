import numpy as np
from pyspark.sql import functions as F

from nearfield.llm import vamana
from nearfield.llm.common import table


def brute(rows, queries, k=5):
    good = {}
    for i, v in rows:
        if i is None or not v or any(x is None for x in v):
            continue
        a = np.array(v, float)
        if np.isfinite(a).all() and a.any():
            good[i] = a
    out = {}
    for q in queries:
        if q in good:
            a = good[q]
            s = [(-(a @ b) / (np.sqrt(a @ a) * np.sqrt(b @ b)), i) for i, b in good.items() if i != q and len(b) == len(a)]
            out[q] = sorted((round(x, 12), i) for x, i in s)[:k]
    return out


def result(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r.query_id, r.rank)):
        assert r.rank == len(out.setdefault(r.query_id, [])) + 1
        out[r.query_id].append((round(-r.score, 12), r.vec_id))
    return out


def test_query_recall(spark):
    sf = "/root/testdata/sf0.01"
    rows = [(r.vec_id, r.embedding) for r in table(spark, sf, "embeddings").collect()]
    want, got = brute(rows, range(0, 500, 50)), result(vamana.op1_vamana(spark, sf))
    assert got.keys() == want.keys() and all(len(v) == 5 for v in got.values())
    assert sum(len({i for _, i in got[q]} & {i for _, i in want[q]}) for q in want) >= 0.95 * 5 * len(want)
    for q in want:
        scores = dict((i, s) for s, i in brute(rows, [q], 499)[q])
        assert all(abs(scores[i] - s) < 1e-9 for s, i in got[q])


def test_recall_of_a_graph_on_random_vectors():
    rng = np.random.default_rng(2)
    u = vamana._unit(rng.standard_normal((3000, 24)))
    nbrs, starts = vamana.build_graph(u)
    q = vamana._unit(rng.standard_normal((50, 24)))
    got, _ = vamana._beam_search(u, nbrs, starts, q, 96)
    exact = np.argsort(-(q @ u.T), axis=1)[:, :5]
    assert np.mean([len(set(a[:5]) & set(b)) / 5 for a, b in zip(got.tolist(), exact.tolist(), strict=True)]) > 0.95
    assert (nbrs != np.arange(3000)[:, None]).all()
    for row in nbrs.tolist():
        held = [x for x in row if x >= 0]
        assert len(held) == len(set(held))
    assert all(len(set(x)) == len(x) for x in got.tolist())


def test_odd_rows_shards_and_ties(spark):
    rng = np.random.default_rng(3)
    base = rng.integers(-3, 4, (6, 4)).astype(float).tolist()
    rows = [(i, base[i % 6] if i % 3 else rng.standard_normal(4).tolist()) for i in range(120)]
    rows += [(200, None), (201, []), (202, [0.0] * 4), (203, [1.0, None, 2.0, 3.0]), (250, [1.0, float("nan"), 2.0, 3.0]), (251, [1.0, float("inf"), 2.0, 3.0]), (None, base[0]), (252, [1.0, 2.0]), (253, [2.0, 1.0]), (300, [1e300, 1e300, 1.0, 2.0][:2])]
    df = spark.createDataFrame([(i, v, 0) for i, v in rows], "vec_id long, embedding array<double>, shard int")
    got = result(vamana.nearest(df, F.col("vec_id") % 10 == 0, shard_rows=25))
    rows = [r for r in rows if r[0] != 300]
    got.pop(300, None)
    want = brute(rows, range(0, 260, 10))
    assert {q: v for q, v in got.items()} == want
    assert vamana.nearest(df.limit(0), F.col("vec_id") % 10 == 0).count() == 0


def test_huge_and_tiny_components(spark):
    rng = np.random.default_rng(4)
    rows = [(i, (rng.standard_normal(5) * (1e200, 1.0, 1e-200)[i % 3]).tolist()) for i in range(60)]
    got = result(vamana.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 10 == 0))
    small = [(i, (np.array(v) / np.abs(v).max()).tolist()) for i, v in rows]
    want = brute(small, range(0, 60, 10))
    assert got.keys() == want.keys()
    for q, found in got.items():
        assert [i for _, i in found] == [i for _, i in want[q]] and all(abs(a - b) < 1e-11 for (a, _), (b, _) in zip(found, want[q], strict=True))


def test_query_blocks(spark):
    rng = np.random.default_rng(5)
    rows = [(i, rng.standard_normal(6).tolist()) for i in range(300)]
    df = vamana.usable(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    index = vamana.build_index(df, 70, 6)
    once, often = (result(vamana.search(index, df.filter("vec_id % 5 = 0"), held=held)) for held in (1 << 20, 600))
    assert once == often == brute(rows, range(0, 300, 5))


def test_recall_of_clusters_in_full_shards():
    """Clustered vectors, more than one shard holds: every shard is searched, the best are merged."""
    rng = np.random.default_rng(6)
    centres = rng.standard_normal((150, 32)) * 3
    v = centres[rng.integers(0, 150, 12_000)] + rng.standard_normal((12_000, 32)) * 0.6
    u = vamana._unit(v)
    q = np.arange(0, 12_000, 200)
    exact = np.argsort(-(u[q] @ u.T), axis=1)[:, :6]
    best = [[] for _ in q]
    for rows in (np.arange(0, 12_000, 2), np.arange(1, 12_000, 2)):
        nbrs, starts = vamana.build_graph(u[rows])
        ids, sims = vamana._beam_search(u[rows], nbrs, starts, u[q], 96)
        for j in range(len(q)):
            best[j] += [(-s, rows[i]) for s, i in zip(sims[j, :24].tolist(), ids[j, :24].tolist(), strict=True)]
    recall = np.mean([len({i for _, i in sorted(b)[:6]} & set(e)) / 6 for b, e in zip(best, exact.tolist(), strict=True)])
    print("recall", recall)
    assert recall >= 0.95
