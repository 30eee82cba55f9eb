"""Lists of many queries: against whole numbers in plain Python, in small batches, and what they send through a shuffle."""

import random
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from nearfield.operators import batch_topk, rank_metrics
from nearfield.plans import catalogue, catalogue_stats  # noqa: F401


def odd_rows(seed: int, most: float) -> list[tuple]:
    """Repeated, null and negative ids, null components, null and empty arrays, other lengths, copies."""
    rng = random.Random(seed)
    v = lambda n: [float(np.float32(rng.uniform(-most, most))) for _ in range(n)]
    rows = [(rng.randrange(-40, 60), v(rng.choice([1, 3, 8]))) for _ in range(90)] + [(i, [0.125, -0.25, 0.375]) for i in range(100, 140)]
    rows += [(i, v(8)) for i in range(200, 300)] + [(20, None), (40, []), (21, None), (None, v(8)), (None, v(3))]
    return rows + [(rng.choice([0, 20, 7]), [x if rng.random() < 0.5 else None for x in v(8)]) for _ in range(10)] + [(400, [None, None]), (401, [None]), (420, [None, 0.5])]


def plain(rows: list[tuple], k: int, width: int, step: int = 20) -> list[tuple]:
    one = 1 << (width - 1)
    fixed = [(r, [None if x is None else int(x * one) for x in v]) for r, v in rows if v]
    score: dict = {}
    for q, a in fixed:
        if q is not None and q % step == 0:
            for r, b in fixed:
                terms = [(1 if x * y > 0 else -1) * (abs(x * y) // one) for x, y in zip(a, b, strict=False) if x is not None and y is not None]
                own = score.setdefault(q, {}).setdefault(r, [])
                own += terms
    low = -(10**30)
    out = []
    for q, of in score.items():
        order = sorted(of, key=lambda r: (-(sum(of[r]) if of[r] else low), -(low if r is None else r)))
        out += [(q, n + 1, r, sum(of[r]) / one if of[r] else None) for n, r in enumerate(order[:k])]
    return sorted(out, key=str)


@pytest.mark.parametrize(("seed", "most", "k"), [(1, 1.0, 7), (2, 1.4, 200), (3, 0.2, 25)])
def test_lists_against_whole_numbers(spark, seed, most, k):
    rows = odd_rows(seed, most)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    for held in (1 << 26, 40_000):  # one block of queries, and several
        got = batch_topk.fixed_lists(df, "row % 20 = 0", k, (32, 8), held=held)
        for width in (32, 8):
            assert sorted(map(tuple, got[width].collect()), key=str) == plain(rows, k, width)
    assert all(x.count() == 0 for x in batch_topk.fixed_lists(df.limit(0), "row % 20 = 0", k, (32, 8)).values())


def test_lists_in_small_batches():
    # an id over several batches, copies at the cut, more rows than results in each batch; sorted as the tasks get them
    rng = random.Random(5)
    rows = [(r, [rng.choice([-0.5, 0.25, 0.7]) for _ in range(4)]) for r in range(400)] + [(77, [0.9, 0.1])] * 9 + [(60, [0.3])] * 3
    rows.sort(key=lambda x: -x[0])
    t = pa.table({"row": pa.array([r for r, _ in rows], pa.int64()), "v": pa.array([v for _, v in rows], pa.list_(pa.float64()))})
    asked = t.filter(pa.array([r % 20 == 0 for r, _ in rows]))
    for size in (1, 5, 64, 1000):
        sent = SimpleNamespace(value=batch_topk._Queries(asked["row"].to_numpy(), *batch_topk._padded(asked["v"])))
        out = pa.Table.from_batches(batch_topk._finder(sent, 6, (32, 8))(t.to_batches(max_chunksize=size))).to_pylist()
        for width in (32, 8):
            got = {(x["list_id"], x["row"], x["score"] / (1 << (width - 1))) for x in out if x["width"] == width}
            assert got == {(q, r, s) for q, _, r, s in plain(rows, 6, width)}


def test_numbers_beyond_64_bits_are_errors():
    with pytest.raises(OverflowError):
        batch_topk.quantised(np.array([[np.nan]]), 32)
    big = batch_topk.quantised(np.array([[1e5]]), 32)
    with pytest.raises(OverflowError):
        batch_topk.candidates(big, big, 31, 1, np.array([batch_topk.NOTHING]))


@pytest.mark.parametrize("relevance", ["rank", "score"])
def test_bounded_ndcg_is_ndcg_of_cut_lists(spark, relevance):
    rng = random.Random(6)
    lists = lambda: spark.createDataFrame([(q, n + 1, i, 9.0 - n) for q, size in ((0, 12), (1, 7), (2, 3)) for n, i in enumerate(rng.sample(range(16), size))], "list_id long, rank int, item long, score double")
    ref, got = lists(), lists().filter("list_id <> 2")
    found = {(r.list_id, r.t): r.ndcg for r in rank_metrics.bounded_ndcg(ref, got, (3, 7, 10), relevance).collect()}
    assert set(found) == {(0, 3), (0, 7), (0, 10), (1, 3), (1, 7), (2, 3)}
    for t in (3, 7, 10):
        for r in rank_metrics.ndcg(ref, got, relevance, t).collect():
            assert (r.list_id, t) not in found or found[r.list_id, t] == pytest.approx(r.ndcg)


def shuffled(spark, run) -> int:
    """Rows written to shuffles by ``run``."""
    sc, jvm = spark.sparkContext._jsc.sc(), spark.sparkContext._jvm

    def total():
        sc.listenerBus().waitUntilEmpty()
        stages = sc.statusStore().stageList(None, False, False, spark.sparkContext._gateway.new_array(jvm.double, 0), jvm.java.util.ArrayList())
        return {(s.stageId(), s.attemptId()): s.shuffleWriteRecords() for s in (stages.apply(i) for i in range(stages.size()))}

    before = total()
    run()
    return sum(n for k, n in total().items() if k not in before)


@pytest.mark.parametrize("name", ["ndcg_sweep", "precision_sweep"])
def test_sweeps_do_not_shuffle_pairs(spark, tmp_path, name):
    # 2400 copies shifted from 1200 vectors: 120 queries, 288,000 pairs of a query and a row for each width
    e = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").filter("vec_id < 1200")
    e.unionAll(e.withColumn("vec_id", F.col("vec_id") + 1200)).coalesce(4).write.parquet(str(tmp_path / "embeddings.parquet"))
    results = []
    rows = shuffled(spark, lambda: results.extend(catalogue.QUERIES[name](spark, str(tmp_path)).collect()))
    assert len(results) == 120 * 6
    assert rows < 2 * 288_000
