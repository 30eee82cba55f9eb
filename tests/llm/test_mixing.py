import random
import re

import pytest
from pyspark.sql import functions as F

from nearfield.llm import mixing
from nearfield.llm.common import table


def plain_sainte_lague(votes, seats, most):
    got = [0] * len(votes)
    for _ in range(seats):
        best = max((i for i in range(len(votes)) if got[i] < most[i] and votes[i] > 0), key=lambda i: (votes[i] / (2 * got[i] + 1), -i), default=None)
        if best is None:
            break
        got[best] += 1
    return got


def test_highest_quotients():
    rng = random.Random(2)
    for _ in range(300):
        n = rng.randrange(1, 12)
        votes = [rng.choice([0, 1, 5, rng.random() * 40]) for _ in range(n)]
        most = [rng.randrange(0, 60) for _ in range(n)]
        seats = rng.randrange(0, 80)
        assert mixing.sainte_lague(votes, seats, most) == plain_sainte_lague(votes, seats, most)


def test_targets():
    assert mixing.targets([100, 100, 100], [3, 1, 2]) == pytest.approx([200, 250 / 3, 500 / 3])
    assert mixing.targets([10, 0], [1, 1]) == [15, 0]
    assert mixing.targets([], []) == []


@pytest.mark.parametrize("opts", [{}, {"block_words": 7, "shard_docs": 90}])
def test_query_against_blocks(spark, opts):
    sf = "/root/testdata/sf0.01"
    docs = table(spark, sf, "documents").select("doc_id", "source", "text").withColumn("source", F.expr("nullif(source, 'src3')"))
    rows = mixing.mix(docs, **opts).collect()
    b = opts.get("block_words", 128)
    sizes = {}
    for r in rows:
        assert r.size == len(re.findall(r"[^\x20\x09-\x0D]+", r.text))
        sizes[r.source] = sizes.get(r.source, 0) + r.size
        # the same words one by one
        hits = [mixing.times(w // b, r.blocks, r.quota, r.u) for w in range(r.start, r.start + r.size)]
        assert sum(hits) == r.taken <= 2 * r.size
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    goal = dict(zip(order, mixing.targets([sizes[s] for s in order], [(3, 1, 2)[i % 3] for i in range(len(order))]), strict=True))
    for s in order:
        taken = sum(r.taken for r in rows if r.source == s)
        assert all(r.source_size == sizes[s] and r.target == goal[s] for r in rows if r.source == s)
        assert abs(taken - goal[s]) <= 0.03 * goal[s]
    again = {(r.doc_id, r.taken) for r in mixing.mix(docs.repartition(5), **opts).collect()}
    assert again == {(r.doc_id, r.taken) for r in rows}


def test_odd_rows(spark):
    df = spark.createDataFrame([(1, None, None, 1), (None, "", "a", 2), (3, "x y z", "a", 3), (3, "x y z", "a", 3), (None, "w", None, 4)], "doc_id long, text string, source string, size int")
    rows = mixing.mix(df, block_words=1).collect()
    assert sorted(r.size for r in rows) == [0, 0, 1, 3, 3] and all(r.taken <= 2 * r.size for r in rows)
    assert mixing.mix(df.limit(0)).count() == 0


def test_clashing_columns_and_repeated_ids(spark):
    rng = random.Random(7)
    rows = [(rng.choice([None, 5, 5, i]), " ".join(rng.choice("abc") for _ in range(rng.randrange(40))), rng.choice(["x", "y"]), "b", 1, 2, 3, 4.0) for i in range(3000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, blocks string, quota int, shard int, words int, target double")
    got = mixing.mix(df, shard_docs=100, block_words=4)
    assert set(df.columns) <= set(got.columns) and len(got.columns) == len(set(got.columns))
    got = got.collect()
    assert len(got) == len(rows) and all(r.shard == 2 and r.words == 3 for r in got)
    by = {}
    for r in got:
        by.setdefault((r.source, r.stream, r.blocks, r.quota, r.u), []).append(r)
    # null and repeated ids spread over the shards
    assert max(len(x) for x in by.values()) < 300 and len(by) > 20
    texts = lambda d: sorted((r.source, r.text) for r in mixing.mixed_documents(d, ("doc_id", "source"), shard_docs=100, block_words=4).collect())
    assert texts(df) == texts(df.repartition(7))


def test_long_text(spark):
    words = [f"w{i}" for i in range(60_000)]
    df = spark.createDataFrame([(1, " ".join(words), "a"), (2, "few words here", "a"), (3, "other source", "b")], "doc_id long, text string, source string")
    r = {r.doc_id: r for r in mixing.mix(df).collect()}[1]
    assert r.size == 60_000 and r.taken == sum(mixing.times(w // 128, r.blocks, r.quota, r.u) for w in range(r.start, r.start + r.size))
    assert sum(len(r.text.split()) for r in mixing.mixed_documents(df, ("doc_id", "source")).filter("doc_id = 1").collect()) == r.taken
