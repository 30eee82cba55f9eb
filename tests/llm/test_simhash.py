import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from nearfield.llm import simhash
from nearfield.llm.common import table

SF = "/root/testdata/sf0.01"


def plain_fingerprint(text, k=4):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in __import__("re").split(r"[\x20\x09-\x0D]+", words) if w]
    grams = [" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))] if words else []
    hs = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hs) * 2 > len(hs)) if hs else 0


def plain_components(rows, radius=4):
    fps = sorted({f for _, f in rows})
    up = {f: f for f in fps}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    arr = np.array(fps, np.uint64)
    for i, f in enumerate(fps):
        for j in np.flatnonzero(np.bitwise_count(arr ^ arr[i]) <= radius):
            up[find(fps[int(j)])] = find(f)
    least = {}
    for i, f in rows:
        if i is not None:
            least[find(f)] = min(i, least.get(find(f), i))
    return sorted(((i, f, least.get(find(f))) for i, f in rows), key=str)


def test_query_against_brute_force(spark):
    docs = [(r.doc_id, r.text) for r in table(spark, SF, "documents").collect()]
    want = plain_components([(i, plain_fingerprint(t)) for i, t in docs])
    got = [(r.doc_id, int(r.fingerprint, 16), r.component_id) for r in simhash.op10_simhash(spark, SF).collect()]
    assert sorted(got, key=str) == want


@pytest.mark.parametrize("shard_rows", [3, 4096])
def test_clusters_and_chunks(spark, shard_rows):
    rng = np.random.default_rng(3)
    base = rng.integers(0, 2**64, 40, np.uint64)
    rows = []
    for n in range(600):
        f = int(base[n % 40 if n % 3 else 0])
        for b in rng.choice(64, rng.integers(0, 5), replace=False):
            f ^= 1 << int(b)
        rows.append((n if n % 50 else None, f))
    df = spark.createDataFrame([(i, f - 2**64 if f >= 2**63 else f) for i, f in rows], "doc_id long, fp long")
    got = [(r.doc_id, r.fp % 2**64, r.component_id) for r in simhash.near_duplicate_components(df, shard_rows=shard_rows).collect()]
    assert sorted(got, key=str) == plain_components(rows)


def test_odd_rows(spark):
    rows = [(1, None, 0), (2, "", 0), (3, " \n", 0), (None, "a b c d e", 1), (5, "A b C d e", 1), (5, "A b C d e", 1), (6, "x", 2), (7, "w " * 30_000, 3)]
    df = spark.createDataFrame(rows, "doc_id long, text string, fp int")
    out = simhash.near_duplicate_components(simhash.with_fingerprint(df)).collect()
    got = sorted(((r.doc_id, r.component_id, r.fp % 2**64) for r in out), key=str)
    assert got == sorted(((i, {0: 1, 1: 5, 2: 6, 3: 7}[g], plain_fingerprint(t)) for i, t, g in rows), key=str)
    empty = df.filter(F.lit(False))
    assert simhash.near_duplicate_components(simhash.with_fingerprint(empty)).count() == 0


def test_tree_follows_only_edges_within_the_radius():
    rng = np.random.default_rng(5)
    base = rng.integers(0, 2**64, 700, np.uint64)
    fps = np.concatenate([base, base[:200] ^ (np.uint64(1) << rng.integers(0, 64, 200, np.uint64)), base[:20]])
    tree = simhash.BkTree(fps)
    edges = [(i, key, c) for i, children in enumerate(tree.children) for key, c in children]
    assert sorted(c for _, _, c in edges) == list(range(1, len(fps)))  # every node but the root has one parent
    assert all(int(np.bitwise_count(fps[i] ^ fps[c])) == key for i, key, c in edges)
    assert all(len({key for key, _ in children}) == len(children) for children in tree.children)
    radius, want = 2, {(i, j) for i in range(len(fps)) for j in np.flatnonzero(np.bitwise_count(fps ^ fps[i]) <= 2).tolist()}
    got = {(i, j) for i, near in tree.near(fps, radius) for j in near.tolist()}
    assert got == want

    def plain(node, q):  # edges a query follows
        to = int(np.bitwise_count(fps[node] ^ q))
        return sum(1 + plain(c, q) for key, c in tree.children[node] if abs(to - key) <= radius)

    assert tree.followed == sum(plain(0, q) for q in fps)
    assert len(fps) < tree.followed < 0.7 * len(fps) * len(fps)


def test_shards_are_answered_by_trees(spark, monkeypatch):
    """At sf0.01 the fingerprints of a shard go through a tree with edges to follow."""
    docs = [(r.doc_id, r.text) for r in table(spark, SF, "documents").collect()]
    fps = np.unique(np.array([plain_fingerprint(t) for _, t in docs], np.uint64))
    made = []

    class Counted(simhash.BkTree):
        def __init__(self, fps):
            super().__init__(fps)
            made.append(self)

    monkeypatch.setattr(simhash, "BkTree", Counted)
    simhash._forest(fps.view(np.int64), fps, np.ones(len(fps), bool), 4, None, 0.0)
    assert len(made) == 1 and made[0].followed > len(fps)


def test_hot_shards_are_dealt_again(spark):
    rng = np.random.default_rng(8)
    low = np.uint64(0x1234567)  # all agree in their first blocks
    base = (rng.integers(0, 2**64, 300, np.uint64) << np.uint64(28)) | low
    rows = []
    for n in range(900):
        f = int(base[n % 300])
        for b in rng.choice(64, rng.integers(0, 5), replace=False):
            f ^= 1 << int(b)
        rows.append((n, f))
    df = spark.createDataFrame([(i, f - 2**64 if f >= 2**63 else f) for i, f in rows], "doc_id long, fp long")
    got = [(r.doc_id, r.fp % 2**64, r.component_id) for r in simhash.near_duplicate_components(df, shard_rows=16).collect()]
    assert sorted(got, key=str) == plain_components(rows)


def test_components_with_hubs(spark, monkeypatch):
    from nearfield.llm import components

    monkeypatch.setattr(components, "HUB", 3)
    rng = np.random.default_rng(1)
    edges = [(0, i) for i in range(1, 80)] + [(i, i + 1) for i in range(100, 160)] + [(int(a), int(b)) for a, b in rng.integers(200, 320, (90, 2))] + [(500, 500)]
    up = {}

    def find(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in edges:
        if a != b:
            up[max(find(a), find(b))] = min(find(a), find(b))
    got = {r.node: r.label for r in components.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for x in up}
