"""Approximate nearest neighbours by a robust-pruned directed graph, searched with a beam.

Vectors are normalised; equal ones are one node that carries its smallest ids. Nodes are dealt by a hash
to shards of at most about ``shard_rows``, and each shard gets a graph of its own: for batches of nodes a
greedy beam search proposes neighbours, relaxed distance pruning (a candidate is dropped when a kept
neighbour is ``alpha`` times nearer to it) keeps diverse edges, edges are also laid backwards, and lists
that overflow are pruned again. A query searches every shard with a beam and the shards' best are merged.
The final score is the cosine of the original vectors in double precision.

The graphs are built once and kept, shard by shard, in the shared checkpoint folder. A search leaves them where they
are: blocks of queries, of at most ``HELD`` bytes, are broadcast one after another, and each task searches its shards
one at a time. Since every query meets every shard, the searches grow with queries times shards.

Defined results: vectors that are null, empty, zero or hold null or non-finite components take no part,
neither do null ids; vectors of different lengths are not neighbours; repeated vectors and ties go to the
smaller id; a repeated id stands once, with its first vector in order; queries with fewer than k other
vectors get all; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import shared, table

DEGREE, BEAM, ALPHA = 32, 64, 1.2
HELD = 32 << 20


def _beam_search(vecs: np.ndarray, nbrs: np.ndarray, starts: np.ndarray, q: np.ndarray, beam: int, active_rows: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Greedy search of all queries at once: (ids, similarities) of the ``beam`` best met, best first.

    Each round every query that still has an unexpanded node in its beam expands the best one.
    """
    n, width = len(q), max(beam, len(starts))
    ids = np.full((n, width), -1, np.int32)
    ids[:, : len(starts)] = starts
    sims = np.full((n, width), -np.inf, np.float32)
    sims[:, : len(starts)] = q @ vecs[starts].T
    order = np.argsort(-sims, axis=1, kind="stable")
    ids, sims = np.take_along_axis(ids, order, 1)[:, :beam], np.take_along_axis(sims, order, 1)[:, :beam]
    done = ids < 0
    seen = np.zeros((n, len(vecs)), bool)
    seen[:, starts] = True
    live = np.arange(n)
    while len(live):
        open_ = ~done[live]
        has = open_.any(axis=1)
        live = live[has]
        if not len(live):
            break
        at = open_[has].argmax(axis=1)
        done[live, at] = True
        new = nbrs[ids[live, at]]
        ok = (new >= 0) & ~seen[live[:, None], new]
        row, at = np.nonzero(new >= 0)
        seen[live[row], new[row, at]] = True
        got = np.where(ok, np.einsum("qd,qrd->qr", q[live], vecs[np.where(ok, new, 0)], optimize=True), -np.inf).astype(np.float32)
        all_ids = np.concatenate([ids[live], np.where(ok, new, -1)], axis=1)
        all_sims = np.concatenate([sims[live], got], axis=1)
        all_done = np.concatenate([done[live], ~ok], axis=1)
        top = np.argpartition(-all_sims, beam - 1, axis=1)[:, :beam]
        top = np.take_along_axis(top, np.argsort(-np.take_along_axis(all_sims, top, 1), axis=1, kind="stable"), 1)
        ids[live], sims[live], done[live] = (np.take_along_axis(x, top, 1) for x in (all_ids, all_sims, all_done))
    return ids, sims


def _prune(vecs: np.ndarray, own: np.ndarray, cand: np.ndarray, degree: int, alpha: float) -> np.ndarray:
    """Robust pruning of candidate lists (rows of node ids, -1: none) for nodes ``own``: (B, degree) ids."""
    cand = np.sort(cand, axis=1)
    bad = (cand < 0) | (cand == own[:, None])
    bad[:, 1:] |= cand[:, 1:] == cand[:, :-1]
    c = vecs[np.where(bad, 0, cand)]
    # squared distances of unit vectors
    to_own = np.where(bad, np.inf, 2 - 2 * np.einsum("bd,bcd->bc", vecs[own], c, optimize=True))
    among = 2 - 2 * np.matmul(c, c.transpose(0, 2, 1))
    out = np.full((len(own), degree), -1, np.int32)
    rows = np.arange(len(own))
    for k in range(degree):
        best = to_own.argmin(axis=1)
        some = np.isfinite(to_own[rows, best])
        if not some.any():
            break
        out[some, k] = cand[rows[some], best[some]]
        near = alpha * alpha * among[rows, best] <= to_own
        near[rows, best] = True
        to_own[near] = np.inf
    return out


def build_graph(vecs: np.ndarray, degree: int = DEGREE, beam: int = BEAM, alpha: float = ALPHA, batch: int = 512, seed: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """(neighbours (n, degree) with -1 for none, start nodes) of a shard of unit vectors."""
    n = len(vecs)
    rng = np.random.default_rng(seed)
    nbrs = np.full((n, degree), -1, np.int32)
    starts = np.unique(np.concatenate([[int((vecs @ vecs.mean(axis=0)).argmax())], rng.choice(n, min(n, 8), replace=False)])).astype(np.int32)
    order = rng.permutation(n).astype(np.int32)
    # the first nodes know each other; later batches grow with the graph
    first = order[: min(n, degree)]
    nbrs[first, : len(first)] = np.where(first[None] == first[:, None], -1, first[None])
    nbrs[starts, : min(degree, len(first))] = first[: min(degree, len(first))]
    at = len(first)
    while at < n:
        rows = order[at : at + min(batch, max(32, at // 2))]
        at += len(rows)
        found, _ = _beam_search(vecs, nbrs, starts, vecs[rows], beam)
        # nodes of one batch may be each other's neighbours too
        if len(rows) > 1:
            mutual = vecs[rows] @ vecs[rows].T
            mine = rows[np.argsort(-mutual, axis=1)[:, : min(16, len(rows))]]
        else:
            mine = np.zeros((1, 0), np.int32)
        nbrs[rows] = _prune(vecs, rows, np.concatenate([found, nbrs[rows], mine], axis=1), degree, alpha)
        _lay_back(vecs, nbrs, rows, degree, alpha)
    return nbrs, starts


def _lay_back(vecs: np.ndarray, nbrs: np.ndarray, rows: np.ndarray, degree: int, alpha: float) -> None:
    """Add the edges of ``rows`` to the lists of their neighbours, pruning lists that overflow."""
    to, frm = nbrs[rows].ravel(), np.repeat(rows, degree)
    frm, to = frm[to >= 0], to[to >= 0]
    new = (nbrs[to] != frm[:, None]).all(axis=1)  # a list holds a node once
    frm, to = frm[new], to[new]
    by = np.argsort(to, kind="stable")
    frm, to = frm[by], to[by]
    nodes, first, count = np.unique(to, return_index=True, return_counts=True)
    held = (nbrs[nodes] >= 0).sum(axis=1)
    fits = held + count <= degree
    slot = np.arange(len(to)) - np.repeat(first, count) + np.repeat(held, count)
    room = np.repeat(fits, count)
    nbrs[to[room], slot[room]] = frm[room]
    full = np.flatnonzero(~fits)
    for lo in range(0, len(full), 256):
        part = full[lo : lo + 256]
        wide = np.full((len(part), degree + int(count[part].max())), -1, np.int32)
        wide[:, :degree] = nbrs[nodes[part]]
        for k, p in enumerate(part.tolist()):
            wide[k, degree : degree + count[p]] = frm[first[p] : first[p] + count[p]]
        nbrs[nodes[part]] = _prune(vecs, nodes[part], wide, degree, alpha)


def usable(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(vec_id, v array<double>) of the rows that take part."""
    v = F.col(vec_col).cast("array<double>")
    rows = df.select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v")).filter(F.col("vec_id").isNotNull() & (F.size("v") > 0) & F.exists("v", lambda x: x != 0))
    return rows.filter(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))))


def build_index(rows: DataFrame, shard_rows: int, copies: int, **graph) -> DataFrame:
    """(shard, node, v, ids, nbrs, start): the distinct vectors of all rows with their graph, materialised.

    ``ids`` are the ``copies`` smallest of a vector's ids, enough for any query.
    """
    few = Window.partitionBy("v").orderBy("vec_id")
    # the limit by row number is applied before the shuffle as well: a vector of very many ids is no hot key
    first = rows.withColumn("r", F.row_number().over(few)).filter(F.col("r") <= copies)
    nodes = shared(first.groupBy("v").agg(F.sort_array(F.collect_list("vec_id")).alias("ids")))
    n = nodes.count()
    shards = max(1, -(-n // shard_rows))
    dealt = nodes.withColumn("shard", F.concat_ws("/", F.size("v"), F.pmod(F.xxhash64("v"), F.lit(shards)))).repartition(shards, "shard")

    def build(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("ids", key=lambda s: s.map(lambda x: x[0])).reset_index(drop=True)
        vecs = np.stack(part["v"].to_list())
        nbrs, starts = build_graph(_unit(vecs), **graph)
        return pd.DataFrame({"shard": part["shard"], "node": np.arange(len(part), dtype=np.int32), "v": part["v"], "ids": part["ids"], "nbrs": list(nbrs), "start": np.isin(np.arange(len(part)), starts)})

    return shared(dealt.groupBy("shard").applyInPandas(build, "shard string, node int, v array<double>, ids array<long>, nbrs array<int>, start boolean"))


def _unit(v: np.ndarray) -> np.ndarray:
    v = v / np.abs(v).max(axis=1, keepdims=True)
    return (v / np.linalg.norm(v, axis=1, keepdims=True)).astype(np.float32)


def _scaled(v: np.ndarray) -> np.ndarray:
    """Vectors times powers of two that bring their largest component near 1: no cosine changes, no square overflows."""
    return np.ldexp(v, -np.frexp(np.abs(v).max(axis=-1, keepdims=True))[1])


def _cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Cosine of vector a and each row of b, in double precision."""
    a, b = _scaled(a), _scaled(b)
    return (b @ a) / (np.sqrt(a @ a) * np.sqrt(np.einsum("ij,ij->i", b, b)))


def _whole_shards(batches):
    """Tables of one shard each from batches in which a shard's rows follow one another."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        if not b.num_rows:
            continue
        names = b.column(0).to_pylist()
        cuts = [0, *(i for i in range(1, len(names)) if names[i] != names[i - 1]), len(names)]
        for a, z in zip(cuts, cuts[1:], strict=False):
            if held and held[0].column(0)[0].as_py() != names[a]:
                yield pa.Table.from_batches(held)
                held = []
            held.append(b.slice(a, z - a))
    if held:
        yield pa.Table.from_batches(held)


def _matrix(column: pa.ChunkedArray, kind) -> np.ndarray:
    """Rows of equally long lists."""
    flat = pa.concat_arrays([c.flatten() for c in column.chunks])
    return flat.to_numpy(zero_copy_only=False).astype(kind).reshape(len(column), -1)


def search(index: DataFrame, queries: DataFrame, k: int = 5, beam: int = 96, held: int = HELD) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found of each query (vec_id, v), itself left out."""
    spark = index.sparkSession
    n, width = queries.agg(F.count("*"), F.max(F.size("v"))).first()
    blocks = max(1, -(-n * 8 * ((width or 0) + 1) // held))
    block = F.pmod(F.xxhash64("vec_id", F.lit(5)), F.lit(blocks))
    found = None
    for i in range(blocks):
        asked: dict[int, tuple[list[int], list]] = {}
        for r in queries.filter(block == i).select("vec_id", "v").toLocalIterator():
            ids, vectors = asked.setdefault(len(r.v), ([], []))
            ids.append(r.vec_id)
            vectors.append(r.v)
        part = index.mapInArrow(_finder(spark.sparkContext.broadcast({d: (np.array(ids), np.array(vs)) for d, (ids, vs) in asked.items()}), k, beam), "query_id long, vec_id long, score double")
        found = part if found is None else found.unionAll(part)
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _finder(queries, k: int, beam: int):
    def find(batches):
        for shard in _whole_shards(batches):
            vecs, ids = _matrix(shard["v"], float), shard["ids"].to_pylist()
            if vecs.shape[1] not in queries.value:
                continue
            own, qs = queries.value[vecs.shape[1]]
            nbrs, starts = _matrix(shard["nbrs"], np.int32), np.flatnonzero(shard["start"].to_numpy()).astype(np.int32)
            unit, out = _unit(vecs), []
            for lo in range(0, len(own), 256):
                got, _ = _beam_search(unit, nbrs, starts, _unit(qs[lo : lo + 256]), min(beam, len(vecs)))
                for j, near in enumerate(got[:, : 4 * k + 4]):
                    near = near[near >= 0]
                    score = _cosines(qs[lo + j], vecs[near])
                    me = int(own[lo + j])
                    best = sorted((-s, i) for s, f in zip(score.tolist(), near.tolist(), strict=True) for i in ids[f] if i != me)[:k]
                    out += [(me, i, -s) for s, i in best]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True) if out else ([], [], []), (pa.int64(), pa.int64(), pa.float64()), strict=True)], names=["query_id", "vec_id", "score"])

    return find


def nearest(df: DataFrame, is_query, k: int = 5, shard_rows: int = 8192, id_col: str = "vec_id", vec_col: str = "embedding", **graph) -> DataFrame:
    """The k nearest of every row for which ``is_query`` (a column over vec_id) holds, among all rows."""
    rows = shared(usable(df, id_col, vec_col).groupBy("vec_id").agg(F.min("v").alias("v")))
    return search(build_index(rows, shard_rows, k + 1, **graph), rows.filter(is_query), k)


def op1_vamana(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five nearest vectors of every row whose vec_id is divisible by 50."""
    return nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)
