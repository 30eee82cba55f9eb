"""SimHash near-duplicates: 64-bit fingerprints linked within a Hamming radius through BK-trees.

A fingerprint has a bit set where over half of the document's shingle hashes have it set. Two fingerprints that
differ in at most ``radius`` bits agree on one of ``radius + 1`` bit blocks, so the distinct fingerprints are dealt
into shards by a block and its first bits, as many as leave about ``shard_rows`` fingerprints in a shard by their
count: every link lies inside some shard. Each shard gets a BK-tree, whose children are keyed by their Hamming
distance to the parent; a query follows only edges within the radius of its own distance. A shard that holds more
than twice as many is dealt again by ``radius + 1`` blocks of its remaining bits; what is still larger is cut into
chunks, and every pair of chunks becomes a task of its own, so no task holds more than two chunks and no link is
lost. A task returns a spanning forest of its links, not the links.

A tree goes to its queries by the shuffle that deals the shards. A broadcast passes through the driver, which would
hold the fingerprints of all documents, and has no bound.

Defined results: null and empty texts and texts without a word have fingerprint zero and link like any
other; a null id stays null and never becomes a component id; repeated rows and ids are kept, copies share
a component; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import shared, slices, small, table
from .components import connected_components

SEED = 42
BINS = 128
#: odd multipliers that order hashes: the first half deals texts into shards, the second deals large shards again
ROUTES = tuple(np.uint64(x) for x in (
    0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB,
    0x8EBC6AF09C88C6E3, 0x589965CC75374CC3, 0x1D8E4E27C47D124F, 0xEB44ACCAB455D165, 0x4CF5AD432745937F, 0x52DCE729DA3ED7E7,
))


def shingle_hashes(text: bytes, k: int = 4) -> np.ndarray:
    """Hashes of the ``k``-word shingles of UTF-8 text: A-Z lower-cased, words parted by ASCII white space."""
    words = text.lower().split()
    if not words:
        return np.array([], np.uint64)
    line = b" ".join(words)
    if len(words) <= k:
        return np.array([xxhash.xxh64_intdigest(line, SEED)], np.uint64)
    gaps = np.flatnonzero(np.frombuffer(line, np.uint8) == 32)
    n = len(words) - k + 1
    starts = [0, *(gaps[: n - 1] + 1).tolist()]
    ends = [*gaps[k - 1 :].tolist(), len(line)]
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(line[a:b], SEED) for a, b in zip(starts, ends, strict=True)), np.uint64, n)


def majority(hashes: np.ndarray) -> int:
    """A bit is set if it is set in over half of the hashes; no hashes: zero."""
    n = len(hashes)
    counts = np.zeros(64, np.int64)
    for at in range(0, n, 255):
        part = hashes[at : at + 255]
        counts += np.unpackbits(part.view(np.uint8), bitorder="little").reshape(-1, 64).sum(axis=0, dtype=np.uint8)
    return int(np.packbits(counts * 2 > n, bitorder="little").view(np.uint64)[0])


def fingerprint(text: bytes, k: int = 4) -> int:
    """SimHash of a text over its ``k``-word shingles, repeats included."""
    return majority(shingle_hashes(text, k))


def signature(hashes: np.ndarray) -> bytes:
    """The least shingle hash in each of ``BINS`` equal ranges of hash values, 16 bits each, 0 for none."""
    h = np.sort(hashes)
    out = np.zeros(BINS, np.uint16)
    if len(h):
        where = (h >> np.uint64(64 - BINS.bit_length() + 1)).astype(np.int64)
        first = np.flatnonzero(np.diff(where, prepend=-1))
        out[where[first]] = np.maximum(h[first] & np.uint64(0xFFFF), 1)
    return out.tobytes()


def resemblance(one: np.ndarray, many: np.ndarray) -> np.ndarray:
    """Estimated share of common shingles (Jaccard) of one signature and each row of ``many``."""
    some = (many != 0) | (one != 0)
    return ((many == one) & some).sum(axis=1) / np.maximum(1, some.sum(axis=1))


def with_fingerprint(docs: DataFrame, k: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp): one row per row of ``docs``; fp is the fingerprint's bits as a signed long."""

    def run(batches):
        for b in (part for batch in batches for part in slices(batch, 1)):
            fps = np.array([fingerprint(t or b"", k) for t in b.column(1).to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps)], names=["doc_id", "fp"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").cast("binary").alias("text"))
    return rows.mapInArrow(run, "doc_id long, fp long")


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _masks(bits: list[int], parts: int, most: int = 64) -> list[int]:
    """The first ``most`` of each of ``parts`` runs of bit places, as signed masks."""
    cuts = [len(bits) * i // parts for i in range(parts + 1)]
    return [_signed(sum(1 << b for b in bits[x:y][:most])) for x, y in zip(cuts, cuts[1:], strict=False)]


def block_keys(fp: Column, radius: int, most: int) -> Column:
    """Array of shard keys: the first ``most`` bits of each of ``radius + 1`` blocks; one key, if none."""
    if not most:
        return F.array(F.xxhash64(F.lit(0)))
    return F.array(*(F.xxhash64(F.lit(i), fp.bitwiseAND(F.lit(m))) for i, m in enumerate(_masks([*range(64)], radius + 1, most))))


def finer_block_keys(fp: Column, radius: int, most: int) -> Column:
    """For each key of :func:`block_keys` an array of keys over ``radius + 1`` blocks of the bits it leaves."""
    out = []
    for m in _masks([*range(64)], radius + 1, most):
        rest = [b for b in range(64) if not m >> b & 1]
        out.append(F.array(*(F.xxhash64(F.lit(j), fp.bitwiseAND(F.lit(x))) for j, x in enumerate(_masks(rest, radius + 1)))))
    return F.array(*out)


class BkTree:
    """A BK-tree over fingerprints in the order given: a node's children are keyed by their distance to it."""

    def __init__(self, fps: np.ndarray):
        self.fps = fps
        self.children: list[list[tuple[int, int]]] = [[] for _ in range(len(fps))]
        self.followed = 0  # edges followed so far, one for each query
        groups = [np.arange(len(fps))] if len(fps) else []
        while groups:
            group = groups.pop()
            node, rest = int(group[0]), group[1:]
            to = np.bitwise_count(fps[rest] ^ fps[node])
            order = np.argsort(to, kind="stable")
            to, rest = to[order], rest[order]
            cuts = [0, *(np.flatnonzero(to[1:] != to[:-1]) + 1).tolist(), len(rest)]
            for a, z in zip(cuts, cuts[1:], strict=False):
                if z > a:
                    self.children[node].append((int(to[a]), int(rest[a])))
                    if z > a + 1:
                        groups.append(rest[a:z])

    def near(self, queries: np.ndarray, radius: int) -> Iterator[tuple[int, np.ndarray]]:
        """Yield (node, indexes of the queries within ``radius`` of it). All queries descend together, each along
        the edges whose key is within ``radius`` of its distance to the node."""
        stack = [(0, np.arange(len(queries)))] if len(self.fps) else []
        while stack:
            node, asked = stack.pop()
            to = np.bitwise_count(queries[asked] ^ self.fps[node]).astype(np.int16)
            yield node, asked[to <= radius]
            for key, child in self.children[node]:
                follow = asked[np.abs(to - key) <= radius]
                if len(follow):
                    self.followed += len(follow)
                    stack.append((child, follow))


def _forest(nodes: np.ndarray, fps: np.ndarray, first: np.ndarray, radius: int, sigs: np.ndarray | None, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Edges of a spanning forest of one shard; ``first`` marks the chunk that makes the tree (all in both, if one).
    With signatures, a link also needs a resemblance of ``least``."""
    whole = first.all()
    base, asked = (np.arange(len(fps)), np.arange(len(fps))) if whole else (np.flatnonzero(first), np.flatnonzero(~first))
    label = np.arange(len(fps))
    for i, near in BkTree(fps[base]).near(fps[asked], radius):
        own = label[base[i]]
        at = asked[near]
        at = at[label[at] != own]  # links inside a component already found add nothing
        if len(at) and sigs is not None:
            at = at[resemblance(sigs[base[i]], sigs[at]) >= least]
        if len(at):
            both = np.append(label[at], own)
            label[np.isin(label, both)] = both.min()
    joined = np.flatnonzero(label != np.arange(len(fps)))
    return nodes[joined], nodes[label[joined]]


def _with_size(placed: DataFrame, hot: int) -> DataFrame:
    """Rows (node, key, ...) of shards of at least two, with the shard's size n. The rows of a shard of over ``hot``
    stay where they are: such keys are few, and are broadcast with their sizes."""
    sizes = placed.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1")
    large = F.broadcast(sizes.filter(F.col("n") > hot))
    rest = placed.join(large, "key", "left_anti").join(sizes.filter(F.col("n") <= hot), "key")
    return placed.join(large, "key").unionByName(rest)


def link_forest(nodes: DataFrame, keys: Column, finer: Callable[[Column, Column], Column], radius: int, shard_rows: int, least: float | None = None) -> DataFrame:
    """Edges (a, b) whose connected components are those of all links that lie inside some shard.

    ``nodes`` has node (long, distinct), fp and, if ``least`` is given, sig; ``keys`` is an array of shard keys.
    A shard of over 2 x ``shard_rows`` is dealt again by ``finer(route, key)``, an array of keys from the number of
    the key in ``keys`` and the key. Only nodes and keys are shuffled until the shards of one are gone.
    """
    cols = ["node", "fp"] + ["sig"] * (least is not None)
    hot = max(512, nodes.count() // 2_000)  # at most 2,000 such keys in each route
    placed = shared(_with_size(nodes.select("node", F.posexplode(keys).alias("route", "key")), hot))
    large = placed.filter(F.col("n") > 2 * shard_rows).join(nodes, "node").select("node", F.explode(finer(F.col("route"), F.col("key"))).alias("key"))
    dealt = placed.filter(F.col("n") <= 2 * shard_rows).select("node", "key", "n").unionByName(_with_size(large, hot).select("node", "key", "n"))
    cells = (
        dealt.join(nodes.select(*cols), "node")
        .withColumn("chunks", F.ceil(F.col("n") / (2 * shard_rows)).cast("long"))
        .withColumn("chunk", F.pmod(F.xxhash64("node", F.lit(7)), F.col("chunks")))
        .withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)))
        .select("key", F.least("chunk", "other").alias("lo"), F.greatest("chunk", "other").alias("hi"), "chunk", *cols)
    )

    def run(batches):
        rest = None
        for b in batches:
            cols = [b.column(i).to_numpy(zero_copy_only=False) for i in range(b.num_columns)]
            if rest is not None:
                cols = [np.concatenate(x) for x in zip(rest, cols, strict=True)]
            if not len(cols[0]):
                continue
            edge = np.flatnonzero((np.diff(cols[0]) != 0) | (np.diff(cols[1]) != 0) | (np.diff(cols[2]) != 0)) + 1
            last = int(edge[-1]) if len(edge) else 0
            rest = [c[last:] for c in cols]
            if last:
                yield from _solve([c[:last] for c in cols], edge[:-1])
        if rest is not None and len(rest[0]):
            yield from _solve(rest, np.array([], np.int64))

    def _solve(cols, cuts):
        lo, chunk, node, fps = cols[1], cols[3], cols[4], cols[5].view(np.uint64)
        outs = []
        for a, z in zip([0, *cuts.tolist()], [*cuts.tolist(), len(fps)], strict=True):
            if z - a > 1:
                sigs = np.frombuffer(b"".join(cols[6][a:z]), np.uint16).reshape(z - a, BINS) if least is not None else None
                outs.append(_forest(node[a:z], fps[a:z], chunk[a:z] == lo[a:z], radius, sigs, least or 0.0))
        if outs:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([o[i] for o in outs])) for i in (0, 1)], names=["a", "b"])

    return cells.repartition("key", "lo", "hi").sortWithinPartitions("key", "lo", "hi").mapInArrow(run, "a long, b long").distinct()


def near_duplicate_components(fps: DataFrame, radius: int = 4, shard_rows: int = 1024) -> DataFrame:
    """``fps`` (doc_id, fp) → (doc_id, fp, component_id): the least non-null id reachable over links."""
    fps = shared(fps)
    nodes = shared(fps.groupBy("fp").agg(F.min("doc_id").alias("rep")))
    most = max(0, (nodes.count() - 1) // shard_rows).bit_length()  # bits of a block that leave about shard_rows in a shard
    finer = lambda route, key: F.transform(F.get(finer_block_keys(F.col("fp"), radius, most), route), lambda x: F.xxhash64(key, x))
    labels = connected_components(link_forest(nodes.select(F.col("fp").alias("node"), "fp"), block_keys(F.col("fp"), radius, most), finer, radius, shard_rows))
    linked = nodes.join(labels.withColumnRenamed("node", "fp"), "fp", "left").withColumn("label", F.coalesce("label", "fp"))
    least = linked.groupBy("label").agg(F.min("rep").alias("component_id"))
    return fps.join(linked.join(least, "label").select("fp", "component_id"), "fp").select("doc_id", "fp", "component_id")


def _exact_forest(nodes: np.ndarray, sets: list[np.ndarray], first: np.ndarray, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """Edges of a spanning forest of the pairs whose sets of hashes have a Jaccard similarity of ``similarity``;
    ``first`` marks the chunk whose pairs with the other are meant (all pairs, if one)."""
    whole = first.all()
    sizes = np.array([len(s) for s in sets])
    ends = np.cumsum(sizes)
    codes = np.unique(np.concatenate(sets), return_inverse=True)[1].astype(np.int32)
    codes = [codes[e - n : e] for e, n in zip(ends.tolist(), sizes.tolist(), strict=True)]
    held = np.zeros(int(ends[-1]), np.uint8)
    label = np.arange(len(nodes))
    base, asked = (label.copy(), label.copy()) if whole else (np.flatnonzero(first), np.flatnonzero(~first))
    for i in base.tolist():
        at = asked[i + 1 :] if whole else asked
        at = at[label[at] != label[i]]  # links inside a component already found add nothing
        at = at[np.minimum(sizes[at], sizes[i]) / np.maximum(sizes[at], sizes[i]) >= similarity]
        if not len(at):
            continue
        held[codes[i]] = 1
        starts = np.cumsum(sizes[at]) - sizes[at]
        common = np.add.reduceat(held[np.concatenate([codes[j] for j in at.tolist()])], starts, dtype=np.int64)
        held[codes[i]] = 0
        at = at[common / (sizes[i] + sizes[at] - common) >= similarity]
        if len(at):
            both = np.append(label[at], label[i])
            label[np.isin(label, both)] = both.min()
    joined = np.flatnonzero(label != np.arange(len(nodes)))
    return nodes[joined], nodes[label[joined]]


def exact_links(texts: DataFrame, k: int, similarity: float) -> DataFrame:
    """Edges (a, b) whose components are those of all pairs within a ``label`` that share ``similarity`` of their
    distinct ``k``-word shingles. ``texts`` has label, chunks, node (long, distinct) and text (binary)."""

    def with_set(batches):
        for b in batches:
            sets = [np.unique(shingle_hashes(t, k)).tobytes() for t in b.column(3).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(sets, pa.binary())], names=["label", "chunks", "node", "set"])

    def solve(rows):
        if len(rows) < 2:
            return
        nodes, chunk = np.array([r[0] for r in rows], np.int64), np.array([r[1] for r in rows])
        a, b = _exact_forest(nodes, [np.frombuffer(r[2], np.uint64) for r in rows], chunk == rows[0][3], similarity)
        yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    def run(batches):
        at, rows = None, []
        for b in batches:
            for label, lo, hi, chunk, node, hashes in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if (label, lo, hi) != at:
                    yield from solve(rows)
                    at, rows = (label, lo, hi), []
                rows.append((node, chunk, hashes, lo))
        yield from solve(rows)

    cells = (
        texts.select("label", "chunks", "node", "text")
        .mapInArrow(with_set, "label long, chunks long, node long, set binary")
        .withColumn("chunk", F.pmod(F.xxhash64("node", F.lit(7)), F.col("chunks")))
        .withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)))
        .select("label", F.least("chunk", "other").alias("lo"), F.greatest("chunk", "other").alias("hi"), "chunk", "node", "set")
    )
    return cells.repartition("label", "lo", "hi").sortWithinPartitions("label", "lo", "hi").mapInArrow(run, "a long, b long").distinct()


def keep_one(docs: DataFrame, k: int = 5, similarity: float = 0.8, radius: int = 26, shard_rows: int = 1024, propose: float = 0.65, chunk_shingles: int = 1 << 20) -> DataFrame:
    """``docs`` (with doc_id and text) without near-duplicates: one row of each group stays, the one of the least id.

    Two texts are linked if they share ``similarity`` of their distinct ``k``-word shingles. Signatures only propose:
    texts with an estimate of ``propose``, over four standard errors lower, and fingerprints within ``radius`` form
    groups, and inside a group every pair is decided by the shingle hashes themselves. A group of more than
    ``chunk_shingles`` is cut into chunks that meet in pairs; only texts with a proposal are read again.

    The fingerprint here is over distinct shingles, as the similarity is. At 0.8 about 10 bits differ, 12 for a few
    shingles; a pair of that similarity lies beyond 26 with a chance of 2e-7 for long texts and 1.3e-5 at worst (sets
    of 4 and 5). Bit blocks are no use at such a radius; instead a text goes to the shards of its least shingle hashes
    under six multipliers, where two texts of that similarity miss each other in all six with a chance of 0.2^6. A
    large shard, of a shingle that very many texts hold, is dealt again by six more; a pair misses there with the same
    chance. Texts without a word are one group. Null ids come last in order.

    Rows that agree in id and text are one document. Columns of ``docs`` keep their names and values whatever they are.
    """
    half = len(ROUTES) // 2

    def run(batches):
        for batch in batches:
            for b in slices(batch, 3):
                nodes, fps, sigs, keys, more, sizes = [], [], [], [], [], []
                for t in b.column(3).to_pylist():
                    some = np.unique(shingle_hashes(t or b"", k))
                    fps.append(majority(some))
                    sigs.append(signature(some))
                    with np.errstate(over="ignore"):
                        least = [int((some * m).min().view(np.int64)) for m in ROUTES] if len(some) else [0] * len(ROUTES)
                    keys.append(least[:half])
                    more.append(least[half:])
                    nodes.append(xxhash.xxh64_intdigest(some.tobytes()))  # texts with the same shingles are one node
                    sizes.append(len(some))
                as_long = lambda x: pa.array(np.array(x, np.uint64).view(np.int64))
                longs = pa.list_(pa.int64())
                cols = [*b.columns[:3], as_long(nodes), as_long(fps), pa.array(sigs, pa.binary()), pa.array(keys, longs), pa.array(more, longs), as_long(sizes)]
                yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "k1", "k2", "node", "fp", "sig", "keys", "more", "size"])

    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    own_id = F.col("doc_id").cast("long")
    # a row's id and text in 128 bits
    keys = [F.xxhash64(F.lit(i), own_id.isNull(), F.coalesce(own_id, F.lit(0)), text).alias(f"k{i}") for i in (1, 2)]
    raw = docs.select(own_id.alias("doc_id"), *keys, text.cast("binary").alias("text"))
    rows = shared(raw.mapInArrow(run, "doc_id long, k1 long, k2 long, node long, fp long, sig binary, keys array<long>, more array<long>, size long"))
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "k1", "k2")
    nodes = shared(rows.groupBy("node").agg(F.min(order).alias("rep"), *(F.first(c).alias(c) for c in ("fp", "sig", "keys", "more", "size"))))
    seeded = F.transform("keys", lambda x, i: F.xxhash64(i, x))
    finer = lambda route, key: F.transform("more", lambda x, j: F.xxhash64(key, j, x))
    proposed = connected_components(link_forest(nodes, seeded, finer, radius, shard_rows, propose))
    groups = shared(proposed.join(nodes, "node").select("label", "node", "size", F.col("rep.k1").alias("k1"), F.col("rep.k2").alias("k2")))
    chunks = groups.groupBy("label").agg(F.ceil(F.sum("size") / chunk_shingles).cast("long").alias("chunks"))
    wanted = shared(groups.join(chunks, "label").select("label", "chunks", "node", "k1", "k2"))
    texts = raw.join(small(wanted, 40), ["k1", "k2"]).dropDuplicates(["node"])
    labels = connected_components(exact_links(texts, k, similarity))
    linked = nodes.select("node", "rep").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    kept = linked.groupBy("label").agg(F.min("rep").alias("rep")).select(F.col("rep.k1").alias("_kept1"), F.col("rep.k2").alias("_kept2"))
    whole = docs.select(keys[0].alias("_kept1"), keys[1].alias("_kept2"), F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_row"))
    # the rows meet their key once: the second exchange would be by the same columns
    return whole.join(kept, ["_kept1", "_kept2"], "left_semi").dropDuplicates(["_kept1", "_kept2"]).select(*(F.col("_row").getField(c).alias(c) for c in docs.columns))


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and near-duplicate component of every document."""
    out = near_duplicate_components(with_fingerprint(table(spark, sf_dir, "documents")))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
