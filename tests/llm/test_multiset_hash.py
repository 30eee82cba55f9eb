import hashlib
import random
import re

import numpy as np
import xxhash
from pyspark.sql import functions as F

from nearfield.llm import multiset_hash as mh
from nearfield.llm.common import table


def spark_hash(text, i):
    # xxhash64(int, string): the hash of the 4-byte number seeds that of the string
    return xxhash.xxh64_intdigest(text.encode(), xxhash.xxh64_intdigest(int(i).to_bytes(4, "little"), 42))


def plain_vector(text):
    parts = [p for p in re.split(r"[\n\r]+|(?<=[.!?]) +", text) if p]
    wide, bits = [0] * 8, np.zeros(192, np.int64)
    for p in parts:
        hs = [spark_hash(p, i) for i in range(4)]
        for i, h in enumerate(hs):
            wide[2 * i] = (wide[2 * i] + h) % 2**32
            wide[2 * i + 1] = (wide[2 * i + 1] + (h >> 32)) % 2**32
        bits += np.array([h >> b & 1 for h in hs for b in range(48)])
    return len(parts), wide, bits


def plain_digest(v):
    pairs = v[2].reshape(96, 2)
    return "".join(f"{x:08x}" for x in v[1]) + "".join(f"{int(a) + (int(b) << 31):016x}" for a, b in pairs)


def plain_likeness(a, b):
    if a[0] == b[0] and a[1] == b[1]:
        return 1.0
    x, y = 2.0 * a[2] - a[0], 2.0 * b[2] - b[0]
    size = np.sqrt(x @ x) * np.sqrt(y @ y)
    return float(min(1, max(0, x @ y / size))) if size else 0.0


def check(spark, docs, got):
    order = sorted((d for d in docs if d[0] is not None), key=lambda d: (d[0], d[1] or ""))
    want = []
    for at, (i, t) in enumerate(order):
        want.append((i, t or "", order[(at + 1) % len(order)][1] or ""))
    want += [(None, t or "", "") for i, t in docs if i is None]
    rows = {}
    for r in got:
        rows.setdefault((r.doc_id, r.n_chars, r.edited_sha256), []).append(r)
    assert len(want) == len(got)
    for i, t, nxt in want:
        h = len(t) // 2
        edited = t[: len(t) - h] + nxt[:h]
        r = rows[i, len(t), hashlib.sha256(edited.encode()).hexdigest()].pop()
        v, e, n = plain_vector(t), plain_vector(edited), plain_vector(nxt)
        assert (r.fingerprint, r.edited_fingerprint) == (plain_digest(v), plain_digest(e))
        assert abs(r.near_edited - plain_likeness(v, e)) < 1e-9 and abs(r.near_next - plain_likeness(v, n)) < 1e-9


def test_query_against_plain(spark):
    sf = "/root/testdata/sf0.001"
    docs = [(r.doc_id, r.text) for r in table(spark, sf, "documents").collect()]
    check(spark, docs, mh.op2_multiset_hash(spark, sf).collect())


def test_runs_ties_and_nulls(spark, tmp_path):
    rng = random.Random(4)
    docs = [(rng.choice([i, i, 7, i * i * 1000]), "".join(rng.choice("ab. \né") for _ in range(rng.randrange(60)))) for i in range(300)]
    docs += [(None, "x. y"), (None, None), (-5, None), (9, "long. " * 40_000)]
    df = spark.createDataFrame([(i, t, 1) for i, t in docs], "doc_id long, text string, run int")
    out = mh.with_next(df, run_rows=16).select("doc_id", "text", "next_text").collect()
    order = sorted((d for d in docs if d[0] is not None), key=lambda d: (d[0], d[1] or ""))
    want = [(i, t or "", order[(k + 1) % len(order)][1] or "") for k, (i, t) in enumerate(order)] + [(None, "x. y", ""), (None, "", "")]
    assert sorted(map(tuple, out), key=str) == sorted(want, key=str)
    df.select("doc_id", "text").write.parquet(str(tmp_path / "documents.parquet"))
    check(spark, docs, mh.op2_multiset_hash(spark, str(tmp_path)).collect())
    assert mh.with_next(df.limit(0)).count() == 0


def test_insert_and_delete(spark):
    a, b = "one. two.\nthree", "four\nfive. two."
    df = spark.createDataFrame([(a, b, b + "\n" + a)], "a string, b string, both string")
    for c in ("a", "b", "both"):
        df = mh.with_vector(df, c, f"v{c}")
    r = df.select(mh.combine(F.col("va"), F.col("vb")) == F.col("vboth"), mh.combine(F.col("vboth"), F.col("vb"), -1) == F.col("va")).first()
    assert r == (True, True)


def test_lanes_are_independent(spark):
    """No hash is a function of another: paragraphs in pairs that agree in some bits of one differ in the others."""
    df = spark.range(20_000).select(mh.hash_paragraphs(F.concat(F.lit("p"), "id"))[0].alias("h")).select("h.*")
    bits = {c: F.col(c).bitwiseAND(F.lit(0x3FF)) for c in df.columns}
    for a, b in (("h0", "h1"), ("h1", "h2"), ("h2", "h3"), ("h0", "h3")):
        assert df.groupBy(bits[a].alias("a"), bits[b].alias("b")).count().filter("count > 6").count() == 0


def test_many_paragraphs_do_not_carry(spark):
    """The vectors of two million paragraphs: those of a thousand, added as often."""
    often = lambda v: F.struct((v["n"] * 2048).alias("n"), F.transform(v["wide"], lambda x: F.pmod(x * 2048, F.lit(1 << 32))).alias("wide"), F.transform(v["signs"], lambda x: x * 2048).alias("signs"))
    df = spark.range(1).select(F.repeat(F.lit("a\n"), 1024).alias("t"), F.repeat(F.lit("b\n"), 1024).alias("u"))
    df = mh.with_vector(mh.with_vector(df, "t", "v"), "u", "w").select(often(F.col("v")).alias("v"), often(F.col("w")).alias("w"))
    n, near, far, same = df.select(F.col("v.n"), mh.likeness(F.col("v"), mh.combine(F.col("v"), F.col("w"))), mh.likeness(F.col("v"), F.col("w")), mh.likeness(F.col("v"), F.col("v"))).first()
    ones = [np.array([1 if spark_hash(p, i) >> b & 1 else -1 for i in range(4) for b in range(48)]) for p in "ab"]
    cos = lambda x, y: x @ y / np.sqrt((x @ x) * (y @ y))
    assert n == 1 << 21 and same == 1 and abs(near - cos(ones[0], ones[0] + ones[1])) < 1e-9 and abs(far - max(0, cos(*ones))) < 1e-9
