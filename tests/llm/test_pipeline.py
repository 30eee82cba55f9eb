import re

import pytest
import xxhash

import corpus_pipeline as cp
from nearfield.llm import mixing, pii, simhash
from nearfield.llm.common import shared, table

SF = "/root/testdata/sf0.01"


def shingles(text, k=5):
    w = text.lower().encode().split()
    return {b" ".join(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


@pytest.fixture(scope="module")
def stages(spark):
    docs, out = table(spark, SF, "documents"), []
    for _, f in cp.STAGES:
        docs = shared(f(spark, docs, SF))
        out.append(docs)
    return out


def test_columns_and_filters(spark, stages):
    names = table(spark, SF, "documents").columns
    assert all(s.columns == names for s in stages[:-1])
    before, after = (stages[i].count() for i in (0, 1))
    total = table(spark, SF, "documents").count()
    assert 0.85 * total < before < total and 0.8 * before < after < before


def test_dedup_against_all_pairs(stages):
    docs = [(r.doc_id, r.text) for r in stages[0].collect()]
    sets = {i: shingles(t) for i, t in docs}
    up = {i: i for i, _ in docs}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    holds = {}
    for i, s in sets.items():
        for g in s:
            holds.setdefault(g, []).append(i)
    sure, maybe = {}, set()
    for i, s in sets.items():
        near = {}
        for g in s:
            for j in holds[g]:
                if j > i:
                    near[j] = near.get(j, 0) + 1
        for j, c in near.items():
            jac = c / len(s | sets[j])
            if jac >= 0.8:
                up[max(find(i), find(j))] = min(find(i), find(j))
            if 0.7 <= jac < 0.9:
                maybe |= {i, j}  # the signature may err near the threshold
    want = {find(i) for i in sets}
    got = {r.doc_id for r in stages[1].collect()}
    assert (want ^ got) <= maybe and len(want ^ got) <= 3


def test_masked(stages):
    for r in stages[2].collect():
        assert not pii.base_spans(r.text) and r.n_chars == len(r.text)
    unchanged = {r.doc_id: r.text for r in stages[1].collect() if not re.search("[0-9@]", r.text)}
    masked = {r.doc_id: r.text for r in stages[2].collect()}
    assert len(unchanged) > 500 and all(masked[i] == t for i, t in unchanged.items())


def test_mixed(stages):
    plan = {(r.doc_id, r.source): r.taken for r in mixing.mix(stages[2]).collect()}
    got = {}
    for r in stages[3].collect():
        got[r.doc_id, r.source] = got.get((r.doc_id, r.source), 0) + len(mixing.WORD.findall(r.text))
    assert got == {k: v for k, v in plan.items() if v}


def test_encoded(stages):
    rows = stages[4].collect()
    assert len(rows) == stages[3].count() and all(r.n_tokens == len(r.ids) for r in rows)


def test_keep_one_odd_rows(spark):
    rows = [(5, "a b c d e f g"), (3, "A b c d e F g"), (3, "A b c d e F g"), (None, "x y"), (None, "x y"), (None, "q r"), (7, None), (8, ""), (9, "w " * 20_000), (10, "w " * 20_000)]
    df = spark.createDataFrame([(i, t, "n") for i, t in rows], "doc_id long, text string, node string")
    got = sorted(((r.doc_id, (r.text or "")[:5]) for r in simhash.keep_one(df).collect()), key=str)
    assert got == sorted([(3, "A b c"), (None, "x y"), (None, "q r"), (7, ""), (9, "w w w")], key=str)
    assert simhash.keep_one(df.limit(0)).count() == 0


def test_signature_estimates(spark):
    a = [b"w%d" % i for i in range(900)]
    for cut in (0, 20, 60, 200):
        x, y = b" ".join(a), b" ".join(a[cut:] + [b"v%d" % i for i in range(cut)])
        exact = len(shingles(x.decode()) & shingles(y.decode())) / len(shingles(x.decode()) | shingles(y.decode()))
        import numpy as np

        sig = [np.frombuffer(simhash.signature(simhash.shingle_hashes(t, 5)), np.uint16) for t in (x, y)]
        assert abs(simhash.resemblance(sig[0], sig[1][None])[0] - exact) < 0.12
    assert xxhash.xxh64_intdigest(b"w0 w1 w2 w3 w4", 42) in simhash.shingle_hashes(b" ".join(a), 5).tolist()


def kept_by_all_pairs(docs, least=0.8):
    """Ids that stay if every pair of five-word shingle sets is compared."""
    sets = {i: shingles(t) for i, t in docs}
    group, pairs = {i: {i} for i in sets}, 0
    for i in sets:
        for j in sets:
            if i < j and len(sets[i] & sets[j]) / max(1, len(sets[i] | sets[j])) >= least:
                pairs += 1
                if group[i] is not group[j]:
                    group[i] |= group[j]
                    for x in group[j]:
                        group[x] = group[i]
    return {min(g) for g in group.values()}, pairs


@pytest.mark.parametrize("chunk_shingles", [1 << 20, 300])
def test_links_are_exact(spark, chunk_shingles):
    docs = []
    for base in range(80):  # pairs of 0.75 to 0.85, where an estimate of the similarity decides by chance
        words = [f"b{base}w{i}" for i in range(204)]
        for n in range(3):
            cut = 16 + (base + 7 * n) % 16
            docs.append((len(docs), " ".join(words[: 204 - cut] + [f"b{base}v{n}x{i}" for i in range(cut)] if n else words)))
    df = spark.createDataFrame(docs, "doc_id long, text string")
    want, pairs = kept_by_all_pairs(docs)
    got = {r.doc_id for r in simhash.keep_one(df, chunk_shingles=chunk_shingles).collect()}
    assert 40 < pairs < 200 and got == want


def test_repeats_do_not_part_near_copies(spark):
    docs = []
    for base in range(20):  # one line of twelve words twice, and ninety times; every third pair differs by a word
        rest, line = " ".join(f"b{base}w{i}" for i in range(100)), " ".join(f"b{base}l{i}" for i in range(12))
        docs += [(2 * base, f"{rest} {line} {line}"), (2 * base + 1, f"{'' if base % 3 else 'x '}{rest}" + f" {line}" * 90)]
    kept = simhash.keep_one(spark.createDataFrame(docs, "doc_id long, text string"))
    assert sorted(r.doc_id for r in kept.collect()) == [2 * base for base in range(20)]


def test_keep_one_with_clashing_columns(spark):
    rows = [(1, "a b c d e f", "x", 1, "p"), (2, "A b c d e f", "y", 2, "q"), (3, "other words stand in this one", "z", 3, "r")]
    df = spark.createDataFrame(rows, "doc_id long, text string, kept_id string, k1 int, node string")
    got = simhash.keep_one(df)
    assert got.columns == df.columns and sorted(tuple(r) for r in got.collect()) == [rows[0], rows[2]]


def test_hot_shingles_lose_no_link(spark):
    """A passage that all documents share makes their least shingles agree; shards of it are dealt again."""
    shared = " ".join(f"s{i}" for i in range(400))
    docs = []
    for base in range(60):
        own = [f"b{base}w{i}" for i in range(60)]
        docs.append((2 * base, shared + " " + " ".join(own)))
        docs.append((2 * base + 1, shared + " " + " ".join([*own[:-3], "x", "y", "z"])))
    want, _ = kept_by_all_pairs(docs)
    got = {r.doc_id for r in simhash.keep_one(spark.createDataFrame(docs, "doc_id long, text string"), shard_rows=4).collect()}
    assert got == want


def write_tables(spark, folder, rows, labels):
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, shard int, kept_id string, blocks string")
    df.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return df


def test_whole_pipeline_against_plain_steps(spark, tmp_path):
    """Nulls, empty and repeated texts, ties, long texts and clashing columns through all stages."""
    import hashlib

    import public_tokenizers
    import tiktoken

    from nearfield.llm import bpe

    long = " ".join(f"word{i % 977} x{i % 13}" for i in range(30_000))
    near = " ".join(f"n{i}" for i in range(120))
    texts = [None, "", "some plain words of a text", "some plain words of a text", "mail a.b@example.org now", "Ünïcode text über alles", long, near, near + " more", "   ", "\n\n", "a"]
    rows = [(i if i % 5 else None, t, ["en", None][i % 2], [None, "s1", "s2"][i % 3], len(t or ""), i, "k", "b") for i, t in enumerate(texts)]
    rows += [rows[4], rows[4]]
    docs = write_tables(spark, str(tmp_path), rows, [])
    kept = simhash.keep_one(docs.select(*cp.COLUMNS)).collect()
    sets = {}
    for r in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        words = frozenset(shingles(r[1] or ""))
        if not any(len(words & s) >= 0.8 * len(words | s) if words | s else True for s in sets):
            sets[words] = r
    assert {frozenset(shingles(r.text or "")) for r in kept} == set(sets) and len(kept) == len(sets)
    assert all(r.doc_id == sets[frozenset(shingles(r.text or ""))][0] for r in kept)
    stages, now = [], docs
    for _, f in cp.STAGES:
        now = shared(f(spark, now, str(tmp_path)))
        stages.append(now)
    assert sorted(map(str, stages[0].collect())) == sorted(str(r) for r in docs.select(*cp.COLUMNS).collect())  # no labels: all stay
    masked = {r.text for r in stages[2].collect()}
    assert "mail <EMAIL> now" in masked and long in masked
    lib = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(bpe.read_vocabulary(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))), special_tokens={})
    want = sorted((str(r.doc_id), lib.encode_ordinary(r.text), hashlib.sha256(r.text.encode()).hexdigest()) for r in stages[3].collect())
    assert want == sorted((str(r.doc_id), list(r.ids), r.decoded_sha256) for r in stages[4].collect()) and want


def test_pipeline_of_an_empty_table(spark, tmp_path):
    write_tables(spark, str(tmp_path), [], [])
    assert cp.run(spark, str(tmp_path)).count() == 0
