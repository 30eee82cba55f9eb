import hashlib
import random

import numpy as np
import public_tokenizers
import tiktoken

from nearfield.llm import bpe
from nearfield.llm.common import table

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def library():
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(bpe.read_vocabulary(PATH)), special_tokens={})


def test_odd_texts():
    own, lib, rng = bpe.codec(bpe.read_vocabulary(PATH), public_tokenizers.PATTERN), library(), random.Random(1)
    texts = ["", " ", "  ", "  a b  c ", "a  b", "  x y", "\n a", "a" * 3000, "ab" * 2000, " " * 777, "=-" * 700, "é" * 999, "don't I'll", "a\x1cb \x1f", "́a"]
    for alphabet in ("abcdeinrstt é", " \n ab1.'s", [chr(i) for i in [*range(32, 127), *range(160, 700), *range(0x4E00, 0x4E50), *range(0x1F600, 0x1F640)]]):
        texts += ["".join(rng.choice(alphabet) for _ in range(rng.randrange(1, 90))) for _ in range(300)]
    for t in texts:
        ids = own.encode(t)
        assert ids == lib.encode_ordinary(t), t
        assert own.decode(ids) == t.encode()


def test_query_against_library(spark):
    sf, lib = "/root/testdata/sf0.01", library()
    got = {r.doc_id: r for r in bpe.op6_bpe(spark, sf).collect()}
    docs = table(spark, sf, "documents").select("doc_id", "text").collect()
    assert len(docs) == len(got)
    for d in docs:
        ids = lib.encode_ordinary(d.text or "")
        assert got[d.doc_id].n_tokens == len(ids)
        assert got[d.doc_id].ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert got[d.doc_id].decoded_sha256 == hashlib.sha256((d.text or "").encode()).hexdigest()


def test_odd_rows(spark):
    df = spark.createDataFrame([(1, None, 5), (None, "", 6), (3, "x y", 7), (3, "x y", 7)], "doc_id long, text string, n_tokens int")
    rows = bpe.encode(df).collect()
    assert sorted((r.n_tokens, len(r.ids)) for r in rows) == [(0, 0), (0, 0), (2, 2), (2, 2)]
    assert bpe.encode(df.limit(0)).count() == 0


def test_batches_against_library():
    lib, rng = library(), random.Random(4)
    own = bpe.Codec(bpe.read_ranks(bpe.read_vocabulary(PATH)), public_tokenizers.PATTERN, keep=50)  # generations change often
    syllables = ["th", "eau", "ing", "x", "Q", "é", "ß", "12", ",", "'s", "漢", "\n", " ", "  ", "\t", "\x1c", "\xa0"]
    texts = ["", "a", " a", "a ", "a\n", "a\n b", "a \nb", "\n a", "a  b c", "q" * 100 + " b", "word " * 50, "é" * 300 + " é"]
    texts += ["".join(rng.choice(syllables) + rng.choice(["", "", " "]) for _ in range(rng.randrange(1, 60))) for _ in range(600)]
    for at in range(0, len(texts), 37):
        part = texts[at : at + 37]
        got = own.encode_batch(part)
        for t, a, z, decimals, decoded in zip(part, got[1], got[1][1:], own.decimal_batch(*got), own.decode_batch(*got), strict=False):
            ids = lib.encode_ordinary(t)
            assert got[0][a:z].tolist() == ids, t
            assert decimals == ",".join(map(str, ids)).encode()
            assert decoded == t.encode()
    assert len(own.known.new) + len(own.known.old) < 2000


def test_pair_table_may_forget():
    own, lib = bpe.Codec(bpe.read_ranks(bpe.read_vocabulary(PATH)), public_tokenizers.PATTERN), library()
    own.pairs, own.fit_of = np.full(1 << 20, -1, np.int64), np.zeros(1 << 20, bool)
    left, right = np.arange(300, 1300), np.arange(1300, 2300)
    once = own.compatible(left, right)
    own.pairs[:] = -1
    assert (own.compatible(left, right) == once).all() and (own.compatible(left, right) == once).all()
    for a, b, fits in zip(left.tolist(), right.tolist(), once.tolist(), strict=True):
        joined = own.text_of[a] + own.text_of[b]
        assert (lib._encode_single_piece(joined) == [a, b]) == fits


def test_long_and_slow_pieces():
    lib, rng = library(), random.Random(9)
    own = bpe.Codec(bpe.read_ranks(bpe.read_vocabulary(PATH)), public_tokenizers.PATTERN)
    pieces = ["".join(rng.choice(a) for _ in range(n)) for a in ("ab", "eisnrt", "0123456789", "-=_*#", "éàèaeiou") for n in (1, 2, 7, 60, 900)]
    for some in (pieces, pieces[:1], pieces * 3):
        ids, ends = own.encode_pieces([p.encode() for p in some] + [b""])
        assert [ids[a:z].tolist() for a, z in zip(ends, ends[1:], strict=False)] == [lib._encode_single_piece(p.encode()) for p in some] + [[]]
    assert own._backtrack("ab" * 900) == lib._encode_single_piece(b"ab" * 900)


def test_pattern_that_crosses_spaces():
    pattern = r"\S+ \S+|\S+|\s+"
    own = bpe.codec(bpe.read_vocabulary(PATH), pattern)
    lib = tiktoken.Encoding("two", pat_str=pattern, mergeable_ranks=own.ranks, special_tokens={})
    for t in ("a b c d", "one two  three four five", "", " x "):
        assert own.encode(t) == lib.encode_ordinary(t)
