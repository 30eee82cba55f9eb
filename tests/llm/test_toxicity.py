import math
import random
import re
import zlib

import numpy as np
import zstandard

from nearfield.llm import toxicity as tx
from nearfield.llm.common import table


def test_held_out_ranking(spark):
    sf = "/root/testdata/sf0.1"
    labels = {r.doc_id: r.toxic for r in table(spark, sf, "labels").collect()}
    rows = tx.op4_toxicity(spark, sf).collect()
    assert len(rows) == table(spark, sf, "documents").count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)
    held = [(r.score, labels[r.doc_id]) for r in rows if r.held_out and r.doc_id in labels]
    pos, neg = [s for s, y in held if y], [s for s, y in held if not y]
    auc = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / len(pos) / len(neg)
    caught, false = sum(p >= 0.5 for p in pos) / len(pos), sum(n >= 0.5 for n in neg) / len(neg)
    print("auc", auc, caught, false)
    assert auc > 0.94 and caught > 0.8 and false < 0.02


def test_odd_rows(spark):
    docs = spark.createDataFrame([(1, None, 1.0), (None, "", 2.0), (3, "an idiot " * 20_000, 3.0), (3, "fine words", 4.0)], "doc_id long, text string, score double")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert [r.score for r in tx.score_documents(docs, none).collect()] == [0.0] * 4
    some = spark.createDataFrame([(i, i % 2) for i in range(40)] + [(None, 1), (41, None)], "doc_id long, toxic int")
    texts = spark.createDataFrame([(i, "plain words of some kind here" + (" idiot" if i % 2 else "")) for i in range(40)], "doc_id long, text string")
    got = tx.score_documents(texts.unionByName(docs.drop("score")), some).collect()
    assert len(got) == 44 and all(0 <= r.score <= 1 for r in got)
    assert tx.score_documents(docs.limit(0), some).count() == 0


def test_windows_against_plain_compression():
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abcdeéno") for _ in range(rng.randrange(2, 9)))
    common = [word() for _ in range(300)]
    texts = [" ".join(rng.choice(common) for _ in range(rng.randrange(0, 90))) for _ in range(60)]
    toxic = [t + " vile zorgs and zorgish brats " + t[::-1] for t in texts]
    m = tx.train(toxic, texts)
    for t in ["", "zorgs!", *texts[:10], *toxic[:10]]:
        words = re.findall(rb"[a-z\x80-\xff]+", t.lower().encode())
        words = [w[:4].upper() + w[4:] for w in words]
        parts = [b" " + b" ".join(words[i : i + 3]) + b" " for i in range(0, len(words), 3)]
        size = []
        for content in (m.ordinary, m.toxic):
            d = zstandard.ZstdCompressionDict(content + bytes(8) + b"#" * 64, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            c = zstandard.ZstdCompressor(level=6, dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False)
            size.append([len(c.compress(p + b"#" * 64)) for p in parts])
        gains = [a - b for a, b in zip(*size, strict=True)]
        assert gains == m.gains(parts).tolist()
        best = (sorted(gains, reverse=True) + [0, 0])[:2] if len(gains) > 1 else [*gains, 0, 0][:2]
        n = len(gains)
        up = [sum(g >= k for g in gains) for k in range(1, 8)]
        down = [sum(g <= -k for g in gains) for k in range(1, 4)]
        x = [math.log1p(c) for c in up] + [20 * c / max(1, n) for c in up] + [math.log1p(c) for c in down] + [math.log1p(n), *best]
        logit = sum(w * (v - a) / s for w, v, a, s in zip(m.weights[:-1], x, m.mean, m.scale, strict=True)) + m.weights[-1]
        assert abs(m.score([tx.words_of(t)])[0] - 1 / (1 + math.exp(-logit))) < 1e-9
    assert m.score([tx.words_of(t) for t in toxic]).min() > 0.5 > m.score([tx.words_of(t) for t in texts]).max()


def test_trainer_keeps_the_best_segments():
    rng = random.Random(1)
    words = ["".join(rng.choice("bcdfghklmn") + rng.choice("aeiou") for _ in range(4)) for _ in range(4000)]
    samples = [f"  {w}  {'disgusting' if i % 20 == 0 else ''}  ".encode() for i, w in enumerate(words)]
    assert b"disgust" in tx.trained(samples, 512)


def test_threshold_has_the_highest_f1():
    x, y = np.array([[0.0], [1], [1], [2], [3], [3], [4]]), np.array([0.0, 0, 1, 0, 1, 1, 1])
    weight = np.where(y == 1, 1.0, 3.0)
    mean, scale, w = tx.calibrate(x, y, weight)
    caught = (x[:, 0] - mean[0]) / scale[0] * w[0] + w[1] > 0
    f1 = lambda c: 2 * (c * y * weight).sum() / ((c * weight).sum() + (y * weight).sum())
    assert f1(caught) == max(f1(x[:, 0] > cut) for cut in (-1, 0.5, 1.5, 2.5, 3.5))
