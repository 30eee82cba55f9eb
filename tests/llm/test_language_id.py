import math
import zlib

import numpy as np

from nearfield.llm import language_id as li
from nearfield.llm.common import table


def test_gradients():
    rng = np.random.default_rng(1)
    net = li.Network(["a", "b", "c"])
    for w in (net.forth, net.back):
        w.table, w.u = w.table.astype(np.float64), w.u.astype(np.float64)
    net.w, net.b = net.w.astype(np.float64), net.b.astype(np.float64)
    x, y = rng.integers(0, 5, (7, 4)), rng.integers(0, 3, 4)
    _, grads = net.step(x, y)
    for w, g in zip(net.weights(), grads, strict=True):
        for _ in range(6):
            at = tuple(rng.integers(0, [min(5, s) if s == 256 else s for s in w.shape]))
            old, e = w[at], 3e-2
            w[at] = old + e
            up = net.step(x, y)[0]
            w[at] = old - e
            down = net.step(x, y)[0]
            w[at] = old
            assert abs((up - down) / (2 * e) - g[at]) < 2e-3


def test_positions_count_once():
    net = li.train([b"aaaa bbbb " * 9, b"cccc dddd " * 9], ["x", "y"], steps=30)
    for n in (1, 63, 64, 65, 128, 1000):
        assert abs(net.classify([b"aaaa bbbb " * 100, (b"cccc dddd " * 100)[:n], b""])[1].sum() - 1) < 1e-4
    assert net.classify([b"aaaa bbbb"])[0].argmax() == 0 and net.classify([b"cccc dd" * 50])[0].argmax() == 1


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    truth = {r.doc_id: r for r in table(spark, sf, "documents").collect()}
    got = li.op5_language_id(spark, sf).collect()
    assert len(got) == len(truth)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 for r in got)
    held = [r.lang_pred == truth[r.doc_id].lang for r in got if r.held_out and truth[r.doc_id].lang]
    print("accuracy", sum(held) / len(held), len(held))
    assert sum(held) / len(held) > 0.95


def test_odd_rows(spark):
    df = spark.createDataFrame([(i, "le chat et la souris. " * 4 if i % 2 else "the cat and the mouse. " * 4, "fr" if i % 2 else "en") for i in range(30)] + [(40, None, "en"), (41, "", None), (42, "123 !?", "en"), (None, "the mouse", None), (43, "the cat " * 30_000, None)], "doc_id long, text string, lang string").selectExpr("*", "1 AS score")
    got = {r.doc_id: r for r in li.predict(df).collect()}
    assert [got[i].lang_pred for i in (40, 41, 42)] == ["und"] * 3 and got[43].lang_pred == got[None].lang_pred == "en"
    assert {r.lang_pred for r in li.predict(df.selectExpr("doc_id", "text", "CAST(NULL AS string) AS lang")).collect()} == {"und"}
    assert li.predict(df.limit(0)).count() == 0


def plain_states(gru, data):
    h, state, out = gru.h, [0.0] * gru.h, []
    logistic = lambda v: 1 / (1 + math.exp(-v))
    for byte in data:
        rec = [sum(float(gru.u[i, j]) * state[j] for j in range(h)) for i in range(3 * h)]
        own = [float(gru.table[i, byte]) for i in range(3 * h)]
        z = [logistic(own[i] + rec[i]) for i in range(h)]
        r = [logistic(own[h + i] + rec[h + i]) for i in range(h)]
        n = [math.tanh(own[2 * h + i] + r[i] * rec[2 * h + i]) for i in range(h)]
        state = [n[i] + z[i] * (state[i] - n[i]) for i in range(h)]
        out.append(state)
    return out


def plain_probabilities(net, data):
    """Mean over all positions of a text, each in its window, one byte at a time."""
    total, n, size = [0.0] * len(net.labels), len(data), li.WINDOW
    starts = list(range(0, n - size + 1, size)) if n >= size else []
    windows = [(s, 0) for s in starts] + ([(max(0, n - size), n // size * size)] if n % size else [])
    for start, fresh in windows:
        part = data[start : start + size].ljust(size, b" ")
        forth, back = plain_states(net.forth, part), plain_states(net.back, part[::-1])[::-1]
        for i in range(size):
            if fresh <= start + i < n:
                s = forth[i] + back[i]
                v = [sum(float(net.w[c, j]) * s[j] for j in range(len(s))) + float(net.b[c, 0]) for c in range(len(net.labels))]
                e = [math.exp(x - max(v)) for x in v]
                total = [t + x / sum(e) for t, x in zip(total, e, strict=True)]
    return [t / n for t in total]


def test_documents_against_a_plain_network():
    net = li.train([b"the cat and the mouse " * 9, "le château de la mère ".encode() * 9, b"der hund und die maus " * 9], ["en", "fr", "de"], steps=20)
    texts = ["the cat", "la mère et le chat " * 3, "x", "der hund und die maus " * 6, "é" * 32, "a" * 64, "b" * 129]
    got = net.classify([t.encode() for t in texts])
    for t, p in zip(texts, got.tolist(), strict=True):
        assert np.allclose(p, plain_probabilities(net, t.encode()), atol=2e-5), t


def test_clashing_columns_and_repeated_rows(spark):
    rows = [(1, "the cat and the mouse " * 3, "en", "x", "y", 7)] * 3 + [(2, "le chat et la souris " * 3, "fr", None, "z", 8)] * 2
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, lang_pred string, score string, _text int")
    got = li.predict(df).collect()
    assert len(got) == 5 and len({(r.doc_id, r.lang_pred, r.score) for r in got}) == 2
