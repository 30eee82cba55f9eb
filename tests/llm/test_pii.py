import hashlib
import random
import re

import numpy as np
import pytest

from nearfield.llm import pii
from nearfield.llm.common import table

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def plain(text):
    out = []
    for kind, p in PATTERNS.items():
        for m in re.finditer(p, text):
            d = "".join(c for c in m.group() if c in "0123456789")
            if kind == "ip" and max(map(int, m.group().split("."))) > 255:
                continue
            if kind == "card" and not (16 <= len(d) <= 19 and sum(sum(map(int, str(int(c) * (1 + i % 2)))) for i, c in enumerate(d[::-1])) % 10 == 0):
                continue
            if kind == "phone" and not 8 <= len(d) <= 15:
                continue
            out.append((kind, *m.span()))
    return out


def test_base_patterns():
    rng = random.Random(1)
    for alphabet in ("a1@.-+ (0", "12345 -.+", "ab.@é٣5"):
        for _ in range(800):
            t = "".join(rng.choice(alphabet) for _ in range(70))
            assert pii.base_spans(t) == plain(t)
    assert pii.base_spans("9" * 50_000 + "a" * 50_000 + "@" * 10) == []


def test_gradients():
    rng, net = np.random.default_rng(0), pii.Tagger()
    for x in (net.forth, net.back):
        x.table, x.u = x.table.astype(float), x.u.astype(float)
    net.w, net.b, net.a = net.w.astype(float), net.b.astype(float), net.a.astype(float)
    x, y = rng.integers(0, 6, (9, 3)), rng.integers(0, 5, (9, 3))
    _, grads = net.step(x, y)
    for w, g in zip(net.weights(), grads, strict=True):
        for _ in range(5):
            at = tuple(rng.integers(0, [min(6, s) if s == 130 else s for s in w.shape]))
            old = w[at]
            w[at] = old + 0.02
            up = net.step(x, y)[0]
            w[at] = old - 0.02
            down = net.step(x, y)[0]
            w[at] = old
            assert abs((up - down) / 0.04 - g[at]) < 2e-3


@pytest.fixture(scope="module")
def tagger():
    prose = open(pii.__file__).read().split('"""')[1]
    return pii.train([prose, "the quick and the lazy went over there, with some of them. " * 20])


def test_finds_what_patterns_miss_and_leaves_numbers_alone(tagger):
    rng, hit, false = np.random.default_rng(9), 0, 0
    for i in range(200):
        d = "".join(map(str, rng.integers(0, 10, 30)))
        words = " over there with the lazy ones and some of the others went quick "
        good = [f"({d[:3]}) {d[3:6]}-{d[6:10]}", "4" + d[:14] + str((int(d[14]) + 1) % 10), f"{d[:3]}-{d[3:6]}-{d[6:10]}"][i % 3]
        a = words + good + words
        hit += any(s <= len(words) + 1 and z >= len(words) + len(good) - 1 for _, s, z in sum(pii.find_spans(tagger, [a])[0], []))
        bad = [f"in {1900 + i % 120}", f"{d[:4]}-{d[4:6]}-{d[6:8]}", "v1.2.3", f"${d[:3]}.{d[3:5]}", f"{d[:2]}:{d[2:4]}"][i % 5]
        false += bool(pii.find_spans(tagger, [words + bad + words])[0][1])
    print(hit, false)
    assert hit > 180 and false < 10


def test_windows_join_and_offsets(tagger):
    prose = "over there with the lazy ones " * 40
    text = "é\U0001f600" + prose + "john.smith@mail.example.com " + prose + "+1 (555) 123-4567 x"
    base, added = pii.find_spans(tagger, [text])[0]
    assert [text[a:z] for _, a, z in base] == ["john.smith@mail.example.com", "+1 (555) 123-4567"] and not added
    masked = pii.mask(text, base)
    assert "<EMAIL>" in masked and "<PHONE> x" in masked and masked.count(prose) == 2
    assert pii.mask("abcdef", [("ip", 1, 4), ("card", 2, 5)]) == "a<IP>f"


def test_query_against_plain(spark):
    sf = "/root/testdata/sf0.01"
    docs = {r.doc_id: r.text or "" for r in table(spark, sf, "documents").collect()}
    got = pii.op7_pii(spark, sf).collect()
    assert len(got) == len(docs)
    for r in got:
        want = plain(docs[r.doc_id])
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == kind for k, _, _ in want) for kind in pii.KINDS]
        written = [f"{k}:{a}:{z}" for k, a, z in want]
        assert r.base_sha256 == hashlib.sha256(",".join(written).encode()).hexdigest()
        assert set(written) <= set(r.spans.split(","))


def test_odd_rows(spark):
    df = spark.createDataFrame([(1, None, "x"), (None, "", "x"), (3, "a@b.c " * 3000, "x"), (3, "a@b.c", "x")], "doc_id long, text string, spans string")
    got = sorted((r.n_email, r.doc_id or 0) for r in pii.scan(df).collect())
    assert got == [(0, 0), (0, 1), (1, 3), (3000, 3)]
    assert pii.scan(df.limit(0)).count() == 0


def plain_near(text):
    out = [False] * len(text)
    for i, c in enumerate(text):
        if c in "0123456789@":
            for j in range(max(0, i - 24), min(len(text), i + 25)):
                out[j] = True
        if c == "@":
            a = i - (text[i - 1 : i] == " ")
            while a > max(0, i - 320) and not text[a - 1].isspace():
                a -= 1
            z = i + 1 + (text[i + 1 : i + 2] == " ")
            while z < min(len(text), i + 320) and not text[z].isspace():
                z += 1
            out[min(a, i) : max(z, i + 1)] = [True] * (max(z, i + 1) - min(a, i))
    return out


def odd_texts(rng):
    long = "".join(rng.choice("abcdefgh") for _ in range(60))
    texts = [f"some words {long} @ {long}.{long}.org and more", f"{long * 7} @ host.org 12", "x@y", "@", " @ ", "1", "a" * 100 + "7" + "b" * 100, "(555) 123-4567"]
    for alphabet in ("ab @.1", "abcdefghé \n1@", "0123456789 -().+ab@", "\xa0a@1 "):
        texts += ["".join(rng.choice(alphabet) for _ in range(rng.randrange(1, 500))) for _ in range(60)]
    return texts


def test_places_near_signs():
    for t in odd_texts(random.Random(3)):
        if pii.SIGN.search(t):
            assert pii.near_signs(t, pii.codes(t)).tolist() == plain_near(t), t


def test_windows_left_out_have_no_say(tagger):
    """The same spans as with every window decoded, and the votes of all windows counted one by one."""
    for t in odd_texts(random.Random(4)):
        (some,), (whole,) = tagger.tags([t]), tagger.tags([t], everywhere=True)
        base = pii.base_spans(t)
        if some is None:
            assert whole is None and not pii.reconcile(t, some, base)
            continue
        assert (some == whole).all() and pii.reconcile(t, some, base) == pii.reconcile(t, whole, base)
        x, votes = pii.codes(t), np.zeros((len(t), pii.TAGS))
        for h in range((len(t) - 1) // pii.STEP + 1):
            start = h * pii.STEP - pii.MARGIN
            block = np.array([x[i] if 0 <= i < len(t) else 32 for i in range(start, start + pii.WINDOW)])
            for i, tag in enumerate(tagger.decode(block[:, None])[:, 0].tolist()):
                if 0 <= start + i < len(t):
                    votes[start + i, tag] += 1 + min(i, pii.WINDOW - 1 - i)
        want = np.where(plain_near(t), votes.argmax(axis=1), 0)
        assert (some == want).mean() > 0.99  # sums of windows decoded apart may differ in the last bit


def test_added_spans_touch_no_base_span():
    rng = random.Random(6)
    for _ in range(300):
        text = "".join(rng.choice("12345678 .-") for _ in range(120))
        tags = np.array([rng.choice([0, 0, 2, 3, 4, 4]) for _ in range(12)], np.int8).repeat(10)
        base = [("ip", a, a + rng.randrange(1, 30)) for a in rng.sample(range(100), rng.randrange(5))]
        free = pii.reconcile(text, tags, [])
        assert pii.reconcile(text, tags, base) == [s for s in free if not any(x < s[2] and s[1] < z for _, x, z in base)]


def test_ranges_of_long_texts(tagger, monkeypatch):
    texts = odd_texts(random.Random(8))
    whole = tagger.tags(texts)
    monkeypatch.setattr(pii, "RANGE", 50)
    for everywhere in (False, True):
        for a, b in zip(whole, tagger.tags(texts, everywhere), strict=True):
            assert (a is None) == (b is None) and (a is None or (a == b).mean() > 0.999)
