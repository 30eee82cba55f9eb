import random
import re

from nearfield.llm import license_scan as ls
from nearfield.llm.common import table
from nearfield.llm.license_templates import BASE, TEMPLATES

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def plain(text):
    words = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    places = [(i, a) for a, p in BASE.items() for i in range(len(words)) if words[i : i + len(p.split())] == p.split()]
    at = [i for i, _ in places]
    return (len(words), len(at), min(at, default=None), max(at, default=None), ",".join(sorted({a for _, a in places})))


def base_of(r):
    return (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels)


def test_query_against_plain(spark):
    sf = "/root/testdata/sf0.01"
    want = {r.doc_id: plain(r.text) for r in table(spark, sf, "documents").collect()}
    got = ls.op3_license_scan(spark, sf).collect()
    assert len(got) == len(want) and sum(w[1] for w in want.values()) > 5
    for r in got:
        assert base_of(r) == want[r.doc_id]
        assert set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) and 0 <= r.score <= 1
        assert (r.score == 1) >= bool(r.n_base)


def test_edited_templates_and_odd_rows(spark):
    rng, docs = random.Random(5), []
    for label, texts in TEMPLATES.items():
        for t in texts:
            words = t.split()
            if len(words) > 30:
                for _ in range(len(words) // 25):
                    words[rng.randrange(len(words))] = rng.choice(["thereof", "", "some other"])
            docs.append((len(docs), "Préface one two. " + " ".join(words) + " and after.", label))
    docs += [(100, None, ""), (None, "", ""), (101, "under the mit license " * 3000, "mit"), (102, "the license of versions", ""), (103, "under the mit license under the mit license", "mit")]
    docs += [docs[-1]]
    df = spark.createDataFrame(docs, "doc_id long, text string, labels string")
    got = ls.scan(df).collect()
    assert len(got) == len(docs)
    by = {r.doc_id: r for r in got}
    for i, t, label in docs:
        assert base_of(by[i]) == plain(t)
        assert label in by[i].labels.split(","), (label, by[i])
    assert by[102].labels == "" and by[102].score == 0 and by[101].n_base == 3000
    assert ls.scan(df.limit(0)).count() == 0


def test_common_words():
    rng = random.Random(6)
    for _ in range(200):
        a, b = ([rng.choice([b"x", b"y", b"z"]) for _ in range(rng.randrange(12))] for _ in range(2))
        best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                best[i + 1][j + 1] = best[i][j] + 1 if x == y else max(best[i][j + 1], best[i + 1][j])
        assert ls.common_words(a, b) == best[-1][-1]


def test_no_other_labels(spark):
    """Notices near a template's wording get their own label and no other."""
    docs = [
        ("Released under the BSD License.", ""),
        ("This is released under the Apache License by all.", ""),
        ("Licensed under CC BY-SA 4.0.", ""),
        ("Licensed under CC BY-ND 4.0.", ""),
        ("Released under the MIT License.", "mit"),
        ("Permission to use the software is granted without charge, including the rights to copy and publish.", ""),
    ]
    docs += [(t, label) for label, ts in TEMPLATES.items() for t in ts]
    lines = TEMPLATES["mit"][0].split()
    parted = " ".join(" ".join(lines[i : i + 12]) + " page header four words" for i in range(0, len(lines), 12))
    docs += [(parted, "mit"), (" ".join(TEMPLATES["mit"][:2]) + " " + TEMPLATES["bsd-3-clause"][0], "bsd-3-clause,mit")]
    df = spark.createDataFrame([(i, f"Some words before. {t} And some words after.") for i, (t, _) in enumerate(docs)], "doc_id long, text string")
    got = {r.doc_id: r.labels for r in ls.scan(df).collect()}
    assert got == {i: label for i, (_, label) in enumerate(docs)}


def test_stretch():
    tpl = [b"%d" % i for i in range(30)]
    words = [b"x"] * 40 + tpl[:10] + [b"y"] * 5 + tpl[10:] + [b"z"] * 9
    assert ls.stretch(words, tpl) == (30, 40, 75)
    assert ls.stretch([], tpl) == (0, 0, 0)
