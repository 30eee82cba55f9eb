"""Personal data: exact base patterns, and a character BiLSTM with CRF transitions that adds spans.

The network reads windows of ``WINDOW`` characters in both directions and a linear-chain CRF scores tag
sequences (outside, email, ip, card, phone). It is trained here in numpy from labelled spans: base spans of
a bounded sample of documents, and spans put into that sample's prose by :func:`labelled_window` in forms
the patterns miss (numbers without a plus sign, separated card numbers, failing check digits), beside
number strings that are no personal data (dates, prices, versions, hex). Windows start every ``STEP`` characters, so
that two or three hold each character, and each is decoded by Viterbi. Globally every window votes for the tags of its
characters, with more weight the nearer they stand to its middle; a character takes the tag with the most votes, and
runs of one tag become spans.

A span of the network needs a digit or an at sign, the digit counts of its kind, and no overlap with a base span. A
character can belong to one only if it is within ``REACH`` characters of a digit or at sign, or in the run of other
than white space on either side of an at sign, up to ``LONGEST`` characters (:func:`near_signs`); all others are
outside any span. So windows that hold none of these characters have no say, and are not decoded.

Defined results: null and empty texts have no spans; offsets are code points of the whole text, end
exclusive; documents of any length are read whole; rows are independent, so null or repeated ids and
repeated rows are kept; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections.abc import Callable, Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import hash_sample, slices, table

KINDS = ("email", "ip", "card", "phone")
WINDOW, STEP = 64, 24
MARGIN = (WINDOW - STEP) // 2
REACH, LONGEST = 24, 320
RANGE = 1 << 18
#: a window's vote for the tag of its i-th character
VOTE = 1.0 + np.minimum(np.arange(WINDOW), WINDOW - 1 - np.arange(WINDOW))
HIDDEN = 12
TAGS = 1 + len(KINDS)
Span = tuple[str, int, int]

DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
LOCAL = re.compile(r"[A-Za-z0-9._%+-]+\Z")
LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGIT = re.compile(r"[0-9]")
SIGN = re.compile(r"[0-9@]")


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def luhn(digits: str) -> bool:
    """Check-digit test."""
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else (2 * d if d < 5 else 2 * d - 9)
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    # from each at sign to the left and right: the same matches as scanning, in linear time
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in LOCAL_CHARS:
            start -= 1
        m = DOMAIN.match(text, at + 1) if start < at else None
        if m:
            end = m.end()
            yield start, end
        at = text.find("@", max(at + 1, end))


def base_spans(text: str) -> list[Span]:
    """Spans of the base patterns, by kind as listed, then start."""
    out: list[Span] = [("email", a, z) for a, z in _emails(text)]
    if DIGIT.search(text):
        for m in IP.finditer(text):
            if all(len(p) <= 3 and int(p or "0") <= 255 for p in (x.lstrip("0") for x in m.group().split("."))):
                out.append(("ip", *m.span()))
        for m in CARD.finditer(text):
            d = _digits(m.group())
            if 16 <= len(d) <= 19 and luhn(d):
                out.append(("card", *m.span()))
        for m in PHONE.finditer(text):
            if 8 <= len(_digits(m.group())) <= 15:
                out.append(("phone", *m.span()))
    return out


class Lstm:
    """One direction: a table of character contributions (4H x 130) and recurrent weights; gates i, f, o, g."""

    def __init__(self, rng: np.random.Generator, h: int = HIDDEN):
        self.h = h
        self.table = (rng.standard_normal((4 * h, 130)) * 0.3).astype(np.float32)
        self.table[h : 2 * h] += 1.0
        self.u = (rng.standard_normal((4 * h, h)) / np.sqrt(h)).astype(np.float32)

    def run(self, x: np.ndarray, tape: list | None = None) -> np.ndarray:
        """States (T, H, B) for characters x (T, B)."""
        h, steps, width = self.h, *x.shape
        out = np.empty((steps, h, width), np.float32)
        s, c = np.zeros((h, width), np.float32), np.zeros((h, width), np.float32)
        for t in range(steps):
            a = self.table.take(x[t], axis=1)
            a += self.u @ s
            a[: 3 * h] *= 0.5
            np.tanh(a, out=a)
            a[: 3 * h] *= 0.5
            a[: 3 * h] += 0.5
            before = c
            c = a[h : 2 * h] * c + a[:h] * a[3 * h :]
            squashed = np.tanh(c)
            if tape is not None:
                tape.append((s, before, squashed, a))
            s = a[2 * h : 3 * h] * squashed
            out[t] = s
        return out

    def back(self, x: np.ndarray, tape: list, grad: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Gradients of the table and of u, from those of the states."""
        h, steps, width = self.h, *x.shape
        d_in = np.empty((steps, 4 * h, width), np.float32)
        d_u, d_s, d_c = np.zeros_like(self.u), np.zeros((h, width), np.float32), np.zeros((h, width), np.float32)
        for t in reversed(range(steps)):
            s, before, squashed, a = tape[t]
            i, f, o, g = a[:h], a[h : 2 * h], a[2 * h : 3 * h], a[3 * h :]
            d = d_s + grad[t]
            d_c = d_c + d * o * (1 - squashed * squashed)
            d_in[t, :h] = d_c * g * i * (1 - i)
            d_in[t, h : 2 * h] = d_c * before * f * (1 - f)
            d_in[t, 2 * h : 3 * h] = d * squashed * o * (1 - o)
            d_in[t, 3 * h :] = d_c * i * (1 - g * g)
            d_c = d_c * f
            d_u += d_in[t] @ s.T
            d_s = self.u.T @ d_in[t]
        flat, to = d_in.transpose(1, 0, 2).reshape(4 * h, -1), x.ravel()
        return np.stack([np.bincount(to, row, 130) for row in flat]).astype(np.float32), d_u


def codes(text: str) -> np.ndarray:
    """Character classes: ASCII as it is, 128 for other letters and digits, 129 for the rest."""
    raw = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    out = raw.astype(np.intp)
    high = np.flatnonzero(raw > 127)
    out[high] = [128 if text[i].isalnum() else 129 for i in high.tolist()]
    return out


class Tagger:
    """Both directions, the emission layer and the CRF; a few tens of kilobytes."""

    def __init__(self, seed: int = 3):
        rng = np.random.default_rng(seed)
        self.forth, self.back = Lstm(rng), Lstm(rng)
        self.w = (rng.standard_normal((TAGS, 2 * HIDDEN)) * 0.3).astype(np.float32)
        self.b = np.zeros((TAGS, 1), np.float32)
        self.a = np.zeros((TAGS, TAGS), np.float32)

    def weights(self) -> list[np.ndarray]:
        return [self.forth.table, self.forth.u, self.back.table, self.back.u, self.w, self.b, self.a]

    def emissions(self, x: np.ndarray, tapes: tuple[list, list] | None = None):
        f = self.forth.run(x, tapes and tapes[0])
        g = self.back.run(x[::-1], tapes and tapes[1])[::-1]
        s = np.concatenate([f, g], axis=1)
        return self.w @ s + self.b, s

    def step(self, x: np.ndarray, y: np.ndarray) -> tuple[float, list[np.ndarray]]:
        """Mean negative log-likelihood of the tag rows y (T, B), and the gradients of :meth:`weights`."""
        tapes: tuple[list, list] = ([], [])
        e, s = self.emissions(x, tapes)
        steps, _, width = e.shape
        lse = lambda v, axis: (m := v.max(axis=axis, keepdims=True)).squeeze(axis) + np.log(np.exp(v - m).sum(axis=axis))
        alpha, beta = np.empty_like(e), np.zeros_like(e)
        alpha[0] = e[0]
        for t in range(1, steps):
            alpha[t] = e[t] + lse(alpha[t - 1][:, None] + self.a[:, :, None], 0)
        for t in reversed(range(steps - 1)):
            beta[t] = lse(self.a[:, :, None] + (e[t + 1] + beta[t + 1])[None], 1)
        z = lse(alpha[-1], 0)
        d = np.exp(alpha + beta - z)
        pairs = np.zeros_like(self.a)
        for t in range(1, steps):
            pairs += np.exp(alpha[t - 1][:, None] + self.a[:, :, None] + (e[t] + beta[t])[None] - z).sum(axis=2)
        np.subtract.at(pairs, (y[:-1].ravel(), y[1:].ravel()), 1)
        at = np.arange(width)
        gold = e[np.arange(steps)[:, None], y, at].sum(axis=0) + self.a[y[:-1], y[1:]].sum(axis=0)
        d[np.arange(steps)[:, None], y, at] -= 1
        d = (d / width).astype(np.float32)
        d_s = self.w.T @ d
        f = self.forth.back(x, tapes[0], d_s[:, :HIDDEN])
        g = self.back.back(x[::-1], tapes[1], d_s[::-1, HIDDEN:])
        return float((z - gold).mean()), [*f, *g, np.einsum("tkb,thb->kh", d, s, optimize=True), d.sum(axis=(0, 2))[:, None], pairs / width]

    def decode(self, x: np.ndarray) -> np.ndarray:
        """Best tag rows (T, B) by Viterbi."""
        e, _ = self.emissions(x)
        steps, _, width = e.shape
        best, came = e[0], np.empty((steps, TAGS, width), np.int8)
        for t in range(1, steps):
            v = best[:, None] + self.a[:, :, None]
            came[t] = v.argmax(axis=0)
            best = v.max(axis=0) + e[t]
        out = np.empty((steps, width), np.int8)
        out[-1] = best.argmax(axis=0)
        for t in range(steps - 1, 0, -1):
            out[t - 1] = came[t][out[t], np.arange(width)]
        return out

    def tags(self, texts: list[str], everywhere: bool = False) -> list[np.ndarray | None]:
        """For each text the tags of its characters, None for outside throughout. ``everywhere`` decodes all windows,
        also those without a say."""
        blocks, parts = [], []
        out: list[np.ndarray | None] = []
        for text in texts:
            out.append(None)
            if not SIGN.search(text):
                continue
            x = codes(text)
            near, padded = near_signs(text, x), np.pad(x, (MARGIN, 2 * WINDOW), constant_values=32)
            out[-1] = np.zeros(len(x), np.int8)
            for lo in range(0, len(x), RANGE):  # a very long text's votes are counted range by range
                here = near[lo : lo + RANGE]
                hs = np.arange(lo // STEP - 2, (lo + RANGE) // STEP + 3) if everywhere else windows_of(np.flatnonzero(here) + lo)
                hs = hs[(hs >= 0) & (hs <= (len(x) - 1) // STEP)]
                blocks += [padded[h * STEP : h * STEP + WINDOW] for h in hs.tolist()]
                parts.append((out[-1][lo : lo + RANGE], hs * STEP - MARGIN - lo, here))
        got = [self.decode(np.stack(blocks[at : at + 1024], axis=1)) for at in range(0, len(blocks), 1024)]
        got = np.concatenate(got, axis=1).T if got else np.zeros((0, WINDOW), np.int8)
        done = 0
        for to, starts, here in parts:
            to[:] = voted(got[done : done + len(starts)], starts, here)
            done += len(starts)
        return out


def windows_of(places: np.ndarray) -> np.ndarray:
    """Numbers of the windows that hold any of the places."""
    at = (places + MARGIN) // STEP
    return np.unique(np.concatenate([at - d for d in range((WINDOW - 1) // STEP + 1)]))


def near_signs(text: str, x: np.ndarray) -> np.ndarray:
    """Which characters (of classes ``x``) can belong to a span of the network."""
    n = len(x)
    edge = np.zeros(n + 1, np.int64)

    def mark(a: np.ndarray, z: np.ndarray) -> None:
        np.add.at(edge, np.maximum(0, a), 1)
        np.add.at(edge, np.minimum(n, z), -1)

    signs = np.flatnonzero(((x >= 48) & (x <= 57)) | (x == 64))
    mark(signs - REACH, signs + REACH + 1)
    ats = np.flatnonzero(x == 64)
    if len(ats):
        space = ((x >= 9) & (x <= 13)) | ((x >= 28) & (x <= 32))
        space[[i for i in np.flatnonzero(x == 129).tolist() if text[i].isspace()]] = True
        where = np.arange(n)
        before = np.append(-1, np.maximum.accumulate(np.where(space, where, -1)))  # the last white space before a place
        after = np.append(np.minimum.accumulate(np.where(space, where, n)[::-1])[::-1], n)  # the first from a place on
        left = ats - (x[ats - 1] == 32) * (ats > 0)
        right = np.minimum(n, ats + 1)
        right = right + (np.append(x, 0)[right] == 32)
        mark(np.maximum(before[left] + 1, ats - LONGEST), ats)
        mark(ats, np.minimum(after[np.minimum(n, right)], ats + LONGEST))
    return edge[:-1].cumsum() > 0


def voted(got: np.ndarray, starts: np.ndarray, near: np.ndarray) -> np.ndarray:
    """Tags by the votes of windows (rows of tags and where they start) for the characters in ``near``; ties and
    characters without a window go to the lower tag."""
    number = np.cumsum(near) - 1
    at = starts[:, None] + np.arange(WINDOW)
    valid = (at >= 0) & (at < len(near))
    valid[valid] = near[at[valid]]
    weight = np.broadcast_to(VOTE, at.shape)[valid]
    votes = np.bincount(number[at[valid]] * TAGS + got[valid], weight, int(near.sum()) * TAGS)
    out = np.zeros(len(near), np.int8)
    out[near] = votes.reshape(-1, TAGS).argmax(axis=1)
    return out


#: Digit counts a span of the network may have, by kind.
PLAUSIBLE = {"email": (0, 99), "ip": (4, 12), "card": (13, 19), "phone": (7, 15)}


def reconcile(text: str, tags: np.ndarray | None, base: list[Span]) -> list[Span]:
    """Spans from the tags of a text's characters, without those that touch a base span."""
    if tags is None:
        return []
    out: list[Span] = []
    # base spans of different kinds may overlap: how far any that starts before reaches
    starts = sorted(a for _, a, _ in base)
    reach = list(accumulate((z for _, _, z in sorted(base, key=lambda s: s[1])), max))
    cuts = [0, *(np.flatnonzero(np.diff(tags)) + 1).tolist(), len(tags)]
    for a, z in zip(cuts[:-1], cuts[1:], strict=True):
        held = int(tags[a]) if z > a else 0
        if not held:
            continue
        kind = KINDS[held - 1]
        while a < z and not (text[a].isalnum() or text[a] in "+("):
            a += 1
        while z > a and not text[z - 1].isalnum():
            z -= 1
        part = text[a:z]
        low, high = PLAUSIBLE[kind]
        ok = len(part) <= LONGEST and SIGN.search(part) and low <= len(_digits(part)) <= high and (kind == "email") == ("@" in part)
        if kind == "email":
            ok = ok and re.fullmatch(r"\S+ ?@ ?\S*[^\s.]\.\S+", part)
        elif kind == "ip":
            ok = ok and re.fullmatch(r"[0-9]{1,3}(?:[ ]?\.[ ]?[0-9]{1,3}){3}", part)
        else:
            ok = ok and re.fullmatch(r"[+(]?[0-9][\x20()./0-9-]*[0-9]", part)
        before = bisect_left(starts, z)  # base spans that start before this one ends
        if ok and not (before and reach[before - 1] > a) and not (a and text[a - 1].isalnum()) and not (z < len(text) and text[z].isalnum()):
            out.append((kind, a, z))
    return out


def labelled_window(rng: np.random.Generator, prose: str) -> tuple[np.ndarray, np.ndarray]:
    """A training window: prose with personal data and other numbers put in, and its tags."""
    ds = lambda n: "".join(map(str, rng.integers(0, 10, n)))
    word = lambda: "".join(rng.choice(list("abcdefghilmnoprstu"), rng.integers(2, 9)))
    pick = lambda *xs: xs[rng.integers(len(xs))]
    made: dict[str, Callable[[], str]] = {
        "email": lambda: word() + pick("", "." + word(), "." + ds(2), "_" + ds(1)) + pick("@", "@", "@", " @ ") + word() + pick("", ds(1)) + "." + pick("com", "org", "example.com", "net", "co.uk"),
        "ip": lambda: pick(".", ".", " . ").join(str(rng.integers(0, 256)) for _ in range(4)),
        "card": lambda: pick(*[ds(16)] * 4, " ".join(ds(4) for _ in range(4)), "-".join(ds(4) for _ in range(4)), ds(4) + " " + ds(6) + " " + ds(5), ".".join(ds(4) for _ in range(4))),
        "phone": lambda: pick(f"+{ds(1)} ({ds(3)}) {ds(3)}-{ds(4)}", f"({ds(3)}) {ds(3)}-{ds(4)}", f"{ds(3)}-{ds(3)}-{ds(4)}", f"+{ds(2)} {ds(3)} {ds(7)}", f"0{ds(3)} {ds(7)}", f"{ds(3)}.{ds(3)}.{ds(4)}", f"+{ds(11)}"),
        "": lambda: pick(
            f"{rng.integers(1900, 2030)}", f"{ds(4)}-{ds(2)}-{ds(2)}", f"{rng.integers(1, 13)}/{rng.integers(1, 29)}/{rng.integers(1990, 2030)}", f"{ds(1)}.{ds(1)}.{ds(1)}", f"v{ds(1)}.{ds(2)}",
            f"${ds(3)}.{ds(2)}", "".join(rng.choice(list("0123456789abcdef"), 40)), f"{ds(2)},{ds(3)}", ds(rng.integers(1, 7)), f"{ds(2)}:{ds(2)}:{ds(2)}", f"page {ds(3)}", f"@{word()}", ds(24), f"{ds(2)} {ds(2)} {ds(1)}", "4.0.", "2.0.",
        ),
    }
    kind = pick(*KINDS, "", "", None)
    text, tag = prose, [0] * len(prose)
    if kind is not None:
        s = made[kind]()
        at = int(rng.integers(0, max(1, len(prose))))
        while at < len(prose) and prose[at - 1 : at] not in (" ", "\n", ""):
            at += 1
        left, right = pick(" ", " ", " (", ": ", '"', "\n", ""), pick(" ", " ", ". ", ", ", ")", '"', "!!", "\n", " ")
        put = left * bool(at) + s + right
        text = prose[:at] + put + prose[at:]
        tag[at:at] = [0] * (len(left) * bool(at)) + [KINDS.index(kind) + 1 if kind else 0] * len(s) + [0] * len(right)
        middle = at + len(s) // 2 - int(rng.integers(-MARGIN, MARGIN + 1))
        lo = max(0, middle - WINDOW // 2)
    else:
        lo = int(rng.integers(0, max(1, len(text) - WINDOW)))
    x, y = codes(text[lo : lo + WINDOW]), np.array(tag[lo : lo + WINDOW])
    fill = WINDOW - len(x)
    return np.pad(x, (0, fill), constant_values=32), np.pad(y, (0, fill)).astype(np.intp)


def train(texts: list[str], steps: int = 260, batch: int = 128, seed: int = 3) -> Tagger:
    """A tagger from the base spans of ``texts`` and from spans put into their prose."""
    rng = np.random.default_rng(seed)
    prose = [t for t in texts if t.strip()] or ["plain words and no numbers at all, "]
    real = []
    for t in texts:
        spans = base_spans(t)
        tag = np.zeros(len(t), np.intp)
        for kind, a, z in spans:
            tag[a:z] = KINDS.index(kind) + 1
        for _, a, z in spans[:20]:
            lo = max(0, (a + z) // 2 - int(rng.integers(8, WINDOW - 8)))
            x, y = codes(t[lo : lo + WINDOW]), tag[lo : lo + WINDOW]
            real.append((np.pad(x, (0, WINDOW - len(x)), constant_values=32), np.pad(y, (0, WINDOW - len(y)))))
    net = Tagger(seed)
    ws = net.weights()
    mean, square = [np.zeros_like(w) for w in ws], [np.zeros_like(w) for w in ws]
    for i in range(1, steps + 1):
        rows = []
        for _ in range(batch):
            if real and rng.random() < 0.15:
                rows.append(real[rng.integers(len(real))])
            else:
                t = prose[rng.integers(len(prose))]
                at = int(rng.integers(0, max(1, len(t) - 100)))
                rows.append(labelled_window(rng, t[at : at + 100]))
        _, grads = net.step(np.stack([r[0] for r in rows], axis=1), np.stack([r[1] for r in rows], axis=1))
        size = np.sqrt(sum(float((g * g).sum()) for g in grads))
        rate = 0.02 * min(1, i / 20) * (0.1 if i > 0.85 * steps else 1)
        for w, g, m, v in zip(ws, grads, mean, square, strict=True):
            g = g * min(1.0, 5.0 / (size + 1e-9))
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            w -= (rate * (m / (1 - 0.9**i)) / (np.sqrt(v / (1 - 0.99**i)) + 1e-7)).astype(np.float32)
    return net


def written(spans: list[Span]) -> str:
    """kind:start:end, by kind as listed, then start, comma-joined."""
    return ",".join(f"{k}:{a}:{z}" for k, a, z in sorted(spans, key=lambda s: (KINDS.index(s[0]), s[1])))


def mask(text: str, spans: list[Span]) -> str:
    """The text with every span replaced by its kind; of overlapping spans the union is replaced once."""
    out, at = [], 0
    for kind, a, z in sorted(spans, key=lambda s: (s[1], -s[2])):
        if a >= at:
            out += [text[at:a], f"<{kind.upper()}>"]
        at = max(at, z)
    return "".join(out) + text[at:]


def find_spans(net: Tagger, texts: list[str]) -> list[tuple[list[Span], list[Span]]]:
    """(base spans, added spans) of each text."""
    out = []
    for text, tags in zip(texts, net.tags(texts), strict=True):
        base = base_spans(text)
        out.append((base, reconcile(text, tags, base)))
    return out


def _each(docs: DataFrame, keep: list[str], fields: list[T.StructField], train_docs: int, make) -> DataFrame:
    """Rows of ``docs`` with columns ``keep`` and what ``make(text, base, added)`` returns, as ``fields``."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    sample = [r.text for r in hash_sample(docs.select("doc_id", text.alias("text")), "doc_id", train_docs).distinct().limit(2 * train_docs).collect()]
    net = docs.sparkSession.sparkContext.broadcast(train(sorted(sample)))
    rows = docs.select(*keep, text.alias("_text"))
    schema = T.StructType(rows.drop("_text").schema.fields + fields)
    at = len(keep)

    def run(batches):
        for b in batches:
            for part in slices(b, at):
                texts = part.column(at).to_pylist()
                made = [make(t, base, added) for t, (base, added) in zip(texts, find_spans(net.value, texts), strict=True)]
                cols = [pa.array(c) for c in zip(*made, strict=True)]
                yield pa.RecordBatch.from_arrays([*(part.column(i) for i in range(at)), *cols], names=schema.names)

    return rows.mapInArrow(run, schema)


def scan(docs: DataFrame, train_docs: int = 300) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans) of every document; learns prose from about ``train_docs``."""

    def make(_, base, added):
        n = [sum(k == kind for k, _, _ in base) for kind in KINDS]
        return (*n, hashlib.sha256(written(base).encode()).hexdigest(), written(base + added))

    fields = [T.StructField(f"n_{k}", T.LongType()) for k in KINDS] + [T.StructField("base_sha256", T.StringType()), T.StructField("spans", T.StringType())]
    return _each(docs, ["doc_id"], fields, train_docs, make)


def mask_documents(docs: DataFrame, keep: list[str], train_docs: int = 300) -> DataFrame:
    """Columns ``keep`` of every row and its text with personal data replaced by the kind's name."""
    return _each(docs, keep, [T.StructField("text", T.StringType())], train_docs, lambda t, base, added: (mask(t, base + added),))


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and spans of personal data of every document."""
    return scan(table(spark, sf_dir, "documents"))
