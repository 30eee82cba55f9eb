"""Byte-level BPE encoding and decoding by backtracking over longest matches.

Bytes are mapped to the 256 Latin-1 characters, so that a pyahocorasick automaton over the vocabulary
finds every token in a piece in one pass. The encoder walks from the left with the longest token at each
place; a token may follow another only if the two stay apart when their joined bytes are merged by rank,
which is looked up once for each pair and kept. Where no token fits, the next shorter prefix token is
tried, then the token before is taken back; a place that turned out to be a dead end is not entered
again, so the work is linear in the piece. The result is exactly that of merging by rank.

Defined results: null and empty texts give no ids and decode to empty bytes; a lone piece that is a token
is that token; texts of any length are encoded whole; rows are independent, so repeated rows and ids,
ties and empty tables need nothing special; extra columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
from itertools import chain

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import slices, table

#: Fixed value: patterns whose matches hold a space only where they begin, or in a run of white space.
SPACE_SAFE = (r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+",)
PART = chr(256)
UNKNOWN = -2
SPREAD = np.uint64(0x9E3779B97F4A7C15)
FEW = 24


def read_ranks(data: bytes) -> dict[bytes, int]:
    """Token bytes → rank from a file of base64 tokens and ranks."""
    return {base64.b64decode(a): int(b) for a, b in map(bytes.split, data.splitlines()) if a}


class Recent:
    """What was computed for short strings, in two generations of at most ``most`` entries: when the new
    one is full it becomes the old one, whose entries come back when they are asked for."""

    def __init__(self, most: int, longest: int = 64):
        self.most, self.longest = most, longest
        self.new: dict = {}
        self.old: dict = {}

    def missing(self, keys: list) -> list:
        """Distinct keys that are in neither generation; the others are in the new one afterwards."""
        if len(self.new) >= self.most:
            self.old, self.new = self.new, {}
        new, old, out = self.new, self.old, []
        for k in keys:
            if k not in new:
                got = old.get(k)
                if got is None:
                    out.append(k)
                else:
                    new[k] = got
        return out

    def keep(self, got: dict) -> None:
        """Add what was computed for short strings."""
        self.new.update((k, v) for k, v in got.items() if len(k) <= self.longest)


class Codec:
    """Encoder and decoder for one vocabulary of byte tokens; merges follow the ranks. ``keep`` bounds the pieces
    remembered (one generation)."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, keep: int = 150_000):
        if any(bytes([b]) not in ranks for b in range(256)):
            raise ValueError("a vocabulary needs a token for every byte")
        self.ranks = ranks
        self.find = regex.compile(pattern).findall
        self.safe = pattern in SPACE_SAFE
        self.known = Recent(keep)
        n = max(ranks.values()) + 1
        self.text_of = [b""] * n
        for t, r in ranks.items():
            self.text_of[r] = t
        self.size_of = np.array([len(t) for t in self.text_of], np.int64)
        self.texts, self.decimals = binaries(self.text_of), binaries([b",%d" % i for i in range(n)])
        self.pairs, self.fit_of = np.full(1 << 20, -1, np.int64), np.zeros(1 << 20, bool)
        self.halves: dict[int, tuple[int, int] | None] = {}
        self.matcher = ahocorasick.Automaton()
        for t, r in ranks.items():
            self.matcher.add_word(t.decode("latin-1"), r)
        self.matcher.make_automaton()
        #: the longest token that is a proper prefix of a token, -1 for none
        self.shorter = np.full(n, -1, np.int64)
        for t, r in ranks.items():
            self.shorter[r] = next((x for k in range(len(t) - 1, 0, -1) if (x := ranks.get(t[:k])) is not None), -1)

    def split(self, token: int) -> tuple[int, int] | None:
        """The two tokens whose merge makes ``token``; None for a token no merge makes."""
        if token not in self.halves:
            t = self.text_of[token]
            ends = self._merge(t, below=token) if len(t) > 1 else []
            self.halves[token] = (ends[0], ends[1]) if len(ends) == 2 else None
        return self.halves[token]

    def _merge(self, t: bytes, below: int) -> list[int]:
        """Merge the bytes of ``t`` by rank with merges of rank under ``below`` only; for single tokens."""
        parts = [t[i : i + 1] for i in range(len(t))]
        while len(parts) > 1:
            best = min(((self.ranks.get(parts[i] + parts[i + 1], below), i) for i in range(len(parts) - 1)))
            if best[0] >= below:
                break
            parts[best[1] : best[1] + 2] = [parts[best[1]] + parts[best[1] + 1]]
        return [self.ranks[p] for p in parts]

    def compatible(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Whether merging the joined bytes of two tokens by rank gives back these two. Answers are kept in a table
        with one place for each hash of a pair, where a newer pair replaces an older."""
        pairs = left << 32 | right
        place = (pairs.view(np.uint64) * SPREAD >> np.uint64(44)).astype(np.int64)
        out = self.fit_of[place]
        new = np.flatnonzero(self.pairs[place] != pairs)
        if len(new):
            some, first, where = np.unique(pairs[new], return_index=True, return_inverse=True)
            got = np.array([self._compatible(x >> 32, x & 0xFFFFFFFF) for x in some.tolist()], bool)
            out[new] = got[where]
            at = place[new[first]]
            # of two pairs for one place, the same one must win in both tables
            at, last = np.unique(at[::-1], return_index=True)
            self.pairs[at], self.fit_of[at] = some[::-1][last], got[::-1][last]
        return out

    def _compatible(self, a: int, b: int) -> bool:
        # Undo the latest merge beside the border again and again; a merge across the border of a lower
        # rank than the undone one would have come before it. Of equal ranks the left one comes first.
        limit = 1 << 62
        while True:
            if self.ranks.get(self.text_of[a] + self.text_of[b], limit) < limit:
                return False
            left, right = self.split(a), self.split(b)
            if left and (a > b or not right):
                limit, a = a, left[1]
            elif right:
                limit, b = b + 1, right[0]
            else:
                return True

    def encode_piece(self, piece: bytes) -> list[int]:
        """Ids of one piece of text."""
        return self.encode_pieces([piece])[0].tolist()

    def _matches(self, find, lines: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(token, place) of matches in lines joined by a character that is no byte, and where each line starts."""
        found = np.fromiter(chain.from_iterable(find(PART.join(lines))), np.int64).reshape(-1, 2)
        tokens = found[:, 1]
        return tokens, found[:, 0] + 1 - self.size_of[tokens], np.cumsum([0, *(len(x) + 1 for x in lines)])

    def encode_pieces(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of many pieces one after another, where each piece's ids begin and the last end). One pass of the
        automaton over all pieces gives their longest matches; where all neighbours are compatible these are the
        result, and only the other pieces are walked with backtracking."""
        whole = np.array([self.ranks.get(p, -1) for p in pieces], np.int64)
        rest = np.array([i for i in np.flatnonzero(whole < 0).tolist() if pieces[i]], np.int64)
        sizes = (whole >= 0).astype(np.int64)
        if not len(rest):
            return whole[whole >= 0].astype(np.int32), np.append(0, sizes.cumsum())
        lines = [pieces[i].decode("latin-1") for i in rest.tolist()]
        tokens, at, starts = self._matches(self.matcher.iter_long, lines)
        of = np.searchsorted(starts, at, side="right") - 1
        later = np.flatnonzero(of[:-1] == of[1:]) + 1
        wrong = later[~self.compatible(tokens[later - 1], tokens[later])]
        bad, first = np.unique(of[wrong], return_index=True)  # the first match of a line that doesn't go with the one before
        cuts = np.searchsorted(of, np.arange(len(lines) + 1))
        last = at[wrong[first] - 1] - starts[bad]  # where the last match that goes with all before begins
        stack, base, depth = self._walk([lines[j] for j in bad.tolist()], tokens, cuts[bad], wrong[first], last)
        sizes[rest] = np.diff(cuts)
        sizes[rest[bad]] = depth
        ends = np.append(0, sizes.cumsum())
        ids = np.empty(ends[-1], np.int32)
        ids[ends[:-1][whole >= 0]] = whole[whole >= 0]
        good = np.ones(len(lines), bool)
        good[bad] = False
        good = good[of]
        ids[(ends[rest][of] + np.arange(len(of)) - cuts[of])[good]] = tokens[good]
        ids[runs(ends[rest[bad]], depth)] = stack[runs(base, depth)]
        return ids, ends

    def _walk(self, lines: list[str], found: np.ndarray, lo: np.ndarray, hi: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of pieces by backtracking, all pieces a step at a time: (array of ids, where each piece's begin, their
        number). ``found[lo:hi]`` are longest matches that a piece's walk begins with, ``last`` is where the last of
        them begins; longest matches before it are looked up only if the walk comes back that far. A piece's tokens,
        longest matches and dead ends lie in flat arrays from its start."""
        if not lines:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        tokens, at, starts = self._matches(self.matcher.iter, [x[n:] for x, n in zip(lines, last.tolist(), strict=True)])
        base = np.cumsum([0, *(len(x) + 1 for x in lines)])
        base, size, depth = base[:-1], np.diff(base) - 1, hi - lo
        longest = np.full(base[-1] + size[-1] + 2, UNKNOWN, np.int64)
        longest[at + (base + last - starts[:-1])[np.searchsorted(starts, at, side="right") - 1]] = tokens  # by their end, so the longest is written last
        dead, stack = np.zeros(len(longest), bool), np.zeros(len(longest), np.int64)
        flat = found[runs(lo, depth)]
        stack[runs(base, depth)] = flat
        here = np.bincount(np.repeat(np.arange(len(lines)), depth), self.size_of[flat], len(lines)).astype(np.int64)
        token = longest[base + here]
        live = np.arange(len(lines))
        while len(live):
            t, b = token[live], base[live]
            to = here[live] + self.size_of[t]
            fits = t >= 0
            fits[fits] = ~dead[(b + to)[fits]]
            ask = np.flatnonzero(fits & (depth[live] > 0))
            fits[ask] = self.compatible(stack[b[ask] + depth[live[ask]] - 1], t[ask])
            put = live[fits]
            stack[base[put] + depth[put]] = token[put]
            depth[put] += 1
            here[put] = to[fits]
            token[put] = longest[base[put] + here[put]]
            for j in put[(token[put] == UNKNOWN) & (here[put] < size[put])].tolist():
                token[j] = longest[base[j] + here[j]] = next(self.matcher.iter_long(lines[j], int(here[j])))[1]
            rest = live[~fits]
            back = rest[token[rest] < 0]  # nothing fits here after the token before: take it back
            dead[base[back] + here[back]] = True
            depth[back] -= 1
            token[back] = stack[base[back] + depth[back]]
            here[back] -= self.size_of[token[back]]
            token[rest] = self.shorter[token[rest]]
            live = live[here[live] < size[live]]
            if len(live) < FEW:
                for j in live.tolist():
                    got = self._backtrack(lines[j])
                    stack[base[j] : base[j] + len(got)] = got
                    depth[j] = len(got)
                break
        return stack, base, depth

    def _backtrack(self, line: str) -> list[int]:
        """Ids of one piece, by the same walk."""
        n, text_of, kept = len(line), self.text_of, {}
        longest = {end - len(text_of[r]) + 1: r for end, r in self.matcher.iter_long(line)}
        out: list[int] = []
        dead = bytearray(n + 1)
        at, token = 0, longest[0]
        while True:
            to = at + len(text_of[token])
            if not dead[to]:
                fit = True
                if out:
                    pair = out[-1], token
                    fit = kept.get(pair)
                    if fit is None:
                        fit = kept[pair] = self._compatible(*pair)
                if fit:
                    out.append(token)
                    if to == n:
                        return out
                    at, token = to, longest.get(to)
                    if token is None:
                        token = longest[at] = next(self.matcher.iter_long(line, at))[1]
                    continue
            shorter = int(self.shorter[token])
            while shorter < 0:
                dead[at] = 1
                token = out.pop()
                at -= len(text_of[token])
                shorter = int(self.shorter[token])
            token = shorter

    def encode_batch(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of many texts one after another, where each text's ids begin and the last end).

        For a pattern in ``SPACE_SAFE`` a text is cut at single spaces between two characters other than white space:
        no match crosses such a place, so the cut changes nothing. Of the words, all but a text's first stand behind a
        space; Arrow numbers the distinct ones, and only these are searched for the pattern. A text with other white
        space beside a space, and any text under another pattern, is searched as a whole.
        """
        if not self.safe:
            return self.encode_runs([self.find(t) for t in texts], np.arange(len(texts)), np.arange(len(texts) + 1))
        words = pc.split_pattern(pa.array(texts, pa.large_string()), " ")
        flat = words.flatten().dictionary_encode()
        distinct, index, ends = flat.dictionary.to_pylist(), flat.indices.to_numpy().astype(np.int64), words.offsets.to_numpy()
        odd = np.array([not w or w[0].isspace() or w[-1].isspace() for w in distinct], bool)
        begin, count = ends[:-1], np.diff(ends)
        alone = (np.add.reduceat(odd[index], begin) - odd[index[begin]] > 0) if len(texts) else np.zeros(0, bool)
        heads = [distinct[i] for i in index[begin].tolist()]
        alone |= np.array([n > 1 and (not h or h[-1].isspace()) for h, n in zip(heads, count.tolist(), strict=True)], bool)
        pieces = cut_runs(self.find(" " + " ".join([w for w, x in zip(distinct, odd.tolist(), strict=True) if not x]))) if not odd.all() else []
        pieces += [self.find(t if whole else h) for t, h, whole in zip(texts, heads, alone.tolist(), strict=True)]
        place = np.cumsum(~odd) - 1  # of a word among those searched
        first = int((~odd).sum())
        index = place[index]
        index[begin] = first + np.arange(len(texts))
        held = ~np.repeat(alone, count)
        held[begin] = True
        return self.encode_runs(pieces, index[held], np.append(0, np.cumsum(np.where(alone, 1, count))))

    def encode_runs(self, runs_of: list[list[str]], index: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of texts, each made of the runs of pieces that ``index`` names between two ``ends``; every distinct
        piece is looked up or encoded once."""
        flat = pa.array(list(chain.from_iterable(runs_of)), pa.large_string()).dictionary_encode()
        distinct, cuts = flat.dictionary.to_pylist(), np.cumsum([0, *map(len, runs_of)])
        new = self.known.missing(distinct)
        ids, at = self.encode_pieces([p.encode("utf-8") for p in new])
        raw, at = ids.tobytes(), (4 * at).tolist()
        once = {p: raw[a:z] for p, a, z in zip(new, at[:-1], at[1:], strict=True)}
        find = self.known.new.get
        data, at = joined(binaries([find(p) or once[p] for p in distinct]), flat.indices.to_numpy(), cuts)
        self.known.keep(once)
        runs_ids = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(at) - 1, [None, pa.py_buffer(np.ascontiguousarray(at)), pa.py_buffer(data)])
        data, at = joined(runs_ids, index, ends)
        return np.frombuffer(data, np.int32), at // 4

    def decode_batch(self, ids: np.ndarray, ends: np.ndarray) -> list[bytes]:
        """The bytes that each text's ids stand for."""
        return parted(*joined(self.texts, ids, ends))

    def decimal_batch(self, ids: np.ndarray, ends: np.ndarray) -> list[bytes]:
        """Each text's ids as decimals joined by commas."""
        return [x[1:] for x in parted(*joined(self.decimals, ids, ends))]

    def encode(self, text: str) -> list[int]:
        """Ids of a text."""
        return self.encode_batch([text])[0].tolist()

    def decode(self, ids) -> bytes:
        """The bytes that ids stand for."""
        return b"".join([self.text_of[i] for i in ids])


def cut_runs(pieces: list[str]) -> list[list[str]]:
    """Pieces of words that each stand behind a space, by word."""
    at = [i for i, p in enumerate(pieces) if p[0] == " "]
    return [pieces[a:z] for a, z in zip(at, [*at[1:], len(pieces)], strict=True)]


def binaries(values: list[bytes]) -> pa.LargeBinaryArray:
    """Arrow array of byte strings."""
    return pa.array(values, pa.large_binary())


def joined(values: pa.LargeBinaryArray, index: np.ndarray, ends: np.ndarray) -> tuple[memoryview, np.ndarray]:
    """Of the values picked by ``index``, all one after another, and where each run between ``ends`` begins and ends."""
    picked = values.take(pa.array(index))
    return memoryview(picked.buffers()[2] or b""), np.frombuffer(picked.buffers()[1], np.int64, len(index) + 1)[ends]


def parted(data: memoryview, at: np.ndarray) -> list[bytes]:
    """The runs of :func:`joined`."""
    return [bytes(data[a:z]) for a, z in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]


def runs(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """start, start + 1, ... for each of many runs."""
    return np.arange(sizes.sum()) + np.repeat(starts - np.cumsum(sizes) + sizes, sizes)


_CODECS: dict[str, Codec] = {}


def codec(vocabulary: bytes, pattern: str) -> Codec:
    """The codec of a vocabulary file's content, built once in a process."""
    key = hashlib.sha1(vocabulary + pattern.encode()).hexdigest()
    if key not in _CODECS:
        _CODECS[key] = Codec(read_ranks(vocabulary), pattern)
    return _CODECS[key]


def read_vocabulary(path: str) -> bytes:
    """A vocabulary file on the driver, under 16 MB: the bound of what is sent to executors."""
    with open(path, "rb") as f:
        data = f.read()
    if len(data) > 16 << 20:
        raise ValueError(f"{path}: vocabulary over 16 MB")
    return data


def _public() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN


def encode(docs: DataFrame, path: str | None = None, pattern: str | None = None, keep: tuple[str, ...] = ("doc_id",), ids: bool = True) -> DataFrame:
    """Columns ``keep`` and n_tokens, ids array<int> (if asked for), ids_sha256, decoded_sha256."""
    path, pattern = path or _public()[0], pattern or _public()[1]
    vocabulary = docs.sparkSession.sparkContext.broadcast(read_vocabulary(path))
    rows = docs.select(*keep, F.coalesce(F.col("text").cast("string"), F.lit("")).alias("_text"))
    extra = {"ids": T.ArrayType(T.IntegerType())} if ids else {}
    schema = T.StructType(rows.drop("_text").schema.fields)
    for name, kind in {"n_tokens": T.LongType(), **extra, "ids_sha256": T.StringType(), "decoded_sha256": T.StringType()}.items():
        schema = schema.add(name, kind)

    def run(batches):
        c = codec(vocabulary.value, pattern)
        for b in batches:
            at = b.schema.get_field_index("_text")
            for part in slices(b, at):
                got, ends = c.encode_batch(part.column(at).to_pylist())
                cols = [part.column(i) for i in range(part.num_columns) if i != at]
                cols.append(pa.array(np.diff(ends), pa.int64()))
                if ids:
                    cols.append(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(got)))
                cols.append(pa.array([hashlib.sha256(x).hexdigest() for x in c.decimal_batch(got, ends)], pa.string()))
                cols.append(pa.array([hashlib.sha256(x).hexdigest() for x in c.decode_batch(got, ends)], pa.string()))
                yield pa.RecordBatch.from_arrays(cols, names=schema.names)

    return rows.mapInArrow(run, schema)


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token count and digests of ids and decoded bytes of every document."""
    return encode(table(spark, sf_dir, "documents"), ids=False)
