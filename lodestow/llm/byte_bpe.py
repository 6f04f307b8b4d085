"""Byte-level BPE encoding and decoding.

A text is split by the GPT-2 pattern; each match ("pre-token") is merged on its own.  The merges of a
pre-token are taken from a queue of ranks: every rank has a bucket of linked-list positions, a two-level
bitmap says which buckets hold any, find-first-set gives the next rank, and positions whose pair has
changed since are skipped.  The work is O(n log n) in the length of a pre-token, however long it is.

Texts are split with array operations over code points; a worker merges a pre-token once and keeps its ids in
flat arrays, found by a hash and held against the bytes, for up to KEEP of them.  Null is the empty text; the empty text has no ids; repeated rows
have equal results; extra columns of the input are not read.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import re
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from . import text_arrays as A
from .common import prepare, table

#: Merged pre-tokens that a task remembers, characters of text handled at once.
KEEP, CHUNK = 400_000, 1 << 19

_SPACE, _WHITE, _LETTER, _NUMBER, _OTHER = range(5)
_OUTSIDE = 0x110000
#: The characters with Unicode's property White_Space.
_WHITE_SPACE = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
_classes: list[np.ndarray] = []


def _character_classes() -> np.ndarray:
    if not _classes:
        c = np.full(_OUTSIDE, _OTHER, np.uint8)
        # an unassigned stand-in takes the place of surrogates, which no text has
        points = np.arange(_OUTSIDE, dtype="<u4")
        points[0xD800:0xE000] = 0xFFFF
        everything = points.tobytes().decode("utf-32-le")
        for kind, pattern in ((_LETTER, r"\p{L}+"), (_NUMBER, r"\p{N}+")):
            for m in regex.finditer(pattern, everything):
                c[m.start() : m.end()] = kind
        c[_WHITE_SPACE] = _WHITE
        c[0x20] = _SPACE
        _classes.append(c)
    return _classes[0]


def split(points: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Where pre-tokens start, of texts laid end to end as code points; ``first``: each text's first, and the end.

    The pattern's rules, for runs of one class: a run of letters, of numbers or of other visible characters
    takes one space before it; a run of white space gives its last character up to what follows it, be it as
    that space or as a pre-token of its own; an apostrophe that starts a pre-token takes s, t, re, ve, m, ll, d.
    """
    n = len(points)
    if not n:
        return np.zeros(0, np.int64)
    c = _character_classes()[points]
    white = c <= _WHITE
    kind = np.where(white, _WHITE, c).astype(np.uint8)
    inner = np.ones(n + 1, bool)  # the character before is of the same text
    inner[first] = False
    inside = inner[1:n]
    change = np.empty(n, bool)
    change[0] = True
    np.not_equal(kind[1:], kind[:-1], out=change[1:])
    change[1:] |= ~inside
    start = change & white
    start[:-1] |= white[:-1] & ~white[1:] & inside  # the last white character before something visible
    seen = change & ~white
    spaced = np.zeros(n, bool)
    spaced[1:] = (c[:-1] == _SPACE) & inside
    start |= seen & ~spaced
    at = np.flatnonzero((points == 0x27) & start)
    if len(at):
        p = np.concatenate([points, np.zeros(3, points.dtype)])
        far = first[np.searchsorted(first, at, "right")] - at  # characters up to the end of the text
        one = (far > 1) & np.isin(p[at + 1], [ord(x) for x in "stmd"])
        two = np.zeros(len(at), bool)
        for a, b in ("re", "ve", "ll"):
            two |= (far > 2) & (p[at + 1] == ord(a)) & (p[at + 2] == ord(b))
        for which, size in ((one, 2), (two, 3)):
            i = at[which]
            start[i + 1] = False
            i = i[far[which] > size] + size
            start[i] = True
    return np.flatnonzero(start)


class Merger:
    """Ids of one pre-token by the ranks of a vocabulary, with the queue of ranks inlined.

    ``top`` and ``low`` are the bitmap: bit h of ``top`` says that word h of ``low`` is not 0, bit b of word h
    that the bucket of rank 256 h + b holds positions.  A bucket gives its leftmost position first.
    """

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks, self.longest = ranks, max(map(len, ranks))
        self.low = [0] * ((max(ranks.values()) >> 8) + 1)
        self.bit = [1 << k for k in range(max(256, len(self.low)))]

    def __call__(self, piece: bytes) -> list[int]:
        rank_of = self.ranks.get
        whole = rank_of(piece)
        if whole is not None:
            return [whole]
        n, longest, low, bit = len(piece), self.longest, self.low, self.bit
        after, before = list(range(1, n + 2)), list(range(-1, n))  # neighbours of the part that starts here
        pair: list[int | None] = [rank_of(piece[i : i + 2]) for i in range(n - 1)]
        pair.append(None)
        buckets: dict[int, list[int]] = {}
        top = 0
        for i, r in enumerate(pair):
            if r is not None:
                if r in buckets:
                    buckets[r].append(i)  # ascending, so still a heap
                else:
                    buckets[r] = [i]
                    low[r >> 8] |= bit[r & 255]
                    top |= bit[r >> 8]
        while top:
            high = (top & -top).bit_length() - 1
            word = low[high]
            r = (high << 8) + (word & -word).bit_length() - 1
            bucket = buckets[r]
            if len(bucket) > 1:
                i = heapq.heappop(bucket)
            else:
                i = bucket[0]
                del buckets[r]
                low[high] = word = word & (word - 1)
                if not word:
                    top &= top - 1
            if pair[i] != r:
                continue  # stale
            j = after[i]
            k = after[j]
            after[i] = k
            pair[j] = None
            changed = []
            if k < n:
                before[k] = i
                end = after[k]
                pair[i] = new = rank_of(piece[i:end]) if end - i <= longest else None
                if new is not None:
                    changed.append((new, i))
            else:
                pair[i] = None
            h = before[i]
            if h >= 0:
                pair[h] = new = rank_of(piece[h:k]) if k - h <= longest else None
                if new is not None:
                    changed.append((new, h))
            for new, i in changed:
                if new in buckets:
                    heapq.heappush(buckets[new], i)
                else:
                    buckets[new] = [i]
                    low[new >> 8] |= bit[new & 255]
                    top |= bit[new >> 8]
        out, i = [], 0
        while i < n:
            k = after[i]
            out.append(self.ranks[piece[i:k]])
            i = k
        return out


def read_ranks(path: str) -> dict[bytes, int]:
    """A rank file: lines of base64 bytes and a rank."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


_CUT = re.compile(r"(?<=\S) (?=\S)")


def _segments(text: str) -> Iterator[str]:
    """A long text in parts, cut before a single space, where a pre-token starts whatever stands around it."""
    lo = 0
    while len(text) - lo > 2 * CHUNK:
        m = _CUT.search(text, lo + CHUNK)
        if m is None:
            break
        yield text[lo : m.start()]
        lo = m.start()
    yield text[lo:]


class Known:
    """Pre-tokens and their ids in a few flat arrays, found by hashes and held against the bytes; some 45 bytes each.

    ``hashes`` is sorted; ``at`` and ``size`` say where a pre-token's bytes are in ``data``, ``first`` and ``count``
    where its ids are in ``ids``.
    """

    def __init__(self):
        self.hashes, self.used = np.zeros(0, np.uint64), np.zeros(0, bool)
        self.at, self.size, self.first, self.count = (np.zeros(0, np.int64) for _ in range(4))
        self.data, self.ids = np.zeros(0, np.uint8), np.zeros(0, np.uint32)

    def find(self, h: np.ndarray, buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The place of each pre-token, or -1; what is found counts as used."""
        if not len(self.hashes):
            return np.full(len(h), -1)
        place = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
        same = np.flatnonzero((self.hashes[place] == h) & (self.size[place] == ends - starts))
        both = np.concatenate([buf, self.data])
        own = self.at[place[same]] + len(buf)
        same = same[A.same(both, starts[same], ends[same], own, own + self.size[place[same]])]
        out = np.full(len(h), -1)
        out[same] = place[same]
        self.used[out[same]] = True
        return out

    def add(self, h: np.ndarray, pieces: list[bytes], ids: list[list[int]]) -> None:
        """New pre-tokens; of several with one hash, and beside one that is known, the first stays."""
        h, which = np.unique(h, return_index=True)
        place = np.searchsorted(self.hashes, h)
        free = np.append(self.hashes, np.uint64(0))[place] != h if len(self.hashes) else np.ones(len(h), bool)
        free |= place == len(self.hashes)
        h, which, place = h[free], which[free], place[free]
        size, count = (np.fromiter(map(len, x), np.int64, len(x))[which] for x in (pieces, ids))
        at, first = len(self.data) + np.cumsum(size) - size, len(self.ids) + np.cumsum(count) - count
        self.data = np.concatenate([self.data, np.frombuffer(b"".join(map(pieces.__getitem__, which.tolist())), np.uint8)])
        self.ids = np.concatenate([self.ids, np.fromiter(chain.from_iterable(map(ids.__getitem__, which.tolist())), np.uint32, int(count.sum()))])
        for name, new in (("hashes", h), ("used", True), ("at", at), ("size", size), ("first", first), ("count", count)):
            setattr(self, name, np.insert(getattr(self, name), place, new))

    def forget(self, keep: int) -> None:
        """Beyond ``keep`` pre-tokens, those that have not been used since the last time go."""
        if len(self.hashes) <= keep:
            return
        stay = self.used if self.used.sum() <= keep else np.zeros(len(self.used), bool)
        self.data, at = _packed(self.data, self.at[stay], self.size[stay])
        self.ids, first = _packed(self.ids, self.first[stay], self.count[stay])
        self.hashes, self.size, self.count = self.hashes[stay], self.size[stay], self.count[stay]
        self.at, self.first, self.used = at, first, np.zeros(len(at), bool)


def _packed(flat: np.ndarray, at: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """These runs of a flat array, end to end, and where each begins now."""
    begin = np.cumsum(size) - size
    return flat[np.repeat(at - begin, size) + np.arange(size.sum())], begin


class Encoder:
    """Ids of many texts; ``merge`` gives those of pre-tokens (a list of bytes) as lists of ids."""

    def __init__(self, merge: Callable[[list[bytes]], list[list[int]]], keep: int = KEEP):
        self.merge, self.keep, self.known = merge, keep, Known()

    def _unique(self, buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The hash and a place of each different pre-token, and which of them each pre-token is: by hashes, held against the bytes."""
        h = A.hashes(buf, starts, ends)
        _, where, which = np.unique(h, return_index=True, return_inverse=True)
        first = where[which]
        if not A.same(buf, starts, ends, starts[first], ends[first]).all():  # two that differ have one hash: by value
            data, seen = buf.tobytes(), {}
            which = np.array([seen.setdefault(data[a:b], len(seen)) for a, b in zip(starts.tolist(), ends.tolist())])
            where = np.unique(which, return_index=True)[1]
        return h[where], where, which

    def _part(self, data: bytes, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        buf = np.frombuffer(data, np.uint8)
        starts = split(np.frombuffer(data.decode().encode("utf-32-le"), np.uint32), first)
        row_first = np.searchsorted(starts, first)
        starts = np.flatnonzero((buf & 0xC0) != 0x80)[starts]  # from code points to bytes
        ends = np.append(starts[1:], len(buf))[: len(starts)]
        h, where, which = self._unique(buf, starts, ends)
        lo, hi = starts[where], ends[where]
        place = self.known.find(h, buf, lo, hi)
        begin, size = np.empty(len(where), np.int64), np.empty(len(where), np.int64)
        met = place >= 0
        begin[met], size[met] = self.known.first[place[met]], self.known.count[place[met]]
        flat, new = self.known.ids, np.flatnonzero(~met)
        if len(new):
            pieces = [data[a:b] for a, b in zip(lo[new].tolist(), hi[new].tolist())]
            ids = self.merge(pieces)
            size[new] = np.fromiter(map(len, ids), np.int64, len(ids))
            begin[new] = len(flat) + np.cumsum(size[new]) - size[new]
            flat = np.concatenate([flat, np.fromiter(chain.from_iterable(ids), np.uint32, int(size[new].sum()))])
            self.known.add(h[new], pieces, ids)
            self.known.forget(self.keep)
        count = size[which]
        total = np.zeros(len(count) + 1, np.int64)
        np.cumsum(count, out=total[1:])
        out = flat[np.repeat(begin[which] - total[:-1], count) + np.arange(total[-1])]
        return out, total[row_first]

    def rows(self, col: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """(first row, end row, their ids end to end, each row's first id and the end)."""
        for lo, hi, buf, off in A.chunks(col, CHUNK):
            if hi - lo == 1:
                parts = [self._part(t.encode(), np.array([0, len(t)]))[0] for t in _segments(buf.tobytes().decode())]
                ids = np.concatenate(parts)
                yield lo, hi, ids, np.array([0, len(ids)])
                continue
            at = np.zeros(len(buf) + 1, np.int64)
            np.cumsum((buf & 0xC0) != 0x80, out=at[1:])
            yield lo, hi, *self._part(buf.tobytes(), at[off])


class Decoder:
    """Bytes of ids, by array operations."""

    def __init__(self, tokens: dict[int, bytes]):
        size = np.zeros(max(tokens) + 1, np.int64)
        for i, t in tokens.items():
            size[i] = len(t)
        self.size, self.begin = size, np.cumsum(size) - size
        self.flat = np.frombuffer(b"".join(tokens[i] for i in sorted(tokens)), np.uint8)

    def __call__(self, ids: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All bytes end to end, and each row's first."""
        size = self.size[ids]
        total = np.zeros(len(ids) + 1, np.int64)
        np.cumsum(size, out=total[1:])
        return self.flat[np.repeat(self.begin[ids] - total[:-1], size) + np.arange(total[-1])], total[first]


_loaded: dict = {}


def _tools(ranks: dict[bytes, int], key: str) -> tuple[Encoder, Decoder]:
    """One encoder and decoder for each vocabulary in a worker, so that later tasks know its pre-tokens."""
    if key not in _loaded:
        merger = Merger(ranks)
        _loaded[key] = Encoder(lambda pieces: list(map(merger, pieces))), Decoder({i: t for t, i in ranks.items()})
    return _loaded[key]


def encode(docs: DataFrame, ranks: dict[bytes, int]) -> DataFrame:
    """(doc_id, ids) for every row: the ids of its whole text."""
    shared, key = prepare(docs.sparkSession).sparkContext.broadcast(ranks), hashlib.sha256(repr(sorted(ranks.items())).encode()).hexdigest()

    def run(batches):
        encoder, _ = _tools(shared.value, key)
        for b in batches:
            for lo, hi, ids, first in encoder.rows(b.column(1)):
                lists = pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.array(ids.astype(np.int32)))
                yield pa.record_batch([b.column(0).slice(lo, hi - lo), lists], names=["doc_id", "ids"])

    return docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text").mapInArrow(run, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, ranks: dict[bytes, int]) -> DataFrame:
    """(doc_id, bytes) for rows (doc_id, ids); null ids are none."""
    shared, key = prepare(encoded.sparkSession).sparkContext.broadcast(ranks), hashlib.sha256(repr(sorted(ranks.items())).encode()).hexdigest()

    def run(batches):
        _, decoder = _tools(shared.value, key)
        for b in batches:
            for k in range(b.num_rows):
                ids = np.array(b.column(1)[k].as_py() or [], np.int64)
                body, _ = decoder(ids, np.array([0, len(ids)]))
                yield pa.record_batch([b.column(0).slice(k, 1), pa.array([body.tobytes()], pa.binary())], names=["doc_id", "bytes"])

    return encoded.selectExpr("cast(doc_id as long) doc_id", "ids").mapInArrow(run, "doc_id long, bytes binary")


def round_trip(docs: DataFrame, ranks: dict[bytes, int]) -> DataFrame:
    """Digests of the ids of every whole text and of what they decode to, without moving either out of the task."""
    shared, key = prepare(docs.sparkSession).sparkContext.broadcast(ranks), hashlib.sha256(repr(sorted(ranks.items())).encode()).hexdigest()

    def run(batches):
        encoder, decoder = _tools(shared.value, key)
        for b in batches:
            n, sha, back = [], [], []
            for lo, hi, ids, first in encoder.rows(b.column(1)):
                body, at = decoder(ids, first)
                n.append(np.diff(first))
                for k in range(hi - lo):
                    sha.append(hashlib.sha256(ids[first[k] : first[k + 1]]).hexdigest())
                    back.append(hashlib.sha256(body[at[k] : at[k + 1]]).hexdigest())
            yield pa.record_batch([b.column(0), pa.array(np.concatenate(n) if n else np.zeros(0, np.int64)), pa.array(sha, pa.string()), pa.array(back, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return round_trip(table(spark, sf_dir, "documents"), read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken")))
