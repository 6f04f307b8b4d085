"""Whole texts as NumPy arrays: runs of bytes, their 64-bit hashes, and n-grams of them.

Works on Arrow string columns inside a task.  Memory is bounded by CHUNK for ordinary rows, and by a
small multiple of one text for texts longer than that.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text handled at once.
CHUNK = 1 << 20

_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_JOIN = np.uint64(0xD6E8FEB86659FD93)

#: Bytes that part words: space and 0x09 to 0x0D.
SEPARATORS = np.zeros(256, bool)
SEPARATORS[[0x20, *range(0x09, 0x0E)]] = True

#: Classes of bytes: 0 separators, 1 letters, digits and every byte of a character beyond ASCII, 2 the rest.
WORDS = np.where(SEPARATORS, 0, 1).astype(np.uint8)
RUNS = np.array([0 if SEPARATORS[b] else 1 if b >= 0x80 or chr(b).isalnum() else 2 for b in range(256)], np.uint8)

#: Each byte with A-Z as a-z.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

#: 8-byte words of a run that are folded one after the other; longer runs are hashed by blocks of that many.
_WORDS = 32
#: Masks of the first k bytes of a word.
_FIRST = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
_LENGTH = np.uint64(0x9E3779B97F4A7C15)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    h = (h ^ (h >> np.uint64(30))) * _M1
    h = (h ^ (h >> np.uint64(27))) * _M2
    return h ^ (h >> np.uint64(31))


def chunks(col: pa.Array, limit: int = CHUNK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, their bytes, offsets in these) for runs of rows of about ``limit`` bytes; null is empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if not pa.types.is_large_string(col.type):
        col = col.cast(pa.large_string())
    if col.null_count:
        col = col.fill_null("")
    n = len(col)
    if not n:
        return
    _, offsets, data = col.buffers()
    off = np.frombuffer(offsets, np.int64)[col.offset : col.offset + n + 1]
    body = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(off, off[lo] + limit, "right")) - 1)
        hi = min(hi, n)
        yield lo, hi, body[off[lo] : off[hi]], off[lo : hi + 1] - off[lo]
        lo = hi


def runs(buf: np.ndarray, off: np.ndarray, classes: np.ndarray = WORDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the longest runs of one class other than 0 within a row, and each row's first run."""
    n = len(buf)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(off), np.int64)
    c = classes[buf]
    cut = np.empty(n + 1, bool)
    cut[0] = cut[n] = True
    np.not_equal(c[1:], c[:-1], out=cut[1:n])
    cut[off] = True
    at = np.flatnonzero(cut)
    starts, ends = at[:-1], at[1:]
    full = c[starts] != 0
    starts, ends = starts[full], ends[full]
    return starts, ends, np.searchsorted(starts, off)


def hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, folded: bool = False) -> np.ndarray:
    """A 64-bit hash of each run; equal bytes have equal hashes wherever they are.  ``folded``: with A-Z as a-z.

    A run's length and then its bytes, eight at a time, go through a mixing step each that is no linear function
    of them; a run of more than 256 bytes is the hash of the hashes of its blocks.
    """
    padded = np.zeros(len(buf) + 8, np.uint8)
    padded[: len(buf)] = LOWER[buf] if folded else buf
    return _hashed(padded, np.asarray(starts, np.int64), np.asarray(ends, np.int64), 0)


def _hashed(padded: np.ndarray, starts: np.ndarray, ends: np.ndarray, level: int) -> np.ndarray:
    words = np.ndarray(len(padded) - 7, "<u8", padded, strides=(1,))
    size = ends - starts
    out = mix(size.astype(np.uint64) * _LENGTH + np.uint64(level))
    block = 8 * _WORDS
    long = np.flatnonzero(size > block)
    left = np.flatnonzero(size > 0) if not len(long) else np.flatnonzero((size > 0) & (size <= block))
    for k in range(_WORDS):
        if not len(left):
            break
        at, rest = starts[left] + 8 * k, size[left] - 8 * k
        out[left] = mix(out[left] ^ (words[at] & _FIRST[np.minimum(rest, 8)]))
        left = left[rest > 8]
    if len(long):
        parts = -(-size[long] // block)
        upto = np.cumsum(parts)
        nth = np.arange(upto[-1]) - np.repeat(upto - parts, parts)
        begin = np.repeat(starts[long], parts) + nth * block
        each = _hashed(padded, begin, np.minimum(begin + block, np.repeat(ends[long], parts)), level)
        inner = np.zeros(8 * len(each) + 8, np.uint8)
        inner[:-8] = each.astype("<u8").view(np.uint8)
        out[long] = mix(out[long] ^ _hashed(inner, 8 * (upto - parts), 8 * upto, level + 1))
    return out


def same(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, others: np.ndarray, other_ends: np.ndarray) -> np.ndarray:
    """Which runs have the very bytes of the other run beside them."""
    size = ends - starts
    equal = size == other_ends - others
    run = np.repeat(np.flatnonzero(equal), size[equal])
    upto = np.cumsum(size[equal])
    nth = np.arange(len(run)) - np.repeat(upto - size[equal], size[equal])
    equal[run[buf[starts[run] + nth] != buf[others[run] + nth]]] = False
    return equal


def rows_of(first: np.ndarray) -> np.ndarray:
    """The row of each item, from the rows' first items."""
    return np.repeat(np.arange(len(first) - 1), np.diff(first))


def ngrams(h: np.ndarray, row: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the n-grams within rows, and where each starts."""
    m = len(h) - n + 1
    if m <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    at = np.flatnonzero(row[:m] == row[n - 1 :])
    g = h[at].copy()
    for k in range(1, n):
        g *= _JOIN
        g += h[at + k]
    return mix(g + np.uint64(n)), at


def echoes(h: np.ndarray, row: np.ndarray, far: int = 4) -> tuple[np.ndarray, np.ndarray]:
    """For each word equal to the one ``d`` words before it in its row (d = 1 to ``far``): a hash that stands for d, and where.

    The n-gram "this word again", whatever the word is: a model learns repetition from it though it has never met the word.
    """
    at = [np.flatnonzero((h[d:] == h[:-d]) & (row[d:] == row[:-d])) for d in range(1, far + 1)]
    names = mix(np.arange(1, far + 1, dtype=np.uint64))
    return np.concatenate([np.full(len(a), k) for a, k in zip(at, names)]).astype(np.uint64), np.concatenate(at)


def sums(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums over each row's items, empty rows included."""
    total = np.zeros(len(values) + 1, values.dtype if values.dtype.kind != "b" else np.int64)
    np.cumsum(values, out=total[1:])
    return total[first[1:]] - total[first[:-1]]
