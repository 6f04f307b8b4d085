"""Quality rules: exact text statistics with fixed limits, and a calibrated hashed n-gram classifier.

Words are runs of bytes other than space and 0x09-0x0D.  The classifier's features are words, pairs of
words and runs of four bytes, hashed into one table; its log odds are calibrated on a fold of their own.
A row is kept if the rules pass and the calibrated probability reaches KEEP.  Null and empty texts have
zero statistics and fail (too few words).  Extra columns of the input are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from . import text_arrays as A
from .common import prepare, table
from .linear import adagrad, fit, labelled_sample, platt, sigmoid

BITS = 18
SCALE = 20.0
HELD_OUT = 2
#: Fixed limits: words, hundredths of words in repeated windows, least probability.
MIN_WORDS, MAX_REPEAT, KEEP = 50, 50, 0.5
SYMBOLS = np.zeros(256, bool)
SYMBOLS[[ord(c) for c in "#*$%&|<>"]] = True
_LINES = np.where(np.arange(256) == 10, 0, 1).astype(np.uint8)
_ROW = np.uint64(0xA24BAED4963EE407)


def _repeats(h: np.ndarray, row: np.ndarray) -> np.ndarray:
    """Which items equal another one of the same row."""
    key = A.mix(h + row.astype(np.uint64) * _ROW)
    by = np.argsort(key)
    k = key[by]
    same = k[1:] == k[:-1]
    out = np.zeros(len(h), bool)
    out[by[1:][same]] = True
    out[by[:-1][same]] = True
    return out


def statistics(buf: np.ndarray, off: np.ndarray) -> tuple[dict[str, np.ndarray], np.ndarray, np.ndarray]:
    """The counts of each row, and the hashes and rows of its words."""
    m = len(off) - 1
    starts, ends, first = A.runs(buf, off)
    h, row = A.hashes(buf, starts, ends), A.rows_of(first)
    counted = ~A.SEPARATORS[buf] & ((buf & 0xC0) != 0x80)
    lines = A.runs(buf, off, _LINES)
    text = np.zeros(len(buf) + 1, np.int64)
    np.cumsum(~A.SEPARATORS[buf], out=text[1:])
    full = text[lines[1]] > text[lines[0]]
    line_row, begin, end = A.rows_of(lines[2])[full], lines[0][full], lines[1][full]
    line_key = A.hashes(buf, begin, end)
    by = np.lexsort((line_key, line_row))
    again = (line_key[by][1:] == line_key[by][:-1]) & (line_row[by][1:] == line_row[by][:-1])
    a, b = by[1:][again], by[:-1][again]
    if not A.same(buf, begin[a], end[a], begin[b], end[b]).all():  # two that differ have one hash: by value
        data, seen, by = buf.tobytes(), set(), np.arange(len(by))
        keys = [(r, data[x:y]) for r, x, y in zip(line_row.tolist(), begin.tolist(), end.tolist())]
        again = np.array([k in seen or seen.add(k) is not None for k in keys], bool)[1:]
    three, at = A.ngrams(h, row, 3)
    hit = at[_repeats(three, row[at])]
    covered = np.zeros(len(h) + 2, bool)
    for k in range(3):
        covered[hit + k] = True
    return {
        "n_words": np.diff(first),
        "word_chars": A.sums(counted, off),
        "n_symbols": A.sums(SYMBOLS[buf], off),
        "n_dup_lines": np.bincount(line_row[by][1:][again], minlength=m),
        "n_repeat_words": A.sums(covered[: len(h)], first),
    }, h, row


def _indices(buf, off, h, row) -> list[tuple[np.ndarray, np.ndarray]]:
    """(indices, rows) of the word, word-pair, word-again and four-byte features, each in order of rows.

    Shares of the first three are of the words, so that few repetitions count little.
    """
    shift = np.uint64(64 - BITS)
    two, at = A.ngrams(h, row, 2)
    same, where = A.echoes(h, row)
    by = np.argsort(row[where], kind="stable")
    out = [((h >> shift).astype(np.int64), row), ((two >> shift).astype(np.int64), row[at]), ((same[by] >> shift).astype(np.int64), row[where][by])]
    if len(buf) >= 4:
        b = buf.astype(np.uint32)
        four = b[:-3] | b[1:-2] << np.uint32(8) | b[2:-1] << np.uint32(16) | b[3:] << np.uint32(24)
        chars = np.repeat(np.arange(len(off) - 1, dtype=np.int32), np.diff(off))
        inside = chars[:-3] == chars[3:]
        four = (four[inside] * np.uint32(0x9E3779B1)) >> np.uint32(32 - BITS)
        out.append((four.astype(np.int64), chars[:-3][inside]))
    return out


def features(col: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    for lo, hi, buf, off in A.chunks(col):
        starts, ends, first = A.runs(buf, off)
        groups = _indices(buf, off, A.hashes(buf, starts, ends), A.rows_of(first))
        words = np.diff(first)
        for r in range(hi - lo):
            i, v = [], []
            for k, (idx, rows) in enumerate(groups):
                part = idx[np.searchsorted(rows, r) : np.searchsorted(rows, r, "right")]
                u, n = np.unique(part, return_counts=True)
                i.append(u)
                v.append(n * (SCALE / max(words[r] if k < 3 else len(part), 1)))
            yield np.concatenate(i), np.concatenate(v)


def learn(idx, val, y, ids) -> np.ndarray:
    """Weights, bias, and the two numbers of the calibration, which is fitted on every fourth row (none of fewer than four rows)."""
    size = 1 << BITS
    if not len(y):
        return np.append(np.zeros(size + 1), [1.0, 0.0])
    own = np.arange(len(y)) % 4 == 3
    take = np.flatnonzero(~own)
    w = adagrad([idx[k] for k in take], [val[k] for k in take], y[take], size)
    held = np.flatnonzero(own)
    z = np.array([w[idx[k]] @ val[k] + w[-1] for k in held])
    return np.append(w, platt(z, y[held]))


def train_rules(docs: DataFrame, labels: DataFrame, held_out: int = HELD_OUT) -> np.ndarray:
    prepare(docs.sparkSession)
    return fit(labelled_sample(docs, labels, "quality", held_out), features, learn)


OUT = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, probability double"


def apply_rules(docs: DataFrame, model: np.ndarray, keep: float = KEEP) -> DataFrame:
    """The statistics, verdicts and calibrated probability of every row; one pass, no shuffle."""
    spark = prepare(docs.sparkSession)
    shared = spark.sparkContext.broadcast((model[: 1 << BITS].astype(np.float32), *map(float, model[1 << BITS :])))

    def score(batches):
        w, bias, a, c = shared.value
        for b in batches:
            got, z = [], np.full(b.num_rows, bias)
            for lo, hi, buf, off in A.chunks(b.column(1)):
                stats, h, row = statistics(buf, off)
                got.append(stats)
                for k, (i, rows) in enumerate(_indices(buf, off, h, row)):
                    of = stats["n_words"] if k < 3 else np.bincount(rows, minlength=hi - lo)
                    z[lo:hi] += SCALE * np.bincount(rows, w[i], hi - lo) / np.maximum(of, 1)
            s = {k: np.concatenate([g[k] for g in got]).astype(np.int64) if got else np.zeros(0, np.int64) for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")}
            failed = (s["n_words"] < MIN_WORDS) | (100 * s["n_repeat_words"] > MAX_REPEAT * s["n_words"])
            p = sigmoid(a * z + c)
            yield pa.record_batch([b.column(0), *map(pa.array, s.values()), pa.array(failed), pa.array(~failed & (p >= keep)), pa.array(p)], names=[x.split()[0] for x in OUT.split(", ")])

    return docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text").mapInArrow(score, OUT)


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return apply_rules(docs, train_rules(docs, table(spark, sf_dir, "labels")))
