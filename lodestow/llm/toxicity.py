"""Toxicity: restore disguised words by a noisy-channel model, then score the restored text.

A passage may be disguised if it has look-alike characters next to letters (leetspeak, letters of other scripts
among Latin ones), a letter three times
in a row, or at least three single characters spread out with any runs of white space and punctuation, behind
any opening punctuation; passages have any length.  Its lattice has for each character the letters it may stand
for, for each repetition one or two of the letter, and for each gap nothing or the end of a word, all at a
channel cost: a gap as narrow as the passage's narrowest is more likely nothing, a wider one the end of a word.
Viterbi decoding finds the path that is most
likely under a character trigram model, which is counted over all texts.  All other passages stay.

The score is a logistic regression on which words, beginnings of words and pairs of words the restored text
has, fitted by follow-the-regularised-leader on a bounded, balanced sample of labelled rows.

Null and empty texts have no feature: their score is that of the bias.  Repeated rows get equal scores.
Without labels every score is 0.5.  Extra columns of the input are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import text_arrays as A
from .common import prepare, table
from .linear import fit, fold, ftrl, labelled_sample, sigmoid

BITS, HELD_OUT, THRESHOLD = 20, 2, 0.3
#: Bytes of the beginnings of words.
PREFIXES = (4, 5, 6)
#: Letters that a character may stand for.
LOOKS = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "€": "e", "(": "c"}
#: Letters of other scripts that look like Latin ones (none that is one when case is ignored); full-width letters lie in one order.
_ALIKE = {"а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "і": "i", "ѕ": "s", "ј": "j", "ο": "o", "α": "a"}
LOOKS |= _ALIKE | {chr(first + i): chr(97 + i) for first in (0xFF21, 0xFF41) for i in range(26)}
#: log costs of the channel: a look-alike, a repetition, a gap; what a gap costs more if it does not mean what its width says.
LOOK_COST, REPEAT_COST, GAP_COST, ODD_GAP = -0.7, -0.5, -0.3, -3.0
#: Characters of the longest passages whose answers are kept.
KEPT = 64
_STATES = 28  # 0 between words, 1-26 a-z, 27 any other letter
_LETTER = re.compile(r"[A-Za-z]")
_LOOK = "".join(re.escape(c) for c in LOOKS)
_GAP = rf"(?:[^\w{_LOOK}]|_)"
_SPREAD = rf"(?<!\S)(?:[^\w\s]|_)*?[A-Za-z{_LOOK}](?:{_GAP}+[A-Za-z{_LOOK}](?![A-Za-z{_LOOK}])){{2,}}(?![A-Za-z0-9@])"
_DISGUISED = rf"(?:[A-Za-z][{_LOOK}]|[{_LOOK}][A-Za-z]|[\uff21-\uff3a\uff41-\uff5a]{{2}}|([A-Za-z])\1\1)"
_SUSPECT = re.compile(rf"{_SPREAD}|(?<!\S)(?=\S*?{_DISGUISED})\S{{3,}}", re.IGNORECASE)
_GAPS = re.compile(f"{_GAP}+")
_TRAIL = re.compile(r"^(?:[^\w@$|+€(]|_)+|(?:[^\w@$|+€]|_)+$")
#: Letters that look like others.
_ODD = re.compile("[" + "".join(c for c in LOOKS if c.isalpha()) + "]", re.IGNORECASE)
_LATIN = re.compile(r"[A-Za-z\uff21-\uff3a\uff41-\uff5a]")

_CLASS = np.zeros(256, np.int64)
_CLASS[97:123] = np.arange(1, 27)
_CLASS[65:91] = np.arange(1, 27)
_CLASS[0x80:] = 27


def train_characters(docs: DataFrame) -> np.ndarray:
    """log P(character | two before) as a cube, counted over all texts."""
    prepare(docs.sparkSession)

    def count(batches):
        total = np.zeros(_STATES**3, np.int64)
        for b in batches:
            for _, _, buf, off in A.chunks(b.column(0)):
                c = _CLASS[buf]
                if len(c) > 2:
                    total += np.bincount(c[:-2] * _STATES**2 + c[1:-1] * _STATES + c[2:], minlength=_STATES**3)
        at = np.flatnonzero(total)
        yield pa.record_batch([pa.array(at), pa.array(total[at])], names=["i", "n"])

    rows = docs.select(F.col("text").cast("string")).mapInArrow(count, "i long, n long").groupBy("i").agg(F.sum("n").alias("n")).collect()
    n = np.zeros(_STATES**3)
    for r in rows:  # at most 28^3
        n[r["i"]] = r["n"]
    n = n.reshape(_STATES, _STATES, _STATES)
    two = n.sum(0)
    one = two.sum(0)
    p1 = (one + 1) / (one.sum() + _STATES)
    p2 = (two + 5 * p1) / (two.sum(1, keepdims=True) + 5)
    return np.log((n + 5 * p2) / (n.sum(2, keepdims=True) + 5))


class Restorer:
    """Decodes suspicious passages; keeps the answers it has given, up to a bound."""

    def __init__(self, log: np.ndarray, keep: int = 200_000):
        self.log, self.keep, self.known = log.tolist(), keep, {}

    def _lattice(self, passage: str) -> list[list[tuple[float, str]]]:
        spread = len(passage) > 2 and not _LETTER.search(re.sub(r"(?<![^\W_])\S(?![^\W_])", "", passage)) and bool(_GAPS.search(passage))
        narrow = min((len(g) for g in _GAPS.findall(passage)), default=0) if spread else 0
        out: list[list[tuple[float, str]]] = []
        i, n = 0, len(passage)
        while i < n:
            c = passage[i]
            gap = _GAPS.match(passage, i) if spread else None
            if gap:
                wide = gap.end() - i > narrow
                out.append([(GAP_COST + (ODD_GAP if wide else 0), ""), (GAP_COST + (0 if wide else ODD_GAP), " ")])
                i = gap.end()
                continue
            j = i + 1
            while j < n and passage[j] == c:
                j += 1
            c = c if c in LOOKS else c.lower()
            low = c.lower()
            if "a" <= low <= "z" and len(low) == 1:
                if j - i > 2:
                    out.append([(REPEAT_COST, low), (REPEAT_COST, low * 2)])
                else:
                    out += [[(0.0, low)]] * (j - i)
            elif c in LOOKS:
                letters = [(LOOK_COST, x) for x in LOOKS[c]]
                out.append(letters + ([(LOOK_COST + REPEAT_COST, x * 2) for x in LOOKS[c]] if j - i > 1 else []))
            elif c.isalpha():
                out += [[(0.0, low)]] * (j - i)
            else:
                out.append([(0.0, " ")])
            i = j
        return out

    def decode(self, passage: str) -> str:
        log = self.log
        # what a path has emitted is a chain of pairs, shared by the paths that go on from it: linear in the passage
        best: dict[tuple[int, int], tuple[float, tuple | None]] = {(0, 0): (0.0, None)}
        for choices in [*self._lattice(passage), [(0.0, " ")]]:
            following: dict[tuple[int, int], tuple[float, tuple | None]] = {}
            for (a, b), (score, chain) in best.items():
                for cost, emitted in choices:
                    p, q, s = a, b, score + cost
                    for c in emitted:
                        k = ord(c) - 96 if "a" <= c <= "z" else 0 if c == " " else 27
                        if k or q:
                            s += log[p][q][k]
                            p, q = q, k
                    if (p, q) not in following or following[p, q][0] < s:
                        following[p, q] = s, (chain, emitted)
            best = following
        chain, emitted = max(best.values(), key=lambda x: x[0])[1], []
        while chain is not None:
            emitted.append(chain[1])
            chain = chain[0]
        return " ".join("".join(reversed(emitted)).split())

    def _replace(self, m: re.Match) -> str:
        whole = m.group()
        core = _TRAIL.sub("", whole)
        if len(core) < 3 or len(_LATIN.findall(core)) < 2 or core.isalpha() and not _ODD.search(core) and not re.search(r"(.)\1\1", core, re.IGNORECASE):
            return whole
        answer = self.known.get(core)
        if answer is None:
            if len(self.known) > self.keep:
                self.known.clear()
            answer = self.decode(core)
            if len(core) <= KEPT:
                self.known[core] = answer
        return whole.replace(core, answer, 1)

    def __call__(self, text: str) -> str:
        return _SUSPECT.sub(self._replace, text)


def restore(docs: DataFrame, log: np.ndarray) -> DataFrame:
    """(doc_id, restored): every text with its disguised passages restored; null stays null."""
    shared = prepare(docs.sparkSession).sparkContext.broadcast(log)

    def run(batches):
        restorer = Restorer(shared.value)
        for b in batches:
            yield pa.record_batch([b.column(0), pa.array([None if t is None else restorer(t) for t in b.column(1).to_pylist()], pa.string())], names=["doc_id", "restored"])

    return docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text").mapInArrow(run, "doc_id long, restored string")


def _indices(buf, off) -> tuple[np.ndarray, np.ndarray]:
    """Hashed features that each row has, once each, in order of rows."""
    starts, ends, first = A.runs(buf, off, A.RUNS)
    row = A.rows_of(first)
    h = A.hashes(buf, starts, ends, folded=True)
    two, at = A.ngrams(h, row, 2)
    parts, rows = [h, two], [row, row[at]]
    for n in PREFIXES:
        long = ends - starts > n
        parts.append(A.mix(A.hashes(buf, starts[long], starts[long] + n, folded=True) + np.uint64(n)))
        rows.append(row[long])
    i, row = (np.concatenate(parts) >> np.uint64(64 - BITS)).astype(np.int64), np.concatenate(rows)
    key = np.unique(row << BITS | i)
    return key & ((1 << BITS) - 1), key >> BITS


def _restored(col: pa.Array, restorer: Restorer) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    for lo, hi, buf, off in A.chunks(col):
        texts = pa.array([restorer(buf[a:b].tobytes().decode()) for a, b in zip(off[:-1], off[1:])], pa.large_string())
        for x, y, part, edges in A.chunks(texts, 1 << 40):
            yield lo + x, lo + y, part, edges


def train_toxicity(docs: DataFrame, labels: DataFrame, log: np.ndarray, held_out: int = HELD_OUT) -> np.ndarray:
    """Weights (bias last) from labelled rows outside the held-out fold."""
    shared = prepare(docs.sparkSession).sparkContext.broadcast(log)

    def features(col):
        for lo, hi, buf, off in _restored(col, Restorer(shared.value)):
            i, row = _indices(buf, off)
            for part in np.split(i, np.searchsorted(row, np.arange(1, hi - lo))):
                yield part, np.ones(len(part))

    def learn(idx, val, y, ids):
        size = 1 << BITS
        return ftrl(idx, val, y, size, alpha=0.3, l1=3.0, epochs=4) if len(y) else np.zeros(size + 1)

    return fit(labelled_sample(docs, labels, "toxic", held_out), features, learn)


def score_toxicity(docs: DataFrame, log: np.ndarray, weights: np.ndarray) -> DataFrame:
    """(doc_id, score, n_features) for every row; one pass over the texts, no shuffle."""
    shared = prepare(docs.sparkSession).sparkContext.broadcast((log, weights[:-1].astype(np.float32), float(weights[-1])))

    def score(batches):
        log, w, bias = shared.value
        restorer = Restorer(log)
        for b in batches:
            z, n = np.full(b.num_rows, bias), np.zeros(b.num_rows, np.int64)
            for lo, hi, buf, off in _restored(b.column(1), restorer):
                i, row = _indices(buf, off)
                n[lo:hi] = np.bincount(row, minlength=hi - lo)
                z[lo:hi] += np.bincount(row, w[i], hi - lo)
            yield pa.record_batch([b.column(0), pa.array(sigmoid(z)), pa.array(n)], names=["doc_id", "score", "n_features"])

    return docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text").mapInArrow(score, "doc_id long, score double, n_features long")


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    log = train_characters(docs)
    scored = score_toxicity(docs, log, train_toxicity(docs, table(spark, sf_dir, "labels"), log))
    return scored.select("doc_id", F.coalesce(fold(4) == HELD_OUT, F.lit(False)).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), "n_features")
