"""Hashed logistic regressions: bounded labelled samples, FTRL and AdaGrad fitting, calibration."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Labelled rows of each class that a fit reads at most.
SAMPLE_PER_CLASS = 3000


def fold(modulus: int, doc_id="doc_id"):
    """crc32 of the id as text, modulo ``modulus`` (null ids: null)."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % modulus


def labelled_sample(docs: DataFrame, labels: DataFrame, target: str, held_out: int, modulus: int = 4, per_class: int = SAMPLE_PER_CLASS) -> DataFrame:
    """Rows (doc_id, text, y) of up to ``per_class`` labelled ids a class, none of the fold ``held_out``.

    Which ids: those with the least hashes, so the choice is the same on every run.  The ids, at most
    2 * per_class, are broadcast; documents are scanned once, and only the sample's are shuffled.  An id that
    is labelled both ways is left out; of several texts with one id the least is taken.
    """
    known = labels.select(F.col("doc_id").cast("long").alias("_id"), F.col(target).alias("y")).where(F.col("_id").isNotNull() & F.col("y").isin(0, 1))
    known = known.where(fold(modulus, "_id") != held_out).groupBy("_id").agg(F.min("y").alias("y"), F.max("y").alias("_most")).where("y = _most").drop("_most")
    picks = [known.where(F.col("y") == y).orderBy(F.xxhash64("_id"), "_id").limit(per_class) for y in (0, 1)]
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    drawn = rows.join(F.broadcast(picks[0].unionByName(picks[1])), F.col("doc_id") == F.col("_id"))
    return drawn.groupBy("doc_id", "y").agg(F.min("text").alias("text")).select("doc_id", "text", "y")


def fit(sample: DataFrame, features: Callable[[pa.Array], Iterator[tuple[np.ndarray, np.ndarray]]], learn: Callable) -> np.ndarray:
    """Extract features where the rows are, then learn in one task from the bounded sample.

    ``features`` yields (indices, values) for each text; ``learn`` gets lists of indices, values, labels
    and ids, and returns an array of floats.
    """

    def extract(batches):
        for b in batches:
            got = list(features(b.column(1)))
            yield pa.record_batch(
                [b.column(0), b.column(2).cast(pa.int32()), pa.array([i.astype("<i4").tobytes() for i, _ in got], pa.binary()), pa.array([v.astype("<f4").tobytes() for _, v in got], pa.binary())],
                names=["doc_id", "y", "i", "v"],
            )

    def train(batches):
        got = pa.Table.from_batches(list(batches)).to_pylist() if (batches := list(batches)) else []
        i = [np.frombuffer(r["i"], "<i4") for r in got]
        v = [np.frombuffer(r["v"], "<f4") for r in got]
        w = learn(i, v, np.array([r["y"] for r in got], float), [r["doc_id"] for r in got])
        at = np.flatnonzero(w)
        yield pa.record_batch([pa.array(np.array([len(w)])), pa.array([at.astype("<i4").tobytes()], pa.binary()), pa.array([w[at].astype("<f8").tobytes()], pa.binary())], names=["n", "i", "w"])

    rows = sample.selectExpr("cast(doc_id as long) doc_id", "text", "cast(y as int) y").mapInArrow(extract, "doc_id long, y int, i binary, v binary")
    one = rows.repartition(1).sortWithinPartitions(F.xxhash64("doc_id"), "doc_id", "y", "i").mapInArrow(train, "n long, i binary, w binary").first()
    if one is None:  # not one labelled row
        return learn([], [], np.zeros(0), [])
    w = np.zeros(one["n"])
    w[np.frombuffer(one["i"], "<i4")] = np.frombuffer(one["w"], "<f8")
    return w


def sigmoid(z):
    return 1 / (1 + np.exp(-np.clip(z, -35, 35)))


def ftrl(idx: list, val: list, y: np.ndarray, size: int, alpha=0.5, beta=1.0, l1=0.0, l2=0.0, epochs=4, seed=7) -> np.ndarray:
    """Weights by follow-the-regularised-leader (per-coordinate rates); the last one is the bias, not regularised."""
    z, n = np.zeros(size + 1), np.zeros(size + 1)
    order = np.arange(len(y))
    rng = np.random.Generator(np.random.PCG64(seed))

    def weights(zi, ni, free):
        w = -(zi - np.sign(zi) * l1) / ((beta + np.sqrt(ni)) / alpha + l2)
        return np.where((np.abs(zi) > l1) | free, np.where(free, -zi / ((beta + np.sqrt(ni)) / alpha), w), 0.0)

    for _ in range(epochs):
        rng.shuffle(order)
        for k in order:
            i = np.append(idx[k], size)
            x = np.append(val[k], 1.0)
            free = i == size
            w = weights(z[i], n[i], free)
            g = (sigmoid(w @ x) - y[k]) * x
            s = (np.sqrt(n[i] + g * g) - np.sqrt(n[i])) / alpha
            z[i] += g - s * w
            n[i] += g * g
    return weights(z, n, np.arange(size + 1) == size)


def adagrad(idx: list, val: list, y: np.ndarray, size: int, rate=0.5, l2=1e-6, epochs=6, batch=64, seed=11) -> np.ndarray:
    """Weights by mini-batch AdaGrad on the logistic loss; the last one is the bias."""
    w, n = np.zeros(size + 1), np.full(size + 1, 1e-8)
    order = np.arange(len(y))
    rng = np.random.Generator(np.random.PCG64(seed))
    for _ in range(epochs):
        rng.shuffle(order)
        for lo in range(0, len(order), batch):
            part = order[lo : lo + batch]
            i = np.concatenate([np.append(idx[k], size) for k in part])
            x = np.concatenate([np.append(val[k], 1.0) for k in part])
            r = np.repeat(np.arange(len(part)), [len(idx[k]) + 1 for k in part])
            e = sigmoid(np.bincount(r, w[i] * x, len(part))) - y[part]
            u, at = np.unique(i, return_inverse=True)
            g = np.bincount(at, e[r] * x, len(u)) / len(part) + l2 * w[u]
            n[u] += g * g
            w[u] -= rate * g / np.sqrt(n[u])
    return w


def platt(z: np.ndarray, y: np.ndarray, steps: int = 100) -> tuple[float, float]:
    """(a, b) so that sigmoid(a z + b) is a calibrated probability, by Newton steps with smoothed targets.

    A step is halved until it lowers the loss, which scores far from 0 would else overshoot.
    """
    if not len(y):
        return 1.0, 0.0
    pos, neg = y.sum(), len(y) - y.sum()
    t = np.where(y > 0, (pos + 1) / (pos + 2), 1 / (neg + 2))

    def loss(a: float, b: float) -> float:
        x = a * z + b
        return float((np.logaddexp(0, x) - t * x).sum() + 5e-4 * ((a - 1) ** 2 + b * b))

    a, b = 1.0, 0.0
    for _ in range(steps):
        p = sigmoid(a * z + b)
        g = np.array([((p - t) * z).sum() + 1e-3 * (a - 1), (p - t).sum() + 1e-3 * b])
        q = p * (1 - p) + 1e-9
        h = np.array([[(q * z * z).sum() + 1e-3, (q * z).sum()], [(q * z).sum(), q.sum() + 1e-3]])
        step, now, scale = np.linalg.solve(h, g), loss(a, b), 1.0
        while scale > 1e-9 and not loss(a - scale * step[0], b - scale * step[1]) <= now:
            scale /= 2
        a, b = a - scale * step[0], b - scale * step[1]
        if abs(scale * step).max() < 1e-8:
            break
    return float(a), float(b)
