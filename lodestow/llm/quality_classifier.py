"""Quality classifier: hashed word n-grams, logistic regression by follow-the-regularised-leader.

A feature is a word or a pair of neighbouring words, or the pattern of a word that comes again within four
words, where a word is a run of letters and digits or a run of other visible characters; its value is its share of the text's features.  A score is the sigmoid of the
sparse dot product of these with the weights.  Null and empty texts have no feature: their score is that
of the bias.  Repeated rows get equal scores; extra columns of the input are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from . import text_arrays as A
from .common import prepare, table
from .linear import fit, fold, ftrl, labelled_sample, sigmoid

BITS = 18
#: Features are shares; this makes them of the order of 1.
SCALE = 20.0
HELD_OUT, THRESHOLD = 2, 0.7


def _indices(buf, off) -> tuple[np.ndarray, np.ndarray]:
    """Indices of all features of these rows, and the rows' (unsorted)."""
    starts, ends, first = A.runs(buf, off, A.RUNS)
    h, row = A.hashes(buf, starts, ends), A.rows_of(first)
    two, at = A.ngrams(h, row, 2)
    same, where = A.echoes(h, row)
    return (np.concatenate([h, two, same]) >> np.uint64(64 - BITS)).astype(np.int64), np.concatenate([row, row[at], row[where]])


def features(col: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    for lo, hi, buf, off in A.chunks(col):
        i, row = _indices(buf, off)
        by = np.argsort(row, kind="stable")
        ends = np.cumsum(np.bincount(row, minlength=hi - lo))
        for part in np.split(i[by], ends[:-1]):
            u, n = np.unique(part, return_counts=True)
            yield u, n * (SCALE / max(len(part), 1))


def learn(idx, val, y, ids) -> np.ndarray:
    return ftrl(idx, val, y, 1 << BITS, alpha=0.3, l1=0.02, epochs=4) if len(y) else np.zeros((1 << BITS) + 1)


def train_quality(docs: DataFrame, labels: DataFrame, held_out: int = HELD_OUT) -> np.ndarray:
    """Weights (bias last) from a bounded, balanced sample of the labelled rows outside the held-out fold."""
    prepare(docs.sparkSession)
    return fit(labelled_sample(docs, labels, "quality", held_out), features, learn)


def score_quality(docs: DataFrame, weights: np.ndarray) -> DataFrame:
    """(doc_id, score, n_features) for every row of ``docs``, and its ``row`` if it has such a column; no shuffle, one pass over the texts."""
    spark = prepare(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *(["row"] if "row" in docs.columns else []))
    out = StructType([StructField("doc_id", LongType()), StructField("score", DoubleType()), StructField("n_features", LongType())] + rows.schema.fields[2:])
    shared = spark.sparkContext.broadcast((weights[:-1].astype(np.float32), float(weights[-1])))

    def score(batches):
        w, bias = shared.value
        for b in batches:
            z, n = np.full(b.num_rows, bias), np.zeros(b.num_rows, np.int64)
            for lo, hi, buf, off in A.chunks(b.column(1)):
                i, row = _indices(buf, off)
                n[lo:hi] = np.bincount(row, minlength=hi - lo)
                z[lo:hi] += SCALE * np.bincount(row, w[i], hi - lo) / np.maximum(n[lo:hi], 1)
            yield pa.record_batch([b.column(0), pa.array(sigmoid(z)), pa.array(n), *b.columns[2:]], names=out.names)

    return rows.mapInArrow(score, out)


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = score_quality(docs, train_quality(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", F.coalesce(fold(4) == HELD_OUT, F.lit(False)).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), "n_features")
