"""Vector best-fit packing of tokenised documents into sequences.

A document's ids end with one id of its own; documents longer than a sequence are cut, the short piece
first.  Pieces are dealt at random into shards of about SHARD pieces, and each shard is packed on its own,
longest piece first: of the open sequences with room in every dimension (tokens, documents, attention cost
as the sum of squared lengths) a piece goes to the best one, by the residual vector it would leave (its
weighted norm) or by the weighted dot product of its demand with the present residual.  A full piece is a
sequence by itself.

Null and empty texts are one piece, the closing id alone.  Repeated rows are packed each for itself.  Ties
go to the sequence opened first.  Extra columns of the input are not read.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .byte_bpe import Encoder
from .common import prepare, table, written

#: Pieces in a shard, about.
SHARD = 16_384
CLOSING = 2


@dataclass(frozen=True)
class Capacity:
    """Of one sequence.  The attention cost of full sequences of one document is tokens squared."""

    tokens: int = 1024
    documents: int = 1024
    attention: int = 1024 * 1024
    weights: tuple[float, float, float] = (1.0, 0.01, 0.01)
    rule: str = "norm"  # or "dot"


def pack(lengths: np.ndarray, cap: Capacity) -> tuple[np.ndarray, np.ndarray]:
    """Each piece's sequence, numbered from 0, and its offset there.

    A piece that no empty sequence could take for its attention cost gets one of its own.
    """
    n = len(lengths)
    bins, offsets = np.empty(n, np.int64), np.zeros(n, np.int64)
    order = np.argsort(-lengths, kind="stable")
    least = int(lengths.min()) if n else 0
    full = np.array([cap.tokens, cap.documents, cap.attention], float)
    weight = np.array(cap.weights)
    room, ids, used = np.empty((3, 1024)), np.empty(1024, np.int64), 0
    opened = 0
    for k in order:
        size = int(lengths[k])
        need = np.array([size, 1, size * size], float)
        best = -1
        if used:
            left = room[:, :used] - need[:, None]
            fits = (left >= 0).all(0)
            if fits.any():
                if cap.rule == "dot":
                    value = -(room[:, :used] * (need * weight / full**2)[:, None]).sum(0)
                else:
                    value = ((left / full[:, None]) ** 2 * weight[:, None]).sum(0)
                best = int(np.argmin(np.where(fits, value, np.inf)))
        if best < 0:
            if used == room.shape[1]:
                room, ids = np.concatenate([room, np.empty_like(room)], 1), np.concatenate([ids, np.empty_like(ids)])
            best, used = used, used + 1
            room[:, best], ids[best] = full, opened
            opened += 1
        bins[k], offsets[k] = ids[best], cap.tokens - room[0, best]
        room[:, best] -= need
        if room[0, best] < least or room[1, best] < 1 or room[2, best] < least * least:
            room[:, best : used - 1], ids[best : used - 1] = room[:, best + 1 : used].copy(), ids[best + 1 : used].copy()
            used -= 1
    return bins, offsets


_encoders: dict[str, Encoder] = {}


def _encoder(vocabulary: str) -> Encoder:
    """The ids of pre-tokens by the tokenizers library, one for each vocabulary in a worker."""
    if vocabulary not in _encoders:
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_str(vocabulary)
        tokenizer.encode_special_tokens = True
        _encoders[vocabulary] = Encoder(lambda pieces: [e.ids for e in tokenizer.encode_batch_fast([p.decode() for p in pieces], add_special_tokens=False)])
    return _encoders[vocabulary]


PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, nth long"


def pieces(docs: DataFrame, vocabulary: str, tokens: int, closing: int = CLOSING) -> DataFrame:
    """A row for each piece of each document, without its ids; ``nth`` counts the pieces of a task.

    ``vocabulary``: the JSON of a byte-level BPE tokenizer.
    """
    shared = prepare(docs.sparkSession).sparkContext.broadcast(vocabulary)

    def run(batches):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        encoder, nth = _encoder(shared.value), 0
        for b in batches:
            ids_of = b.column(0).to_pylist()
            for lo, hi, ids, first in encoder.rows(b.column(1)):
                out: list[list] = [[], [], [], [], []]
                for k in range(hi - lo):
                    own = np.append(ids[first[k] : first[k + 1]], np.uint32(closing)).astype("<u4")
                    count = -(-len(own) // tokens)
                    ends = len(own) - tokens * np.arange(count - 1, -1, -1)
                    starts = np.append(0, ends[:-1])
                    for p, (s, e) in enumerate(zip(starts.tolist(), ends.tolist())):
                        for column, v in zip(out, (ids_of[lo + k], p, s, e - s, zlib.crc32(own[s:e]))):
                            column.append(v)
                numbers = np.arange(nth, nth + len(out[0]))
                nth += len(numbers)
                yield pa.record_batch([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int32()), *(pa.array(c, pa.int64()) for c in out[2:]), pa.array(numbers)], names=[x.split()[0] for x in PIECES.split(", ")])

    return docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text").mapInArrow(run, PIECES)


def best_fit(pieces_df: DataFrame, cap: Capacity, shard: int = SHARD) -> DataFrame:
    """The pieces with sequence_id and offset.  Only lengths are shuffled; no shard grows with the input.

    The rows are written first, so that every later read, after a lost executor too, deals the same shards.
    """
    rows = written(pieces_df, "pieces")
    count = rows.count()
    shards = max(1, round(count / shard))
    dealt = rows.withColumn("shard", F.expr(f"pmod(xxhash64(doc_id, piece, ids_crc32, nth), {shards})"))

    def group(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["length", "doc_id", "piece", "nth"], ascending=[False, True, True, True])
        bins, offsets = pack(pdf["length"].to_numpy(), cap)
        return pdf.assign(sequence_id=(pdf["shard"].to_numpy() << 32) + bins, offset=offsets)[["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]]

    return dealt.groupBy("shard").applyInPandas(group, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def pack_documents(docs: DataFrame, vocabulary: str, cap: Capacity = Capacity(), shard: int = SHARD) -> DataFrame:
    return best_fit(pieces(docs, vocabulary, cap.tokens), cap, shard)


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    with open(public_tokenizers.path("byte_bpe_50k.json")) as f:
        return pack_documents(table(spark, sf_dir, "documents"), f.read())
