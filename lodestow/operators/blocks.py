"""Objects as blocks: cutting, compressing, indexing and reading ranges."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import visible
from .matching import range_overlaps
from .ordered import offsets


def chunks(objects: DataFrame, key: str, data: str, size: int) -> DataFrame:
    """(key, block_no, offset, bytes): each object cut into blocks of ``size`` bytes, the last one shorter."""
    n = F.ceil(F.octet_length(data) / F.lit(size)).cast("int")
    rows = objects.where(F.octet_length(data) > 0).select(key, F.col(data).alias("_d"), F.explode(F.sequence(F.lit(0), n - 1)).alias("block_no"))
    return rows.select(key, F.col("block_no").cast("bigint").alias("block_no"), (F.col("block_no").cast("bigint") * size).alias("offset"), F.substring("_d", F.col("block_no") * size + 1, F.lit(size)).alias("bytes"))


def compressed(blocks: DataFrame, level: int = 6) -> DataFrame:
    """Blocks with ``packed`` and ``is_raw``: deflated, or as they are where that is not smaller."""

    @F.pandas_udf("packed binary, is_raw boolean")
    def pack(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for s in parts:
            got = [zlib.compress(bytes(x), level) for x in s]
            raw = [len(g) >= len(x) for g, x in zip(got, s)]
            yield pd.DataFrame({"packed": [bytes(x) if r else g for g, x, r in zip(got, s, raw)], "is_raw": raw})

    visible(blocks.sparkSession)
    return blocks.withColumn("_p", pack("bytes")).select(*blocks.columns, "_p.packed", "_p.is_raw")


def decompressed(blocks: DataFrame) -> DataFrame:
    """``bytes``, ``ok`` and ``error`` for (packed, is_raw); a corrupt block is a row that is not ok."""

    @F.pandas_udf("ok boolean, bytes binary, error string")
    def unpack(packed: pd.Series, is_raw: pd.Series) -> pd.DataFrame:
        out = []
        for p, raw in zip(packed, is_raw):
            try:
                out.append((True, bytes(p) if raw else zlib.decompress(p), None))
            except zlib.error as e:
                out.append((False, None, str(e)))
        return pd.DataFrame(out, columns=["ok", "bytes", "error"])

    visible(blocks.sparkSession)
    return blocks.withColumn("_u", unpack("packed", "is_raw")).select(*[c for c in blocks.columns if c not in ("bytes", "ok", "error")], "_u.bytes", "_u.ok", "_u.error")


def seek_index(blocks: DataFrame, key: str, packed: str = "packed") -> DataFrame:
    """Where each packed block lies in its container."""
    return offsets(blocks.select(key, "block_no", "offset", F.octet_length(packed).cast("bigint").alias("packed_size")), [key], [F.col("block_no")], F.col("packed_size"), name="packed_offset")


def read_ranges(reads: DataFrame, blocks: DataFrame, key: str, size: int) -> DataFrame:
    """(key, read_no, bytes) of byte ranges (key, read_no, v_start, v_end): only the blocks that a range touches are joined."""
    touched = reads.where("v_end > v_start").withColumn("block_no", F.explode(F.sequence(F.floor(F.col("v_start") / size), F.floor((F.col("v_end") - 1) / size))))
    joined = touched.join(blocks.select(key, "block_no", "offset", "bytes"), [key, "block_no"])
    lo = F.greatest(F.col("v_start") - F.col("offset"), F.lit(0))
    piece = F.substring("bytes", (lo + 1).cast("int"), (F.least(F.col("v_end") - F.col("offset"), F.octet_length("bytes").cast("bigint")) - lo).cast("int"))
    parts = joined.groupBy(key, "read_no").agg(F.array_sort(F.collect_list(F.struct("block_no", F.hex(piece).alias("h")))).alias("p"))
    return parts.select(key, "read_no", F.unhex(F.array_join(F.transform("p", lambda x: x["h"]), "")).alias("bytes"))


def sparse_reads(reads: DataFrame, extents: DataFrame, blocks: DataFrame, key: str, size: int) -> DataFrame:
    """(key, read_no, bytes) of byte ranges of virtual objects; what no extent covers reads as zeros.

    Extents (key, e_start, e_end, src, p_start) say where a range lies in the physical object ``src``, of which
    ``blocks`` (src, block_no, offset, bytes) are the blocks of ``size`` bytes.  Extents of a key do not overlap.
    """
    pieces = range_overlaps(reads, extents, key, size)
    asked = pieces.select(key, F.col("read_no").alias("_read"), F.col("from").alias("_from"), "src", F.col("p_from").alias("v_start"), (F.col("p_from") + F.col("until") - F.col("from")).alias("v_end"))
    asked = asked.withColumn("read_no", F.struct(key, "_read", "_from"))
    got = read_ranges(asked.select("src", "read_no", "v_start", "v_end"), blocks, "src", size)
    parts = got.groupBy(F.col(f"read_no.{key}").alias(key), F.col("read_no._read").alias("read_no")).agg(F.array_sort(F.collect_list(F.struct(F.col("read_no._from").alias("at"), F.hex("bytes").alias("h")))).alias("p"))
    zeros = F.repeat(F.lit("00"), (F.col("v_end") - F.col("v_start")).cast("int"))
    laid = F.aggregate(F.coalesce("p", F.array().cast("array<struct<at:bigint,h:string>>")), zeros, lambda s, x: F.overlay(s, x["h"], ((x["at"] - F.col("v_start")) * 2 + 1).cast("int"), F.length(x["h"])))
    return reads.where("v_end > v_start").join(parts, [key, "read_no"], "left").select(key, "read_no", F.unhex(laid).alias("bytes"))


def transcoded(packed: DataFrame, key: str, size: int, to: int, level: int = 6) -> DataFrame:
    """Packed blocks of ``size`` bytes as packed blocks of ``to`` bytes: (key, block_no, offset, bytes, packed, is_raw).

    Each block's bytes go to the one or few new blocks that they lie in, so no object is ever whole.
    """
    plain = decompressed(packed).select(key, "offset", "bytes")
    first, last = F.floor(F.col("offset") / to), F.floor((F.col("offset") + F.octet_length("bytes") - 1) / to)
    parts = plain.where(F.octet_length("bytes") > 0).withColumn("_no", F.explode(F.sequence(first, last)))
    lo = F.greatest(F.col("_no") * to - F.col("offset"), F.lit(0))
    hi = F.least((F.col("_no") + 1) * to - F.col("offset"), F.octet_length("bytes"))
    piece = F.struct("offset", F.hex(F.substring("bytes", (lo + 1).cast("int"), (hi - lo).cast("int"))).alias("h"))
    new = parts.groupBy(key, F.col("_no").alias("block_no")).agg(F.array_sort(F.collect_list(piece)).alias("p"))
    whole = new.select(key, "block_no", (F.col("block_no") * to).alias("offset"), F.unhex(F.array_join(F.transform("p", lambda x: x["h"]), "")).alias("bytes"))
    return compressed(whole, level)


def reframed(sectors: DataFrame, data: str, header: int, keep: int) -> DataFrame:
    """Sectors cut down to ``keep`` bytes after a header (2352 to 2048, 2448 to 2352 and the like)."""
    return sectors.withColumn(data, F.substring(data, header + 1, keep))


def delta_applied(segments: DataFrame, originals: DataFrame, key: str) -> DataFrame:
    """Objects rebuilt from segments (key, nth, src 'base' or 'delta', at, size, bytes) over (key, bytes) in order.

    A base segment takes its range from the original, a delta segment has its own bytes.
    """
    joined = segments.join(originals.select(key, F.col("bytes").alias("_base")), key, "left")
    part = F.when(F.col("src") == "base", F.substring("_base", F.col("at").cast("int") + 1, F.col("size").cast("int"))).otherwise(F.col("bytes"))
    parts = joined.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("nth", F.hex(part).alias("h")))).alias("p"))
    return parts.select(key, F.unhex(F.array_join(F.transform("p", lambda x: x["h"]), "")).alias("bytes"))
