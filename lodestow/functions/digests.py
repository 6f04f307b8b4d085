"""Checksums, block hashes and their verification."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut

_SHA = {"md5": F.md5, "sha1": F.sha1, "sha256": lambda c: F.sha2(c, 256)}


def digest(data: Column, method: str) -> Column:
    """Lower-case hex digest of bytes by md5, sha1, sha256 or crc32; empty bytes have one too."""
    if method == "crc32":
        return F.lpad(F.lower(F.hex(F.crc32(data))), 8, "0")
    return _SHA[method](data)


def prefix_digest(data: Column, limit: int) -> Column:
    """SHA-256 of the first ``limit`` bytes."""
    return F.sha2(F.substring(data, 1, limit), 256)


def synthetic_id(name: Column) -> Column:
    """A 14-digit title id made of a name's checksum."""
    return F.concat(F.lit("010"), F.upper(digest(F.encode(name, "UTF-8"), "crc32")), F.lit("000"))


def block_hashes(data: Column, size: int) -> Column:
    """SHA-256 of each block of ``size`` bytes, the last one filled up with zeros; none for empty bytes.

    One expression in the row: for objects of up to some MB.  Larger ones are stored as a row a block.
    """
    n = F.ceil(F.octet_length(data) / F.lit(size)).cast("int")
    zeros = F.lit(bytes(size))

    def block(i: Column) -> Column:
        part = F.substring(data, i * size + 1, F.lit(size))
        return F.sha2(F.when(i < n - 1, part).otherwise(F.substring(F.concat(part, zeros), 1, size)), 256)

    return F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), block)).otherwise(F.array().cast("array<string>"))


def padded_sha1(data: Column, step: int) -> Column:
    """SHA-1 of the bytes with zeros up to the next multiple of ``step``."""
    short = F.pmod(-F.octet_length(data), F.lit(step))
    return F.sha1(F.concat(data, F.unhex(F.repeat(F.lit("00"), short))))


def hash_levels(blocks: DataFrame, key: list[str], block_no: str, data: str, size: int, fan: int = 16, levels: int = 4) -> DataFrame:
    """(key, level, node, sha1) of a tree of SHA-1: level 0 of each block filled up to ``size`` bytes with zeros, each
    level above of ``fan`` hashes of the one below, those that are missing as zeros.

    A level is one aggregation on (key, node) over the one below, which is computed once; nothing larger than
    ``fan`` hashes is put together.
    """
    short = F.lit(size) - F.octet_length(data)
    level = blocks.select(*key, F.lit(0).alias("level"), F.col(block_no).cast("bigint").alias("node"), F.sha1(F.concat(F.col(data), F.unhex(F.repeat(F.lit("00"), short)))).alias("sha1"))
    out = level = cut(level)
    for n in range(1, levels):
        place = F.pmod("node", F.lit(fan)).cast("int")
        parts = [F.coalesce(F.max(F.when(place == i, F.col("sha1"))), F.lit("00" * 20)) for i in range(fan)]
        level = level.groupBy(*key, F.expr(f"node div {fan}").alias("up")).agg(F.sha1(F.unhex(F.concat(*parts))).alias("sha1"))
        level = level.select(*key, F.lit(n).alias("level"), F.col("up").alias("node"), "sha1")
        level = cut(level) if n < levels - 1 else level
        out = out.unionByName(level)
    return out


def hash_tree_root(leaves: Column) -> Column:
    """SHA-256 of the leaves' bytes end to end."""
    return F.sha2(F.unhex(F.array_join(leaves, "")), 256)


def verified_blocks(blocks: DataFrame, expected: DataFrame, key: list[str]) -> DataFrame:
    """Blocks (key, bytes) against rows (key, sha256): ``ok``, and the bytes or, where they are corrupt, zeros.

    A block without an expected hash is not ok and is kept.
    """
    joined = blocks.join(expected.select(*key, F.col("sha256").alias("_want")), key, "left")
    ok = F.coalesce(F.sha2("bytes", 256) == F.col("_want"), F.lit(False))
    zeros = F.unhex(F.repeat(F.lit("00"), F.octet_length("bytes")))
    return joined.withColumn("ok", ok).withColumn("bytes", F.when(ok | F.col("_want").isNull(), F.col("bytes")).otherwise(zeros)).drop("_want")


def path_hash(name: Column, seed: int = 123456789) -> Column:
    """A 32-bit hash of a name: rotate right by five, then exclusive-or with each UTF-16 unit."""
    digits = F.hex(F.encode(name, "UTF-16BE"))
    places = F.when(F.length(digits) > 0, F.sequence(F.lit(0), (F.length(digits) / 4).cast("int") - 1)).otherwise(F.array().cast("array<int>"))
    units = F.transform(places, lambda i: F.conv(F.substring(digits, i * 4 + 1, F.lit(4)), 16, 10).cast("bigint"))

    def step(h: Column, u: Column) -> Column:
        turned = F.shiftrightunsigned(h, 5).bitwiseOR(F.shiftleft(h.bitwiseAND(F.lit(31)), 27))
        return turned.bitwiseXOR(u).bitwiseAND(F.lit(0xFFFFFFFF))

    return F.aggregate(units, F.lit(seed).cast("bigint"), step)
