"""Binary patches: detection, application, creation.  Faults are rows, not failed jobs.

A patch is parsed into records; records go to the blocks of the object that they touch, and a block is laid over
with its records in order.  Objects that are rows are cut into blocks where they lie: a row's blocks follow one another
out of the row, so a task reads them in order and nothing is shuffled.  Objects of any size are rows of blocks, which
meet their records by (key, block_no).  Formats that copy (BPS, VCDIFF) have records whose bytes are ranges of the
source, read from its blocks; what they copy from their own target is resolved to these when the patch is parsed.
Creation is the reverse: blocks of source and target meet, and what differs in a block is its records.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..functions import names
from ..functions import patch_formats as P
from ..session import visible
from .catalog import first_rule

#: Bytes of a block of an object.
BLOCK = 1 << 16


def patch_format(patch: Column) -> Column:
    """The format by what a patch begins with; null for none (and for fewer than four bytes)."""
    rules = [((F.octet_length(patch) >= 4) & (F.substring(patch, 1, len(m)) == F.lit(m)), name) for name, m in P.MAGIC.items()]
    return first_rule(rules)


_RECORDS = "array<struct<seq:bigint,at:bigint,data:binary,n:bigint,place:bigint>>"
_HEAD = f"grows boolean, xor boolean, source_size bigint, target_size bigint, source_crc bigint, target_crc bigint, check_at bigint, check_bytes binary, copies boolean, error string, records {_RECORDS}"


def _streamed(df: DataFrame, run: Callable[[Iterator[tuple]], Iterable[tuple]], schema: StructType, few: int = 128) -> DataFrame:
    """What ``run`` makes of a partition's rows, read and written a few at a time."""
    kinds = to_arrow_schema(schema)

    def go(batches):
        rows = (r for b in batches for lo in range(0, b.num_rows, few) for r in zip(*(c.to_pylist() for c in b.slice(lo, few).columns)))
        done = iter(run(rows))
        while part := [r for _, r in zip(range(few), done)]:
            yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*part), kinds.types)], schema=kinds)

    visible(df.sparkSession)
    return df.mapInArrow(go, schema)


def _types(df: DataFrame, columns: list[str]) -> str:
    return ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in columns)


def records(patches: DataFrame, key: str, patch: str = "patch") -> DataFrame:
    """``patches`` without the patch: ``format``, what it says of the objects, ``records`` (seq, at, data, n, place), or its fault.

    A record without data takes ``n`` bytes of the source from ``place`` on.
    """
    kept = [c for c in patches.columns if c not in (key, patch, "format")]

    def run(rows):
        for k, fmt, body, *rest in rows:
            try:
                P.need(fmt is not None, "unknown format")
                got, error = P.parsed(body, fmt), None
            except ValueError as e:
                got, error = P.Patch(), str(e)
            recs = [(at, data, len(data), None) for at, data in got.records] + [(at, None, n, place) for at, n, place in got.copies or []]
            head = (got.grows, got.xor, got.source_size, got.target_size, got.source_crc, got.target_crc, got.check_at, got.check, got.copies is not None, error)
            yield k, fmt, *rest, *head, [(i, *r) for i, r in enumerate(recs)]

    rows = patches.select(key, patch_format(F.col(patch)).alias("format"), patch, *kept)
    return _streamed(rows, run, StructType.fromDDL(f"{_types(rows, [key, 'format', *kept])}, {_HEAD}"))


def xored(a: Column, b: Column) -> Column:
    """Two byte strings of one length, exclusive-or, seven bytes at a time."""
    x, y = F.hex(a), F.hex(b)
    digits = lambda c, i: F.conv(F.substring(c, i * 14 + 1, F.lit(14)), 16, 10).cast("bigint")
    width = F.length(x)
    part = lambda i: F.lpad(F.hex(digits(x, i).bitwiseXOR(digits(y, i))), F.least(F.lit(14), width - i * 14), F.lit("0"))
    return F.unhex(F.array_join(F.transform(F.sequence(F.lit(0), F.ceil(width / 14).cast("int") - 1), part), ""))


def patched_blocks(blocks: DataFrame, recs: DataFrame, sizes: DataFrame, key: str, size: int = BLOCK) -> DataFrame:
    """(key, block_no, bytes) of objects after their records.

    ``blocks``: (key, block_no, bytes) of ``size`` bytes; ``recs``: (key, seq, at, data, xor); ``sizes``: (key, n) how large
    the results are.  A record goes to each block that it touches; a block takes its pieces in order of records,
    so the last one written counts.  What nobody has written is zero.
    """
    grid = sizes.where("n > 0").select(key, "n", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("n") - 1) / size))).alias("block_no"))
    pieces = recs.where(F.octet_length("data") > 0).withColumn("block_no", F.explode(F.sequence(F.floor(F.col("at") / size), F.floor((F.col("at") + F.octet_length("data") - 1) / size))))
    start = F.col("block_no") * size - F.col("at")
    lo = F.greatest(start, F.lit(0))
    piece = F.substring("data", (lo + 1).cast("int"), (F.least(start + size, F.octet_length("data").cast("bigint")) - lo).cast("int"))
    laid = pieces.groupBy(key, "block_no").agg(F.array_sort(F.collect_list(F.struct("seq", (lo - start).cast("int").alias("at"), piece.alias("d"), "xor"))).alias("p"))
    met = grid.join(blocks.select(key, "block_no", "bytes"), [key, "block_no"], "left").join(laid, [key, "block_no"], "left")
    room = F.least(F.col("n") - F.col("block_no") * size, F.lit(size)).cast("int")
    base = F.rpad(F.coalesce("bytes", F.lit(b"")), room, F.lit(b"\0"))

    def step(body: Column, x: Column) -> Column:
        fits = F.substring(x["d"], 1, F.greatest(room - x["at"], F.lit(0)))
        new = F.when(x["xor"], xored(F.substring(body, x["at"] + 1, F.octet_length(fits)), fits)).otherwise(fits)
        return F.when(F.octet_length(fits) > 0, F.overlay(body, new, x["at"] + 1)).otherwise(body)

    return met.select(key, "block_no", F.when(F.col("p").isNull(), base).otherwise(F.aggregate("p", base, step)).alias("bytes"))


def applied(df: DataFrame, key: str, patch: str = "patch", source: str = "source", size: int = BLOCK) -> DataFrame:
    """(key, format, ok, bytes, error) for rows (key, patch, source); the format is found by what the patch begins with.

    What a patch says of its objects (sizes, checksums, a block's bytes) is held against them.  ``patched_blocks``
    takes objects of any size; here they come and go as rows.
    """
    told = records(df.select(key, F.col(patch).alias("_p"), F.col(source).alias("_s")), key, "_p")
    furthest = lambda at: F.array_max(F.transform("records", lambda r: r[at] + r["n"]))
    told = told.select("*", F.octet_length("_s").cast("bigint").alias("_n"), F.crc32("_s").alias("_c"), furthest("at").alias("_end"), furthest("place").alias("_reach"))
    held = F.substring("_s", F.col("check_at").cast("int") + 1, F.octet_length("check_bytes"))
    fault = F.coalesce(
        "error",
        F.when(F.col("_n").isNull(), "no source"),
        F.when((F.col("source_size") != F.col("_n")) | (F.col("source_crc") != F.col("_c")), "source checksum"),
        F.when(F.col("check_at").isNotNull() & ~(held == F.col("check_bytes")), "block check"),
        F.when((~F.col("grows") & ~F.col("xor") & (F.col("_end") > F.col("_n"))) | (F.col("_reach") > F.col("_n")), "outside the source"),
    )
    n = F.coalesce("target_size", F.greatest("_n", F.coalesce("_end", F.lit(0))))
    judged = told.select(key, "format", fault.alias("error"), n.alias("n"), "xor", "copies", "target_crc", "records", "_s")

    def block(no: Column) -> Column:
        start = no * size

        def piece(r: Column) -> Column:
            lo = F.greatest(start - r["at"], F.lit(0))
            length = (F.least(start + size - r["at"], r["n"]) - lo).cast("int")
            own = F.substring(r["data"], (lo + 1).cast("int"), length)
            return F.struct((r["at"] + lo - start).cast("int").alias("at"), F.when(r["data"].isNotNull(), own).otherwise(F.substring("_s", (r["place"] + lo + 1).cast("int"), length)).alias("d"))

        body = F.when(~F.col("copies"), F.substring("_s", (start + 1).cast("int"), F.lit(size)))  # a patch that copies builds anew
        touching = F.filter("records", lambda r: (r["at"] < start + size) & (r["at"] + r["n"] > start))
        return F.struct(no.alias("block_no"), body.alias("body"), F.transform(touching, piece).alias("pieces"))

    places = F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("n") - 1) / size))
    cut_up = judged.select(key, "format", "error", "n", "xor", "target_crc", F.when(F.col("error").isNull() & (F.col("n") > 0), F.transform(places, block)).alias("_b"))
    rows = cut_up.select(key, "format", "error", "n", "xor", "target_crc", F.inline_outer("_b")).select(key, "format", "error", "n", "xor", "target_crc", "block_no", "body", "pieces.at", "pieces.d")

    def run(rows):
        whole = []
        for k, fmt, error, n, xor, crc, no, body, at, data in rows:
            if no is not None:
                whole.append(P.laid(body or b"", min(size, n - no * size), zip(at, data), xor))
                if (no + 1) * size < n:
                    continue
            made, whole = b"".join(whole), []
            if error is None and crc is not None and crc != zlib.crc32(made):
                error = "target checksum"
            yield k, fmt, error is None, made if error is None else None, error

    return _streamed(rows, run, StructType.fromDDL(f"{_types(rows, [key])}, format string, ok boolean, bytes binary, error string"))


def created(df: DataFrame, key: str, kind: str, source: str = "source", target: str = "target", size: int = BLOCK, keep: tuple[str, ...] = ()) -> DataFrame:
    """(key, patch, error) that turns each source into its target, and the columns ``keep``; null where the format cannot."""
    sizes = [f(F.col(c)).cast("bigint").alias(n) for c, x in ((source, "a"), (target, "b")) for n, f in ((f"_n{x}", F.octet_length), (f"_c{x}", F.crc32))]
    last = F.floor((F.greatest(F.octet_length(source), F.octet_length(target), F.lit(1)) - 1) / size)
    block = lambda no: F.struct(no.alias("block_no"), *[F.substring(c, (no * size + 1).cast("int"), F.lit(size)).alias(n) for c, n in ((source, "_a"), (target, "_b"))], *[F.when(no == 0, F.col(c)).alias(c) for c in keep])
    cut_up = df.select(key, *sizes, last.alias("_last"), F.transform(F.sequence(F.lit(0).cast("bigint"), last), block).alias("_x"))
    rows = cut_up.select(key, "_na", "_ca", "_nb", "_cb", "_last", F.inline("_x"))

    def run(rows):
        encoder = error = begun = kept = None
        for k, na, ca, nb, cb, last, no, a, b, *first in rows:
            if no == 0:
                encoder, error, begun, kept = None, None, None, first
                try:
                    P.need(na is not None and nb is not None, "no source or no target")
                    encoder = P.Encoder(kind, (na, nb), (ca, cb))
                except ValueError as e:
                    error = str(e)
            for at, data in P.differences(kind, no * size, a, b) if encoder else ():
                if kind == "ups" and begun and begun[0] + len(begun[1]) == at:  # goes on over the end of a block: one record
                    begun[1].extend(data)
                    continue
                if begun:
                    encoder.add(*begun)
                begun = at, bytearray(data)
            if no == last:
                if begun:
                    encoder.add(*begun)
                yield k, encoder.done() if encoder else None, error, *kept

    return _streamed(rows, run, StructType.fromDDL(f"{_types(rows, [key])}, patch binary, error string{''.join(', ' + _types(rows, [c]) for c in keep)}"))


def batch_targets(patches: DataFrame, files: DataFrame, path: str) -> DataFrame:
    """``patches`` with ``kind`` and ``target``: the file that each one is for.

    A file that is no patch takes the place of its own path.  A patch is for the file of its name without the
    ending, or with another ending than that: in its own folder, or else anywhere, the first by path; whatever
    the case.  Null: there is none.
    """
    # small files of paths are many rows: neither side is broadcast, and what is sorted has been dealt by key before
    known = files.select(F.col(path).alias("_file"), F.explode(F.array_distinct(F.array(F.upper(names.stem(F.col(path))), F.upper(names.base_name(F.col(path)))))).alias("_k")).withColumn("_dir", F.upper(names.directory(F.col("_file"))))
    near = known.repartition("_dir", "_k").groupBy("_dir", "_k").agg(F.min("_file").alias("_near"))
    far = near.groupBy("_k").agg(F.min("_near").alias("_far"))
    asked = patches.withColumn("kind", names.patch_kind(F.col(path)))
    own = asked.where("kind = 'overwrite'").withColumn("target", F.col(path))
    others = asked.where("kind = 'patch'").withColumn("_k", F.upper(names.patch_target(F.col(path)))).withColumn("_dir", F.upper(names.directory(F.col(path))))
    met = others.join(near.hint("merge"), ["_dir", "_k"], "left").join(far.hint("merge"), "_k", "left")
    return met.select(*asked.columns, F.coalesce("_near", "_far").alias("target")).unionByName(own)


def batch_applied(files: DataFrame, patches: DataFrame, path: str = "path", content: str = "content") -> DataFrame:
    """(path, content, how, error): a tree of files after a folder of patches: kept, overwritten, new, patched or failed.

    Of several patches for one file the first by path is applied; a file whose patch fails stays as it was.
    """
    kind = names.patch_kind(F.col(path))
    over = patches.where((kind == "overwrite") & F.col(path).isNotNull()).select(path, F.col(content).alias("_new"))
    made = patches.where(kind == "patch")
    own = lambda df, name: df.select(F.col(path).alias(name), F.col(content).alias(f"_{name}"))
    first = batch_targets(made.select(path), files.select(path), path).where("kind = 'patch' and target is not null").groupBy(F.col("target").alias("_file")).agg(F.min(path).alias("_patch"))
    met = first.join(own(made, "_patch").hint("merge"), "_patch").join(own(files, "_file").hint("merge"), "_file")
    done = applied(met.select(F.col("_file").alias(path), F.col("__patch").alias("patch"), F.col("__file").alias("source")), path).select(path, "ok", F.col("bytes").alias("_bytes"), "error")
    whole = files.select(path, content).join(over.hint("merge"), path, "full").join(done.hint("merge"), path, "left")
    how = F.when(F.col("_new").isNotNull(), F.when(F.col(content).isNull(), "new").otherwise("overwritten")).when(F.col("ok"), "patched").when(~F.col("ok"), "failed").otherwise("kept")
    return whole.select(path, F.coalesce("_new", "_bytes", content).alias(content), how.alias("how"), F.when(F.col("_new").isNull(), F.col("error")).alias("error"))
