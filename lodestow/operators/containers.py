"""How files are laid out in containers, and containers taken apart."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.names import base_name, directory
from ..functions.numbers import align_up, le_bytes, little_endian
from .ordered import offsets, sequential_bins, spread_sums


def partition_layout(entries: DataFrame, container: str, name: str, size: str, head: int = 16, entry: int = 24, step: int = 16) -> DataFrame:
    """Entries in order of their names' bytes with name_offset (in the table of names, each closed by a zero),
    data_offset (from the end of the header) and header_size: ``head`` and ``entry`` bytes an entry, and the names rounded up to ``step``.
    """
    order, named, sized = [F.col(name)], F.octet_length(name).cast("bigint") + 1, F.col(size).cast("bigint")
    placed = spread_sums(spread_sums(entries, [container], order, named, "name_offset"), [container], order, sized, "data_offset")
    placed = placed.withColumn("name_offset", F.col("name_offset") - named).withColumn("data_offset", F.col("data_offset") - sized)
    sums = entries.groupBy(F.col(container).alias("_c")).agg((head + F.count("*") * entry + align_up(F.sum(named), step)).alias("header_size"))
    return placed.join(sums, F.col(container).eqNullSafe(F.col("_c"))).drop("_c")


def hashed_layout(entries: DataFrame, container: str, name: str, data: str, region: int = 512) -> DataFrame:
    """As ``partition_layout`` with larger entries, and the SHA-256 of the first ``region`` bytes of each."""
    hashed = entries.withColumn("size", F.octet_length(data).cast("bigint")).withColumn("sha256", F.sha2(F.substring(data, 1, region), 256)).drop(data)
    return partition_layout(hashed, container, name, "size", entry=64)


def container_bytes(entries: DataFrame, container: str, name: str, data: str) -> DataFrame:
    """(container, content): small containers in whole: a mark, the number of files, the size of the table of names, an
    entry (offset, size, name's offset) of 24 bytes for each, the names, the data.  For containers that fit into a row;
    of larger ones ``partition_layout`` gives the places, and blocks are written to them.
    """
    placed = partition_layout(entries.withColumn("_size", F.octet_length(data)), container, name, "_size")
    entry = F.concat(le_bytes(F.col("data_offset"), 8), le_bytes(F.col("_size"), 8), le_bytes(F.col("name_offset"), 4), F.lit(bytes(4)))
    each = F.struct(F.col(name).alias("n"), F.hex(entry).alias("e"), F.hex(F.encode(name, "UTF-8")).alias("s"), F.hex(data).alias("d"))
    rows = placed.groupBy(container).agg(F.array_sort(F.collect_list(each)).alias("f"), F.max("header_size").alias("header_size"))
    joined = lambda f: F.unhex(F.array_join(F.transform("f", f), ""))
    strings = (F.col("header_size") - 16 - F.size("f") * 24).cast("int")
    names = F.rpad(joined(lambda x: F.concat(x["s"], F.lit("00"))), strings, F.lit(b"\0"))
    return rows.select(container, F.concat(F.lit(b"PFS0"), le_bytes(F.size("f"), 4), le_bytes(strings, 4), F.lit(bytes(4)), joined(lambda x: x["e"]), names, joined(lambda x: x["d"])).alias("content"))


def container_entries(df: DataFrame, container: str, data: str) -> DataFrame:
    """(container, name, offset, size, bytes) of the files in containers as ``container_bytes`` makes them; none of other bytes."""
    d = F.col("_d")
    rows = df.where(F.substring(data, 1, 4) == F.lit(b"PFS0")).select(container, F.col(data).alias("_d"), little_endian(F.col(data), 4, 4).cast("int").alias("_count"), little_endian(F.col(data), 8, 4).cast("int").alias("_strings"))
    rows = rows.where("_count > 0").withColumn("_n", F.explode(F.sequence(F.lit(0), F.col("_count") - 1)))
    of = lambda o, n: little_endian(d, F.lit(16 + o) + F.col("_n") * 24, n)
    names = F.lit(16) + F.col("_count") * 24
    name = F.unhex(F.regexp_extract(F.hex(F.substring(d, (names + of(16, 4) + 1).cast("int"), F.col("_strings"))), r"^((?:(?!00)..)*)", 1))
    body = F.substring(d, (names + F.col("_strings") + of(0, 7) + 1).cast("int"), of(8, 7).cast("int"))
    return rows.select(container, F.decode(name, "UTF-8").alias("name"), of(0, 7).alias("offset"), of(8, 7).alias("size"), body.alias("bytes"))


def split_by_id(contents: DataFrame, metas: DataFrame, file: str, ident: str, digits: int = 32) -> DataFrame:
    """Contents with the meta whose id (of ``digits`` hex digits) their file's name begins with: equality on the beginning."""
    return contents.join(metas.withColumn("_id", F.lower(ident)), F.lower(F.substring(file, 1, digits)) == F.col("_id")).drop("_id")


def gdi_text(tracks: DataFrame, disc: str) -> DataFrame:
    """(disc, text): the GDI sheet of tracks (disc, number, lba, type, sector, file, offset)."""
    quoted = F.when(F.contains("file", F.lit(" ")), F.concat(F.lit('"'), F.col("file"), F.lit('"'))).otherwise(F.col("file"))
    line = F.concat_ws(" ", *[F.col(c).cast("string") for c in ("number", "lba", "type", "sector")], quoted, F.col("offset").cast("string"))
    sheets = tracks.groupBy(disc).agg(F.array_sort(F.collect_list(F.struct("number", line.alias("l")))).alias("t"))  # tracks of a disc are at most 99
    return sheets.select(disc, F.concat_ws("\n", F.size("t").cast("string"), F.array_join(F.transform("t", lambda x: x["l"]), "\n")).alias("text"))


def track_starts(tracks: DataFrame, disc: str, number: str, frames: str, pregap: Column, pad: int = 4) -> DataFrame:
    """physical (frames before), padded (each track rounded up to ``pad``) and logical (pregaps counted) starts of tracks."""
    order = [F.col(number)]
    out = offsets(tracks, [disc], order, F.col(frames), name="physical")
    out = offsets(out, [disc], order, F.col(frames), pad, name="padded")
    return offsets(out, [disc], order, F.col(frames) + pregap, start=pregap, name="logical")


#: Bytes of a disc's sector of files, and of a folder's record without its name.
SECTOR, _RECORD = 2048, 33


def disc_layout(entries: DataFrame, first: int = 18) -> DataFrame:
    """(path, is_dir, sectors, lba): where a disc image's folders and then its files lie, in order of their paths.

    Entries are (path, is_dir, size), the top folder '' left out.  A folder's records, two of its own and one
    for each of its entries, do not go over the end of a sector; a file takes whole sectors, none if it is empty.
    """
    name = base_name(F.col("path"))
    records = entries.select(directory(F.col("path")).alias("folder"), F.concat(F.lit("2"), name).alias("name"), (_RECORD + F.octet_length(name) + F.pmod(_RECORD + F.octet_length(name), F.lit(2))).alias("size"))
    folders = entries.where("is_dir").select("path").union(entries.sparkSession.range(1).select(F.lit("").alias("path")))
    own = folders.select(F.col("path").alias("folder"), F.explode(F.array(F.lit("0"), F.lit("1"))).alias("name"), F.lit(_RECORD + 1).alias("size"))
    packed = sequential_bins(own.unionByName(records), ["folder"], "name", "size", SECTOR)
    sized = packed.groupBy(F.col("folder").alias("path")).agg((F.max("bin") + 1).alias("sectors")).join(folders, "path", "left_semi").select("path", F.lit(True).alias("is_dir"), "sectors")
    files = entries.where("not is_dir").select("path", "is_dir", F.ceil(F.col("size") / SECTOR).cast("bigint").alias("sectors"))
    placed = spread_sums(sized.unionByName(files), [], [F.col("is_dir").desc(), F.col("path")], F.col("sectors"), "lba")
    return placed.withColumn("lba", F.col("lba") - F.col("sectors") + first)
