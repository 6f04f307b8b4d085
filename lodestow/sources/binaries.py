"""Small binary structures as rows, by column functions on their bytes: parameter tables, seek tables, track blocks, image headers, folders of disc images."""

from __future__ import annotations

from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import be_bytes, big_endian, le_bytes, little_endian
from ..operators.catalog import first_rule
from ..session import visible

#: What files begin with, or have at an offset, by format; the first that holds counts.
MAGICS = [
    (0, b"Z3DS", "zcci"), (0, b"MComprHD", "chd"), (0, b"RVZ\x01", "rvz"), (0, b"\x01\xc0\x0b\xb1", "gcz"), (0, b"WIA\x01", "wia"), (0, b"WBFS", "wbfs"),
    (0x100, b"NCSD", "cci"), (0x18, b"\x5d\x1c\x9e\xa3", "wii"), (0x1C, b"\xc2\x33\x9f\x3d", "gcm"), (0x8001, b"CD001", "iso"),
]
#: Formats that an extension settles.
EXTENSIONS = ("cue", "bin", "gdi", "ccd", "nsp", "nsz", "xci", "xcz", "zcci", "cia")
#: What a format is turned into.
TURNED_INTO = {
    "cue": "chd", "bin": "chd", "gdi": "chd", "ccd": "chd", "iso": "chd", "nsp": "nsz", "nsz": "nsp", "xci": "xcz", "xcz": "xci", "zcci": "cci", "cia": "zcci", "cci": "zcci",
    "gcz": "rvz", "wia": "rvz", "wbfs": "rvz", "wii": "rvz", "gcm": "rvz", "rvz": "iso",
}


def file_format(ext: Column, data: Column) -> Column:
    """The format by the extension, or else by the bytes; null for neither."""
    at = lambda offset, magic: F.substring(data, offset + 1, len(magic)) == F.lit(magic)
    rules = [(F.lower(ext) == e, e) for e in EXTENSIONS] + [(at(o, m), name) for o, m, name in MAGICS]
    return first_rule(rules)


def turned_into(kind: Column, data: Column) -> Column:
    """What a format is compressed to or restored to; an rvz image by the kind of disc that its first 256 bytes name."""
    head = F.hex(F.substring(data, 1, 256))
    held = lambda x: F.regexp_replace(head, f"^(?:..)*?{x}", "") != head
    disc = F.when(held("5D1C9EA3"), "wbfs").when(held("C2339F3D"), "gcm")
    return F.coalesce(F.when(kind == "rvz", disc), *[F.when(kind == k, F.lit(v)) for k, v in TURNED_INTO.items()])


def _entries(df: DataFrame, key: str, data: str, count: Column) -> DataFrame:
    return df.select(key, F.col(data).alias("_d"), F.posexplode(F.when(count > 0, F.sequence(F.lit(0), count.cast("int") - 1)).otherwise(F.array().cast("array<int>"))).alias("nth", "_n")).drop("_n")


def _until_zero(data: Column, at: Column) -> Column:
    """The text from a place up to the next zero byte."""
    rest = F.hex(F.substring(data, at.cast("int") + 1, F.octet_length(data)))
    return F.decode(F.unhex(F.regexp_extract(rest, r"^((?:(?!00)..)*)", 1)), "US-ASCII")


def sfo_entries(df: DataFrame, key: str = "id", data: str = "content") -> DataFrame:
    """(key, nth, name, value) of parameter tables: texts and 32-bit numbers (as texts); null values of other kinds."""
    good = df.where(F.substring(data, 1, 4) == F.lit(b"\0PSF"))
    rows = _entries(good, key, data, little_endian(F.col(data), 16, 4))
    d = F.col("_d")
    at = lambda o, n: little_endian(d, F.lit(20 + o) + F.col("nth") * 16, n)
    names, values = little_endian(d, 8, 4), little_endian(d, 12, 4)
    number = little_endian(d, (values + at(12, 4)).cast("int"), 4)
    signed = F.when(number >= 1 << 31, number - (1 << 32)).otherwise(number)
    value = F.when(at(2, 2) == 0x0204, _until_zero(d, values + at(12, 4))).when(at(2, 2) == 0x0404, signed.cast("string"))
    return rows.select(key, "nth", _until_zero(d, names + at(0, 2)).alias("name"), value.alias("value"))


def sfo_bytes(df: DataFrame, key: str, name: str, value: str) -> DataFrame:
    """(key, content): a parameter table of texts (key, name, value), in order of their names; a key's are few."""
    each = F.struct(F.col(name).alias("n"), F.col(value).alias("v"), (F.octet_length(name) + 1).alias("ns"), (F.octet_length(value) + 1).alias("vs"), (F.floor((F.octet_length(value) + 4) / 4) * 4).cast("int").alias("room"))
    rows = df.groupBy(key).agg(F.array_sort(F.collect_list(each)).alias("e"))
    before = lambda field, i: F.aggregate(F.slice("e", 1, i), F.lit(0), lambda s, x: s + x[field])
    whole = lambda field: F.aggregate("e", F.lit(0), lambda s, x: s + x[field])
    texts = lambda f: F.unhex(F.array_join(F.transform("e", f), ""))
    hexed = lambda c: F.hex(F.encode(c, "US-ASCII"))
    n, pad = F.size("e"), F.pmod(-whole("ns"), F.lit(4))
    index = texts(lambda x, i: F.concat(*map(F.hex, (le_bytes(before("ns", i), 2), F.lit(b"\x04\x02"), le_bytes(x["vs"], 4), le_bytes(x["room"], 4), le_bytes(before("room", i), 4)))))
    names = texts(lambda x: F.concat(hexed(x["n"]), F.lit("00")))
    values = texts(lambda x: F.rpad(hexed(x["v"]), x["room"] * 2, F.lit("0")))
    key_at = F.lit(20) + n * 16
    head = F.concat(F.lit(b"\0PSF\x01\x01\0\0"), le_bytes(key_at, 4), le_bytes(key_at + whole("ns") + pad, 4), le_bytes(n, 4))
    return rows.select(key, F.concat(head, index, names, F.unhex(F.repeat(F.lit("00"), pad)), values).alias("content"))


#: The marks of a seek table's frame and of its end.
_SEEK_FRAME, _SEEK_END = 0x184D2A5E, 0x8F92EAB1


def seek_table(blocks: DataFrame, key: str, block_no: str, packed: Column, unpacked: Column) -> DataFrame:
    """(key, content): the table that says how large each block is, packed and unpacked, in order."""
    each = F.struct(F.col(block_no).alias("o"), F.hex(F.concat(le_bytes(packed, 4), le_bytes(unpacked, 4))).alias("h"))
    rows = blocks.groupBy(key).agg(F.array_sort(F.collect_list(each)).alias("e"))
    n = F.size("e")
    body = F.unhex(F.array_join(F.transform("e", lambda x: x["h"]), ""))
    return rows.select(key, F.concat(le_bytes(F.lit(_SEEK_FRAME), 4), le_bytes(n * 8 + 9, 4), body, le_bytes(n, 4), F.lit(b"\0"), le_bytes(F.lit(_SEEK_END), 4)).alias("content"))


def seek_entries(df: DataFrame, key: str = "id", data: str = "content") -> DataFrame:
    """(key, block_no, packed_size, size, packed_offset, offset) of the seek table that bytes end with; none without its end mark."""
    size = F.octet_length(data)
    good = df.where(F.substring(data, -4, 4) == F.lit(_SEEK_END.to_bytes(4, "little")))
    count = little_endian(F.col(data), size - 9, 4)
    rows = _entries(good, key, data, F.when(count * 8 + 9 <= size, count))
    start = F.octet_length("_d") - 9 - little_endian(F.col("_d"), F.octet_length("_d") - 9, 4) * 8
    at = lambda o: little_endian(F.col("_d"), (start + F.col("nth") * 8 + o).cast("int"), 4)
    from ..operators.ordered import offsets

    found = rows.select(key, F.col("nth").cast("bigint").alias("block_no"), at(0).alias("packed_size"), at(4).alias("size"))
    placed = offsets(found, [key], [F.col("block_no")], F.col("packed_size"), name="packed_offset")
    return offsets(placed, [key], [F.col("block_no")], F.col("size"), name="offset")


#: Places in track block files: count of a session's blocks, offset of the first, size of one.
_MDS_COUNT, _MDS_FIRST, _MDS_BLOCK = 0x0A, 0x14, 0x50


def mds_tracks(df: DataFrame, key: str = "id", data: str = "content") -> DataFrame:
    """(key, track, mode, sector, subchannel, pregap, length, start) of MDS files: the blocks of points 1 to 99 of the first session.

    ``sector``: bytes of a sector in the image; ``subchannel``: how many of them are beyond 2352, where the block says
    that there is one; ``start``: the track's first byte in the image.
    """
    good = df.where(F.substring(data, 1, 16) == F.lit(b"MEDIA DESCRIPTOR"))
    session = little_endian(F.col(data), 0x50, 4).cast("int")
    placed = good.select(key, F.col(data).alias("_d"), little_endian(F.col(data), session + _MDS_COUNT, 1).alias("_c"), little_endian(F.col(data), session + _MDS_FIRST, 4).alias("_f"))
    rows = placed.select("*", F.explode(F.when(F.col("_c") > 0, F.sequence(F.lit(0), F.col("_c").cast("int") - 1)).otherwise(F.array().cast("array<int>"))).alias("_n"))
    d, at = F.col("_d"), (F.col("_f") + F.col("_n") * _MDS_BLOCK).cast("int")
    of = lambda o, n: little_endian(d, at + o, n)
    extra = of(0x0C, 4).cast("int")
    tracks = rows.select(
        key, of(4, 1).cast("int").alias("track"), of(0, 1).cast("int").alias("mode"), of(0x10, 2).cast("int").alias("sector"),
        F.when(of(1, 1) != 0, F.greatest(of(0x10, 2) - 2352, F.lit(0))).otherwise(0).cast("int").alias("subchannel"),
        little_endian(d, extra, 4).alias("pregap"), little_endian(d, extra + 4, 4).alias("length"), of(0x28, 7).alias("start"),
    )
    return tracks.where("track between 1 and 99")


def mds_bytes(tracks: DataFrame, key: str) -> DataFrame:
    """(key, content): an MDS file of tracks (key, track, mode, sector, pregap, length, start) of one session; a disc has at most 99."""
    rows = tracks.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("track", "mode", "sector", "pregap", "length", "start"))).alias("t"))
    n = F.size("t")
    zeros = lambda k: F.lit(bytes(k))

    def block(x: Column, i: Column) -> Column:
        extra = F.lit(0x70) + n * _MDS_BLOCK + i * 8
        return F.hex(F.concat(le_bytes(x["mode"], 1), F.when(x["sector"] > 2352, F.lit(b"\x08")).otherwise(F.lit(b"\0")), zeros(2), le_bytes(x["track"], 1), zeros(7), le_bytes(extra, 4), le_bytes(x["sector"], 2), zeros(22), le_bytes(x["start"], 8), zeros(32)))

    def sizes(x: Column) -> Column:
        return F.hex(F.concat(le_bytes(x["pregap"], 4), le_bytes(x["length"], 4)))

    joined = lambda f: F.unhex(F.array_join(F.transform("t", f), ""))
    head = F.concat(F.lit(b"MEDIA DESCRIPTOR\x01\x05".ljust(0x50, b"\0")), le_bytes(F.lit(0x58), 4), zeros(4))
    session = F.concat(zeros(10), le_bytes(n, 1), zeros(9), le_bytes(F.lit(0x70), 4))
    return rows.select(key, F.concat(head, session, joined(block), joined(sizes)).alias("content"))


def chd_headers(df: DataFrame, key: str = "id", data: str = "content") -> DataFrame:
    """(key, version, bytes, hunk_bytes, unit_bytes, hunks, codecs, sha1, parent_sha1) of version 5 image headers; none for other bytes."""
    d = F.col(data)
    good = df.where((F.substring(data, 1, 8) == F.lit(b"MComprHD")) & (big_endian(d, 12, 4) == 5) & (F.octet_length(data) >= 124))
    codecs = F.filter(F.array(*[F.decode(F.substring(data, 17 + 4 * i, 4), "US-ASCII") for i in range(4)]), lambda c: c != "\0\0\0\0")
    size, hunk = big_endian(d, 33, 7), big_endian(d, 56, 4)
    return good.select(
        key, big_endian(d, 12, 4).cast("int").alias("version"), size.alias("bytes"), hunk.alias("hunk_bytes"), big_endian(d, 60, 4).alias("unit_bytes"),
        F.ceil(size / hunk).cast("bigint").alias("hunks"), F.array_join(codecs, ",").alias("codecs"), F.lower(F.hex(F.substring(data, 85, 20))).alias("sha1"), F.lower(F.hex(F.substring(data, 105, 20))).alias("parent_sha1"),
    )


def chd_header(version: int, size: Column, hunk: Column, unit: Column, codecs: list[bytes], sha1: Column) -> Column:
    """The first 124 bytes of an image."""
    names = b"".join(codecs).ljust(16, b"\0")
    return F.concat(F.lit(b"MComprHD"), be_bytes(F.lit(124), 4), be_bytes(F.lit(version), 4), F.lit(names), be_bytes(size, 8), F.lit(bytes(16)), be_bytes(hunk, 4), be_bytes(unit, 4), F.lit(bytes(20)), F.unhex(sha1), F.lit(bytes(20)))


#: Bytes of a sector of files, and the place of a volume's root folder in its descriptor.
SECTOR, _ROOT = 2048, 156


def iso_entries(sectors: DataFrame, key: str = "id", descriptor: int = 16) -> DataFrame:
    """(key, path, is_dir, lba, size, extent) of all entries of disc images given as sectors (key, lba, bytes).

    Folders are read level by level: those of a level meet their sectors by equality, and a sector's records
    are rows.  A file in several extents is a row for each.  Images without a descriptor have no rows; a folder
    that stands for one above itself is not gone into.
    """
    spark = visible(sectors.sparkSession)
    kind = sectors.schema[key].dataType.simpleString()
    s = sectors.select(key, F.col("lba").cast("bigint").alias("at"), "bytes")
    roots = s.where((F.col("at") == descriptor) & (F.substring("bytes", 1, 6) == F.lit(b"\x01CD001")))
    folders = roots.select(key, F.lit("").alias("path"), little_endian(F.col("bytes"), _ROOT + 2, 4).alias("lba"), little_endian(F.col("bytes"), _ROOT + 10, 4).alias("size"), F.array().cast("array<bigint>").alias("above"))
    found: list[DataFrame] = []

    def records(batches):
        """Of (key, path, nth, bytes) rows the records: lengths run from one to the next, a zero ends a sector."""
        for b in batches:
            rows = []
            for k, path, nth, body in zip(*(b.column(i).to_pylist() for i in range(4))):
                at = 0
                while at + 33 <= len(body) and body[at]:
                    name = body[at + 33 : at + 33 + body[at + 32]]
                    if name not in (b"\0", b"\1"):
                        rows.append((k, path, nth * SECTOR + at, int.from_bytes(body[at + 2 : at + 6], "little"), int.from_bytes(body[at + 10 : at + 14], "little"), body[at + 25], name.decode("ascii", "replace")))
                    at += body[at]
            columns = list(zip(*rows)) or [[]] * 7
            yield pa.record_batch([pa.array(c, t) for c, t in zip(columns, (b.schema.field(0).type, pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.string()))], names=["key", "folder", "place", "lba", "size", "flags", "raw"])

    from ..session import cut

    while True:
        touched = folders.withColumn("nth", F.explode(F.sequence(F.lit(0).cast("bigint"), F.ceil(F.col("size") / SECTOR) - 1))).where("size > 0")
        read = touched.select(key, "path", "nth", (F.col("lba") + F.col("nth")).alias("at")).join(s, [key, "at"]).select(key, "path", "nth", "bytes")
        read = read.mapInArrow(records, f"key {kind}, folder string, place bigint, lba bigint, size bigint, flags int, raw string")
        # a folder that holds one of those above it would have no end
        paths = folders.select(F.col(key).alias("key"), F.col("path").alias("folder"), F.concat("above", F.array("lba")).alias("above"))
        rows = cut(read.join(paths, ["key", "folder"]).where("flags & 2 = 0 or not array_contains(above, lba)"))
        if rows.isEmpty():
            break
        is_dir = F.col("flags").bitwiseAND(F.lit(2)) != 0
        name = F.when(is_dir, F.col("raw")).otherwise(F.substring_index("raw", ";", 1))
        level = rows.select(F.col("key").alias(key), F.concat_ws("/", F.nullif("folder", F.lit("")), name).alias("path"), is_dir.alias("is_dir"), "lba", "size", "place", "above")
        found.append(level.drop("above"))
        folders = level.where("is_dir").select(key, "path", "lba", "size", "above")
    if not found:
        return spark.createDataFrame([], f"{key} {kind}, path string, is_dir boolean, lba bigint, size bigint, extent int")
    from ..operators.ordered import renumber

    whole = renumber(reduce(DataFrame.unionByName, found), [key, "path"], [F.col("place")])
    return whole.select(key, "path", "is_dir", "lba", "size", (F.col("number") - 1).cast("int").alias("extent"))
