"""Binary structures, blocks and hashes built from the supplied tables and read back; the SQL knows the rows they were built from."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import digests
from ..functions.numbers import be_bytes, le_bytes
from ..operators import blocks as B
from ..operators import containers as K
from ..registry import register
from ..sources import binaries as S
from . import table


def _b(*columns):
    return F.encode(F.concat(*columns), "UTF-8")


@register(
    "sfo_entries",
    "select c_custkey as id, unnest([0, 1, 2]) as nth, unnest(['CATEGORY', 'TITLE', 'TITLE_ID']) as name, unnest([c_mktsegment, c_name, 'N' || c_nationkey::varchar]) as value from customer",
)
def sfo_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parameter tables written and read."""
    c = table(spark, sf_dir, "customer")
    rows = c.select(F.col("c_custkey").alias("id"), F.inline(F.array(*[F.struct(F.lit(n).alias("name"), v.alias("value")) for n, v in (("TITLE", F.col("c_name")), ("CATEGORY", F.col("c_mktsegment")), ("TITLE_ID", F.concat(F.lit("N"), F.col("c_nationkey").cast("string"))))])))
    return S.sfo_entries(S.sfo_bytes(rows, "id", "name", "value"))


@register(
    "seek_table",
    """select l_orderkey as id, row_number() over w - 1 as block_no, l_partkey as packed_size, l_quantity::bigint * 100 as size, coalesce(sum(l_partkey) over b, 0)::bigint as packed_offset,
       coalesce(sum(l_quantity::bigint * 100) over b, 0)::bigint as "offset" from lineitem window w as (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice),
       b as (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice rows between unbounded preceding and 1 preceding)""",
)
def seek_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seek tables of an order's lines as blocks, written and read."""
    rows = table(spark, sf_dir, "lineitem").withColumn("o", F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"))
    return S.seek_entries(S.seek_table(rows.withColumnRenamed("l_orderkey", "id"), "id", "o", F.col("l_partkey"), F.col("l_quantity").cast("bigint") * 100))


@register(
    "mds_tracks",
    """select o_custkey as id, n as track, case when o_orderkey % 2 = 0 then 169 else 170 end as mode, case when o_orderkey % 3 = 0 then 2448 else 2352 end as sector, case when o_orderkey % 3 = 0 then 96 else 0 end as subchannel,
       150 as pregap, o_orderkey + 1 as length, o_orderkey * 4096 as start from (select *, row_number() over (partition by o_custkey order by o_orderkey) as n from orders) where n < 100""",
)
def mds_tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Track block files written and read; a disc has at most 99 tracks."""
    from pyspark.sql import Window

    k = F.col("o_orderkey")
    o = table(spark, sf_dir, "orders").withColumn("track", F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey"))).where("track < 100")
    cells = [F.when(k % 2 == 0, 169).otherwise(170).alias("mode"), F.when(k % 3 == 0, 2448).otherwise(2352).alias("sector"), F.lit(150).alias("pregap"), (k + 1).alias("length"), (k * 4096).alias("start")]
    return S.mds_tracks(S.mds_bytes(o.select(F.col("o_custkey").alias("id"), "track", *cells), "id"))


@register(
    "chd_headers",
    """select o_orderkey as id, 5 as version, (o_orderkey + 1) * 19584 * 4096 as bytes, 19584 as hunk_bytes, 2448 as unit_bytes, (o_orderkey + 1) * 4096 as hunks, 'cdzl,cdfl' as codecs, sha1(o_orderkey::varchar) as sha1, repeat('0', 40) as parent_sha1
       from orders where o_orderkey % 5 <> 0""",
)
def chd_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Image headers; those of another version are left out."""
    k = F.col("o_orderkey")
    head = lambda v: S.chd_header(v, (k + 1) * 19584 * 4096, F.lit(19584), F.lit(2448), [b"cdzl", b"cdfl"], F.sha1(k.cast("string")))
    return S.chd_headers(table(spark, sf_dir, "orders").select(k.alias("id"), F.when(k % 5 == 0, head(4)).otherwise(head(5)).alias("content")))


@register(
    "iso_tree",
    """select r_regionkey as id, r_name as path, true as is_dir, 20 + r_regionkey as lba, 2048 as size, 0 as extent from region
       union all select n_regionkey, r_name || '/' || n_name, false, 1000 + n_nationkey, n_nationkey * 10, 0 from nation join region on n_regionkey = r_regionkey
       union all select n_regionkey, r_name || '/' || n_name, false, 5000 + n_nationkey, 7, 1 from nation join region on n_regionkey = r_regionkey where n_nationkey % 3 = 0""",
)
def iso_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A disc image for each region: a folder of its name with its nations as files, some in two extents."""
    r, n = table(spark, sf_dir, "region"), table(spark, sf_dir, "nation")

    def record(lba, size, flags, name):
        length = 33 + F.octet_length(name) + F.pmod(1 + F.octet_length(name), F.lit(2))
        body = F.concat(le_bytes(length, 1), F.lit(b"\0"), le_bytes(lba, 4), be_bytes(lba, 4), le_bytes(size, 4), be_bytes(size, 4), F.lit(bytes(7)), le_bytes(flags, 1), F.lit(bytes(6)), le_bytes(F.octet_length(name), 1), name)
        return F.rpad(body, length, F.lit(b"\0"))

    def sector(key, lba, body):
        return F.struct(key.alias("id"), lba.cast("bigint").alias("lba"), F.rpad(body, 2048, F.lit(b"\0")).alias("bytes"))

    dots = F.concat(record(F.lit(20), F.lit(2048), F.lit(2), F.lit(b"\0")), record(F.lit(20), F.lit(2048), F.lit(2), F.lit(b"\1")))
    at, k = F.col("r_regionkey") + 20, F.col("r_regionkey")
    root = F.concat(F.rpad(F.lit(b"\x01CD001\x01"), 156, F.lit(b"\0")), record(F.lit(18), F.lit(2048), F.lit(2), F.lit(b"\0")))
    tops = r.select(F.inline(F.array(sector(k, F.lit(16), root), sector(k, F.lit(18), F.concat(dots, record(at, F.lit(2048), F.lit(2), F.encode("r_name", "US-ASCII")))))))
    name = F.encode(F.concat("n_name", F.lit(";1")), "US-ASCII")
    more = F.col("n_nationkey") % 3 == 0
    file = F.concat(record(F.col("n_nationkey") + 1000, F.col("n_nationkey") * 10, F.when(more, 128).otherwise(0), name), F.when(more, record(F.col("n_nationkey") + 5000, F.lit(7), F.lit(0), name)).otherwise(F.lit(b"")))
    files = n.groupBy("n_regionkey").agg(F.array_sort(F.collect_list(F.struct("n_nationkey", F.hex(file).alias("h")))).alias("f"))
    folders = files.select(F.inline(F.array(sector(F.col("n_regionkey"), F.col("n_regionkey") + 20, F.concat(dots, F.unhex(F.array_join(F.transform("f", lambda x: x["h"]), "")))))))
    return S.iso_entries(tops.unionByName(folders))


@register(
    "file_formats",
    """select p_partkey, case p_partkey % 6 when 0 then 'cue' when 1 then 'chd' when 2 then 'rvz' when 3 then 'wii' when 4 then 'iso' end as kind,
       case p_partkey % 6 when 0 then 'chd' when 2 then 'gcm' when 3 then 'rvz' when 4 then 'chd' end as target from part""",
)
def file_formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Formats by extension or by what the bytes begin with, and what they are turned into."""
    n = (F.col("p_partkey") % 6 + 1).cast("int")
    ext = F.element_at(F.array(F.lit("CUE"), *[F.lit(x) for x in ("x", "x", "x", "x", "txt")]), n)
    pad = lambda at: F.lit(bytes(at))
    data = F.element_at(F.array(F.lit(b"MComprHD"), F.lit(b"MComprHD"), F.lit(b"RVZ\x01" + bytes(60) + b"\xc2\x33\x9f\x3d"), F.concat(pad(0x18), F.lit(b"\x5d\x1c\x9e\xa3")), F.concat(pad(0x8001), F.lit(b"CD001")), F.lit(b"text")), n)
    p = table(spark, sf_dir, "part").select("p_partkey", ext.alias("ext"), data.alias("data"))
    kinds = p.withColumn("kind", S.file_format(F.col("ext"), F.col("data")))
    return kinds.select("p_partkey", "kind", S.turned_into(F.col("kind"), F.col("data")).alias("target"))


@register(
    "verified_blocks",
    "select event_id, event_id % 7 <> 0 and event_id % 5 <> 0 as ok, case when event_id % 5 = 0 or event_id % 7 <> 0 then hex(encode(event_type)) else repeat('00', length(event_type)) end as bytes from events",
)
def verified_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks held against expected hashes: every seventh is corrupt and reads as zeros, every fifth has none."""
    e = table(spark, sf_dir, "events")
    blocks = e.select("event_id", F.encode("event_type", "UTF-8").alias("bytes"))
    want = e.where("event_id % 5 <> 0").select("event_id", F.sha2(F.when(F.col("event_id") % 7 == 0, F.lit("other")).otherwise(F.col("event_type")), 256).alias("sha256"))
    return digests.verified_blocks(blocks, want, ["event_id"]).select("event_id", "ok", F.hex("bytes").alias("bytes"))


@register("seek_index", """select event_id, i as block_no, i * 8 as "offset", least(8, length(x) - i * 8) as packed_size, i * 8 as packed_offset from (select event_id, event_type || props as x from events) t, unnest(range((length(x) + 7) // 8)) u(i)""")
def seek_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("event_id", _b("event_type", "props").alias("x"))
    return B.seek_index(B.chunks(e, "event_id", "x", 8), "event_id", "bytes")


@register("sector_reframe", "select p_partkey, p_name as body from part")
def sector_reframe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sectors with a header of 16 bytes and a trailer, cut down to what lies between."""
    raw = F.concat(F.lit(bytes(16)), F.rpad(F.encode("p_name", "UTF-8"), 64, F.lit(b"\0")), F.lit(bytes(range(1, 9))))
    cut = B.reframed(table(spark, sf_dir, "part").select("p_partkey", raw.alias("d")), "d", 16, 64)
    return cut.select("p_partkey", F.rtrim(F.decode("d", "UTF-8"), F.lit("\0")).alias("body"))


@register(
    "sparse_reads",
    """select p_partkey, hex(encode(rpad(p_name, 40, '.')[1:10])) || repeat('00', 6) || hex(encode(rpad(p_brand, 40, '.')[5:8])) as bytes from part""",
)
def sparse_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reads of 20 bytes of an object of ten bytes of one file, a hole of six, and four bytes of another."""
    p = table(spark, sf_dir, "part")
    physical = p.select(F.concat(F.lit("a"), F.col("p_partkey").cast("string")).alias("src"), F.encode(F.rpad("p_name", 40, "."), "UTF-8").alias("x")).unionByName(p.select(F.concat(F.lit("b"), F.col("p_partkey").cast("string")).alias("src"), F.encode(F.rpad("p_brand", 40, "."), "UTF-8").alias("x")))
    long = lambda v: F.lit(v).cast("bigint")
    source = lambda x: F.concat(F.lit(x), F.col("p_partkey").cast("string"))
    extents = p.select("p_partkey", F.inline(F.array(*[F.struct(long(a).alias("e_start"), long(b).alias("e_end"), source(x).alias("src"), long(at).alias("p_start")) for a, b, x, at in ((0, 10, "a", 0), (16, 20, "b", 4))])))
    reads = p.select("p_partkey", F.lit(0).alias("read_no"), long(0).alias("v_start"), long(20).alias("v_end"))
    return B.sparse_reads(reads, extents, B.chunks(physical, "src", "x", 16), "p_partkey", 16).select("p_partkey", F.hex("bytes").alias("bytes"))


@register("padded_sha1", "select p_partkey, sha1(rpad(p_name, ((length(p_name) + 31) // 32 * 32)::int, chr(0))) as hash from part")
def padded_sha1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", digests.padded_sha1(F.encode("p_name", "UTF-8"), 32).alias("hash"))


_LEVEL = """select user_id, {n} as level, node // 16 as node, sha1(unhex(string_agg(coalesce(h, repeat('0', 40)), '' order by place))) as h from
    (select g.user_id, g.node * 16 + p as node, p as place, l.h from (select distinct user_id, node // 16 as node from {below}) g cross join range(16) r(p) left join {below} l on l.user_id = g.user_id and l.node = g.node * 16 + p) group by user_id, node // 16"""


@register(
    "hash_levels",
    f"""with l0 as (select user_id, 0 as level, row_number() over (partition by user_id order by event_id) - 1 as node, sha1(rpad(event_type, 12, chr(0))) as h from events),
       l1 as ({_LEVEL.format(n=1, below="l0")}), l2 as ({_LEVEL.format(n=2, below="l1")}), l3 as ({_LEVEL.format(n=3, below="l2")})
       select user_id, level, node, h as sha1 from l0 union all select * from l1 union all select * from l2 union all select * from l3""",
)
def hash_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tree of hashes over each user's events as blocks."""
    from ..operators.ordered import renumber

    e = renumber(table(spark, sf_dir, "events"), ["user_id"], [F.col("event_id")]).select("user_id", (F.col("number") - 1).alias("no"), F.encode("event_type", "UTF-8").alias("d"))
    return digests.hash_levels(e, ["user_id"], "no", "d", 12)


@register(
    "container_files",
    """select n_regionkey as id, n_name as name, (sum(length(n_name)) over (partition by n_regionkey order by n_name) - length(n_name))::bigint as "offset", length(n_name) as size, n_name as body from nation""",
)
def container_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Containers of small files, written as bytes and read."""
    files = table(spark, sf_dir, "nation").select(F.col("n_regionkey").alias("id"), F.col("n_name").alias("name"), F.encode("n_name", "UTF-8").alias("data"))
    read = K.container_entries(K.container_bytes(files, "id", "name", "data"), "id", "content")
    return read.select("id", "name", "offset", "size", F.decode("bytes", "UTF-8").alias("body"))


@register(
    "hashed_layout",
    """select p_partkey, coalesce(sum(length(x) + 1) over b, 0)::bigint as name_offset, coalesce(sum(length(p_brand)) over b, 0)::bigint as data_offset, sha256(p_brand[1:6]) as sha256,
       (16 + count(*) over e * 64 + (sum(length(x) + 1) over e + 15) // 16 * 16)::bigint as header_size from (select *, p_name || p_partkey::varchar as x from part)
       window b as (partition by p_type order by x rows between unbounded preceding and 1 preceding), e as (partition by p_type)""",
)
def hashed_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").select("p_partkey", "p_type", F.concat("p_name", F.col("p_partkey").cast("string")).alias("x"), F.encode("p_brand", "UTF-8").alias("d"))
    return K.hashed_layout(p, "p_type", "x", "d", 6).select("p_partkey", "name_offset", "data_offset", "sha256", "header_size")


@register("transcoded", "select event_id, count(*) as blocks, md5(string_agg(piece, '' order by i)) as hash from (select event_id, i, substr(x, (i * 11 + 1)::bigint, 11) as piece from (select event_id, event_type || props as x from events) t, unnest(range((length(x) + 10) // 11)) u(i)) group by event_id")
def transcoded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packed blocks of eight bytes turned into packed blocks of eleven, without a whole object in a row on the way."""
    e = table(spark, sf_dir, "events").select("event_id", _b("event_type", "props").alias("x"))
    packed = B.compressed(B.chunks(e, "event_id", "x", 8)).drop("bytes")
    again = B.decompressed(B.transcoded(packed, "event_id", 8, 11))
    pieces = again.groupBy("event_id").agg(F.count("*").alias("blocks"), F.array_sort(F.collect_list(F.struct("block_no", F.hex("bytes").alias("h")))).alias("b"))
    return pieces.select("event_id", "blocks", F.md5(F.unhex(F.array_join(F.transform("b", lambda x: x["h"]), ""))).alias("hash"))
