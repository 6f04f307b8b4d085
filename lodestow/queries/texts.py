"""Small texts and names built from the supplied tables, read back by the parsers; the SQL knows the rows they were built from."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import digests, names, numbers
from ..operators import matching as M
from ..registry import register
from ..sources import texts as T
from . import crc32_sql, table

_KIND = "case o_orderstatus when 'F' then 'MODE1/2352' when 'O' then 'AUDIO' else 'MODE2/2352' end"
_TRACKS = f"""select o_custkey as id, o_orderkey as k, row_number() over (partition by o_custkey order by o_orderkey) as n, {_KIND} as kind, o_orderkey * 75 + 13 as frames, o_orderpriority as p from orders"""


def _tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, rows): a customer's orders as tracks (k, n, kind, frames, p), in order."""
    from pyspark.sql import Window

    o = table(spark, sf_dir, "orders")
    n = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey"))
    rows = o.select(F.col("o_custkey").alias("id"), F.struct(n.alias("n"), F.col("o_orderkey").alias("k"), F.expr(_KIND).alias("kind"), (F.col("o_orderkey") * 75 + 13).alias("frames"), F.col("o_orderpriority").alias("p")).alias("t"))
    return rows.groupBy("id").agg(F.array_sort(F.collect_list("t")).alias("t"))


def _text(spark: SparkSession, sf_dir: str, line, head: str = "", end: str = "\n") -> DataFrame:
    """(id, text): a line for each track of a customer."""
    return _tracks(spark, sf_dir).select("id", F.concat(F.lit(head), F.array_join(F.transform("t", line), end), F.lit(end)).alias("text"))


def _two(c: Column) -> Column:
    return F.lpad(c.cast("string"), F.greatest(F.length(c.cast("string")), F.lit(2)), F.lit("0"))


def _cue(spark: SparkSession, sf_dir: str) -> DataFrame:
    def line(x: Column) -> Column:
        dense = F.when(x["p"] == "1-URGENT", "REM HIGH-DENSITY AREA\n").otherwise(F.when(x["p"] == "5-LOW", "REM SINGLE-DENSITY AREA\n").otherwise(""))
        return F.concat(dense, F.lit('FILE "order '), x["k"].cast("string"), F.lit('.bin" BINARY\r\n  TRACK '), _two(x["n"]), F.lit(" "), x["kind"], F.lit("\n    INDEX 01 "), numbers.msf_text(x["frames"]))

    return _text(spark, sf_dir, line)


@register("cue_indexes", f"""select id, 'order ' || k::varchar || '.bin' as file, n as track, kind as "type", 1 as "index", frames from ({_TRACKS})""")
def cue_indexes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.cue_indexes(_cue(spark, sf_dir))


@register("cue_files", f"select id, n as nth, 'order ' || k::varchar || '.bin' as file from ({_TRACKS})")
def cue_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.cue_files(_cue(spark, sf_dir))


_DENSE = f"""select *, coalesce(last_value(case p when '1-URGENT' then true when '5-LOW' then false end ignore nulls) over (partition by id order by n), false) as dense from ({_TRACKS})"""


@register("main_data_track", f"""select id, coalesce(max(n - 1) filter (dense and kind <> 'AUDIO'), min(n - 1) filter (kind <> 'AUDIO'), 0) as file_no from ({_DENSE}) group by id""")
def main_data_track(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.main_data_track(_cue(spark, sf_dir))


@register("cue_bins", f"""select id, count(*) as named, count(p_partkey) as there from ({_TRACKS}) left join part on p_partkey = k group by id""")
def cue_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files that sheets name, found in the folder of the sheet whatever the case."""
    there = table(spark, sf_dir, "part").select(F.concat(F.lit("ORDER "), F.col("p_partkey").cast("string"), F.lit(".BIN")).alias("name"), F.lit("a/b").alias("folder"), "p_partkey")
    named = T.cue_files(_cue(spark, sf_dir)).withColumn("folder", F.lit("a/b"))
    return M.in_folder(named, there, "file", "name", "folder").groupBy("id").agg(F.count("*").alias("named"), F.count("p_partkey").alias("there"))


_LBA = "k * 30 as lba, case kind when 'AUDIO' then 0 else 4 end as t"


@register("gdi_tracks", f"""select id, n as number, lba, t as "type", 2352 as sector, case when k % 2 = 0 then 'track ' || n::varchar || '.bin' else 'track' || n::varchar || '.raw' end as file, 0 as "offset", true as complete from (select *, {_LBA} from ({_TRACKS}))""")
def gdi_tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sheets written and read."""
    return T.gdi_tracks(_gdi(spark, sf_dir))


def _gdi(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.containers import gdi_text

    rows = _tracks(spark, sf_dir).select("id", F.explode("t").alias("x"))
    file = F.when(F.col("x.k") % 2 == 0, F.concat(F.lit("track "), F.col("x.n").cast("string"), F.lit(".bin"))).otherwise(F.concat(F.lit("track"), F.col("x.n").cast("string"), F.lit(".raw")))
    cells = [F.col("x.n").alias("number"), (F.col("x.k") * 30).alias("lba"), F.when(F.col("x.kind") == "AUDIO", 0).otherwise(4).alias("type"), F.lit(2352).alias("sector"), file.alias("file"), F.lit(0).alias("offset")]
    return gdi_text(rows.select("id", *cells), "id")


@register("gdi_picks", f"""select id, arg_min(n, lba) filter (t = 4 and lba >= 45000) as first_dense, max(n) filter (t = 4) as last_data from (select *, {_LBA} from ({_TRACKS})) group by id""")
def gdi_picks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.data_picks(T.gdi_tracks(_gdi(spark, sf_dir)))


@register("ccd_tracks", f"select id, n as track, case kind when 'AUDIO' then 0 when 'MODE1/2352' then 1 else 2 end as mode, frames as start from ({_TRACKS})")
def ccd_tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    mode = lambda x: F.when(x["kind"] == "AUDIO", "0").when(x["kind"] == "MODE1/2352", "1").otherwise("2")
    sheet = _text(spark, sf_dir, lambda x: F.concat(F.lit("[TRACK "), x["n"].cast("string"), F.lit("]\r\nMODE="), mode(x), F.lit("\r\nINDEX 1="), x["frames"].cast("string")), "[CloneCD]\r\nVersion=3\r\n", "\r\n")
    return T.ccd_tracks(sheet)


@register("dat_entries", f"""select id, n - 1 as ord, 'rom' || k::varchar || '.bin' as source_name, 'patch' || n::varchar as patch_base, case when k % 3 > 0 then lower(lpad(printf('%x', k * 65537), 8, '0')) end as crc from ({_TRACKS})""")
def dat_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    crc = lambda x: F.when(x["k"] % 3 > 0, F.concat(F.lit("\tCRC("), F.lpad(F.hex(x["k"] * 65537), 8, "0"), F.lit(")"))).otherwise("")
    line = lambda x: F.concat(F.lit("rom"), x["k"].cast("string"), F.lit(".bin\tpatch"), x["n"].cast("string"), crc(x))
    text = _text(spark, sf_dir, line).select("id", F.concat("text", F.lit("\nnot\tread\n")).alias("text"))
    return T.dat_entries(text)


@register("dat_titles", "select c_custkey as id, case when c_custkey % 3 = 0 then c_mktsegment else c_name end as title from customer")
def dat_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    local = F.when(F.col("c_custkey") % 3 == 0, F.concat(F.lit("\n[ko_KR]\n"), F.col("c_mktsegment"))).otherwise("")
    return T.dat_title(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.concat(F.lit("[en_US]\n"), F.col("c_name"), local).alias("text")))


@register("ini_values", """select c_custkey as id, 'account' as section, 'name' as name, c_name as value from customer union all select c_custkey, 'account', 'segment', c_mktsegment from customer
    union all select c_custkey, 'place', 'nation', c_nationkey::varchar from customer""")
def ini_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Settings written and read."""
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), "c_name", "c_mktsegment", F.col("c_nationkey").cast("string").alias("nation"))
    settings = c.select("id", F.inline(F.array(*[F.struct(F.lit(o).alias("ord"), F.lit(s).alias("section"), F.lit(n).alias("name"), F.col(v).alias("value")) for o, s, n, v in ((1, "account", "name", "c_name"), (2, "account", "segment", "c_mktsegment"), (3, "place", "nation", "nation"))])))
    return T.ini_values(T.ini_text(settings))


@register("playlist", f"select id, n as nth, case when k % 2 = 0 then '/games/disc' || n::varchar || '.cue' else '/abs/' || k::varchar || '.cue' end as path from ({_TRACKS})")
def playlist(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = lambda x: F.when(x["k"] % 2 == 0, F.concat(F.lit("disc"), x["n"].cast("string"), F.lit(".cue"))).otherwise(F.concat(F.lit("/abs/"), x["k"].cast("string"), F.lit(".cue")))
    return T.playlist(_text(spark, sf_dir, line, "#EXTM3U\n\n").withColumn("dir", F.lit("/games/")), folder="dir")


@register("xml_values", "select p_partkey as id, p_name as title, p_size::varchar as size, null::varchar as missing from part")
def xml_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.concat(F.lit("<app><title lang='en'>"), F.col("p_name"), F.lit("</title><size>"), F.col("p_size").cast("string"), F.lit("</size><empty/></app>"))
    return T.xml_values(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), text.alias("text")), {"title": "/app/title", "size": "/app/size", "missing": "/app/empty"})


@register("track_fields", f"select id, n as track, case when kind = 'MODE1/2352' then kind when kind = 'AUDIO' then 'AUDIO' else 'MODE2/2352' end as kind, frames from ({_TRACKS})")
def track_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _tracks(spark, sf_dir).select("id", F.explode("t").alias("x"))
    text = F.concat(F.lit("TRACK:"), F.col("x.n").cast("string"), F.lit(" TYPE:"), F.replace("x.kind", F.lit("/"), F.lit("_")), F.lit("  FRAMES:"), F.col("x.frames").cast("string"))
    m = T.track_fields("text")
    return rows.select("id", text.alias("text")).select("id", m["TRACK"].cast("int").alias("track"), names.track_type(m["TYPE"]).alias("kind"), m["FRAMES"].cast("bigint").alias("frames"))


@register(
    "path_parts",
    "select p_partkey, p_type as directory, p_name || '.tar.GZ' as name, p_name || '.tar' as stem, 'gz' as ext, p_name || '.tar.bin' as other from part",
)
def path_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.concat("p_type", F.lit("/"), "p_name", F.lit(".tar.GZ"))
    return table(spark, sf_dir, "part").select("p_partkey", names.directory(path).alias("directory"), names.base_name(path).alias("name"), names.stem(path).alias("stem"), names.extension(path).alias("ext"), F.concat(names.stem(path), F.lit(".bin")).alias("other"))


@register("content_ids", "select o_orderkey, case when o_orderkey % 3 = 0 then '' else md5(o_orderkey::varchar) end as ident, o_orderkey % 3 <> 0 as is_hex from orders")
def content_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = F.upper(F.md5(F.col("o_orderkey").cast("string")))
    file = F.when(F.col("o_orderkey") % 3 == 0, F.concat(F.substring(h, 1, 20), F.lit("-.nca"))).when(F.col("o_orderkey") % 3 == 1, F.concat(h, F.lit(".cnmt.nca"))).otherwise(F.concat(h, F.lit(".nca")))
    return table(spark, sf_dir, "orders").select("o_orderkey", names.content_id(file).alias("ident"), names.is_hex_id(names.stem(F.replace(file, F.lit(".cnmt"), F.lit(""))), 32).alias("is_hex"))


@register("clean_names", "select p_partkey, p_name || p_brand as removed, p_name || '_' || p_brand || '__' as replaced, p_name as title from part")
def clean_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.concat("p_name", F.lit(":"), "p_brand", F.lit('?"'))
    number = (F.col("p_partkey") % 3).cast("int")
    disc = F.element_at(F.array(F.concat(F.lit(" (Disc "), F.col("p_size").cast("string"), F.lit(")")), F.lit(" [disk A]"), F.lit("  (DISC 1 of 3)")), number + 1)
    return table(spark, sf_dir, "part").select("p_partkey", names.without_forbidden(raw).alias("removed"), names.without_forbidden(raw, "_").alias("replaced"), names.without_disc(F.concat("p_name", disc)).alias("title"))


@register("disc_ids", "select p_partkey, 'SLUS' || lpad(p_partkey::varchar, 5, '0') as disc from part where p_partkey < 100000")
def disc_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.lpad(F.col("p_partkey").cast("string"), 5, "0")
    text = F.concat(F.lit("cdrom:\\slus_"), F.substring(n, 1, 3), F.lit("."), F.substring(n, 4, 2), F.lit(";1"))
    return table(spark, sf_dir, "part").where("p_partkey < 100000").select("p_partkey", names.disc_id(text).alias("disc"))


@register(
    "archive_names",
    """select p_partkey, p_partkey % 5 < 4 as is_archive, p_partkey % 5 < 2 as is_volume, p_partkey % 5 > 1 or p_size = 1 as is_first, p_name as title from part""",
)
def archive_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.lpad(F.col("p_size").cast("string"), 3, "0")
    end = F.element_at(F.array(F.concat(F.lit(".part"), n, F.lit(".RAR")), F.concat(F.lit(".7z."), n), F.lit(".7z"), F.lit(".Zip"), F.lit(".txt")), (F.col("p_partkey") % 5 + 1).cast("int"))
    file = F.concat("p_name", end)
    return table(spark, sf_dir, "part").select("p_partkey", names.is_archive(file).alias("is_archive"), names.is_volume(file).alias("is_volume"), names.is_first_volume(file).alias("is_first"), names.archive_title(file).alias("title"))


@register("hex_both_ways", "select p_partkey, lower(hex(encode(p_name))) as low, hex(encode(p_name)) as high, p_name as back, null::varchar as odd from part")
def hex_both_ways(spark: SparkSession, sf_dir: str) -> DataFrame:
    data = F.encode("p_name", "UTF-8")
    return table(spark, sf_dir, "part").select("p_partkey", names.hex_text(data).alias("low"), names.hex_text(data, lower=False).alias("high"), F.decode(names.hex_bytes(names.hex_text(data)), "UTF-8").alias("back"), F.decode(names.hex_bytes(F.concat(names.hex_text(data), F.lit("a"))), "UTF-8").alias("odd"))


@register("synthetic_ids", f"select p_partkey, '010' || upper(lpad(printf('%x', {crc32_sql('p_name')}), 8, '0')) || '000' as ident from part")
def synthetic_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", digests.synthetic_id(F.col("p_name")).alias("ident"))


@register(
    "path_hashes",
    "select p_partkey, list_reduce(list_prepend(123456789::bigint, list_transform(string_split(p_name, ''), lambda ch: ascii(ch)::bigint)), lambda h, u: xor((h >> 5) | ((h & 31) << 27), u)) as hash from part",
)
def path_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", digests.path_hash(F.col("p_name")).alias("hash"))


@register("hangul_names", "select p_partkey, p_partkey % 2 = 0 as hangul from part")
def hangul_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    other = F.when(F.col("p_partkey") % 2 == 0, F.lit("가힣")).otherwise(F.lit("ひカ한".replace("한", "漢")))
    return table(spark, sf_dir, "part").select("p_partkey", names.has_hangul(F.concat("p_name", other)).alias("hangul"))


@register("folder_roles", "select p_partkey, case p_partkey % 3 when 0 then 'update' when 1 then 'dlc' else 'base' end as role, p_partkey % 2 = 0 as is_title from part")
def folder_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    end = F.element_at(F.array(F.lit("_UPDATE1"), F.lit("_dlc"), F.lit("")), (F.col("p_partkey") % 3 + 1).cast("int"))
    digits = F.lower(F.lpad(F.hex("p_partkey"), 8, "0"))
    title = F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit("sd/00040000/"), digits)).otherwise(F.concat(F.lit("sd/0004000/"), digits))
    return table(spark, sf_dir, "part").select("p_partkey", names.folder_role(F.concat(F.lit("x_update/"), "p_name", end)).alias("role"), names.is_title_path(title).alias("is_title"))


@register("patch_kinds", "select p_partkey, case when p_partkey % 3 = 0 then 'overwrite' else 'patch' end as kind, case when p_partkey % 3 = 0 then p_name || '.bin' else p_name || '.bin' end as target from part")
def patch_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    file = F.concat(F.lit("dir/"), "p_name", F.element_at(F.array(F.lit(".bin"), F.lit(".bin.IPS"), F.lit(".bin.xdelta3")), (F.col("p_partkey") % 3 + 1).cast("int")))
    return table(spark, sf_dir, "part").select("p_partkey", names.patch_kind(file).alias("kind"), names.patch_target(file).alias("target"))


@register("reader_kinds", "select p_partkey, case p_partkey % 4 when 0 then 'ccd' when 1 then 'mds' when 2 then 'gdi' end as reader from part")
def reader_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    file = F.concat("p_name", F.element_at(F.array(F.lit(".Img"), F.lit(".mds"), F.lit(".GDI"), F.lit(".txt")), (F.col("p_partkey") % 4 + 1).cast("int")))
    return table(spark, sf_dir, "part").select("p_partkey", names.reader_of(file).alias("reader"))


@register(
    "msf_sums",
    "select l_orderkey, l_linenumber, (l_partkey + 5000)::bigint as added, greatest(5000 - l_partkey, 0)::bigint as taken from lineitem",
)
def msf_sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = numbers.msf_text(F.col("l_partkey")), numbers.msf_text(F.lit(5000))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", numbers.msf_frames(numbers.msf_add(a, b)).alias("added"), numbers.msf_frames(numbers.msf_subtract(b, a)).alias("taken"))


@register("bcd_numbers", "select l_orderkey, l_linenumber, (l_partkey % 100 // 10 * 16 + l_partkey % 10)::bigint as bcd, (l_partkey % 100)::bigint as back from lineitem")
def bcd_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("l_partkey") % 100
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", numbers.to_bcd(n).alias("bcd"), numbers.from_bcd(numbers.to_bcd(n)).alias("back"))


@register("index_shifts", "select o_orderkey, greatest(length(format('{:b}', (o_orderkey + 1) * 1000003)) - 31, 0)::int as shift from orders")
def index_shifts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select("o_orderkey", numbers.index_shift((F.col("o_orderkey") + 1) * 1000003).cast("int").alias("shift"))


@register("percents", "select p_partkey, case when p_size % 5 = 0 then 0.0 else round(p_partkey * 100.0 / (p_size % 5), 6) end::double as share from part")
def percents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", F.round(numbers.percent(F.col("p_partkey"), F.col("p_size") % 5), 6).alias("share"))


@register("zero_slices", "select p_partkey, p_partkey % 2 = 0 as none, p_partkey % 2 = 1 as some from part")
def zero_slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    data = F.when(F.col("p_partkey") % 2 == 0, F.lit(b"\x10\0\0\0\x01")).otherwise(F.lit(b"\x10\0\x01\0\x01"))
    return table(spark, sf_dir, "part").select("p_partkey", numbers.all_zero(F.substring(data, 2, 3)).alias("none"), numbers.any_nonzero(data, 1, 3).alias("some"))


@register(
    "map_lookups",
    "select p_partkey, case p_size when 1 then 'one' when 2 then 'two' else 'more' end as name, case when p_size in (1, 2) then p_size end as back, least(p_size, 3) as kept from part",
)
def map_lookups(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = F.create_map(F.lit(1), F.lit("one"), F.lit(2), F.lit("two"))
    name = names.map_get(m, F.col("p_size"), F.lit("more"))
    added = names.map_add(m, F.lit(3), F.lit("three"))
    return table(spark, sf_dir, "part").select("p_partkey", name.alias("name"), F.try_element_at(names.map_inverted(m), name).alias("back"), F.when(F.try_element_at(added, F.col("p_size")).isNull(), 3).otherwise(F.col("p_size")).alias("kept"))
