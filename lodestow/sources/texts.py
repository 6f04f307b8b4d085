"""Small structured texts as rows: cue sheets, GDI, DAT, INI, playlists.

Each parser takes (id, text) and works line by line with column functions: lines are exploded with their
numbers and what a line inherits (its file, track) is carried forward in a window; sections of settings are cut in the row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.names import blank_as_null
from ..functions.numbers import msf_frames
from ..operators.catalog import last_by
from ..operators.ordered import carried


def lines(df: DataFrame, key: str = "id", text: str = "text") -> DataFrame:
    """(key, no, line): lines without the white space around them, numbered from 0."""
    return df.select(key, F.posexplode(F.split(text, r"\r\n|\r|\n", -1)).alias("no", "_l")).select(key, "no", F.trim(F.regexp_replace("_l", r"^\s+|\s+$", "")).alias("line"))


def _part(pattern: str, group: int = 1):
    return F.nullif(F.regexp_extract("line", pattern, group), F.lit(""))


def cue_indexes(df: DataFrame, key: str = "id") -> DataFrame:
    """A row for each INDEX of each track: (key, file, track, type, index, frames)."""
    rows = lines(df, key).select(
        key, "no",
        _part(r'(?i)^FILE\s+"?(.*?)"?\s+\w+$').alias("file"),
        _part(r"(?i)^TRACK\s+(\d+)\s+\S+").cast("int").alias("track"),
        _part(r"(?i)^TRACK\s+\d+\s+(\S+)").alias("type"),
        _part(r"(?i)^INDEX\s+(\d+)\s+\S+").cast("int").alias("index"),
        msf_frames(F.regexp_extract("line", r"(?i)^INDEX\s+\d+\s+(\S+)", 1)).alias("frames"),
    )
    return carried(rows, [key], "no", ["file", "track", "type"]).where("index is not null").drop("no")


def cue_files(df: DataFrame, key: str = "id") -> DataFrame:
    """(key, nth, file): the files that a cue sheet names, in order, each once."""
    named = lines(df, key).select(key, "no", _part(r'(?i)^FILE\s+"?(.*?)"?\s+\w+$').alias("file")).where("file is not null")
    once = named.groupBy(key, "file").agg(F.min("no").alias("no"))
    return once.select(key, F.row_number().over(Window.partitionBy(key).orderBy("no")).alias("nth"), "file")


def main_data_track(df: DataFrame, key: str = "id") -> DataFrame:
    """(key, file_no): which of a cue sheet's binary files, from 0, holds the main data track.

    The last data track of a high-density area, or else the first data track, or else file 0.  Remarks switch
    the area; tracks before any file are not counted.
    """
    low = F.lower("line")
    rows = lines(df, key).select(
        key, "no",
        F.when(low.rlike("^rem") & F.contains(low, F.lit("high-density")), F.lit(True)).when(low.rlike("^rem") & F.contains(low, F.lit("single-density")), F.lit(False)).alias("dense"),
        F.when(low.rlike(r'^file\s+".+?"\s+binary'), 1).otherwise(0).alias("file"),
        _part(r"(?i)^TRACK\s+\d+\s+(\S+)").alias("type"),
    )
    files = F.sum("file").over(Window.partitionBy(key).orderBy("no").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - 1
    placed = carried(rows, [key], "no", ["dense"]).withColumn("file", files)
    data = (F.upper("type") != "AUDIO") & (F.col("file") >= 0)
    return placed.groupBy(key).agg(F.coalesce(F.max(F.when(data & F.col("dense"), F.col("file"))), F.min(F.when(data, F.col("file"))), F.lit(0)).alias("file_no"))


def gdi_tracks(df: DataFrame, key: str = "id") -> DataFrame:
    """(key, number, lba, type, sector, file, offset, complete): ``complete`` if as many tracks follow as the first line says."""
    every = lines(df, key).where("line <> ''")
    first = every.groupBy(key).agg(F.min_by("line", "no").alias("said"))
    row = r'^(\d+)\s+(\d+)\s+(\d+)\s+(\d+)\s+(?:"([^"]*)"|(\S+))\s+(\d+)$'
    at = lambda g: F.regexp_extract("line", row, g)
    tracks = every.where(F.col("line").rlike(row)).select(key, at(1).cast("int").alias("number"), at(2).cast("bigint").alias("lba"), at(3).cast("int").alias("type"), at(4).cast("int").alias("sector"), F.concat(at(5), at(6)).alias("file"), at(7).cast("bigint").alias("offset"))
    counted = tracks.groupBy(key).agg(F.count("*").alias("_n"))
    joined = tracks.join(counted.join(first, key), key)
    return joined.withColumn("complete", F.coalesce(F.when(F.col("said").rlike(r"^\d+$"), F.col("said").cast("int")) == F.col("_n"), F.lit(False))).drop("_n", "said")


def data_picks(tracks: DataFrame, key: str = "id", dense: int = 45_000) -> DataFrame:
    """(key, first_dense, last_data): the numbers of the first data track from sector ``dense`` on, and of the last data track."""
    data = F.col("type") == 4
    first = F.min_by(F.when(data & (F.col("lba") >= dense), F.col("number")), F.when(data & (F.col("lba") >= dense), F.struct("lba", "number")))
    return tracks.groupBy(key).agg(first.alias("first_dense"), F.max(F.when(data, F.col("number"))).alias("last_data"))


def dat_entries(df: DataFrame, key: str = "id") -> DataFrame:
    """(key, ord, source_name, patch_base, crc) of the tab-separated lines before the first blank one."""
    every = lines(df, key)
    blank = every.where("line = ''").groupBy(key).agg(F.min("no").alias("_end"))
    body = every.join(blank, key, "left").where("line <> '' and (_end is null or no < _end)")
    cells = F.split("line", r"\t")
    return body.where(F.size(cells) >= 2).select(key, F.col("no").alias("ord"), F.trim(cells[0]).alias("source_name"), F.trim(cells[1]).alias("patch_base"), F.lower(F.nullif(F.regexp_extract(F.get(cells, F.lit(2)), r"(?i)CRC\(([0-9a-f]{8})\)", 1), F.lit(""))).alias("crc"))


def dat_title(df: DataFrame, key: str = "id", locales: tuple[str, ...] = ("ko_KR", "en_US")) -> DataFrame:
    """(key, title): the line after the preferred [locale] that the text has."""
    marked = carried(lines(df, key).select(key, "no", "line", _part(r"^\[([A-Za-z]{2}_[A-Za-z]{2})\]$").alias("locale")).withColumn("head", F.col("locale").isNotNull()), [key], "no", ["locale"])
    titles = marked.where("locale is not null and not head and line <> ''").groupBy(key, "locale").agg(F.min_by("line", "no").alias("t"))
    rank = F.coalesce(*[F.when(F.col("locale") == x, i) for i, x in enumerate(locales)], F.lit(len(locales)))
    return titles.groupBy(key).agg(F.min_by("t", F.struct(rank, "locale")).alias("title"))


def ini_values(df: DataFrame, key: str = "id") -> DataFrame:
    """(key, section, name, value): lines after ; are comments, the last value of a name counts, quotes go."""
    line = lambda x: F.trim(F.regexp_replace(x, r"^\s+|\s+$", ""))
    head = lambda x: F.nullif(F.regexp_extract(x, r"^\[(.*)\]$", 1), F.lit(""))
    every = df.select(key, F.transform(F.split("text", r"\r\n|\r|\n", -1), line).alias("_l"))
    heads = every.withColumn("_h", F.filter(F.sequence(F.lit(1), F.size("_l")), lambda i: head(F.element_at("_l", i)).isNotNull()))

    def part(j: Column) -> Column:
        """What begins with the head before place ``j`` of the heads, up to the next one."""
        begin, end = F.coalesce(F.get("_h", j - 1), F.lit(0)), F.coalesce(F.get("_h", j), F.size("_l") + 1)
        return F.struct(head(F.get("_l", begin - 1)).alias("section"), begin.alias("at"), F.slice("_l", begin + 1, end - begin - 1).alias("body"))

    parts = heads.select(key, F.inline(F.transform(F.sequence(F.lit(0), F.size("_h")), part)))
    rows = parts.select(key, "section", "at", F.posexplode("body").alias("_n", "line")).withColumn("no", F.col("at") + F.col("_n")).where("line <> '' and not startswith(line, ';') and instr(line, '=') > 0")
    pair = rows.select(key, "no", F.coalesce("section", F.lit("")).alias("section"), F.trim(F.substring_index("line", "=", 1)).alias("name"), F.regexp_replace(F.trim(F.regexp_extract("line", r"^[^=]*=(.*)$", 1)), r'^"(.*)"$', "$1").alias("value"))
    return last_by(pair, [key, "section", "name"], [F.col("no")]).drop("no")


def ini_text(settings: DataFrame, key: str = "id") -> DataFrame:
    """(key, text): settings (key, ord, section, name, value) as sections of quoted values, in order; sections go by their first setting."""
    each = settings.groupBy(key, "section").agg(F.min("ord").alias("o"), F.array_sort(F.collect_list(F.struct("ord", "name", "value"))).alias("s"))
    body = F.concat(F.lit("["), F.col("section"), F.lit("]\n"), F.array_join(F.transform("s", lambda x: F.concat(x["name"], F.lit('="'), x["value"], F.lit('"\n'))), ""))
    return each.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("o", body.alias("b")))), lambda x: x["b"]), "\n").alias("text"))


def ccd_tracks(df: DataFrame, key: str = "id") -> DataFrame:
    """(key, track, mode, start) of a CCD sheet: of its [TRACK n] sections, or else of its [Entry n] sections with points 1 to 99."""
    values = ini_values(df, key).withColumn("name", F.upper("name"))
    number = F.nullif(F.regexp_extract("section", r"(?i)^TRACK\s+(\d+)$", 1), F.lit("")).cast("int")
    value = lambda n: F.max(F.when(F.col("name") == n, F.col("value")))
    told = values.withColumn("_own", number).withColumn("_entry", F.when(F.col("_own").isNull() & F.col("section").rlike(r"(?i)^Entry\s+\d+$"), F.col("section")))
    cells = [value(n).alias(c) for c, n in (("m", "MODE"), ("i", "INDEX 1"), ("p", "POINT"), ("c", "CONTROL"), ("b", "PLBA"))]
    each = told.where("_own is not null or _entry is not null").groupBy(key, "_own", "_entry").agg(*cells)
    point = F.conv(F.regexp_replace(F.lower("p"), "^0x", ""), 16, 10).cast("int")
    data = F.conv(F.regexp_replace(F.lower("c"), "^0x", ""), 16, 10).cast("int").bitwiseAND(F.lit(4)) != 0
    own = F.col("_own").isNotNull()
    rows = each.select(
        key,
        F.when(own, F.col("_own")).otherwise(point).alias("track"),
        F.when(own, F.col("m").cast("int")).otherwise(F.when(data, 1).otherwise(0)).alias("mode"),
        F.when(own, F.col("i").cast("bigint")).otherwise(F.col("b").cast("bigint")).alias("start"),
        own.alias("_is_own"),
        F.max(own).over(Window.partitionBy(key)).alias("_has_own"),
    )
    return rows.where("_is_own or (not _has_own and track between 1 and 99)").select(key, "track", "mode", "start")


def playlist(df: DataFrame, key: str = "id", folder: str | None = None) -> DataFrame:
    """(key, nth, path): entries of an M3U playlist; relative ones lie in the column ``folder``."""
    rows = lines(df, key).where("line <> '' and not startswith(line, '#')")
    path = F.col("line")
    if folder is not None:
        rows = rows.join(df.select(key, F.col(folder).alias("_f")), key)
        path = F.when(F.col("line").rlike(r"^(/|[A-Za-z]:)"), F.col("line")).otherwise(F.concat_ws("/", F.regexp_replace(blank_as_null(F.col("_f")), "/$", ""), "line"))
    return rows.select(key, F.row_number().over(Window.partitionBy(key).orderBy("no")).alias("nth"), path.alias("path"))


def track_fields(text: str = "text"):
    """A map of a metadata string such as TRACK:1 TYPE:AUDIO FRAMES:300."""
    return F.str_to_map(F.trim(text), F.lit(r"\s+"), F.lit(":"))


def xml_values(df: DataFrame, paths: dict[str, str], key: str = "id", text: str = "text") -> DataFrame:
    """(key, and a column for each XPath): the text of the first element found, null for none."""
    found = [F.nullif(F.expr(f"xpath_string(`{text}`, '{p}')"), F.lit("")).alias(name) for name, p in paths.items()]
    return df.select(key, *found)
