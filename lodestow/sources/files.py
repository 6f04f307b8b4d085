"""Files and archives as rows."""

from __future__ import annotations

import io
import zipfile
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.names import base_name, directory, extension
from ..operators.catalog import first_by
from ..session import visible
from .texts import cue_files, gdi_tracks

#: Levels of archives within archives that are opened.
DEPTH = 4


def tree(spark: SparkSession, path: str, pattern: str = "*", content: bool = False) -> DataFrame:
    """(path, parent, name, ext, size, modified) of all files below ``path``; with their bytes only if asked, so that scans stay light."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).option("ignoreMissingFiles", "true").load(path)
    below = F.substring(F.col("path"), F.instr("path", path) + len(path), F.length("path"))
    files = files.where(~below.rlike(r"(?:^|/)\.[^/]"))  # what is hidden stays so
    cols = [F.col("path"), directory(F.col("path")).alias("parent"), base_name(F.col("path")).alias("name"), extension(F.col("path")).alias("ext"), F.col("length").alias("size"), F.col("modificationTime").alias("modified")]
    return files.select(*cols, *(["content"] if content else []))


def directories(entries: DataFrame) -> DataFrame:
    """(path, parent) of every folder that leads to an entry's (path)."""
    parts = F.split("path", "/")
    every = entries.where(F.size(parts) > 1).select(F.explode(F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda i: F.array_join(F.slice(parts, 1, i), "/"))).alias("path"))
    return every.where("path <> ''").distinct().select("path", F.nullif(directory(F.col("path")), F.lit("")).alias("parent"))


def _members(name: str, body: bytes, depth: int, password: bytes | None) -> Iterator[tuple]:
    """(path, size, bytes, error) of an archive's files, one at a time; an archive within that cannot be opened is a file."""
    with zipfile.ZipFile(io.BytesIO(body)) as z:
        for info in z.infolist():
            if info.is_dir():
                continue
            path = f"{name}/{info.filename}" if name else info.filename
            try:
                data = z.read(info, password)
            except (RuntimeError, zipfile.BadZipFile, NotImplementedError, zlib.error) as e:
                yield path, info.file_size, None, str(e)
                continue
            if depth < DEPTH and _opens(data):
                yield from _members(path, data, depth + 1, password)
            else:
                yield path, info.file_size, data, None


def _opens(data: bytes) -> bool:
    try:
        with zipfile.ZipFile(io.BytesIO(data)) as z:
            return z.infolist() is not None
    except (zipfile.BadZipFile, NotImplementedError, ValueError):
        return False


def zip_entries(archives: DataFrame, key: str = "path", content: str = "content", password: str | None = None) -> DataFrame:
    """(key, entry, size, bytes, error): members of ZIP files, those of archives within them too; unreadable ones are rows with an error.

    Members leave a task as they are read, some MB at once; what is held is the archive and one member.
    """
    secret = password.encode() if password else None
    names = [key, "entry", "size", "bytes", "error"]

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in parts:
            for k, body in zip(df[key], df[content]):
                rows, held = [], 0
                try:
                    for m in _members("", bytes(body), 0, secret):
                        rows.append((k, *m))
                        held += len(m[2] or b"")
                        if held > 8 << 20 or len(rows) == 1024:
                            yield pd.DataFrame(rows, columns=names)
                            rows, held = [], 0
                except (zipfile.BadZipFile, NotImplementedError) as e:
                    rows.append((k, "", len(body), None, str(e)))
                if rows:
                    yield pd.DataFrame(rows, columns=names)

    visible(archives.sparkSession)
    return archives.where(F.col(content).isNotNull()).select(key, content).mapInPandas(run, f"{key} {archives.schema[key].dataType.simpleString()}, entry string, size long, bytes binary, error string")


def scoped(entries: DataFrame, prefix: str, column: str = "entry") -> DataFrame:
    """Entries below a prefix, named from there on."""
    return entries.where(F.startswith(F.col(column), F.lit(prefix))).withColumn(column, F.substring(F.col(column), F.lit(len(prefix) + 1), F.length(column)))


def json_table(spark: SparkSession, path: str, schema: str, key: str) -> DataFrame:
    """JSON lines with a declared schema, the first row of each key in order of files and of places in them."""
    rows = spark.read.schema(schema).json(path)
    columns = rows.columns
    placed = rows.select("*", F.col("_metadata.file_path").alias("_f"), F.col("_metadata.file_block_start").alias("_b"), F.monotonically_increasing_id().alias("_n"))
    return first_by(placed, [key], [F.col("_f"), F.col("_b"), F.col("_n")]).select(*columns)


def titles_by_folder(entries: DataFrame, path: str = "path") -> DataFrame:
    """(ident, nth, part): folders within folders named by 16 hex digits, with how far each id is from the least one."""
    parts = r"(?:^|/)([0-9a-fA-F]{16})/([^/]+)$"
    rows = entries.where(F.col(path).rlike(parts)).select(F.upper(F.regexp_extract(path, parts, 1)).alias("ident"), F.regexp_extract(path, parts, 2).alias("part"))
    least = rows.agg(F.min("ident").alias("m")).first()["m"]  # one value
    far = F.conv("ident", 16, 10).cast("decimal(20,0)") - int(least or "0", 16)
    return rows.select("ident", far.cast("bigint").alias("nth"), "part")


def descriptor_sizes(sheets: DataFrame, entries: DataFrame, key: str = "id") -> DataFrame:
    """(key, size, missing): a sheet's own size and those of the files it names that are there, and how many are not.

    Sheets are (key, folder, text), of the cue or the GDI kind; entries are (folder, name, size).  Names are
    compared whatever their case.
    """
    named = cue_files(sheets, key).select(key, "file").unionByName(gdi_tracks(sheets, key).select(key, "file")).distinct()
    there = entries.groupBy("folder", F.upper("name").alias("_n")).agg(F.max("size").alias("_size"))
    found = named.join(sheets.select(key, "folder"), key).withColumn("_n", F.upper("file")).join(there, ["folder", "_n"], "left")
    sums = found.groupBy(key).agg(F.sum("_size").alias("_sum"), F.count_if(F.col("_size").isNull()).alias("_gone"))
    return sheets.join(sums, key, "left").select(key, (F.octet_length("text") + F.coalesce("_sum", F.lit(0))).alias("size"), F.coalesce("_gone", F.lit(0)).alias("missing"))
