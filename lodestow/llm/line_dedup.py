"""Line deduplication by overlapping windows of three lines, with DataFrame functions only.

The lines of a text that are not blank, without the white space around them, are taken in order; each three
consecutive ones are a window.  The first occurrence of a window, in order of (doc_id, place), stays; every
later one covers its three lines, and all covered lines are removed.  A window that comes again before its
first occurrence has ended covers only the lines after that end.  Blank lines and the rest stay as they are.

Texts of fewer than three such lines have no window and stay.  Null texts stay null, empty ones empty.  Null
ids come first.  Rows equal in id and text are one document: they lose the same lines, and none to each
other.  Extra columns of the input are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, written
from .fingerprints import let

WIDTH = 3


def _lines(text: Column) -> Column:
    """Each line with its place in the text, blank ones left out."""
    every = F.transform(F.split(text, "\n", -1), lambda x, i: F.struct(i.alias("i"), F.regexp_replace(x, r"^[\x09-\x0D ]+|[\x09-\x0D ]+$", "").alias("s")))
    return F.filter(every, lambda x: x["s"] != "")


def dedup_lines(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """(doc_id, text, n_lines, n_removed): each text without its repeated passages; and ``row`` if ``docs`` has it.

    Windows travel as hashes of 128 bits.  Counting is a partial aggregate before the shuffle, so a window
    that a third of the corpus holds is a few rows; only windows found twice are joined back, and that join
    may be split where it is skewed.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *(["row"] if "row" in docs.columns else []))
    rows = rows.withColumn("key", F.xxhash64("text"))
    lines = rows.where("text is not null").select("doc_id", "key", _lines(F.col("text")).alias("l")).where(F.size("l") >= width)
    starts = F.sequence(F.lit(1), F.size("l") - (width - 1))

    def window(i: Column) -> Column:
        part = F.transform(F.slice("l", i, width), lambda x: x["s"])
        return F.struct((i - 1).alias("p"), F.xxhash64(part).alias("h"), F.xxhash64(F.lit(1), part).alias("g"))

    windows = lines.select("doc_id", "key", F.explode(F.transform(starts, window)).alias("w")).select("doc_id", "key", "w.p", "w.h", "w.g")
    windows = written(windows, "windows")  # read twice: to count them and to find the later ones
    place = F.struct(F.col("doc_id"), F.col("key"), F.col("p"))
    repeated = windows.groupBy("h", "g").agg(F.count("*").alias("n"), F.min(place).alias("first")).where("n > 1").drop("n")
    later = windows.join(repeated, ["h", "g"]).where(place != F.col("first"))
    same = F.col("first.doc_id").eqNullSafe(F.col("doc_id")) & (F.col("first.key") == F.col("key"))
    begin = F.when(same, F.greatest(F.col("p"), F.col("first.p") + width)).otherwise(F.col("p"))
    covered = later.select("doc_id", "key", begin.alias("b"), (F.col("p") + width).alias("e")).where("b < e")
    # every line that a later occurrence covers, once for each document
    spans = covered.groupBy("doc_id", "key").agg(F.collect_set(F.struct("b", "e")).alias("spans"))
    spans = spans.select(F.col("doc_id").alias("_id"), F.col("key").alias("_key"), F.array_distinct(F.flatten(F.transform("spans", lambda s: F.sequence(s["b"], s["e"] - 1)))).alias("gone"))
    joined = rows.join(spans, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("key") == F.col("_key")), "left")

    def without(every: Column) -> Column:
        def at(places: Column) -> Column:
            dropped = F.transform("gone", lambda k: F.get(places, k))
            return F.array_join(F.transform(F.array_except(F.sequence(F.lit(0), F.size(every) - 1), dropped), lambda i: F.get(every, i)), "\n")

        return let(F.transform(_lines(F.col("text")), lambda x: x["i"]), at)

    return joined.select(
        "doc_id",
        F.when(F.col("gone").isNull(), F.col("text")).otherwise(let(F.split("text", "\n", -1), without)).alias("text"),
        F.when(F.coalesce(F.col("text"), F.lit("")) == "", 0).otherwise(F.size(F.split("text", "\n", -1))).cast("long").alias("n_lines"),
        F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_removed"),
        *(["row"] if "row" in docs.columns else []),
    )


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_lines(table(spark, sf_dir, "documents"))
