"""Layered trees, versioned keys and sector deduplication."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .catalog import first_by, last_by


def overlay(entries: DataFrame, path: str = "path", layer: str = "layer") -> DataFrame:
    """Of each path the entry of the lowest layer."""
    return first_by(entries, [path], [F.col(layer)])


def without_shadowed(entries: DataFrame) -> DataFrame:
    """Entries (path, is_dir, layer) of an overlay without those that lie below a file of a lower layer."""
    files = entries.where("not is_dir").select(F.col("path").alias("_file"), F.col("layer").alias("_layer"))
    parts = F.split("path", "/")
    above = entries.where(F.size(parts) > 1).select("path", "layer", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda i: F.array_join(F.slice(parts, 1, i), "/"))).alias("_file"))
    hidden = above.join(files, "_file").where("_layer < layer").select("path", "layer").distinct()
    return overlay(entries.join(hidden, ["path", "layer"], "left_anti"))


def merged(target: DataFrame, source: DataFrame, keys: list[str], exclude: Column) -> DataFrame:
    """``target`` overwritten by the rows of ``source`` that are not excluded."""
    new = source.where(~exclude)
    return target.join(new, keys, "left_anti").unionByName(new)


def snapshot(log: DataFrame, key: str = "key", seq: str = "seq", deleted: str = "deleted") -> DataFrame:
    """The latest version of each key of a log of puts and deletions; deleted keys are left out."""
    return last_by(log, [key], [F.col(seq)]).where(~F.col(deleted))


def upserted(current: DataFrame, changes: DataFrame, keys: list[str], seq: str, deleted: str) -> DataFrame:
    """A snapshot after changes (the columns of ``current``, and a sequence number and a deletion mark)."""
    last = last_by(changes, keys, [F.col(seq)])
    return current.join(last, keys, "left_anti").unionByName(last.where(~F.col(deleted)).select(*current.columns))


def published(existing: DataFrame, new: DataFrame, ident: str, order: list[Column], keys: list[str]) -> DataFrame:
    """``new`` with identifiers from the greatest existing one on, counted within ``keys`` (one hot group is a window's)."""
    top = existing.groupBy(*keys).agg(F.max(ident).alias("_top"))
    return new.join(top, keys, "left").withColumn(ident, F.coalesce("_top", F.lit(0)) + F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).drop("_top")


def lower_bound(df: DataFrame, key: str, at) -> DataFrame:
    return df.where(F.col(key) >= F.lit(at)).orderBy(key)


def log_structured(base: DataFrame, log: DataFrame, keys: list[str], seq: str) -> DataFrame:
    """Blocks of ``base`` under the last block that the log has for each."""
    last = last_by(log, keys, [F.col(seq)])
    value = [c for c in base.columns if c not in keys][0]
    return base.select(*keys, F.col(value).alias("_b")).join(last.select(*keys, F.col(value).alias("_l")), keys, "full").select(*keys, F.coalesce("_l", "_b").alias(value), F.col("_l").isNotNull().alias("logged"))


def sector_index(sectors: DataFrame, content: str) -> tuple[DataFrame, DataFrame]:
    """(distinct, index): each different content once with the hash that names it, and the sectors with these names.

    Names are hashes, so no global numbering has to pass through one task.
    """
    named = sectors.withColumn("sector", F.sha2(F.col(content).cast("binary"), 256))
    return named.groupBy("sector").agg(F.any_value(content).alias(content), F.count("*").alias("uses")), named.drop(content)


def as_of(log: DataFrame, seq_no: int, key: str = "key", seq: str = "seq", deleted: str = "deleted") -> DataFrame:
    """The snapshot of a log as it was at a commit: what came later does not count."""
    return snapshot(log.where(F.col(seq) <= seq_no), key, seq, deleted)


def committed(copies: DataFrame, selector: DataFrame, written: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """(copies, selector) after a commit: what was written goes to the copy that is not selected, and is selected then.

    Until the new selector counts, every reader sees the old copies.
    """
    value = [c for c in written.columns if c not in keys][0]
    new = written.select(*keys, F.col(value).alias("_new")).join(selector.select(*keys, (1 - F.col("copy")).alias("copy")), keys)
    blocks = copies.join(new, [*keys, "copy"], "left").select(*keys, "copy", F.coalesce("_new", value).alias(value))
    turned = selector.join(new.select(*keys, F.col("copy").alias("_to")), keys, "left").select(*keys, F.coalesce("_to", "copy").alias("copy"))
    return blocks, turned
