"""Streams: polled changes, debouncing, sliding rates."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def watched(spark: SparkSession, path: str, schema: str, per_trigger: int | None = None, name: str = "*") -> DataFrame:
    """New Parquet files in the folder ``path`` whose names match ``name`` as a stream; ``per_trigger`` bounds the files of a batch."""
    reader = spark.readStream.schema(schema).option("pathGlobFilter", name)
    return (reader if per_trigger is None else reader.option("maxFilesPerTrigger", per_trigger)).parquet(path)


def of_kind(events: DataFrame, kinds: list[str], column: str = "event_type") -> DataFrame:
    return events.where(F.col(column).isin(kinds))


def debounced(events: DataFrame, key: str, at: str, gap_us: int) -> DataFrame:
    """Events at least ``gap_us`` after the last one of their key that passed; the state is that one's time.

    (key, at as microseconds).  Within a batch events go in order of time; one older than what has passed is dropped.
    """

    def step(k: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else None
        kept = []
        for t in sorted(x for df in parts for x in df["at"].tolist()):
            if last is None or t - last >= gap_us:
                last = t
                kept.append((*k, t))
        if last is not None:
            state.update((last,))
        yield pd.DataFrame(kept, columns=[key, "at"])

    kind = events.schema[key].dataType.simpleString()
    rows = events.select(key, F.unix_micros(F.col(at).cast("timestamp")).alias("at"))
    return rows.groupBy(key).applyInPandasWithState(step, f"{key} {kind}, at long", "last long", "append", GroupStateTimeout.NoTimeout)


def rates(events: DataFrame, at: str, amount: str, span: str, slide: str, late: str) -> DataFrame:
    """Sums and counts of sliding spans of event time; what comes later than ``late`` is left out."""
    timed = events.withColumn("_at", F.col(at).cast("timestamp")).withWatermark("_at", late)
    sums = timed.groupBy(F.window("_at", span, slide)).agg(F.sum(amount).alias("amount"), F.count("*").alias("n"))
    return sums.select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), "amount", "n")


def changes(before: DataFrame, after: DataFrame, keys: list[str]) -> DataFrame:
    """What differs between two snapshots: added, removed and changed rows by key."""
    rest = [c for c in after.columns if c not in keys]
    a = before.select(*keys, F.struct(*rest).alias("_a"))
    b = after.select(*keys, F.struct(*rest).alias("_b"))
    kind = F.when(F.col("_a").isNull(), "added").when(F.col("_b").isNull(), "removed").otherwise("changed")
    return a.join(b, keys, "full").where(~F.col("_a").eqNullSafe(F.col("_b"))).select(*keys, kind.alias("change"))
