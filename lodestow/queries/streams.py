"""Streams over the events file, run until all that is there has been read."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..registry import register
from ..session import shared, visible
from ..streaming import watch
from . import table

_HALF_DAY = 12 * 3600 * 1_000_000


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table as a stream of its files: of its folder, or, if it is one file, of the files of its name beside it."""
    schema = table(spark, sf_dir, "events").schema
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{sf_dir}/events.parquet")
    if where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(where).isDirectory():
        return watch.watched(spark, f"{sf_dir}/events.parquet", schema)
    return watch.watched(spark, sf_dir, schema, name="events.parquet")


def _drained(stream: DataFrame) -> DataFrame:
    spark, path = stream.sparkSession, f"{shared(stream.sparkSession)}/stream-{uuid.uuid4().hex}"
    query = stream.writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{path}/out")


@register(
    "stream_debounce",
    f"""with recursive e as (select user_id, epoch_us(ts) as t, row_number() over (partition by user_id order by ts, event_id) as n from events),
       f as (select user_id, n, t as last, true as kept from e where n = 1
             union all select e.user_id, e.n, case when e.t - f.last >= {_HALF_DAY} then e.t else f.last end, e.t - f.last >= {_HALF_DAY} from f join e on e.user_id = f.user_id and e.n = f.n + 1)
       select user_id, last as "at" from f where kept""",
)
def stream_debounce(spark: SparkSession, sf_dir: str) -> DataFrame:
    visible(spark)
    return _drained(watch.debounced(_events(spark, sf_dir), "user_id", "ts", _HALF_DAY))


@register("stream_filter", "select event_id, user_id from events where event_type in ('signup', 'error')")
def stream_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _drained(watch.of_kind(_events(spark, sf_dir), ["signup", "error"]).select("event_id", "user_id"))


@register(
    "stream_rates",
    """select epoch_us(date_trunc('day', ts)) as start, count(*) as n, round(sum(value), 4) as amount from events group by 1 having date_trunc('day', min(ts)) + interval 1 day <= (select max(ts) - interval 1 hour from events)""",
)
def stream_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sums of the days that the watermark has closed."""
    closed = watch.rates(_events(spark, sf_dir), "ts", "value", "1 day", "1 day", "1 hour")
    return _drained(closed).select(F.unix_micros("start").alias("start"), "n", F.round("amount", 4).alias("amount"))
