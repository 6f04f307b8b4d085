from datetime import datetime, timedelta

from lodestow.operators import ordered
from lodestow.streaming import watch
from pyspark.sql import functions as F

T = datetime(2024, 1, 1)


def run(df, name, tmp_path, mode="append"):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return df.sparkSession.table(name)


def source(spark, tmp_path, batches):
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, "id string, ts timestamp, v double").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    return watch.watched(spark, str(tmp_path / "in"), "id string, ts timestamp, v double", per_trigger=1)


def test_debounce_across_batches(spark, tmp_path):
    s = lambda *x: [("d", T + timedelta(seconds=i), 1.0) for i in x]
    stream = source(spark, tmp_path, [s(0, 0.4, 0.9), s(1.2, 1.5, 2.3)])
    got = sorted(r["at"] for r in run(watch.debounced(stream, "id", "ts", 1_000_000), "debounced", tmp_path).collect())
    batch = spark.read.parquet(str(tmp_path / "in")).select("id", F.unix_micros("ts").alias("at"))
    assert got == sorted(r["at"] for r in ordered.debounced(batch, ["id"], "at", 1_000_000, "at").collect())
    assert len(got) == 3


def test_rates(spark, tmp_path):
    stream = source(spark, tmp_path, [[("d", T + timedelta(seconds=i), 2.0)] for i in (0, 1, 30)])
    got = {(r["start"], r["n"]) for r in run(watch.rates(stream, "ts", "v", "2 seconds", "2 seconds", "1 second"), "rates", tmp_path).collect()}
    assert (T, 2) in got


def test_changes(spark):
    a = spark.createDataFrame([(1, "x"), (2, "y"), (3, None)], "k int, v string")
    b = spark.createDataFrame([(1, "x"), (3, "z"), (4, "n")], "k int, v string")
    assert {(r["k"], r["change"]) for r in watch.changes(a, b, ["k"]).collect()} == {(2, "removed"), (3, "changed"), (4, "added")}
