"""Session helpers shared by the training-data operators."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


#: Rows and bytes of an Arrow batch, where the session has Spark's defaults: 10,000 long texts are too much for a task.
BATCH = {"spark.sql.execution.arrow.maxRecordsPerBatch": ("10000", "1000"), "spark.sql.execution.arrow.maxBytesPerBatch": (str(64 << 20), str(8 << 20))}


def prepare(spark: SparkSession) -> SparkSession:
    """Let Python workers import this package (the path is merged with theirs), bound Arrow batches, and see to a checkpoint folder."""
    sc = spark.sparkContext
    for name, (default, bound) in BATCH.items():
        if spark.conf.get(name).removesuffix("b") == default:
            spark.conf.set(name, bound)
    path = sc.environment.get("PYTHONPATH", "")
    if ROOT not in path.split(":"):
        sc.environment["PYTHONPATH"] = f"{path}:{ROOT}" if path else ROOT
    if spark.conf.get("spark.checkpoint.dir", None) is None and sc.getCheckpointDir() is None:
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="lodestow-"))
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: ``spark.checkpoint.dir``, or our own where it is unset."""
    prepare(spark)
    return spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()


def written(df: DataFrame, label: str) -> DataFrame:
    """``df`` written once as Parquet in the shared folder and read back: cuts lineage, survives lost executors.

    The files go when the application ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(conf).deleteOnExit(where)
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{sf_dir}/{name}.parquet")
