"""The registered queries: operators applied to the supplied tables, with the DuckDB SQL of the same rows."""

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def crc32_sql(text: str) -> str:
    """SQL for the CRC-32 of a short ASCII text, which the SQL engine has no function for: its polynomial bit by bit."""
    step = "xor(c, b)"
    for _ in range(8):
        step = f"list_transform([{step}], lambda v: xor(v >> 1, (v & 1) * 3988292384))[1]"
    codes = f"list_transform(string_split({text}, ''), lambda ch: ascii(ch)::bigint)"
    return f"xor(list_reduce(list_prepend(4294967295::bigint, {codes}), lambda c, b: {step}), 4294967295)"
