"""The flow that merges a base, its updates and what belongs to them: group, rank, allow, look up."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def merge_plan(metas: DataFrame, titles: DataFrame, contents: DataFrame) -> DataFrame:
    """A row for each group of metas (orders by customer): its name, members, base, latest update and what both contain.

    The base is the first row of status F, or else the first of any; the latest update is the last of status O.
    All picks are partial aggregates of one pass over the metas; the contents meet the picked ids in one join.
    """
    update = F.col("o_orderstatus") == "O"
    groups = metas.groupBy("o_custkey").agg(
        F.count("*").alias("members"),
        F.count_if(update).alias("updates"),
        F.min_by("o_orderkey", F.struct(F.col("o_orderstatus") != "F", "o_orderkey")).alias("base"),
        F.max_by(F.when(update, F.col("o_orderkey")), F.when(update, F.struct("o_orderdate", "o_orderkey"))).alias("latest"),
    )
    picked = groups.select("o_custkey", F.explode(F.array_distinct(F.array("base", "latest"))).alias("l_orderkey")).where("l_orderkey is not null")
    items = contents.join(picked, "l_orderkey").groupBy("o_custkey").agg(F.count("*").alias("items"), F.round(F.sum("l_quantity"), 2).alias("quantity"))
    named = groups.join(titles.select(F.col("c_custkey").alias("o_custkey"), "c_name"), "o_custkey")
    return named.join(items, "o_custkey", "left").withColumns({"items": F.coalesce("items", F.lit(0)), "quantity": F.coalesce("quantity", F.lit(0.0))}).select("o_custkey", "c_name", "members", "updates", "base", "latest", "items", "quantity")
