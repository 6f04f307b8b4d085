"""Layouts, track starts, chains."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import chains, containers
from ..registry import register
from . import table


@register(
    "partition_layout",
    """select p_partkey, coalesce(sum(strlen(p_name) + 1) over b, 0)::bigint as name_offset, coalesce(sum(p_size * 1000) over b, 0)::bigint as data_offset,
       (16 + count(*) over e * 24 + (sum(strlen(p_name) + 1) over e + 15) // 16 * 16)::bigint as header_size from (select *, p_name || p_partkey::varchar as x from part)
       window b as (partition by p_type order by x rows between unbounded preceding and 1 preceding), e as (partition by p_type)""".replace("strlen(p_name)", "strlen(x)"),
)
def partition_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").select("p_partkey", "p_type", F.concat("p_name", F.col("p_partkey").cast("string")).alias("x"), (F.col("p_size") * 1000).alias("size"))
    return containers.partition_layout(p, "p_type", "x", "size").select("p_partkey", "name_offset", "data_offset", "header_size")


@register(
    "track_starts",
    """select o_orderkey, coalesce(sum(f) over b, 0)::bigint as physical, coalesce(sum((f + 3) // 4 * 4) over b, 0)::bigint as padded, (coalesce(sum(f + 150) over b, 0) + 150)::bigint as logical
       from (select *, floor(o_totalprice)::bigint as f from orders) window b as (partition by o_custkey order by o_orderkey rows between unbounded preceding and 1 preceding)""",
)
def track_starts(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", F.floor("o_totalprice").alias("frames"))
    return containers.track_starts(o, "o_custkey", "o_orderkey", "frames", F.lit(150)).select("o_orderkey", "physical", "padded", "logical")


@register("split_by_id", "select l_orderkey, l_linenumber, p_partkey from lineitem join part on substr(md5(l_partkey::varchar), 1, 32) = md5(p_partkey::varchar)")
def split_by_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    contents = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.concat(F.md5(F.col("l_partkey").cast("string")), F.lit(".nca")).alias("file"))
    metas = table(spark, sf_dir, "part").select("p_partkey", F.upper(F.md5(F.col("p_partkey").cast("string"))).alias("content_id"))
    return containers.split_by_id(contents, metas, "file", "content_id").select("l_orderkey", "l_linenumber", "p_partkey")


@register("block_chains", "select conv_id * 1000 + turn as k, conv_id * 1000 as head, turn as position from conversations")
def block_chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("conv_id") * 1000 + F.col("turn")
    c = table(spark, sf_dir, "conversations").select(k.alias("k"), F.when(F.col("turn") > 0, k - 1).alias("before"))
    return chains.positions(c, "k", "before")
