"""Whole flows: the catalogue merge."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..plans.merge import merge_plan
from ..registry import register
from . import table

_SQL = """
with g as (select o_custkey, count(*) as members, count(*) filter (o_orderstatus = 'O') as updates from orders group by o_custkey),
base as (select o_custkey, o_orderkey as base from (select *, row_number() over (partition by o_custkey order by (o_orderstatus = 'F') desc, o_orderkey) as n from orders) where n = 1),
latest as (select o_custkey, o_orderkey as latest from (select *, row_number() over (partition by o_custkey order by o_orderdate desc, o_orderkey desc) as n from orders where o_orderstatus = 'O') where n = 1),
items as (select o_custkey, count(*) as items, round(sum(l_quantity), 2) as quantity from lineitem join (select o_custkey, base as l_orderkey from base union select o_custkey, latest from latest) using (l_orderkey) group by o_custkey)
select g.o_custkey, c_name, members, updates, base, latest, coalesce(items, 0) as items, coalesce(quantity, 0.0) as quantity
from g join customer on c_custkey = g.o_custkey join base using (o_custkey) left join latest using (o_custkey) left join items using (o_custkey)
"""


@register("merge_plan", _SQL)
def merge_plan_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merge_plan(table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer"), table(spark, sf_dir, "lineitem"))
