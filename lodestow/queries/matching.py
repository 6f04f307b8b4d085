"""Pairing, priorities, ranges, set operations, layers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import layers as L
from ..operators import matching as M
from ..registry import register
from . import table

_MICROS = "timestampdiff(microsecond, timestamp_ntz'1970-01-01', ts)"


@register(
    "pair_full_outer",
    """select coalesce(d.doc_id, l.doc_id) as doc_id, case when l.doc_id is null then 'left' when d.doc_id is null then 'right' else 'both' end as status
       from (select doc_id from documents where doc_id % 3 <> 0) d full outer join labels l on d.doc_id = l.doc_id""",
)
def pair_full_outer(spark: SparkSession, sf_dir: str) -> DataFrame:
    # a third of the documents is taken away so that both kinds of orphans exist
    d = table(spark, sf_dir, "documents").where("doc_id % 3 <> 0").select("doc_id")
    return M.pair_full(d, table(spark, sf_dir, "labels").select("doc_id"), "doc_id").select("doc_id", "status")


@register("validated_match", "select doc_id, min(doc_id) over (partition by text) as original from documents")
def validated_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the first of those that have its text: they meet by a checksum and are held against the digest and the length."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.crc32(F.encode("text", "UTF-8")).alias("crc"), F.md5("text").alias("h"), "n_chars")
    first = d.groupBy("crc", F.col("h").alias("fh"), F.col("n_chars").alias("fn")).agg(F.min("doc_id").alias("original"))
    return M.validated(d, first, ["crc"], (F.col("h") == F.col("fh")) & (F.col("n_chars") == F.col("fn"))).select("doc_id", "original")


@register("unmatched_anti", "select doc_id from documents where doc_id not in (select doc_id from labels)")
def unmatched_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.unmatched(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), ["doc_id"]).select("doc_id")


@register("semi_allow", "select l_suppkey, count(*) as n from lineitem where l_partkey in (select p_partkey from part where p_size > 40) or l_partkey is null group by l_suppkey")
def semi_allow(spark: SparkSession, sf_dir: str) -> DataFrame:
    allowed = table(spark, sf_dir, "part").where("p_size > 40").select(F.col("p_partkey").alias("l_partkey"))
    return M.allowed_or_blank(table(spark, sf_dir, "lineitem"), allowed, "l_partkey").groupBy("l_suppkey").agg(F.count("*").alias("n"))


@register(
    "two_hop_priority",
    """select c_custkey, coalesce(a.n_name, r.r_name) as place, case when a.n_name is not null then 0 when r.r_name is not null then 1 end as tier
       from customer c left join (select * from nation where n_nationkey % 2 = 0) a on c.c_nationkey = a.n_nationkey left join nation n on c.c_nationkey = n.n_nationkey left join region r on n.n_regionkey = r.r_regionkey""",
)
def two_hop_priority(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    near = nation.where("n_nationkey % 2 = 0").select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("place"))
    far = nation.join(region, F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_nationkey").alias("c_nationkey"), F.col("r_name").alias("place"))
    return M.by_priority(table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey"), [near, far], ["c_nationkey"], "place").select("c_custkey", "place", "tier")


@register(
    "union_lookup",
    """select coalesce(a.k, b.k) as k, coalesce(a.v, b.v) as v, case when a.v is null then 'update' when b.v is null then 'base' else 'both' end as side
       from (select p_partkey as k, p_name as v from part where p_partkey % 3 <> 0) a full outer join (select p_partkey as k, p_brand as v from part where p_partkey % 2 = 0) b on a.k = b.k""",
)
def union_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    return M.union_lookup(p.where("p_partkey % 3 <> 0").select(F.col("p_partkey").alias("k"), F.col("p_name").alias("v")), p.where("p_partkey % 2 = 0").select(F.col("p_partkey").alias("k"), F.col("p_brand").alias("v")), ["k"], "v")


@register(
    "exact_else_contains",
    """with n as (select distinct p_type || ' ' || p_brand as name from part union select distinct p_brand as name from part), t as (select distinct p_brand as target from part), e as (select name, target from n join t on name = target)
       select name, target, 'exact' as how from e union all select name, target, 'contains' as how from n join t on contains(name, target) where name not in (select name from e)""",
)
def exact_else_contains(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    n = p.select(F.concat_ws(" ", "p_type", "p_brand").alias("name")).union(p.select("p_brand"))
    return M.exact_else_contains(n, p.select(F.col("p_brand").alias("target")), "name", "target", grams=8)


@register(
    "benchmark_contained",
    "select item_id, count(*) as documents from (select distinct b.item_id, d.doc_id from benchmark b join documents d on contains(d.text, b.text)) group by item_id",
)
def benchmark_contained(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = M.passages_in(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), "doc_id", "text", "item_id", "text")
    return found.groupBy("item_id").agg(F.count("*").alias("documents"))


@register(
    "as_of_extent",
    """select e.event_id, s.event_id as since from events e asof left join (select event_id, user_id, ts from events where event_type = 'signup' qualify row_number() over (partition by user_id, ts order by event_id desc) = 1) s
       on e.user_id = s.user_id and e.ts >= s.ts""",
)
def as_of_extent(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("event_id", "user_id", F.expr(_MICROS).alias("at"))
    signups = table(spark, sf_dir, "events").where("event_type = 'signup'").groupBy("user_id", F.expr(_MICROS).alias("start")).agg(F.max("event_id").alias("since"))
    return M.containing_extent(e, signups, "user_id", "at", "start", ["since"]).select("event_id", "since")


@register(
    "range_overlaps",
    """select r.o_orderkey, greatest(r.a, e.a) as "from", least(r.b, e.b) as "until", e.p + greatest(r.a, e.a) - e.a as p_from
       from (select o_orderkey, o_custkey, o_orderkey * 10 as a, o_orderkey * 10 + 35 as b from orders) r join (select o_custkey, o_orderkey * 10 + 5 as a, o_orderkey * 10 + 45 as b, o_orderkey * 1000 as p from orders where o_orderkey % 2 = 0) e
       on r.o_custkey = e.o_custkey and r.a < e.b and e.a < r.b""",
)
def range_overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    reads = o.select("o_custkey", "o_orderkey", (k * 10).alias("v_start"), (k * 10 + 35).alias("v_end"))
    extents = o.where(k % 2 == 0).select("o_custkey", (k * 10 + 5).alias("e_start"), (k * 10 + 45).alias("e_end"), (k * 1000).alias("p_start"))
    return M.range_overlaps(reads, extents, "o_custkey", 16).select("o_orderkey", "from", "until", "p_from")


@register("broadcast_dim", "select n_name, count(*) as customers, round(sum(c_acctbal), 2) as balance from customer left join nation on c_nationkey = n_nationkey group by n_name")
def broadcast_dim(spark: SparkSession, sf_dir: str) -> DataFrame:
    # no hint: Spark broadcasts the dimension where its size, read from the file, is under the threshold
    joined = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"), "left")
    return joined.groupBy("n_name").agg(F.count("*").alias("customers"), F.round(F.sum("c_acctbal"), 2).alias("balance"))


@register(
    "greedy_pairs",
    """select a.o_orderkey as source, b.o_orderkey as patch from (select o_orderkey, o_custkey, row_number() over (partition by o_custkey order by o_orderkey) as n from orders where o_orderstatus = 'F') a
       join (select o_orderkey, o_custkey, row_number() over (partition by o_custkey order by o_orderkey) as n from orders where o_orderstatus = 'O') b on a.o_custkey = b.o_custkey and a.n = b.n""",
)
def greedy_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    return M.greedy_pairs(o.where("o_orderstatus = 'F'").select("o_custkey", F.col("o_orderkey").alias("source")), o.where("o_orderstatus = 'O'").select("o_custkey", F.col("o_orderkey").alias("patch")), ["o_custkey"], "source", "patch").select("source", "patch")


@register("first_owner", "select l_partkey as item, min(l_orderkey) as owner from lineitem group by l_partkey")
def first_owner(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("owner")).agg(F.collect_set("l_partkey").alias("items"))
    return M.first_owner(orders, "items", "owner", [F.col("owner")])


@register("set_union", "select l_suppkey as k from lineitem where l_quantity > 45 union select p_partkey as k from part where p_size > 45")
def set_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _a(spark, sf_dir).union(_b(spark, sf_dir)).distinct()


@register("set_except", "select l_suppkey as k from lineitem where l_quantity > 45 except select p_partkey as k from part where p_size > 45")
def set_except(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _a(spark, sf_dir).subtract(_b(spark, sf_dir))


@register("set_intersect", "select l_suppkey as k from lineitem where l_quantity > 45 intersect select p_partkey as k from part where p_size > 45")
def set_intersect(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _a(spark, sf_dir).intersect(_b(spark, sf_dir))


def _a(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").where("l_quantity > 45").select(F.col("l_suppkey").alias("k"))


def _b(spark, sf_dir):
    return table(spark, sf_dir, "part").where("p_size > 45").select(F.col("p_partkey").alias("k"))


@register("overlay_layers", "select n_chars as path, layer, doc_id from (select n_chars, doc_id, doc_id % 4 as layer, row_number() over (partition by n_chars order by doc_id % 4, doc_id) as n from documents) where n = 1")
def overlay_layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select(F.col("n_chars").alias("path"), F.struct(F.col("doc_id") % 4, F.col("doc_id")).alias("layer"), "doc_id")
    return L.overlay(d).select("path", (F.col("doc_id") % 4).alias("layer"), "doc_id")


@register(
    "kv_snapshot",
    "select user_id, event_id, value from (select *, row_number() over (partition by user_id order by event_id desc) as n from events) where n = 1 and event_type <> 'error'",
)
def kv_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("user_id", "event_id", "value", (F.col("event_type") == "error").alias("deleted"))
    return L.snapshot(e, "user_id", "event_id").drop("deleted")


@register(
    "kv_upsert",
    """with last as (select *, row_number() over (partition by o_custkey order by o_orderkey desc) as n from orders where o_orderkey % 3 = 0) select c_custkey as k, c_acctbal as v from customer where c_custkey not in (select o_custkey from last)
       union all select o_custkey as k, o_totalprice as v from last where n = 1 and o_orderstatus <> 'F'""",
)
def kv_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    now = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), F.col("c_acctbal").alias("v"))
    changes = table(spark, sf_dir, "orders").where("o_orderkey % 3 = 0").select(F.col("o_custkey").alias("k"), F.col("o_totalprice").alias("v"), "o_orderkey", (F.col("o_orderstatus") == "F").alias("gone"))
    return L.upserted(now, changes, ["k"], "o_orderkey", "gone")


@register(
    "log_structured",
    """select coalesce(l.k, p.k) as k, coalesce(l.v, p.v) as v, l.k is not null as logged from (select p_partkey as k, p_size as v from part) p
       full outer join (select l_partkey as k, arg_max(l_linenumber, l_orderkey * 100 + l_linenumber) as v from lineitem where l_orderkey % 7 = 0 group by l_partkey) l on p.k = l.k""",
)
def log_structured(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), F.col("p_size").alias("v"))
    log = table(spark, sf_dir, "lineitem").where("l_orderkey % 7 = 0").select(F.col("l_partkey").alias("k"), F.col("l_linenumber").alias("v"), (F.col("l_orderkey") * 100 + F.col("l_linenumber")).alias("seq"))
    return L.log_structured(base, log, ["k"], "seq")


@register("merge_dirs", "select p_partkey as k, p_name as v from part where p_partkey not in (select s_suppkey from supplier where s_acctbal > 0) union all select s_suppkey as k, s_name as v from supplier where s_acctbal > 0")
def merge_dirs(spark: SparkSession, sf_dir: str) -> DataFrame:
    target = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), F.col("p_name").alias("v"))
    source = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("k"), F.col("s_name").alias("v"), "s_acctbal")
    return L.merged(target, source.where("s_acctbal > 0").drop("s_acctbal"), ["k"], F.lit(False))


@register("sector_dedupe", "select sha256(line) as sector, count(*) as uses from (select unnest(string_split(text, chr(10))) as line from documents) group by line")
def sector_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    sectors = table(spark, sf_dir, "documents").select("doc_id", F.explode(F.split("text", "\n", -1)).alias("line"))
    return L.sector_index(sectors, "line")[0].select("sector", "uses")


@register(
    "tree_levels",
    """with recursive t as (select conv_id, turn, 0 as level from conversations where turn = 0 union all select c.conv_id, c.turn, t.level + 1 from conversations c join t on c.conv_id = t.conv_id and c.turn = t.turn + 1)
       select conv_id * 1000 + turn as k, level from t""",
)
def tree_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.ordered import tree_levels as levels

    c = table(spark, sf_dir, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("k"), F.when(F.col("turn") > 0, F.col("conv_id") * 1000 + F.col("turn") - 1).alias("parent"))
    return levels(c, "k", "parent").select("k", "level")


@register(
    "bucket_fallback",
    """with b as (select distinct p_type as key from part), s as (select p_partkey, lower(substr(p_brand, 1, 1)) || case when p_partkey % 2 = 0 then 'zz' else '' end as x, substr(p_type, length(p_type) - 2) as ext from part)
       select p_partkey, s.ext, (select min(key) from b where contains(key, s.ext)) as key from s""",
)
def bucket_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    sources = p.select("p_partkey", F.substring("p_type", F.length("p_type") - 2, F.lit(3)).alias("ext"))
    buckets = p.select(F.col("p_type").alias("key")).distinct().withColumn("ord", F.col("key"))
    return M.bucket_fallback(sources, buckets, "ext", "key", "ord").select("p_partkey", "ext", "key")


@register(
    "selected_copies",
    "select a.p_partkey as k, case when s.c = 1 then p_brand else p_name end as v from part a left join (select p_partkey, (p_size % 2)::int as c from part where p_size > 10) s on a.p_partkey = s.p_partkey",
)
def selected_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    copies = p.select(F.col("p_partkey").alias("k"), F.lit(0).alias("copy"), F.col("p_name").alias("v")).union(p.select("p_partkey", F.lit(1), "p_brand"))
    return M.unpacked(copies, p.where("p_size > 10").select(F.col("p_partkey").alias("k"), (F.col("p_size") % 2).alias("copy")), ["k"])
