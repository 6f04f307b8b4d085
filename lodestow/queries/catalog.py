"""Filters, classification, picking, counting."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import names, numbers
from ..operators import catalog as C
from ..registry import register
from . import table


@register(
    "cat_search",
    "select p_partkey, p_name, p_brand, p_type from part where (contains(lower(p_name), 'a') or contains(lower(p_brand), 'a') or contains(lower(p_type), 'a')) and p_size <= 25",
)
def cat_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.search(table(spark, sf_dir, "part").where("p_size <= 25"), "A", ["p_name", "p_brand", "p_type"]).select("p_partkey", "p_name", "p_brand", "p_type")


@register("cat_of_kinds", "select event_type, count(*) as n from events where lower(event_type) in ('view', 'click') group by event_type")
def cat_of_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.of_kinds(table(spark, sf_dir, "events"), "event_type", ["VIEW", "Click"]).groupBy("event_type").agg(F.count("*").alias("n"))


@register("cat_optional_filter", "select o_orderkey, o_custkey from orders where o_orderstatus = 'F' and o_orderpriority = '1-URGENT'")
def cat_optional_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.optional_filter(table(spark, sf_dir, "orders"), o_orderstatus="F", o_custkey=None, o_orderpriority="1-URGENT").select("o_orderkey", "o_custkey")


@register(
    "classify_signature",
    """select doc_id, case when starts_with(text, 'The ') then 'the' when starts_with(text, 'Der ') then 'der' when contains(lower(text), 'license') then 'license'
       when contains(text, '|') then 'table' when length(text) < 200 then 'short' else 'prose' end as class from documents""",
)
def classify_signature(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("text")
    rules = [(t.startswith("The "), "the"), (t.startswith("Der "), "der"), (F.contains(F.lower(t), F.lit("license")), "license"), (t.contains("|"), "table"), (F.length(t) < 200, "short")]
    return table(spark, sf_dir, "documents").select("doc_id", C.first_rule(rules, "prose").alias("class"))


_TIER = "case when n_chars < 100 then 0 when n_chars < 1000 then 1 else 2 end"


@register("tier_candidates", f"select source, doc_id, tier from (select source, doc_id, {_TIER} as tier, min({_TIER}) over (partition by source) as best from documents) where tier = best")
def tier_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.least_tier(table(spark, sf_dir, "documents"), ["source"], F.expr(_TIER)).select("source", "doc_id", "tier")


@register(
    "type_tag",
    """select user_id, concat_ws('+', case when bool_or(event_type = 'view') then 'V' end, case when bool_or(event_type = 'signup') then 'S' end,
       case when bool_or(event_type = 'purchase') then 'P' end) as tag from events group by user_id""",
)
def type_tag(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = table(spark, sf_dir, "events").groupBy("user_id").agg(F.collect_set("event_type").alias("kinds"))
    return kinds.select("user_id", C.type_tag(F.col("kinds"), [("view", "V"), ("signup", "S"), ("purchase", "P")]).alias("tag"))


@register(
    "count_tag",
    """select user_id, concat_ws('+', case when p = 1 then 'P' when p > 1 then p::varchar || 'P' end, case when s = 1 then 'S' when s > 1 then s::varchar || 'S' end) as tag
       from (select user_id, count(*) filter (event_type = 'purchase') as p, count(*) filter (event_type = 'signup') as s from events group by user_id)""",
)
def count_tag(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "events").groupBy("user_id").agg(F.count_if(F.col("event_type") == "purchase").alias("p"), F.count_if(F.col("event_type") == "signup").alias("s"))
    return n.select("user_id", C.count_tag([(F.col("p"), "P"), (F.col("s"), "S")]).alias("tag"))


@register(
    "latest_top1",
    "select o_custkey, o_orderkey, o_totalprice from (select *, row_number() over (partition by o_custkey order by o_orderdate desc, o_orderkey desc) as n from orders) where n = 1",
)
def latest_top1(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_totalprice", "o_orderdate")
    return C.last_by(o, ["o_custkey"], [F.col("o_orderdate"), F.col("o_orderkey")]).drop("o_orderdate")


@register("dedupe_first", "select min(doc_id) as doc_id, text from documents group by text")
def dedupe_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.first_by(table(spark, sf_dir, "documents").select("doc_id", "text"), ["text"], [F.col("doc_id")])


@register("dedupe_last", "select max(doc_id) as doc_id, arg_max(source, doc_id) as source, text from documents group by text")
def dedupe_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.last_by(table(spark, sf_dir, "documents").select("doc_id", "source", "text"), ["text"], [F.col("doc_id")])


@register(
    "group_roles",
    """select l_orderkey, count(*) filter (l_returnflag = 'R') as n_returned, count(*) filter (l_returnflag = 'A') as n_accepted, count(*) filter (l_returnflag = 'N') as n_new,
       epoch_us(max(l_shipdate)) as last_ship from lineitem group by l_orderkey""",
)
def group_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    flag = lambda x: F.count_if(F.col("l_returnflag") == x)
    last = F.expr("timestampdiff(microsecond, timestamp_ntz'1970-01-01', max(l_shipdate))")
    return table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(flag("R").alias("n_returned"), flag("A").alias("n_accepted"), flag("N").alias("n_new"), last.alias("last_ship"))


@register("distinct_key_count", "select p_type, count(distinct upper(p_brand)) as brands from part group by p_type")
def distinct_key_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").groupBy("p_type").agg(F.count_distinct(names.ci_key(F.col("p_brand"))).alias("brands"))


@register("set_union_ids", "select l_orderkey, array_to_string(list_sort(list_distinct(list(l_suppkey))), ',') as suppliers from lineitem group by l_orderkey")
def set_union_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = F.array_sort(F.collect_set("l_suppkey"))
    return table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_join(ids.cast("array<string>"), ",").alias("suppliers"))


@register(
    "best_candidate",
    """select o_custkey, o_orderkey from (select *, row_number() over (partition by o_custkey order by (o_orderpriority = '1-URGENT') desc, o_totalprice desc, o_orderkey desc) as n from orders) where n = 1""",
)
def best_candidate(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderpriority", "o_totalprice")
    return C.last_by(o, ["o_custkey"], [F.col("o_orderpriority") == "1-URGENT", F.col("o_totalprice"), F.col("o_orderkey")]).select("o_custkey", "o_orderkey")


@register("merge_flags", "select o_custkey, bit_or(1 << (length(o_orderstatus) + (o_orderkey % 7)::int)) as flags from orders group by o_custkey")
def merge_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.expr("cast(bit_or(shiftleft(1, cast(length(o_orderstatus) + o_orderkey % 7 as int))) as bigint)").alias("flags"))


@register(
    "append_new",
    """with old as (select doc_id, text from documents where doc_id % 2 = 0), batch as (select min(doc_id) as doc_id, text from documents where doc_id % 2 = 1 group by text)
       select doc_id from old union all select doc_id from batch where text not in (select text from old)""",
)
def append_new(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", "text")
    return C.append_new(d.where("doc_id % 2 = 0"), d.where("doc_id % 2 = 1"), ["text"], [F.col("doc_id")]).select("doc_id")


@register(
    "fallback_title",
    "select doc_id, coalesce(case when trim(lang) <> '' and lang <> 'en' then lang end, case when trim(source) <> '' and doc_id % 3 > 0 then source end, 'Unknown') as title from documents",
)
def fallback_title(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", C.fallback(F.when(F.col("lang") != "en", F.col("lang")), F.when(F.col("doc_id") % 3 > 0, F.col("source"))).alias("title"))


@register(
    "contiguous_parts",
    """select conv_id, count(turn) as parts, coalesce(min(turn) = 0 and max(turn) = count(turn) - 1 and count(distinct turn) = count(turn), true) as complete
       from conversations where (conv_id + turn) % 5 <> 3 group by conv_id""",
)
def contiguous_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.contiguous(table(spark, sf_dir, "conversations").where("(conv_id + turn) % 5 <> 3"), ["conv_id"], "turn", first=0)


@register(
    "volume_group",
    """select 'doc' || (doc_id // 40)::varchar || case doc_id % 4 when 0 then '.rar' when 1 then '.7z' when 2 then '.zip' else '.iso' end as volume,
       case when doc_id % 4 < 3 then min(doc_id // 4 % 10 + 1)::int end as first_part, count(*) as parts from documents group by doc_id // 40, doc_id % 4""",
)
def volume_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = "lpad(doc_id div 4 % 10 + 1, 3, '0')"
    name = F.expr(f"concat('Doc', doc_id div 40, element_at(array(concat('.part', {part}, '.rar'), concat('.7z.', {part}), concat('.zip.', {part}), '.iso'), cast(doc_id % 4 + 1 as int)))")
    d = table(spark, sf_dir, "documents").select(name.alias("file"))
    return d.groupBy(names.volume_key(F.col("file")).alias("volume")).agg(F.min(names.volume_part(F.col("file"))).alias("first_part"), F.count("*").alias("parts"))


@register("take_with_overflow", "(select 'taken' as what, o_orderkey as n from orders order by o_totalprice desc, o_orderkey limit 100) union all select 'left out', greatest(count(*) - 100, 0) from orders")
def take_with_overflow(spark: SparkSession, sf_dir: str) -> DataFrame:
    taken, left = C.take_with_overflow(table(spark, sf_dir, "orders"), 100, [F.desc("o_totalprice"), F.col("o_orderkey")])
    return taken.select(F.lit("taken").alias("what"), F.col("o_orderkey").alias("n")).union(left.select(F.lit("left out"), "skipped"))


@register(
    "role_order",
    "select o_orderkey, row_number() over (partition by o_custkey order by case o_orderstatus when 'F' then 0 when 'O' then 1 else 2 end, o_orderkey) as place from orders",
)
def role_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.ordered import renumber

    role = C.first_rule([(F.col("o_orderstatus") == "F", "0"), (F.col("o_orderstatus") == "O", "1")], "2")
    return renumber(table(spark, sf_dir, "orders"), ["o_custkey"], [role, F.col("o_orderkey")]).select("o_orderkey", F.col("number").alias("place"))


@register("size_format", """select l_orderkey * 4099 as n, case when l_orderkey * 4099 >= 1073741824 then (floor(l_orderkey * 4099 * 10 / 1073741824.0 + 0.5)::bigint // 10)::varchar || '.' || (floor(l_orderkey * 4099 * 10 / 1073741824.0 + 0.5)::bigint % 10)::varchar || ' GB'
       when l_orderkey * 4099 >= 1048576 then (floor(l_orderkey * 4099 * 10 / 1048576.0 + 0.5)::bigint // 10)::varchar || '.' || (floor(l_orderkey * 4099 * 10 / 1048576.0 + 0.5)::bigint % 10)::varchar || ' MB'
       when l_orderkey * 4099 >= 1024 then (floor(l_orderkey * 4099 * 10 / 1024.0 + 0.5)::bigint // 10)::varchar || '.' || (floor(l_orderkey * 4099 * 10 / 1024.0 + 0.5)::bigint % 10)::varchar || ' KB'
       else (l_orderkey * 4099)::varchar || ' B' end as size from (select distinct l_orderkey from lineitem)""")
def size_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") * 4099).alias("n")).distinct()
    return n.select("n", numbers.size_text(F.col("n")).alias("size"))


@register("size_parse", "select p_partkey, (case p_partkey % 3 when 0 then 1024 when 1 then 1048576 else 1073741824 end)::bigint * p_size as bytes from part")
def size_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.expr("concat(p_size, ' ', element_at(array('kb', 'MB', 'Gb'), cast(p_partkey % 3 + 1 as int)))")
    return table(spark, sf_dir, "part").select("p_partkey", numbers.size_bytes(text).alias("bytes"))


@register(
    "file_name_build",
    "select p_partkey, trim(regexp_replace(p_name || ' [' || p_brand || '] (' || p_type || ') [v' || p_size::varchar || '.0] [v' || (p_size * 65536)::varchar || ']', '\\s+', ' ', 'g')) as file from part",
)
def file_name_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    version = names.version_text(F.concat(F.lit("v"), F.col("p_size").cast("string"), F.lit(".0")))
    return table(spark, sf_dir, "part").select("p_partkey", names.composed_name(F.col("p_name"), F.col("p_brand"), F.col("p_type"), version, F.col("p_size") * 65536).alias("file"))


@register("base_ids", "select o_orderkey, substr(upper(lpad(printf('%x', o_orderkey * 70001), 16, '0')), 1, 12) || '0000' as base from orders")
def base_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select("o_orderkey", names.base_id(F.lower(F.hex(F.col("o_orderkey") * 70001))).alias("base"))


@register(
    "flag_expand",
    """select p_partkey, concat_ws(',', case when p_size & 1 > 0 then 'a' end, case when p_size & 2 > 0 then 'b' end, case when p_size & 4 > 0 then 'c' end, case when p_size & 8 > 0 then 'd' end) as flags from part""",
)
def flag_expand(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(numbers.flags(F.col("p_size"), list("abcd")), ",").alias("flags"))


@register("frame_addresses", "select doc_id, case when n_chars < 45000 then '0' else '' end || (n_chars // 4500)::varchar || ':' || lpad((n_chars // 75 % 60)::varchar, 2, '0') || ':' || lpad((n_chars % 75)::varchar, 2, '0') as msf, n_chars as frames from documents")
def frame_addresses(spark: SparkSession, sf_dir: str) -> DataFrame:
    msf = numbers.msf_text(F.col("n_chars"))
    return table(spark, sf_dir, "documents").select("doc_id", msf.alias("msf"), numbers.msf_frames(msf).alias("frames"))


@register("json_dim", "select event_type, sum(cast(json_extract(props, '$.k') as bigint))::bigint as total from events group by event_type")
def json_dim(spark: SparkSession, sf_dir: str) -> DataFrame:
    props = F.from_json("props", "k long")
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.sum(props["k"]).alias("total"))


@register("glob_filter", "select p_partkey from part where regexp_full_match(p_brand, 'Brand#.[1-3]')  or regexp_full_match(p_type, '.*E.?')")
def glob_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = F.col("p_brand")
    return table(spark, sf_dir, "part").where(names.glob_match(b, "Brand#?1") | names.glob_match(b, "Brand#?2") | names.glob_match(b, "Brand#?3") | names.glob_match(F.col("p_type"), "*E?") | names.glob_match(F.col("p_type"), "*E")).select("p_partkey")


@register("unique_names", "select doc_id, case when n = 1 then source || '.txt' else source || ' (' || (n - 1)::varchar || ').txt' end as file from (select doc_id, source, row_number() over (partition by source order by doc_id) as n from documents)")
def unique_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.ordered import spread_sums

    numbered = spread_sums(table(spark, sf_dir, "documents").select("doc_id", "source"), ["source"], [F.col("doc_id")], F.lit(1), "nth")
    return numbered.select("doc_id", names.numbered(F.concat("source", F.lit(".txt")), F.col("nth")).alias("file"))


@register(
    "regex_rules",
    "select doc_id, case when regexp_full_match(source, 'src[0-4]') then 'first' when regexp_full_match(source, 'src1.*') then 'teens' else 'rest' end as rule from documents",
)
def regex_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", C.regex_rule("source", [("src[0-4]", "first"), ("src1.*", "teens")], "rest").alias("rule"))


@register(
    "shallowest_root",
    """select o_custkey, arg_min(case when d = 1 then '' when d = 2 then 'a' else 'a/b' end, d) as root from (select o_custkey, (o_orderkey % 3 + 1) as d from orders) group by o_custkey""",
)
def shallowest_root(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.element_at(F.array(F.lit("Patch/x"), F.lit("a/patch/y"), F.lit("a/b/PATCH/z")), (F.col("o_orderkey") % 3 + 1).cast("int"))
    return C.shallowest(table(spark, sf_dir, "orders").select("o_custkey", path.alias("path")), ["o_custkey"], "path", ["patch"])


@register(
    "inferred_kind",
    """select o_custkey, case when sum(floor(o_totalprice)::bigint) > 500000 then 'high density' when count(*) filter (o_orderstatus <> 'F') = 0 then 'audio' when count(*) filter (o_orderstatus = 'F') = 0 then 'data' else 'mixed' end as kind
       from orders group by o_custkey""",
)
def inferred_kind(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select("o_custkey", F.when(F.col("o_orderstatus") == "F", "AUDIO").otherwise("MODE1").alias("type"), F.floor("o_totalprice").alias("frames"))
    return C.inferred_kind(o, ["o_custkey"], "type", "frames")
