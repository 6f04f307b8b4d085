"""Offsets, neighbours, runs, packing, rates, blocks, digests, links."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import digests
from ..operators import blocks as B
from ..operators import ordered as O
from ..registry import register
from ..sources import pages as P
from . import table

_MICROS = "timestampdiff(microsecond, timestamp_ntz'1970-01-01', ts)"
_HALF_DAY = 12 * 3600 * 1_000_000


@register(
    "cumsum_offsets",
    """select o_orderkey, coalesce(sum((floor(o_totalprice)::bigint + 15) // 16 * 16) over (partition by o_custkey order by o_orderkey rows between unbounded preceding and 1 preceding), 0)::bigint as "offset" from orders""",
)
def cumsum_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.offsets(table(spark, sf_dir, "orders"), ["o_custkey"], [F.col("o_orderkey")], F.floor("o_totalprice"), 16).select("o_orderkey", "offset")


@register("lead_length", "select event_id, lead(epoch_us(ts)) over (partition by user_id order by ts, event_id) - epoch_us(ts) as length from events")
def lead_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("event_id", "user_id", F.expr(_MICROS).alias("at"))
    return O.until_next(e, ["user_id"], [F.col("at"), F.col("event_id")], "at").select("event_id", "length")


@register("renumber_label", "select doc_id, n as number, 'D' || lpad(n::varchar, 6, '0') as label from (select doc_id, row_number() over (partition by source order by n_chars desc, doc_id) as n from documents)")
def renumber_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", "source", "n_chars")
    return O.spread_renumber(d, ["source"], [F.desc("n_chars"), F.col("doc_id")], "D", 6).select("doc_id", "number", "label")


@register(
    "extent_coalesce",
    """with x as (select *, case when lag(turn) over w = turn - 1 and lag(role) over w = role then 0 else 1 end as fresh from conversations where (conv_id + turn) % 4 <> 1 window w as (partition by conv_id order by turn)),
       y as (select *, sum(fresh) over (partition by conv_id order by turn) as run from x) select conv_id, min(turn) as first, max(turn) as last, min(role) as role from y group by conv_id, run""",
)
def extent_coalesce(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations").where("(conv_id + turn) % 4 <> 1")
    runs = O.runs(c, ["conv_id"], "turn", [F.col("role")], F.lit(1))
    return runs.groupBy("conv_id", "run").agg(F.min("turn").alias("first"), F.max("turn").alias("last"), F.min("role").alias("role")).drop("run")


@register(
    "bin_pack",
    """with recursive r as (select o_custkey, o_orderkey, floor(o_totalprice)::bigint as s, row_number() over (partition by o_custkey order by o_orderkey) as n from orders),
       f as (select o_custkey, o_orderkey, n, s as used, 0::bigint as bin from r where n = 1
             union all select r.o_custkey, r.o_orderkey, r.n, case when f.used > 0 and f.used + r.s > 500000 then r.s else f.used + r.s end, case when f.used > 0 and f.used + r.s > 500000 then f.bin + 1 else f.bin end
             from f join r on r.o_custkey = f.o_custkey and r.n = f.n + 1) select o_custkey, o_orderkey, bin from f""",
)
def bin_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", F.floor("o_totalprice").alias("size"))
    return O.sequential_bins(o, ["o_custkey"], "o_orderkey", "size", 500_000)


@register(
    "sliding_rate",
    f"""select event_id, count(*) over w as in_span, round(sum(value) over w, 4) as amount_in_span from events
       window w as (partition by user_id order by epoch_us(ts) range between {_HALF_DAY} preceding and current row)""",
)
def sliding_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "value", F.expr(_MICROS).alias("at"))
    return O.sliding_rate(e, ["user_id"], "at", _HALF_DAY, F.col("value")).select("event_id", "in_span", F.round("amount_in_span", 4).alias("amount_in_span"))


@register(
    "debounce",
    f"""with recursive e as (select user_id, event_id, epoch_us(ts) as t, row_number() over (partition by user_id order by ts, event_id) as n from events),
       f as (select user_id, event_id, n, t as last, true as kept from e where n = 1
             union all select e.user_id, e.event_id, e.n, case when e.t - f.last >= {_HALF_DAY} then e.t else f.last end, e.t - f.last >= {_HALF_DAY} from f join e on e.user_id = f.user_id and e.n = f.n + 1)
       select user_id, event_id from f where kept""",
)
def debounce(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("user_id", "event_id", F.expr(_MICROS).alias("at"))
    return O.debounced(e, ["user_id"], "at", _HALF_DAY, "event_id")


@register("hash_md5", "select doc_id, md5(text) as hash from documents")
def hash_md5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", digests.digest(F.encode("text", "UTF-8"), "md5").alias("hash"))


@register("hash_sha1", "select doc_id, sha1(text) as hash from documents")
def hash_sha1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", digests.digest(F.encode("text", "UTF-8"), "sha1").alias("hash"))


@register("hash_sha256", "select doc_id, sha256(text) as hash from documents")
def hash_sha256(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", digests.digest(F.encode("text", "UTF-8"), "sha256").alias("hash"))


@register("hash_crc32")
def hash_crc32(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DuckDB has no crc32: checked against zlib in the tests."""
    return table(spark, sf_dir, "documents").select("doc_id", digests.digest(F.encode("text", "UTF-8"), "crc32").alias("hash"))


@register("prefix_digest", "select event_id, sha256(substr(event_type || props, 1, 8)) as hash from events")
def prefix_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", digests.prefix_digest(F.encode(F.concat("event_type", "props"), "UTF-8"), 8).alias("hash"))


@register(
    "block_hash_tree",
    """with b as (select event_id, i, sha256(rpad(substr(x, (i * 16 + 1)::bigint, 16), 16, chr(0))) as leaf from (select event_id, props || event_type || event_type || event_type as x from events) t, unnest(range((length(x) + 15) // 16)) u(i))
       select event_id, count(*) as leaves, min(leaf) filter (i = 0) as first_leaf, sha256(from_hex(string_agg(leaf, '' order by i))) as root from b group by event_id""",
)
def block_hash_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    data = F.encode(F.concat("props", "event_type", "event_type", "event_type"), "UTF-8")
    e = table(spark, sf_dir, "events").select("event_id", digests.block_hashes(data, 16).alias("leaves"))
    return e.select("event_id", F.size("leaves").cast("bigint").alias("leaves"), F.get("leaves", F.lit(0)).alias("first_leaf"), digests.hash_tree_root(F.col("leaves")).alias("root"))


@register(
    "chunk_explode",
    "select event_id, i as block_no, i * 8 as \"offset\", substr(x, (i * 8 + 1)::bigint, 8) as piece from (select event_id, event_type || props as x from events) t, unnest(range((length(x) + 7) // 8)) u(i)",
)
def chunk_explode(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("event_id", F.encode(F.concat("event_type", "props"), "UTF-8").alias("x"))
    return B.chunks(e, "event_id", "x", 8).select("event_id", "block_no", "offset", F.decode("bytes", "UTF-8").alias("piece"))


@register("block_round_trip", "select p_partkey, (length(p_name || p_type) + 15) // 16 as blocks, length(p_name || p_type) as size, sha256(p_name || p_type) as hash, (length(p_name || p_type) + 15) // 16 as sound from part")
def block_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cut, compress, decompress, put together: how many blocks there are, how many of them are sound, and the digest of what comes back."""
    p = table(spark, sf_dir, "part").select("p_partkey", F.encode(F.concat("p_name", "p_type"), "UTF-8").alias("x"))
    back = B.decompressed(B.compressed(B.chunks(p, "p_partkey", "x", 16)).drop("bytes"))
    whole = back.groupBy("p_partkey").agg(F.count("*").alias("blocks"), F.count_if("ok").alias("sound"), F.array_sort(F.collect_list(F.struct("block_no", F.hex("bytes").alias("h")))).alias("b"))
    after = F.unhex(F.array_join(F.transform("b", lambda x: x["h"]), ""))
    return whole.select("p_partkey", "blocks", F.octet_length(after).cast("bigint").alias("size"), F.sha2(after, 256).alias("hash"), "sound")


@register("read_ranges", "select p_partkey, substr(p_name || p_type, 4, 15) as piece from part where length(p_name || p_type) > 3")
def read_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").select("p_partkey", F.encode(F.concat("p_name", "p_type"), "UTF-8").alias("x"))
    reads = p.select("p_partkey", F.lit(0).alias("read_no"), F.lit(3).cast("bigint").alias("v_start"), F.lit(18).cast("bigint").alias("v_end"))
    return B.read_ranges(reads, B.chunks(p, "p_partkey", "x", 7), "p_partkey", 7).select("p_partkey", F.decode("bytes", "UTF-8").alias("piece"))


@register("delta_segments", "select doc_id, md5(unhex(substr(h, 1, 10) || '44454C5441' || substr(h, 21, 40))) as hash from (select doc_id, hex(encode(text[:40])) as h from documents)")
def delta_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", F.encode("text", "UTF-8").alias("bytes"))
    plan = F.array(*[F.struct(F.lit(n).alias("nth"), F.lit(s).alias("src"), F.lit(a).alias("at"), F.lit(k).alias("size"), F.lit(b).alias("bytes")) for n, s, a, k, b in ((0, "base", 0, 5, None), (1, "delta", 0, 5, b"DELTA"), (2, "base", 10, 20, None))])
    return B.delta_applied(d.select("doc_id", F.explode(plan).alias("s")).select("doc_id", "s.*"), d, "doc_id").select("doc_id", F.md5("bytes").alias("hash"))


@register(
    "link_extract",
    """with x as (select page_id, unnest(regexp_extract_all(html, '(?i)\\b(?:href|data-url)="([^"]+)"', 1)) as url, generate_subscripts(regexp_extract_all(html, '(?i)\\b(?:href|data-url)="([^"]+)"', 1), 1) as pos from pages),
       y as (select page_id, arg_min(url, pos) as url, min(pos) as pos from x group by page_id, lower(url)) select page_id, row_number() over (partition by page_id order by pos) as nth, url from y""",
)
def link_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.links(table(spark, sf_dir, "pages"))


@register(
    "blended_rate",
    f"""with x as (select event_id, user_id, epoch_us(ts) as t, sum(100) over (partition by user_id order by ts, event_id rows unbounded preceding) as done from events),
       y as (select *, first_value(t) over n as a1, first_value(done) over n as d1, first_value(t) over w as a0, first_value(done) over w as d0 from x
             window w as (partition by user_id order by t, event_id), n as (partition by user_id order by t range between {_HALF_DAY} preceding and current row))
       select event_id, round(coalesce(((done - d1) * 1e6 / nullif(t - a1, 0) + (done - d0) * 1e6 / nullif(t - a0, 0)) / 2, (done - d1) * 1e6 / nullif(t - a1, 0), (done - d0) * 1e6 / nullif(t - a0, 0), 0), 9) as rate from y""",
)
def blended_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    e = table(spark, sf_dir, "events").select("event_id", "user_id", F.expr(_MICROS).alias("at"), F.lit(10**6).alias("total"))
    w = Window.partitionBy("user_id").orderBy("at", "event_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return O.blended_rate(e.withColumn("done", F.sum(F.lit(100)).over(w)), ["user_id"], "at", "done", "total", _HALF_DAY).select("event_id", F.round("rate", 9).alias("rate"))


@register(
    "byte_integers",
    "select event_id, ascii(x[1]) + 256 * ascii(x[2]) + 65536 * ascii(x[3]) as little, ascii(x[1]) * 65536 + 256 * ascii(x[2]) + ascii(x[3]) as big from (select event_id, event_type as x from events)",
)
def byte_integers(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..functions.numbers import big_endian, little_endian

    data = F.encode("event_type", "UTF-8")
    return table(spark, sf_dir, "events").select("event_id", little_endian(data, 0, 3).alias("little"), big_endian(data, 0, 3).alias("big"))


@register(
    "anchor_names",
    """with x as (select page_id, unnest(regexp_extract_all(html, '(?is)<a\\b[^>]*\\bhref="[^"]*"[^>]*>.*?</a>')) as a, generate_subscripts(regexp_extract_all(html, '(?is)<a\\b[^>]*\\bhref="[^"]*"[^>]*>.*?</a>'), 1) as nth from pages)
       select page_id, nth, regexp_extract(a, '(?i)\\bhref="([^"]*)"', 1) as url,
       trim(replace(replace(replace(replace(replace(replace(replace(regexp_replace(regexp_replace(a, '(?s)<[^>]*>', ' ', 'g'), '\\s+', ' ', 'g'), '&nbsp;', ' '), '&quot;', '"'), '&#39;', ''''), '&apos;', ''''), '&lt;', '<'), '&gt;', '>'), '&amp;', '&')) as name from x""",
)
def anchor_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.anchors(table(spark, sf_dir, "pages"))
