"""Catalogue flows: roles, folders, sizes, pages, versions, batches of patches, snapshots."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import catalog as C
from ..operators import layers as L
from ..operators import matching as M
from ..operators import ordered as O
from ..operators import patches as P
from ..registry import register
from ..sources import files as S
from ..sources import pages as W
from ..streaming import watch
from . import table


@register(
    "role_groups",
    """select upper(p_type) as base, arg_min(p_name, p_partkey) as name, array_to_string(list(p_partkey order by p_partkey) filter (p_size % 3 = 0), ',') as bases, array_to_string(list(p_partkey order by p_partkey) filter (p_size % 3 = 1), ',') as updates,
       array_to_string(list(p_partkey order by p_partkey) filter (p_size % 3 = 2), ',') as extras from part where p_size > 1 group by upper(p_type)""",
)
def role_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows by base, whatever its case, as three lists by role; rows with a blank base are left out."""
    p = table(spark, sf_dir, "part").withColumn("base", F.when(F.col("p_size") > 1, F.when(F.col("p_partkey") % 2 == 0, F.lower("p_type")).otherwise(F.col("p_type"))).otherwise(" "))
    role = F.element_at(F.array(F.lit("bases"), F.lit("updates"), F.lit("extras")), (F.col("p_size") % 3 + 1).cast("int"))
    groups = C.role_groups(p.withColumn("role", role), "base", "role", ["bases", "updates", "extras"], F.col("p_partkey"), "p_partkey", "p_name")
    lists = [F.nullif(F.array_join(F.col(r).cast("array<string>"), ","), F.lit("")).alias(r) for r in ("bases", "updates", "extras")]
    return groups.select("base", F.col("name"), *lists)


@register("id_sets", "select o_custkey, array_to_string(list(distinct l_partkey order by l_partkey) filter (l_quantity > 25), ',') as ids from orders left join lineitem on l_orderkey = o_orderkey group by o_custkey")
def id_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ids of a group's rows once; null for none."""
    o = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "lineitem"), F.col("l_orderkey") == F.col("o_orderkey"), "left")
    return o.groupBy("o_custkey").agg(C.id_set(F.when(F.col("l_quantity") > 25, F.col("l_partkey"))).alias("ids")).select("o_custkey", F.array_join(F.col("ids").cast("array<string>"), ",").alias("ids"))


@register(
    "group_counts",
    """select l_orderkey, count(*) filter (l_returnflag <> 'R') as good, count(*) filter (l_returnflag = 'R') as bad, min(l_partkey) filter (l_partkey > 50) as least, list_sum(list(l_quantity::bigint * 10))::bigint as size from lineitem group by l_orderkey""",
)
def group_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many rows are good and bad, the least number above a bound, and a fold over an array of sizes."""
    li = table(spark, sf_dir, "lineitem")
    groups = li.groupBy("l_orderkey").agg(F.collect_list(F.struct((F.col("l_quantity").cast("bigint") * 10).alias("size"))).alias("c"), *C.outcomes(F.col("l_returnflag") != "R"), C.least_above(F.col("l_partkey"), 50).alias("least"))
    return groups.select("l_orderkey", F.col("succeeded").alias("good"), F.col("failed").alias("bad"), "least", C.folded_size(F.col("c"), "size").alias("size"))


@register("skip_take", "select conv_id, turn from (select *, row_number() over (partition by conv_id order by turn) as n from conversations) where n > 1 and n <= 3")
def skip_take(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each group the rows behind a header, two at most."""
    return C.skip_take(table(spark, sf_dir, "conversations"), ["conv_id"], [F.col("turn")], 1, 2).select("conv_id", "turn")


@register(
    "version_chains",
    """with p as (select o_custkey, o_orderkey as v, row_number() over (partition by o_custkey order by o_orderkey) as n from orders), x as (select a.v, b.v as before, c.v as second, s.s_suppkey is not null as based from p a left join p b on a.o_custkey = b.o_custkey and b.n = a.n - 1
       left join p c on a.o_custkey = c.o_custkey and c.n = a.n - 2 left join supplier s on s.s_suppkey = a.v)
       select v, coalesce(case when based then v end, before, second) as source, case when based then 'base' when before is not null then 'delta' else 'new' end as kind from x""",
)
def version_chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where each version of an object comes from: the base, the version before it, or nowhere."""
    o = table(spark, sf_dir, "orders")
    w = Window.partitionBy("o_custkey").orderBy("o_orderkey")
    versions = o.select(F.col("o_orderkey").alias("v"), F.lag("o_orderkey").over(w).alias("before"))
    return M.version_sources(versions, table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("v")), "v", "before")


@register(
    "unpacked_titles",
    "select p_partkey, p_partkey - min(p_partkey) over () as nth, p_type as part from part where p_partkey % 4 <> 0",
)
def unpacked_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Folders named by 16 hex digits: how far each id is from the least, and the folder within."""
    digits = F.lpad(F.hex("p_partkey"), 16, "0")
    path = F.concat(F.lit("out/"), F.when(F.col("p_partkey") % 4 == 0, F.concat(F.lit("x"), digits)).otherwise(digits), F.lit("/"), F.col("p_type"))
    found = S.titles_by_folder(table(spark, sf_dir, "part").select(path.alias("path")), "path")
    return found.select(F.conv("ident", 16, 10).cast("bigint").alias("p_partkey"), "nth", "part")


@register(
    "descriptor_sizes",
    """select o_custkey as id, length(text) + coalesce(sum(p_size), 0)::bigint as size from (select o_custkey, string_agg('FILE "' || o_orderkey::varchar || '.bin" BINARY', chr(10) order by o_orderkey) as text, list(o_orderkey) as k from orders group by o_custkey)
       left join part on list_contains(k, p_partkey) group by o_custkey, text""",
)
def descriptor_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sheet's own size and that of the files it names that are there."""
    o = table(spark, sf_dir, "orders")
    each = F.struct("o_orderkey", F.concat(F.lit('FILE "'), F.col("o_orderkey").cast("string"), F.lit('.bin" BINARY')).alias("l"))
    sheets = o.groupBy(F.col("o_custkey").alias("id")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(each)), lambda x: x["l"]), "\n").alias("text")).withColumn("folder", F.lit("d"))
    there = table(spark, sf_dir, "part").select(F.lit("d").alias("folder"), F.concat(F.col("p_partkey").cast("string"), F.lit(".bin")).alias("name"), F.col("p_size").cast("bigint").alias("size"))
    return S.descriptor_sizes(sheets, there, "id").select("id", "size")


@register("folder_tree", "select distinct 'd' || (p_partkey % 10)::varchar as path, null::varchar as parent from part union select distinct 'd' || (p_partkey % 10)::varchar || '/' || p_type, 'd' || (p_partkey % 10)::varchar from part")
def folder_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.concat_ws("/", F.concat(F.lit("d"), (F.col("p_partkey") % 10).cast("string")), "p_type", F.concat("p_name", F.lit(".bin")))
    return S.directories(table(spark, sf_dir, "part").select(path.alias("path")))


@register("scoped_entries", "select p_partkey, p_name || '.bin' as entry from part where p_type = 'ECONOMY'")
def scoped_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.concat_ws("/", "p_type", F.concat("p_name", F.lit(".bin")))
    return S.scoped(table(spark, sf_dir, "part").select("p_partkey", path.alias("entry")), "ECONOMY/")


@register(
    "path_lookup",
    """with recursive t as (select n_nationkey as k, n_name as path from nation where n_nationkey < 5 union all select n.n_nationkey, t.path || '/' || n.n_name from nation n join t on t.k = n.n_nationkey // 2 and n.n_nationkey >= 5)
       select path, k from t where path like '%/%'""",
)
def path_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes found by their whole path in a tree of parents."""
    n = table(spark, sf_dir, "nation")
    nodes = n.select(F.col("n_nationkey").cast("bigint").alias("k"), F.when(F.col("n_nationkey") >= 5, F.expr("n_nationkey div 2")).alias("parent"), F.col("n_name").alias("name"))
    paths = O.tree_paths(nodes, "k", "parent", "name")
    return paths.join(paths.select("path").where(F.contains("path", F.lit("/"))), "path").select("path", F.col("k").cast("int").alias("k"))


@register(
    "path_table",
    """with recursive t as (select n_nationkey as k, -1 as parent, n_name as path, n_name as name, 0 as level from nation where n_nationkey < 5
       union all select n.n_nationkey, t.k, t.path || '/' || n.n_name, n.n_name, t.level + 1 from nation n join t on t.k = n.n_nationkey // 2 and n.n_nationkey >= 5),
       u as (select *, row_number() over (order by level, rank_path) as number from (select *, path as rank_path from t))
       select k, number, coalesce((select number from u p where p.k = u.parent), 0) as parent_number from u""",
)
def path_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Folders numbered level by level, in order of their parents and names, each with its parent's number."""
    n = table(spark, sf_dir, "nation")
    nodes = n.select(F.col("n_nationkey").cast("bigint").alias("k"), F.when(F.col("n_nationkey") >= 5, F.expr("n_nationkey div 2")).alias("parent"), F.col("n_name").alias("name"))
    return O.path_table(nodes, "k", "parent", "name").select(F.col("k").cast("int").alias("k"), "number", "parent_number")


@register("lower_bounds", "select c_custkey, c_name from customer where c_name >= 'Customer#000000100'")
def lower_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.lower_bound(table(spark, sf_dir, "customer"), "c_name", "Customer#000000100").select("c_custkey", "c_name")


@register(
    "published_ids",
    "select o_orderkey, c_nationkey, coalesce(m, 0) + row_number() over (partition by c_nationkey order by o_orderkey) as ident from orders join customer on c_custkey = o_custkey left join (select s_nationkey, max(s_suppkey) as m from supplier group by s_nationkey) on s_nationkey = c_nationkey",
)
def published_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """New rows numbered on from the greatest id that each key has."""
    old = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("c_nationkey"), F.col("s_suppkey").alias("ident"))
    new = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("c_custkey") == F.col("o_custkey")).select("o_orderkey", "c_nationkey")
    return L.published(old, new, "ident", [F.col("o_orderkey")], ["c_nationkey"])


@register(
    "rolled_back",
    "select k, v from (select o_custkey as k, o_totalprice as v, row_number() over (partition by o_custkey order by o_orderkey desc) as n from orders where o_orderkey < 1000) where n = 1",
)
def rolled_back(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An index as it was at a commit: what came later is as if it had not been."""
    log = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k"), F.col("o_totalprice").alias("v"), F.col("o_orderkey").alias("seq"), F.lit(False).alias("deleted"))
    return L.as_of(log, 999, "k", "seq").select("k", "v")


@register(
    "committed_copies",
    "select p_partkey as k, (1 - p_size % 2)::int as selected, case when p_size % 2 = 0 then p_type else p_name end as v from part",
)
def committed_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks in two copies: what was written goes to the copy that is not selected, and a commit turns the selection."""
    p = table(spark, sf_dir, "part")
    copies = p.select(F.col("p_partkey").alias("k"), F.lit(0).alias("copy"), F.col("p_name").alias("v")).union(p.select("p_partkey", F.lit(1), "p_brand"))
    selector = p.select(F.col("p_partkey").alias("k"), F.lit(0).alias("copy"))
    written = p.where("p_size % 2 = 0").select(F.col("p_partkey").alias("k"), F.col("p_type").alias("v"))
    blocks, chosen = L.committed(copies, selector, written, ["k"])
    now = M.unpacked(blocks, chosen, ["k"])
    return now.join(chosen, "k").select("k", F.col("copy").alias("selected"), "v")


@register(
    "allocated_blocks",
    "select o_custkey as owner, o_orderkey as block, lag(o_orderkey) over (partition by o_custkey order by o_orderkey) as before from orders where o_orderstatus <> 'F'",
)
def allocated_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Free blocks handed out to owners as chains, each block with the one before it."""
    o = table(spark, sf_dir, "orders")
    free = o.where("o_orderstatus <> 'F'").select(F.col("o_custkey").alias("owner"), F.col("o_orderkey").alias("block"))
    from ..operators import chains

    return chains.linked(free, "owner", "block")


@register(
    "batch_targets",
    """select p_partkey, case when p_partkey % 3 = 0 then 'overwrite' else 'patch' end as kind, case when p_partkey % 3 = 0 then p_type || '/' || p_partkey::varchar || '.bin' when p_size % 2 = 0 then p_type || '/' || p_partkey::varchar || '.dat' when p_size % 5 = 0 then 'other/' || p_partkey::varchar || '.dat' end as target from part""",
)
def batch_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a folder of patches does: files that take a place, patches with the file they are for (in their folder, or anywhere)."""
    p = table(spark, sf_dir, "part")
    k = F.col("p_partkey").cast("string")
    patches = p.select("p_partkey", F.concat(F.col("p_type"), F.lit("/"), k, F.when(F.col("p_partkey") % 3 == 0, ".bin").otherwise(".ips")).alias("path"))
    here = p.where("p_size % 2 = 0").select(F.concat(F.col("p_type"), F.lit("/"), k, F.lit(".dat")).alias("path"))
    there = p.where("p_size % 2 = 1 and p_size % 5 = 0").select(F.concat(F.lit("other/"), k, F.lit(".dat")).alias("path"))
    return P.batch_targets(patches, here.unionByName(there), "path").select("p_partkey", "kind", "target")


@register(
    "snapshot_changes",
    "select coalesce(a.k, b.k) as k, case when a.k is null then 'added' when b.k is null then 'removed' else 'changed' end as change from (select p_partkey as k, p_name as v from part where p_size > 10) a full outer join (select p_partkey as k, case when p_size % 7 = 0 then p_brand else p_name end as v from part where p_size < 40) b on a.k = b.k where a.k is null or b.k is null or a.v <> b.v",
)
def snapshot_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    before = p.where("p_size > 10").select(F.col("p_partkey").alias("k"), F.col("p_name").alias("v"))
    after = p.where("p_size < 40").select(F.col("p_partkey").alias("k"), F.when(F.col("p_size") % 7 == 0, F.col("p_brand")).otherwise(F.col("p_name")).alias("v"))
    return watch.changes(before, after, ["k"])


@register("url_names", r"select page_id, case when url_decode(regexp_extract(regexp_replace(url, '[?#].*$', ''), '([^/]*)$', 1)) = '' then '' else url_decode(regexp_extract(regexp_replace(url, '[?#].*$', ''), '([^/]*)$', 1)) end as name from pages")
def url_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", W.file_name(F.col("url")).alias("name"))


_LINKS = """(with x as (select page_id, unnest(regexp_extract_all(html, '(?i)\\b(?:href|data-url)="([^"]+)"', 1)) as url, generate_subscripts(regexp_extract_all(html, '(?i)\\b(?:href|data-url)="([^"]+)"', 1), 1) as pos from pages)
       select page_id, arg_min(url, pos) as url, min(pos) as pos from x group by page_id, lower(url))"""


@register(
    "attachments",
    f"""select page_id, url, case when regexp_matches(url, '(?i)\\.(zip|iso|7z)([?#].*)?$') then 2 when contains(url, '.example.') then 1 else 0 end as score from {_LINKS}
       where not regexp_matches(url, '(?i)^(javascript|mailto|tel):') and url <> '#' and (contains(url, 'attachment') or regexp_matches(url, '(?i)^[^?#]*\\.(iso|zip)([?#].*)?$') or (contains(url, 'example.org') and not ends_with(url, '.html') and not ends_with(url, '/')))""",
)
def attachments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links that lead to files, by words, extensions and hosts, with the score by which they are ordered."""
    found = W.links(table(spark, sf_dir, "pages")).where(W.is_attachment(F.col("url"), words=["attachment"], extensions=["iso", "zip"], hosts=["example.org"]))
    score = F.when(F.col("url").rlike(r"(?i)\.(zip|iso|7z)([?#].*)?$"), 2).when(F.contains("url", F.lit(".example.")), 1).otherwise(0)
    return found.select("page_id", "url", score.alias("score"))


@register(
    "content_part",
    "select p_partkey, case when p_partkey % 2 = 0 then '<b>' || p_name || '</b><div>in</div>' else '<p>' || p_name || '</p>' end as body from part",
)
def content_part(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The element of a page that has two classes, whatever is nested in it; the whole page without one."""
    inner = F.concat(F.lit("<b>"), F.col("p_name"), F.lit("</b><div>in</div>"))
    html = F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit('<div id="x"><div class="post main wide">'), inner, F.lit("</div></div><div>after</div>"))).otherwise(F.concat(F.lit("<p>"), F.col("p_name"), F.lit("</p>")))
    return W.content_part(table(spark, sf_dir, "part").select("p_partkey", html.alias("html")), ["main", "post"], "p_partkey", "html")


@register(
    "link_titles",
    """select p_partkey, case p_partkey % 4 when 0 then p_name when 1 then p_name || ' & co' when 2 then 'T' || p_brand else null end as name, case when p_partkey % 4 = 0 then p_size * 1048576 end as size from part""",
)
def link_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a link is called, and how large its file is said to be, by the texts in and around it."""
    n = (F.col("p_partkey") % 4 + 1).cast("int")
    around = F.element_at(F.array(F.concat(F.lit("["), F.col("p_name"), F.lit("] - "), F.col("p_size").cast("string"), F.lit(" MB down")), F.concat(F.col("p_name"), F.lit(" &amp; co (12)")), F.lit("http://x"), F.lit(" ")), n)
    title = F.when(F.col("p_partkey") % 4 == 2, F.concat(F.lit("T"), F.col("p_brand")))
    text = F.element_at(F.array(F.lit("down"), F.concat(F.col("p_name"), F.lit(" &#38; co (12)")), F.lit("http://x"), F.lit(" ")), n)
    rows = table(spark, sf_dir, "part").select("p_partkey", text.alias("text"), around.alias("around"), title.alias("title"))
    return rows.select("p_partkey", *W.link_title(F.col("text"), F.col("around"), F.col("title")))


@register("entities_decoded", "select p_partkey, p_name || chr(228) || chr(8364) || '<' || chr(65) as text from part")
def entities_decoded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", W.decoded(F.concat("p_name", F.lit("&#228;&#x20AC;&lt;&#65;"))).alias("text"))


@register("json_first", "select event_type as id, arg_min(event_id, event_id) as event_id from events group by event_type")
def json_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table of JSON lines, written in order and read with the first line of each key."""
    import uuid

    from ..session import shared

    path = f"{shared(spark)}/json-{uuid.uuid4().hex}"
    table(spark, sf_dir, "events").select(F.col("event_type").alias("id"), "event_id").repartitionByRange(2, "event_id").sortWithinPartitions("event_id").write.json(path)
    return S.json_table(spark, path, "id string, event_id long", "id")


@register("rule_bins", """select doc_id, rule, bin from (with r as (select doc_id, n_chars, case when doc_id % 10 >= 7 then 'late' when doc_id % 2 = 0 then 'even' else 'odd' end as rule from documents),
    b as (select *, sum(n_chars) over (partition by rule order by doc_id) as upto from r) select doc_id, rule, ((upto - n_chars) // 100000)::bigint as bin from b)""")
def rule_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files by the last rule that their whole name matches, and the stretch of 100,000 that each begins in."""
    name = F.concat(F.lit("f"), F.col("doc_id").cast("string"))
    d = table(spark, sf_dir, "documents").select("doc_id", "n_chars", name.alias("name"))
    rule = C.last_regex_rule("name", [("f[0-9]*[13579]", "odd"), ("f[0-9]*[02468]", "even"), ("f[0-9]*[789]", "late")])
    placed = O.spread_sums(d.withColumn("rule", rule), ["rule"], [F.col("doc_id")], F.col("n_chars"), "upto")
    return placed.select("doc_id", "rule", F.floor((F.col("upto") - F.col("n_chars")) / 100000).cast("bigint").alias("bin"))


@register(
    "title_tickets",
    "select p_partkey, count(l_orderkey) as tickets from part left join (select distinct l_orderkey, l_partkey from lineitem) on l_partkey = p_partkey group by p_partkey",
)
def title_tickets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files whose names contain a title's id, counted for each title."""
    ident = F.md5(F.col("k").cast("string"))
    titles = table(spark, sf_dir, "part").select("p_partkey", F.col("p_partkey").alias("k")).select("p_partkey", ident.alias("ident"))
    files = table(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_partkey").alias("k")).distinct().select(F.concat(F.lit("x"), F.col("l_orderkey").cast("string"), F.lit("-"), ident, F.lit(".tik")).alias("file"))
    found = M.contained(files, titles.select("ident"), "file", "ident", grams=16).groupBy("ident").agg(F.count("*").alias("tickets"))
    return titles.join(found, "ident", "left").select("p_partkey", F.coalesce("tickets", F.lit(0)).alias("tickets"))


@register(
    "batch_applied",
    """select p_type || '/' || p_partkey::varchar || '.dat' as path, case p_partkey % 4 when 0 then 'kept' when 1 then 'overwritten' when 2 then 'patched' else 'failed' end as how,
       md5(case p_partkey % 4 when 1 then p_brand when 2 then p_name || p_brand else p_name end) as hash from part union all select 'new/' || p_partkey::varchar || '.txt', 'new', md5(p_type) from part where p_partkey % 8 = 0""",
)
def batch_applied(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tree of files after a folder of replacements and patches, one in four of which is broken."""
    p = table(spark, sf_dir, "part")
    k, b = F.col("p_partkey"), lambda *c: F.encode(F.concat(*c), "UTF-8")
    stem = F.concat(F.col("p_type"), F.lit("/"), k.cast("string"))
    files = p.select(F.concat(stem, F.lit(".dat")).alias("path"), b("p_name").alias("content"))
    made = P.created(p.where("p_partkey % 4 = 2").select("p_partkey", "p_type", b("p_name").alias("source"), b("p_name", "p_brand").alias("target")), "p_partkey", "ips", keep=("p_type",))
    patches = made.select(F.concat(stem, F.lit(".ips")).alias("path"), F.col("patch").alias("content"))
    broken = p.where("p_partkey % 4 = 3").select(F.concat(stem, F.lit(".bps")).alias("path"), F.lit(b"BPS1 no patch at all").alias("content"))
    over = p.where("p_partkey % 4 = 1").select(F.concat(stem, F.lit(".dat")).alias("path"), b("p_brand").alias("content"))
    new = p.where("p_partkey % 8 = 0").select(F.concat(F.lit("new/"), k.cast("string"), F.lit(".txt")).alias("path"), b("p_type").alias("content"))
    done = P.batch_applied(files, patches.unionByName(broken).unionByName(over).unionByName(new))
    return done.select("path", "how", F.md5("content").alias("hash"))


@register(
    "disc_relayout",
    """with recursive e as (select p_type || '/f' || p_partkey::varchar as path, p_type as folder, false as is_dir, case when p_partkey in (select s_suppkey from supplier) then 10 else p_size * 300 end as size, 'f' || p_partkey::varchar as name from part),
       d as (select distinct folder as path, '' as folder, true as is_dir, 0 as size, folder as name from e), a as (select * from e union all select * from d),
       r as (select folder, '2' || name as name, 33 + length(name) + (33 + length(name)) % 2 as size from a union all select path, x, 34 from (select path from d union all select '') t, (values ('0'), ('1')) v(x)),
       o as (select folder, size, row_number() over (partition by folder order by name) as n from r),
       f as (select folder, n, size as used, 0 as bin from o where n = 1 union all select o.folder, o.n, case when f.used + o.size > 2048 then o.size else f.used + o.size end, case when f.used + o.size > 2048 then f.bin + 1 else f.bin end from f join o on o.folder = f.folder and o.n = f.n + 1),
       s as (select folder as path, true as is_dir, (max(bin) + 1)::bigint as sectors from f group by folder union all select path, false, (size + 2047) // 2048 from e)
       select path, is_dir, sectors::bigint as sectors, (18 + sum(sectors) over (order by is_dir desc, path) - sectors)::bigint as lba from s""",
)
def disc_relayout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A disc's files, some of them replaced by others, laid out anew."""
    from ..operators import containers as K

    p = table(spark, sf_dir, "part")
    path = F.concat(F.col("p_type"), F.lit("/f"), F.col("p_partkey").cast("string"))
    old = p.select(path.alias("path"), F.lit(False).alias("is_dir"), (F.col("p_size") * 300).cast("bigint").alias("size"))
    new = p.join(table(spark, sf_dir, "supplier"), F.col("s_suppkey") == F.col("p_partkey")).select(path.alias("path"), F.lit(False).alias("is_dir"), F.lit(10).cast("bigint").alias("size"))
    files = L.merged(old, new, ["path"], F.lit(False))
    folders = p.select(F.col("p_type").alias("path"), F.lit(True).alias("is_dir"), F.lit(0).cast("bigint").alias("size")).distinct()
    return K.disc_layout(files.unionByName(folders))
