"""Joins that pair sources with patches, prefer exact matches, or look up what lies before a position."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .catalog import first_by


def pair_full(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Full outer pairing on a key, of texts whatever their case: status both, left (only) or right (only)."""
    a = left.withColumnRenamed(key, "_l")
    b = right.withColumnRenamed(key, "_r")
    status = F.when(F.col("_r").isNull(), "left").when(F.col("_l").isNull(), "right").otherwise("both")
    same = [F.upper(c) if left.schema[key].dataType.simpleString() == "string" else F.col(c) for c in ("_l", "_r")]
    return a.join(b, same[0] == same[1], "full").withColumn("status", status).withColumn(key, F.coalesce("_l", "_r")).drop("_l", "_r")


def unmatched(df: DataFrame, used: DataFrame, keys: list[str]) -> DataFrame:
    return df.join(used, keys, "left_anti")


def allowed_or_blank(df: DataFrame, allowed: DataFrame, key: str) -> DataFrame:
    """Rows whose key is allowed, and rows whose key is null or blank."""
    blank = F.col(key).isNull() | (F.trim(F.col(key).cast("string")) == "")
    return df.where(~blank).join(allowed.select(key).distinct(), key, "left_semi").unionByName(df.where(blank))


def union_lookup(base: DataFrame, update: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Every key of either side with the base's value, or else the update's."""
    joined = base.select(*keys, F.col(value).alias("_b")).join(update.select(*keys, F.col(value).alias("_u")), keys, "full")
    return joined.select(*keys, F.coalesce("_b", "_u").alias(value), F.when(F.col("_b").isNull(), "update").when(F.col("_u").isNull(), "base").otherwise("both").alias("side"))


def exact_else_contains(names: DataFrame, targets: DataFrame, name: str, target: str, grams: int = 12) -> DataFrame:
    """Rows (name, target, how): the targets equal to a name or, if there are none, those that the name contains.

    The containment join goes by hashes of short pieces: a target's first ``grams`` bytes against all pieces
    of a name, so candidates meet by equality and no name is held against all targets; what meets is held
    against the whole target.  Targets shorter than a piece are joined by their own lengths.  Both columns hold different values; empty targets match nothing.
    """
    n = names.select(name).where(F.col(name).isNotNull()).distinct()
    t = targets.select(target).where(F.length(target) > 0).distinct()
    exact = n.join(t, F.col(name) == F.col(target)).withColumn("how", F.lit("exact"))
    rest = n.join(exact.select(name), name, "left_anti")
    return exact.unionByName(contained(rest, t, name, target, grams).withColumn("how", F.lit("contains")))


def contained(names: DataFrame, targets: DataFrame, name: str, target: str, grams: int = 12) -> DataFrame:
    """(name, target) for all targets that a name contains, itself included, by the hashes of ``exact_else_contains``."""
    rest = names.select(name).where(F.col(name).isNotNull()).distinct().withColumn("_id", F.md5(name))
    t = targets.select(target).where(F.length(target) > 0).distinct()
    begins = t.withColumn("_k", F.least(F.octet_length(target), F.lit(grams)))
    begins = begins.withColumn("_p", F.expr(f"xxhash64(substring(encode(`{target}`, 'UTF-8'), 1, _k))"))
    lengths = [r[0] for r in begins.select("_k").distinct().collect()]  # grams values at most

    def pieces_of(k: int) -> DataFrame:
        """(_id, _p) of each place of a name; places are rows of short stretches, whose hashes are compiled code."""
        stretch = lambda data: F.transform(F.sequence(F.lit(0), F.greatest(F.octet_length(data) - k, F.lit(0)).bitwiseAND(F.lit(-64)), F.lit(64)), lambda i: F.substring(data, i + 1, F.lit(63 + k)))
        cut_up = rest.select("_id", F.explode(F.transform(F.array(F.encode(name, "UTF-8")), stretch)[0]).alias("_d"))  # the bytes are bound once
        places = cut_up.select("_id", "_d", F.explode(F.sequence(F.lit(1), F.greatest(F.octet_length("_d") - (k - 1), F.lit(1)))).alias("_i"))
        return places.select("_id", F.xxhash64(F.substring("_d", F.col("_i"), F.lit(k))).alias("_p"))

    out = rest.limit(0).select(name, F.lit("").alias(target)) if not lengths else None
    for k in lengths:
        # a piece travels with its name's digest; the name itself comes back only for what has met a target
        met = pieces_of(k).join(begins.where(F.col("_k") == k), "_p").select("_id", target).distinct()
        found = met.join(rest, "_id").where(F.contains(name, target)).select(name, target)
        out = found if out is None else out.unionByName(found)
    return out


def passages_in(texts: DataFrame, passages: DataFrame, ident: str, text: str, passage_id: str, passage: str) -> DataFrame:
    """(ident, passage_id): which passages each text contains, to the letter, itself included where they are equal.

    A passage of five words or more has three whole ones behind its first space, which a text that contains it
    has too: they meet by a hash of three words, and what meets is held against the whole passage.  Texts are
    cut at spaces once.  Shorter passages, which are names more than passages, meet by hashes of bytes.
    """
    parts = passages.select(passage_id, F.col(passage).alias("_passage"), F.split(passage, " ").alias("_w")).where(F.length(passage) > 0)
    worded = parts.where(F.size("_w") >= 5).select(passage_id, "_passage", F.xxhash64(F.slice("_w", 2, 3)).alias("_p"))

    def triples(w: Column) -> Column:
        return F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.size(w) - 2, F.lit(1))), lambda i: F.xxhash64(F.slice(w, i, 3))))

    pieces = texts.select(ident, F.explode(F.transform(F.array(F.split(text, " ")), triples)[0]).alias("_p"))
    met = pieces.join(worded.drop("_passage"), "_p").select(ident, passage_id).distinct()
    long = met.join(texts.select(ident, F.col(text).alias("_text")), ident).join(worded.drop("_p"), passage_id).where(F.contains("_text", "_passage")).select(ident, passage_id)
    few = parts.where(F.size("_w") < 5).select(passage_id, "_passage")
    if few.isEmpty():
        return long
    named = contained(texts.select(text), few, text, "_passage")
    return long.unionByName(named.join(texts.select(ident, text), text).join(few, "_passage").select(ident, passage_id)).distinct()


def in_folder(named: DataFrame, there: DataFrame, name: str, file: str, folder: str) -> DataFrame:
    """Names of a folder with the first file there that has the name, whatever its case (null columns without one)."""
    first = first_by(there.withColumn("_k", F.upper(file)), ["_k", folder], [F.col(file)])
    return named.withColumn("_k", F.upper(name)).join(first, ["_k", folder], "left").drop("_k")


def by_priority(left: DataFrame, tiers: list[DataFrame], keys: list[str], value: str) -> DataFrame:
    """``left`` with the value of the first tier that knows its key (tiers hold one row a key), and that tier's number."""
    out = left
    for i, tier in enumerate(tiers):
        out = out.join(tier.select(*keys, F.col(value).alias(f"_v{i}")), keys, "left")
    found = [F.col(f"_v{i}") for i in range(len(tiers))]
    number = F.coalesce(*[F.when(v.isNotNull(), F.lit(i)) for i, v in enumerate(found)])
    return out.withColumn(value, F.coalesce(*found)).withColumn("tier", number).drop(*[f"_v{i}" for i in range(len(tiers))])


def containing_extent(points: DataFrame, extents: DataFrame, key: str, at: str, start: str, columns: list[str]) -> DataFrame:
    """``points`` with the columns of the extent of their key that starts last at or before them (null before the first).

    Points and extents are laid in one order and the last extent is carried forward: a sort within the key,
    no pairs.
    """
    marked = extents.select(key, F.col(start).alias("_at"), F.struct(*columns).alias("_extent"), F.lit(0).alias("_point"), F.lit(None).cast(points.select(F.struct("*").alias("x")).schema["x"].dataType).alias("_row"))
    asked = points.select(key, F.col(at).alias("_at"), F.lit(None).cast(marked.schema["_extent"].dataType).alias("_extent"), F.lit(1).alias("_point"), F.struct(*points.columns).alias("_row"))
    seen = Window.partitionBy(key).orderBy("_at", "_point").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    carried = marked.unionByName(asked).withColumn("_found", F.last("_extent", ignorenulls=True).over(seen))
    return carried.where("_point = 1").select("_row.*", *[F.col("_found")[c].alias(c) for c in columns])


def range_overlaps(reads: DataFrame, extents: DataFrame, key: str, block: int) -> DataFrame:
    """Pieces of reads (key, v_start, v_end) that lie in extents (key, e_start, e_end, p_start): (…, from, until, p_from).

    Cells are ``block`` long, or that doubled until a range lies in two of them at most.  A pair meets in the
    cells of the longer one, so a range is a few rows however long it is: two for each size of cell that occurs,
    of which there are 63 at most.  A piece counts in its first cell.
    """
    def level(a: str, b: str) -> Column:
        cells = F.floor((F.col(b) - F.col(a) - 1) / block)
        return F.when(cells == 0, 0).otherwise(F.length(F.bin(cells)))

    asked = reads.where("v_end > v_start").withColumn("_r", level("v_start", "v_end"))
    there = extents.where("e_end > e_start").withColumn("_e", level("e_start", "e_end"))
    sizes = sorted(x[0] for x in asked.select("_r").distinct().union(there.select("_e").distinct()).distinct().collect())

    def cells(df: DataFrame, a: str, b: str, own: str) -> DataFrame:
        levels = F.filter(F.array(*map(F.lit, sizes)), lambda x: x >= F.col(own)) if sizes else F.array().cast("array<int>")
        placed = df.withColumn("_level", F.explode(levels)).withColumn("_cell", _cell(F.col(a)))
        return placed.withColumn("_cell", F.explode(F.array_distinct(F.array("_cell", _cell(F.col(b) - 1)))))

    def _cell(at: Column) -> Column:
        return F.floor(at / (F.lit(block) * F.expr("shiftleft(1L, _level)"))).cast("bigint")

    lo, hi = F.greatest("v_start", "e_start"), F.least("v_end", "e_end")
    joined = cells(asked, "v_start", "v_end", "_r").join(cells(there, "e_start", "e_end", "_e"), [key, "_level", "_cell"]).where((lo < hi) & (F.col("_level") == F.greatest("_r", "_e")))
    once = joined.where(_cell(lo) == F.col("_cell"))
    return once.withColumn("from", lo).withColumn("until", hi).withColumn("p_from", F.col("p_start") + lo - F.col("e_start")).drop("_cell", "_level", "_r", "_e")


def validated(left: DataFrame, right: DataFrame, keys: list[str], holds: Column) -> DataFrame:
    """Equal keys, and then a condition on both rows."""
    return left.join(right, keys).where(holds)


def greedy_pairs(sources: DataFrame, patches: DataFrame, keys: list[str], source_order: str, patch_order: str) -> DataFrame:
    """One-to-one pairs within a key: the n-th source gets the n-th patch, in order (a queue that each source takes from).

    Ranks are windows within a key; a queue of equal stems is short.
    """
    a = sources.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(source_order)))
    b = patches.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(patch_order)))
    return a.join(b, [*keys, "_n"]).drop("_n")


def first_owner(df: DataFrame, items: str, owner: str, order: list[Column]) -> DataFrame:
    """(item, owner): the first row, in order, whose array of items has the item."""
    rows = df.select(F.explode(items).alias("item"), owner, *[o.alias(f"_o{i}") for i, o in enumerate(order)])
    return first_by(rows, ["item"], [F.col(f"_o{i}") for i in range(len(order))]).select("item", owner)


def bucket_fallback(sources: DataFrame, buckets: DataFrame, ext: str, key: str, order: str) -> DataFrame:
    """Sources with the first bucket (by ``order``) whose key contains their extension; a blank extension matches none.

    Extensions and keys are few different texts, so these are what is compared; rows then join by equality.
    """
    kinds = sources.select(ext).where(F.length(ext) > 0).distinct()
    found = exact_else_contains(buckets.select(key), kinds, key, ext, grams=3).join(buckets, key)
    best = found.groupBy(ext).agg(F.min_by(key, F.struct(order, key)).alias(key))
    return sources.join(best, ext, "left")


def unpacked(contents: DataFrame, selector: DataFrame, keys: list[str]) -> DataFrame:
    """Of two copies of each block (copy 0 and 1) the one that a selector row (keys, copy) names; copy 0 without one."""
    chosen = contents.join(selector.withColumnRenamed("copy", "_want"), keys, "left")
    return chosen.where(F.col("copy") == F.coalesce("_want", F.lit(0))).drop("_want", "copy")


def version_sources(versions: DataFrame, base: DataFrame, key: str, before: str) -> DataFrame:
    """(key, source, kind): a version is read from the base if that has it, else it is a delta on the version before, else new."""
    there = base.select(F.col(key).alias("_base")).distinct()
    joined = versions.join(there, F.col(key) == F.col("_base"), "left")
    kind = F.when(F.col("_base").isNotNull(), "base").when(F.col(before).isNotNull(), "delta").otherwise("new")
    return joined.select(key, F.coalesce("_base", before).alias("source"), kind.alias("kind"))
