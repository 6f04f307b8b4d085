"""Filters, classification, picking and counting over catalogue rows.

Order is part of the meaning here: "first" and "last" always go by explicit columns, ties included.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def of_kinds(df: DataFrame, column: str, kinds: list[str]) -> DataFrame:
    """Rows whose column is one of ``kinds``, whatever the case."""
    return df.where(F.lower(column).isin([k.lower() for k in kinds]))


def search(df: DataFrame, text: str | None, columns: list[str]) -> DataFrame:
    """Rows that have ``text`` in one of the columns, whatever the case; all rows for null or blank."""
    if not text or not text.strip():
        return df
    return df.where(reduce(Column.__or__, [F.coalesce(F.contains(F.lower(c), F.lit(text.strip().lower())), F.lit(False)) for c in columns]))


def optional_filter(df: DataFrame, **wanted) -> DataFrame:
    """Rows that equal every value that is not None."""
    return reduce(lambda d, kv: d if kv[1] is None else d.where(F.col(kv[0]) == F.lit(kv[1])), wanted.items(), df)


def first_rule(rules: list[tuple[Column, str]], otherwise: str | None = None) -> Column:
    """The label of the first rule that holds."""
    chain = F.when(*[rules[0][0], F.lit(rules[0][1])])
    for condition, label in rules[1:]:
        chain = chain.when(condition, F.lit(label))
    return chain.otherwise(F.lit(otherwise))


def least_tier(df: DataFrame, keys: list[str], tier: Column) -> DataFrame:
    """Of each group the rows of its least tier (a cascade: later tiers count only where earlier ones are empty)."""
    best = df.groupBy(*keys).agg(F.min(tier).alias("_best"))
    return df.join(best, keys).where(tier == F.col("_best")).withColumnRenamed("_best", "tier")


def first_by(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row of each group, the first in ``order``; partial aggregation before the shuffle, so hot groups are no burden.

    ``order`` must tell all rows of a group apart, or equal rows stand for each other.
    """
    rest = [c for c in df.columns if c not in keys]
    picked = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_row"))
    return picked.select(*[F.col(c) if c in keys else F.col("_row")[c].alias(c) for c in df.columns])


def last_by(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    rest = [c for c in df.columns if c not in keys]
    picked = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_row"))
    return picked.select(*[F.col(c) if c in keys else F.col("_row")[c].alias(c) for c in df.columns])


def require_unique(df: DataFrame, keys: list[str]) -> DataFrame:
    """``df``; fails while it is read if two rows share a key."""
    n = F.count("*").over(Window.partitionBy(*keys))
    return df.withColumn("_n", F.when(n > 1, F.raise_error(F.lit(f"duplicate key {keys}"))).otherwise(n)).where("_n = 1").drop("_n")


def append_new(existing: DataFrame, batch: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """``existing`` and those rows of ``batch`` whose key neither it nor an earlier row of the batch has."""
    return existing.unionByName(first_by(batch, keys, order).join(existing.select(*keys).distinct(), keys, "left_anti"))


def type_tag(kinds: Column, order: list[tuple[str, str]]) -> Column:
    """Tags of the kinds that a set has, in a fixed order and joined by +."""
    return F.array_join(F.filter(F.array(*[F.when(F.array_contains(kinds, k), F.lit(t)) for k, t in order]), lambda x: x.isNotNull()), "+")


def count_tag(counts: list[tuple[Column, str]]) -> Column:
    """Tags with their numbers, such as B+2U+3D: none for 0, no number for 1."""
    return F.concat_ws("+", *[F.when(n == 1, F.lit(t)).when(n > 1, F.concat(n.cast("string"), F.lit(t))) for n, t in counts])


def fallback(*choices: Column, otherwise: str = "Unknown") -> Column:
    """The first choice that is not null or blank."""
    return F.coalesce(*[F.when(F.trim(c) != "", c) for c in choices], F.lit(otherwise))


def take_with_overflow(df: DataFrame, room: int, order: list[Column]) -> tuple[DataFrame, DataFrame]:
    """The first ``room`` rows, and one row with how many were left out (skipped)."""
    taken = df.orderBy(*order).limit(room)
    return taken, df.agg(F.greatest(F.count("*") - room, F.lit(0)).alias("skipped"))


def contiguous(df: DataFrame, keys: list[str], part: str, first: int = 1) -> DataFrame:
    """Of each group: how many parts it has, and whether they are ``first``, ``first`` + 1, ... without gap or repetition.

    A group with no part at all (null numbers) is complete.
    """
    n, least, most, different = F.count(part), F.min(part), F.max(part), F.count_distinct(part)
    return df.groupBy(*keys).agg(n.cast("bigint").alias("parts"), F.coalesce((least == first) & (most == n + first - 1) & (different == n), F.lit(True)).alias("complete"))


def regex_rule(column: str, rules: list[tuple[str, str]], otherwise: str | None = None) -> Column:
    """The label of the first pattern that all of a text matches."""
    return first_rule([(F.col(column).rlike(f"^(?:{pattern})$"), label) for pattern, label in rules], otherwise)


def shallowest(entries: DataFrame, keys: list[str], path: str, anchors: list[str]) -> DataFrame:
    """(keys, root): the folder that holds an anchor folder with the fewest folders above it (ties by name); '' is the top."""
    parts = F.split(path, "/")
    names = F.array(*[F.lit(a.lower()) for a in anchors])
    place = F.array_position(F.transform(parts, lambda p: F.array_contains(names, F.lower(p))), F.lit(True))
    found = entries.withColumn("_at", place).where("_at > 0 and _at < size(split(`" + path + "`, '/'))")
    root = F.array_join(F.slice(parts, 1, F.col("_at").cast("int") - 1), "/")
    return found.groupBy(*keys).agg(F.min_by(root, F.struct("_at", root)).alias("root"))


def inferred_kind(df: DataFrame, keys: list[str], track_type: str, frames: str) -> DataFrame:
    """(keys, kind): what a disc is, by its tracks: audio only, data only, mixed, or high density by its length."""
    audio, data = F.count_if(F.col(track_type) == "AUDIO"), F.count_if(F.col(track_type) != "AUDIO")
    kind = F.when(F.sum(frames) > 500_000, "high density").when(data == 0, "audio").when(audio == 0, "data").otherwise("mixed")
    return df.groupBy(*keys).agg(kind.alias("kind"))


def last_regex_rule(column: str, rules: list[tuple[str, str]], otherwise: str | None = None) -> Column:
    """The label of the last pattern that all of a text matches: later rules overrule earlier ones."""
    return regex_rule(column, rules[::-1], otherwise)


def role_groups(df: DataFrame, base: str, role: str, roles: list[str], order: Column, value: str, name: str) -> DataFrame:
    """(base, name, and a list for each role): rows by base, whatever its case, in order; the first row's name; blank bases are left out."""
    rows = df.withColumn("_base", F.upper(F.trim(base))).where("_base <> ''")
    each = lambda r: F.transform(F.array_sort(F.collect_list(F.when(F.col(role) == r, F.struct(order.alias("o"), F.col(value).alias("v"))))), lambda x: x["v"])
    return rows.groupBy(F.col("_base").alias("base")).agg(F.min_by(name, order).alias("name"), *[each(r).alias(r) for r in roles])


def id_set(c: Column) -> Column:
    """An aggregate: the different values, sorted; null for none."""
    found = F.array_sort(F.collect_set(c))
    return F.when(F.size(found) > 0, found)


def outcomes(ok: Column) -> list[Column]:
    """Aggregates: how many rows succeeded and how many failed; an unknown outcome is a failure."""
    good = F.coalesce(ok, F.lit(False))
    return [F.count_if(good).alias("succeeded"), F.count_if(~good).alias("failed")]


def least_above(c: Column, bound=0) -> Column:
    """An aggregate: the least value above a bound."""
    return F.min(F.when(c > bound, c))


def folded_size(parts: Column, field: str) -> Column:
    """The sum of a field over an array of structs; 0 for none."""
    return F.aggregate(F.coalesce(parts, F.array().cast(f"array<struct<{field}:bigint>>")), F.lit(0).cast("bigint"), lambda s, x: s + x[field])


def skip_take(df: DataFrame, keys: list[str], order: list[Column], skip: int, take: int) -> DataFrame:
    """Of each group, in order, ``take`` rows at most behind the first ``skip``."""
    n = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_n", n).where(F.col("_n").between(skip + 1, skip + take)).drop("_n")
