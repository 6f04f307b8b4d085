"""Computations along an order: offsets, next and previous rows, runs, renumbering, sequential packing.

Most are windows partitioned by a key, for keys of which each is a task's work; ``spread_sums`` and what is
built on it take keys of any size.  ``order`` should tell the rows of a key apart, or ties fall as they come.
"""

from __future__ import annotations

from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from ..functions.numbers import align_up
from ..session import cut, visible
from .chains import paths, positions


def offsets(df: DataFrame, keys: list[str], order: list[Column], size: Column, step: int = 1, start: Column | int = 0, name: str = "offset") -> DataFrame:
    """Where each row's data begins if rows lie one after another, each size rounded up to ``step``."""
    before = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn(name, F.coalesce(F.sum(align_up(size, step)).over(before), F.lit(0)) + (F.lit(start) if isinstance(start, int) else start))


def until_next(df: DataFrame, keys: list[str], order: list[Column], at: str, end: Column | None = None, name: str = "length") -> DataFrame:
    """From each row's position to the next one's; the last row's goes to ``end`` (null without it)."""
    following = F.lead(at).over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn(name, (following if end is None else F.coalesce(following, end)) - F.col(at))


def renumber(df: DataFrame, keys: list[str], order: list[Column], prefix: str = "D", digits: int = 2) -> DataFrame:
    """Numbers from 1 without gaps and labels such as D01."""
    n = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("number", n).withColumn("label", F.concat(F.lit(prefix), F.lpad(n.cast("string"), digits, "0")))


def spread_renumber(df: DataFrame, keys: list[str], order: list[Column], prefix: str = "D", digits: int = 2) -> DataFrame:
    """As ``renumber``, for keys of any size."""
    return spread_sums(df, keys, order, F.lit(1), "number").withColumn("label", F.concat(F.lit(prefix), F.lpad(F.col("number").cast("string"), digits, "0")))


def spread_sums(df: DataFrame, keys: list[str], order: list[Column], value: Column, name: str) -> DataFrame:
    """``df`` with the sum of ``value`` over the rows of its key up to each row, that one included, for keys of any size.

    Rows are dealt into ranges of (keys, order) and written; a range's sums by key are a few rows, whose own
    running sum is what each range begins with.  So a key with a third of all rows is many ranges' work.
    """
    ranged = cut(df.withColumn(name, value.cast("bigint")).repartitionByRange(*keys, *order).withColumn("_at", F.spark_partition_id()))
    sums = ranged.groupBy("_at", *keys).agg(F.sum(name).alias("_sum"))
    before = F.coalesce(F.sum("_sum").over(Window.partitionBy(*keys).orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    begins = sums.select("_at", *[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], before.alias("_begin"))
    own = F.sum(name).over(Window.partitionBy("_at", *keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    met = ranged.withColumn(name, own).join(begins.withColumnRenamed("_at", "_a"), reduce(Column.__and__, [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)], F.col("_at") == F.col("_a")))
    return met.withColumn(name, F.col(name) + F.col("_begin")).select(*df.columns, name)


def runs(df: DataFrame, keys: list[str], order: str, same: list[Column] | None = None, step: Column | None = None) -> DataFrame:
    """``df`` with ``run``, which grows by one where a row does not continue the one before.

    A row continues it if the expressions ``same`` are as they were and, with ``step``, if its order is the
    one before plus that row's step (adjacent extents).
    """
    w = Window.partitionBy(*keys).orderBy(order)
    goes_on = F.lag(F.lit(True)).over(w)
    for s in same or []:
        goes_on = goes_on & F.lag(s).over(w).eqNullSafe(s)
    if step is not None:
        goes_on = goes_on & (F.lag(F.col(order) + step).over(w) == F.col(order))
    marked = df.withColumn("_new", F.when(F.coalesce(goes_on, F.lit(False)), 0).otherwise(1))
    return marked.withColumn("run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))).drop("_new")


def coalesced_extents(extents: DataFrame, key: str = "obj_id") -> DataFrame:
    """Extents (key, v_start, v_end, p_start, src) with neighbours that continue each other in both spaces made one."""
    shift = F.col("v_start") - F.col("p_start")
    marked = runs(extents, [key], "v_start", [F.col("src"), shift], F.col("v_end") - F.col("v_start"))
    return marked.groupBy(key, "run").agg(F.min("v_start").alias("v_start"), F.max("v_end").alias("v_end"), F.min("p_start").alias("p_start"), F.min("src").alias("src")).drop("run")


def carried(df: DataFrame, keys: list[str], order: str, columns: list[str]) -> DataFrame:
    """Null values replaced by the last value before them."""
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return df.withColumns({c: F.last(c, ignorenulls=True).over(w) for c in columns})


def sequential_bins(df: DataFrame, keys: list[str], order: str, size: str, capacity: int) -> DataFrame:
    """(keys, order, bin): rows in order, a new bin where the next row would not fit; larger rows have a bin of their own.

    Rows are sorted by (key, order) within partitions by key and read as a stream; what is carried from row to
    row is two numbers, so no key is held in memory, however many rows it has.
    """
    rows = df.select(*keys, order, F.col(size).cast("bigint").alias("_size"))

    def step(state, value):
        number, used = state or (0, 0)
        fresh = used > 0 and used + value > capacity
        state = (number + 1, value) if fresh else (number, used + value)
        return state, state[0]

    return _folded(rows, keys, [order], "_size", step, "bin")


def debounced(df: DataFrame, keys: list[str], at: str, gap: int, tie: str) -> DataFrame:
    """Rows that come at least ``gap`` after the last row that was itself kept; the first of a key is kept.

    Whether a row is kept depends on what was kept before, so a window cannot tell: rows are read in order as
    a stream, and the time of the last one that was kept is carried along.
    """
    rows = df.select(*keys, F.col(at).cast("bigint").alias("_at"), tie)

    def step(last, value):
        taken = last is None or value - last >= gap
        return (value if taken else last), int(taken)

    return _folded(rows, keys, ["_at", tie], "_at", step, "_kept").where("_kept = 1").select(*keys, tie)


def _folded(df: DataFrame, keys: list[str], order: list[str], value: str, step, name: str) -> DataFrame:
    """The columns of ``df`` but ``value``'s helper, and what ``step`` gives row by row within a key: (state, value) -> (state, number)."""
    kept = [c for c in df.columns if c != value or c in keys or c in order]
    out = StructType([*df.select(*kept).schema.fields, StructField(name, LongType())])
    at = [df.columns.index(k) for k in keys]
    of, places = df.columns.index(value), [df.columns.index(c) for c in kept]

    def run(batches):
        key, state = None, None
        for b in batches:
            names, numbers = zip(*(b.column(i).to_pylist() for i in at)), []
            for k, v in zip(names, b.column(of).to_pylist()):
                if k != key:
                    key, state = k, None
                state, n = step(state, v)
                numbers.append(n)
            yield pa.record_batch([*(b.column(i) for i in places), pa.array(numbers, pa.int64())], names=out.names)

    visible(df.sparkSession)
    return df.repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(run, out)


def sliding_rate(df: DataFrame, keys: list[str], at: str, span: int, amount: Column) -> DataFrame:
    """Of the rows in the ``span`` up to each one: how many, and the sum of ``amount``."""
    w = Window.partitionBy(*keys).orderBy(at).rangeBetween(-span, Window.currentRow)
    return df.withColumn("in_span", F.count("*").over(w)).withColumn("amount_in_span", F.sum(amount).over(w))


def tree_levels(nodes: DataFrame, key: str, parent: str) -> DataFrame:
    """(key, parent, level): level 0 where the parent is null; joins grow with log2 of the depth; cycles and orphans are left out."""
    levels = positions(nodes.select(key, parent).distinct(), key, parent).select(key, F.col("position").cast("int").alias("level"))
    return nodes.select(key, parent).join(levels, key)


def tree_paths(nodes: DataFrame, key: str, parent: str, name: str) -> DataFrame:
    """(key, path) of every node below a root, to be found by their whole path with one equality join."""
    return paths(nodes.select(key, parent, name).distinct(), key, parent, name)


def path_table(nodes: DataFrame, key: str, parent: str, name: str) -> DataFrame:
    """(key, number, parent_number): nodes numbered from 1, level by level, in a level by their parents' order and then by name; roots have parent 0."""
    placed = tree_paths(nodes, key, parent, name).join(tree_levels(nodes, key, parent).select(key, parent, "level"), key)
    numbered = cut(spread_sums(placed, [], [F.col("level"), F.split("path", "/")], F.lit(1), "number"))
    above = numbered.select(F.col(key).alias(parent), F.col("number").alias("parent_number"))
    return numbered.join(above, parent, "left").select(key, "number", F.coalesce("parent_number", F.lit(0)).alias("parent_number"))


def blended_rate(df: DataFrame, keys: list[str], at: str, written: str, total: str, span: int) -> DataFrame:
    """``df`` with rate (bytes a second over the last ``span`` microseconds, blended half and half with the rate since the start) and eta (seconds)."""
    w = Window.partitionBy(*keys).orderBy(at)
    near = w.rangeBetween(-span, Window.currentRow)
    since = lambda first_at, first: (F.col(written) - first) * 1e6 / F.nullif(F.col(at) - first_at, F.lit(0))
    recent = since(F.first(at).over(near), F.first(written).over(near))
    overall = since(F.first(at).over(w), F.first(written).over(w))
    rate = F.coalesce((recent + overall) / 2, recent, overall, F.lit(0.0))
    return df.withColumn("rate", rate).withColumn("eta", F.when(F.col("rate") > 0, (F.col(total) - F.col(written)) / F.col("rate")))
