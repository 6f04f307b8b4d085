"""Chains of blocks: each knows the one before it."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut


def positions(nodes: DataFrame, key: str, before: str) -> DataFrame:
    """(key, head, position) of every node that a chain reaches from its head (null ``before``), by pointer doubling.

    Each round joins every node with the one it points at, so a chain of n nodes takes log2(n) joins, not n.
    Nodes whose chain has a gap or runs in a circle are left out.
    """
    jump = cut(nodes.select(key, F.coalesce(before, key).alias("to"), F.when(F.col(before).isNull(), 0).otherwise(1).cast("bigint").alias("steps"), F.col(before).isNull().alias("done")))
    rounds = 0
    while rounds < 40 and not jump.where("not done").isEmpty():
        ahead = jump.select(F.col(key).alias("to"), F.col("to").alias("_to"), F.col("steps").alias("_steps"), F.col("done").alias("_done"))
        moved = jump.join(ahead, "to")  # a node that points at nothing goes
        following = cut(moved.select(key, F.col("_to").alias("to"), (F.col("steps") + F.col("_steps")).alias("steps"), F.col("_done").alias("done")))
        if following.where("not done").count() == jump.where("not done").count() and rounds > 0:
            jump = following.where("done")  # what is left runs in circles
            break
        jump, rounds = following, rounds + 1
    return jump.where("done").select(key, F.col("to").alias("head"), F.col("steps").alias("position"))


def linked(blocks: DataFrame, owner: str, block: str) -> DataFrame:
    """Blocks given to owners as chains: each with the one ``before`` it, in order of blocks."""
    return blocks.withColumn("before", F.lag(block).over(Window.partitionBy(owner).orderBy(block)))


def paths(nodes: DataFrame, key: str, parent: str, name: str) -> DataFrame:
    """(key, path): the names from the root to each node, joined by /, by pointer doubling; cycles and orphans are left out."""
    jump = cut(nodes.select(key, F.coalesce(parent, key).alias("to"), F.col(name).alias("path"), F.col(parent).isNull().alias("done")))
    left = None
    while (now := jump.where("not done").count()) and now != left:
        ahead = jump.select(F.col(key).alias("to"), F.col("to").alias("_to"), F.col("path").alias("_path"), F.col("done").alias("_done"))
        moved = jump.join(ahead, "to")
        longer = F.when(F.col("done"), F.col("path")).otherwise(F.concat("_path", F.lit("/"), "path"))
        before, jump = jump, cut(moved.select(key, F.col("_to").alias("to"), longer.alias("path"), (F.col("done") | F.col("_done")).alias("done")))
        left = now if jump.where("done").count() == before.where("done").count() else None
    return jump.where("done").select(key, "path")
