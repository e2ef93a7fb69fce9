"""Distributed union-find over link rows, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import drop, table


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Maps every linked node to the smallest node it reaches: rows ``(node, component)``.

    Alternates large-star and small-star steps until the forest is flat: each step joins a node's links with
    the node's least neighbour, so a node with many links is a join key that adaptive execution may split, and
    never one task's group. Each round is a table in the shared folder; only two counts reach the driver.
    Null ends and self links are ignored; an empty input gives an empty result.
    """
    e = links.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u is not null and v is not null and u <> v")
    e = table(e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "links")
    before = None
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        small_least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(small_least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(small_least.select("u", F.col("m").alias("v")))
        last, e = e, table(small.where("u <> v").distinct(), "links")
        drop(last)
        state = e.agg(F.count("*"), F.count_distinct("u"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before or state[0] == 0:
            break
        before = state
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def extended(known: DataFrame | None, links: DataFrame) -> DataFrame:
    """``known`` components ``(node, component)`` with the links ``(a, b)`` added, as a table.

    Known components are single nodes to union-find, so that it works on the added links alone.
    """
    if known is None:
        return table(components(links), "components")
    a, b = (known.select(F.col("node").alias(x), F.col("component").alias(f"c{x}")) for x in "ab")
    between = links.join(a, "a", "left").join(b, "b", "left").select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b"))
    added = table(components(between), "components")
    moved = added.select(F.col("node").alias("component"), F.col("component").alias("to"))
    old = known.join(moved, "component", "left").select("node", F.coalesce("to", "component").alias("component"))
    return table(old.unionByName(added.join(known.select("node"), "node", "left_anti")), "components")
