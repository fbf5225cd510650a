"""Connected components of an edge table, as repeated joins.

Alternating large-star and small-star steps (Kiveris et al., 2014): each step is
a partial ``min`` aggregate and an equi-join, and is written to the shared
checkpoint folder, so lineage stays short and nothing but one row count and
checksum reaches the driver.  The minima are written before they are joined:
both sides of the join are then plain shuffles, whose hot nodes AQE can split.
Ends when a step changes nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spendlens.session import materialize


def _star(edges: DataFrame, flag: Column) -> DataFrame:
    """One star step over (u, v) rows: every neighbour that ``flag`` selects is
    tied to the least of the node's neighbours and itself."""
    least = edges.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
    return edges.join(materialize(least, "cc-least"), "u").where(flag)


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, component) for every node that occurs in ``edges`` (a, b); the
    component is its smallest node.  Nulls are not nodes."""
    now = materialize(edges.where(F.col("a") != F.col("b"))
                      .select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "cc")
    before = None
    for _ in range(rounds):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = (_star(both, F.col("v") > F.col("u"))
                 .select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct())
        down = materialize(large, "cc")
        least = materialize(down.groupBy("u").agg(F.min("v").alias("m")), "cc-least")
        small = (down.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .unionByName(least.select("u", F.col("m").alias("v"))).where("u != v").distinct())
        now = materialize(small, "cc")
        mark = tuple(now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if mark == before:
            break
        before = mark
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return (now.select(F.col("u").alias("node"), F.col("v").alias("component"))
            .unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()))
