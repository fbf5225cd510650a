"""Merkle manifest of a dataset by lag and lead windows.

Every row is a leaf; leaves of one group, in order, are the lowest level of the
group's tree, every ``FAN`` consecutive nodes have one parent, and the groups'
subroots, in order, are the leaves of the tree over them.

A node sits on the row of its first leaf.  Level ``k`` of a tree reads its
siblings with ``lag`` and ``lead`` of the fixed offsets ``FAN**k`` and
``2 * FAN**k``, masked by the node's slot and the length of its run; the row of a
first child then hashes the parent.  Runs never cross blocks of
``FAN**LEVELS`` leaves, so windows are partitioned by (group, block): a hot
group is many small windows, and one exchange serves ``LEVELS`` levels.  Only
the first row of a block goes on to the next round, ``FAN**LEVELS`` times fewer;
the paths of a round are joined to those of the round below it, block by block.

Nulls: a null field is written ``-``, null groups are one group that comes
first, null ids come first in their group.  Empty texts are ``0:``.  Rows that
repeat an id stand in order of their leaf; rows that are equal in all fields
have equal leaves, each with a proof of its own.  Texts of any length are hashed
whole where they are read and do not travel.  An empty table gives no rows;
columns beside those named are left behind.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spendlens.operators.ranks import placed
from spendlens.session import materialize


FAN, LEVELS = 3, 5
BLOCK = FAN ** LEVELS


def digest(*parts: Column) -> Column:
    """Lowercase hex SHA-256 of the parts, end to end."""
    return F.sha2(F.concat(*parts), 256)


def field(value: Column) -> Column:
    """A field as hashed: UTF-8 byte count, colon, value; ``-`` for null."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(*values: Column) -> Column:
    return digest(*[field(v) for v in values])


def proof(path: str | Column) -> Column:
    """Digest of all siblings on a path, from the leaf to the root, left to right."""
    return F.sha2(F.array_join(F.transform(path, lambda s: F.concat(s["before"], s["after"])), ""), 256)


def fold(start: str | Column, path: str | Column) -> Column:
    """The root that a leaf and the siblings of a path give."""
    begin = F.col(start) if isinstance(start, str) else start
    return F.aggregate(path, begin, lambda h, s: digest(s["before"], h, s["after"]))


def _masked(keep: Column, value: Column) -> Column:
    return F.when(keep, value).otherwise(F.lit(""))


def _climb(nodes: DataFrame, *carried: str) -> DataFrame:
    """One round over nodes (g, pos, n, h): ``path`` holds the siblings of the
    round's levels, ``top`` on the first row of a block the node above them."""
    block = Window.partitionBy("g", "block").orderBy("pos")
    fill = block.rowsBetween(Window.unboundedPreceding, 0)
    out = nodes.withColumn("block", F.expr(f"pos div {BLOCK}")).withColumn("h0", F.col("h"))
    for k in range(LEVELS):
        step = FAN ** k
        slot = F.expr(f"(pos div {step}) % {FAN}")
        run = F.expr(f"least({FAN}, ceil(n / {step}) - pos div {step * FAN} * {FAN})")      # nodes of the run
        many = F.col("n") > step                                                           # the level has siblings at all
        out = out.withColumns({f"b{d}": F.lag(f"h{k}", d * step).over(block) for d in (1, 2)}
                              | {f"a{d}": F.lead(f"h{k}", d * step).over(block) for d in (1, 2)})
        before = F.concat(_masked(slot >= 2, F.col("b2")), _masked(slot >= 1, F.col("b1")))
        after = F.concat(_masked(slot + 1 < run, F.col("a1")), _masked(slot + 2 < run, F.col("a2")))
        own = F.when((F.col("pos") % step == 0) & many, F.struct(before.alias("before"), after.alias("after")))
        parent = F.when(~many, F.col(f"h{k}")).when(F.col("pos") % (step * FAN) == 0, digest(F.col(f"h{k}"), after))
        out = (out.withColumns({f"own{k}": own, f"h{k + 1}": parent})
               .withColumn(f"s{k}", F.last(f"own{k}", ignorenulls=True).over(fill)))
    return out.select("g", "pos", "n", "block", *carried, F.array_compact(F.array(*[f"s{k}" for k in range(LEVELS)])).alias("path"),
                      F.when(F.col("pos") % BLOCK == 0, F.col(f"h{LEVELS}")).alias("top"))


def _rounds(leaves: DataFrame, *carried: str) -> tuple[list[DataFrame], DataFrame]:
    """The rounds from leaves (g, pos, n, h) up, and the last nodes (g, h), one a group."""
    rounds, nodes, columns = [], leaves, carried
    size = leaves.agg(F.max("n")).first()[0] or 1
    while not rounds or size > 1:
        rounds.append(materialize(_climb(nodes, *columns), "merkle-round"))
        columns, size = (), -(-size // BLOCK)
        nodes = (rounds[-1].where("top is not null")
                 .select("g", F.col("block").alias("pos"), F.expr(f"ceil(n / {BLOCK})").alias("n"), F.col("top").alias("h")))
    return rounds, nodes.select("g", "h")


def _paths(rounds: list[DataFrame], tops: DataFrame, *carried: str) -> DataFrame:
    """The carried columns of the lowest round and all of ``tops`` (one row for each
    g, its ``path`` above that node) with the whole ``path``."""
    more = [c for c in tops.columns if c not in ("g", "path")]
    above = tops.select("g", F.lit(0).cast("long").alias("block"), *more, F.col("path").alias("rest"))
    for level in rounds[:0:-1]:
        above = (level.join(above, ["g", "block"])
                 .select("g", F.col("pos").alias("block"), *more, F.concat("path", "rest").alias("rest")))
    return (rounds[0].join(above, ["g", "block"])
            .select("g", *carried, *more, F.concat("path", "rest").alias("path")))


def manifest(rows: DataFrame, fields: Sequence[str], by: str, order: str, keep: Mapping[str, Column] | None = None) -> DataFrame:
    """``order``, the columns of ``keep`` (expressions over ``rows``), ``leaf``,
    ``subroot``, ``root`` and ``path`` (siblings before and after the node, level by
    level from the leaf to the root) of every row."""
    kept = {f"k_{name}": value for name, value in (keep or {}).items()}
    leaves = rows.select(F.coalesce(F.concat(F.lit("="), F.col(by).cast("string")), F.lit("")).alias("g"),
                         F.col(order).alias("k"), leaf(*[F.col(c) for c in fields]).alias("h"),
                         *[value.alias(name) for name, value in kept.items()])
    leaves = materialize(leaves, "merkle-digests")           # texts are read and hashed once, digests are dealt
    low = placed(leaves, "g", [F.col("k").asc_nulls_first(), F.col("h")], "merkle-leaves").withColumn("leaf", F.col("h"))
    lower, subroots = _rounds(low, "k", "leaf", *kept)
    high = placed(subroots.select(F.lit("").alias("g"), F.col("g").alias("of"), "h"), "g", [F.col("of")], "merkle-subroots")
    upper, top = _rounds(high.withColumn("subroot", F.col("h")), "of", "subroot")
    none = F.array().cast("array<struct<before:string,after:string>>")
    over = _paths(upper, top.select("g", F.col("h").alias("root"), none.alias("path")), "of", "subroot")
    out = _paths(lower, over.select(F.col("of").alias("g"), "subroot", "root", "path"), "k", "leaf", *kept)
    return out.select(F.col("k").alias(order), *[F.col(c).alias(c[2:]) for c in kept], "leaf", "subroot", "root", "path")
