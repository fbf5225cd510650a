"""Places of rows in the order of their group, however large the group.

A window over a group would put a hot group into one task.  Here the rows are
range-partitioned by (group, order), sorted inside the partitions and written
once with their number; counts per (group, partition) and a running sum over a
group's partitions (at most one row per partition) turn the numbers into places.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize


def placed(rows: DataFrame, group: str, order: list[Column], name: str) -> DataFrame:
    """``rows`` with ``pos`` (from 0, in ``order`` within ``group``) and ``n`` (rows
    of the group).  ``group`` holds no nulls; rows that tie in all of ``order`` come
    as they lie in the input."""
    tie = F.col("_tie")
    laid = (rows.withColumn("_tie", F.monotonically_increasing_id())
            .repartitionByRange(F.col(group), *order, tie).sortWithinPartitions(F.col(group), *order, tie)
            .drop("_tie").withColumn("_at", F.monotonically_increasing_id()))
    laid = materialize(laid, name).withColumn("_part", F.shiftright("_at", 33))
    whole = Window.partitionBy(group)
    before = whole.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    held = (laid.groupBy(group, "_part").agg(F.count("*").alias("_m"), F.min("_at").alias("_first"))
            .select(F.col(group).alias("_g"), F.col("_part").alias("_p"), "_first",
                    F.sum("_m").over(whole).alias("n"), F.coalesce(F.sum("_m").over(before), F.lit(0)).alias("_before")))
    return (laid.join(held, (F.col(group) == F.col("_g")) & (F.col("_part") == F.col("_p")))
            .withColumn("pos", F.col("_before") + F.col("_at") - F.col("_first"))
            .drop("_at", "_part", "_g", "_p", "_first", "_before"))
