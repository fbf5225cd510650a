"""Stand-in inputs built from the driver's test tables.

This module only *shapes* rows of the TPC-H-like tables into the schemas the
library expects (``purchases_raw`` and ``catalogue``), following the mapping
in FIXTURES.md.  It does none of the reports' work: joining the catalogue,
grouping lines and every analysis run in the library proper.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import CATALOGUE, PURCHASES_RAW, conform


#: Purchase lines that one task joins (and groups or writes, where that follows).
LINES_A_TASK = 250_000


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cost-centre catalogue: one row per (nation, market segment) seen."""
    c = _read(spark, sf_dir, "customer").select("c_nationkey", "c_mktsegment")
    n = _read(spark, sf_dir, "nation").select("n_nationkey", "n_name", "n_regionkey")
    r = _read(spark, sf_dir, "region").select("r_regionkey", "r_name")
    d = (
        c.join(n, c.c_nationkey == n.n_nationkey)
        .join(r, n.n_regionkey == r.r_regionkey)
        .where(n.n_nationkey % 5 != 4)          # 20 % of cost centres unmatched
        .select(
            n.n_nationkey.alias("cost_center_id"),
            c.c_mktsegment.alias("unit"),
            r.r_name.alias("destination"),
            n.n_name.alias("level6"),
            F.lit(None).cast("string").alias("level7"),
            F.lit(None).cast("string").alias("level8"),
            F.lit(None).cast("string").alias("nature"),
        )
        .distinct()
    )
    return conform(d, CATALOGUE, "catalogue")


def purchases_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Purchase lines: lineitem x orders x customer x part, with planted dirt.

    Orders meet their customers and lines their parts while both are narrow; the two
    are then dealt by request, so that a grouping by keys of which the request is one
    needs no further shuffle, and a task holds about as many lines at every size.
    """
    li = _read(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_partkey", "l_linenumber", "l_extendedprice", "l_shipdate")
    o = _read(spark, sf_dir, "orders").select(
        "o_orderkey", "o_custkey", "o_orderdate", "o_orderpriority")
    c = _read(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    p = _read(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_type", "p_name")
    tasks = max(spark.sparkContext.defaultParallelism, -(-li.count() // LINES_A_TASK))    # a count of Parquet footers
    lines = (li.join(p, li.l_partkey == p.p_partkey).withColumn("request_id", F.col("l_orderkey").cast("string"))
             .drop("l_orderkey", "l_partkey", "p_partkey").repartition(tasks, "request_id"))
    orders = (o.join(c, o.o_custkey == c.c_custkey).withColumn("request_id", F.col("o_orderkey").cast("string"))
              .drop("o_orderkey", "o_custkey", "c_custkey").repartition(tasks, "request_id"))
    k = F.col("request_id").cast("bigint")
    price = F.col("l_extendedprice")
    prio = F.col("o_orderpriority")
    amount = (
        F.when(k % 89 == 0, -price)
        .when(k % 83 == 0, F.lit(0.0))
        .when(k % 997 == 0, price * 90)
        .when(prio == "1-URGENT", price * 3)
        .when(prio == "5-LOW", price * 0.2)
        .otherwise(price)
    )
    category = (
        F.when(k % 97 == 0, F.lit(None).cast("string"))
        .when(k % 101 == 0, F.lit("Desconocido"))
        .otherwise(F.col("p_type"))
    )
    ln6 = F.col("l_linenumber") % 6
    detail = (
        F.when(ln6 == 0, "Cant. 12").when(ln6 == 1, "Cantidad: 7")
        .when(ln6 == 2, "caja PZA 3").when(ln6 == 3, "UN:4 Cant 9")
        .when(ln6 == 4, "sin dato").otherwise(F.lit(None).cast("string"))
    )
    null_s = F.lit(None).cast("string")
    df = (
        lines.join(orders, "request_id")
        .select(
            prio.alias("origin"),
            null_s.alias("system"),
            F.col("c_mktsegment").alias("company"),
            F.when(k % 103 == 0, F.lit(None)).otherwise(F.col("l_shipdate")).alias("request_date"),
            F.col("o_orderdate").alias("order_date"),
            F.col("c_nationkey").alias("cost_center"),
            null_s.alias("business_line"),
            amount.alias("amount"),
            detail.alias("detail"),
            null_s.alias("requester"),
            null_s.alias("preparer"),
            "request_id",
            F.col("l_linenumber").cast("string").alias("line_no"),
            category.alias("category"),
            F.col("p_brand").alias("class"),
            F.col("p_name").alias("family"),
            null_s.alias("buying_entity"),
        )
    )
    return conform(df, PURCHASES_RAW, "purchases_raw")
