"""Aggregations shared by the reports (AGG-2..8, AGG-28/29, TOP-1, JOIN-6).

Every aggregate here is a single ``groupBy`` with map-side partial
aggregation (sum/avg/count/min/max), so a hot key costs one combined row per
map task, not a skewed reducer.  Frames joined back are either bounded by
construction (12 months, a handful of years, one-row scalars: broadcast) or
left to AQE's runtime size check.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import fixed
from ..functions import scalars as S
from ..session import materialize


def money(amount="amount") -> Column:
    """An amount as a decimal, so that sums do not depend on the order of rows.

    Doubles hold 15 reliable digits: ten decimals are kept below 10,000, five
    below a thousand million, two above.  Null for values that no decimal holds
    (infinite, or of more than 28 digits): they are left out of sums and counts of
    a mean alike, and the quality profile counts them.
    """
    c = F.col(amount) if isinstance(amount, str) else amount
    d = c.try_cast("decimal(38,10)")
    return (F.when(F.abs(c) < 1e4, d).when(F.abs(c) < 1e9, F.round(d, 5)).otherwise(F.round(d, 2))
            .cast("decimal(38,10)"))


def money_mean(amount="amount") -> Column:
    """Mean of an amount column of rows; numerator and count cover the same rows."""
    return money_mean_of(money(amount))


def money_mean_of(m) -> Column:
    """Mean of money, or of a column that holds it."""
    return F.try_divide(F.try_sum(m).cast("double"), F.count(m))


#: What a cell of a cube holds: sum of amounts (double), exact sum, number of amounts
#: in the exact sum, number of orders, largest amount.
MEASURES = ("amount", "money", "priced", "orders", "largest")


def measures(df: DataFrame) -> DataFrame:
    """Purchase rows as cells of one order each; cells stay as they are.  So every
    aggregate below reads rows and cubes alike."""
    if "orders" in df.columns:
        return df
    return df.withColumn("money", money()).withColumns({
        "priced": F.col("money").isNotNull().cast("bigint"), "orders": F.lit(1).cast("bigint"), "largest": F.col("amount")})


def counted(df: DataFrame) -> DataFrame:
    """Rows as cells of one order each, for functions that only count."""
    return df if "orders" in df.columns else df.withColumn("orders", F.lit(1).cast("bigint"))


def cells(df: DataFrame, *keys) -> DataFrame:
    """The cells of the given keys: mergeable measures, one partial aggregate."""
    return measures(df).groupBy(*keys).agg(
        F.sum("amount").alias("amount"), F.try_sum("money").alias("money"), F.sum("priced").alias("priced"),
        F.sum("orders").alias("orders"), F.max("largest").alias("largest"))


def mean_of(where: Column | None = None) -> Column:
    """Mean amount of cells, from exact sums; null where nothing was summed, or where
    the sum has more than 28 digits."""
    money_, priced = F.col("money"), F.col("priced")
    if where is not None:
        money_, priced = F.when(where, money_), F.when(where, priced)
    return F.try_divide(F.try_sum(money_).cast("double"), F.sum(priced))


def orders_of(where: Column | None = None) -> Column:
    """Number of orders of cells (0 for none)."""
    return F.coalesce(F.sum(F.col("orders") if where is None else F.when(where, F.col("orders"))), F.lit(0)).cast("bigint")


ALL = "_all"


def monthly_cube(prepared: DataFrame, labels: Sequence[str] = (), year: int | None = None) -> DataFrame:
    """Cells by (dimension, value, year, month): all rows by month (dimension and
    value ``_all``), the named dimensions by year (month null; of ``year`` alone, where
    given).  One scan that the headline, the months, the breakdown, the seasonal
    model and the gap fill of a report share.

    Without dimensions a cube has one cell a month and is kept in memory; with
    them it grows with the number of values and is written once.
    """
    check_dimensions(prepared, labels)
    if not labels:
        return keep_small(cells(prepared, F.lit(ALL).alias("dimension"), F.lit(ALL).alias("value"), "year", "month"))
    known = F.lit(True) if year is None else F.col("year") == year
    cols = [F.when(known, F.col(fixed.DIMENSIONS[l]).cast("string")).alias(l) for l in labels]
    long = (measures(prepared).select("year", "month", *MEASURES, *cols, F.lit(ALL).alias(ALL))
            .unpivot(ids=["year", "month", *MEASURES], values=[ALL, *labels], variableColumnName="dimension",
                     valueColumnName="value").where(F.col("value").isNotNull())
            .withColumn("month", F.when(F.col("dimension") == ALL, F.col("month"))))
    return materialize(cells(long, "dimension", "value", "year", "month"), "monthly-cube")


def totals(cube: DataFrame) -> DataFrame:
    """The cells of all rows, one a month."""
    return cube.where((F.col("dimension") == ALL)) if "dimension" in cube.columns else cube


def month_spine(spark: SparkSession) -> DataFrame:
    """Months 1..12 (JOIN-6 spine)."""
    return spark.range(1, 13).select(F.col("id").cast("int").alias("month"))


def annual_totals(hist: DataFrame) -> DataFrame:
    """AGG-2: spend per year."""
    return hist.groupBy("year").agg(F.sum("amount").alias("total"))


def predicted_annual_total(hist: DataFrame, trend_years: int = 3,
                           trend_divisor: float = 3.0) -> DataFrame:
    """AGG-3: mean annual total, plus (last - first of the last k years) / divisor.

    One row.  The per-year list has one entry per distinct year, a bound
    fixed by the history window, so collecting it per group is safe.
    """
    a = annual_totals(hist)
    agg = a.agg(
        F.avg("total").alias("mean_total"),
        F.count(F.lit(1)).alias("years"),
        F.sort_array(F.collect_list(F.struct("year", "total")), asc=False).alias("_yt"),
    )
    last = F.col("_yt")[0]["total"]
    first_k = F.col("_yt")[trend_years - 1]["total"]
    trend = (last - first_k) / float(trend_divisor)
    return agg.select(
        "mean_total", "years",
        F.when(F.col("years") >= trend_years, trend).alias("trend"),
        F.when(F.col("years") >= trend_years, F.col("mean_total") + trend)
        .otherwise(F.col("mean_total")).alias("predicted"),
    )


def sum_amount(df: DataFrame, name: str = "actual") -> DataFrame:
    """AGG-4: one-row sum."""
    return df.agg(F.sum("amount").alias(name))


def monthly_actual(year_df: DataFrame) -> DataFrame:
    """AGG-5: spend per month of the target year."""
    return year_df.groupBy("month").agg(F.sum("amount").alias("actual_sum"))


def monthly_history_mean(hist: DataFrame, basis: str = "order_mean") -> DataFrame:
    """AGG-6: mean *order* amount per month over history (reference default).

    ``basis="month_total"`` gives the mean monthly total instead.
    """
    if basis == "order_mean":
        return measures(hist).groupBy("month").agg(mean_of().alias("hist_mean"))
    per = hist.groupBy("year", "month").agg(F.sum("amount").alias("_t"))
    return per.groupBy("month").agg(F.avg("_t").alias("hist_mean"))


def monthly_resample(df: DataFrame, date_col: str = "order_date") -> DataFrame:
    """AGG-7: spend per month-end between the first and last month, gaps = 0.

    Null dates are dropped.  The spine is generated from the one-row min/max,
    so it has one row per month of the span (bounded by the date range).
    """
    d = df.where(F.col(date_col).isNotNull()).select(
        F.last_day(F.col(date_col)).alias("ds"), "amount")
    sums = d.groupBy("ds").agg(F.sum("amount").alias("y"))
    span = d.agg(F.min("ds").alias("a"), F.max("ds").alias("b"))
    spine = span.select(F.explode(F.sequence(
        F.trunc("a", "month"), F.trunc("b", "month"), F.expr("interval 1 month"))).alias("m")) \
        .select(F.last_day("m").alias("ds"))
    return spine.join(sums, "ds", "left").select("ds", F.coalesce("y", F.lit(0.0)).alias("y"))


def unpivot_dimensions(df: DataFrame, labels: Sequence[str], measure: str = "amount") -> DataFrame:
    """(dimension label, value, measure) rows for the chosen dimensions.

    One scan feeds every dimension: the expand happens inside the map stage.
    """
    cols = [F.col(fixed.DIMENSIONS[l]).cast("string").alias(l) for l in labels]
    base = df.select(*cols, F.col(measure).alias("_m"))
    return base.unpivot(ids=["_m"], values=list(labels), variableColumnName="dimension",
                        valueColumnName="value").withColumnRenamed("_m", measure)


def check_dimensions(df: DataFrame, labels: Sequence[str]) -> None:
    for label in labels:
        if label not in fixed.DIMENSIONS:
            raise ValueError(f"unknown dimension {label!r}; known: {sorted(fixed.DIMENSIONS)}")
        if fixed.DIMENSIONS[label] not in df.columns:
            raise ValueError(f"dimension {label!r} needs the column {fixed.DIMENSIONS[label]!r}")


def dimension_breakdown(df: DataFrame, labels: Sequence[str], top: int = 10) -> DataFrame:
    """AGG-8 + TOP-1: per dimension value: total, mean, orders, share of total, over
    purchase rows or over the cells of a monthly cube.

    Null values are dropped; the share base is all non-null groups before the
    top-k cut.  The values' totals are read twice (ranks and shares) through one
    shuffle; top-k uses ``row_number``, which Catalyst turns into a partial
    per-task limit before the shuffle.
    """
    if "dimension" in df.columns:
        long = df.where(F.col("dimension").isin(*labels))
    else:
        check_dimensions(df, labels)
        cols = [F.col(fixed.DIMENSIONS[l]).cast("string").alias(l) for l in labels]
        long = measures(df).select(*MEASURES, *cols)
        if labels:
            long = long.unpivot(ids=list(MEASURES), values=list(labels), variableColumnName="dimension", valueColumnName="value")
    if not labels:
        return df.sparkSession.createDataFrame([], "dimension string, value string, total double, "
                                                   "mean double, orders bigint, share_pct double, rank int")
    g = (long.where(F.col("value").isNotNull()).groupBy("dimension", "value")
         .agg(F.sum("amount").alias("total"), mean_of().alias("mean"), orders_of().alias("orders")))
    dim_tot = F.broadcast(g.groupBy("dimension").agg(F.sum("total").alias("_all")))
    w = Window.partitionBy("dimension").orderBy(F.col("total").desc(), F.col("value").asc())
    ranked = g.withColumn("_rk", F.row_number().over(w)).where(F.col("_rk") <= top)
    return ranked.join(dim_tot, "dimension").select(
        "dimension", "value", "total", "mean", "orders",
        F.when(F.col("_all") > 0, F.col("total") / F.col("_all") * 100.0)
        .otherwise(F.lit(0.0)).alias("share_pct"),
        F.col("_rk").cast("int").alias("rank"),
    )


def history_months(df: DataFrame) -> DataFrame:
    """AGG-28: distinct (non-null) years x 12."""
    return df.agg((F.count_distinct("year") * 12).alias("history_months"))


def observed_periods(df: DataFrame, date_col: str = "order_date") -> DataFrame:
    """AGG-29: distinct year-months observed."""
    return df.where(F.col(date_col).isNotNull()).select(
        month_start(date_col).alias("period")).distinct()


def month_start(date_col: str = "order_date"):
    """First instant of the month, kept as a timestamp (no time zone)."""
    return F.date_trunc("month", F.col(date_col)).cast("timestamp_ntz")


def month_name_col(month: str = "month"):
    return S.month_name(month)


def scalar(one_row: DataFrame, col: str | None = None):
    """A one-row frame as a value: a Spark scalar subquery.

    Catalyst runs the subquery once and uses its result as a constant in the
    consuming plan -- no join, no pairing of rows.  Without ``col`` the whole
    row comes back as a struct (fields by name); zero rows give null.
    """
    if col is not None:
        return one_row.select(col).scalar()
    return one_row.select(F.struct(*one_row.columns)).scalar()


def keep_small(df: DataFrame) -> DataFrame:
    """Persist a frame whose size is bounded by construction (one-row
    statistics, per-group profiles, top-k lists) because several outputs read
    it; large fact slices are never persisted here."""
    from pyspark import StorageLevel
    return df.persist(StorageLevel.MEMORY_AND_DISK)
