"""ML-7/ML-8/JOIN-7: monthly forecasts as Catalyst aggregates.

The seasonal model is trend + month-of-year season, fitted for any number of
series at once (``by`` = series key; empty = one global series):

1. y per month-end (AGG-7, zero-filled), t = months since the series start;
2. trend by least squares: ``regr_slope``/``regr_intercept`` per series;
3. season = mean residual per (series, month-of-year), re-centred to mean 0
   (needs >= 24 months, else 0);
4. noise = sample std of what is left; bounds = yhat +- z * noise;
5. future months come from ``sequence`` over the horizon, yhat is clamped at 0.

A fitted model is one row a series, which can be stored and used later; its input
is bounded by (#series x #months), never by #rows.
"""

from __future__ import annotations

import statistics
from typing import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from . import aggregates as A


def z_value(confidence: float) -> float:
    return statistics.NormalDist().inv_cdf(0.5 + confidence / 2.0)


def monthly_series(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """AGG-7 per series: (by..., ds = month end, y), empty months = 0; from purchase
    rows or from the cells of a monthly cube."""
    by = list(by)
    day = F.col("order_date") if "order_date" in df.columns else F.make_date("year", "month", F.lit(1))
    d = df.select(*by, F.last_day(day).alias("ds"), "amount").where(F.col("ds").isNotNull())
    sums = d.groupBy(*by, "ds").agg(F.sum("amount").alias("y"))
    span = d.groupBy(*by).agg(F.min("ds").alias("_a"), F.max("ds").alias("_b"))
    spine = span.select(*by, F.explode(F.sequence(
        F.trunc("_a", "month"), F.trunc("_b", "month"), F.expr("interval 1 month"))).alias("_m")) \
        .select(*by, F.last_day("_m").alias("ds"))
    return spine.join(sums, [*by, "ds"], "left").select(*by, "ds", F.coalesce("y", F.lit(0.0)).alias("y"))


def _months_between(a, b):
    return ((F.year(a) - F.year(b)) * 12 + (F.month(a) - F.month(b)))


#: The key of the one series of a model without ``by``.
SERIES = "_series"


def fit_series(df: DataFrame, by: Sequence[str] = (), min_season_months: int = 24) -> DataFrame:
    """The fitted model, one row a series: first and last month, number of months,
    intercept, slope, ``season`` (month of year -> deviation; all 0 and ``seasonal``
    false below ``min_season_months``) and ``noise``.

    The months of a series are dealt once by its key; trend, season and noise are
    windows over them (their number is bounded by the dates, not by the rows).
    """
    by = list(by)
    if not by:
        by, df = [SERIES], df.withColumn(SERIES, F.lit(0))
    one = Window.partitionBy(*by)
    month = Window.partitionBy(*by, "moy")
    s = monthly_series(df, by).repartition(*by).withColumns({
        "first_month": F.min("ds").over(one), "last_month": F.max("ds").over(one), "months": F.count("*").over(one), "moy": F.month("ds")})
    s = s.withColumn("t", _months_between(F.col("ds"), F.col("first_month")).cast("double"))
    s = s.withColumns({"slope": F.coalesce(F.regr_slope("y", "t").over(one), F.lit(0.0)),
                       "intercept": F.coalesce(F.regr_intercept("y", "t").over(one), F.lit(0.0))})
    s = s.withColumn("res", F.col("y") - (F.col("intercept") + F.col("slope") * F.col("t")))
    s = s.withColumns({"raw": F.avg("res").over(month), "same": F.count("*").over(month)})
    centre = F.sum(F.col("raw") / F.col("same")).over(one) / F.sum(F.lit(1.0) / F.col("same")).over(one)      # every month once
    s = s.withColumn("seasonal", F.col("months") >= min_season_months)
    s = s.withColumn("dev", F.when(F.col("seasonal"), F.col("raw") - centre).otherwise(F.lit(0.0)))
    return s.groupBy(*by, "first_month", "last_month", "months", "intercept", "slope", "seasonal").agg(
        F.map_from_entries(F.collect_set(F.struct("moy", "dev"))).alias("season"),          # <= 12 entries
        F.coalesce(F.stddev_samp(F.col("res") - F.col("dev")), F.lit(0.0)).alias("noise"))


def predict_series(model: DataFrame, target_year: int, confidence: float = 0.95, intervals: bool = True,
                   keep_raw: bool = False) -> DataFrame:
    """(series key, month, predicted, lower, upper, seasonal) of a fitted model for the
    forecast months that fall in the target year: a projection, no shuffle."""
    by = [c for c in model.columns if c not in (SERIES, "first_month", "last_month", "months", "intercept", "slope",
                                                "seasonal", "season", "noise")]
    # last + 1 .. last + h, h = months to December of the target year
    h = (F.lit(target_year) - F.year("last_month")) * 12 + (F.lit(12) - F.month("last_month"))
    fut = model.withColumn("k", F.explode(F.sequence(F.lit(1), F.when(h <= 0, F.lit(12)).otherwise(h))))
    fut = fut.withColumn("ds", F.last_day(F.add_months("last_month", F.col("k")))).where(F.year("ds") == target_year)
    t = _months_between(F.col("ds"), F.col("first_month")).cast("double")
    yhat = F.col("intercept") + F.col("slope") * t + F.coalesce(F.try_element_at("season", F.month("ds")), F.lit(0.0))
    band = F.col("noise") * z_value(confidence)
    none = F.lit(None).cast("double")
    return fut.select(*by, F.month("ds").cast("int").alias("month"),
                      S.clamp_non_negative(yhat).alias("predicted"),
                      (S.clamp_non_negative(yhat - band) if intervals else none).alias("lower"),
                      (S.clamp_non_negative(yhat + band) if intervals else none).alias("upper"), "seasonal",
                      *([yhat.alias("raw_predicted"), (yhat - band).alias("raw_lower")] if keep_raw else []))


def seasonal_forecast(df: DataFrame, target_year: int, confidence: float = 0.95,
                      intervals: bool = True, by: Sequence[str] = (),
                      min_season_months: int = 24, keep_raw: bool = False) -> DataFrame:
    """ML-7: monthly prediction for ``target_year`` with bounds.

    Horizon = months from the last observed month to December of the target
    year (<= 0 -> 12), counted from the same series the model is fitted on.
    ``seasonal`` tells whether the series was long enough for a season.
    """
    return predict_series(fit_series(df, by, min_season_months), target_year, confidence, intervals, keep_raw)


def _order_means(df: DataFrame) -> tuple[DataFrame, Column]:
    """Mean order amount of each month (<= 12 rows) and of all rows."""
    m = A.measures(df)
    mm = m.where(F.col("month").isNotNull()).groupBy("month").agg(A.mean_of().alias("_mm"))
    return mm, A.scalar(m.agg(A.mean_of().alias("_gm")), "_gm")


def fill_missing_months(forecast: DataFrame, df: DataFrame) -> DataFrame:
    """JOIN-7: add the months 1..12 the forecast lacks, valued at the mean
    order amount of that month (global mean when the month never occurs).

    Spine (12 rows) anti-joined to the forecast, left-joined to the monthly
    means (<= 12 rows) and the global mean (1 row): all broadcast, bounded.
    """
    spark = df.sparkSession
    have = forecast.select("month").distinct()
    missing = A.month_spine(spark).join(F.broadcast(have), "month", "left_anti")
    mm, gm = _order_means(df)
    filled = (missing.join(F.broadcast(mm), "month", "left")
              .select("month", F.coalesce(F.col("_mm"), gm).alias("predicted"),
                      F.lit(None).cast("double").alias("lower"), F.lit(None).cast("double").alias("upper")))
    source = F.when(F.col("seasonal"), "model").otherwise("trend") if "seasonal" in forecast.columns else F.lit("model")
    return (forecast.select("month", "predicted", "lower", "upper", source.alias("source"))
            .unionByName(filled.withColumn("source", F.lit("filled"))))


def fallback_monthly(df: DataFrame) -> DataFrame:
    """ML-8: 12 months = mean order amount of that month, else global mean."""
    spark = df.sparkSession
    mm, gm = _order_means(df)
    return (A.month_spine(spark).join(F.broadcast(mm), "month", "left")
            .select("month", F.coalesce(F.col("_mm"), gm).alias("predicted")))
