"""REP-1: monitoring of a current or past year (actual vs predicted spend).

Inputs are the base purchases of the forecast window (SRC-5).  One scan makes
the monthly cube; every table below reads the cube (or, given to a function by
itself, the prepared rows: ``aggregates.measures``).  All outputs are DataFrames: ``headline`` (1 row), ``monthly`` (12 rows),
``breakdown`` (top values per dimension) and ``alerts``.
"""

from __future__ import annotations

import functools
from typing import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import fixed
from ..functions import scalars as S
from ..functions import text as X
from ..operators import aggregates as A
from ..operators import rules as R
from ..params import Params
from ..schema import InsufficientData


def prepare(purchases: DataFrame) -> DataFrame:
    """SCA-1/2 + FIL-4: parse the order date, add year/month, keep amount > 0
    and a known year."""
    d = S.parse_date("order_date", purchases.schema["order_date"].dataType)
    return (purchases.withColumn("order_date", d)
            .withColumn("amount", S.nan_to_null("amount"))
            .withColumn("year", F.year("order_date"))
            .withColumn("month", F.month("order_date"))
            .where((F.col("amount") > 0) & F.col("year").isNotNull()))


def split_history(prepared: DataFrame, year: int) -> tuple[DataFrame, DataFrame]:
    """FIL-6: (target-year rows, rows of earlier years)."""
    return prepared.where(F.col("year") == year), prepared.where(F.col("year") < year)


def months_elapsed(year: int, p: Params) -> int:
    """Months used by the year-end run rate: the as-of month for the as-of
    year, 12 for past years (never the wall clock)."""
    if year < p.as_of.year:
        return 12
    return p.as_of.month


def headline(cube: DataFrame, year: int, p: Params, budget: float | None = None) -> DataFrame:
    """One row: actual year-to-date, predicted total, deviation, budget
    position and the year-end projection (AGG-3/4, SCA-8/10/11)."""
    ydf, hist = split_history(A.measures(A.totals(cube)), year)
    actual = ydf.agg(F.sum("amount").alias("actual"), A.orders_of().alias("target_rows"))
    pred = A.predicted_annual_total(hist, p.trend_years, p.trend_divisor)
    h = actual.withColumn("predicted", A.scalar(pred, "predicted"))
    b = F.lit(budget).cast("double")
    dev = F.col("actual") - F.col("predicted")
    proj = S.year_end_projection("actual", "predicted", F.lit(months_elapsed(year, p)), p.linear_weight)
    has_budget = b.isNotNull() & (b != 0)
    return h.select(
        F.lit(year).cast("int").alias("year"),
        F.lit(fixed.MODE_MONITORING).alias("mode"),
        "actual", "predicted",
        dev.alias("deviation"),
        F.when(F.col("predicted") > 0, dev / F.col("predicted") * 100.0)
        .otherwise(F.lit(0.0)).alias("deviation_pct"),
        b.alias("budget"),
        F.when(has_budget, b - F.col("actual")).alias("remaining"),
        proj.alias("year_end_projection"),
        "target_rows",
    )


def monthly(cube: DataFrame, year: int, p: Params, intervals: bool = True,
            basis: str = "order_mean") -> DataFrame:
    """12 rows: predicted (historical mean order of the month), actual,
    deviation, deviation %, and a +-15 % band (AGG-5/6, JOIN-6, SCA-8/9/16)."""
    ydf, hist = split_history(A.totals(cube), year)
    spine = A.month_spine(cube.sparkSession)
    act = F.broadcast(A.monthly_actual(ydf))            # <= 12 rows
    hm = F.broadcast(A.monthly_history_mean(hist, basis))  # <= 12 rows
    m = spine.join(act, "month", "left").join(hm, "month", "left").select(
        "month",
        F.coalesce("actual_sum", F.lit(0.0)).alias("_a"),
        F.coalesce("hist_mean", F.lit(0.0)).alias("predicted"),
    )
    dev, pct = S.deviation("_a", "predicted")
    lo, hi = S.interval_band("predicted", p.month_band, intervals)
    return m.select(
        "month", S.month_name("month").alias("month_name"), "predicted",
        F.when(F.col("_a") > 0, F.col("_a")).alias("actual"),
        dev.alias("deviation"), pct.alias("deviation_pct"),
        lo.alias("lower"), hi.alias("upper"),
    )


def breakdown(cube: DataFrame, year: int, dimensions: Sequence[str], top: int = 10) -> DataFrame:
    """AGG-8 over the target year."""
    ydf, _ = split_history(cube, year)
    return A.dimension_breakdown(ydf, dimensions, top)


def alerts(head: DataFrame, p: Params) -> DataFrame:
    """RUL-1 over the one-row headline."""
    pct = F.col("deviation_pct")
    real, pred, b, proj = F.col("actual"), F.col("predicted"), F.col("budget"), F.col("year_end_projection")
    lo, hi = p.alert_dev
    direction = F.when(pct > 0, F.lit(fixed.TXT_DEV_OVER)).otherwise(F.lit(fixed.TXT_DEV_UNDER))
    has_budget = b.isNotNull() & (b != 0)
    rules = [
        (F.abs(pct) > lo, dict(
            type=fixed.ALERT_BUDGET,
            severity=F.when(F.abs(pct) > hi, fixed.SEV_CRITICAL).otherwise(fixed.SEV_HIGH),
            title=X.template(fixed.TXT_DEV_TITLE, dir=direction),
            description=X.template(fixed.TXT_DEV_DESC, pct=X.fixed1(F.abs(pct)), dir=direction,
                                   real=X.money(real), pred=X.money(pred)),
            observed=real, expected=pred)),
        (has_budget & (real > b * p.budget_used), dict(
            type=fixed.ALERT_BUDGET, severity=fixed.SEV_CRITICAL,
            title=fixed.TXT_BUDGET_TITLE,
            description=X.template(fixed.TXT_BUDGET_DESC, pct=X.fixed1(real / b * 100.0),
                                   budget=X.money(b)),
            observed=real, expected=b)),
        (has_budget & (proj > b), dict(
            type=fixed.ALERT_BUDGET, severity=fixed.SEV_HIGH,
            title=fixed.TXT_PROJ_TITLE,
            description=X.template(fixed.TXT_PROJ_DESC, proj=X.money(proj), excess=X.money(proj - b)),
            observed=proj, expected=b)),
    ]
    return R.alerts(head, rules)


class MonitoringReport:
    """REP-1 tables, each planned on first access, all from one monthly cube."""

    def __init__(self, purchases: DataFrame, year: int, p: Params, budget: float | None = None,
                 dimensions: Sequence[str] = (), intervals: bool = True):
        self.prepared = prepare(purchases)
        self.year, self.p, self.budget = year, p, budget
        self.dimensions, self.intervals = list(dimensions), intervals

    @functools.cached_property
    def cube(self) -> DataFrame:
        return A.monthly_cube(self.prepared, self.dimensions, self.year)

    @functools.cached_property
    def headline(self) -> DataFrame:
        return A.keep_small(headline(self.cube, self.year, self.p, self.budget))   # one row

    @functools.cached_property
    def monthly(self) -> DataFrame:
        return monthly(self.cube, self.year, self.p, self.intervals)

    @functools.cached_property
    def breakdown(self) -> DataFrame:
        return breakdown(self.cube, self.year, self.dimensions)

    @functools.cached_property
    def alerts(self) -> DataFrame:
        return alerts(self.headline, self.p)


def monitoring_report(purchases: DataFrame, year: int, p: Params, budget: float | None = None,
                      dimensions: Sequence[str] = (), intervals: bool = True) -> MonitoringReport:
    """REP-1 over the purchases of the forecast window; raises ``InsufficientData``
    where the year or its history holds no valid rows (read from the cube)."""
    report = MonitoringReport(purchases, year, p, budget, dimensions, intervals)
    seen = A.totals(report.cube).agg(A.orders_of(F.col("year") == year).alias("target"),
                                     A.orders_of(F.col("year") < year).alias("history")).first()
    if not seen["target"]:
        raise InsufficientData(f"no valid rows in {year}")
    if not seen["history"]:
        raise InsufficientData(f"no valid rows before {year}")
    return report
