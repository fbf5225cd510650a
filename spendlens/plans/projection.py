"""REP-2/REP-3: projection of a future year, and the dynamic dispatcher.

Total: the amount model's summed predictions (``method="model"``, a fitted
``PipelineModel``) or the explicit naive rule -- latest-year spend x 1.05
(``method="naive"``, the reference's fallback; no silent catch).
Monthly: the seasonal model (ML-7) with missing months filled (JOIN-7).
Breakdown: the latest year's actual spend per dimension value (ML-9).

Everything but the amount model comes from one monthly cube, one scan.
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
from ..operators import features as FE
from ..operators import forecast as FC
from ..operators import rules as R
from ..operators.ranks import placed
from ..params import Params
from ..schema import InsufficientData
from ..session import materialize
from . import monitoring as M


def sufficiency_checks(prepared: DataFrame, p: Params, target_year: int | None = None) -> DataFrame:
    """FIL-13: (check, ok, observed, needed) in one conditional aggregate."""
    aggs = [A.orders_of().alias("_rows")]
    if target_year is not None:
        aggs += [A.orders_of(F.col("year") == target_year).alias("_target"),
                 A.orders_of(F.col("year") < target_year).alias("_hist")]
    one = A.measures(A.totals(prepared)).agg(*aggs)
    items = [F.struct(F.lit("not_empty").alias("check"), (F.col("_rows") > 0).alias("ok"),
                      F.col("_rows").alias("observed"), F.lit(1).cast("bigint").alias("needed")),
             F.struct(F.lit("min_rows").alias("check"), (F.col("_rows") >= p.min_rows).alias("ok"),
                      F.col("_rows").alias("observed"), F.lit(p.min_rows).cast("bigint").alias("needed"))]
    if target_year is not None:
        items += [F.struct(F.lit("target_year_rows").alias("check"), (F.col("_target") > 0).alias("ok"),
                           F.col("_target").alias("observed"), F.lit(1).cast("bigint").alias("needed")),
                  F.struct(F.lit("history_rows").alias("check"), (F.col("_hist") > 0).alias("ok"),
                           F.col("_hist").alias("observed"), F.lit(1).cast("bigint").alias("needed"))]
    return one.select(F.explode(F.array(*items)).alias("c")).select("c.*")


def require(checks: DataFrame, names: Sequence[str]) -> None:
    """Raise ``InsufficientData`` where one of the named checks fails (one small
    aggregate job)."""
    failed = [f"{r['check']}: {r['observed']} of {r['needed']}" for r in checks.collect()
              if r["check"] in names and not r["ok"]]
    if failed:
        raise InsufficientData("; ".join(failed))


def naive_total(latest: DataFrame, p: Params) -> DataFrame:
    """ML-6: latest-year spend x growth factor (one row)."""
    return latest.agg((F.sum("amount") * p.naive_growth).alias("projected_total"))


def monthly(prepared: DataFrame, target_year: int, p: Params, intervals: bool = True) -> DataFrame:
    """ML-7 + JOIN-7 + SCA-16/17: 12 monthly rows for the target year."""
    cube = A.totals(prepared)
    fc = A.keep_small(FC.seasonal_forecast(cube, target_year, p.confidence, intervals))  # <= 12 rows
    filled = FC.fill_missing_months(fc, cube)
    return filled.select("month", S.month_name("month").alias("month_name"), "predicted",
                         "lower", "upper", "source")


def dimension_forecast(latest: DataFrame, dimensions: Sequence[str], top: int = 10) -> DataFrame:
    """ML-9: breakdown of the latest year's actual amounts (as AGG-8)."""
    return A.dimension_breakdown(latest, dimensions, top)


def scale_to_total(parts: DataFrame, total: DataFrame) -> DataFrame:
    """ML-9 scaled: the one-row ``projected_total`` dealt to the values of each
    dimension in proportion to their ``total`` - (dimension, value, total, scaled).

    In cents, by largest remainders: every value gets the whole cents of its share,
    and the cents left over go to the largest remainders (ties: by value), so the
    parts of a dimension add up to the total exactly.  Values without positive spend
    get nothing; a dimension without any stays unscaled (null).  Remainders are
    ranked across partitions (``ranks.placed``), so a dimension may have any number
    of values.
    """
    cents = lambda c: F.round(c * 100).cast("decimal(38,0)")        # noqa: E731
    whole = F.greatest(cents(A.scalar(total, "projected_total")), F.lit(0).cast("decimal(38,0)"))
    g = parts.select("dimension", "value", "total", F.greatest(cents(F.col("total")), F.lit(0).cast("decimal(38,0)")).alias("part"))
    sums = g.groupBy("dimension").agg(F.sum("part").cast("decimal(38,0)").alias("parts"))
    g = g.join(F.broadcast(sums), "dimension").where(F.col("parts") > 0).withColumn("whole", whole)   # a row a dimension
    g = g.withColumns({"share": F.expr("whole * part div parts"), "rest": F.expr("cast(whole * part % parts as decimal(38,0))")})
    given = materialize(g, "scaled-shares")
    left = given.groupBy("dimension").agg((F.max("whole") - F.sum("share")).cast("bigint").alias("over"))
    ranked = placed(given, "dimension", [F.col("rest").desc(), F.col("value")], "scaled-ranks").join(F.broadcast(left), "dimension")
    return ranked.select("dimension", "value", "total",
                         ((F.col("share") + F.when(F.col("pos") < F.col("over"), 1).otherwise(0)) / 100.0).alias("scaled"))


def headline(prepared: DataFrame, total: DataFrame, p: Params, target_year: int,
             budget: float | None = None, intervals: bool = True) -> DataFrame:
    """One row: projected total, +-10 % band, budget difference, confidence,
    months of history (SCA-9, SCA-11, AGG-28)."""
    b = F.lit(budget).cast("double")
    diff, pct = S.budget_position(b, F.col("projected_total"))
    hm = A.scalar(A.history_months(A.totals(prepared)), "history_months")
    lo, hi = S.interval_band("projected_total", p.year_band, intervals)
    return total.withColumn("history_months", hm).select(
        F.lit(target_year).cast("int").alias("year"), F.lit(fixed.MODE_PROJECTION).alias("mode"),
        "projected_total", lo.alias("lower"), hi.alias("upper"), b.alias("budget"),
        diff.alias("difference"), pct.alias("difference_pct"),
        F.lit(p.confidence).alias("confidence"), F.col("history_months").cast("int").alias("history_months"))


def alerts(head: DataFrame, p: Params) -> DataFrame:
    """RUL-2: projected total over budget by > 5 % (high) / > 15 % (critical)."""
    pct, proj, b = F.col("difference_pct"), F.col("projected_total"), F.col("budget")
    lo, hi = p.proj_dev
    rules = [(b.isNotNull() & (b != 0) & pct.isNotNull() & (pct != 0) & (pct > lo), dict(
        type=fixed.ALERT_BUDGET,
        severity=F.when(pct > hi, fixed.SEV_CRITICAL).otherwise(fixed.SEV_HIGH),
        title=fixed.TXT_PROJ_TITLE,
        description=X.template(fixed.TXT_PROJ2_DESC, proj=X.money(proj), pct=X.fixed1(pct),
                               excess=X.money(proj - b)),
        observed=proj, expected=b))]
    return R.alerts(head, rules)


class ProjectionReport:
    """REP-2 tables, each planned on first access."""

    def __init__(self, purchases: DataFrame, target_year: int, p: Params, budget: float | None = None,
                 dimensions: Sequence[str] = (), intervals: bool = True, method: str = "naive", model=None):
        if method not in ("naive", "model"):
            raise ValueError(f"unknown method {method!r}")
        self.prepared = FE.prepare(purchases)
        self.year, self.p, self.budget = target_year, p, budget
        self.dimensions, self.intervals, self.method, self.model = list(dimensions), intervals, method, model

    @functools.cached_property
    def cube(self) -> DataFrame:
        return A.monthly_cube(self.prepared, self.dimensions)

    @functools.cached_property
    def slice(self) -> DataFrame:
        """The latest year's cells (no feature frame needed)."""
        last = A.scalar(A.totals(self.cube).agg(F.max("year").alias("last")), "last")
        return self.cube.where(F.col("year") == last)

    @functools.cached_property
    def total(self) -> DataFrame:
        if self.method == "naive":
            return A.keep_small(naive_total(A.totals(self.slice), self.p))
        from ..operators import model as ML
        return A.keep_small(ML.predicted_total(ML.score(self.model, ML.features(self.model, self.prepared, self.year))))

    @functools.cached_property
    def headline(self) -> DataFrame:
        return headline(self.cube, self.total, self.p, self.year, self.budget, self.intervals)

    @functools.cached_property
    def monthly(self) -> DataFrame:
        return monthly(self.cube, self.year, self.p, self.intervals)

    @functools.cached_property
    def breakdown(self) -> DataFrame:
        return dimension_forecast(self.slice, self.dimensions)

    @functools.cached_property
    def scaled_breakdown(self) -> DataFrame:
        """The projected total dealt to all values of the dimensions."""
        parts = (self.slice.where(F.col("dimension") != A.ALL).groupBy("dimension", "value").agg(F.sum("amount").alias("total")))
        return scale_to_total(parts, self.total)

    @functools.cached_property
    def alerts(self) -> DataFrame:
        return alerts(self.headline, self.p)

    @functools.cached_property
    def checks(self) -> DataFrame:
        return sufficiency_checks(self.cube, self.p)


def projection_report(purchases: DataFrame, target_year: int, p: Params, budget: float | None = None,
                      dimensions: Sequence[str] = (), intervals: bool = True,
                      method: str = "naive", model=None) -> ProjectionReport:
    report = ProjectionReport(purchases, target_year, p, budget, dimensions, intervals, method, model)
    require(report.checks, ["not_empty", "min_rows"])
    return report


def forecast_dynamic(purchases: DataFrame, target_year: int, p: Params, budget: float | None = None,
                     dimensions: Sequence[str] = (), intervals: bool = True,
                     method: str = "naive", model=None):
    """REP-3: monitoring for years up to the as-of year, projection after it."""
    if target_year <= p.as_of.year:
        return M.monitoring_report(purchases, target_year, p, budget, dimensions, intervals)
    return projection_report(purchases, target_year, p, budget, dimensions, intervals, method, model)


def dynamic_headline(report) -> DataFrame:
    """Common one-row view of either report: year, mode, total, reference
    total, budget, budget gap, alert count."""
    h = report.headline
    n = A.scalar(report.alerts.agg(F.count(F.lit(1)).alias("alerts")), "alerts")
    if "actual" in h.columns:
        v = h.select("year", "mode", F.col("actual").alias("total"), F.col("predicted").alias("reference_total"),
                     "budget", F.col("remaining").alias("budget_gap"))
    else:
        v = h.select("year", "mode", F.col("projected_total").alias("total"),
                     F.lit(None).cast("double").alias("reference_total"), "budget",
                     F.col("difference").alias("budget_gap"))
    return v.withColumn("alerts", n)
