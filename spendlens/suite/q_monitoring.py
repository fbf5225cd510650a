"""REP-1 and its parts: AGG-2..6, JOIN-6, AGG-8, SCA-8..11/16, RUL-1."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import aggregates as A
from ..plans import monitoring as M
from ..sources import purchases as P
from .core import ALL_DIMS, BUDGET, PARAMS, YEAR, base, r, register

# Forecast window of 2001 (1996..2001), prepared (amount > 0, known year).
PREP = """
prep AS (SELECT *, CAST(year(order_date) AS INTEGER) AS year,
                CAST(month(order_date) AS INTEGER) AS month
         FROM purchases
         WHERE order_date >= TIMESTAMP '1996-01-01' AND order_date < TIMESTAMP '2002-01-01'
           AND amount > 0),
ydf AS (SELECT * FROM prep WHERE year = 2001),
hist AS (SELECT * FROM prep WHERE year < 2001)"""

PRED = PREP + """,
annual AS (SELECT year, SUM(amount) AS total FROM hist GROUP BY year),
ranked AS (SELECT *, row_number() OVER (ORDER BY year DESC) AS rn FROM annual),
pred AS (SELECT avg(total) AS mean_total, count(*) AS years,
                CASE WHEN count(*) >= 3 THEN
                  (max(CASE WHEN rn = 1 THEN total END) - max(CASE WHEN rn = 3 THEN total END)) / 3.0
                END AS trend
         FROM ranked),
pred2 AS (SELECT *, CASE WHEN years >= 3 THEN mean_total + trend ELSE mean_total END AS predicted
          FROM pred)"""

HEAD = PRED + """,
act AS (SELECT SUM(amount) AS actual, count(*) AS target_rows FROM ydf),
head AS (
  SELECT 2001 AS year, 'monitoreo' AS mode, actual, predicted, actual - predicted AS deviation,
         CASE WHEN predicted > 0 THEN (actual - predicted) / predicted * 100.0 ELSE 0.0 END
           AS deviation_pct,
         CAST(450000000.0 AS DOUBLE) AS budget, 450000000.0 - actual AS remaining,
         (actual / 8) * 12.0 * 0.6 + predicted * 0.4 AS year_end_projection, target_rows
  FROM act, pred2)"""

MONTHLY = PREP + """,
spine AS (SELECT CAST(range AS INTEGER) AS month FROM range(1, 13)),
ma AS (SELECT month, SUM(amount) AS actual_sum FROM ydf GROUP BY month),
mh AS (SELECT month, (sum(round(amount * 10000)::HUGEINT)::DOUBLE / 10000 / count(amount)) AS hist_mean FROM hist GROUP BY month),
mm AS (SELECT s.month, coalesce(ma.actual_sum, 0.0) AS a, coalesce(mh.hist_mean, 0.0) AS predicted
       FROM spine s LEFT JOIN ma USING (month) LEFT JOIN mh USING (month)),
monthly AS (
  SELECT month, (%s)[month] AS month_name, predicted,
         CASE WHEN a > 0 THEN a END AS actual,
         CASE WHEN a > 0 AND a - predicted <> 0 THEN a - predicted END AS deviation,
         CASE WHEN predicted > 0 AND a > 0 AND a - predicted <> 0
              THEN (a - predicted) / predicted * 100.0 END AS deviation_pct,
         CASE WHEN predicted * 0.85 <> 0 THEN predicted * 0.85 END AS lower,
         CASE WHEN predicted * 1.15 <> 0 THEN predicted * 1.15 END AS upper
  FROM mm)""" % "['Enero','Febrero','Marzo','Abril','Mayo','Junio','Julio','Agosto','Septiembre','Octubre','Noviembre','Diciembre']"


BREAKDOWN_SELECT = """
SELECT dimension, value, total, mean, orders,
       CASE WHEN all_total > 0 THEN total / all_total * 100.0 ELSE 0.0 END AS share_pct,
       CAST(rk AS INTEGER) AS rank
FROM (SELECT *, sum(total) OVER (PARTITION BY dimension) AS all_total,
             row_number() OVER (PARTITION BY dimension ORDER BY total DESC, value ASC) AS rk
      FROM g) WHERE rk <= 10"""
BREAKDOWN_CTES = PREP + """,
u AS (UNPIVOT (SELECT origin AS ORIGEN, unit AS UN, category AS CATEGORIA, class AS CLASE,
                      family AS FAMILIA, destination AS DESTINO, company AS EMPRESA, amount FROM ydf)
      ON ORIGEN, UN, CATEGORIA, CLASE, FAMILIA, DESTINO, EMPRESA
      INTO NAME dimension VALUE value),
g AS (SELECT dimension, value, SUM(amount) AS total, (sum(round(amount * 10000)::HUGEINT)::DOUBLE / 10000 / count(amount)) AS mean, count(*) AS orders
      FROM u WHERE value IS NOT NULL GROUP BY dimension, value)"""

ALERTS_SELECT = """
SELECT * FROM (
  SELECT 1 AS alert_no, 'desviacion_presupuesto' AS type,
         CASE WHEN abs(deviation_pct) > 20 THEN 'critico' ELSE 'alto' END AS severity,
         'Desviación ' || dir || ' lo predicho' AS title,
         'El gasto real está ' || format('{:.1f}', abs(deviation_pct)) || '% ' || dir
           || ' la predicción. Real: $' || format('{:,.2f}', actual) || ' vs Predicho: $'
           || format('{:,.2f}', predicted) AS description,
         actual AS observed, predicted AS expected, CAST(NULL AS VARCHAR) AS dimension
  FROM (SELECT *, CASE WHEN deviation_pct > 0 THEN 'sobre' ELSE 'bajo' END AS dir FROM head)
  WHERE abs(deviation_pct) > 10
  UNION ALL
  SELECT 2, 'desviacion_presupuesto', 'critico', 'Presupuesto cerca de agotarse',
         'Se ha consumido el ' || format('{:.1f}', actual / budget * 100.0)
           || '% del presupuesto asignado. Presupuesto: $' || format('{:,.2f}', budget),
         actual, budget, NULL
  FROM head WHERE budget IS NOT NULL AND budget <> 0 AND actual > budget * 0.9
  UNION ALL
  SELECT 3, 'desviacion_presupuesto', 'alto', 'Proyección excede presupuesto',
         'La proyección de fin de año ($' || format('{:,.2f}', year_end_projection)
           || ') excede el presupuesto en $' || format('{:,.2f}', year_end_projection - budget),
         year_end_projection, budget, NULL
  FROM head WHERE budget IS NOT NULL AND budget <> 0 AND year_end_projection > budget)"""

HEAD_R = r("actual, budget, remaining") | r("predicted, deviation, year_end_projection", 4) | r("deviation_pct", 6)
MONTH_R = r("actual") | r("deviation, lower, upper", 4) | r("predicted, deviation_pct", 6)


def _prepared(spark, sf):
    return M.prepare(P.forecast_history_window(base(spark, sf), YEAR, PARAMS))


def _cube(spark, sf, dimensions=()):
    """The monthly cube of the report window: one scan for all tables."""
    return A.monthly_cube(_prepared(spark, sf), dimensions, YEAR)


@register("monitoring_headline", "SELECT * FROM head", ctes=HEAD, rounding=HEAD_R)
def monitoring_headline(spark, sf):
    """REP-1 headline: actual YTD, predicted total, deviation, budget, year-end projection."""
    return M.headline(_cube(spark, sf), YEAR, PARAMS, BUDGET)


@register("monitoring_monthly", "SELECT * FROM monthly", ctes=MONTHLY, rounding=MONTH_R)
def monitoring_monthly(spark, sf):
    """REP-1 monthly table: 12 rows, actual vs historical mean order per month."""
    return M.monthly(_cube(spark, sf), YEAR, PARAMS, intervals=True)


@register("annual_totals", "SELECT year, SUM(amount) AS total FROM hist GROUP BY year",
          ctes=PREP, rounding=r("total"))
def annual_totals(spark, sf):
    """AGG-2: spend per history year."""
    _, hist = M.split_history(_cube(spark, sf), YEAR)
    return A.annual_totals(hist)


@register("predicted_annual_total", "SELECT mean_total, years, trend, predicted FROM pred2",
          ctes=PRED, rounding=r("mean_total, trend, predicted", 4))
def predicted_annual_total(spark, sf):
    """AGG-3: mean annual total plus the 3-year trend term."""
    _, hist = M.split_history(_cube(spark, sf), YEAR)
    return A.predicted_annual_total(hist, PARAMS.trend_years, PARAMS.trend_divisor)


@register("ytd_actual", "SELECT SUM(amount) AS actual FROM ydf", ctes=PREP, rounding=r("actual"))
def ytd_actual(spark, sf):
    """AGG-4: target-year spend."""
    ydf, _ = M.split_history(_cube(spark, sf), YEAR)
    return A.sum_amount(ydf, "actual")


@register("monthly_actual", "SELECT month, SUM(amount) AS actual_sum FROM ydf GROUP BY month",
          ctes=PREP, rounding=r("actual_sum"))
def monthly_actual(spark, sf):
    """AGG-5: target-year spend per month."""
    ydf, _ = M.split_history(_cube(spark, sf), YEAR)
    return A.monthly_actual(ydf)


@register("monthly_history_mean", "SELECT month, (sum(round(amount * 10000)::HUGEINT)::DOUBLE / 10000 / count(amount)) AS hist_mean FROM hist GROUP BY month",
          ctes=PREP, rounding=r("hist_mean", 6))
def monthly_history_mean(spark, sf):
    """AGG-6: mean order amount per month over the history years."""
    _, hist = M.split_history(_cube(spark, sf), YEAR)
    return A.monthly_history_mean(hist)


@register("month_spine", "SELECT month, a AS actual, predicted FROM mm", ctes=MONTHLY,
          rounding=r("actual") | r("predicted", 6))
def month_spine(spark, sf):
    """JOIN-6: months 1..12 left-joined to the two monthly aggregates, missing -> 0."""
    ydf, hist = M.split_history(_cube(spark, sf), YEAR)
    spine = A.month_spine(spark)
    return (spine.join(F.broadcast(A.monthly_actual(ydf)), "month", "left")
            .join(F.broadcast(A.monthly_history_mean(hist)), "month", "left")
            .select("month", F.coalesce("actual_sum", F.lit(0.0)).alias("actual"),
                    F.coalesce("hist_mean", F.lit(0.0)).alias("predicted")))


@register("deviation", "SELECT month, actual, predicted, deviation, deviation_pct FROM monthly",
          ctes=MONTHLY, rounding=r("actual") | r("deviation", 4) | r("predicted, deviation_pct", 6))
def deviation(spark, sf):
    """SCA-8: deviation and deviation % per month (zero -> null)."""
    return monitoring_monthly(spark, sf).select("month", "actual", "predicted", "deviation", "deviation_pct")


@register("interval_band", "SELECT month, predicted, lower, upper FROM monthly",
          ctes=MONTHLY, rounding=r("lower, upper", 4) | r("predicted", 6))
def interval_band(spark, sf):
    """SCA-9: +-15 % band around the monthly prediction."""
    return monitoring_monthly(spark, sf).select("month", "predicted", "lower", "upper")


@register("month_name", "SELECT month, month_name FROM monthly", ctes=MONTHLY)
def month_name(spark, sf):
    """SCA-16: month names of the monthly table."""
    return monitoring_monthly(spark, sf).select("month", S.month_name("month").alias("month_name"))


@register("year_end_projection",
          "SELECT year, actual, predicted, 8 AS months_elapsed, year_end_projection FROM head",
          ctes=HEAD, rounding=r("actual") | r("predicted, year_end_projection", 4))
def year_end_projection(spark, sf):
    """SCA-10: 0.6 x run-rate x 12 + 0.4 x predicted, run rate from the as-of month."""
    h = monitoring_headline(spark, sf)
    return h.select("year", "actual", "predicted",
                    F.lit(M.months_elapsed(YEAR, PARAMS)).alias("months_elapsed"),
                    "year_end_projection")


@register("budget_position", "SELECT year, actual, budget, remaining FROM head",
          ctes=HEAD, rounding=r("actual, budget, remaining"))
def budget_position(spark, sf):
    """SCA-11: remaining budget = budget - actual."""
    return monitoring_headline(spark, sf).select("year", "actual", "budget", "remaining")


@register("dimension_breakdown", BREAKDOWN_SELECT, ctes=BREAKDOWN_CTES,
          rounding=r("total") | r("mean, share_pct", 6))
def dimension_breakdown(spark, sf):
    """AGG-8 + TOP-1: top-10 values per dimension of 2001 with share of total."""
    return M.breakdown(_cube(spark, sf, ALL_DIMS), YEAR, ALL_DIMS)


@register("monitoring_alerts", ALERTS_SELECT, ctes=HEAD, rounding=r("observed, expected", 4))
def monitoring_alerts(spark, sf):
    """RUL-1: deviation, budget-consumption and projection-over-budget alerts."""
    head = M.headline(_cube(spark, sf), YEAR, PARAMS, BUDGET)
    return M.alerts(head, PARAMS)
