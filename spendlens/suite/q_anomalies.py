"""REP-5 and its parts: ML-10/11, FIL-8, AGG-25..27, TOP-2, PRJ-1, SCA-12, RUL-3."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import aggregates as A
from ..plans import anomalies as AN
from ..sources import purchases as P
from .core import PARAMS, base, r, register

ANOM = """
two AS (SELECT *, year(order_date) AS y FROM purchases
        WHERE order_date >= TIMESTAMP '2000-01-01' AND order_date < TIMESTAMP '2002-01-01'),
q AS (SELECT * EXCLUDE (y) FROM two WHERE y = (SELECT max(y) FROM two)),
cl AS (SELECT * FROM q WHERE amount > 0),
thr AS (SELECT quantile_cont(amount, 0.95) AS threshold FROM cl),
fl AS (SELECT cl.*, threshold, coalesce(amount > threshold, false) AS is_anomaly, amount - threshold AS score
       FROM cl, thr),
st AS (SELECT count(*) AS rows_analysed, CAST(count_if(is_anomaly) AS BIGINT) AS anomalies,
              CASE WHEN count(*) > 0 THEN count_if(is_anomaly) / count(*) * 100.0 ELSE 0.0 END AS anomaly_pct,
              coalesce(sum(round(amount * 10000)::HUGEINT) FILTER (NOT is_anomaly)::DOUBLE / 10000 / count(*) FILTER (NOT is_anomaly), 0.0) AS mean_normal,
              coalesce(sum(round(amount * 10000)::HUGEINT) FILTER (is_anomaly)::DOUBLE / 10000 / count(*) FILTER (is_anomaly), 0.0) AS mean_anomalous,
              coalesce(max(CASE WHEN is_anomaly THEN amount END), 0.0) AS max_anomalous
       FROM fl),
ub AS (UNPIVOT (SELECT origin AS ORIGEN, category AS CATEGORIA FROM fl WHERE is_anomaly)
       ON ORIGEN, CATEGORIA INTO NAME dimension VALUE value),
cbd AS (SELECT * FROM (
          SELECT dimension, value, count(*) AS anomalies,
                 CAST(row_number() OVER (PARTITION BY dimension ORDER BY count(*) DESC, value) AS INTEGER) AS rank
          FROM ub WHERE value IS NOT NULL GROUP BY dimension, value) WHERE rank <= 10),
og AS (SELECT origin, count(*) AS n FROM fl WHERE is_anomaly AND origin IS NOT NULL GROUP BY origin),
tos AS (SELECT origin, n AS origin_anomalies, st.anomalies,
               CASE WHEN st.anomalies > 0 THEN n / st.anomalies END AS share
        FROM (SELECT * FROM og ORDER BY n DESC, origin LIMIT 1), st),
ta AS (SELECT * FROM fl WHERE is_anomaly
       ORDER BY amount DESC, order_date ASC NULLS FIRST, request_line ASC NULLS FIRST, detail ASC NULLS FIRST,
                category ASC NULLS FIRST, origin ASC NULLS FIRST LIMIT 20),
ctx AS (SELECT order_date, coalesce(origin, 'N/A') AS origin, coalesce(category, 'N/A') AS category,
               coalesce(destination, 'N/A') AS destination, amount,
               CASE WHEN mean_normal <> 0 THEN (amount - mean_normal) / mean_normal END AS relative_excess,
               score, substr(coalesce(detail, ''), 1, 200) AS detail,
               coalesce(request_id, 'N/A') AS ctx_request_id, coalesce(line_no, 'N/A') AS ctx_line_no,
               coalesce(company, 'N/A') AS ctx_company, coalesce(unit, 'N/A') AS ctx_unit
        FROM ta, st),
aal AS (
  SELECT 1 AS alert_no, 'anomalia' AS type, 'alto' AS severity, 'Alto volumen de anomalías detectadas' AS title,
         'Se detectaron ' || anomalies || ' gastos anómalos. Revisar procesos de aprobación y validación.'
           AS description, CAST(anomalies AS DOUBLE) AS observed, CAST(NULL AS DOUBLE) AS expected,
         CAST(NULL AS VARCHAR) AS dimension
  FROM st WHERE anomalies > 100
  UNION ALL
  SELECT 2, 'gasto_elevado', 'critico', 'Gasto anómalo extremadamente elevado',
         'Gasto máximo anómalo: $' || format('{:,.2f}', max_anomalous) || ' (50x superior al promedio normal de $'
           || format('{:,.2f}', mean_normal) || ')', max_anomalous, mean_normal, NULL
  FROM st WHERE max_anomalous > mean_normal * 50
  UNION ALL
  SELECT 3, 'patron_inusual', 'medio', 'Concentración de anomalías en ' || origin,
         origin_anomalies || ' de ' || anomalies || ' anomalías provienen de ' || origin
           || '. Revisar proceso de compra.', CAST(origin_anomalies AS DOUBLE), NULL, 'ORIGEN'
  FROM tos WHERE origin_anomalies > anomalies * 0.5)"""


#: The top list of the report document beside its counts.
DOC_SQL = """
SELECT st.anomalies AS anomalias, (SELECT value FROM cbd WHERE dimension = 'ORIGEN' AND rank = 1) AS primer_origen,
       ta.amount AS importe, strftime(ta.order_date, '%Y-%m-%d') AS fecha FROM ta, st"""


def _year(spark, sf):
    return P.latest_year_fallback(base(spark, sf), PARAMS.as_of.year)


def _flagged(spark, sf):
    return AN.flag(_year(spark, sf), PARAMS, "quantile")


STAT_R = r("max_anomalous") | r("mean_normal, mean_anomalous, anomaly_pct", 6)


@register("quantile_flag", "SELECT request_line, amount, threshold, is_anomaly, score FROM fl", ctes=ANOM,
          rounding=r("amount") | r("threshold, score", 6))
def quantile_flag(spark, sf):
    """ML-11: amount above its exact 95th percentile (contamination 5 %)."""
    return _flagged(spark, sf).select("request_line", "amount", "threshold", "is_anomaly", "score")


@register("split_flagged", """
SELECT request_line, amount, CASE WHEN is_anomaly THEN 'anomaly' ELSE 'normal' END AS part FROM fl""",
          ctes=ANOM, rounding=r("amount"))
def split_flagged(spark, sf):
    """FIL-8: normal vs anomalous rows by flag."""
    f = _flagged(spark, sf)
    return f.select("request_line", "amount",
                    F.when(F.col("is_anomaly"), "anomaly").otherwise("normal").alias("part"))


@register("anomaly_stats", "SELECT * FROM st", ctes=ANOM, rounding=STAT_R)
def anomaly_stats(spark, sf):
    """AGG-25: analysed, flagged, %, mean normal / flagged, max flagged."""
    return AN.stats(_flagged(spark, sf))


@register("anomaly_counts_by_dimension", "SELECT * FROM cbd", ctes=ANOM)
def anomaly_counts_by_dimension(spark, sf):
    """AGG-26: flagged rows by origin and by category, top 10 each."""
    return AN.counts_by_dimension(_flagged(spark, sf))


@register("top_origin_share", "SELECT * FROM tos", ctes=ANOM, rounding=r("share", 6))
def top_origin_share(spark, sf):
    """AGG-27: origin with most flagged rows and its share."""
    return AN.top_origin_share(_flagged(spark, sf))


@register("top_anomalies", """
SELECT request_line, order_date, origin, category, amount FROM ta""", ctes=ANOM, rounding=r("amount"))
def top_anomalies(spark, sf):
    """TOP-2: top 20 flagged rows by amount."""
    return AN.top_anomalies(_flagged(spark, sf), PARAMS.top_n).select(
        "request_line", "order_date", "origin", "category", "amount")


@register("context_projection", "SELECT * FROM ctx", ctes=ANOM,
          rounding=r("amount") | r("score, relative_excess", 6))
def context_projection(spark, sf):
    """PRJ-1: report rows of the top anomalies with the request context."""
    f = _flagged(spark, sf)
    return AN.context_projection(AN.top_anomalies(f, PARAMS.top_n), AN.stats(f))


@register("relative_excess", "SELECT amount, relative_excess FROM ctx", ctes=ANOM,
          rounding=r("amount") | r("relative_excess", 6))
def relative_excess(spark, sf):
    """SCA-12: (amount - mean normal) / mean normal of the top anomalies."""
    return context_projection(spark, sf).select("amount", "relative_excess")


@register("anomaly_alerts", "SELECT * FROM aal", ctes=ANOM, rounding=r("observed, expected", 6))
def anomaly_alerts(spark, sf):
    """RUL-3: volume, extreme maximum and origin-concentration alerts."""
    f = _flagged(spark, sf)
    return AN.alerts(f, AN.stats(f), PARAMS)


@register("anomaly_report", """
SELECT st.*, (SELECT count(*) FROM ctx) AS top_rows, (SELECT count(*) FROM cbd) AS dimension_rows,
       (SELECT count(*) FROM aal) AS alerts FROM st""", ctes=ANOM, rounding=STAT_R)
def anomaly_report(spark, sf):
    """REP-5 (quantile method): statistics plus the sizes of its sections."""
    rep = AN.anomaly_report(_year(spark, sf), PARAMS, "quantile")
    c = lambda d: A.scalar(d.agg(F.count(F.lit(1)).alias("n")), "n")
    return rep.stats.select("*", c(rep.top).alias("top_rows"), c(rep.by_dimension).alias("dimension_rows"),
                            c(rep.alerts).alias("alerts"))


@register("isolation_scores")
def isolation_scores(spark, sf):
    """ML-10: isolation-forest score of every row with amount > 0 and its flag
    (no exact SQL: the forest is randomised; rows-only check, properties in tests)."""
    f = AN.flag(_year(spark, sf), PARAMS, "forest")
    return f.select("request_line", "amount", "anomaly_score", "is_anomaly")


@register("anomaly_report_forest")
def anomaly_report_forest(spark, sf):
    """REP-5 with the isolation forest: statistics of the flagged rows."""
    return AN.anomaly_report(_year(spark, sf), PARAMS, "forest").stats
