"""EXT-1..5: dashboard extracts over the monitoring/projection report tables."""

from __future__ import annotations

from .. import fixed
from ..plans import anomalies as AN
from ..plans import extracts as E
from ..plans import monitoring as M
from ..plans import projection as PR
from ..sources import purchases as P
from . import q_anomalies as QA
from . import q_monitoring as QM
from . import q_projection as QP
from .core import ALL_DIMS, BUDGET, NEXT_YEAR, PARAMS, PROJ_BUDGET, YEAR, base, r, register

ALL = (QM.HEAD + QM.MONTHLY[len(QM.PREP):] + QM.BREAKDOWN_CTES[len(QM.PREP):]
       + ",\nbd AS (" + QM.BREAKDOWN_SELECT + ")"
       + ",\nmal AS (" + QM.ALERTS_SELECT + ")")


def _large(x: str) -> str:
    return (f"CASE WHEN {x} >= 1e9 THEN '$' || format('{{:.1f}}', {x} / 1e9) || 'B' "
            f"WHEN {x} >= 1e6 THEN '$' || format('{{:.1f}}', {x} / 1e6) || 'M' "
            f"WHEN {x} >= 1e3 THEN '$' || format('{{:.1f}}', {x} / 1e3) || 'K' "
            f"ELSE '$' || format('{{:.0f}}', {x}) END")


def _monitoring(spark, sf):
    return M.monitoring_report(P.forecast_history_window(base(spark, sf), YEAR, PARAMS), YEAR, PARAMS,
                               BUDGET, ALL_DIMS)


@register("extract_monthly_chart", """
SELECT month, month_name AS label, predicted / 1e9 AS predicted_b,
       CASE WHEN actual <> 0 THEN actual / 1e9 END AS actual_b,
       CASE WHEN lower <> 0 THEN lower / 1e9 END AS lower_b,
       CASE WHEN upper <> 0 THEN upper / 1e9 END AS upper_b FROM monthly""", ctes=ALL,
          rounding=r("predicted_b, actual_b, lower_b, upper_b", 12))
def extract_monthly_chart(spark, sf):
    """EXT-1: monthly chart series in billions (falsy -> null)."""
    return E.monthly_chart(_monitoring(spark, sf).monthly)


@register("extract_origin_pie", """
SELECT rank AS slice_no, value AS name, total / 1e9 AS value_b, share_pct AS percentage
FROM bd WHERE dimension = 'ORIGEN' AND rank <= 6""", ctes=ALL, rounding=r("value_b", 12) | r("percentage", 6))
def extract_origin_pie(spark, sf):
    """EXT-2: first six origins: name, total in billions, share."""
    return E.origin_pie(_monitoring(spark, sf).breakdown)


_TREND_DIR = "CASE WHEN deviation_pct IS NULL OR deviation_pct = 0 THEN 'none' " \
             "WHEN deviation_pct > 0 THEN 'up' ELSE 'down' END"
_TREND_TXT = "CASE WHEN deviation_pct IS NOT NULL AND deviation_pct <> 0 " \
             "THEN format('{:.1f}', abs(deviation_pct)) || '%' END"


@register("extract_stat_cards", f"""
SELECT 1 AS card_no, 'Gasto Real' AS title, {_large('actual')} AS value, 'Acumulado a la fecha' AS subtitle,
       {_TREND_DIR} AS trend, {_TREND_TXT} AS trend_text FROM head
UNION ALL
SELECT 2, 'Presupuesto Asignado', {_large('budget')}, 'Restante: ' || {_large('coalesce(remaining, 0.0)')},
       NULL, NULL FROM head
UNION ALL
SELECT 3, 'Proyección Fin Año', {_large('year_end_projection')}, 'Estimado', NULL, NULL FROM head
UNION ALL
SELECT 4, 'Alertas', CAST((SELECT count(*) FROM mal) AS VARCHAR),
       CASE WHEN (SELECT count(*) FROM mal) > 0 THEN (SELECT severity FROM mal ORDER BY alert_no LIMIT 1)
            ELSE 'Sin alertas' END, NULL, NULL""", ctes=ALL)
def extract_stat_cards(spark, sf):
    """EXT-3 (monitoring mode): the four stat cards."""
    rep = _monitoring(spark, sf)
    return E.stat_cards(rep.headline, rep.alerts)


@register("extract_stat_cards_projection", f"""
SELECT 1 AS card_no, 'Proyección Total' AS title, {_large('projected_total')} AS value,
       'Año ' || year AS subtitle, 'none' AS trend, CAST(NULL AS VARCHAR) AS trend_text FROM phead
UNION ALL
SELECT 2, 'Presupuesto Asignado', {_large('budget')}, 'Diferencia: ' || {_large('coalesce(difference, 0.0)')},
       NULL, NULL FROM phead
UNION ALL
SELECT 3, 'Confianza', format('{{:.0f}}', confidence * 100.0) || '%', history_months || ' meses históricos',
       NULL, NULL FROM phead
UNION ALL
SELECT 4, 'Alertas', CAST((SELECT count(*) FROM palerts) AS VARCHAR),
       CASE WHEN (SELECT count(*) FROM palerts) > 0 THEN (SELECT severity FROM palerts ORDER BY alert_no LIMIT 1)
            ELSE 'Sin alertas' END, NULL, NULL""", ctes=QP.HEAD)
def extract_stat_cards_projection(spark, sf):
    """EXT-3 (projection mode): the four stat cards for 2002."""
    rep = PR.projection_report(P.forecast_history_window(base(spark, sf), NEXT_YEAR, PARAMS), NEXT_YEAR,
                               PARAMS, PROJ_BUDGET, ALL_DIMS)
    return E.stat_cards(rep.headline, rep.alerts)


@register("extract_alert_styles", """
SELECT alert_no, severity, title,
       CASE WHEN severity = 'critico' THEN 'red' WHEN severity = 'alto' THEN 'orange' ELSE 'yellow' END AS band,
       CASE severity WHEN 'critico' THEN 'red' WHEN 'alto' THEN 'orange' WHEN 'medio' THEN 'yellow'
                     WHEN 'bajo' THEN 'blue' WHEN 'info' THEN 'gray' END AS palette_color
FROM mal""", ctes=ALL)
def extract_alert_styles(spark, sf):
    """EXT-4: alert colour bands and palette colours."""
    return E.alert_styles(_monitoring(spark, sf).alerts)


@register("formatted_extract", f"""
SELECT month, month_name, {_large('predicted')} AS predicted_large,
       CASE WHEN predicted < 0 THEN '-$' || format('{{:,.0f}}', -predicted)
            ELSE '$' || format('{{:,.0f}}', predicted) END AS predicted_currency,
       CASE WHEN actual IS NOT NULL THEN format('{{:,.0f}}', actual) END AS actual_number,
       CASE WHEN deviation_pct IS NOT NULL THEN format('{{:.1f}}', deviation_pct) || '%' END AS deviation_pct_text,
       CASE WHEN actual IS NOT NULL THEN
         CASE WHEN predicted = 0 THEN 0.0 ELSE (actual - predicted) / predicted * 100.0 END END AS pct_difference
FROM monthly""", ctes=ALL, rounding=r("pct_difference", 6))
def formatted_extract(spark, sf):
    """EXT-5: display columns of the monthly table (B/M/K, currency, number,
    percent, percent difference)."""
    return E.formatted_monthly(_monitoring(spark, sf).monthly)


_ABBR = "[" + ",".join(f"'{m}'" for m in fixed.MONTH_ABBR) + "]"


@register("formatted_rows_extract", f"""
SELECT order_date,
       day(order_date) || ' ' || {_ABBR}[month(order_date)] || ' ' || year(order_date) AS date_text,
       day(order_date) || ' ' || {_ABBR}[month(order_date)] || ' ' || year(order_date) || ', '
         || hour(order_date) || ':' || lpad(CAST(minute(order_date) AS VARCHAR), 2, '0') AS datetime_text,
       CASE WHEN length(detail) <= 50 THEN detail ELSE substr(detail, 1, 50) || '...' END AS text_short
FROM ctx""", ctes=QA.ANOM)
def formatted_rows_extract(spark, sf):
    """EXT-5: medium date, date-time and shortened detail of the top anomalies."""
    rep = AN.anomaly_report(QA._year(spark, sf), PARAMS, "quantile")
    return E.formatted_rows(rep.top)
