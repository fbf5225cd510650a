"""REP-6 and its parts: AGG-15..19, AGG-29..32, FIL-9..11, JOIN-8/9,
TOP-3/4/5/9, SCA-15/18, RUL-6..9, PRJ-2."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import fixed
from ..operators import aggregates as A
from ..plans import recommend as RC
from ..sources import purchases as P
from .core import PARAMS, YEAR, base, r, register

TREND_DIMS = ["ORIGEN", "UN", "CATEGORIA", "DESTINO", "EMPRESA"]


def _acts(xs):
    return " | ".join(xs)


def _window_sql(y0: int) -> str:
    return f"""
rw AS (SELECT * FROM purchases
       WHERE order_date >= TIMESTAMP '{y0}-01-01' AND order_date < TIMESTAMP '2002-01-01'),
gs AS (SELECT (sum(round(amount * 10000)::HUGEINT)::DOUBLE / 10000 / count(amount)) AS global_mean, sum(amount) AS total_spend, count(*) AS orders,
              quantile_cont(amount, 0.25) AS q25, quantile_cont(amount, 0.75) AS q75 FROM rw),
op AS (SELECT origin, sum(amount) AS total, (sum(round(amount * 10000)::HUGEINT)::DOUBLE / 10000 / count(amount)) AS mean, count(*) AS orders
       FROM rw WHERE origin IS NOT NULL GROUP BY origin),
op2 AS (SELECT op.*, CASE WHEN mean > q75 THEN 'alto' WHEN mean < q25 THEN 'bajo' ELSE 'normal' END
               AS spend_class FROM op, gs),
up AS (SELECT unit, sum(amount) AS total, (sum(round(amount * 10000)::HUGEINT)::DOUBLE / 10000 / count(amount)) AS mean, count(*) AS orders
       FROM rw WHERE unit IS NOT NULL GROUP BY unit),
p75 AS (SELECT quantile_cont(orders, 0.75) AS p75_orders FROM op),
tc AS (SELECT category, sum(amount) AS total FROM rw WHERE category IS NOT NULL
       GROUP BY category ORDER BY total DESC, category LIMIT 3),
tu AS (SELECT * FROM up ORDER BY mean DESC, unit LIMIT 3),
recs_all AS (
  SELECT 1 AS rule_no, origin AS _key, total AS _metric,
         'Optimizar gastos en ' || origin AS title,
         'El origen ' || origin || ' presenta un gasto promedio de $' || format('{{:,.2f}}', mean)
           || ', superior al promedio global. Total acumulado: $' || format('{{:,.2f}}', total) AS description,
         'alto' AS priority, '{fixed.REC1_AREA}' AS area,
         'Ahorro potencial: $' || format('{{:,.2f}}', total * 0.1) || ' (10%)' AS impact,
         '{_acts(fixed.REC1_ACTIONS)}' AS actions
  FROM op2 WHERE spend_class = 'alto'
  UNION ALL
  SELECT 2, origin, total, 'Consolidar pedidos en ' || origin,
         origin || ' tiene ' || format('{{:,}}', orders) || ' pedidos, uno de los volúmenes más altos. '
           || 'La consolidación puede reducir costos operativos.',
         'medio', '{fixed.REC2_AREA}', '{fixed.REC2_IMPACT}', '{_acts(fixed.REC2_ACTIONS)}'
  FROM op, p75 WHERE orders > p75_orders
  UNION ALL
  SELECT 3, unit, mean, 'Revisar procesos de aprobación en ' || unit,
         'La unidad ' || unit || ' tiene un gasto promedio 50% superior al global ($'
           || format('{{:,.2f}}', mean) || '). Total: $' || format('{{:,.2f}}', total),
         'alto', '{fixed.REC3_AREA}', 'Reducción potencial: $' || format('{{:,.2f}}', total * 0.15),
         '{_acts(fixed.REC3_ACTIONS)}'
  FROM tu, gs WHERE mean > global_mean * 1.5
  UNION ALL
  SELECT 4, category, total, 'Estrategia de compra para ' || category,
         category || ' representa $' || format('{{:,.2f}}', total)
           || ' del gasto total. Optimizar esta categoría tiene alto impacto.',
         'alto', '{fixed.REC4_AREA}', 'Impacto potencial: $' || format('{{:,.2f}}', total * 0.08) || ' (8% ahorro)',
         'Desarrollar estrategia específica para ' || category || ' | {_acts(fixed.REC4_ACTIONS[1:])}'
  FROM tc
  UNION ALL
  SELECT 5, unit, total, 'Consolidar compras de ' || unit || ' con otras unidades',
         unit || ' tiene solo ' || orders || ' pedidos. Consolidar con otras UNs puede mejorar poder de negociación.',
         'medio', '{fixed.REC5_AREA}', '{fixed.REC5_IMPACT}', '{_acts(fixed.REC5_ACTIONS)}'
  FROM up WHERE orders < 100),
recs AS (SELECT CAST(row_number() OVER (ORDER BY rule_no, _metric DESC, _key) AS INTEGER) AS rec_no,
                rule_no, title, description, priority, area, impact, actions
         FROM (SELECT * FROM recs_all ORDER BY rule_no, _metric DESC, _key LIMIT 10)),
o1 AS (SELECT 'Negociación de Proveedores' AS kind, 'ORIGEN' AS dimension, origin AS value,
              'Renegociar precios con ' || origin AS description, total AS spend, total * 0.15 AS saving,
              CAST(15.0 AS DOUBLE) AS saving_pct, 'Media' AS complexity, '3-6 meses' AS lead_time
       FROM op, gs WHERE mean > global_mean * 1.3),
so AS (SELECT count(*) AS small_orders, sum(amount) AS small_spend FROM rw, gs WHERE amount < q25),
o2 AS (SELECT 'Consolidación de Compras', 'OPERACIONAL', 'Pedidos pequeños',
              'Consolidar ' || format('{{:,}}', small_orders) || ' pedidos pequeños',
              coalesce(small_spend, 0.0), coalesce(small_spend, 0.0) * 0.1, CAST(10.0 AS DOUBLE), 'Baja', '1-3 meses'
       FROM so WHERE small_orders > 1000),
opps AS (SELECT CAST(row_number() OVER (ORDER BY saving DESC, value) AS INTEGER) AS opp_no, *
         FROM (SELECT * FROM (SELECT * FROM o1 UNION ALL SELECT * FROM o2)
               ORDER BY saving DESC, value LIMIT 5)),
ss AS (SELECT sum(amount) AS total_spend, count(*) AS orders, (sum(round(amount * 10000)::HUGEINT)::DOUBLE / 10000 / count(amount)) AS mean FROM rw),
sv AS (SELECT coalesce(sum(saving), 0.0) AS saving, count(*) AS opportunities FROM opps),
spend AS (SELECT ss.*, sv.saving, sv.opportunities, sv.saving / ss.total_spend * 100.0 AS saving_pct
          FROM ss, sv),
pa AS (SELECT rec_no, title FROM recs WHERE priority IN ('critico', 'alto') ORDER BY rec_no LIMIT 3),
pai AS (SELECT *, row_number() OVER (ORDER BY rec_no) AS i FROM pa),
summ AS (SELECT
  'RESUMEN EJECUTIVO - ANÁLISIS DE COMPRAS' || chr(10) || chr(10) || '🔹 Situación Actual:' || chr(10)
  || '   • Gasto Total Analizado: $' || format('{{:,.2f}}', total_spend) || chr(10)
  || '   • Total de Pedidos: ' || format('{{:,}}', orders) || chr(10)
  || '   • Gasto Promedio por Pedido: $' || format('{{:,.2f}}', mean) || chr(10) || chr(10)
  || ' Oportunidades Identificadas:' || chr(10)
  || '   • ' || (SELECT count(*) FROM recs) || ' recomendaciones estratégicas generadas' || chr(10)
  || '   • ' || opportunities || ' oportunidades de ahorro cuantificadas' || chr(10)
  || '   • Ahorro Potencial Estimado: $' || format('{{:,.2f}}', saving) || ' ('
  || format('{{:.2f}}', saving_pct) || '% del gasto total)' || chr(10) || chr(10)
  || ' Acciones Prioritarias:' || chr(10)
  || coalesce((SELECT string_agg(chr(10) || '   ' || i || '. ' || title, '' ORDER BY i) FROM pai), '')
  || chr(10) || chr(10) || ' Próximos Pasos: Implementar las ' || (SELECT count(*) FROM pai)
  || ' acciones prioritarias identificadas para maximizar el impacto en los próximos 3-6 meses.'
  AS summary FROM spend),
per AS (SELECT DISTINCT date_trunc('month', order_date) AS period
        FROM rw WHERE order_date IS NOT NULL),
perr AS (SELECT period, row_number() OVER (ORDER BY period DESC) AS rk, count(*) OVER () AS n FROM per),
parts AS (SELECT period, CASE WHEN rk <= 6 THEN 'recent' ELSE 'prior' END AS part
          FROM perr WHERE n >= 12 AND rk <= 12),
u AS (UNPIVOT (SELECT origin AS ORIGEN, unit AS UN, category AS CATEGORIA, destination AS DESTINO,
                      company AS EMPRESA, date_trunc('month', order_date) AS period,
                      amount, request_line FROM rw)
      ON ORIGEN, UN, CATEGORIA, DESTINO, EMPRESA INTO NAME dimension VALUE value),
tv AS (SELECT dimension, value, count(*) AS orders FROM u WHERE value IS NOT NULL GROUP BY dimension, value),
tops AS (SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY dimension ORDER BY orders DESC, value)
                                  AS INTEGER) AS rank FROM tv) WHERE rank <= 5),
rows_ AS (SELECT u.dimension, u.value, u.period, u.amount, u.request_line, parts.part
          FROM u JOIN tops USING (dimension, value) JOIN parts USING (period)),
g AS (SELECT dimension, value,
             sum(CASE WHEN part = 'recent' THEN amount ELSE 0.0 END) AS recent,
             sum(CASE WHEN part = 'prior' THEN amount ELSE 0.0 END) AS prior
      FROM rows_ GROUP BY dimension, value),
chg AS (SELECT t.dimension, t.value, coalesce(g.recent, 0.0) AS recent, coalesce(g.prior, 0.0) AS prior
        FROM tops t LEFT JOIN g USING (dimension, value) WHERE (SELECT count(*) FROM parts) > 0),
chg2 AS (SELECT dimension, value, recent, prior, (recent - prior) / prior * 100.0 AS change_pct,
                CASE WHEN (recent - prior) / prior * 100.0 > 0 THEN 'creciente' ELSE 'decreciente' END
                  AS direction
         FROM chg WHERE prior <> 0),
trends AS (SELECT dimension, value, direction, change_pct, recent, prior FROM chg2
           WHERE abs(change_pct) > 10 ORDER BY abs(change_pct) DESC, dimension, value LIMIT 10)"""


REC = _window_sql(1999)
QUICK = _window_sql(2000)


def _rw(spark, sf, quick=False):
    return P.recommendation_window(base(spark, sf), YEAR, PARAMS, quick=quick)


def _rep(spark, sf, quick=False):
    """The report object: global statistics and profiles are planned once and
    shared by its tables."""
    return RC.recommendation_report(_rw(spark, sf, quick), PARAMS, TREND_DIMS)


def _recs_out(recs):
    return recs.select("rec_no", "rule_no", "title", "description", "priority", "area", "impact",
                       F.array_join("actions", " | ").alias("actions"))


@register("amount_quartiles", "SELECT q25, q75 FROM gs", ctes=REC, rounding=r("q25, q75", 6))
def amount_quartiles(spark, sf):
    """AGG-15: q25 and q75 of amount (linear interpolation), skew-safe exact."""
    return RC.amount_quartiles(_rw(spark, sf), PARAMS)


@register("group_size_p75", "SELECT p75_orders FROM p75", ctes=REC, rounding=r("p75_orders", 6))
def group_size_p75(spark, sf):
    """AGG-16: p75 of the order counts per origin."""
    return RC.group_size_p75(_rw(spark, sf), PARAMS)


@register("origin_profile", "SELECT * FROM op2", ctes=REC, rounding=r("total") | r("mean", 6))
def origin_profile(spark, sf):
    """AGG-17: per origin total, mean, orders, spend class."""
    return _rep(spark, sf).origins


@register("unit_profile", "SELECT * FROM up", ctes=REC, rounding=r("total") | r("mean", 6))
def unit_profile(spark, sf):
    """AGG-18: per non-null unit total, mean, orders."""
    return RC.unit_profile(_rw(spark, sf))


@register("top_categories_by_group", """
SELECT * FROM (
  SELECT group_dimension, group_value, CAST(rk AS INTEGER) AS rank, category, total FROM (
    SELECT *, row_number() OVER (PARTITION BY group_dimension, group_value ORDER BY total DESC, category) AS rk
    FROM (SELECT 'ORIGEN' AS group_dimension, origin AS group_value, category, sum(amount) AS total
          FROM rw WHERE origin IS NOT NULL AND category IS NOT NULL GROUP BY origin, category
          UNION ALL
          SELECT 'UN', unit, category, sum(amount) FROM rw
          WHERE unit IS NOT NULL AND category IS NOT NULL GROUP BY unit, category))
  WHERE rk <= 3)""", ctes=REC, rounding=r("total"))
def top_categories_by_group(spark, sf):
    """AGG-19: top-3 categories by spend inside each origin and each unit."""
    rep = _rep(spark, sf)
    a = rep.origin_top_categories.select(F.lit("ORIGEN").alias("group_dimension"), "*")
    b = rep.unit_top_categories.select(F.lit("UN").alias("group_dimension"), "*")
    return a.unionByName(b)


@register("non_null_unit", "SELECT request_line, unit, amount FROM rw WHERE unit IS NOT NULL",
          ctes=REC, rounding=r("amount"))
def non_null_unit(spark, sf):
    """FIL-11: rows with a known unit (input of the unit profile)."""
    return _rw(spark, sf).where(F.col("unit").isNotNull()).select("request_line", "unit", "amount")


@register("scalar_broadcast", """
SELECT op2.origin, op2.mean, op2.orders, gs.global_mean, gs.q25, gs.q75, p75.p75_orders
FROM op2, gs, p75""", ctes=REC, rounding=r("mean, global_mean, q25, q75, p75_orders", 6))
def scalar_broadcast(spark, sf):
    """JOIN-9: each origin next to the global scalars (mean, q25, q75, p75 of counts)."""
    rep = _rep(spark, sf)
    o = rep.origins
    s = A.scalar(rep.stats.select("global_mean", "q25", "q75"))
    p75 = A.scalar(RC.group_size_p75(rep.cells, PARAMS), "p75_orders")
    return o.select("origin", "mean", "orders", s["global_mean"].alias("global_mean"), s["q25"].alias("q25"),
                    s["q75"].alias("q75"), p75.alias("p75_orders"))


@register("recommendations", "SELECT * FROM recs", ctes=REC)
def recommendations(spark, sf):
    """RUL-6 (+TOP-8): first 10 recommendations in rule order (actions joined by ' | ')."""
    return _recs_out(_rep(spark, sf).recommendations)


@register("top_categories", "SELECT * FROM tc", ctes=REC, rounding=r("total"))
def top_categories(spark, sf):
    """TOP-3: top 3 categories by spend."""
    return RC.top_categories(_rw(spark, sf))


@register("top_units_by_mean", "SELECT * FROM tu", ctes=REC, rounding=r("total") | r("mean", 6))
def top_units_by_mean(spark, sf):
    """TOP-4: top 3 units by mean amount."""
    return RC.top_units_by_mean(_rw(spark, sf))


@register("priority_actions", "SELECT rec_no, title FROM pa", ctes=REC)
def priority_actions(spark, sf):
    """TOP-9: first 3 recommendations of severity critical/high."""
    return RC.priority_actions(_rep(spark, sf).recommendations)


@register("small_orders", "SELECT request_line, amount FROM rw, gs WHERE amount < q25",
          ctes=REC, rounding=r("amount"))
def small_orders(spark, sf):
    """FIL-9: orders strictly below q25."""
    rep = _rep(spark, sf)
    return RC.small_orders(rep.df, rep.stats).select("request_line", "amount")


@register("small_order_totals", "SELECT * FROM so", ctes=REC, rounding=r("small_spend"))
def small_order_totals(spark, sf):
    """AGG-31: count and spend of the small orders."""
    rep = _rep(spark, sf)
    return RC.small_order_totals(rep.df, rep.stats)


@register("savings_opportunities", "SELECT * FROM opps", ctes=REC,
          rounding=r("spend") | r("saving", 4) | r("saving_pct", 6))
def savings_opportunities(spark, sf):
    """RUL-8 (+TOP-7): expensive origins and small orders, top 5 by saving."""
    return _rep(spark, sf).opportunities


@register("spend_summary", "SELECT total_spend, orders, mean, saving, opportunities, saving_pct FROM spend",
          ctes=REC, rounding=r("total_spend") | r("saving", 4) | r("mean, saving_pct", 6))
def spend_summary(spark, sf):
    """AGG-32: total, orders, mean, saving and saving % of spend."""
    rep = _rep(spark, sf)
    return RC.spend_summary(rep.df, rep.opportunities)


@register("executive_summary", "SELECT summary FROM summ", ctes=REC)
def executive_summary(spark, sf):
    """RUL-7 (+SCA-18): executive summary text."""
    return _rep(spark, sf).summary


@register("money_text", """
SELECT format('{:,.2f}', total_spend) AS total_text, format('{:,}', orders) AS orders_text,
       format('{:.2f}', saving_pct) AS saving_pct_text FROM spend""", ctes=REC)
def money_text(spark, sf):
    """SCA-18: money, grouped-integer and percent text of the spend summary."""
    from ..functions import text as X
    rep = _rep(spark, sf)
    s = RC.spend_summary(rep.df, rep.opportunities)
    return s.select(X.money("total_spend").alias("total_text"), X.grouped_int("orders").alias("orders_text"),
                    X.fixed_n("saving_pct", 2).alias("saving_pct_text"))


@register("observed_periods", "SELECT period FROM per", ctes=REC)
def observed_periods(spark, sf):
    """AGG-29: distinct year-months observed."""
    from ..operators import aggregates as A
    return A.observed_periods(_rw(spark, sf))


@register("recent_vs_prior_periods", "SELECT * FROM parts", ctes=REC)
def recent_vs_prior_periods(spark, sf):
    """FIL-10: last 6 observed months vs the 6 before."""
    return RC.period_parts(_rw(spark, sf), PARAMS)


@register("top_values_by_frequency", "SELECT * FROM tops", ctes=REC)
def top_values_by_frequency(spark, sf):
    """TOP-5: top 5 values by order count per dimension."""
    return RC.top_values_by_frequency(_rw(spark, sf), TREND_DIMS)


@register("restrict_to_top_values", "SELECT dimension, value, period, part, amount FROM rows_",
          ctes=REC, rounding=r("amount"))
def restrict_to_top_values(spark, sf):
    """JOIN-8: rows of top-5 values inside the 12 trend months."""
    return RC.restrict_to_top_values(_rw(spark, sf), TREND_DIMS, PARAMS).select(
        "dimension", "value", "period", "part", "amount")


@register("period_spend_change", "SELECT dimension, value, recent, prior, change_pct FROM chg2",
          ctes=REC, rounding=r("recent, prior") | r("change_pct", 6))
def period_spend_change(spark, sf):
    """AGG-30: recent vs prior spend per top value and % change."""
    return RC.period_spend_change(_rw(spark, sf), TREND_DIMS, PARAMS).select(
        "dimension", "value", "recent", "prior", "change_pct")


@register("change_direction", "SELECT dimension, value, change_pct, direction FROM chg2",
          ctes=REC, rounding=r("change_pct", 6))
def change_direction(spark, sf):
    """SCA-15: creciente / decreciente by the sign of the change."""
    return RC.period_spend_change(_rw(spark, sf), TREND_DIMS, PARAMS).select(
        "dimension", "value", "change_pct", "direction")


@register("dimension_trends", "SELECT * FROM trends", ctes=REC,
          rounding=r("recent, prior") | r("change_pct", 6))
def dimension_trends(spark, sf):
    """RUL-9: significant trends, top 10 by |change|."""
    return RC.dimension_trends(_rw(spark, sf), TREND_DIMS, PARAMS)


@register("recommendation_report", """
SELECT (SELECT count(*) FROM recs) AS recommendations, (SELECT count(*) FROM op2) AS origins,
       (SELECT count(*) FROM up) AS units, (SELECT count(*) FROM trends) AS trends,
       (SELECT count(*) FROM opps) AS opportunities, summary FROM summ""", ctes=REC)
def recommendation_report(spark, sf):
    """REP-6: the report's section sizes and its summary (default dims + trends)."""
    rep = RC.recommendation_report(_rw(spark, sf), PARAMS, TREND_DIMS, include_trends=True)
    c = lambda d: A.scalar(d.agg(F.count(F.lit(1)).alias("n")), "n")
    return rep.summary.select(c(rep.recommendations).alias("recommendations"), c(rep.origins).alias("origins"),
                              c(rep.units).alias("units"), c(rep.trends).alias("trends"),
                              c(rep.opportunities).alias("opportunities"), "summary")


@register("recommendation_quick", """
SELECT (SELECT count(*) FROM recs) AS total_recommendations,
       (SELECT string_agg(title, ' | ' ORDER BY rec_no) FROM recs WHERE rec_no <= 5) AS top_recommendations,
       (SELECT string_agg(description, ' | ' ORDER BY opp_no) FROM opps WHERE opp_no <= 3) AS top_opportunities,
       summary FROM summ""", ctes=QUICK)
def recommendation_quick(spark, sf):
    """PRJ-2 (recommendations): quick form over 2000..2001, no trends."""
    return RC.quick_recommendations(_rw(spark, sf, quick=True), PARAMS)
