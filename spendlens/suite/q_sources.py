"""SRC-1..6, FIL-1..3, FIL-4, FIL-6, JOIN-1, SCA-7."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..plans import monitoring as M
from ..sources import purchases as P
from .core import NEXT_YEAR, PARAMS, YEAR, base, r, raw_inputs, register

MONEY = r("amount")


@register("base_purchases", "SELECT * FROM purchases", rounding=MONEY)
def base_purchases(spark, sf):
    """SRC-1: fact LEFT JOIN catalogue, SUM(amount) over the 22 keys."""
    return base(spark, sf).drop("order_year")


@register("purchases_year", """
SELECT * FROM purchases
WHERE order_date >= TIMESTAMP '2001-01-01' AND order_date < TIMESTAMP '2002-01-01'""", rounding=MONEY)
def purchases_year(spark, sf):
    """SRC-2: one calendar year (half-open on the timestamp)."""
    return P.purchases_year(base(spark, sf), YEAR)


@register("purchases_year_range", """
SELECT * FROM purchases
WHERE order_date >= TIMESTAMP '1999-01-01' AND order_date < TIMESTAMP '2002-01-01'""", rounding=MONEY)
def purchases_year_range(spark, sf):
    """SRC-3: years 1999..2001."""
    return P.years_between(base(spark, sf), 1999, YEAR)


@register("latest_year_fallback", """
SELECT * EXCLUDE (y) FROM two WHERE y = (SELECT max(y) FROM two)""", ctes="""
two AS (SELECT *, year(order_date) AS y FROM purchases
        WHERE order_date >= TIMESTAMP '2001-01-01' AND order_date < TIMESTAMP '2003-01-01')""",
          rounding=MONEY)
def latest_year_fallback(spark, sf):
    """SRC-4: year 2002 is asked for; it has no rows, so 2001 is used."""
    return P.latest_year_fallback(base(spark, sf), NEXT_YEAR)


@register("forecast_history_window", """
SELECT * FROM purchases
WHERE order_date >= TIMESTAMP '1996-01-01' AND order_date < TIMESTAMP '2002-01-01'""", rounding=MONEY)
def forecast_history_window(spark, sf):
    """SRC-5: max(min_year, 2001 - 5) .. 2001."""
    return P.forecast_history_window(base(spark, sf), YEAR, PARAMS)


@register("recommendation_window", """
SELECT * FROM purchases
WHERE order_date >= TIMESTAMP '1999-01-01' AND order_date < TIMESTAMP '2002-01-01'""", rounding=MONEY)
def recommendation_window(spark, sf):
    """SRC-6: 2001 - 2 .. 2001."""
    return P.recommendation_window(base(spark, sf), YEAR, PARAMS)


@register("filter_date_between", """
SELECT * FROM purchases
WHERE order_date BETWEEN TIMESTAMP '1998-03-01' AND TIMESTAMP '1998-06-30'""", rounding=MONEY)
def filter_date_between(spark, sf):
    """FIL-1: inclusive range pushed to the fact scan before join and grouping."""
    return base(spark, sf, start="1998-03-01", end="1998-06-30")


@register("filter_origin_company", """
SELECT * FROM purchases WHERE origin = '1-URGENT' AND company = 'BUILDING'""", rounding=MONEY)
def filter_origin_company(spark, sf):
    """FIL-2: origin and company equality filters."""
    return base(spark, sf, origin="1-URGENT", company="BUILDING")


@register("filter_extra_equals", "SELECT * FROM purchases WHERE line_no = '1'", rounding=MONEY)
def filter_extra_equals(spark, sf):
    """FIL-3: extra fact-side equality filters, schema-checked."""
    return base(spark, sf, extra={"line_no": "1"})


@register("join_catalogue", """
SELECT a.*, d.unit, d.destination, d.level6, d.level7, d.level8, d.nature
FROM purchases_raw a
LEFT JOIN catalogue d ON d.cost_center_id = a.cost_center AND d.unit = a.company""", rounding=MONEY)
def join_catalogue(spark, sf):
    """JOIN-1: LEFT equi-join of the fact lines to the cost-centre catalogue."""
    raw, cat = raw_inputs(spark, sf)
    return P.join_catalogue(raw, cat)


@register("concat_request_line", """
SELECT request_id, line_no, request_line FROM purchases""")
def concat_request_line(spark, sf):
    """SCA-7: CONCAT with null as empty."""
    return base(spark, sf).select("request_id", "line_no", "request_line")


PREP_SQL = """
SELECT *, CAST(year(order_date) AS INTEGER) AS year, CAST(month(order_date) AS INTEGER) AS month
FROM purchases WHERE amount > 0 AND order_date IS NOT NULL"""


@register("valid_monitoring_rows", PREP_SQL, rounding=MONEY)
def valid_monitoring_rows(spark, sf):
    """FIL-4 (with SCA-1/2): amount > 0 and a known order year."""
    return M.prepare(base(spark, sf).drop("order_year"))


@register("history_split", """
SELECT request_line, order_date, amount, year,
       CASE WHEN year = 2001 THEN 'target' ELSE 'history' END AS part
FROM prep WHERE year <= 2001""", ctes="""
prep AS (SELECT *, CAST(year(order_date) AS INTEGER) AS year FROM purchases
         WHERE amount > 0 AND order_date >= TIMESTAMP '1996-01-01'
           AND order_date < TIMESTAMP '2002-01-01')""", rounding=MONEY)
def history_split(spark, sf):
    """FIL-6: target-year rows vs rows of earlier years (forecast window)."""
    prepared = M.prepare(P.forecast_history_window(base(spark, sf), YEAR, PARAMS))
    ydf, hist = M.split_history(prepared, YEAR)
    cols = ["request_line", "order_date", "amount", "year"]
    return (ydf.select(*cols, F.lit("target").alias("part"))
            .unionByName(hist.select(*cols, F.lit("history").alias("part"))))


@register("group_base_sum", """
SELECT a.origin, a.system, a.company, d.unit, a.request_date, a.order_date,
       a.cost_center, d.destination, d.level6, d.level7, d.level8, d.nature,
       a.business_line, SUM(a.amount) AS amount, a.detail, a.requester, a.preparer,
       a.request_id, a.line_no, concat_ws('', a.request_id, a.line_no) AS request_line,
       a.category, a.class, a.family, a.buying_entity
FROM (SELECT * FROM purchases_raw UNION ALL SELECT * FROM purchases_raw) a
LEFT JOIN catalogue d ON d.cost_center_id = a.cost_center AND d.unit = a.company
GROUP BY a.origin, a.system, d.unit, a.company, a.request_date, a.order_date,
         a.cost_center, d.destination, d.level6, d.level7, d.level8, d.nature,
         a.business_line, a.detail, a.requester, a.preparer, a.request_id,
         a.line_no, a.category, a.class, a.family, a.buying_entity""", rounding=MONEY)
def group_base_sum(spark, sf):
    """AGG-1: every fact line arrives twice; the 22-key grouping merges the
    copies and sums their amounts (null keys group together)."""
    raw, cat = raw_inputs(spark, sf)
    return P.base_purchases(raw.unionByName(raw), cat)
