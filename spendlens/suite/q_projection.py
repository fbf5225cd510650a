"""REP-2/REP-3 and their parts: SCA-1..6/17, FIL-5/7/13, JOIN-2..5/7,
AGG-7/9..14/28, ML-1/2/6..9, RUL-2."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import fixed
from ..functions import scalars as S
from ..operators import aggregates as A
from ..operators import features as FE
from ..operators import forecast as FC
from ..plans import projection as PR
from ..session import materialize
from ..sources import purchases as P
from . import q_monitoring as QM
from .core import ALL_DIMS, BUDGET, NEXT_YEAR, PARAMS, PROJ_BUDGET, YEAR, base, r, register

Z = FC.z_value(PARAMS.confidence)

# the oracles state patterns and column lists by themselves
_QTY = " , ".join(
    f"TRY_CAST(NULLIF(regexp_extract(detail, '{pat}', 1, 'i'), '') AS BIGINT)"
    for pat in (r"Cant[.:]?\s*(\d+)", r"Cantidad[.:]?\s*(\d+)", r"PZA[.:]?\s*(\d+)", r"UN[.:]?\s*(\d+)"))


def _prep_sql(y0: int, y1: int) -> str:
    return f"""
pp AS (SELECT *, CAST(year(order_date) AS INTEGER) AS year, CAST(month(order_date) AS INTEGER) AS month,
              CAST(quarter(order_date) AS INTEGER) AS quarter,
              CAST(isodow(order_date) - 1 AS INTEGER) AS weekday,
              CAST(day(order_date) AS INTEGER) AS day, CAST(weekofyear(order_date) AS INTEGER) AS iso_week,
              coalesce({_QTY}, CAST(1 AS BIGINT)) AS quantity,
              coalesce(CAST(day(order_date) >= 25 AS INTEGER), 0) AS is_month_end,
              coalesce(CAST(day(order_date) <= 5 AS INTEGER), 0) AS is_month_start,
              coalesce(CAST(month(order_date) IN (3, 6, 9, 12) AS INTEGER), 0) AS is_quarter_end
       FROM purchases
       WHERE order_date >= TIMESTAMP '{y0}-01-01' AND order_date < TIMESTAMP '{y1 + 1}-01-01'
         AND amount > 0)"""


_PLAIN = ["cost_center", "year", "month", "quarter", "weekday", "day", "iso_week", "is_month_end", "is_month_start",
          "is_quarter_end", "quantity"]
_NUM = ["amount", *_PLAIN, "cat_mean", "cat_median", "cat_std", "dest_mean", "dest_median", "origin_mean", "unit_mean",
        "cat_ratio", "dest_ratio", "prev_month_spend"]
_TEXT = ["category", "class", "family", "destination", "origin", "unit"]
_MED = ", ".join(f"median(CAST({c} AS DOUBLE)) AS med_{c}" for c in _NUM)
_IMP = ", ".join(f"fe.{c} AS {c}" if c in _PLAIN else f"coalesce(fe.{c}, med_{c}) AS {c}" for c in _NUM)

FEAT = _prep_sql(1997, 2002) + f""",
mx AS (SELECT max(year) AS my FROM pp),
fs AS (SELECT pp.* REPLACE (CAST(2002 AS INTEGER) AS year) FROM pp, mx WHERE pp.year = mx.my),
cs AS (SELECT category, (sum(round(amount * 10000)::HUGEINT)::DOUBLE / 10000 / count(amount)) AS cat_mean, median(amount) AS cat_median, stddev_samp(amount) AS cat_std
       FROM pp WHERE category IS NOT NULL GROUP BY category),
dst AS (SELECT destination, (sum(round(amount * 10000)::HUGEINT)::DOUBLE / 10000 / count(amount)) AS dest_mean, median(amount) AS dest_median
        FROM pp WHERE destination IS NOT NULL GROUP BY destination),
os AS (SELECT origin, (sum(round(amount * 10000)::HUGEINT)::DOUBLE / 10000 / count(amount)) AS origin_mean FROM pp WHERE origin IS NOT NULL GROUP BY origin),
us AS (SELECT unit, (sum(round(amount * 10000)::HUGEINT)::DOUBLE / 10000 / count(amount)) AS unit_mean FROM pp WHERE unit IS NOT NULL GROUP BY unit),
gm AS (SELECT median(amount) AS prev_month_spend FROM pp),
fe AS (SELECT fs.*, cs.cat_mean, cs.cat_median, cs.cat_std, dst.dest_mean, dst.dest_median, os.origin_mean,
              us.unit_mean, fs.amount / (cs.cat_mean + 1.0) AS cat_ratio,
              fs.amount / (dst.dest_mean + 1.0) AS dest_ratio, gm.prev_month_spend
       FROM fs LEFT JOIN cs ON fs.category = cs.category LEFT JOIN dst ON fs.destination = dst.destination
       LEFT JOIN os ON fs.origin = os.origin LEFT JOIN us ON fs.unit = us.unit, gm),
med AS (SELECT {_MED} FROM fe),
imp AS (SELECT fe.request_line, fe.category, fe.class, fe.family, fe.destination, fe.origin, fe.unit, {_IMP}
        FROM fe, med),
feat AS (SELECT request_line, {", ".join(c for c in [*_TEXT, *_NUM] if c != "day")} FROM imp)"""

_ENC = ",\n".join(
    f"enc_{c} AS (SELECT {c} AS label, CAST(dense_rank() OVER (ORDER BY {c}) - 1 AS INTEGER) AS idx "
    f"FROM (SELECT DISTINCT {c} FROM pp WHERE {c} IS NOT NULL)),\n"
    f"k_{c} AS (SELECT CAST(count(*) AS INTEGER) AS k FROM enc_{c})" for c in _TEXT)
ENC = FEAT + ",\n" + _ENC

# seasonal model over the prepared rows of the window, target year T
def _seasonal_sql(prep: str, target: int) -> str:
    return prep + f""",
d AS (SELECT last_day(order_date) AS ds, amount FROM pp WHERE order_date IS NOT NULL),
sums AS (SELECT ds, sum(amount) AS y FROM d GROUP BY ds),
span AS (SELECT min(ds) AS a, max(ds) AS b FROM d),
spine AS (SELECT last_day(g.m) AS ds FROM span,
          unnest(generate_series(date_trunc('month', a), date_trunc('month', b), INTERVAL 1 MONTH)) AS g(m)),
ser AS (SELECT spine.ds, coalesce(sums.y, 0.0) AS y FROM spine LEFT JOIN sums USING (ds)),
st AS (SELECT min(ds) AS s0, max(ds) AS e0, count(*) AS nm FROM ser),
s2 AS (SELECT ser.*, CAST((year(ds) - year(s0)) * 12 + (month(ds) - month(s0)) AS DOUBLE) AS t FROM ser, st),
fit AS (SELECT coalesce(regr_slope(y, t), 0.0) AS b1, coalesce(regr_intercept(y, t), 0.0) AS b0 FROM s2),
rr AS (SELECT s2.*, y - (b0 + b1 * t) AS res, month(ds) AS moy FROM s2, fit),
sea0 AS (SELECT moy, avg(res) AS sea FROM rr GROUP BY moy),
sea AS (SELECT moy, CASE WHEN (SELECT nm FROM st) >= 24 THEN sea - (SELECT avg(sea) FROM sea0) ELSE 0.0 END AS sea
        FROM sea0),
noise AS (SELECT stddev_samp(res - coalesce(sea.sea, 0.0)) AS sd FROM rr LEFT JOIN sea USING (moy)),
hz AS (SELECT CASE WHEN ({target} - year(e0)) * 12 + (12 - month(e0)) <= 0 THEN 12
                   ELSE ({target} - year(e0)) * 12 + (12 - month(e0)) END AS h, e0, s0 FROM st),
fut AS (SELECT last_day(e0 + to_months(CAST(k AS INTEGER))) AS ds, s0 FROM hz, generate_series(1, h) AS g(k)),
fut2 AS (SELECT ds, CAST((year(ds) - year(s0)) * 12 + (month(ds) - month(s0)) AS DOUBLE) AS t, month(ds) AS moy
         FROM fut WHERE year(ds) = {target}),
yh AS (SELECT CAST(month(ds) AS INTEGER) AS month, b0 + b1 * t + coalesce(sea.sea, 0.0) AS yhat,
              coalesce(sd, 0.0) * {Z!r} AS band
       FROM fut2 LEFT JOIN sea USING (moy), fit, noise),
fc AS (SELECT month, CASE WHEN yhat IS NOT NULL THEN greatest(yhat, 0.0) END AS predicted,
              greatest(yhat - band, 0.0) AS lower, greatest(yhat + band, 0.0) AS upper,
              yhat AS raw_predicted, yhat - band AS raw_lower FROM yh),
mm AS (SELECT month, (sum(round(amount * 10000)::HUGEINT)::DOUBLE / 10000 / count(amount)) AS m FROM pp WHERE month IS NOT NULL GROUP BY month),
gmean AS (SELECT (sum(round(amount * 10000)::HUGEINT)::DOUBLE / 10000 / count(amount)) AS g FROM pp),
filled AS (
  SELECT month, predicted, lower, upper, 'model' AS source FROM fc
  UNION ALL
  SELECT s.month, coalesce(mm.m, gmean.g), CAST(NULL AS DOUBLE), CAST(NULL AS DOUBLE), 'filled'
  FROM (SELECT CAST(range AS INTEGER) AS month FROM range(1, 13)) s LEFT JOIN mm USING (month), gmean
  WHERE s.month NOT IN (SELECT month FROM fc)),
pmonthly AS (SELECT month, {_month_names()}[month] AS month_name, predicted, lower, upper, source FROM filled)"""


def _month_names():
    return "[" + ",".join(f"'{m}'" for m in fixed.MONTH_NAMES) + "]"


SEAS = _seasonal_sql(FEAT, NEXT_YEAR)
SEAS_2001 = _seasonal_sql(_prep_sql(1996, 2001), YEAR)

HEAD = SEAS + """,
tot AS (SELECT sum(amount) * 1.05 AS projected_total FROM feat),
hm AS (SELECT count(DISTINCT year) * 12 AS history_months FROM pp),
phead AS (SELECT CAST(2002 AS INTEGER) AS year, 'proyeccion' AS mode, projected_total,
                 CASE WHEN projected_total * 0.9 <> 0 THEN projected_total * 0.9 END AS lower,
                 CASE WHEN projected_total * 1.1 <> 0 THEN projected_total * 1.1 END AS upper,
                 CAST(400000000.0 AS DOUBLE) AS budget, projected_total - 400000000.0 AS difference,
                 (projected_total - 400000000.0) / 400000000.0 * 100.0 AS difference_pct,
                 CAST(0.95 AS DOUBLE) AS confidence, CAST(history_months AS INTEGER) AS history_months
          FROM tot, hm),
palerts AS (SELECT 1 AS alert_no, 'desviacion_presupuesto' AS type,
                   CASE WHEN difference_pct > 15 THEN 'critico' ELSE 'alto' END AS severity,
                   'Proyección excede presupuesto' AS title,
                   'La proyección ($' || format('{:,.2f}', projected_total) || ') excede el presupuesto en '
                     || format('{:.1f}', difference_pct) || '% ($' || format('{:,.2f}', projected_total - budget)
                     || ')' AS description,
                   projected_total AS observed, budget AS expected, CAST(NULL AS VARCHAR) AS dimension
            FROM phead WHERE budget IS NOT NULL AND budget <> 0 AND difference_pct <> 0 AND difference_pct > 5)"""


def _prep(spark, sf, year=NEXT_YEAR):
    return FE.prepare(P.forecast_history_window(base(spark, sf), year, PARAMS))


def _feats(spark, sf):
    return FE.feature_frame(_prep(spark, sf), NEXT_YEAR, PARAMS)


_FEAT_R = r("amount") | r("cat_mean, cat_median, cat_std, dest_mean, dest_median, origin_mean, unit_mean, "
                        "prev_month_spend, cat_ratio, dest_ratio", 6)


@register("valid_projection_rows", "SELECT * FROM pp", ctes=_prep_sql(1997, 2002), rounding=r("amount"))
def valid_projection_rows(spark, sf):
    """FIL-5 (+SCA-1..4): projection rows (amount > 0) with calendar features."""
    return _prep(spark, sf)


@register("parse_date", """
SELECT request_line, CAST(TRY_CAST(CAST(order_date AS VARCHAR) AS TIMESTAMP) AS TIMESTAMP) AS parsed_order_date,
       TRY_CAST(detail AS TIMESTAMP) AS parsed_detail FROM purchases""")
def parse_date(spark, sf):
    """SCA-1: coerce text to a timestamp; unparseable text -> null, never an error."""
    b = base(spark, sf)
    return b.select("request_line",
                    S.parse_date(F.col("order_date").cast("string")).cast("timestamp_ntz").alias("parsed_order_date"),
                    S.parse_date("detail").cast("timestamp_ntz").alias("parsed_detail"))


@register("calendar_features", """
SELECT request_line, order_date, year, month, quarter, weekday, day, iso_week FROM pp""",
          ctes=_prep_sql(1997, 2002))
def calendar_features(spark, sf):
    """SCA-2: year, month, quarter, weekday (Mon=0), day, ISO week."""
    return _prep(spark, sf).select("request_line", "order_date", "year", "month", "quarter", "weekday",
                                   "day", "iso_week")


@register("calendar_flags", """
SELECT request_line, day, month, is_month_end, is_month_start, is_quarter_end FROM pp""",
          ctes=_prep_sql(1997, 2002))
def calendar_flags(spark, sf):
    """SCA-3: end/start of month and quarter-end flags."""
    return _prep(spark, sf).select("request_line", "day", "month", "is_month_end", "is_month_start",
                                   "is_quarter_end")


@register("extract_quantity", f"""
SELECT request_line, detail, coalesce({_QTY}, CAST(1 AS BIGINT)) AS quantity FROM purchases""")
def extract_quantity(spark, sf):
    """SCA-4: quantity from the detail text, patterns in priority order; else 1."""
    return base(spark, sf).select("request_line", "detail", S.extract_quantity("detail").alias("quantity"))


@register("latest_year_slice", "SELECT request_line, order_date, amount, year FROM fs", ctes=FEAT,
          rounding=r("amount"))
def latest_year_slice(spark, sf):
    """FIL-7: rows of the latest year, year overwritten with the target (2002)."""
    return FE.latest_year_slice(_prep(spark, sf), NEXT_YEAR).select("request_line", "order_date", "amount", "year")


@register("category_stats", "SELECT * FROM cs", ctes=FEAT, rounding=r("cat_mean, cat_median, cat_std", 6))
def category_stats(spark, sf):
    """AGG-9: mean, exact median, sample std per category."""
    return FE.category_stats(_prep(spark, sf), PARAMS)


@register("destination_stats", "SELECT * FROM dst", ctes=FEAT, rounding=r("dest_mean, dest_median", 6))
def destination_stats(spark, sf):
    """AGG-10: mean and exact median per destination."""
    return FE.destination_stats(_prep(spark, sf), PARAMS)


@register("origin_stats", "SELECT * FROM os", ctes=FEAT, rounding=r("origin_mean", 6))
def origin_stats(spark, sf):
    """AGG-11: mean per origin."""
    return FE.origin_stats(_prep(spark, sf))


@register("unit_stats", "SELECT * FROM us", ctes=FEAT, rounding=r("unit_mean", 6))
def unit_stats(spark, sf):
    """AGG-12: mean per unit."""
    return FE.unit_stats(_prep(spark, sf))


@register("global_median", "SELECT * FROM gm", ctes=FEAT, rounding=r("prev_month_spend", 6))
def global_median(spark, sf):
    """AGG-13: exact median amount over the prepared rows."""
    return FE.global_median(_prep(spark, sf), PARAMS)


@register("column_medians", "SELECT * FROM med", ctes=FEAT,
          rounding={f"med_{c}": 6 for c in FE.NUMERIC_FEATURES})
def column_medians(spark, sf):
    """AGG-14: exact median of every numeric column of the enriched slice."""
    return FE.column_medians(_enriched_written(spark, sf), FE.NUMERIC_FEATURES, PARAMS)


def _enriched(spark, sf):
    p = _prep(spark, sf)
    return FE.enrich(FE.latest_year_slice(p, NEXT_YEAR), p, PARAMS)


def _enriched_written(spark, sf):
    """The enriched slice written once to the shared folder (read several times)."""
    return materialize(_enriched(spark, sf), "feature-slice")


@register("enrich_category_stats", "SELECT request_line, category, cat_mean, cat_median, cat_std FROM fe",
          ctes=FEAT, rounding=r("cat_mean, cat_median, cat_std", 6))
def enrich_category_stats(spark, sf):
    """JOIN-2: slice rows left-joined to the category statistics."""
    return _enriched(spark, sf).select("request_line", "category", "cat_mean", "cat_median", "cat_std")


@register("enrich_destination_stats", "SELECT request_line, destination, dest_mean, dest_median FROM fe",
          ctes=FEAT, rounding=r("dest_mean, dest_median", 6))
def enrich_destination_stats(spark, sf):
    """JOIN-3: slice rows left-joined to the destination statistics."""
    return _enriched(spark, sf).select("request_line", "destination", "dest_mean", "dest_median")


@register("enrich_origin_stats", "SELECT request_line, origin, origin_mean FROM fe", ctes=FEAT,
          rounding=r("origin_mean", 6))
def enrich_origin_stats(spark, sf):
    """JOIN-4: slice rows left-joined to the origin mean."""
    return _enriched(spark, sf).select("request_line", "origin", "origin_mean")


@register("enrich_unit_stats", "SELECT request_line, unit, unit_mean FROM fe", ctes=FEAT,
          rounding=r("unit_mean", 6))
def enrich_unit_stats(spark, sf):
    """JOIN-5: slice rows left-joined to the unit mean."""
    return _enriched(spark, sf).select("request_line", "unit", "unit_mean")


@register("spend_ratios", "SELECT request_line, amount, cat_ratio, dest_ratio FROM fe", ctes=FEAT,
          rounding=r("amount") | r("cat_ratio, dest_ratio", 6))
def spend_ratios(spark, sf):
    """SCA-5: amount / (group mean + 1) for category and destination."""
    return _enriched(spark, sf).select("request_line", "amount", "cat_ratio", "dest_ratio")


@register("impute_medians", """
SELECT request_line, cat_mean, cat_median, cat_std, dest_mean, dest_median, unit_mean, cat_ratio, dest_ratio
FROM imp""", ctes=FEAT, rounding=r("cat_mean, cat_median, cat_std, dest_mean, dest_median, unit_mean, cat_ratio, dest_ratio", 6))
def impute_medians(spark, sf):
    """SCA-6: nulls replaced by the column's exact median."""
    cols = ["cat_mean", "cat_median", "cat_std", "dest_mean", "dest_median", "unit_mean", "cat_ratio", "dest_ratio"]
    return FE.impute_medians(_enriched_written(spark, sf), FE.NUMERIC_FEATURES, PARAMS).select("request_line", *cols)


@register("feature_frame", "SELECT * FROM feat", ctes=FEAT, rounding=_FEAT_R)
def feature_frame(spark, sf):
    """ML-2: the 26 model features of the 2002 slice (strings unencoded) and the amount."""
    return _feats(spark, sf)


@register("encode_categories", "SELECT feat.request_line, " + ", ".join(
    f"coalesce(enc_{c}.idx, (SELECT k FROM k_{c})) AS {c}" for c in _TEXT) +
    " FROM feat " + " ".join(f"LEFT JOIN enc_{c} ON feat.{c} = enc_{c}.label" for c in _TEXT),
    ctes=ENC)
def encode_categories(spark, sf):
    """ML-1: label indices learnt on the history (sorted labels, null/unseen -> k)."""
    p = _prep(spark, sf)
    return FE.encode_categories(p, FE.feature_frame(p, NEXT_YEAR, PARAMS)).select(
        "request_line", *fixed.ENCODED_COLUMNS)


@register("projection_fallback_total", "SELECT sum(amount) * 1.05 AS projected_total FROM feat",
          ctes=FEAT, rounding=r("projected_total", 4))
def projection_fallback_total(spark, sf):
    """ML-6: latest-year spend x 1.05."""
    return PR.naive_total(FE.latest_year_slice(_prep(spark, sf), NEXT_YEAR), PARAMS)


@register("sufficiency_checks", """
SELECT * FROM (VALUES
  ('not_empty', (SELECT count(*) FROM pp) > 0, (SELECT count(*) FROM pp), CAST(1 AS BIGINT)),
  ('min_rows', (SELECT count(*) FROM pp) >= 100, (SELECT count(*) FROM pp), CAST(100 AS BIGINT)),
  ('target_year_rows', (SELECT count(*) FROM pp WHERE year = 2001) > 0,
                       (SELECT count(*) FROM pp WHERE year = 2001), CAST(1 AS BIGINT)),
  ('history_rows', (SELECT count(*) FROM pp WHERE year < 2001) > 0,
                   (SELECT count(*) FROM pp WHERE year < 2001), CAST(1 AS BIGINT))
) AS t(check_name, ok, observed, needed)""", ctes=_prep_sql(1996, 2001))
def sufficiency_checks(spark, sf):
    """FIL-13: non-empty, >= 100 rows, target-year and history rows present."""
    return PR.sufficiency_checks(_prep(spark, sf, YEAR), PARAMS, YEAR).withColumnRenamed("check", "check_name")


@register("history_months", "SELECT CAST(count(DISTINCT year) * 12 AS BIGINT) AS history_months FROM pp",
          ctes=_prep_sql(1997, 2002))
def history_months(spark, sf):
    """AGG-28: distinct years x 12."""
    from ..operators import aggregates as A
    return A.history_months(_prep(spark, sf))


@register("monthly_resample", "SELECT CAST(ds AS TIMESTAMP) AS ds, y FROM ser", ctes=SEAS, rounding=r("y"))
def monthly_resample(spark, sf):
    """AGG-7: spend per month-end, empty months between first and last = 0."""
    return FC.monthly_series(_prep(spark, sf)).select(F.col("ds").cast("timestamp_ntz").alias("ds"), "y")


@register("seasonal_forecast", "SELECT month, predicted, lower, upper FROM fc", ctes=SEAS,
          rounding=r("predicted, lower, upper"))
def seasonal_forecast(spark, sf):
    """ML-7: trend + season monthly forecast for 2002 with 95 % bounds."""
    return FC.seasonal_forecast(A.monthly_cube(_prep(spark, sf)), NEXT_YEAR, PARAMS.confidence).drop("seasonal")


@register("clamp_non_negative", "SELECT month, raw_predicted, predicted, raw_lower, lower FROM fc", ctes=SEAS,
          rounding=r("raw_predicted, predicted, raw_lower, lower"))
def clamp_non_negative(spark, sf):
    """SCA-17: max(0, x) on the forecast and its lower bound (null stays null)."""
    return FC.seasonal_forecast(_prep(spark, sf), NEXT_YEAR, PARAMS.confidence, keep_raw=True).select(
        "month", "raw_predicted", "predicted", "raw_lower", "lower")


@register("fill_missing_months", "SELECT month, predicted, lower, upper, source FROM filled", ctes=SEAS_2001,
          rounding=r("predicted, lower, upper"))
def fill_missing_months(spark, sf):
    """JOIN-7: a 2001 forecast covers Sep-Dec; Jan-Aug are filled with monthly means."""
    p = _prep(spark, sf, YEAR)
    return FC.fill_missing_months(FC.seasonal_forecast(p, YEAR, PARAMS.confidence), p)


@register("fallback_monthly", """
SELECT s.month, coalesce(mm.m, gmean.g) AS predicted
FROM (SELECT CAST(range AS INTEGER) AS month FROM range(1, 13)) s LEFT JOIN mm USING (month), gmean""",
          ctes=SEAS, rounding=r("predicted", 6))
def fallback_monthly(spark, sf):
    """ML-8: mean order amount per month, global mean where a month is missing."""
    return FC.fallback_monthly(_prep(spark, sf))


@register("dimension_forecast", """
SELECT dimension, value, total, mean, orders,
       CASE WHEN all_total > 0 THEN total / all_total * 100.0 ELSE 0.0 END AS share_pct,
       CAST(rk AS INTEGER) AS rank
FROM (SELECT *, sum(total) OVER (PARTITION BY dimension) AS all_total,
             row_number() OVER (PARTITION BY dimension ORDER BY total DESC, value ASC) AS rk FROM g) WHERE rk <= 10""",
          ctes=FEAT + """,
u AS (UNPIVOT (SELECT origin AS ORIGEN, unit AS UN, category AS CATEGORIA, class AS CLASE, family AS FAMILIA,
                      destination AS DESTINO, company AS EMPRESA, amount FROM fs)
      ON ORIGEN, UN, CATEGORIA, CLASE, FAMILIA, DESTINO, EMPRESA INTO NAME dimension VALUE value),
g AS (SELECT dimension, value, SUM(amount) AS total, (sum(round(amount * 10000)::HUGEINT)::DOUBLE / 10000 / count(amount)) AS mean, count(*) AS orders
      FROM u WHERE value IS NOT NULL GROUP BY dimension, value)""",
          rounding=r("total") | r("mean, share_pct", 6))
def dimension_forecast(spark, sf):
    """ML-9: breakdown of the latest year's actual amounts per dimension (top 10)."""
    return PR.dimension_forecast(FE.latest_year_slice(_prep(spark, sf), NEXT_YEAR), ALL_DIMS)


@register("dimension_forecast_scaled", """
SELECT dimension, value, total, (share + CASE WHEN row_number() OVER (PARTITION BY dimension ORDER BY rest DESC, value) <= over
       THEN 1 ELSE 0 END)::DOUBLE / 100 AS scaled
FROM (SELECT *, whole - sum(share) OVER (PARTITION BY dimension) AS over FROM (
  SELECT dimension, value, total, whole, (whole * part) // every AS share, (whole * part) % every AS rest FROM (
    SELECT *, sum(part) OVER (PARTITION BY dimension)::HUGEINT AS every FROM (
      SELECT dimension, value, total, greatest(round(total * 100), 0)::HUGEINT AS part,
             (SELECT round(projected_total * 100)::HUGEINT FROM tot) AS whole FROM sg))))""", ctes=FEAT + """,
tot AS (SELECT sum(amount) * 1.05 AS projected_total FROM feat),
u AS (UNPIVOT (SELECT origin AS ORIGEN, unit AS UN, category AS CATEGORIA, class AS CLASE, family AS FAMILIA,
                      destination AS DESTINO, company AS EMPRESA, amount FROM fs)
      ON ORIGEN, UN, CATEGORIA, CLASE, FAMILIA, DESTINO, EMPRESA INTO NAME dimension VALUE value),
sg AS (SELECT dimension, value, SUM(amount) AS total FROM u WHERE value IS NOT NULL GROUP BY dimension, value)""",
          rounding=r("total, scaled"))
def dimension_forecast_scaled(spark, sf):
    """ML-9 (scale_to_total): the projected total dealt to all values of every dimension."""
    return _report(spark, sf).scaled_breakdown


_HEAD_R = r("budget") | r("projected_total, lower, upper, difference", 4) | r("difference_pct, confidence", 6)


def _report(spark, sf):
    return PR.projection_report(P.forecast_history_window(base(spark, sf), NEXT_YEAR, PARAMS), NEXT_YEAR,
                                PARAMS, PROJ_BUDGET, ALL_DIMS, intervals=True, method="naive")


@register("projection_headline", "SELECT * FROM phead", ctes=HEAD, rounding=_HEAD_R)
def projection_headline(spark, sf):
    """REP-2 headline (naive total): projected total, band, budget difference."""
    return _report(spark, sf).headline


@register("projection_monthly", "SELECT * FROM pmonthly", ctes=HEAD, rounding=r("predicted, lower, upper"))
def projection_monthly(spark, sf):
    """REP-2 monthly table: seasonal forecast for 2002, filled to 12 months."""
    return _report(spark, sf).monthly


@register("projection_alerts", "SELECT * FROM palerts", ctes=HEAD, rounding=r("observed, expected", 4))
def projection_alerts(spark, sf):
    """RUL-2: projection over budget by > 5 % / > 15 %."""
    return _report(spark, sf).alerts


@register("forecast_dynamic", """
SELECT year, mode, projected_total AS total, CAST(NULL AS DOUBLE) AS reference_total, budget,
       difference AS budget_gap, (SELECT count(*) FROM palerts) AS alerts FROM phead""",
          ctes=HEAD, rounding=r("total, budget, budget_gap", 4))
def forecast_dynamic(spark, sf):
    """REP-3: 2002 is after the as-of year, so the projection path runs."""
    rep = PR.forecast_dynamic(P.forecast_history_window(base(spark, sf), NEXT_YEAR, PARAMS), NEXT_YEAR,
                              PARAMS, PROJ_BUDGET, ALL_DIMS)
    return PR.dynamic_headline(rep)


@register("forecast_dynamic_current", """
SELECT year, mode, actual AS total, predicted AS reference_total, budget, remaining AS budget_gap,
       (SELECT count(*) FROM mal) AS alerts FROM head""",
          ctes=QM.HEAD + ",\nmal AS (" + QM.ALERTS_SELECT + ")",
          rounding=r("total, budget, budget_gap") | r("reference_total", 4))
def forecast_dynamic_current(spark, sf):
    """REP-3: 2001 is the as-of year, so the monitoring path runs."""
    rep = PR.forecast_dynamic(P.forecast_history_window(base(spark, sf), YEAR, PARAMS), YEAR, PARAMS,
                              BUDGET, ALL_DIMS)
    return PR.dynamic_headline(rep)
