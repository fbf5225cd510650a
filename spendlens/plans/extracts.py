"""EXT-1..5: dashboard extracts as batch jobs over the report tables.

Column expressions only (plus one bounded top-6 cut); no UI.  Values the
dashboard treats as "falsy" (0 and null) become null, numbers are scaled to
billions where the charts do so, and the display texts use the dashboard's
formats.  Rounding is half-even on the binary value (``format_number``); the
browser's ``toFixed`` differs only on exact binary ties.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import fixed
from ..functions import text as X
from ..operators import aggregates as A


def _falsy_to_null(c):
    return F.when(F.col(c).isNotNull() & (F.col(c) != 0), F.col(c))


def monthly_chart(monthly: DataFrame) -> DataFrame:
    """EXT-1: month name, predicted/1e9, actual/1e9, bounds/1e9."""
    return monthly.select(
        "month", F.col("month_name").alias("label"),
        (F.col("predicted") / 1e9).alias("predicted_b"),
        (_falsy_to_null("actual") / 1e9).alias("actual_b"),
        (_falsy_to_null("lower") / 1e9).alias("lower_b"),
        (_falsy_to_null("upper") / 1e9).alias("upper_b"),
    )


def origin_pie(breakdown: DataFrame, n: int = 6) -> DataFrame:
    """EXT-2: first six origin values of the breakdown: name, total/1e9, share."""
    return (breakdown.where((F.col("dimension") == "ORIGEN") & (F.col("rank") <= n))
            .select(F.col("rank").alias("slice_no"), F.col("value").alias("name"),
                    (F.col("total") / 1e9).alias("value_b"), F.col("share_pct").alias("percentage")))


def stat_cards(headline: DataFrame, alerts: DataFrame) -> DataFrame:
    """EXT-3: the four stat cards of either mode, long form:
    (card_no, title, value, subtitle, trend, trend_text)."""
    first = A.scalar(alerts.orderBy("alert_no").limit(1), "severity")          # null if no alert
    cnt = A.scalar(alerts.agg(F.count(F.lit(1)).alias("_alerts")), "_alerts")
    h = headline.withColumn("_alerts", cnt).withColumn("_first_sev", first)
    mon = F.col("mode") == fixed.MODE_MONITORING
    cols = set(headline.columns)

    def col(name, dtype="double"):
        return F.col(name) if name in cols else F.lit(None).cast(dtype)

    trend = F.when(mon, col("deviation_pct"))
    trend_text = F.when(trend.isNotNull() & (trend != 0), X.percent(F.abs(trend), 1))
    trend_dir = (F.when(trend.isNull() | (trend == 0), F.lit("none"))
                 .when(trend > 0, F.lit("up")).otherwise(F.lit("down")))
    card = lambda no, title, value, sub: F.struct(
        F.lit(no).alias("card_no"), title.alias("title"), value.cast("string").alias("value"),
        sub.cast("string").alias("subtitle"))
    cards = F.array(
        card(1, F.when(mon, F.lit(fixed.CARD_ACTUAL)).otherwise(F.lit(fixed.CARD_PROJECTED)),
             X.large_number(F.when(mon, col("actual")).otherwise(col("projected_total"))),
             F.when(mon, F.lit(fixed.CARD_ACTUAL_SUB)).otherwise(
                 X.template(fixed.CARD_PROJECTED_SUB, year=F.col("year")))),
        card(2, F.lit(fixed.CARD_BUDGET), X.large_number(col("budget")),
             F.when(mon, X.template(fixed.CARD_REMAINING_SUB,
                                    value=X.large_number(F.coalesce(col("remaining"), F.lit(0.0)))))
             .otherwise(X.template(fixed.CARD_DIFFERENCE_SUB,
                                   value=X.large_number(F.coalesce(col("difference"), F.lit(0.0)))))),
        card(3, F.when(mon, F.lit(fixed.CARD_YEAR_END)).otherwise(F.lit(fixed.CARD_CONFIDENCE)),
             F.when(mon, X.large_number(col("year_end_projection")))
             .otherwise(F.concat(X.fixed_n(col("confidence") * 100.0, 0), F.lit("%"))),
             F.when(mon, F.lit(fixed.CARD_YEAR_END_SUB)).otherwise(
                 X.template(fixed.CARD_HISTORY_SUB, n=col("history_months", "int")))),
        card(4, F.lit(fixed.CARD_ALERTS), F.col("_alerts"),
             F.when(F.col("_alerts") > 0, F.col("_first_sev")).otherwise(F.lit(fixed.CARD_NO_ALERTS))),
    )
    out = h.select(F.explode(cards).alias("c"), trend_dir.alias("_td"), trend_text.alias("_tt"))
    return out.select("c.*",
                      F.when(F.col("c.card_no") == 1, F.col("_td")).alias("trend"),
                      F.when(F.col("c.card_no") == 1, F.col("_tt")).alias("trend_text"))


def alert_styles(alerts: DataFrame) -> DataFrame:
    """EXT-4: alert rows with the dashboard's colour band and palette colour."""
    sev = F.col("severity")
    band = (F.when(sev == fixed.SEV_CRITICAL, F.lit(fixed.ALERT_BAND_CRITICAL))
            .when(sev == fixed.SEV_HIGH, F.lit(fixed.ALERT_BAND_HIGH))
            .otherwise(F.lit(fixed.ALERT_BAND_OTHER)))
    palette = F.create_map(*[x for k, v in fixed.SEVERITY_COLORS.items() for x in (F.lit(k), F.lit(v))])
    return alerts.select("alert_no", "severity", "title", band.alias("band"),
                         F.element_at(palette, sev).alias("palette_color"))


def currency(x) -> "F.Column":
    """es-MX currency, no decimals: $1,234,568 (negatives -$1,234)."""
    v = F.col(x) if isinstance(x, str) else x
    return F.when(v.isNull(), F.lit(None).cast("string")).when(
        v < 0, F.concat(F.lit("-$"), F.format_number(-v, 0))).otherwise(F.concat(F.lit("$"), F.format_number(v, 0)))


def medium_date(x) -> "F.Column":
    """es-MX medium date: '3 ene 2001'."""
    d = F.col(x) if isinstance(x, str) else x
    abbr = F.array(*[F.lit(m) for m in fixed.MONTH_ABBR])
    return F.concat_ws(" ", F.dayofmonth(d).cast("string"), F.element_at(abbr, F.month(d)),
                       F.year(d).cast("string"))


def medium_datetime(x) -> "F.Column":
    """es-MX medium date + short time: '3 ene 2001, 0:00'."""
    d = F.col(x) if isinstance(x, str) else x
    return F.concat(medium_date(d), F.lit(", "), F.hour(d).cast("string"), F.lit(":"),
                    F.lpad(F.minute(d).cast("string"), 2, "0"))


def formatted_monthly(monthly: DataFrame) -> DataFrame:
    """EXT-5 over the monthly table: large number, currency, plain number,
    percent and percent difference columns."""
    return monthly.select(
        "month", "month_name",
        X.large_number("predicted").alias("predicted_large"),
        currency("predicted").alias("predicted_currency"),
        F.when(F.col("actual").isNotNull(), F.format_number("actual", 0)).alias("actual_number"),
        F.when(F.col("deviation_pct").isNotNull(), X.percent("deviation_pct", 1)).alias("deviation_pct_text"),
        F.when(F.col("actual").isNotNull(), X.percent_difference("actual", "predicted"))
        .alias("pct_difference"),
    )


def formatted_rows(rows: DataFrame, date_col: str = "order_date", text_col: str = "detail",
                   max_len: int = 50) -> DataFrame:
    """EXT-5 over report rows: medium date, medium date-time, shortened text."""
    return rows.select(
        F.col(date_col).alias(date_col),
        medium_date(date_col).alias("date_text"),
        medium_datetime(date_col).alias("datetime_text"),
        X.truncate_text(text_col, max_len).alias("text_short"),
    )
