"""SCA-1..17: scalar column functions, all native Catalyst expressions.

None of these is a Python UDF; they stay inside whole-stage codegen.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import fixed


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def parse_date(x, dtype: T.DataType | None = None) -> Column:
    """SCA-1: coerce to a timestamp, unparseable -> null (never raises)."""
    c = _c(x)
    if dtype is None or isinstance(dtype, T.StringType):
        return F.try_to_timestamp(c.cast("string"))
    if isinstance(dtype, (T.TimestampType, T.TimestampNTZType)):
        return c
    return c.cast("timestamp_ntz")


def calendar_features(date) -> dict[str, Column]:
    """SCA-2: year, month, quarter, weekday (Monday = 0), day, ISO week."""
    d = _c(date)
    return {
        "year": F.year(d),
        "month": F.month(d),
        "quarter": F.quarter(d),
        "weekday": F.weekday(d),
        "day": F.dayofmonth(d),
        "iso_week": F.weekofyear(d),
    }


def calendar_flags(day, month) -> dict[str, Column]:
    """SCA-3: end of month (day >= 25), start (day <= 5), quarter-end month; null -> 0."""
    d, m = _c(day), _c(month)
    return {
        "is_month_end": F.coalesce((d >= 25).cast("int"), F.lit(0)),
        "is_month_start": F.coalesce((d <= 5).cast("int"), F.lit(0)),
        "is_quarter_end": F.coalesce(m.isin(3, 6, 9, 12).cast("int"), F.lit(0)),
    }


def extract_quantity(detail) -> Column:
    """SCA-4: first of four patterns (priority order, case-insensitive); else 1."""
    t = _c(detail)
    tries = [
        F.nullif(F.regexp_extract(t, "(?i)" + pat, 1), F.lit("")).try_cast("bigint")
        for pat in fixed.QUANTITY_PATTERNS
    ]
    return F.coalesce(*tries, F.lit(1).cast("bigint"))


def spend_ratio(amount, mean) -> Column:
    """SCA-5: amount / (group mean + 1)."""
    return _c(amount) / (_c(mean) + F.lit(1.0))


def concat_request_line(request_id, line_no) -> Column:
    """SCA-7: SQL Server CONCAT (null behaves as empty string)."""
    return F.concat_ws("", _c(request_id), _c(line_no))


def deviation(actual, predicted) -> tuple[Column, Column]:
    """SCA-8: (actual - predicted if actual > 0) and its % of predicted.

    Zero deviations and zero percentages become null, as in the reference.
    """
    a, p = _c(actual), _c(predicted)
    dev = F.when(a > 0, a - p)
    dev_out = F.when(dev != 0, dev)
    pct = F.when((p > 0) & dev.isNotNull() & (dev != 0), dev / p * 100.0)
    pct_out = F.when(pct != 0, pct)
    return dev_out, pct_out


def interval_band(value, band: float, enabled: bool = True) -> tuple[Column, Column]:
    """SCA-9: value * (1 - band), value * (1 + band); zero -> null."""
    v = _c(value)
    if not enabled:
        return F.lit(None).cast("double"), F.lit(None).cast("double")
    lo, hi = v * (1.0 - band), v * (1.0 + band)
    return F.when(lo != 0, lo), F.when(hi != 0, hi)


def year_end_projection(ytd, predicted, months_elapsed, linear_weight: float) -> Column:
    """SCA-10: w * (ytd / months * 12) + (1 - w) * predicted."""
    m = _c(months_elapsed)
    rate = F.when(m > 0, _c(ytd) / m).otherwise(F.lit(0.0))
    return rate * 12.0 * linear_weight + _c(predicted) * (1.0 - linear_weight)


def budget_position(budget, value) -> tuple[Column, Column]:
    """SCA-11: (value - budget, % of budget) when a non-zero budget is given."""
    b, v = _c(budget), _c(value)
    has = b.isNotNull() & (b != 0)
    diff = F.when(has, v - b)
    return diff, F.when(has, diff / b * 100.0)


def relative_excess(amount, mean_normal) -> Column:
    """SCA-12: (amount - mean_normal) / mean_normal; null when the mean is 0/null."""
    m = _c(mean_normal)
    return F.try_divide(_c(amount) - m, m)


def quality_score(rows, nulls, negatives, bad_dates, unknown) -> Column:
    """SCA-13: 100 minus four capped penalties, clamped to 0..100; n = 0 -> 0."""
    n = _c(rows).cast("double")

    def pen(x, cap):
        return F.least(_c(x) / n * 100.0, F.lit(float(cap)))

    s = (F.lit(100.0) - pen(nulls, 30) - pen(negatives, 25) - pen(bad_dates, 20)
         - pen(unknown, 15))
    return F.when(n == 0, F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(100.0), s)))


def quality_state(score) -> Column:
    """SCA-14: >= 90, >= 75, >= 60, else."""
    s = _c(score)
    return (F.when(s >= 90, fixed.STATE_EXCELLENT).when(s >= 75, fixed.STATE_GOOD)
            .when(s >= 60, fixed.STATE_ACCEPTABLE).otherwise(fixed.STATE_POOR))


def needs_cleaning(state) -> Column:
    return _c(state).isin(fixed.STATE_POOR, fixed.STATE_ACCEPTABLE)


def change_direction(change_pct) -> Column:
    """SCA-15: 'creciente' if > 0 else 'decreciente'."""
    return F.when(_c(change_pct) > 0, fixed.TREND_UP).otherwise(fixed.TREND_DOWN)


def month_name(month) -> Column:
    """SCA-16: Spanish month name of 1..12."""
    return F.element_at(F.array(*[F.lit(m) for m in fixed.MONTH_NAMES]), _c(month).cast("int"))


def clamp_non_negative(x) -> Column:
    """SCA-17: max(0, x), keeping null as null (greatest(null, 0) would be 0)."""
    c = _c(x)
    return F.when(c.isNotNull(), F.greatest(c, F.lit(0.0)))


def nan_to_null(x) -> Column:
    c = _c(x)
    return F.when(~F.isnan(c), c)
