"""SRC-1, FIL-12, SCA-1, AGG-22 over input as it comes: purchase lines whose dates,
amounts and cost centres are text, some of it malformed, in folders by year."""

from __future__ import annotations

import hashlib
import os

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans import quality as Q
from ..sources import fixtures as fx
from ..sources import purchases as P
from ..sources import readers as RD
from .core import PARAMS, base, r, raw_inputs, register, scratch

_WRITTEN: dict[tuple, str] = {}


def _spoilt(df: DataFrame) -> DataFrame:
    """Dates, amounts and cost centres as text, with planted malformed values."""
    k = F.col("request_id").cast("bigint")
    text = {c: F.col(c).cast("string") for c in ("order_date", "request_date", "amount", "cost_center")}
    return df.withColumns({
        "order_date": F.when(k % 31 == 0, "not a date").when(k % 37 == 0, "2001-02-30 00:00:00").when(k % 41 == 0, "")
        .otherwise(text["order_date"]),
        "request_date": F.when(k % 43 == 0, "31/12/1999").otherwise(text["request_date"]),
        "amount": F.when(k % 47 == 0, "12,5").when(k % 53 == 0, "NaN").when(k % 59 == 0, "1e3").when(k % 61 == 0, "n/a")
        .otherwise(text["amount"]),
        "cost_center": F.when(k % 67 == 0, "x1").otherwise(text["cost_center"]),
    })


def files(spark, sf) -> str:
    """The spoilt purchase lines as Parquet files in folders by year, written once."""
    key = (spark.sparkContext.applicationId, os.path.abspath(sf))
    if key not in _WRITTEN:
        path = scratch(spark, f"spoilt-{hashlib.sha1(key[1].encode()).hexdigest()[:12]}")
        raw = fx.purchases_raw(spark, sf).withColumn("order_year", F.year("order_date"))
        _spoilt(raw).write.mode("overwrite").partitionBy("order_year").parquet(path)
        _WRITTEN[key] = path
    return _WRITTEN[key]


def _scan(spark, sf) -> RD.Scan:
    return RD.read_purchases(spark, files(spark, sf))


SPOILT = """
spoilt AS (SELECT * REPLACE (
    CASE WHEN k % 31 = 0 THEN 'not a date' WHEN k % 37 = 0 THEN '2001-02-30 00:00:00' WHEN k % 41 = 0 THEN ''
         ELSE strftime(order_date, '%Y-%m-%d %H:%M:%S') END AS order_date,
    CASE WHEN k % 43 = 0 THEN '31/12/1999' ELSE strftime(request_date, '%Y-%m-%d %H:%M:%S') END AS request_date,
    CASE WHEN k % 47 = 0 THEN '12,5' WHEN k % 53 = 0 THEN 'NaN' WHEN k % 59 = 0 THEN '1e3' WHEN k % 61 = 0 THEN 'n/a'
         ELSE CAST(amount AS VARCHAR) END AS amount,
    CASE WHEN k % 67 = 0 THEN 'x1' ELSE CAST(cost_center AS VARCHAR) END AS cost_center)
  FROM (SELECT *, CAST(request_id AS BIGINT) AS k FROM {source})),
typed AS (SELECT *, TRY_CAST(order_date AS TIMESTAMP) AS od, TRY_CAST(request_date AS TIMESTAMP) AS rd,
    CASE WHEN NOT isnan(TRY_CAST(amount AS DOUBLE)) THEN TRY_CAST(amount AS DOUBLE) END AS am,
    TRY_CAST(amount AS DOUBLE) IS NULL AND amount IS NOT NULL AS bad_amount,
    TRY_CAST(cost_center AS INTEGER) AS cc FROM spoilt)"""
RAW = SPOILT.format(source="purchases_raw")


@register("base_purchases_from_files", """
SELECT a.origin, a.system, a.company, d.unit, a.rd AS request_date, a.od AS order_date, CAST(a.cc AS VARCHAR) AS cost_center, d.destination,
  d.level6, d.level7, d.level8, d.nature, a.business_line, SUM(a.am) AS amount, a.detail, a.requester, a.preparer,
  a.request_id, a.line_no, concat_ws('', a.request_id, a.line_no) AS request_line, a.category, a.class, a.family, a.buying_entity
FROM typed a LEFT JOIN catalogue d ON d.cost_center_id = a.cc AND d.unit = a.company
WHERE a.od BETWEEN TIMESTAMP '2000-01-01' AND TIMESTAMP '2001-12-31'
GROUP BY ALL""", ctes=RAW, rounding=r("amount"))
def base_purchases_from_files(spark, sf):
    """SRC-1 from files with text dates and amounts: malformed values are null, none
    stops the scan; the years of the range are the only folders read."""
    _, cat = raw_inputs(spark, sf)
    out = P.base_purchases(_scan(spark, sf).rows, cat, start="2000-01-01", end="2001-12-31")
    return out.withColumn("cost_center", F.col("cost_center").cast("string"))       # null beside integers: text compares


_NAMES = ["origin", "system", "company", "request_date", "order_date", "cost_center", "business_line", "amount", "detail",
          "requester", "preparer", "request_id", "line_no", "category", "class", "family", "buying_entity"]
_BAD = {"order_date": "od IS NULL AND order_date IS NOT NULL", "request_date": "rd IS NULL AND request_date IS NOT NULL",
        "amount": "bad_amount", "cost_center": "cc IS NULL AND cost_center IS NOT NULL"}


@register("scan_value_counts", " UNION ALL ".join(
    f"SELECT '{c}' AS column_name, count(*) AS rows, count_if({c} IS NULL)::BIGINT AS nulls, "
    f"count_if({_BAD.get(c, 'false')})::BIGINT AS bad FROM typed" for c in _NAMES), ctes=RAW)
def scan_value_counts(spark, sf):
    """FIL-12: rows, nulls and values that cannot be cast, of every column of the files."""
    return _scan(spark, sf).counts


@register("scan_rejected_rows", f"""
SELECT array_to_string(list_filter([{', '.join(f"CASE WHEN {_BAD[c]} THEN '{c}' END" for c in _NAMES if c in _BAD)}],
       lambda x: x IS NOT NULL), ' ') AS bad_columns, request_id, line_no, order_date, request_date, cost_center
FROM typed WHERE {' OR '.join(f'({c})' for c in _BAD.values())}""", ctes=RAW)
def scan_rejected_rows(spark, sf):
    """FIL-12: the rows that hold a malformed value, as they came, with its columns."""
    return _scan(spark, sf).rejected.select(F.array_join("bad_columns", " ").alias("bad_columns"), "request_id", "line_no",
                                            "order_date", "request_date", "cost_center")


BASE = SPOILT.format(source="purchases")


def _report(spark, sf) -> Q.QualityReport:
    return Q.quality_report(_spoilt(base(spark, sf).drop("order_year")), PARAMS)


@register("invalid_date_count_text", """
SELECT count(*) AS rows, count_if(od IS NULL)::BIGINT + count_if(rd IS NULL)::BIGINT AS invalid_dates,
       count_if(am < 0)::BIGINT AS negatives,
       count_if(am <= 0 OR category = 'Desconocido' OR destination = 'Desconocido')::BIGINT AS invalid_rows FROM typed""", ctes=BASE)
def invalid_date_count_text(spark, sf):
    """AGG-22 (and 21, 23) over text columns: a malformed date is an invalid date."""
    return _report(spark, sf).profile.select("rows", "invalid_dates", "negatives", "invalid_rows")


@register("castability_counts", """
SELECT column_name, bad, bad / (SELECT count(*) FROM typed) * 100.0 AS bad_pct FROM (
  SELECT 'order_date' AS column_name, count_if(od IS NULL AND order_date IS NOT NULL)::BIGINT AS bad FROM typed
  UNION ALL SELECT 'request_date', count_if(rd IS NULL AND request_date IS NOT NULL)::BIGINT FROM typed
  UNION ALL SELECT 'cost_center', count_if(cc IS NULL AND cost_center IS NOT NULL)::BIGINT FROM typed
  UNION ALL SELECT 'amount', count_if(bad_amount)::BIGINT FROM typed
  UNION ALL SELECT 'amount (infinite or too large)', count_if(isinf(am) OR abs(am) >= 1e28)::BIGINT FROM typed)""",
          ctes=BASE, rounding=r("bad_pct", 6))
def castability_counts(spark, sf):
    """FIL-12: values that cannot be cast, counted in the profile's one aggregate."""
    return _report(spark, sf).castability
