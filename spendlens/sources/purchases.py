"""SRC-1..6: the base purchases and the year windows every report reads.

``base_purchases`` is the reference's single SQL query re-expressed as a
DataFrame plan: optional filters on the fact side, LEFT join to the
cost-centre catalogue on (cost centre, company), and SUM(amount) over the 22
descriptive keys (null keys form their own group, SQL semantics).

Scale notes: filters are applied on the fact side *before* the join, so
Catalyst pushes them into the Parquet scan (and prunes year partitions of a
staged table).  The catalogue is broadcast where its measured rows are within a
bound and joined by salted keys otherwise.  The grouping is one shuffle on the 22 keys with
map-side partial sums.
"""

from __future__ import annotations

from typing import Any, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..params import Params
from ..schema import (CATALOGUE, FACT_KEYS, PURCHASES_COLUMNS, PURCHASES_RAW,
                      InsufficientData, SchemaError, conform)
from ..session import materialize


def filter_date_between(df: DataFrame, start: Any = None, end: Any = None,
                        column: str = "order_date") -> DataFrame:
    """FIL-1: inclusive range, applied only when both bounds are given."""
    if start is None or end is None:
        return df
    c = F.col(column)
    return df.where(c.between(F.lit(start).cast(df.schema[column].dataType),
                              F.lit(end).cast(df.schema[column].dataType)))


def filter_origin_company(df: DataFrame, origin: str | None = None,
                          company: str | None = None) -> DataFrame:
    """FIL-2: optional equality filters, ANDed."""
    if origin:
        df = df.where(F.col("origin") == F.lit(origin))
    if company:
        df = df.where(F.col("company") == F.lit(company))
    return df


def filter_extra_equals(df: DataFrame, extra: Mapping[str, Any] | None = None) -> DataFrame:
    """FIL-3: extra column = value filters on the fact side.

    Column names are checked against the schema (never interpolated into SQL)
    and values are bound as typed literals.
    """
    if not extra:
        return df
    for name, value in extra.items():
        if name not in df.columns:
            raise SchemaError(f"unknown filter column {name!r}")
        df = df.where(F.col(name) == F.lit(value).cast(df.schema[name].dataType))
    return df


#: Catalogue rows up to which every task gets the whole of it (a row is some 300
#: bytes in memory, so at most about 60 MB).
BROADCAST_ROWS = 200_000


def join_catalogue(fact: DataFrame, catalogue: DataFrame, dedupe_catalogue: bool = False,
                   normalise_keys: bool = False, broadcast_rows: int = BROADCAST_ROWS, salts: int = 16) -> DataFrame:
    """JOIN-1: LEFT equi-join on cost_center = cost_center_id AND company = unit.

    Duplicate catalogue rows fan out (as in the reference) unless
    ``dedupe_catalogue`` keeps one row per key.  ``normalise_keys`` compares
    the text key like a case-insensitive collation that ignores trailing
    spaces (upper + rtrim on both sides).

    The catalogue is written once and its rows counted: up to ``broadcast_rows`` it
    is broadcast and the purchases are not dealt at all.  A larger one is joined by
    shuffle, each key in ``salts`` parts, so a hot key is spread over as many tasks;
    purchases with a null key, which match nothing, get parts of their own.
    """
    if dedupe_catalogue:
        catalogue = catalogue.dropDuplicates(["cost_center_id", "unit"])
    d = materialize(catalogue.select(
        F.col("cost_center_id").alias("_cc"), F.col("unit").alias("_un"),
        "unit", "destination", "level6", "level7", "level8", "nature"), "catalogue")
    un, company = F.col("_un"), F.col("company")
    if normalise_keys:
        un, company = F.upper(F.rtrim(un)), F.upper(F.rtrim(company))
    d = d.withColumn("_un", un).where(F.col("_cc").isNotNull() & F.col("_un").isNotNull())
    f = fact.withColumn("_fu", company)
    if d.count() <= broadcast_rows:
        j = f.join(F.broadcast(d), (F.col("cost_center") == F.col("_cc")) & (F.col("_fu") == F.col("_un")), "left")
        return j.drop("_cc", "_un", "_fu")
    part = F.pmod(F.xxhash64(*[F.col(c) for c in ("request_id", "line_no", "order_date", "amount") if c in fact.columns]), F.lit(salts))
    f = f.withColumn("_part", F.when(F.col("cost_center").isNull() | F.col("_fu").isNull(), -1 - part).otherwise(part))
    d = d.withColumn("_dp", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))).withColumn("_dp", F.col("_dp").cast("bigint"))
    j = f.join(d, (F.col("cost_center") == F.col("_cc")) & (F.col("_fu") == F.col("_un")) & (F.col("_part") == F.col("_dp")), "left")
    return j.drop("_cc", "_un", "_fu", "_part", "_dp")


def base_purchases(purchases_raw: DataFrame, catalogue: DataFrame,
                   start: Any = None, end: Any = None,
                   origin: str | None = None, company: str | None = None,
                   extra: Mapping[str, Any] | None = None, dedupe_catalogue: bool = False,
                   normalise_keys: bool = False) -> DataFrame:
    """SRC-1: filtered fact LEFT JOIN catalogue, SUM(amount) over 22 keys.

    Columns may come as text; where the input has a partition column
    ``order_year``, a date range also prunes its folders."""
    if "order_year" in purchases_raw.columns and start is not None and end is not None:
        lo, hi = (int(str(d)[:4]) for d in (start, end))
        purchases_raw = purchases_raw.where(F.col("order_year").between(lo, hi))
    fact = conform(purchases_raw, PURCHASES_RAW, "purchases_raw")
    cat = conform(catalogue, CATALOGUE, "catalogue")
    fact = filter_date_between(fact, start, end)
    fact = filter_origin_company(fact, origin, company)
    fact = filter_extra_equals(fact, extra)
    joined = join_catalogue(fact, cat, dedupe_catalogue, normalise_keys)
    keys = FACT_KEYS + ["unit", "destination", "level6", "level7", "level8", "nature"]
    grouped = joined.groupBy(*keys).agg(F.sum("amount").alias("amount"))
    grouped = grouped.withColumn("request_line", S.concat_request_line("request_id", "line_no"))
    return grouped.select(*PURCHASES_COLUMNS)


def stage_purchases(purchases: DataFrame, path: str) -> DataFrame:
    """Write the base purchases once as a table partitioned by order year and
    read it back.

    Every report reads year windows of the same base; materialising it cuts
    the lineage (a lost executor re-reads files instead of recomputing the
    join and the 22-key grouping) and lets order-date range filters skip
    whole files by their statistics.  ``path`` must be a shared folder (the
    session's checkpoint directory on a cluster).
    """
    (purchases.withColumn("order_year", F.year("order_date"))
     .write.mode("overwrite").partitionBy("order_year").parquet(path))
    return read_staged(purchases.sparkSession, path)


def read_staged(spark, path: str) -> DataFrame:
    """The staged table; ``order_year`` (the partition column) stays beside the
    purchases columns so that year windows prune partitions."""
    return spark.read.parquet(path).select(*PURCHASES_COLUMNS, "order_year")


def _year_bounds(y0: int, y1: int) -> tuple[str, str]:
    # text literals cast to timestamp_ntz: independent of any time zone setting
    return f"{y0:04d}-01-01 00:00:00", f"{y1 + 1:04d}-01-01 00:00:00"


def years_between(purchases: DataFrame, y0: int, y1: int) -> DataFrame:
    """SRC-3: rows with order_date in years y0..y1.

    Half-open on the timestamp ([y0-01-01, y1+1-01-01)), so 31 December after
    midnight is kept; a range predicate on the raw column pushes down to the
    scan; on a staged table the year partitions outside it are not read.
    """
    lo, hi = _year_bounds(y0, y1)
    c = F.col("order_date")
    if "order_year" in purchases.columns:      # staged table: skip whole partitions
        purchases = purchases.where(F.col("order_year").between(y0, y1)).drop("order_year")
    return purchases.where((c >= F.lit(lo).cast("timestamp_ntz")) & (c < F.lit(hi).cast("timestamp_ntz")))


def purchases_year(purchases: DataFrame, year: int) -> DataFrame:
    """SRC-2: one calendar year."""
    return years_between(purchases, year, year)


def latest_year_fallback(purchases: DataFrame, year: int) -> DataFrame:
    """SRC-4: rows of ``year``; if it has none, rows of ``year - 1``.

    The later year present is asked for first - of a staged table from the values
    of its partitions, without reading a column - so the rows come from a scan of
    that year alone, with its filters pushed down.
    """
    if "order_year" in purchases.columns:
        seen = purchases.where(F.col("order_year").between(year - 1, year)).agg(F.max("order_year"))
    else:
        seen = years_between(purchases, year - 1, year).agg(F.max(F.year("order_date")))
    chosen = seen.first()[0]
    if chosen is None:
        raise InsufficientData(f"no rows in {year} nor in {year - 1}")
    return purchases_year(purchases, chosen)


def forecast_history_window(purchases: DataFrame, year: int, p: Params) -> DataFrame:
    """SRC-5: years max(min_year, year - history_years) .. year."""
    return years_between(purchases, max(p.min_year, year - p.history_years), year)


def recommendation_window(purchases: DataFrame, year: int, p: Params,
                          quick: bool = False) -> DataFrame:
    """SRC-6: years year-2 .. year (quick form: year-1 .. year)."""
    back = p.quick_recommendation_years if quick else p.recommendation_years
    return years_between(purchases, year - back, year)


def order_year(col: str = "order_date") -> Column:
    return F.year(col)
