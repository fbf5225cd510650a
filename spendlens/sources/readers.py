"""SRC-1: readers for real input.

Files are read as they are - dates and amounts may be text - and cast with
``try_cast``: one malformed value becomes null and is counted, it does not stop
the scan.  Partition columns of a folder (``order_year=2001/``) stay beside the
schema's columns, so year windows prune folders.

A database is read in ranges of the order date, so that every task asks for its
own months; the options are built by pure functions and handed to Spark's JDBC
source by ``jdbc_reader``.
"""

from __future__ import annotations

import dataclasses
import datetime as dt
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, DataFrameReader, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schema import CATALOGUE, PURCHASES_RAW, bad_values, conform, require_columns

#: Folder levels that may stand beside the columns of the schema.
PARTITIONS = ("order_year",)


@dataclasses.dataclass
class Scan:
    """What a tolerant scan gives: all lazy, all over the same input."""

    rows: DataFrame             # the schema's columns, typed, and the partition columns
    counts: DataFrame           # (column_name, rows, nulls, bad) of every column of the schema
    rejected: DataFrame         # rows with a bad value: bad columns, and the row as it came


def scan(raw: DataFrame, schema: T.StructType, name: str, keep: Sequence[str] = PARTITIONS) -> Scan:
    """A tolerant scan of ``raw``: no row is dropped and no value raises; a value that
    cannot be cast is null in ``rows``, counted in ``counts`` (one aggregate) and shown
    with its row in ``rejected``."""
    require_columns(raw, schema, name)
    bad = bad_values(raw, schema)
    names = [f.name for f in schema.fields]
    one = raw.agg(F.count(F.lit(1)).alias("rows"), *[F.count_if(F.col(c).isNull()).alias(f"n_{c}") for c in names],
                  *[F.count_if(b).alias(f"b_{c}") for c, b in bad.items()])
    items = [F.struct(F.lit(c).alias("column_name"), F.col("rows"), F.col(f"n_{c}").alias("nulls"),
                      (F.col(f"b_{c}") if c in bad else F.lit(0).cast("bigint")).alias("bad")) for c in names]
    flags = F.array_compact(F.array(*[F.when(b, F.lit(c)) for c, b in bad.items()], F.lit(None).cast("string")))
    rejected = raw.withColumn("bad_columns", flags).where(F.size("bad_columns") > 0)
    return Scan(rows=conform(raw, schema, name, keep),
                counts=one.select(F.inline(F.array(*items))),
                rejected=rejected.select("bad_columns", *[F.col(c).cast("string").alias(c) for c in names]))


def read_purchases(spark: SparkSession, path: str, fmt: str = "parquet", renames: Mapping[str, str] | None = None) -> Scan:
    """Purchase lines of a folder of files; ``renames`` maps column names of the files
    to those of the schema."""
    raw = spark.read.format(fmt).option("header", "true").load(path)
    return scan(raw.withColumnsRenamed(dict(renames or {})), PURCHASES_RAW, "purchases_raw")


def read_catalogue(spark: SparkSession, path: str, fmt: str = "parquet", renames: Mapping[str, str] | None = None) -> Scan:
    """The cost-centre catalogue of a folder of files."""
    raw = spark.read.format(fmt).option("header", "true").load(path)
    return scan(raw.withColumnsRenamed(dict(renames or {})), CATALOGUE, "catalogue")


def month_ranges(start: dt.date, end: dt.date, months: int = 1) -> list[tuple[dt.date, dt.date]]:
    """Half-open ranges of whole months (the ends cut to [start, end))."""
    if months < 1 or start >= end:
        raise ValueError("an empty range, or ranges of no months")
    out, a = [], start
    while a < end:
        i = a.year * 12 + a.month - 1 + months
        b = min(dt.date(i // 12, i % 12 + 1, 1), end)
        out.append((a, b))
        a = b
    return out


def date_predicates(column: str, start: dt.date, end: dt.date, months: int = 1, nulls: bool = False) -> list[str]:
    """One condition for each task of a range-partitioned read: disjoint, and together
    all of [start, end) (and the rows without a date)."""
    _checked(column)
    out = [f"{column} >= '{a.isoformat()}' AND {column} < '{b.isoformat()}'" for a, b in month_ranges(start, end, months)]
    return [*out, f"{column} IS NULL"] if nulls else out


def _checked(name: str) -> str:
    if not name.replace("_", "").replace(".", "").isalnum():
        raise ValueError(f"not a plain name: {name!r}")
    return name


def jdbc_options(url: str, table: str, date_column: str, start: dt.date, end: dt.date, partitions: int,
                 columns: Sequence[str] = (), fetch_rows: int = 10_000, properties: Mapping[str, str] | None = None) -> dict[str, str]:
    """Options of Spark's JDBC source for rows of [start, end), read in ``partitions``
    ranges of the date.  The window is part of the query, so the server sends no other
    rows; bounds only deal the ranges.  Rows without a date are not in any window."""
    if partitions < 1 or start >= end:
        raise ValueError("an empty range, or no partitions")
    what = ", ".join(map(_checked, columns)) or "*"
    _checked(date_column)
    query = (f"(SELECT {what} FROM {_checked(table)} WHERE {date_column} >= '{start.isoformat()}' "
             f"AND {date_column} < '{end.isoformat()}') q")
    return {"url": url, "dbtable": query, "partitionColumn": date_column, "lowerBound": start.isoformat(),
            "upperBound": end.isoformat(), "numPartitions": str(min(partitions, (end - start).days)),
            "fetchsize": str(fetch_rows), "pushDownPredicate": "true", "pushDownAggregate": "true",
            **dict(properties or {})}


def year_window_options(url: str, table: str, date_column: str, first: int, last: int, partitions_a_year: int = 12,
                        **more) -> dict[str, str]:
    """``jdbc_options`` of whole years (SRC-2, SRC-3)."""
    start, end = dt.date(first, 1, 1), dt.date(last + 1, 1, 1)
    return jdbc_options(url, table, date_column, start, end, partitions_a_year * (last - first + 1), **more)


def jdbc_reader(spark: SparkSession, options: Mapping[str, str]) -> DataFrameReader:
    """A reader with these options; its ``load()`` is the first thing that connects."""
    return spark.read.format("jdbc").options(**options)
