"""Canonical schemas of the inputs (fixed StructTypes, checked at scan)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Purchase lines as they arrive (one row per order line).
PURCHASES_RAW = T.StructType([
    T.StructField("origin", T.StringType()),
    T.StructField("system", T.StringType()),
    T.StructField("company", T.StringType()),
    T.StructField("request_date", T.TimestampNTZType()),
    T.StructField("order_date", T.TimestampNTZType()),
    T.StructField("cost_center", T.IntegerType()),
    T.StructField("business_line", T.StringType()),
    T.StructField("amount", T.DoubleType()),
    T.StructField("detail", T.StringType()),
    T.StructField("requester", T.StringType()),
    T.StructField("preparer", T.StringType()),
    T.StructField("request_id", T.StringType()),
    T.StructField("line_no", T.StringType()),
    T.StructField("category", T.StringType()),
    T.StructField("class", T.StringType()),
    T.StructField("family", T.StringType()),
    T.StructField("buying_entity", T.StringType()),
])

# Cost-centre catalogue (dimension).
CATALOGUE = T.StructType([
    T.StructField("cost_center_id", T.IntegerType()),
    T.StructField("unit", T.StringType()),
    T.StructField("destination", T.StringType()),
    T.StructField("level6", T.StringType()),
    T.StructField("level7", T.StringType()),
    T.StructField("level8", T.StringType()),
    T.StructField("nature", T.StringType()),
])

# The 22 grouping keys of the base purchases, in output order around the sum.
FACT_KEYS = [
    "origin", "system", "company", "request_date", "order_date", "cost_center",
    "business_line", "detail", "requester", "preparer", "request_id", "line_no",
    "category", "class", "family", "buying_entity",
]
CATALOGUE_KEYS = ["unit", "destination", "level6", "level7", "level8", "nature"]

# Output column order of the base purchases (24 columns).
PURCHASES_COLUMNS = [
    "origin", "system", "company", "unit", "request_date", "order_date",
    "cost_center", "destination", "level6", "level7", "level8", "nature",
    "business_line", "amount", "detail", "requester", "preparer",
    "request_id", "line_no", "request_line", "category", "class", "family",
    "buying_entity",
]


class SchemaError(ValueError):
    pass


class InsufficientData(ValueError):
    """A report was asked for data that the input does not hold."""


def coerced(c: Column, have: T.DataType, want: T.DataType) -> Column:
    """A value as the type ``want``; null where it cannot be read as one (SCA-1: a date
    that is none, a number with letters), and for NaN, which is a missing value: as
    null it leaves sums, means and ranks alone."""
    out = c if have == want else c.try_cast(want)
    return F.when(~F.isnan(out), out) if isinstance(want, (T.DoubleType, T.FloatType)) else out


def require_columns(df: DataFrame, schema: T.StructType, name: str) -> None:
    """FIL-12, SET-2: raise listing the missing columns, before any job runs."""
    missing = sorted({f.name for f in schema.fields} - set(df.columns))
    if missing:
        raise SchemaError(f"{name}: missing columns {missing}")


def conform(df: DataFrame, schema: T.StructType, name: str, keep: Sequence[str] = ()) -> DataFrame:
    """Select the schema's columns with its types, and those of ``keep`` as they are.

    Values that cannot be cast become null (``bad_values`` counts them); missing
    columns raise.
    """
    require_columns(df, schema, name)
    have = {f.name: f.dataType for f in df.schema.fields}
    return df.select(*[coerced(F.col(f.name), have[f.name], f.dataType).alias(f.name) for f in schema.fields],
                     *[c for c in keep if c in have])


def bad_values(df: DataFrame, schema: T.StructType) -> dict[str, Column]:
    """For every column that has to be cast: true where a value is present and
    cannot be (FIL-12).  Columns of the right type have none."""
    have = {f.name: f.dataType for f in df.schema.fields}
    return {f.name: F.col(f.name).isNotNull() & F.col(f.name).try_cast(f.dataType).isNull()
            for f in schema.fields if f.name in have and have[f.name] != f.dataType}
