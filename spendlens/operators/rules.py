"""Rule tables: turn rows of facts into rows of alerts/advice.

Each rule is (condition, fields).  For every input row the rules that hold
emit one output row each, in rule order, via one ``explode`` of an array of
conditional structs -- a narrow, codegen-friendly projection (no join, no
shuffle).  Works on one-row headlines and on per-group profiles alike.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

ALERT_FIELDS: list[tuple[str, T.DataType]] = [
    ("type", T.StringType()),
    ("severity", T.StringType()),
    ("title", T.StringType()),
    ("description", T.StringType()),
    ("observed", T.DoubleType()),
    ("expected", T.DoubleType()),
    ("dimension", T.StringType()),
]


def emit(df: DataFrame, rules: Sequence[tuple[Column, dict]],
         fields: Sequence[tuple[str, T.DataType]], keep: Sequence[str] = (),
         rule_col: str = "rule_no") -> DataFrame:
    """One output row per (input row, rule that holds)."""
    structs = []
    for i, (cond, values) in enumerate(rules, start=1):
        parts = [F.lit(i).alias(rule_col)]
        for name, dtype in fields:
            v = values.get(name)
            v = F.lit(None) if v is None else (v if isinstance(v, Column) else F.lit(v))
            parts.append(v.cast(dtype).alias(name))
        structs.append(F.when(cond, F.struct(*parts)))
    out = df.select(*keep, F.explode(F.array(*structs)).alias("_r"))
    return out.where(F.col("_r").isNotNull()).select(*keep, "_r.*")


def alerts(df: DataFrame, rules: Sequence[tuple[Column, dict]], keep: Sequence[str] = ()) -> DataFrame:
    return emit(df, rules, ALERT_FIELDS, keep=keep, rule_col="alert_no")
