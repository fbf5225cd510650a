"""SCA-18 and EXT-5: money, number and percent text as native expressions.

``format_number`` rounds half-even on the binary value, like Python's
``format`` and DuckDB's ``format``; ``format_string`` would round half-up.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def money(x) -> Column:
    """Python ``f"{x:,.2f}"``."""
    return F.format_number(_c(x).cast("double"), 2)


def fixed1(x) -> Column:
    """Python ``f"{x:.1f}"`` (no grouping)."""
    return F.regexp_replace(F.format_number(_c(x).cast("double"), 1), ",", "")


def fixed_n(x, decimals: int) -> Column:
    return F.regexp_replace(F.format_number(_c(x).cast("double"), decimals), ",", "")


def grouped_int(x) -> Column:
    """Python ``f"{n:,}"`` for an integer."""
    return F.format_number(_c(x).cast("bigint"), 0)


def template(fmt: str, **parts: Column) -> Column:
    """Fill ``{name}`` slots of a fixed text with column values."""
    out: list[Column] = []
    rest = fmt
    while rest:
        i = rest.find("{")
        if i < 0:
            out.append(F.lit(rest))
            break
        j = rest.index("}", i)
        if i:
            out.append(F.lit(rest[:i]))
        out.append(parts[rest[i + 1:j]].cast("string"))
        rest = rest[j + 1:]
    return F.concat(*out) if len(out) > 1 else out[0]


def large_number(x, decimals: int = 1) -> Column:
    """Dashboard: >= 1e9 'B', >= 1e6 'M', >= 1e3 'K', else 0 decimals."""
    v = _c(x).cast("double")
    return (
        F.when(v >= 1e9, F.concat(F.lit("$"), fixed_n(v / 1e9, decimals), F.lit("B")))
        .when(v >= 1e6, F.concat(F.lit("$"), fixed_n(v / 1e6, decimals), F.lit("M")))
        .when(v >= 1e3, F.concat(F.lit("$"), fixed_n(v / 1e3, decimals), F.lit("K")))
        .otherwise(F.concat(F.lit("$"), fixed_n(v, 0)))
    )


def percent(x, decimals: int = 1) -> Column:
    return F.concat(fixed_n(x, decimals), F.lit("%"))


def truncate_text(x, max_len: int = 50) -> Column:
    t = _c(x)
    return F.when(F.char_length(t) <= max_len, t).otherwise(
        F.concat(F.substring(t, 1, max_len), F.lit("...")))


def percent_difference(current, previous) -> Column:
    c, p = _c(current), _c(previous)
    return F.when(p == 0, F.lit(0.0)).otherwise((c - p) / p * 100.0)
