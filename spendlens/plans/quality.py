"""REP-4: data-quality report.

All counts come from ONE conditional aggregation over the input (a single
scan, partial aggregation per task).  Problems and advice are rule tables
over that one-row profile; examples are per-problem top-n rows chosen by a
deterministic order, with Catalyst's per-task window group limit so no task
ever holds more than n rows per problem.
"""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import fixed
from ..functions import scalars as S
from ..functions import text as X
from ..operators import aggregates as A
from ..operators import rules as R
from ..params import Params
from ..schema import PURCHASES_COLUMNS, PURCHASES_RAW, InsufficientData, bad_values, coerced

LABEL = dict(zip(fixed.REQUIRED_COLUMNS, fixed.REQUIRED_LABELS))


#: Types that the columns of the profile should have.
TYPES = {f.name: f.dataType for f in PURCHASES_RAW.fields}


def profile(df: DataFrame, p: Params) -> DataFrame:
    """AGG-20..24 + SCA-13/14 + FIL-12 in one aggregate: one row.

    Columns may come as text: dates and amounts are read with ``try_cast``, and
    ``bad_<column>`` counts the values present that cannot be (a bad date also counts
    among the invalid dates, which are those that are null once read)."""
    have = {f.name: f.dataType for f in df.schema.fields}
    read = {c: coerced(F.col(c), have[c], TYPES[c]) for c in ("amount", "order_date", "request_date")}
    bad = bad_values(df, PURCHASES_RAW)
    unk = F.lit(p.unknown_label)
    amount = read["amount"]
    aggs = [F.count(F.lit(1)).alias("rows")]
    aggs += [F.count_if(F.col(c).isNull()).alias(f"null_{c}") for c in fixed.REQUIRED_COLUMNS]
    aggs += [(F.count_if(bad[c]) if c in bad else F.lit(0).cast("bigint")).alias(f"bad_{c}") for c in CAST_COLUMNS]
    aggs += [
        F.count_if(amount < 0).alias("negatives"),
        (F.count_if(read["order_date"].isNull()) + F.count_if(read["request_date"].isNull()))
        .alias("invalid_dates"),
        F.count_if((amount <= 0) | (F.col("category") == unk) | (F.col("destination") == unk))
        .alias("invalid_rows"),
        F.count_if(F.col("category") == unk).alias("unknown"),
        F.count_if(amount.isNotNull() & A.money(amount).isNull()).alias("unfit_amounts"),
    ]
    prof = df.agg(*aggs)
    nulls = sum((F.col(f"null_{c}") for c in fixed.REQUIRED_COLUMNS), F.lit(0))
    prof = prof.withColumn("nulls", nulls)
    prof = prof.withColumn("score", S.quality_score("rows", "nulls", "negatives", "invalid_dates", "unknown"))
    prof = prof.withColumn("state", S.quality_state("score"))
    return prof.withColumn("needs_cleaning", S.needs_cleaning("state"))


#: Columns that are not text in the schema, so that a value can fail to be one.
CAST_COLUMNS = ("order_date", "request_date", "cost_center", "amount")


def castability(prof: DataFrame) -> DataFrame:
    """FIL-12 in long form: (column_name, bad values, bad %) of the columns that are not
    text, and the amounts that no decimal holds."""
    items = [F.struct(F.lit(c).alias("column_name"), F.col(f"bad_{c}").alias("bad"),
                      pct_of(F.col(f"bad_{c}"), F.col("rows")).alias("bad_pct")) for c in CAST_COLUMNS]
    items.append(F.struct(F.lit("amount (infinite or too large)").alias("column_name"), F.col("unfit_amounts").alias("bad"),
                          pct_of(F.col("unfit_amounts"), F.col("rows")).alias("bad_pct")))
    return prof.select(F.inline(F.array(*items)))


def pct_of(n, rows):
    return F.when(rows > 0, n / rows * 100.0).otherwise(F.lit(0.0))


def null_counts(prof: DataFrame) -> DataFrame:
    """AGG-20 in long form: (column, nulls, null %), reference order."""
    rows = F.col("rows")
    items = [F.struct(F.lit(i + 1).alias("column_no"), F.lit(LABEL[c]).alias("column_label"),
                      F.col(f"null_{c}").alias("nulls"),
                      pct_of(F.col(f"null_{c}"), rows).alias("null_pct"))
             for i, c in enumerate(fixed.REQUIRED_COLUMNS)]
    return prof.select(F.explode(F.array(*items)).alias("x")).select("x.*")


PROBLEM_FIELDS = [("column_label", T.StringType()), ("kind", T.StringType()),
                  ("count", T.LongType()), ("pct", T.DoubleType())]


def problems(prof: DataFrame) -> DataFrame:
    """RUL-4: null critical columns (reference column order), negatives,
    invalid dates, unknown category."""
    rows = F.col("rows")
    rules = []
    for c in fixed.REQUIRED_COLUMNS:
        if LABEL[c] in fixed.CRITICAL_NULL_LABELS:
            n = F.col(f"null_{c}")
            rules.append((n > 0, dict(column_label=LABEL[c], kind=fixed.PROBLEM_NULLS, count=n, pct=pct_of(n, rows))))
    neg, dates, unk = F.col("negatives"), F.col("invalid_dates"), F.col("unknown")
    rules += [
        (neg > 0, dict(column_label="TOTALPESOS", kind=fixed.PROBLEM_NEGATIVE, count=neg, pct=pct_of(neg, rows))),
        (dates > 0, dict(column_label=fixed.DATES_LABEL, kind=fixed.PROBLEM_DATES, count=dates, pct=pct_of(dates, rows))),
        (unk > 0, dict(column_label="CATEGORIA", kind=fixed.PROBLEM_UNKNOWN, count=unk, pct=pct_of(unk, rows))),
    ]
    return R.emit(prof, rules, PROBLEM_FIELDS, rule_col="problem_no")


def advice(prof: DataFrame, probs: DataFrame) -> DataFrame:
    """RUL-5: advice lines in reference order; 'acceptable' when none."""
    first = prof.where(F.col("state") == fixed.STATE_POOR).select(
        F.lit(0).alias("problem_no"), F.lit(fixed.TXT_Q_CRITICAL).alias("advice"))
    kind, col = F.col("kind"), F.col("column_label")
    text = (
        F.when((kind == fixed.PROBLEM_NULLS) & (F.col("pct") > 10),
               X.template(fixed.TXT_Q_REVIEW, col=col, pct=X.fixed1("pct")))
        .when(kind == fixed.PROBLEM_NULLS, X.template(fixed.TXT_Q_IMPUTE, col=col))
        .when(kind == fixed.PROBLEM_NEGATIVE, X.template(fixed.TXT_Q_FILTER, n=F.col("count")))
        .when(kind == fixed.PROBLEM_UNKNOWN, X.template(fixed.TXT_Q_ENRICH, col=col, n=F.col("count")))
    )
    per = probs.select("problem_no", text.alias("advice")).where(F.col("advice").isNotNull())
    lines = first.unionByName(per)
    n = lines.agg(F.count(F.lit(1)).alias("_n"))
    ok = n.where(F.col("_n") == 0).select(F.lit(99).alias("problem_no"), F.lit(fixed.TXT_Q_OK).alias("advice"))
    out = lines.unionByName(ok)
    w = Window.orderBy("problem_no")  # at most 1 + #rules rows: a fixed bound
    return out.select(F.row_number().over(w).alias("advice_no"), "advice")


#: Order of the examples: these columns, then the others of the row.
EXAMPLE_ORDER = ["order_date", "origin", "amount", "request_line", "category", "destination"]
EXAMPLE_COLS = EXAMPLE_ORDER + [c for c in PURCHASES_COLUMNS if c not in EXAMPLE_ORDER]


def examples(df: DataFrame, prof: DataFrame, limit: int = 10) -> DataFrame:
    """TOP-10: first ``limit`` offending rows per problem, deterministic order.

    Null problems show the whole row; the amount problem (<= 0) shows date, origin
    and amount, as the reference does.  Only problems that are reported get
    examples (the amount problem is reported when negatives > 0).
    """
    tags = []
    for c in fixed.REQUIRED_COLUMNS:
        if LABEL[c] in fixed.CRITICAL_NULL_LABELS:
            tags.append(F.when(F.col(c).isNull(), F.struct(F.lit(LABEL[c]).alias("column_label"),
                                                           F.lit(fixed.PROBLEM_NULLS).alias("kind"))))
    tags.append(F.when(F.col("amount") <= 0, F.struct(F.lit("TOTALPESOS").alias("column_label"),
                                                      F.lit(fixed.PROBLEM_NEGATIVE).alias("kind"))))
    t = df.select(*EXAMPLE_COLS, F.explode(F.array(*tags)).alias("_t")).where(F.col("_t").isNotNull())
    t = t.select("_t.column_label", "_t.kind", *EXAMPLE_COLS)
    w = Window.partitionBy("column_label", "kind").orderBy(*[F.col(c).asc_nulls_first() for c in EXAMPLE_COLS])
    top = t.withColumn("example_no", F.row_number().over(w)).where(F.col("example_no") <= limit)
    has_neg = A.scalar(prof, "negatives") > 0
    top = top.where((F.col("kind") != fixed.PROBLEM_NEGATIVE) | has_neg)
    narrow = F.col("kind") == fixed.PROBLEM_NEGATIVE
    return top.select(
        "column_label", "kind", F.col("example_no").cast("int").alias("example_no"),
        *EXAMPLE_ORDER[:3], *[F.when(~narrow, F.col(c)).alias(c) for c in EXAMPLE_COLS[3:]])


def summary(prof: DataFrame, probs: DataFrame) -> DataFrame:
    """PRJ-2 (quality part): total, state, score, needs-cleaning, problem count."""
    n = A.scalar(probs.agg(F.count(F.lit(1)).alias("problems")), "problems")
    return prof.select(F.col("rows").alias("total_rows"), "state", "score", "needs_cleaning", n.alias("problems"))


class QualityReport:
    """REP-4 tables, each planned on first access."""

    def __init__(self, df: DataFrame, p: Params, details: bool = True):
        self.df, self.p, self.details = df, p, details

    @functools.cached_property
    def profile(self) -> DataFrame:
        return A.keep_small(profile(self.df, self.p))                        # one row

    @functools.cached_property
    def castability(self) -> DataFrame:
        return castability(self.profile)

    @functools.cached_property
    def null_counts(self) -> DataFrame:
        return null_counts(self.profile)

    @functools.cached_property
    def problems(self) -> DataFrame:
        return problems(self.profile)

    @functools.cached_property
    def advice(self) -> DataFrame:
        return advice(self.profile, self.problems)

    @functools.cached_property
    def examples(self) -> DataFrame | None:
        return examples(self.df, self.profile, self.p.example_limit) if self.details else None

    @functools.cached_property
    def summary(self) -> DataFrame:
        return summary(self.profile, self.problems)


def quality_report(df: DataFrame, p: Params, details: bool = True) -> QualityReport:
    """REP-4; raises ``InsufficientData`` on an empty input (read from the profile
    that the report needs anyway)."""
    report = QualityReport(df, p, details)
    if not report.profile.first()["rows"]:
        raise InsufficientData("no purchases to check")
    return report
