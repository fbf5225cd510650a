"""REP-5: anomaly report over one year of purchases.

Rows with amount > 0 are scored either by the isolation forest
(``method="forest"``, ML-10) or by the deterministic quantile rule
(``method="quantile"``, ML-11: amount above its exact (1 - c) quantile).
Either way the flag is "score strictly above the exact (1 - c) quantile of
the scores", so the flagged share is at most c (ties aside) and the
threshold comes from the skew-safe quantile operator.

The flagged rows are read twice: once for the cells of (origin, category, flag),
from which statistics, counts by dimension, the origin share and the alerts come,
and once for the top-N list, an ``orderBy().limit()``.  Each function takes flagged
rows or such cells.
"""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import fixed
from ..functions import scalars as S
from ..functions import text as X
from ..operators import aggregates as A
from ..operators import isolation as IF
from ..operators import rules as R
from ..operators.quantiles import exact_percentile_scalar
from ..params import Params
from ..session import materialize


def clean(df: DataFrame) -> DataFrame:
    return df.where(S.nan_to_null("amount") > 0)


def flag_above(rows: DataFrame, threshold: DataFrame, score_col: str) -> DataFrame:
    """FIL-8: ``is_anomaly`` = score strictly above the one-row ``_thr``; ``score`` =
    score - threshold (positive for anomalies)."""
    out = rows.withColumn("threshold", A.scalar(A.keep_small(threshold), "_thr"))                # one row
    return (out.withColumn("is_anomaly", F.coalesce(F.col(score_col) > F.col("threshold"), F.lit(False)))
            .withColumn("score", F.col(score_col) - F.col("threshold")))


def quantile_flag(rows: DataFrame, p: Params, score_col: str = "amount") -> DataFrame:
    """ML-11: flagged above the exact (1-c) quantile of the score column."""
    return flag_above(rows, exact_percentile_scalar(rows, score_col, [1.0 - p.contamination], ["_thr"],
                                                    p.quantile_accuracy, exact=p.exact_quantiles), score_col)


def forest_flag(rows: DataFrame, p: Params) -> DataFrame:
    """ML-10: isolation-forest scores, flagged above their (1-c) quantile."""
    model = IF.fit(rows, "amount", p.n_trees, p.sample_size, p.seed)
    return flag_above(IF.score(model, rows, "amount", "anomaly_score"),
                      IF.threshold(model, rows, 1.0 - p.contamination), "anomaly_score")


def flag(df: DataFrame, p: Params, method: str = "quantile") -> DataFrame:
    rows = clean(df)
    if method == "quantile":
        return quantile_flag(rows, p)
    if method == "forest":
        return forest_flag(rows, p)
    raise ValueError(f"unknown method {method!r}")


def flag_cells(flagged: DataFrame) -> DataFrame:
    """Cells by (origin, category, is_anomaly), written once."""
    return materialize(A.cells(flagged, "origin", "category", "is_anomaly"), "anomaly-cells")


def stats(flagged: DataFrame) -> DataFrame:
    """AGG-25: analysed, flagged, %, mean normal, mean flagged, max flagged
    (zeros when nothing was analysed)."""
    anom = F.col("is_anomaly")
    g = A.measures(flagged).agg(
        A.orders_of().alias("rows_analysed"),
        A.orders_of(anom).alias("anomalies"),
        A.mean_of(~anom).alias("mean_normal"),
        A.mean_of(anom).alias("mean_anomalous"),
        F.max(F.when(anom, F.col("largest"))).alias("max_anomalous"),
    )
    n = F.col("rows_analysed")
    return g.select(
        "rows_analysed", "anomalies",
        F.when(n > 0, F.col("anomalies") / n * 100.0).otherwise(F.lit(0.0)).alias("anomaly_pct"),
        F.coalesce("mean_normal", F.lit(0.0)).alias("mean_normal"),
        F.coalesce("mean_anomalous", F.lit(0.0)).alias("mean_anomalous"),
        F.coalesce("max_anomalous", F.lit(0.0)).alias("max_anomalous"),
    )


def counts_by_dimension(flagged: DataFrame, labels=("ORIGEN", "CATEGORIA"), top: int = 10) -> DataFrame:
    """AGG-26: flagged rows per value of each dimension, top 10, null dropped."""
    cols = [F.col(fixed.DIMENSIONS[l]).cast("string").alias(l) for l in labels]
    u = (A.counted(flagged).where("is_anomaly").select("orders", *cols)
         .unpivot(ids=["orders"], values=list(labels), variableColumnName="dimension", valueColumnName="value")
         .where(F.col("value").isNotNull()))
    g = u.groupBy("dimension", "value").agg(A.orders_of().alias("anomalies"))
    w = Window.partitionBy("dimension").orderBy(F.col("anomalies").desc(), F.col("value").asc())
    return g.withColumn("rank", F.row_number().over(w).cast("int")).where(F.col("rank") <= top)


def top_origin_share(flagged: DataFrame) -> DataFrame:
    """AGG-27: origin with the most flagged rows and its share of them."""
    flagged = A.counted(flagged)
    g = flagged.where(F.col("is_anomaly") & F.col("origin").isNotNull()).groupBy("origin").agg(A.orders_of().alias("n"))
    top = g.orderBy(F.col("n").desc(), F.col("origin").asc()).limit(1)
    tot = A.scalar(flagged.agg(A.orders_of(F.col("is_anomaly")).alias("anomalies")), "anomalies")
    return top.withColumn("anomalies", tot).select(
        "origin", F.col("n").alias("origin_anomalies"), "anomalies",
        F.when(F.col("anomalies") > 0, F.col("n") / F.col("anomalies")).alias("share"))


def top_anomalies(flagged: DataFrame, n: int) -> DataFrame:
    """TOP-2: flagged rows, top n by amount (ties by the row's keys)."""
    return (flagged.where("is_anomaly")
            .orderBy(F.col("amount").desc(), F.col("order_date").asc_nulls_first(),
                     F.col("request_line").asc_nulls_first(), F.col("detail").asc_nulls_first(),
                     F.col("category").asc_nulls_first(), F.col("origin").asc_nulls_first())
            .limit(n))


def _na(c: str):
    return F.coalesce(F.col(c).cast("string"), F.lit("N/A"))


def context_projection(rows: DataFrame, st: DataFrame, context: bool = True) -> DataFrame:
    """PRJ-1 + SCA-12: report rows: date, origin, category, destination,
    amount, relative excess over the normal mean, score, detail[:200] and the
    request context ('N/A' for missing values)."""
    r = rows.withColumn("mean_normal", A.scalar(st, "mean_normal"))
    cols = [
        F.col("order_date").cast("timestamp_ntz").alias("order_date"),
        _na("origin").alias("origin"), _na("category").alias("category"),
        _na("destination").alias("destination"), "amount",
        S.relative_excess("amount", "mean_normal").alias("relative_excess"),
        F.col("score").alias("score"),
        F.substring(F.coalesce(F.col("detail"), F.lit("")), 1, 200).alias("detail"),
    ]
    if context:
        cols += [_na("request_id").alias("ctx_request_id"), _na("line_no").alias("ctx_line_no"),
                 _na("company").alias("ctx_company"), _na("unit").alias("ctx_unit")]
    return r.select(*cols)


def alerts(flagged: DataFrame, st: DataFrame, p: Params) -> DataFrame:
    """RUL-3: many anomalies, an extreme maximum, concentration in one origin."""
    share = A.scalar(top_origin_share(flagged).select("origin", "origin_anomalies"))  # null if none
    one = st.withColumn("origin", share["origin"]).withColumn("origin_anomalies", share["origin_anomalies"])
    n, mx, mn = F.col("anomalies"), F.col("max_anomalous"), F.col("mean_normal")
    o, on = F.col("origin"), F.col("origin_anomalies")
    rules = [
        (n > p.anomaly_many, dict(
            type=fixed.ALERT_ANOMALY, severity=fixed.SEV_HIGH, title=fixed.TXT_ANOM_MANY_TITLE,
            description=X.template(fixed.TXT_ANOM_MANY_DESC, n=n), observed=n)),
        (mx > mn * p.anomaly_ratio, dict(
            type=fixed.ALERT_HIGH_SPEND, severity=fixed.SEV_CRITICAL, title=fixed.TXT_ANOM_MAX_TITLE,
            description=X.template(fixed.TXT_ANOM_MAX_DESC, max=X.money(mx), mean=X.money(mn)),
            observed=mx, expected=mn)),
        (on.isNotNull() & (on > n * p.origin_share), dict(
            type=fixed.ALERT_PATTERN, severity=fixed.SEV_MEDIUM,
            title=X.template(fixed.TXT_ANOM_CONC_TITLE, origin=o),
            description=X.template(fixed.TXT_ANOM_CONC_DESC, n=on, total=n, origin=o),
            observed=on, dimension="ORIGEN")),
    ]
    return R.alerts(one, rules)


class AnomalyReport:
    """REP-5 tables, each planned on first access; rows are flagged once."""

    def __init__(self, df: DataFrame, p: Params, method: str = "quantile", top_n: int | None = None,
                 context: bool = True):
        self.df, self.p, self.method = df, p, method
        self.top_n, self.context = top_n or p.top_n, context

    @functools.cached_property
    def flagged(self) -> DataFrame:
        return flag(self.df, self.p, self.method)

    @functools.cached_property
    def cells(self) -> DataFrame:
        return flag_cells(self.flagged)

    @functools.cached_property
    def stats(self) -> DataFrame:
        return A.keep_small(stats(self.cells))                               # one row

    @functools.cached_property
    def top(self) -> DataFrame:
        return context_projection(top_anomalies(self.flagged, self.top_n), self.stats, self.context)

    @functools.cached_property
    def by_dimension(self) -> DataFrame:
        return counts_by_dimension(self.cells)

    @functools.cached_property
    def alerts(self) -> DataFrame:
        return alerts(self.cells, self.stats, self.p)


def anomaly_report(df: DataFrame, p: Params, method: str = "quantile", top_n: int | None = None,
                   context: bool = True) -> AnomalyReport:
    return AnomalyReport(df, p, method, top_n, context)
