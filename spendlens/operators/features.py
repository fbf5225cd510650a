"""ML-1/ML-2: the 26-feature frame of the projection model and the encoder.

Statistics per category/destination/origin/unit are single ``groupBy``
aggregates joined back by broadcast where their counted values are few (by
shuffle otherwise, where AQE splits skewed partitions).  Medians are the skew-safe exact
operator, never a per-group value list.
"""

from __future__ import annotations

from functools import reduce
from typing import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import fixed
from ..functions import scalars as S
from ..params import Params
from ..session import materialize
from . import aggregates as A
from .quantiles import FEW_GROUPS, exact_percentile_scalar, exact_percentiles, ranked_values
from .ranks import placed


def prepare(purchases: DataFrame) -> DataFrame:
    """SCA-1..4 + FIL-5: calendar features, quantity, flags; keep amount > 0
    (rows with a null date stay)."""
    d = S.parse_date("order_date", purchases.schema["order_date"].dataType)
    df = purchases.withColumn("order_date", d).withColumn("amount", S.nan_to_null("amount"))
    cal = S.calendar_features("order_date")
    for name, col in cal.items():
        df = df.withColumn(name, col)
    df = df.withColumn("quantity", S.extract_quantity("detail"))
    for name, col in S.calendar_flags("day", "month").items():
        df = df.withColumn(name, col)
    return df.where(F.col("amount") > 0)


def latest_year_slice(prepared: DataFrame, target_year: int) -> DataFrame:
    """FIL-7: rows of the latest observed year, with ``year`` set to the target.

    The max year is a one-row aggregate, broadcast (proven bound).  (The
    reference's "last 1000 rows" fallback applies only when every year is
    null; an unordered tail has no meaning here, so the slice is then empty.)
    """
    mx = F.broadcast(prepared.agg(F.max("year").alias("_maxy")))
    return (prepared.join(mx, F.col("year") == F.col("_maxy")).drop("_maxy")
            .withColumn("year", F.lit(target_year).cast("int")))


STAT_DIMENSIONS = ["category", "destination", "origin", "unit"]
MEDIAN_DIMENSIONS = ["category", "destination"]     # the model uses these medians (+ the global one)
ALL = "_all"


def group_stats(hist: DataFrame, p: Params) -> DataFrame:
    """AGG-9..13 in one pass: (dim, value, mean, std, median, n) for every
    value of category, destination, origin and unit, plus the group of all
    rows (dim = value = '_all') for the global median.

    One unpivot feeds one partially-aggregated groupBy (means, std), written at once so
    that its groups are counted, and one skew-safe quantile job for the medians the
    features use (category, destination and all rows -- the all-rows group is hot by
    construction).
    The result has one row per dimension value, not per purchase, and is kept
    because the enrichment reads it four times.
    """
    cols = [F.col(c).cast("string").alias(c) for c in STAT_DIMENSIONS]
    long = (hist.select(*cols, F.lit(ALL).alias(ALL), "amount", A.money().alias("money"))       # a row's money once, not once a dimension
            .unpivot(ids=["amount", "money"], values=STAT_DIMENSIONS + [ALL], variableColumnName="dim",
                     valueColumnName="value")
            .where(F.col("value").isNotNull()))
    g = materialize(long.groupBy("dim", "value").agg(A.money_mean_of("money").alias("mean"), F.stddev_samp("amount").alias("std")), "group-means")
    med = exact_percentiles(long.where(F.col("dim").isin(*MEDIAN_DIMENSIONS, ALL)), "amount", [0.5], by=["dim", "value"],
                            names=["median"], accuracy=p.quantile_accuracy, exact=p.exact_quantiles, few=g.count() <= FEW_GROUPS)
    return A.keep_small(g.join(med.drop("n"), ["dim", "value"], "left"))


def _stats_of(gs: DataFrame, dim: str, **names) -> DataFrame:
    return gs.where(F.col("dim") == dim).select(F.col("value").alias(dim),
                                                *[F.col(src).alias(dst) for dst, src in names.items()])


def category_stats(hist: DataFrame, p: Params, gs: DataFrame | None = None) -> DataFrame:
    """AGG-9: mean, exact median and sample std of amount per category."""
    gs = gs if gs is not None else group_stats(hist, p)
    return _stats_of(gs, "category", cat_mean="mean", cat_median="median", cat_std="std")


def destination_stats(hist: DataFrame, p: Params, gs: DataFrame | None = None) -> DataFrame:
    """AGG-10: mean and exact median per destination."""
    gs = gs if gs is not None else group_stats(hist, p)
    return _stats_of(gs, "destination", dest_mean="mean", dest_median="median")


def origin_stats(hist: DataFrame, p: Params | None = None, gs: DataFrame | None = None) -> DataFrame:
    """AGG-11: mean per origin."""
    if gs is None:
        return hist.where(F.col("origin").isNotNull()).groupBy("origin").agg(A.money_mean().alias("origin_mean"))
    return _stats_of(gs, "origin", origin_mean="mean")


def unit_stats(hist: DataFrame, p: Params | None = None, gs: DataFrame | None = None) -> DataFrame:
    """AGG-12: mean per unit."""
    if gs is None:
        return hist.where(F.col("unit").isNotNull()).groupBy("unit").agg(A.money_mean().alias("unit_mean"))
    return _stats_of(gs, "unit", unit_mean="mean")


def global_median(hist: DataFrame, p: Params, gs: DataFrame | None = None) -> DataFrame:
    """AGG-13: median amount (one row), used as the 'previous month' feature."""
    if gs is None:
        return exact_percentile_scalar(hist, "amount", [0.5], ["prev_month_spend"], p.quantile_accuracy, exact=p.exact_quantiles)
    return gs.where(F.col("dim") == ALL).select(F.col("median").alias("prev_month_spend"))


NUMERIC_FEATURES = [
    "cost_center", "amount", "year", "month", "quarter", "weekday", "day", "iso_week",
    "is_month_end", "is_month_start", "is_quarter_end", "quantity",
    "cat_mean", "cat_median", "cat_std", "dest_mean", "dest_median", "origin_mean",
    "unit_mean", "cat_ratio", "dest_ratio", "prev_month_spend",
]


def enrich(forecast: DataFrame, hist: DataFrame, p: Params) -> DataFrame:
    """JOIN-2..5 + SCA-5 + AGG-13: group statistics, ratios, lag feature."""
    return enrich_with(forecast, group_stats(hist, p))


def enrich_with(forecast: DataFrame, gs: DataFrame) -> DataFrame:
    """``enrich`` with statistics that are known already (``group_stats``, perhaps stored)."""
    held = {r["dim"]: r["count"] for r in gs.groupBy("dim").count().collect()}       # a row a dimension
    f = forecast
    for dim, names in (("category", dict(cat_mean="mean", cat_median="median", cat_std="std")),
                       ("destination", dict(dest_mean="mean", dest_median="median")),
                       ("origin", dict(origin_mean="mean")), ("unit", dict(unit_mean="mean"))):
        f = f.join(_whole_if_few(_stats_of(gs, dim, **names), held.get(dim, 0)), dim, "left")
    f = f.withColumn("cat_ratio", S.spend_ratio("amount", "cat_mean"))
    f = f.withColumn("dest_ratio", S.spend_ratio("amount", "dest_mean"))
    last = gs.where(F.col("dim") == ALL).select(F.col("median").alias("prev_month_spend"))
    return f.withColumn("prev_month_spend", A.scalar(last, "prev_month_spend"))


def _whole_if_few(values: DataFrame, n: int) -> DataFrame:
    """A side of one row a value, given whole to every task where its ``n`` values are few:
    rows dealt by a column of few values would meet in as few tasks.  More values are
    joined by shuffle, and AQE splits the hot ones."""
    return F.broadcast(values) if n <= FEW_GROUPS else values


#: Numeric features that have few values together: what a day, a category, the other
#: groups and a line tell.
TOGETHER = (("year", "month", "quarter", "weekday", "day", "iso_week", "is_month_end", "is_month_start", "is_quarter_end"),
            ("cat_mean", "cat_median", "cat_std"), ("dest_mean", "dest_median", "origin_mean", "unit_mean", "prev_month_spend"),
            ("cost_center", "quantity"))


def column_medians(df: DataFrame, columns: Sequence[str], p: Params, together: Sequence[Sequence[str]] = ()) -> DataFrame:
    """AGG-14: exact median of every listed numeric column, one row.

    The columns are unpivoted to (column, value) so one skew-safe quantile
    job covers them all.  Columns that are listed ``together`` are counted by their values
    first, each such set in one hash lookup a row; where those are few, their counts alone
    give the medians, else the quantile job does.
    """
    counts, rest = None, list(columns)
    sets = [own for by in together if (own := [c for c in by if c in columns])] if p.exact_quantiles else []
    if sets:
        cells = materialize(reduce(DataFrame.union, [
            _unpivoted(df.groupBy(*own).agg(F.count(F.lit(1)).alias("_c")), own, ["_c"]).withColumn("_set", F.lit(i))
            for i, own in enumerate(sets)]), "median-cells")
        held = {r["_set"]: r["count"] // len(sets[r["_set"]]) for r in cells.groupBy("_set").count().collect()}     # a row a set
        few = [i for i in range(len(sets)) if held.get(i, 0) <= FEW_GROUPS]
        rest = [c for c in columns if not any(c in sets[i] for i in few)]
        counts = (cells.where(F.col("_set").isin(few) & F.col("_val").isNotNull() & ~F.isnan("_val"))
                  .groupBy("_col", F.col("_val").alias("_v")).agg(F.sum("_c").alias("_c")))
    med = exact_percentiles(_unpivoted(df, rest), "_val", [0.5], by=["_col"], names=["_med"], accuracy=p.quantile_accuracy,
                            exact=p.exact_quantiles, few=len(columns) <= FEW_GROUPS).select("_col", "_med") if rest else None
    if counts is not None:
        known = ranked_values(counts, [0.5], ["_med"], keys=["_col"]).select("_col", "_med")
        med = known if med is None else med.union(known)
    wide = med.groupBy().pivot("_col", list(columns)).agg(F.first("_med"))
    return wide.select(*[F.col(c).alias(f"med_{c}") for c in columns])


def _unpivoted(df: DataFrame, columns: Sequence[str], ids: Sequence[str] = ()) -> DataFrame:
    """(ids, _col, _val): the columns as doubles, one below the other."""
    return df.select(*ids, *[F.col(c).cast("double").alias(c) for c in columns]).unpivot(
        ids=list(ids), values=list(columns), variableColumnName="_col", valueColumnName="_val")


def materialize_counted(df: DataFrame, name: str, columns: Sequence[str]) -> tuple[DataFrame, dict[str, int]]:
    """``df`` written once, and the nulls of each column, counted while it is written."""
    from pyspark.sql import Observation

    seen = Observation(name)
    out = materialize(df.observe(seen, *[F.count_if(F.col(c).isNull()).alias(c) for c in columns]), name)
    return out, seen.get


def impute_medians(df: DataFrame, columns: Sequence[str], p: Params, source: DataFrame | None = None,
                   nulls: dict[str, int] | None = None) -> DataFrame:
    """SCA-6: null numeric values -> that column's exact median (over ``source``,
    where given, in place of ``df`` itself).

    Only columns with nulls go through the median job (``nulls``: known counts;
    without them, the columns whose type allows nulls).  The medians come back
    as one scalar subquery (no join).
    """
    need = [c for c in columns if (nulls[c] if nulls is not None else df.schema[c].nullable)]
    if not need:
        return df
    return impute_with(df, need, A.keep_small(column_medians(df if source is None else source, need, p)))


def impute_with(df: DataFrame, columns: Sequence[str], medians: DataFrame) -> DataFrame:
    """Nulls of the columns replaced by those of the one-row ``medians``."""
    meds = A.scalar(medians)
    return df.withColumns({c: F.coalesce(F.col(c), meds[f"med_{c}"].cast(df.schema[c].dataType)) for c in columns})


def feature_frame(prepared: DataFrame, target_year: int, p: Params) -> DataFrame:
    """ML-2: the latest-year slice re-dated to the target, with the 26
    features (strings still unencoded) and the amount."""
    f = enrich(latest_year_slice(prepared, target_year), prepared, p)
    # The enriched slice is read twice (medians, imputation); write it once to the
    # shared checkpoint folder so the statistics are not recomputed and the lineage
    # stays short.  Its nulls are counted by the way.
    f, nulls = materialize_counted(f, "feature-slice", NUMERIC_FEATURES)
    f = impute_medians(f, NUMERIC_FEATURES, p, nulls=nulls)
    return f.select("request_line", *fixed.FEATURES, "amount")


def label_indexes(fit: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Dense 0-based index of the distinct non-null labels of every column, in sort
    order: (col, label, index, n).  One unpivoted distinct and one range partitioning
    for all columns together, written once as every column's join reads it."""
    long = (fit.select(*[F.col(c).cast("string").alias(c) for c in columns])
            .unpivot(ids=[], values=list(columns), variableColumnName="col", valueColumnName="label")
            .where(F.col("label").isNotNull()).distinct())
    ranked = placed(long, "col", [F.col("label")], "labels")
    return materialize(ranked.select("col", "label", F.col("pos").cast("int").alias("index"), F.col("n").cast("int").alias("n")), "label-indexes")


def encode_with(labels: DataFrame, apply: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``apply`` with the columns replaced by the numbers of ``labels``."""
    held = {r["col"]: r["n"] for r in labels.groupBy("col").agg(F.max("n").alias("n")).collect()}       # a row a column
    out = apply
    for c in columns:
        mine = labels.where(F.col("col") == c).select(F.col("label").alias(f"_l_{c}"), F.col("index").alias(f"_i_{c}"))
        k = held.get(c, 0)
        out = (out.join(_whole_if_few(mine, k), F.col(c).cast("string") == F.col(f"_l_{c}"), "left")
               .withColumn(c, F.coalesce(F.col(f"_i_{c}"), F.lit(k))).drop(f"_i_{c}", f"_l_{c}"))
    return out


def encode_categories(fit: DataFrame, apply: DataFrame, columns: Sequence[str] = fixed.ENCODED_COLUMNS) -> DataFrame:
    """ML-1: integer-encode string columns with labels learnt on ``fit``.

    Labels sorted ascending get 0..k-1; null and unseen labels get k (like
    ``StringIndexer(stringOrderType='alphabetAsc', handleInvalid='keep')``).
    """
    return encode_with(label_indexes(fit, columns), apply, columns)
