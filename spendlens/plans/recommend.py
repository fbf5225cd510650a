"""REP-6: savings recommendations, trends, opportunities, executive summary.

One scan makes the cells of (origin, unit, category); the profiles, the top
categories, the global mean and all five rules read those.  Only the quartiles
and the small orders look at the purchases again.  Every function takes purchase
rows or such cells.  Global scalars are one-row frames, read as scalar
subqueries.  Ordered cuts (first 10 recommendations,
top 3 units, top 5 opportunities, top 10 trends) are ``orderBy().limit()``,
i.e. a per-partition top-k merged on the driver side of the plan, never a
global sort.  Every order ends with the key columns so results are
deterministic.
"""

from __future__ import annotations

import functools
from typing import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import fixed
from ..functions import scalars as S
from ..functions import text as X
from ..operators import aggregates as A
from ..operators.quantiles import exact_percentile_scalar
from ..params import Params
from ..schema import InsufficientData
from ..session import materialize

REC_FIELDS = [("title", T.StringType()), ("description", T.StringType()), ("priority", T.StringType()),
              ("area", T.StringType()), ("impact", T.StringType()), ("actions", T.ArrayType(T.StringType()))]


def spend_cells(df: DataFrame) -> DataFrame:
    """Cells by (origin, unit, category), written once."""
    return materialize(A.cells(df, "origin", "unit", "category"), "spend-cells")


def amount_quartiles(df: DataFrame, p: Params) -> DataFrame:
    """AGG-15: q25 and q75 of the order amounts (one row)."""
    return exact_percentile_scalar(df, "amount", [0.25, 0.75], ["q25", "q75"], p.quantile_accuracy, exact=p.exact_quantiles)


def global_stats(df: DataFrame, p: Params, cells: DataFrame | None = None) -> DataFrame:
    """AGG-15 + global mean/total/count: one row."""
    g = A.scalar(A.measures(df if cells is None else cells).agg(
        A.mean_of().alias("global_mean"), F.sum("amount").alias("total_spend"), A.orders_of().alias("orders")))
    return amount_quartiles(df, p).select(g["global_mean"].alias("global_mean"), g["total_spend"].alias("total_spend"),
                                          g["orders"].alias("orders"), "q25", "q75")


def _profile(df: DataFrame, key: str) -> DataFrame:
    return (A.measures(df).where(F.col(key).isNotNull()).groupBy(key)
            .agg(F.sum("amount").alias("total"), A.mean_of().alias("mean"), A.orders_of().alias("orders")))


def top_categories_by_group(df: DataFrame, group_col: str, k: int = 3) -> DataFrame:
    """AGG-19: top-k categories by spend inside each group (null keys dropped)."""
    g = (df.where(F.col(group_col).isNotNull() & F.col("category").isNotNull())
         .groupBy(group_col, "category").agg(F.sum("amount").alias("total")))
    w = Window.partitionBy(group_col).orderBy(F.col("total").desc(), F.col("category").asc())
    return (g.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
            .select(F.col(group_col).alias("group_value"), F.col("rank").cast("int").alias("rank"),
                    "category", "total"))


def origin_profile(df: DataFrame, stats: DataFrame) -> DataFrame:
    """AGG-17: per origin: total, mean, orders and the class against q25/q75."""
    g = _profile(df, "origin")
    q = A.scalar(stats.select("q25", "q75"))
    cls = (F.when(F.col("mean") > q["q75"], fixed.ORIGIN_CLASS_HIGH)
           .when(F.col("mean") < q["q25"], fixed.ORIGIN_CLASS_LOW)
           .otherwise(fixed.ORIGIN_CLASS_NORMAL))
    return g.select("origin", "total", "mean", "orders", cls.alias("spend_class"))


def unit_profile(df: DataFrame) -> DataFrame:
    """AGG-18 (with FIL-11): per non-null unit: total, mean, orders."""
    return _profile(df, "unit")


def group_size_p75(df: DataFrame, p: Params) -> DataFrame:
    """AGG-16: 75th percentile of the number of orders per origin (one row).

    Sizes that add up to N orders have at most sqrt(2 N) different values, so Spark's
    own exact ``percentile``, which keeps a count for each, is bounded here."""
    sizes = _profile(df, "origin").select(F.col("orders").alias("n"))
    return sizes.agg(F.percentile("n", F.lit(0.75)).alias("p75_orders"))


def _rec_frame(df: DataFrame, rule_no: int, key: Column, metric: Column, **fields) -> DataFrame:
    cols = [F.lit(rule_no).alias("rule_no"), key.cast("string").alias("_key"),
            metric.cast("double").alias("_metric")]
    for name, dtype in REC_FIELDS:
        v = fields[name]
        v = v if isinstance(v, Column) else F.lit(v)
        cols.append(v.cast(dtype).alias(name))
    return df.select(*cols)


def recommendations(cells: DataFrame, p: Params, stats: DataFrame, origins: DataFrame, units: DataFrame) -> DataFrame:
    """RUL-6 (+ AGG-16, TOP-3, TOP-4, TOP-8): five rules, first 10 in rule order."""
    gmean = A.scalar(stats, "global_mean")
    p75 = A.scalar(group_size_p75(cells, p), "p75_orders")
    o, t, m, n = F.col("origin"), F.col("total"), F.col("mean"), F.col("orders")

    r1 = _rec_frame(
        origins.where(F.col("spend_class") == fixed.ORIGIN_CLASS_HIGH), 1, o, t,
        title=X.template(fixed.REC1_TITLE, origin=o),
        description=X.template(fixed.REC1_DESC, origin=o, mean=X.money(m), total=X.money(t)),
        priority=fixed.SEV_HIGH, area=fixed.REC1_AREA,
        impact=X.template(fixed.REC1_IMPACT, saving=X.money(t * p.high_saving)),
        actions=F.array(*[F.lit(a) for a in fixed.REC1_ACTIONS]))
    r2 = _rec_frame(
        origins.where(n > p75), 2, o, t,
        title=X.template(fixed.REC2_TITLE, origin=o),
        description=X.template(fixed.REC2_DESC, origin=o, n=X.grouped_int(n)),
        priority=fixed.SEV_MEDIUM, area=fixed.REC2_AREA, impact=fixed.REC2_IMPACT,
        actions=F.array(*[F.lit(a) for a in fixed.REC2_ACTIONS]))
    top_units = units.orderBy(m.desc(), F.col("unit").asc()).limit(3)          # TOP-4
    u = F.col("unit")
    r3 = _rec_frame(
        top_units.where(m > gmean * p.unit_mean_factor), 3, u, m,
        title=X.template(fixed.REC3_TITLE, unit=u),
        description=X.template(fixed.REC3_DESC, unit=u, mean=X.money(m), total=X.money(t)),
        priority=fixed.SEV_HIGH, area=fixed.REC3_AREA,
        impact=X.template(fixed.REC3_IMPACT, saving=X.money(t * p.unit_saving)),
        actions=F.array(*[F.lit(a) for a in fixed.REC3_ACTIONS]))
    cats = top_categories(cells, 3)                                              # TOP-3
    c = F.col("category")
    r4 = _rec_frame(
        cats, 4, c, t,
        title=X.template(fixed.REC4_TITLE, category=c),
        description=X.template(fixed.REC4_DESC, category=c, total=X.money(t)),
        priority=fixed.SEV_HIGH, area=fixed.REC4_AREA,
        impact=X.template(fixed.REC4_IMPACT, saving=X.money(t * p.category_saving)),
        actions=F.array(X.template(fixed.REC4_ACTIONS[0], category=c),
                        *[F.lit(a) for a in fixed.REC4_ACTIONS[1:]]))
    r5 = _rec_frame(
        units.where(n < p.few_orders), 5, u, t,
        title=X.template(fixed.REC5_TITLE, unit=u),
        description=X.template(fixed.REC5_DESC, unit=u, n=n),
        priority=fixed.SEV_MEDIUM, area=fixed.REC5_AREA, impact=fixed.REC5_IMPACT,
        actions=F.array(*[F.lit(a) for a in fixed.REC5_ACTIONS]))
    allr = r1.unionByName(r2).unionByName(r3).unionByName(r4).unionByName(r5)
    first = allr.orderBy("rule_no", F.col("_metric").desc(), F.col("_key").asc()).limit(p.max_recommendations)
    w = Window.orderBy("rule_no", F.col("_metric").desc(), F.col("_key").asc())  # <= 10 rows
    return first.select(F.row_number().over(w).alias("rec_no"), "rule_no",
                        *[n for n, _ in REC_FIELDS])


def top_categories(df: DataFrame, k: int = 3) -> DataFrame:
    """TOP-3: top k categories by spend (null category dropped)."""
    return (df.where(F.col("category").isNotNull()).groupBy("category")
            .agg(F.sum("amount").alias("total"))
            .orderBy(F.col("total").desc(), F.col("category").asc()).limit(k))


def top_units_by_mean(df: DataFrame, k: int = 3) -> DataFrame:
    """TOP-4: top k units by mean amount."""
    return unit_profile(df).orderBy(F.col("mean").desc(), F.col("unit").asc()).limit(k)


OPP_FIELDS = [("kind", T.StringType()), ("dimension", T.StringType()), ("value", T.StringType()),
              ("description", T.StringType()), ("spend", T.DoubleType()), ("saving", T.DoubleType()),
              ("saving_pct", T.DoubleType()), ("complexity", T.StringType()), ("lead_time", T.StringType())]


def small_orders(df: DataFrame, stats: DataFrame) -> DataFrame:
    """FIL-9: orders strictly below the 25th percentile of amount."""
    return df.where(F.col("amount") < A.scalar(stats, "q25"))


def small_order_totals(df: DataFrame, stats: DataFrame) -> DataFrame:
    """AGG-31: count and spend of the small orders (one row)."""
    return small_orders(df, stats).agg(F.count(F.lit(1)).alias("small_orders"),
                                       F.sum("amount").alias("small_spend"))


def opportunities(df: DataFrame, p: Params, stats: DataFrame, origins: DataFrame) -> DataFrame:
    """RUL-8 (+ FIL-9, AGG-31, TOP-7): expensive origins and small orders,
    top 5 by saving."""
    o, t = F.col("origin"), F.col("total")

    def frame(src, **f):
        cols = []
        for name, dtype in OPP_FIELDS:
            v = f[name]
            v = v if isinstance(v, Column) else F.lit(v)
            cols.append(v.cast(dtype).alias(name))
        return src.select(*cols)

    o1 = frame(origins.where(F.col("mean") > A.scalar(stats, "global_mean") * p.saving_mean_factor),
               kind=fixed.OPP1_KIND, dimension=fixed.OPP1_DIMENSION, value=o,
               description=X.template(fixed.OPP1_DESC, origin=o), spend=t,
               saving=t * p.origin_saving, saving_pct=round(p.origin_saving * 100.0, 10),
               complexity=fixed.OPP1_COMPLEXITY, lead_time=fixed.OPP1_LEAD_TIME)
    so = small_order_totals(df, stats)
    n, s = F.col("small_orders"), F.coalesce(F.col("small_spend"), F.lit(0.0))
    o2 = frame(so.where(n > p.small_orders_min),
               kind=fixed.OPP2_KIND, dimension=fixed.OPP2_DIMENSION, value=fixed.OPP2_VALUE,
               description=X.template(fixed.OPP2_DESC, n=X.grouped_int(n)), spend=s,
               saving=s * p.small_saving, saving_pct=round(p.small_saving * 100.0, 10),
               complexity=fixed.OPP2_COMPLEXITY, lead_time=fixed.OPP2_LEAD_TIME)
    top = o1.unionByName(o2).orderBy(F.col("saving").desc(), F.col("value").asc()).limit(p.max_opportunities)
    w = Window.orderBy(F.col("saving").desc(), F.col("value").asc())  # <= 5 rows
    return top.select(F.row_number().over(w).alias("opp_no"), *[n for n, _ in OPP_FIELDS])


# ---------------------------------------------------------------- trends ----

def period_parts(df: DataFrame, p: Params) -> DataFrame:
    """FIL-10 (+ AGG-29): the last ``recent_months`` observed months are
    'recent', the ones before 'prior'.  Empty unless >= 2 x recent months
    were observed.  At most one row per observed month (a bounded list)."""
    return _recent_and_prior(A.observed_periods(df), p)


def _recent_and_prior(per: DataFrame, p: Params) -> DataFrame:
    k = p.recent_months
    w = Window.orderBy(F.col("period").desc())   # one row per observed month
    ranked = per.withColumn("_rk", F.row_number().over(w)).withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy()))
    return ranked.where((F.col("_n") >= 2 * k) & (F.col("_rk") <= 2 * k)).select(
        "period", F.when(F.col("_rk") <= k, F.lit("recent")).otherwise(F.lit("prior")).alias("part"))


TOP_VALUES = 5


def top_values_by_frequency(df: DataFrame, labels: Sequence[str], k: int = TOP_VALUES) -> DataFrame:
    """TOP-5: the k most frequent values per dimension (null dropped)."""
    u = A.unpivot_dimensions(df, labels).where(F.col("value").isNotNull())
    g = u.groupBy("dimension", "value").agg(F.count(F.lit(1)).alias("orders"))
    w = Window.partitionBy("dimension").orderBy(F.col("orders").desc(), F.col("value").asc())
    return g.withColumn("rank", F.row_number().over(w).cast("int")).where(F.col("rank") <= k)


def _long_months(df: DataFrame, labels: Sequence[str]) -> DataFrame:
    """Rows as (dimension, value, period, amount)."""
    cols = [F.col(fixed.DIMENSIONS[l]).cast("string").alias(l) for l in labels]
    return df.select(*cols, A.month_start("order_date").alias("period"), "amount").unpivot(
        ids=["period", "amount"], values=list(labels), variableColumnName="dimension", valueColumnName="value")


def trend_months(df: DataFrame, labels: Sequence[str]) -> DataFrame:
    """Spend and orders by (dimension, value, month), written once: top values,
    periods and changes all come from it."""
    return materialize(_long_months(df, labels).groupBy("dimension", "value", "period")
                       .agg(F.sum("amount").alias("spend"), F.count(F.lit(1)).alias("orders")), "trend-months")


def _top_values(months: DataFrame) -> DataFrame:
    g = months.where(F.col("value").isNotNull()).groupBy("dimension", "value").agg(F.sum("orders").alias("orders"))
    w = Window.partitionBy("dimension").orderBy(F.col("orders").desc(), F.col("value").asc())
    return g.withColumn("_rk", F.row_number().over(w)).where(F.col("_rk") <= TOP_VALUES)


def _parts(months: DataFrame, p: Params) -> DataFrame:
    return _recent_and_prior(months.where(F.col("period").isNotNull()).select("period").distinct(), p)


def restrict_to_top_values(df: DataFrame, labels: Sequence[str], p: Params) -> DataFrame:
    """JOIN-8: rows whose dimension value is a top-5 value and whose month is
    in the recent/prior list.  Both lists come from one table of months and are
    bounded (5 x dims, 12 months), so they are broadcast."""
    months = trend_months(df, labels)
    tops = F.broadcast(_top_values(months).select("dimension", "value"))
    return _long_months(df, labels).join(tops, ["dimension", "value"]).join(F.broadcast(_parts(months, p)), "period")


def period_spend_change(df: DataFrame, labels: Sequence[str], p: Params) -> DataFrame:
    """AGG-30 (+ SCA-15): per top value: recent vs prior spend and % change
    (values whose prior spend is 0 are skipped).

    One scan: spend and orders per (dimension, value, month) are written once,
    and the top values, the months and the change all come from that table."""
    months = trend_months(df, labels)
    parts = _parts(months, p)
    spend = lambda part: F.coalesce(F.sum(F.when(F.col("part") == part, F.col("spend"))), F.lit(0.0))
    g = (months.where(F.col("value").isNotNull()).join(F.broadcast(parts), "period", "left")
         .groupBy("dimension", "value")
         .agg(F.sum("orders").alias("orders"), spend("recent").alias("recent"), spend("prior").alias("prior")))
    w = Window.partitionBy("dimension").orderBy(F.col("orders").desc(), F.col("value").asc())
    g = g.withColumn("_rk", F.row_number().over(w)).where((F.col("_rk") <= TOP_VALUES) & (F.col("prior") != 0))
    chg = (F.col("recent") - F.col("prior")) / F.col("prior") * 100.0
    return g.select("dimension", "value", "recent", "prior", chg.alias("change_pct"),
                    S.change_direction(chg).alias("direction"))


def dimension_trends(df: DataFrame, labels: Sequence[str], p: Params) -> DataFrame:
    """RUL-9: significant changes (|%| > 10), top 10 by |%|."""
    ch = period_spend_change(df, labels, p).where(F.abs("change_pct") > p.trend_min_pct)
    top = ch.orderBy(F.abs("change_pct").desc(), F.col("dimension").asc(), F.col("value").asc()) \
        .limit(p.max_trends)
    return top.select("dimension", "value", "direction", "change_pct", "recent", "prior")


# ---------------------------------------------------------------- summary ---

def spend_summary(df: DataFrame, opps: DataFrame) -> DataFrame:
    """AGG-32: total spend, orders, mean, saving sum and saving % (one row)."""
    g = A.measures(df).agg(F.sum("amount").alias("total_spend"), A.orders_of().alias("orders"), A.mean_of().alias("mean"))
    s = opps.agg(F.coalesce(F.sum("saving"), F.lit(0.0)).alias("saving"),
                 F.count(F.lit(1)).alias("opportunities"))
    sv = A.scalar(s)
    g = g.withColumn("saving", sv["saving"]).withColumn("opportunities", sv["opportunities"])
    return g.withColumn(
        "saving_pct", F.try_divide(F.col("saving"), F.col("total_spend")) * 100.0)


def priority_actions(recs: DataFrame, k: int = 3) -> DataFrame:
    """TOP-9: first k recommendations with severity critical or high."""
    return (recs.where(F.col("priority").isin(fixed.SEV_CRITICAL, fixed.SEV_HIGH))
            .orderBy("rec_no").limit(k)
            .select("rec_no", "title"))


def executive_summary(df: DataFrame, recs: DataFrame, opps: DataFrame) -> DataFrame:
    """RUL-7: the summary text (one row)."""
    summ = spend_summary(df, opps)
    nrec = recs.agg(F.count(F.lit(1)).alias("_nrec"))
    top = priority_actions(recs).withColumn("_i", F.row_number().over(Window.orderBy("rec_no")))
    items = top.agg(F.sort_array(F.collect_list(F.struct("_i", "title"))).alias("_items"))
    one = summ.withColumn("_nrec", A.scalar(nrec, "_nrec")).withColumn("_items", A.scalar(items, "_items"))
    item_lines = F.transform("_items", lambda x: F.concat(F.lit("\n   "), x["_i"].cast("string"),
                                                          F.lit(". "), x["title"]))
    head = F.concat_ws(
        "\n",
        F.lit(fixed.SUM_HEAD), F.lit(""), F.lit(fixed.SUM_NOW),
        X.template(fixed.SUM_TOTAL, total=X.money("total_spend")),
        X.template(fixed.SUM_ORDERS, n=X.grouped_int("orders")),
        X.template(fixed.SUM_MEAN, mean=X.money("mean")),
        F.lit(""), F.lit(fixed.SUM_OPPS),
        X.template(fixed.SUM_RECS, n=F.col("_nrec")),
        X.template(fixed.SUM_NOPPS, n=F.col("opportunities")),
        X.template(fixed.SUM_SAVING, saving=X.money("saving"), pct=X.fixed_n("saving_pct", 2)),
        F.lit(""), F.lit(fixed.SUM_ACTIONS),
    )
    text = F.concat(head, F.lit("\n"), F.array_join(item_lines, ""), F.lit("\n\n"),
                    X.template(fixed.SUM_NEXT, n=F.size("_items")))
    return one.select(text.alias("summary"))


class RecommendationReport:
    """REP-6 tables, each planned on first access; shared profiles built once."""

    def __init__(self, df: DataFrame, p: Params, dimensions: Sequence[str] = ("ORIGEN", "UN"),
                 include_trends: bool = True):
        self.df, self.p, self.dimensions, self.include_trends = df, p, list(dimensions), include_trends

    # written once; one row / one row per origin or unit / <= 10 / <= 5 rows: kept
    # because several tables read them
    @functools.cached_property
    def cells(self) -> DataFrame:
        return spend_cells(self.df)

    @functools.cached_property
    def stats(self) -> DataFrame:
        return A.keep_small(global_stats(self.df, self.p, self.cells))

    @functools.cached_property
    def origins(self) -> DataFrame:
        return A.keep_small(origin_profile(self.cells, self.stats))

    @functools.cached_property
    def units(self) -> DataFrame:
        return A.keep_small(unit_profile(self.cells))

    @functools.cached_property
    def origin_top_categories(self) -> DataFrame:
        return top_categories_by_group(self.cells, "origin")

    @functools.cached_property
    def unit_top_categories(self) -> DataFrame:
        return top_categories_by_group(self.cells, "unit")

    @functools.cached_property
    def recommendations(self) -> DataFrame:
        return A.keep_small(recommendations(self.cells, self.p, self.stats, self.origins, self.units))

    @functools.cached_property
    def opportunities(self) -> DataFrame:
        return A.keep_small(opportunities(self.df, self.p, self.stats, self.origins))

    @functools.cached_property
    def trends(self) -> DataFrame | None:
        return dimension_trends(self.df, self.dimensions, self.p) if self.include_trends else None

    @functools.cached_property
    def summary(self) -> DataFrame:
        return executive_summary(self.cells, self.recommendations, self.opportunities)


def recommendation_report(df: DataFrame, p: Params, dimensions: Sequence[str] = ("ORIGEN", "UN"),
                          include_trends: bool = True) -> RecommendationReport:
    """REP-6; raises ``InsufficientData`` where there are no purchases (read from
    the cells that the report needs anyway)."""
    report = RecommendationReport(df, p, dimensions, include_trends)
    if report.cells.isEmpty():
        raise InsufficientData("no purchases to analyse")
    return report


def quick_recommendations(df: DataFrame, p: Params) -> DataFrame:
    """PRJ-2 (recommendations): total, first 5 titles, first 3 opportunities,
    summary -- one row."""
    rep = recommendation_report(df, p, include_trends=False)
    recs = rep.recommendations
    n = recs.agg(F.count(F.lit(1)).alias("total_recommendations"))
    t5 = recs.where(F.col("rec_no") <= 5).agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("rec_no", "title"))),
                                 lambda x: x["title"]), " | ").alias("top_recommendations"))
    o3 = rep.opportunities.where(F.col("opp_no") <= 3).agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("opp_no", "description"))),
                                 lambda x: x["description"]), " | ").alias("top_opportunities"))
    return (n.withColumn("top_recommendations", A.scalar(t5, "top_recommendations"))
            .withColumn("top_opportunities", A.scalar(o3, "top_opportunities"))
            .withColumn("summary", A.scalar(rep.summary, "summary")))

