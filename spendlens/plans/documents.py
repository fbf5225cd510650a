"""SRC-7: the five reports as nested JSON documents, one row each.

A document is assembled from the long tables of a report: lists become arrays in
report order, key-value tables become maps, breakdowns become maps of lists.  All
tables that go in are bounded (months, top-k rows, alerts, problems); profiles by
origin and unit, which are not, go in with their first ``most`` entries by spend -
the tables themselves stay whole.  The date is ``as_of``, never the clock.
"""

from __future__ import annotations

import functools
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import fixed
from ..operators import aggregates as A
from ..params import Params
from .anomalies import AnomalyReport
from .monitoring import MonitoringReport
from .projection import ProjectionReport
from .quality import QualityReport
from .recommend import RecommendationReport

Names = Sequence[tuple[str, str]]


def _fields(df: DataFrame, names: Names) -> list[Column]:
    """The named columns under their document names; null where the table lacks one."""
    return [(F.col(c) if c in df.columns else F.lit(None).cast("double")).alias(n) for n, c in names]


def _scalar(df: DataFrame, value: Column) -> Column:
    return df.agg(value.alias("v")).scalar()


def _listed(df: DataFrame, order: str, value: Column) -> Column:
    """The rows as an array, by the order column (values may hold maps, which have no order)."""
    rows = F.array_sort(F.collect_list(F.struct(F.col(order).alias("k"), value.alias("v"))),
                        lambda a, b: F.when(a["k"] < b["k"], -1).when(a["k"] > b["k"], 1).otherwise(0))
    return _scalar(df, F.transform(rows, lambda x: x["v"]))


def array(df: DataFrame, order: str, names: Names, *more: Column) -> Column:
    return _listed(df, order, F.struct(*_fields(df, names), *more))


def mapping(df: DataFrame, order: str, key: str, value: Column) -> Column:
    """The rows as a map, entries by the order column."""
    return F.map_from_entries(_listed(df, order, F.struct(F.col(key).alias("key"), value.alias("value"))))


def breakdowns(df: DataFrame) -> Column:
    """Breakdown rows as a map of dimension to its list."""
    rows = F.sort_array(F.collect_list(F.struct("rank", F.struct(*_fields(df, fixed.DOC_BREAKDOWN)).alias("v"))))
    lists = df.groupBy("dimension").agg(F.transform(rows, lambda x: x["v"]).alias("rows"))
    return mapping(lists, "dimension", "dimension", F.col("rows"))


def _document(one: DataFrame, names: Names, date_name: str, p: Params, **parts: Column) -> DataFrame:
    head = [F.lit(p.as_of.isoformat()).alias(date_name), *_fields(one, names)]
    whole = F.struct(*head, *[v.alias(k) for k, v in parts.items()])
    return one.select(F.to_json(whole, {"ignoreNullFields": "false"}).alias("document"))


def _top(df: DataFrame, most: int) -> DataFrame:
    return df.orderBy(F.col("total").desc(), F.col(df.columns[0])).limit(most)


def _profiles(profile: DataFrame, key: str, categories: DataFrame, most: int, *more: Column) -> Column:
    first = _top(profile, most)
    best = (categories.join(first.select(F.col(key).alias("group_value")), "group_value")
            .groupBy("group_value").agg(F.map_from_entries(F.transform(
                F.sort_array(F.collect_list(F.struct("rank", "category", "total"))),
                lambda x: F.struct(x["category"], x["total"]))).alias("top")))
    rows = first.join(best, F.col(key) == F.col("group_value"), "left")
    return mapping(rows, key, key, F.struct(*_fields(rows, fixed.DOC_PROFILE), *more, F.col("top").alias("top_categorias")))


@functools.singledispatch
def document(report, most: int = 1000) -> DataFrame:
    """One row, ``document``: the report as JSON."""
    raise TypeError(f"no document for {type(report).__name__}")


@document.register
def _(report: MonitoringReport, most: int = 1000) -> DataFrame:
    return _document(report.headline, fixed.DOC_MONITORING, "fecha_generacion", report.p,
                     gastos_mensuales=array(report.monthly, "month", fixed.DOC_MONTH),
                     desgloses=breakdowns(report.breakdown), alertas=array(report.alerts, "alert_no", fixed.DOC_ALERT))


@document.register
def _(report: ProjectionReport, most: int = 1000) -> DataFrame:
    return _document(report.headline, fixed.DOC_PROJECTION, "fecha_generacion", report.p,
                     proyeccion_mensual=array(report.monthly, "month", fixed.DOC_MONTH),
                     desgloses=breakdowns(report.breakdown), alertas=array(report.alerts, "alert_no", fixed.DOC_ALERT))


@document.register
def _(report: QualityReport, most: int = 1000) -> DataFrame:
    problems = report.problems
    if report.details:
        shown = [c for c in report.examples.columns if c not in ("column_label", "kind", "example_no")]
        rows = F.sort_array(F.collect_list(F.struct("example_no", F.struct(*[F.col(c).cast("string").alias(c) for c in shown]).alias("v"))))
        lists = report.examples.groupBy("column_label", "kind").agg(F.transform(rows, lambda x: x["v"]).alias("ejemplos"))
        problems = problems.join(lists, ["column_label", "kind"], "left")
        more = [F.col("ejemplos")]
    else:
        more = []
    nulls = report.null_counts
    return _document(report.profile, fixed.DOC_QUALITY, "fecha_analisis", report.p,
                     valores_nulos=mapping(nulls, "column_no", "column_label", F.col("nulls")),
                     porcentaje_nulos=mapping(nulls, "column_no", "column_label", F.col("null_pct")),
                     problemas=array(problems, "problem_no", fixed.DOC_PROBLEM, *more),
                     recomendaciones=_listed(report.advice, "advice_no", F.col("advice")))


@document.register
def _(report: AnomalyReport, most: int = 1000) -> DataFrame:
    top = report.top
    more = [F.date_format("order_date", "yyyy-MM-dd").alias("fecha_pedido")]
    if report.context:
        more.append(F.struct(*_fields(top, fixed.DOC_CONTEXT)).alias("contexto"))
    counts = report.by_dimension
    by = lambda label: mapping(counts.where(F.col("dimension") == label), "rank", "value", F.col("anomalies"))     # noqa: E731
    rows = F.sort_array(F.collect_list(F.struct((-F.col("amount")).alias("a"), F.col("order_date").alias("b"),
                                                F.struct(*_fields(top, fixed.DOC_ANOMALY), *more).alias("v"))))
    return _document(report.stats, fixed.DOC_ANOMALIES, "fecha_analisis", report.p,
                     anomalias_top=_scalar(top, F.transform(rows, lambda x: x["v"])),
                     anomalias_por_origen=by("ORIGEN"), anomalias_por_categoria=by("CATEGORIA"),
                     alertas=array(report.alerts, "alert_no", fixed.DOC_ALERT))


@document.register
def _(report: RecommendationReport, most: int = 1000) -> DataFrame:
    recs = report.recommendations
    spark = report.df.sparkSession
    trends = report.trends
    if trends is None:
        none = "array<struct<" + ",".join(f"{n}:string" for n, _ in fixed.DOC_TREND) + ">>"
        trend_list = F.array().cast(none)
    else:
        rows = F.sort_array(F.collect_list(F.struct((-F.abs("change_pct")).alias("a"), F.col("dimension").alias("b"),
                                                    F.col("value").alias("c"), F.struct(*_fields(trends, fixed.DOC_TREND)).alias("v"))))
        trend_list = _scalar(trends, F.transform(rows, lambda x: x["v"]))
    one = spark.range(1)
    return _document(one, [], "fecha_generacion", report.p,
                     recomendaciones=array(recs, "rec_no", fixed.DOC_RECOMMENDATION),
                     analisis_origen=_profiles(report.origins, "origin", report.origin_top_categories, most,
                                               F.col("spend_class").alias("clasificacion_gasto")),
                     analisis_un=_profiles(report.units, "unit", report.unit_top_categories, most),
                     tendencias=trend_list,
                     oportunidades_ahorro=array(report.opportunities, "opp_no", fixed.DOC_OPPORTUNITY),
                     resumen_ejecutivo=A.scalar(report.summary, "summary"))
