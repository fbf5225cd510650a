"""Plan properties: filters reach the scan, no row-at-a-time Python, results
do not depend on the number of shuffle partitions."""

import re

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

import __spark_entry__ as E
from spendlens.operators import aggregates as A
from spendlens.operators import isolation as IF
from spendlens.plans import anomalies as AN
from spendlens.plans import monitoring as M
from spendlens.plans import projection as PR
from spendlens.plans import quality as Q
from spendlens.plans import recommend as RC
from spendlens.schema import InsufficientData, conform
from spendlens.sources import purchases as P
from spendlens.suite import q_real_input as RI
from spendlens.suite.core import PARAMS, YEAR, base

from .conftest import SF_SMALL


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("key", ["monitoring_headline", "quality_report", "recommendations",
                                 "dimension_trends", "anomaly_stats", "feature_frame"])
def test_no_python_udf_and_pushdown(spark, key):
    df = E.queries()[key](spark, SF_SMALL)
    df.collect()
    plan = _plan(df)
    assert "BatchEvalPython" not in plan
    assert "PythonUDF" not in plan


def _fact_scans(spark, monkeypatch, modules, build):
    """Scans of the staged purchases in all that ``build`` runs or returns (frames): the
    plans of the tables that it writes by the way, and of the frames."""
    seen = []

    def scans(df):
        text = df._jdf.queryExecution().optimizedPlan().toString()
        return len(re.findall(r"Relation \[[^\]]*request_line", text))

    for module in modules:
        if hasattr(module, "materialize"):
            real = module.materialize
            monkeypatch.setattr(module, "materialize", lambda df, name, real=real: (seen.append(scans(df)), real(df, name))[1])
        if hasattr(module, "keep_small"):
            kept = module.keep_small
            monkeypatch.setattr(module, "keep_small", lambda df, kept=kept: (seen.append(scans(df)), kept(df))[1])
    return sum(scans(df) for df in build()) + sum(seen)


def test_monitoring_report_scans_once(spark, monkeypatch):
    def build():
        rep = M.monitoring_report(P.forecast_history_window(base(spark, SF_SMALL), YEAR, PARAMS), YEAR, PARAMS, 4e8, ["ORIGEN", "UN"])
        for df in (rep.headline, rep.monthly, rep.breakdown, rep.alerts):
            df.collect()
        return []
    assert _fact_scans(spark, monkeypatch, [A], build) == 1


def test_projection_report_scans_once(spark, monkeypatch):
    def build():
        rep = PR.projection_report(P.forecast_history_window(base(spark, SF_SMALL), 2002, PARAMS), 2002, PARAMS, 4e8, ["ORIGEN"])
        for df in (rep.headline, rep.monthly, rep.breakdown, rep.alerts):
            df.collect()
        return []
    assert _fact_scans(spark, monkeypatch, [A, PR], build) == 1


def test_recommendations_scan_cells_quartiles_and_small_orders(spark, monkeypatch):
    def build():
        rep = RC.recommendation_report(P.recommendation_window(base(spark, SF_SMALL), YEAR, PARAMS), PARAMS)
        for df in (rep.recommendations, rep.opportunities, rep.summary, rep.origins, rep.units):
            df.collect()
        return []
    # one scan of cells, two of the quartiles (sketch, counts), one of the small orders
    assert _fact_scans(spark, monkeypatch, [RC, A], build) <= 4


def test_anomaly_report_scans(spark, monkeypatch):
    def build():
        rep = AN.anomaly_report(P.latest_year_fallback(base(spark, SF_SMALL), YEAR), PARAMS, "quantile")
        for df in (rep.stats, rep.by_dimension, rep.alerts):
            df.collect()
        return [rep.top]
    # two for the threshold, one for the cells, one for the top list
    assert _fact_scans(spark, monkeypatch, [AN, A], build) <= 4


def test_isolation_sample_reads_narrow_columns(spark):
    rows = AN.clean(P.purchases_year(base(spark, SF_SMALL), YEAR))
    text = IF.sample(rows, "amount", 100, 256, 42, 100_000)._jdf.queryExecution().executedPlan().toString()
    read = re.search(r"ReadSchema: struct<([^>]*)>", text).group(1)
    assert {c.split(":")[0] for c in read.split(",")} <= {"order_date", "amount", "request_line", "request_id"}
    assert "Generate explode" not in text                                   # one draw a row


def test_catalogue_join_spreads_hot_and_null_keys(spark):
    n = 4000
    fact = spark.range(n).select(
        F.when(F.col("id") % 3 == 0, 1).when(F.col("id") % 3 == 1, F.lit(None)).otherwise((F.col("id") % 50).cast("int") + 2).cast("int").alias("cost_center"),
        F.lit("u").alias("company"), F.col("id").cast("string").alias("request_id"), F.lit("1").alias("line_no"),
        F.lit(1.0).alias("amount"))
    cat = spark.range(60).select(F.col("id").cast("int").alias("cost_center_id"), F.lit("u").alias("unit"), F.lit("d").alias("destination"),
                                 *[F.lit(None).cast("string").alias(c) for c in ("level6", "level7", "level8", "nature")])
    keep = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold")}
    try:
        for k, v in zip(keep, ("32", "false", "-1")):
            spark.conf.set(k, v)
        small, large = P.join_catalogue(fact, cat), P.join_catalogue(fact, cat, broadcast_rows=0)
        assert "BroadcastHashJoin" in _plan(small) and "SortMergeJoin" in _plan(large)
        assert sorted(map(tuple, small.collect()), key=repr) == sorted(map(tuple, large.collect()), key=repr)
        most = large.groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0]
    finally:
        for k, v in keep.items():
            spark.conf.set(k, v)
    assert most < n / 6            # the hot key and the null key hold a third each


def test_files_by_year_are_pruned(spark):
    rows = RI._scan(spark, SF_SMALL).rows
    text = P.base_purchases(rows, RI.raw_inputs(spark, SF_SMALL)[1], start="2000-01-01", end="2001-12-31") \
        ._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^\]]*order_year[^\]]*2000", text)


def test_quantiles_run_no_job_while_planned(spark):
    df = E.queries()["amount_quartiles"](spark, SF_SMALL)
    assert "materialized" not in df._jdf.queryExecution().optimizedPlan().toString()


def test_year_windows_prune_partitions(spark):
    text = E.queries()["purchases_year"](spark, SF_SMALL)._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^\]]*order_year", text)
    assert "GreaterThanOrEqual(order_date" in text


def test_monitoring_scan_is_pruned(spark):
    prepared = M.prepare(P.forecast_history_window(base(spark, SF_SMALL), YEAR, PARAMS))
    text = A.cells(prepared, "year", "month")._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^\]]*order_year", text)
    assert "ReadSchema: struct<order_date:timestamp_ntz,amount:double>" in text


def test_exact_money_mean_does_not_depend_on_partitioning(spark):
    # 32 amounts of three decimals whose mean ends exactly on half a unit of the sixth decimal
    rows = [(1000.001 * i + 0.054 * (i == 7),) for i in range(32)]
    means = set()
    for parts in (1, 2, 7, 32):
        df = spark.createDataFrame(rows, "amount double").repartition(parts)
        means.add(df.agg(A.money_mean().alias("m")).first()["m"])
    assert len(means) == 1


@pytest.mark.parametrize("amounts,mean", [
    ([1e16, 1.0], (1e16 + 1) / 2), ([float("inf"), 1.0], 1.0), ([0.00004, 0.00004], 0.00004), ([1.00001, 1.00003], 1.00002),
    ([123456.78901, 0.0], 61728.394505), ([4e27, 4e27], 4e27), ([9e27, 9e27], None), ([None, float("inf")], None), ([-3.5, 1.5], -1.0), ([1e300], None)])
def test_money_means(spark, amounts, mean):
    """Any scale, no overflow; values that no decimal holds are left out of both sums."""
    df = spark.createDataFrame([(a,) for a in amounts], "amount double")
    cells = A.cells(df, F.lit(1).alias("g"))
    got = [df.agg(A.money_mean().alias("m")).first()["m"], cells.agg(A.mean_of().alias("m")).first()["m"]]
    assert got == [None, None] if mean is None else got == pytest.approx([mean, mean], rel=1e-15)


def test_profile_counts_amounts_that_no_decimal_holds(spark):
    df = base(spark, SF_SMALL).drop("order_year").limit(50).withColumn("amount", F.lit(float("inf")))
    assert Q.profile(df, PARAMS).first()["unfit_amounts"] == 50


def test_reports_raise_on_missing_data(spark):
    staged = base(spark, SF_SMALL)
    with pytest.raises(InsufficientData):
        Q.quality_report(staged.limit(0), PARAMS)
    with pytest.raises(InsufficientData):
        RC.recommendation_report(staged.limit(0), PARAMS)
    with pytest.raises(InsufficientData):
        M.monitoring_report(P.forecast_history_window(staged, 1990, PARAMS), 1990, PARAMS)
    with pytest.raises(InsufficientData):
        PR.projection_report(staged.limit(0), 2002, PARAMS)
    with pytest.raises(InsufficientData):
        P.latest_year_fallback(staged, 1980)


def test_all_dimensions_and_unknown_ones(spark):
    rep = PR.projection_report(P.forecast_history_window(base(spark, SF_SMALL), 2002, PARAMS), 2002, PARAMS,
                               dimensions=["EMPRESA", "ORIGEN"])
    assert {r["dimension"] for r in rep.breakdown.collect()} == {"EMPRESA", "ORIGEN"}
    with pytest.raises(ValueError):
        A.dimension_breakdown(rep.prepared, ["NOSUCH"])


def test_nan_is_null_at_the_scan(spark):
    schema = T.StructType([T.StructField("k", T.StringType()), T.StructField("x", T.DoubleType())])
    df = spark.createDataFrame([("a", float("nan")), ("a", 2.0), ("b", None)], schema)
    got = conform(df, schema, "t").agg(F.count_if(F.col("x").isNull()).alias("n"), F.sum("x").alias("s")).first()
    assert (got["n"], got["s"]) == (2, 2.0)


@pytest.mark.parametrize("key", ["dimension_breakdown", "top_categories_by_group", "quality_examples"])
def test_partition_count_independent(spark, key):
    q = E.queries()[key]
    old = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "1")
        a = sorted(map(tuple, q(spark, SF_SMALL).collect()), key=repr)
        spark.conf.set("spark.sql.shuffle.partitions", "13")
        b = sorted(map(tuple, q(spark, SF_SMALL).collect()), key=repr)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    assert a == b
