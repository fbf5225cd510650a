"""What one task holds or reads does not grow with the tables (round 3, F2 to F21)."""

import contextlib
import io
import re

import pytest
from pyspark.sql import functions as F

from spendlens.operators import features as FE
from spendlens.operators import model as ML
from spendlens.operators.quantiles import exact_percentiles
from spendlens.params import TEST
from spendlens.session import materialize
from spendlens.sources import fixtures as fx
from spendlens.sources import purchases as P

from .conftest import SF_SMALL


def plan(df) -> str:
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain()
    return out.getvalue()


@pytest.fixture
def shuffled_joins(spark):
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_purchases_are_dealt_by_request_once(spark, shuffled_joins):
    """Wide rows are not shuffled again for the 22 keys."""
    df = P.base_purchases(fx.purchases_raw(spark, SF_SMALL), fx.catalogue(spark, SF_SMALL))
    text = plan(df)
    assert "Exchange hashpartitioning(origin" not in text
    assert text.count("Exchange hashpartitioning(request_id") == 2
    rows = spark.read.parquet(f"{SF_SMALL}/lineitem.parquet").select("l_orderkey", "l_linenumber").distinct()
    assert df.select("request_line").count() >= rows.count()


def test_lines_of_a_task_are_bounded(spark, shuffled_joins, monkeypatch, tmp_path):
    """The parts in which lines are joined, grouped and written follow the lines, so none has to spill."""
    day = F.lit("2000-01-02").cast("timestamp_ntz")
    i = F.col("id")
    for name, rows, columns in (
            ("region", 1, [i.cast("int").alias("r_regionkey"), F.lit("R").alias("r_name")]),
            ("nation", 2, [i.cast("int").alias("n_nationkey"), F.lit("N").alias("n_name"), F.lit(0).alias("n_regionkey")]),
            ("customer", 50, [i.alias("c_custkey"), (i % 2).cast("int").alias("c_nationkey"), F.lit("A").alias("c_mktsegment")]),
            ("part", 40, [i.alias("p_partkey"), F.lit("b").alias("p_brand"), F.lit("t").alias("p_type"), F.lit("n").alias("p_name")]),
            ("orders", 1500, [i.alias("o_orderkey"), (i % 50).alias("o_custkey"), day.alias("o_orderdate"), F.lit("5-LOW").alias("o_orderpriority")]),
            ("lineitem", 6000, [(i % 1500).alias("l_orderkey"), (i % 40).alias("l_partkey"), F.floor(i / 1500).cast("int").alias("l_linenumber"),
                                F.lit(10.0).alias("l_extendedprice"), day.alias("l_shipdate")])):
        spark.range(rows).select(*columns).write.parquet(str(tmp_path / f"{name}.parquet"))
    monkeypatch.setattr(fx, "LINES_A_TASK", 100, raising=False)
    df = P.base_purchases(fx.purchases_raw(spark, str(tmp_path)), fx.catalogue(spark, str(tmp_path)))
    assert [int(n) for n in re.findall(r"Exchange hashpartitioning\(request_id#\d+, (\d+)\)", plan(df))] == [60, 60]
    held = [r["count"] for r in df.groupBy(F.spark_partition_id()).count().collect()]
    assert max(held) < 300 and sum(held) == 6000


def test_requests_repeat_and_are_null(spark, tmp_path):
    """Rows without a partner drop out, repeated ones multiply, as in any inner join."""
    def put(name, rows, schema):
        spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / f"{name}.parquet"))

    day = "timestamp_ntz"
    put("customer", [(1, 3, "A"), (1, 3, "A"), (None, 3, "B")], "c_custkey long, c_nationkey int, c_mktsegment string")
    put("part", [(7, "b", "t", "n"), (None, "b", "t", "x")], "p_partkey long, p_brand string, p_type string, p_name string")
    import datetime as dt
    d = dt.datetime(2000, 1, 2)
    put("orders", [(5, 1, d, "5-LOW"), (5, 1, d, "5-LOW"), (None, 1, d, "5-LOW"), (6, 2, d, "5-LOW")],
        f"o_orderkey long, o_custkey long, o_orderdate {day}, o_orderpriority string")
    put("lineitem", [(5, 7, 1, 10.0, d), (5, None, 2, 10.0, d), (None, 7, 1, 10.0, d), (6, 7, 1, 10.0, d)],
        f"l_orderkey long, l_partkey long, l_linenumber int, l_extendedprice double, l_shipdate {day}")
    got = fx.purchases_raw(spark, str(tmp_path)).select("request_id", "line_no", "amount", "family").collect()
    assert [tuple(r) for r in got] == [("5", "1", 2.0, "n")] * 4


def test_values_of_few_groups_are_not_dealt(spark):
    """Medians by column and by group join their brackets by broadcast."""
    df = spark.range(1000).select(F.col("id").cast("double").alias("a"), (F.col("id") % 7).cast("double").alias("b"))
    text = plan(FE.column_medians(df, ["a", "b"], TEST))
    assert "SortMergeJoin" not in text and "BroadcastHashJoin" in text
    got = FE.column_medians(df, ["a", "b"], TEST).first()
    assert (got["med_a"], got["med_b"]) == (499.5, 3.0)


@pytest.mark.parametrize("few", [False, True])
def test_hot_groups_meet_in_parts(spark, shuffled_joins, few):
    """Both ways of joining give every group's quantiles, null keys among them."""
    df = spark.range(5000).select(F.when(F.col("id") % 5 == 0, None).when(F.col("id") % 5 < 4, "hot").otherwise("cold").alias("g"),
                                  F.col("id").cast("double").alias("v"))
    out = exact_percentiles(df, "v", [0.5], by=["g"], accuracy=100, few=few)
    assert ("_dp" in plan(out)) is not few
    assert {r["g"]: (r["n"], r["q0"]) for r in out.collect()} == {None: (1000, 2497.5), "hot": (3000, 2499.5), "cold": (1000, 2501.5)}


def test_training_rows_are_not_dealt_by_year(spark, shuffled_joins, monkeypatch):
    """Four years would be four tasks of the whole training table."""
    seen = []
    medians = FE.column_medians
    monkeypatch.setattr(FE, "column_medians", lambda df, *a: (seen.append(plan(df)), medians(df, *a))[1])
    rows = spark.createDataFrame([(f"r{i}", f"2000-{i % 12 + 1:02d}-05", 10.0 * (i + 1), "Cant. 3", *["ab"[i % 2]] * 6, 1) for i in range(60)],
                                 "request_line string, order_date string, amount double, detail string, category string, class string, "
                                 "family string, destination string, origin string, unit string, cost_center int")
    prepared = FE.prepare(rows.withColumn("order_date", F.col("order_date").cast("timestamp_ntz")))
    data, _ = ML.learn_features(prepared, prepared, TEST)
    assert data.count() == 60 and "BroadcastHashJoin" in seen[0] and "Exchange hashpartitioning(year" not in seen[0].split("BroadcastExchange")[0]


def test_boosting_rows_of_a_task_are_bounded(spark):
    """The parts of the training frame follow its rows, not its files."""
    df = spark.range(9000).select(F.col("id").cast("string").alias("request_line"), F.col("id").cast("double").alias("amount"),
                                  F.lit(None).cast("string").alias("family")).coalesce(1)
    parts = ML.dealt(df, rows_a_task=500).rdd.glom().map(len).collect()
    assert len(parts) >= 18 and max(parts) < 1000 and sum(parts) == 9000
    assert ML.dealt(df).rdd.getNumPartitions() == 1


def test_rows_are_not_dealt_by_columns_of_few_values(spark, shuffled_joins):
    """five destinations would be five tasks of the whole slice; null and unseen labels keep theirs."""
    rows = spark.createDataFrame([(f"r{i}", f"2000-{i % 12 + 1:02d}-05", 10.0 * (i + 1), "Cant. 3", *[[None, "a", "b"][i % 3]] * 6, 1) for i in range(60)],
                                 "request_line string, order_date string, amount double, detail string, category string, class string, "
                                 "family string, destination string, origin string, unit string, cost_center int")
    prepared = FE.prepare(rows.withColumn("order_date", F.col("order_date").cast("timestamp_ntz")))
    enriched = FE.enrich_with(prepared, materialize(FE.group_stats(prepared, TEST), "statistics"))
    encoded = FE.encode_categories(prepared.where("destination = 'a'"), prepared)
    for text in (plan(enriched), plan(encoded)):
        assert "SortMergeJoin" not in text and text.count("BroadcastHashJoin") >= 4
    means = {r["destination"]: r["dest_mean"] for r in enriched.select("destination", "dest_mean").distinct().collect()}
    assert means == {None: None, "a": 305.0, "b": 315.0} and enriched.count() == 60
    assert {(r["destination"], r["n"]) for r in encoded.groupBy("destination").agg(F.count("*").alias("n")).collect()} == {(0, 20), (1, 40)}
