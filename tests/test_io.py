"""Sinks, the streaming refresh and the model pipeline."""

import datetime
import json
import uuid

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spendlens.operators import features as FE
from spendlens.operators import forecast as FC
from spendlens.operators import model as ML
from spendlens.plans import anomalies as AN
from spendlens.plans import documents as D
from spendlens.plans import monitoring as M
from spendlens.plans import projection as PR
from spendlens.plans import quality as Q
from spendlens.plans import recommend as RC
from spendlens.schema import SchemaError
from spendlens.session import forget, materialize
from spendlens.sources import purchases as P
from spendlens.sources import readers as RD
from spendlens.sources import sinks as SK
from spendlens.sources import versions as V
from spendlens.streaming import refresh as RF
from spendlens.suite.core import PARAMS, YEAR, base, scratch, staged_path

from .conftest import SF_SMALL


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def _monitoring(spark):
    return M.monitoring_report(P.forecast_history_window(base(spark, SF_SMALL), YEAR, PARAMS), YEAR, PARAMS, 4e8, ["ORIGEN"])


def test_report_tables_as_files(spark):
    rep = _monitoring(spark)
    path = scratch(spark, f"test-reports/{uuid.uuid4().hex[:8]}")
    written = SK.write_report(rep, path, fmt="json")
    assert set(written) == {"headline", "monthly", "breakdown", "alerts"}
    assert SK.read_report_table(spark, path, "monthly", "json").count() == 12


def test_published_versions_appear_whole(spark):
    rep = _monitoring(spark)
    root = scratch(spark, f"test-publish/{uuid.uuid4().hex[:8]}")
    with pytest.raises(V.NoVersion):
        SK.read_published(spark, root, "monthly")
    assert set(SK.publish(spark, rep, root, document=D.document(rep))) == {"headline", "monthly", "breakdown", "alerts", "document"}
    first = V.current(spark, root)
    assert rows(SK.read_published(spark, root, "monthly")) == rows(rep.monthly)
    # a writer that dies before its commit leaves the old version current
    version, path = V.begin(root)
    rep.headline.write.parquet(f"{path}/headline")
    assert V.current(spark, root) == first
    for _ in range(2):
        SK.publish(spark, rep, root, keep=2)
    assert V.current(spark, root)[1]["report"] == "MonitoringReport" and V.commits(spark, root).count() == 3
    with pytest.raises(Exception, match="PATH_NOT_FOUND|does not exist"):
        spark.read.parquet(f"{first[0]}/monthly")                    # pruned


def test_monitoring_document(spark):
    doc = json.loads(D.document(_monitoring(spark)).first()[0])
    assert doc["modo"] == "monitoreo" and [m["mes"] for m in doc["gastos_mensuales"]] == list(range(1, 13))
    assert set(doc["desgloses"]) == {"ORIGEN"} and doc["gastos_mensuales"][11]["gasto_real"] is None
    totals = [x["gasto_total"] for x in doc["desgloses"]["ORIGEN"]]
    assert totals == sorted(totals, reverse=True) and doc["fecha_generacion"] == "2001-08-01"


def test_other_documents(spark):
    b = base(spark, SF_SMALL)
    q = json.loads(D.document(Q.quality_report(P.purchases_year(b, YEAR), PARAMS)).first()[0])
    assert len(q["valores_nulos"]) == 13 and q["problemas"] and all("ejemplos" in x for x in q["problemas"])
    a = json.loads(D.document(AN.anomaly_report(P.purchases_year(b, YEAR), PARAMS)).first()[0])
    amounts = [x["totalpesos"] for x in a["anomalias_top"]]
    assert amounts == sorted(amounts, reverse=True) and set(a["anomalias_top"][0]["contexto"]) == {"solicitud", "posicion", "empresa", "un"}
    r = json.loads(D.document(RC.recommendation_report(P.recommendation_window(b, YEAR, PARAMS), PARAMS)).first()[0])
    assert isinstance(r["recomendaciones"][0]["acciones_sugeridas"], list) and r["resumen_ejecutivo"].startswith("RESUMEN")
    assert all(len(x["top_categorias"]) <= 3 for x in r["analisis_origen"].values())
    few = json.loads(D.document(RC.recommendation_report(P.recommendation_window(b, YEAR, PARAMS), PARAMS, include_trends=False), most=1).first()[0])
    assert few["tendencias"] == [] and len(few["analisis_origen"]) == 1


def test_streaming_refresh_equals_batch(spark):
    src = staged_path(spark, SF_SMALL)
    run = uuid.uuid4().hex[:8]
    table = scratch(spark, f"test-stream/{run}")
    q = RF.start_refresh(spark, src, base(spark, SF_SMALL).schema, table, scratch(spark, f"test-stream/ck-{run}"),
                         trigger={"availableNow": True})
    q.awaitTermination()
    got = RF.current_months(spark, table).select("year", "month", F.round("spend", 2).alias("s"), "orders")
    want = RF.monthly_spend(base(spark, SF_SMALL)).select("year", "month", F.round("spend", 2).alias("s"), "orders")
    assert rows(got) == rows(want)


def test_model_train_score_store(spark):
    prepared = FE.prepare(P.forecast_history_window(base(spark, SF_SMALL), 2002, PARAMS))
    trained = ML.train(prepared, PARAMS, max_iter=5, max_depth=3)
    assert trained.holdout_year == 2001
    m = {r["metric"]: r["value"] for r in ML.metrics(trained).collect()}
    assert set(m) == {"r2", "rmse", "mae", "holdout_rows"} and m["rmse"] >= m["mae"] >= 0
    assert "cat_ratio" not in ML.feature_columns(True)
    # nothing of the held-out year is learnt: other amounts and labels there change no training row
    other = prepared.withColumn("amount", F.when(F.col("year") == 2001, F.col("amount") * 7).otherwise(F.col("amount"))) \
        .withColumn("category", F.when(F.col("year") == 2001, F.lit("0 new")).otherwise(F.col("category")))
    before = F.col("year") < 2001
    same = [ML.training_frame(x.where(before), x, PARAMS).where(before) for x in (prepared, other)]
    assert same[0].exceptAll(same[1]).isEmpty() and same[1].exceptAll(same[0]).isEmpty()
    one = ML.train(prepared.where("year = 2001"), PARAMS, max_iter=1, max_depth=2)
    assert one.holdout_year is None
    assert {r["metric"]: r["value"] for r in ML.metrics(one).collect()} == {"r2": None, "rmse": None, "mae": None, "holdout_rows": 0.0}
    # a loaded model encodes other data with what it learnt: label numbers, statistics, medians, series
    root = scratch(spark, f"test-models/{uuid.uuid4().hex[:8]}")
    ML.save(trained, root)
    fresh = spark.newSession()
    loaded = ML.load(fresh, root)
    assert rows(loaded.learnt.labels) == rows(trained.learnt.labels) and rows(loaded.learnt.series) == rows(trained.learnt.series)
    changed = other.withColumn("category", F.when(F.col("line_no") == "1", F.lit(" first of all")).otherwise(F.col("category")))
    number = {(r["col"], r["label"]): r["index"] for r in trained.learnt.labels.collect()}
    unseen = {r["col"]: r["n"] for r in trained.learnt.labels.select("col", "n").distinct().collect()}
    raw = FE.latest_year_slice(changed, 2002).select("request_line", "category", "amount").collect()
    want = sorted((r["request_line"], number.get(("category", r["category"]), unseen["category"])) for r in raw)
    enc = ML.features(loaded, changed, 2002)
    assert sorted((r["request_line"], r["category"]) for r in enc.select("request_line", "category").collect()) == want
    assert enc.select("prev_month_spend").distinct().collect() == trained.learnt.statistics.where("dim = '_all'").select("median").collect()
    a = sorted(r[0] for r in ML.score(trained, ML.features(trained, prepared, 2002)).select("prediction").collect())
    b = sorted(r[0] for r in ML.score(loaded, ML.features(loaded, prepared, 2002)).select("prediction").collect())
    assert a and a == pytest.approx(b, rel=1e-12)
    # a newer version takes over only when it is committed
    ML.save(one, root)
    assert ML.load(spark, root).holdout_year is None


def test_scaled_parts_add_up(spark):
    parts = spark.createDataFrame([("A", f"v{i}", float(i % 7) + 0.01) for i in range(50)] + [("B", "x", 1.0), ("B", "y", 1.0), ("B", "z", 1.0),
                                  ("C", "neg", -5.0), ("D", "big", 1e13), ("D", "small", 0.01)], "dimension string, value string, total double")
    total = spark.createDataFrame([(100.0,)], "projected_total double")
    got = PR.scale_to_total(parts, total).collect()
    sums = {}
    for r in got:
        sums[r["dimension"]] = sums.get(r["dimension"], 0) + round(r["scaled"] * 100)
    assert sums == {"A": 10_000, "B": 10_000, "D": 10_000}
    assert [r["scaled"] for r in sorted(got, key=lambda r: r["value"]) if r["dimension"] == "B"] == [33.34, 33.33, 33.33]


def test_season_needs_two_years(spark):
    months = [(datetime.datetime(2000 + m // 12, m % 12 + 1, 3), 100.0 + (50.0 if m % 12 == 0 else 0.0)) for m in range(30)]
    df = spark.createDataFrame(months, "order_date timestamp_ntz, amount double")
    long, short = FC.seasonal_forecast(df, 2003).collect(), FC.seasonal_forecast(df.where("order_date < '2001-06-01'"), 2002).collect()
    assert all(r["seasonal"] for r in long) and not any(r["seasonal"] for r in short)
    assert max(long, key=lambda r: r["predicted"])["month"] == 1
    filled = FC.fill_missing_months(FC.seasonal_forecast(df.where("order_date < '2001-06-01'"), 2001).withColumn("month", F.col("month")),
                                    df.withColumns({"year": F.year("order_date"), "month": F.month("order_date")}))
    assert {r["source"] for r in filled.collect()} == {"trend", "filled"}


def test_jdbc_options_and_ranges():
    start, end = datetime.date(2000, 11, 15), datetime.date(2001, 2, 10)
    assert RD.month_ranges(start, end) == [(start, datetime.date(2000, 12, 1)), (datetime.date(2000, 12, 1), datetime.date(2001, 1, 1)),
                                           (datetime.date(2001, 1, 1), datetime.date(2001, 2, 1)), (datetime.date(2001, 2, 1), end)]
    parts = RD.date_predicates("FECHAPEDIDO", start, end, months=2, nulls=True)
    assert parts == ["FECHAPEDIDO >= '2000-11-15' AND FECHAPEDIDO < '2001-01-01'",
                     "FECHAPEDIDO >= '2001-01-01' AND FECHAPEDIDO < '2001-02-10'", "FECHAPEDIDO IS NULL"]
    got = RD.year_window_options("jdbc:x", "dbo.compras", "FECHAPEDIDO", 2000, 2001, columns=["ORIGEN", "FECHAPEDIDO"])
    assert got["dbtable"] == ("(SELECT ORIGEN, FECHAPEDIDO FROM dbo.compras WHERE FECHAPEDIDO >= '2000-01-01' "
                              "AND FECHAPEDIDO < '2002-01-01') q")
    assert (got["lowerBound"], got["upperBound"], got["numPartitions"]) == ("2000-01-01", "2002-01-01", "24")
    assert RD.jdbc_options("u", "t", "d", start, start + datetime.timedelta(days=3), 50)["numPartitions"] == "3"
    for bad in (dict(table="t; drop"), dict(date_column="d--"), dict(columns=["a'b"]), dict(partitions=0), dict(end=start)):
        with pytest.raises(ValueError):
            RD.jdbc_options(**{**dict(url="u", table="t", date_column="d", start=start, end=end, partitions=4), **bad})


def test_tolerant_scan(spark):
    schema = T.StructType([T.StructField("d", T.TimestampNTZType()), T.StructField("x", T.DoubleType()), T.StructField("s", T.StringType())])
    raw = spark.createDataFrame([("2001-01-02 03:04:05", "1.5", "a", 2001), ("not a date", "x", "b", 2001), (None, None, None, 2002),
                                 ("2001-02-30", "NaN", "c", 2002)], "d string, x string, s string, order_year int")
    got = RD.scan(raw, schema, "t")
    assert [tuple(r) for r in got.rows.orderBy("s").collect()][1][:2] == (datetime.datetime(2001, 1, 2, 3, 4, 5), 1.5)
    assert got.rows.columns == ["d", "x", "s", "order_year"] and got.rows.where("d is null and x is null").count() == 3
    assert {r["column_name"]: (r["rows"], r["nulls"], r["bad"]) for r in got.counts.collect()} == {"d": (4, 1, 2), "x": (4, 1, 1), "s": (4, 1, 0)}
    assert sorted(tuple(r) for r in got.rejected.collect()) == [(["d"], "2001-02-30", "NaN", "c"), (["d", "x"], "not a date", "x", "b")]
    with pytest.raises(SchemaError, match="x"):
        RD.scan(raw.drop("x"), schema, "t")


def test_forget_deletes_what_was_written(spark):
    kept, gone = (materialize(spark.range(3), "forget-test") for _ in range(2))
    forget(gone, spark.range(2))
    assert kept.count() == 3
    with pytest.raises(Exception, match="PATH_NOT_FOUND|does not exist"):
        spark.read.parquet(gone.materialized_at)


def test_schema_contract_rejects_missing_columns(spark):
    from spendlens.schema import SchemaError
    raw = spark.createDataFrame([("x",)], "origin string")
    cat = spark.createDataFrame([(1, "u")], "cost_center_id int, unit string")
    with pytest.raises(SchemaError):
        P.base_purchases(raw, cat)


def test_catalogue_key_normalisation(spark):
    fact = spark.createDataFrame([(1, "acme ", 5.0)], "cost_center int, company string, amount double")
    cat = spark.createDataFrame([(1, "ACME", "north"), (1, "ACME", "north")],
                                "cost_center_id int, unit string, destination string")
    for c in ["level6", "level7", "level8", "nature"]:
        cat = cat.withColumn(c, F.lit(None).cast("string"))
    assert P.join_catalogue(fact, cat).where("destination is not null").count() == 0
    assert P.join_catalogue(fact, cat, normalise_keys=True).count() == 2          # duplicates fan out
    assert P.join_catalogue(fact, cat, dedupe_catalogue=True, normalise_keys=True).count() == 1
