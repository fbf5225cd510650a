"""Each rule fires and stays silent by threshold (parameters, not data)."""

import datetime

import pytest
from pyspark.sql import functions as F

from spendlens.params import Params
from spendlens.plans import anomalies as AN
from spendlens.plans import monitoring as M
from spendlens.plans import projection as PR
from spendlens.plans import quality as Q
from spendlens.plans import recommend as RC

P = Params()


def _head(spark, pct, actual=100.0, predicted=100.0, budget=None, proj=0.0):
    return spark.createDataFrame([(pct, actual, predicted, budget, proj)],
                                 "deviation_pct double, actual double, predicted double, budget double, "
                                 "year_end_projection double")


@pytest.mark.parametrize("pct,expected", [(10.0, []), (10.1, ["alto"]), (20.0, ["alto"]),
                                          (20.1, ["critico"]), (-25.0, ["critico"])])
def test_monitoring_deviation_alert(spark, pct, expected):
    rows = M.alerts(_head(spark, pct), P).collect()
    assert [r["severity"] for r in rows] == expected
    if pct == -25.0:
        assert "bajo" in rows[0]["title"] and "25.0%" in rows[0]["description"]


def test_monitoring_budget_alerts(spark):
    rows = M.alerts(_head(spark, 0.0, actual=91.0, budget=100.0, proj=120.0), P).collect()
    assert [(r["alert_no"], r["severity"]) for r in rows] == [(2, "critico"), (3, "alto")]
    assert M.alerts(_head(spark, 0.0, actual=90.0, budget=100.0, proj=100.0), P).count() == 0


@pytest.mark.parametrize("pct,expected", [(5.0, []), (15.0, ["alto"]), (15.1, ["critico"])])
def test_projection_alert(spark, pct, expected):
    h = spark.createDataFrame([(100.0 * (1 + pct / 100), 100.0, pct)],
                              "projected_total double, budget double, difference_pct double")
    assert [r["severity"] for r in PR.alerts(h, P).collect()] == expected


def test_quality_advice_clean_and_poor(spark):
    import datetime as dt
    clean = spark.createDataFrame(
        [("o", "c", "u", dt.datetime(2001, 1, 1), 1, "d", 10.0, "x", "1", "1", "cat", "cl", "f",
          dt.datetime(2001, 1, 1))] * 5,
        "origin string, company string, unit string, order_date timestamp_ntz, cost_center int, "
        "destination string, amount double, detail string, request_id string, line_no string, "
        "category string, class string, family string, request_date timestamp_ntz")
    rep = Q.quality_report(clean, P)
    assert [r["advice"] for r in rep.advice.collect()] == [" Calidad de datos aceptable para análisis"]
    assert rep.profile.first()["state"] == "excelente"
    poor = clean.withColumn("destination", F.lit(None).cast("string")).withColumn("amount", F.lit(-1.0)) \
        .withColumn("category", F.lit("Desconocido"))
    adv = [r["advice"] for r in Q.quality_report(poor, P).advice.collect()]
    assert adv[0].strip().startswith("CRÍTICO")
    assert any(a.startswith("Revisar proceso de captura para DESTINO (100.0% nulos)") for a in adv)


@pytest.mark.parametrize("n,top,share,expected", [
    (P.anomaly_many, 10.0, 0.0, []),
    (P.anomaly_many + 1, 10.0, 0.0, ["alto"]),
    (2, 10.0 * P.anomaly_ratio + 1, 0.0, ["critico"]),
    (4, 10.0, P.origin_share + 0.25, ["medio"]),
    (4, 10.0, P.origin_share, []),
])
def test_anomaly_alerts(spark, n, top, share, expected):
    mine = int(n * share)
    flagged = spark.createDataFrame([(True, "a" if i < mine else f"o{i}") for i in range(n)],
                                    "is_anomaly boolean, origin string")
    st = spark.createDataFrame([(n, 10.0, top)], "anomalies long, mean_normal double, max_anomalous double")
    if share == 0.0:
        flagged = flagged.withColumn("origin", F.lit(None).cast("string"))
    assert [r["severity"] for r in AN.alerts(flagged, st, P).collect()] == expected


@pytest.mark.parametrize("small,mean,expected", [
    (P.small_orders_min, 100.0, []),
    (P.small_orders_min + 1, 100.0, ["small"]),
    (0, 100.0 * P.saving_mean_factor, []),
    (0, 100.0 * P.saving_mean_factor + 1, ["origin"]),
])
def test_opportunities(spark, small, mean, expected):
    df = spark.range(small).select(F.lit(1.0).alias("amount"))
    stats = spark.createDataFrame([(100.0, 2.0)], "global_mean double, q25 double")
    origins = spark.createDataFrame([("x", mean, 5000.0)], "origin string, mean double, total double")
    got = RC.opportunities(df, P, stats, origins).collect()
    assert [{"x": "origin"}.get(r["value"], "small") for r in got] == expected


def _purchases(spark, months, factor, value="a"):
    return spark.createDataFrame([(value, datetime.datetime(2000, 1 + m, 5), 100.0 * (factor if m >= months // 2 else 1))
                                  for m in range(months)], "origin string, order_date timestamp_ntz, amount double")


@pytest.mark.parametrize("months,factor,expected", [
    (2 * P.recent_months, 1.0 + P.trend_min_pct / 100 + 0.01, ["a"]),
    (2 * P.recent_months, 0.5, ["a"]),
    (2 * P.recent_months, 1.0 + P.trend_min_pct / 200, []),
    (2 * P.recent_months - 1, 3.0, []),                        # too few months observed
])
def test_dimension_trends(spark, months, factor, expected):
    assert [r["value"] for r in RC.dimension_trends(_purchases(spark, months, factor), ["ORIGEN"], P).collect()] == expected


def test_trends_skip_values_without_prior_spend(spark):
    df = _purchases(spark, 2 * P.recent_months, 2.0).unionByName(
        _purchases(spark, 2 * P.recent_months, 1.0, "new").where(f"month(order_date) > {P.recent_months}"))
    assert [r["value"] for r in RC.dimension_trends(df, ["ORIGEN"], P).collect()] == ["a"]


# ---------------------------------------------------------------- RUL-6
def _recommended(spark, origins=(), units=(), categories=(), gmean=100.0):
    """Rule numbers and titles for the given profiles: origins (name, total, mean, orders,
    class), units (name, total, mean, orders), categories (name, total)."""
    o = spark.createDataFrame(list(origins), "origin string, total double, mean double, orders long, spend_class string")
    u = spark.createDataFrame(list(units), "unit string, total double, mean double, orders long")
    stats = spark.createDataFrame([(gmean, 1.0, 2.0)], "global_mean double, q25 double, q75 double")
    rows = [(x[0], None, None, x[1], int(x[3])) for x in origins] + [(None, None, c, t, 1) for c, t in categories]
    cells = spark.createDataFrame([(a, b, c, t, None, n, n, t) for a, b, c, t, n in rows],
                                  "origin string, unit string, category string, amount double, money decimal(38,10), "
                                  "priced long, orders long, largest double")
    return [(r["rule_no"], r["title"]) for r in RC.recommendations(cells, P, stats, o, u).orderBy("rec_no").collect()]


def test_rule_1_high_origin(spark):
    got = _recommended(spark, origins=[("a", 10.0, 5.0, 4, "alto"), ("b", 20.0, 5.0, 4, "normal"), ("c", 1.0, 5.0, 4, "bajo")])
    assert [t for n, t in got if n == 1] == ["Optimizar gastos en a"]
    assert not [t for n, t in _recommended(spark, origins=[("a", 10.0, 5.0, 4, "normal")]) if n == 1]


def test_rule_2_many_orders(spark):
    got = _recommended(spark, origins=[(x, 1.0, 1.0, n, "normal") for x, n in (("a", 1), ("b", 2), ("c", 3), ("d", 10))])
    assert [t for n, t in got if n == 2] == ["Consolidar pedidos en d"]               # p75 of 1, 2, 3, 10 is 4.75
    same = _recommended(spark, origins=[(x, 1.0, 1.0, 5, "normal") for x in "abcd"])
    assert not [t for n, t in same if n == 2]


@pytest.mark.parametrize("mean,fires", [(100.0 * P.unit_mean_factor, False), (100.0 * P.unit_mean_factor + 0.01, True)])
def test_rule_3_expensive_units(spark, mean, fires):
    got = _recommended(spark, units=[("u", 10.0, mean, P.few_orders)])
    assert [t for n, t in got if n == 3] == (["Revisar procesos de aprobación en u"] if fires else [])


def test_rule_3_looks_at_three_units(spark):
    got = _recommended(spark, units=[(f"u{i}", 1.0, 1000.0 - i, P.few_orders) for i in range(5)])
    assert [t[-2:] for n, t in got if n == 3] == ["u0", "u1", "u2"]


def test_rule_4_three_categories(spark):
    got = _recommended(spark, categories=[("x", 5.0), ("y", 9.0), ("z", 1.0), ("w", 7.0)])
    assert [t for n, t in got if n == 4] == [f"Estrategia de compra para {c}" for c in "ywx"]
    assert not _recommended(spark)


@pytest.mark.parametrize("orders,fires", [(P.few_orders, False), (P.few_orders - 1, True)])
def test_rule_5_few_orders(spark, orders, fires):
    got = _recommended(spark, units=[("u", 10.0, 1.0, orders)])
    assert [t for n, t in got if n == 5] == (["Consolidar compras de u con otras unidades"] if fires else [])


def test_first_ten_in_rule_order(spark):
    got = _recommended(spark, origins=[(f"o{i:02}", float(i), 5.0, 4, "alto") for i in range(12)], categories=[("x", 1.0)])
    assert [n for n, _ in got] == [1] * P.max_recommendations and got[0][1].endswith("o11")
