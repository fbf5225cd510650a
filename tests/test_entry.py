"""Driver contract of __spark_entry__."""

import __spark_entry__ as E


def test_entry_monthly_table(spark):
    df = E.entry(spark)
    rows = df.collect()
    assert len(rows) == 12
    assert [r["month"] for r in sorted(rows, key=lambda r: r["month"])] == list(range(1, 13))
    assert set(df.columns) >= {"month", "month_name", "predicted", "actual"}


def test_oracle_keys_are_queries():
    qs, sqls = E.queries(), E.oracle_sql()
    assert set(sqls) <= set(qs)
    assert len(qs) >= 100
    # only the randomised or model-based items lack an exact oracle
    from spendlens.suite import spark_queries
    assert set(spark_queries()) - set(sqls) <= {"isolation_scores", "anomaly_report_forest", "train_amount_model",
                                   "score_amount_model", "model_metrics", "predicted_total",
                                   "model_store_roundtrip", "projection_headline_model", "report_document"}


def test_every_query_is_documented():
    from spendlens.suite import REGISTRY
    for key, q in REGISTRY.items():
        assert (q.build.__doc__ or "").strip(), key
