"""The amount model is trained over rows of a few bytes, with the result of Spark's own training (round 4, F1 to F7)."""

import numpy as np
import pytest
from pyspark.ml import PipelineModel
from pyspark.sql import functions as F

from spendlens.operators import boosting as B
from spendlens.operators import features as FE
from spendlens.operators import model as ML
from spendlens.params import TEST


def training_rows(spark, n):
    """Features that tie (class follows category), vary little, and do not vary at all."""
    some = {c: F.pmod(F.xxhash64("id", F.lit(i)), F.lit(3 + 13 * i)).cast("double") for i, c in enumerate(ML.feature_columns())}
    some |= {"class": some["category"] * 2 - 1, "prev_month_spend": F.lit(7.0)}
    return spark.range(n).select(*[v.alias(c) for c, v in some.items()], (some["origin"] * 10 + some["class"] * some["unit"] + F.col("id") % 7 + 1).alias("amount"))


@pytest.mark.parametrize("n, block", [(300, 50), (12_500, 1_000)])      # splits from all rows, and from Spark's sample of some 10,000
def test_same_model_as_sparks(spark, monkeypatch, n, block):
    rows = training_rows(spark, n)
    pipeline = ML.amount_model(max_iter=3, max_depth=4)
    assembler, trees = pipeline.getStages()
    own = pipeline.fit(rows)
    monkeypatch.setattr(B, "BLOCK", block)
    monkeypatch.setattr(B.Task, "__init__", lambda self, cuts, init=B.Task.__init__: init(self, cuts, B.BLOCK))
    got = B.fit(trees, rows, assembler.getInputCols())
    new = PipelineModel([assembler, got])
    assert got.getNumTrees == 3 and got.treeWeights == [1.0, 0.1, 0.1] and got.uid == trees.uid
    a, b = (sorted(r[0] for r in m.transform(rows).select("prediction").collect()) for m in (own, new))
    assert b == pytest.approx(a, rel=1e-9)
    assert got.featureImportances.toArray() == pytest.approx(own.stages[-1].featureImportances.toArray(), rel=1e-6, abs=1e-9)
    assert got.getOrDefault("maxBins") == 64 and got.getOrDefault("maxIter") == 3


def test_a_block_is_a_few_bytes_a_row(spark):
    import pyarrow as pa
    rows = training_rows(spark, 5_000).toPandas()
    cuts = [B.thresholds(rows[c].to_numpy(), float(len(rows)), 63) for c in ML.feature_columns()]
    batches = pa.Table.from_pandas(rows, preserve_index=False).to_batches(1_000)
    blocks = list(B.Task(cuts, block=2_000).encode(batches))
    assert [len(b.column(1)[0].as_py()) // 8 for b in blocks] == [2_000, 2_000, 1_000]
    assert sum(b.nbytes for b in blocks) / len(rows) < 8 + len(cuts) + 1
    with pytest.raises(ValueError, match="infinite"):
        list(B.Task(cuts).encode([pa.RecordBatch.from_pandas(rows.assign(amount=np.inf), preserve_index=False)]))


def test_no_feature_varies(spark):
    rows = training_rows(spark, 40).select(*[F.lit(2.0).alias(c) for c in ML.feature_columns()], "amount")
    assembler, trees = ML.amount_model(max_iter=2, max_depth=2).getStages()
    model = PipelineModel([assembler, B.fit(trees, rows, assembler.getInputCols())])
    own = ML.amount_model(max_iter=2, max_depth=2).fit(rows)
    assert model.transform(rows).first()["prediction"] == pytest.approx(own.transform(rows).first()["prediction"])


def test_training_reads_what_features_need(spark, monkeypatch):
    """No estimator keeps wide rows, and the written training tables have no text that no feature uses."""
    from pyspark.ml.regression import GBTRegressor
    seen = {}
    put = ML.materialize
    monkeypatch.setattr(ML, "materialize", lambda df, name: (seen.update({name: df.columns}), put(df, name))[1])
    monkeypatch.setattr(GBTRegressor, "fit", lambda *a, **k: pytest.fail("Spark's own training holds 440 bytes a row"))
    rows = spark.createDataFrame([(f"r{i}", f"{1999 + i % 3}-{i % 12 + 1:02d}-05", 10.0 * (i + 1), "Cant. 3", *["ab"[i % 2]] * 6, 1) for i in range(60)],
                                 "request_line string, order_date string, amount double, detail string, category string, class string, "
                                 "family string, destination string, origin string, unit string, cost_center int")
    prepared = FE.prepare(rows.withColumn("order_date", F.col("order_date").cast("timestamp_ntz")))
    trained = ML.train(prepared, TEST, max_iter=2, max_depth=2)
    assert trained.holdout_year == 2001 and ML.score(trained, trained.test).count() == 20
    assert "detail" not in seen["training-enriched"] and "order_date" not in seen["training-enriched"]


@pytest.mark.parametrize("few", [100, 3])
def test_medians_of_few_values_come_from_their_counts(spark, monkeypatch, few):
    """Nulls and NaN are left out; a set of more values than ``few`` goes the other way."""
    i = F.col("id")
    df = spark.range(999).select((i % 7).cast("int").alias("a"), F.when(i % 5 > 0, (i % 4) / 2).alias("b"), F.lit(None).cast("double").alias("c"),
                                 F.when(i % 3 == 0, float("nan")).otherwise((i % 2).cast("double")).alias("d"), F.sqrt(i).alias("e"))
    plain = FE.column_medians(df, list("abcde"), TEST).first()
    monkeypatch.setattr(FE, "FEW_GROUPS", few)
    asked = []
    exact = FE.exact_percentiles
    monkeypatch.setattr(FE, "exact_percentiles", lambda x, *a, **k: (asked.extend(r[0] for r in x.select("_col").distinct().collect()), exact(x, *a, **k))[1])
    got = FE.column_medians(df, list("abcde"), TEST, (("a", "b"), ("c",), ("d", "not there")))
    assert got.first() == plain and got.columns == [f"med_{c}" for c in "abcde"]
    assert sorted(asked) == (["e"] if few == 100 else ["a", "b", "e"])
