"""ML-3/4/5 + AGG-33 + SRC-8: the amount model as a Spark ML pipeline.

The reference ships a pre-trained boosted-tree artefact and no training
code.  Here the model is trained on the history with Spark ML's distributed
``GBTRegressor`` (seeded), evaluated on a year-based holdout, stored with
a versioned folder beside its labels, statistics, medians and series, and applied with ``transform`` -- no driver-side
prediction loop.  The two ratio features contain the label (the row's own
amount), so they are left out by default (``drop_leaking=True``).
"""

from __future__ import annotations

import dataclasses

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import fixed
from ..params import Params
from ..session import materialize
from ..sources import versions as V
from . import aggregates as A
from . import boosting
from . import features as FE
from . import forecast as FC

LEAKING = ("cat_ratio", "dest_ratio")


def feature_columns(drop_leaking: bool = True) -> list[str]:
    return [c for c in fixed.FEATURES if not (drop_leaking and c in LEAKING)]


def training_frame(history: DataFrame, rows: DataFrame, p: Params) -> DataFrame:
    """``rows`` with the 26 features (encoded), label = amount; group statistics,
    medians and labels are learnt on ``history`` (a part of ``rows``) alone.

    Written to the shared checkpoint folder (twice: before imputation and
    after encoding): boosting reads it once per iteration, and the lineage
    (statistics, medians, encoders) is long.
    """
    return learn_features(history, rows, p)[0]


def learn_features(history: DataFrame, rows: DataFrame, p: Params) -> tuple[DataFrame, "Learnt"]:
    """The training frame, and what encodes other rows the same way."""
    stats = materialize(FE.group_stats(history, p), "training-statistics")
    used = {"request_line", "amount", *fixed.FEATURES, *FE.NUMERIC_FEATURES}
    f = materialize(FE.enrich_with(rows.select(*[c for c in rows.columns if c in used]), stats), "training-enriched")
    years = materialize(history.select("year").distinct(), "training-years")
    known = f.join(F.broadcast(years), "year", "left_semi")     # whole years, a handful: never dealt by year
    learnt = Learnt(labels=FE.label_indexes(history, fixed.ENCODED_COLUMNS), statistics=stats,
                    medians=materialize(FE.column_medians(known, FE.NUMERIC_FEATURES, p, FE.TOGETHER), "training-medians"),
                    series=FC.fit_series(history))
    return materialize(learnt.finish(f), "training-frame"), learnt


@dataclasses.dataclass
class Learnt:
    """All that the features of a model depend on besides the row: frames, so that they
    are stored and joined like any table."""

    labels: DataFrame           # (col, label, index, n)
    statistics: DataFrame       # (dim, value, mean, std, median)
    medians: DataFrame          # one row, a column for each numeric feature
    series: DataFrame           # the seasonal model, one row a series

    def finish(self, enriched: DataFrame) -> DataFrame:
        """Impute and encode."""
        f = FE.impute_with(enriched, FE.NUMERIC_FEATURES, self.medians).select("request_line", *fixed.FEATURES, "amount")
        return FE.encode_with(self.labels, f, fixed.ENCODED_COLUMNS)

    def features(self, rows: DataFrame) -> DataFrame:
        """The encoded feature frame of prepared rows."""
        return self.finish(FE.enrich_with(rows, self.statistics))

    def tables(self) -> dict[str, DataFrame]:
        return {f.name: getattr(self, f.name) for f in dataclasses.fields(self)}


#: Rows of one task of the boosting, which holds their codes and errors from pass to
#: pass (some 24 bytes a row).
ROWS_A_TASK = 5_000_000


def dealt(data: DataFrame, rows_a_task: int = ROWS_A_TASK) -> DataFrame:
    """A written frame in parts of about ``rows_a_task`` rows, however its files lie; a
    frame that is read in as many parts stays as it is."""
    tasks = -(-data.count() // rows_a_task)
    if tasks <= data.rdd.getNumPartitions():
        return data
    return data.repartition(max(tasks, data.sparkSession.sparkContext.defaultParallelism), "request_line", "amount", "family")


def amount_model(drop_leaking: bool = True, max_iter: int = 20, max_depth: int = 5, seed: int = 42) -> Pipeline:
    cols = feature_columns(drop_leaking)
    return Pipeline(stages=[
        VectorAssembler(inputCols=cols, outputCol="features", handleInvalid="keep"),
        GBTRegressor(featuresCol="features", labelCol="amount", predictionCol="prediction",
                     maxIter=max_iter, maxDepth=max_depth, seed=seed, maxBins=64),
    ])


@dataclasses.dataclass
class TrainedModel:
    model: PipelineModel
    test: DataFrame            # the held-out year; empty where there is none
    holdout_year: int | None
    drop_leaking: bool
    learnt: Learnt             # labels, statistics, medians and series of the years it learnt from


def train(prepared: DataFrame, p: Params, drop_leaking: bool = True, max_iter: int = 20,
          max_depth: int = 5) -> TrainedModel:
    """ML-3: fit on years before the last observed year, hold that year out.

    Nothing is learnt from the held-out year.  A single year of history is all
    learnt from and leaves no holdout (``metrics`` are then null)."""
    rows = prepared.where(F.col("year").isNotNull())
    first, last = rows.agg(F.min("year"), F.max("year")).first()
    history = rows.where(F.col("year") < last) if last != first else rows
    data, learnt = learn_features(history, rows, p)
    held = (F.col("year") == last) if last != first else F.lit(False)
    assembler, trees = amount_model(drop_leaking, max_iter, max_depth, p.seed).getStages()
    model = PipelineModel([assembler, boosting.fit(trees, dealt(data).where(~held), assembler.getInputCols())])
    return TrainedModel(model=model, test=data.where(held), holdout_year=last if last != first else None,
                        drop_leaking=drop_leaking, learnt=learnt)


def features(model: TrainedModel, prepared: DataFrame, target_year: int) -> DataFrame:
    """The encoded features of the latest year's rows, re-dated to the target, by the
    statistics, medians and label numbers that the model learnt."""
    return materialize(model.learnt.features(FE.latest_year_slice(prepared, target_year)), "model-features")


def score(model: PipelineModel | TrainedModel, encoded_features: DataFrame) -> DataFrame:
    """ML-4: predictions for an encoded feature frame (distributed transform)."""
    m = model.model if isinstance(model, TrainedModel) else model
    return m.transform(encoded_features).drop("features")


def predicted_total(scored: DataFrame) -> DataFrame:
    """AGG-33: sum of the row predictions (one row)."""
    return scored.agg(F.sum("prediction").alias("projected_total"))


def regression_metrics(pred: DataFrame, label: str = "amount", prediction: str = "prediction") -> DataFrame:
    """ML-5: R2, RMSE, MAE and the number of rows, as a table (null without rows), in
    two aggregates: the mean of the label, then the errors."""
    y, e, mean = F.col(label), F.col(label) - F.col(prediction), F.col("_mean")
    one = pred.withColumn("_mean", A.scalar(pred.agg(F.avg(label).alias("m")), "m")).agg(F.count(F.lit(1)).cast("double").alias("n"), F.sum(e * e).alias("se"), F.sum(F.abs(e)).alias("ae"),
                   F.sum((y - mean) * (y - mean)).alias("st"))
    items = [("r2", 1.0 - F.try_divide(F.col("se"), F.col("st"))), ("rmse", F.sqrt(F.try_divide(F.col("se"), F.col("n")))),
             ("mae", F.try_divide(F.col("ae"), F.col("n"))), ("holdout_rows", F.col("n"))]
    return one.select(F.inline(F.array(*[F.struct(F.lit(k).alias("metric"), v.alias("value")) for k, v in items])))


def metrics(trained: TrainedModel) -> DataFrame:
    """ML-5: R2, RMSE and MAE on the holdout year (null without one)."""
    return regression_metrics(score(trained, trained.test))


def importances(trained: TrainedModel) -> DataFrame:
    """Feature importances of the fitted trees (feature, importance)."""
    gbt = trained.model.stages[-1]
    cols = feature_columns(trained.drop_leaking)
    spark = trained.learnt.labels.sparkSession
    vals = gbt.featureImportances.toArray().tolist()
    return spark.createDataFrame(list(zip(cols, [float(v) for v in vals])), "feature string, importance double")


def save(model: TrainedModel, root: str) -> str:
    """SRC-8: store the pipeline and everything its features depend on as a new version
    under ``root`` (a shared folder); it is current once all of it is written."""
    spark = model.learnt.labels.sparkSession
    version, path = V.begin(root)
    model.model.write().overwrite().save(f"{path}/pipeline")
    for name, df in model.learnt.tables().items():
        df.write.parquet(f"{path}/{name}")
    V.commit(spark, root, version, {"holdout_year": model.holdout_year, "drop_leaking": model.drop_leaking,
                                    "features": feature_columns(model.drop_leaking)})
    return path


def load(spark: SparkSession, root: str) -> TrainedModel:
    """SRC-8: the current version, ready to encode and score other data; nothing is
    learnt again.  It has no holdout rows."""
    path, info = V.current(spark, root)
    learnt = Learnt(**{f.name: spark.read.parquet(f"{path}/{f.name}") for f in dataclasses.fields(Learnt)})
    return TrainedModel(model=PipelineModel.load(f"{path}/pipeline"), test=None, holdout_year=info["holdout_year"],
                        drop_leaking=info["drop_leaking"], learnt=learnt)
