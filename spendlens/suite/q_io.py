"""ML-3/4/5, AGG-33, SRC-7/8 and the streaming refresh."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import aggregates as A
from ..operators import features as FE
from ..operators import forecast as FC
from ..operators import model as ML
from ..plans import documents as D
from ..plans import monitoring as M
from ..plans import projection as PR
from ..sources import purchases as P
from ..sources import sinks as SK
from ..streaming import refresh as RF
from . import q_anomalies as QA
from . import q_monitoring as QM
from . import q_projection as QP
from . import q_quality as QQ
from . import q_recommend as QR
from .core import ALL_DIMS, BUDGET, NEXT_YEAR, PARAMS, PROJ_BUDGET, YEAR, base, r, register, scratch, staged_path

_MODELS: dict = {}


def _prep(spark, sf):
    return FE.prepare(P.forecast_history_window(base(spark, sf), NEXT_YEAR, PARAMS))


def _trained(spark, sf):
    key = (spark.sparkContext.applicationId, sf)
    if key not in _MODELS:
        _MODELS[key] = ML.train(_prep(spark, sf), PARAMS)
    return _MODELS[key]


def _encoded_slice(spark, sf):
    return ML.features(_trained(spark, sf), _prep(spark, sf), NEXT_YEAR)


@register("train_amount_model")
def train_amount_model(spark, sf):
    """ML-3: boosted trees fitted on 1997-2000, 2001 held out; feature importances."""
    return ML.importances(_trained(spark, sf))


@register("model_metrics")
def model_metrics(spark, sf):
    """ML-5: R2, RMSE, MAE on the holdout year."""
    return ML.metrics(_trained(spark, sf))


@register("model_metrics_fixed", """
SELECT 'r2' AS metric, 1 - sum((y - p) * (y - p)) / sum((y - m) * (y - m)) AS value FROM e
UNION ALL SELECT 'rmse', sqrt(avg((y - p) * (y - p))) FROM e
UNION ALL SELECT 'mae', avg(abs(y - p)) FROM e
UNION ALL SELECT 'holdout_rows', CAST(count(*) AS DOUBLE) FROM e""", ctes="""
h AS (SELECT category, avg(amount) AS p FROM purchases WHERE amount > 0 AND year(order_date) = 2000 GROUP BY category),
e AS (SELECT a.amount AS y, h.p, avg(a.amount) OVER () AS m FROM purchases a JOIN h ON a.category = h.category
      WHERE a.amount > 0 AND year(a.order_date) = 2001)""", rounding=r("value", 4))
def model_metrics_fixed(spark, sf):
    """ML-5 over fixed predictions: the category means of 2000 for the rows of 2001."""
    rows = base(spark, sf).where("amount > 0")
    means = rows.where(F.year("order_date") == 2000).groupBy("category").agg(F.avg("amount").alias("prediction"))
    return ML.regression_metrics(rows.where(F.year("order_date") == 2001).join(means, "category").select("amount", "prediction"))


@register("score_amount_model")
def score_amount_model(spark, sf):
    """ML-4: predicted amount of every row of the 2002 feature slice."""
    return ML.score(_trained(spark, sf), _encoded_slice(spark, sf)).select("request_line", "prediction")


@register("predicted_total")
def predicted_total(spark, sf):
    """AGG-33: sum of the row predictions for 2002."""
    return ML.predicted_total(ML.score(_trained(spark, sf), _encoded_slice(spark, sf)))


@register("model_store_roundtrip")
def model_store_roundtrip(spark, sf):
    """SRC-8: store the pipeline with its labels, statistics, medians and series, load
    it, encode and score again with what was stored."""
    root = scratch(spark, f"models/amount-{uuid.uuid4().hex[:8]}")
    ML.save(_trained(spark, sf), root)
    loaded = ML.load(spark, root)
    a = ML.predicted_total(ML.score(_trained(spark, sf), _encoded_slice(spark, sf))).withColumnRenamed("projected_total", "before")
    again = ML.score(loaded, ML.features(loaded, _prep(spark, sf), NEXT_YEAR))
    return a.withColumn("after", A.scalar(ML.predicted_total(again), "projected_total"))


@register("stored_labels", """
SELECT col, label, CAST(row_number() OVER (PARTITION BY col ORDER BY label) - 1 AS INTEGER) AS index,
       CAST(count(*) OVER (PARTITION BY col) AS INTEGER) AS n
FROM (SELECT DISTINCT col, label FROM (UNPIVOT (SELECT category, class, family, destination, origin, unit FROM purchases
        WHERE amount > 0 AND order_date >= TIMESTAMP '1997-01-01' AND order_date < TIMESTAMP '2001-01-01')
      ON category, class, family, destination, origin, unit INTO NAME col VALUE label))""")
def stored_labels(spark, sf):
    """SRC-8, ML-1: the label numbers of a stored model, read back."""
    root = scratch(spark, f"models/labels-{uuid.uuid4().hex[:8]}")
    ML.save(_trained(spark, sf), root)
    return ML.load(spark, root).learnt.labels


@register("series_coefficients", "SELECT nm AS months, b0 AS intercept, b1 AS slope, sd AS noise FROM st, fit, noise",
          ctes=QP.SEAS, rounding=r("intercept, slope, noise"))
def series_coefficients(spark, sf):
    """SRC-8, ML-7: the stored seasonal model: months, trend and noise."""
    return FC.fit_series(_prep(spark, sf)).select("months", "intercept", "slope", "noise")


@register("projection_headline_model")
def projection_headline_model(spark, sf):
    """REP-2 with the trained model as the total (method="model")."""
    rep = PR.projection_report(P.forecast_history_window(base(spark, sf), NEXT_YEAR, PARAMS), NEXT_YEAR,
                               PARAMS, PROJ_BUDGET, ALL_DIMS, method="model", model=_trained(spark, sf))
    return rep.headline


def _monitoring(spark, sf):
    return M.monitoring_report(P.forecast_history_window(base(spark, sf), YEAR, PARAMS), YEAR, PARAMS, BUDGET, ALL_DIMS)


@register("report_sink_roundtrip", "SELECT * FROM monthly", ctes=QM.MONTHLY, rounding=QM.MONTH_R)
def report_sink_roundtrip(spark, sf):
    """SRC-7: the monitoring report and its document published as one version, read back."""
    rep = _monitoring(spark, sf)
    root = scratch(spark, f"reports/monitoring-{uuid.uuid4().hex[:8]}")
    SK.publish(spark, rep, root, document=D.document(rep))
    return SK.read_published(spark, root, "monthly")


def _parsed(document, schema):
    """Fields of a report document, parsed back."""
    return document.select(F.from_json("document", schema).alias("d"))


@register("document_monitoring", """
SELECT 'monitoreo' AS modo, 2001 AS anio, head.actual AS real, budget AS presupuesto, m.month AS mes, m.month_name AS mes_nombre,
       m.predicted AS predicho, m.actual AS gasto_real
FROM head, monthly m""", ctes=QM.HEAD + "," + QM.MONTHLY[len(QM.PREP) + 1:],
          rounding=r("real, presupuesto, gasto_real") | r("predicho", 6))
def document_monitoring(spark, sf):
    """SRC-7: headline and months of the monitoring document."""
    d = _parsed(D.document(_monitoring(spark, sf)), "modo string, anio int, gasto_real_acumulado double, presupuesto_asignado double, "
                "gastos_mensuales array<struct<mes:int,mes_nombre:string,gasto_predicho:double,gasto_real:double>>")
    return d.select("d.modo", "d.anio", F.col("d.gasto_real_acumulado").alias("real"), F.col("d.presupuesto_asignado").alias("presupuesto"),
                    F.explode("d.gastos_mensuales").alias("m")).select(
        "modo", "anio", "real", "presupuesto", "m.mes", "m.mes_nombre", F.col("m.gasto_predicho").alias("predicho"), "m.gasto_real")


@register("document_breakdowns", "SELECT dimension, value AS valor, total, orders AS pedidos, rank FROM (" + QM.BREAKDOWN_SELECT + ")",
          ctes=QM.BREAKDOWN_CTES, rounding=r("total"))
def document_breakdowns(spark, sf):
    """SRC-7: the map of breakdown lists of the monitoring document, in order."""
    d = _parsed(D.document(_monitoring(spark, sf)),
                "desgloses map<string,array<struct<dimension:string,valor:string,gasto_total:double,cantidad_pedidos:bigint>>>")
    rows = d.select(F.explode("d.desgloses").alias("name", "list")).select("name", F.posexplode("list").alias("i", "x"))
    return rows.select(F.col("name").alias("dimension"), "x.valor", F.col("x.gasto_total").alias("total"),
                       F.col("x.cantidad_pedidos").alias("pedidos"), (F.col("i") + 1).alias("rank"))


@register("document_projection", "SELECT CAST(month AS INTEGER) AS mes, predicted AS predicho, lower AS inferior FROM fc", ctes=QP.SEAS,
          rounding=r("predicho, inferior"))
def document_projection(spark, sf):
    """SRC-7: the months of the projection document."""
    rep = PR.projection_report(P.forecast_history_window(base(spark, sf), NEXT_YEAR, PARAMS), NEXT_YEAR, PARAMS, PROJ_BUDGET, ALL_DIMS)
    d = _parsed(D.document(rep), "proyeccion_mensual array<struct<mes:int,gasto_predicho:double,intervalo_inferior:double>>")
    return d.select(F.explode("d.proyeccion_mensual").alias("m")).select(
        "m.mes", F.col("m.gasto_predicho").alias("predicho"), F.col("m.intervalo_inferior").alias("inferior"))


@register("document_quality", """
SELECT n.column_label AS columna, n.nulls AS nulos, n.null_pct AS porcentaje, prof_.state AS estado, prof_.rows AS total,
       (SELECT count(*) FROM probs) AS problemas
FROM (""" + QQ._NULL_ROWS + """) n, prof_""", ctes=QQ.PROBS, rounding=r("porcentaje", 6))
def document_quality(spark, sf):
    """SRC-7: null counts and percentages (maps), state and problems of the quality document."""
    d = _parsed(D.document(QQ._report(spark, sf)), "total_registros bigint, estado_general string, valores_nulos map<string,bigint>, "
                "porcentaje_nulos map<string,double>, problemas array<struct<columna:string,ejemplos:array<map<string,string>>>>")
    rows = d.select("d.*", F.explode("d.valores_nulos").alias("columna", "nulos"))
    return rows.select("columna", "nulos", F.try_element_at("porcentaje_nulos", F.col("columna")).alias("porcentaje"),
                       F.col("estado_general").alias("estado"), F.col("total_registros").alias("total"),
                       F.size("problemas").cast("bigint").alias("problemas"))


@register("document_anomalies", QA.DOC_SQL, ctes=QA.ANOM, rounding=r("importe"))
def document_anomalies(spark, sf):
    """SRC-7: the top list with its context, and the counts, of the anomaly document."""
    rep = QA.AN.anomaly_report(QA._year(spark, sf), PARAMS, "quantile")
    d = _parsed(D.document(rep), "total_anomalias bigint, anomalias_por_origen map<string,bigint>, "
                "anomalias_top array<struct<fecha_pedido:string,totalpesos:double,contexto:struct<solicitud:string,un:string>>>")
    return d.select(F.col("d.total_anomalias").alias("anomalias"), F.map_keys("d.anomalias_por_origen")[0].alias("primer_origen"),
                    F.explode("d.anomalias_top").alias("x")).select(
        "anomalias", "primer_origen", F.col("x.totalpesos").alias("importe"), F.col("x.fecha_pedido").alias("fecha"))


@register("document_recommendations", """
SELECT recs.rec_no AS numero, recs.title AS titulo, recs.actions AS acciones, op2.origin AS origen, op2.total, op2.orders AS pedidos,
       (SELECT count(*) FROM opps) AS oportunidades
FROM recs, op2""", ctes=QR.REC, rounding=r("total"))
def document_recommendations(spark, sf):
    """SRC-7: the list of recommendations beside the map of origin profiles."""
    d = _parsed(D.document(QR._rep(spark, sf)), "recomendaciones array<struct<titulo:string,acciones_sugeridas:array<string>>>, "
                "analisis_origen map<string,struct<gasto_total:double,total_pedidos:bigint,top_categorias:map<string,double>>>, "
                "oportunidades_ahorro array<struct<tipo:string>>")
    rows = d.select("d.*", F.posexplode("d.recomendaciones").alias("i", "x")).select(
        "i", "x", "oportunidades_ahorro", F.explode("analisis_origen").alias("origen", "o"))
    return rows.select((F.col("i") + 1).alias("numero"), F.col("x.titulo").alias("titulo"),
                       F.array_join("x.acciones_sugeridas", " | ").alias("acciones"), "origen", F.col("o.gasto_total").alias("total"),
                       F.col("o.total_pedidos").alias("pedidos"), F.size("oportunidades_ahorro").cast("bigint").alias("oportunidades"))


@register("streaming_monthly_spend", """
SELECT CAST(year(order_date) AS INTEGER) AS year, CAST(month(order_date) AS INTEGER) AS month,
       sum(amount) AS spend, count(*) AS orders
FROM purchases WHERE amount > 0 AND order_date IS NOT NULL GROUP BY 1, 2""", rounding=r("spend"))
def streaming_monthly_spend(spark, sf):
    """Structured Streaming refresh: the staged purchase files as a stream,
    monthly spend kept as state, complete table rewritten per micro-batch."""
    src = staged_path(spark, sf)
    schema = base(spark, sf).drop("order_year").schema
    run = uuid.uuid4().hex[:8]
    table = scratch(spark, f"stream/monthly-{run}")
    q = RF.start_refresh(spark, src, schema, table, scratch(spark, f"stream/ckpt-{run}"),
                         trigger={"availableNow": True})
    q.awaitTermination()
    return RF.current_months(spark, table)
