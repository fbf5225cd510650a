"""REP-4 and its parts: AGG-20..24, SCA-13/14, RUL-4/5, TOP-10, PRJ-2."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import fixed
from ..plans import quality as Q
from ..sources import purchases as P
from .core import PARAMS, base, r, register

_NULLS = ",\n  ".join(f"CAST(count_if({c} IS NULL) AS BIGINT) AS null_{c}" for c in fixed.REQUIRED_COLUMNS)
_NSUM = " + ".join(f"null_{c}" for c in fixed.REQUIRED_COLUMNS)

PROF = f"""
two AS (SELECT *, year(order_date) AS y FROM purchases
        WHERE order_date >= TIMESTAMP '2000-01-01' AND order_date < TIMESTAMP '2002-01-01'),
q AS (SELECT * EXCLUDE (y) FROM two WHERE y = (SELECT max(y) FROM two)),
prof0 AS (SELECT count(*) AS rows,
  {_NULLS},
  CAST(count_if(amount < 0) AS BIGINT) AS negatives,
  CAST(count_if(order_date IS NULL) AS BIGINT) + CAST(count_if(request_date IS NULL) AS BIGINT) AS invalid_dates,
  CAST(count_if(amount <= 0 OR category = 'Desconocido' OR destination = 'Desconocido') AS BIGINT) AS invalid_rows,
  CAST(count_if(category = 'Desconocido') AS BIGINT) AS unknown
  FROM q),
prof1 AS (SELECT *, {_NSUM} AS nulls FROM prof0),
prof2 AS (SELECT *, CASE WHEN rows = 0 THEN 0.0 ELSE greatest(0.0, least(100.0,
            100.0 - least(nulls / rows * 100.0, 30.0) - least(negatives / rows * 100.0, 25.0)
            - least(invalid_dates / rows * 100.0, 20.0) - least(unknown / rows * 100.0, 15.0))) END AS score
          FROM prof1),
prof AS (SELECT *, CASE WHEN score >= 90 THEN 'excelente' WHEN score >= 75 THEN 'buena'
                        WHEN score >= 60 THEN 'aceptable' ELSE 'deficiente' END AS state
         FROM prof2),
prof_ AS (SELECT *, state IN ('deficiente', 'aceptable') AS needs_cleaning FROM prof)"""

_LABEL = dict(zip(fixed.REQUIRED_COLUMNS, fixed.REQUIRED_LABELS))
_NULL_ROWS = "\n  UNION ALL ".join(
    f"SELECT {i + 1} AS column_no, '{_LABEL[c]}' AS column_label, null_{c} AS nulls, "
    f"CASE WHEN rows > 0 THEN null_{c} / rows * 100.0 ELSE 0.0 END AS null_pct FROM prof_"
    for i, c in enumerate(fixed.REQUIRED_COLUMNS))

_crit = [c for c in fixed.REQUIRED_COLUMNS if _LABEL[c] in fixed.CRITICAL_NULL_LABELS]
_PROB_PARTS = []
for c in _crit:
    _PROB_PARTS.append(f"SELECT '{_LABEL[c]}' AS column_label, 'valores_nulos' AS kind, null_{c} AS count, "
                       f"null_{c} / rows * 100.0 AS pct FROM prof_ WHERE null_{c} > 0")
_PROB_PARTS += [
    "SELECT 'TOTALPESOS', 'valores_negativos_o_cero', negatives, negatives / rows * 100.0 FROM prof_ WHERE negatives > 0",
    "SELECT 'FECHAS', 'fechas_invalidas', invalid_dates, invalid_dates / rows * 100.0 FROM prof_ WHERE invalid_dates > 0",
    "SELECT 'CATEGORIA', 'valores_desconocidos', unknown, unknown / rows * 100.0 FROM prof_ WHERE unknown > 0",
]
PROBS = PROF + ",\nprobs AS (" + "\n  UNION ALL ".join(
    f"SELECT {i + 1} AS problem_no, * FROM ({s})" for i, s in enumerate(_PROB_PARTS)) + ")"

ADVICE = PROBS + """,
lines AS (
  SELECT 0 AS problem_no, ' CRÍTICO: Los datos requieren limpieza exhaustiva antes de análisis' AS advice
  FROM prof_ WHERE state = 'deficiente'
  UNION ALL
  SELECT problem_no, CASE
    WHEN kind = 'valores_nulos' AND pct > 10 THEN
      'Revisar proceso de captura para ' || column_label || ' (' || format('{:.1f}', pct) || '% nulos)'
    WHEN kind = 'valores_nulos' THEN 'Imputar o eliminar registros nulos en ' || column_label
    WHEN kind = 'valores_negativos_o_cero' THEN 'Filtrar registros con TOTALPESOS ≤ 0 (' || count || ' registros)'
    WHEN kind = 'valores_desconocidos' THEN 'Enriquecer clasificación de ' || column_label || ' (' || count || ' desconocidos)'
  END FROM probs WHERE kind <> 'fechas_invalidas'),
lines2 AS (
  SELECT * FROM lines
  UNION ALL
  SELECT 99, ' Calidad de datos aceptable para análisis' WHERE (SELECT count(*) FROM lines) = 0)"""

_EX_OTHERS = ("system company unit request_date cost_center level6 level7 level8 nature business_line detail "
              "requester preparer request_id line_no class family buying_entity").split()
_EX_ORDER = "order_date ASC NULLS FIRST, origin ASC NULLS FIRST, amount ASC NULLS FIRST, " \
            "request_line ASC NULLS FIRST, category ASC NULLS FIRST, destination ASC NULLS FIRST, " \
            + ", ".join(f"{c} ASC NULLS FIRST" for c in _EX_OTHERS)
EXAMPLES = PROF + """,
tagged AS (
  SELECT 'DESTINO' AS column_label, 'valores_nulos' AS kind, * FROM q WHERE destination IS NULL
  UNION ALL SELECT 'TOTALPESOS', 'valores_nulos', * FROM q WHERE amount IS NULL
  UNION ALL SELECT 'CATEGORIA', 'valores_nulos', * FROM q WHERE category IS NULL
  UNION ALL SELECT 'TOTALPESOS', 'valores_negativos_o_cero', * FROM q
            WHERE amount <= 0 AND (SELECT negatives FROM prof_) > 0),
ranked AS (SELECT *, row_number() OVER (PARTITION BY column_label, kind ORDER BY %s) AS rn FROM tagged)""" % _EX_ORDER


def _q(spark, sf):
    return P.latest_year_fallback(base(spark, sf), PARAMS.as_of.year)


def _report(spark, sf):
    return Q.quality_report(_q(spark, sf), PARAMS)


PROF_R = r("score", 6)


@register("quality_report", """
SELECT rows, nulls, invalid_rows, negatives, invalid_dates, unknown, score, state, needs_cleaning
FROM prof_""", ctes=PROF, rounding=PROF_R)
def quality_report(spark, sf):
    """REP-4 profile: totals, score, state, needs-cleaning."""
    return _report(spark, sf).profile.select(
        "rows", "nulls", "invalid_rows", "negatives", "invalid_dates", "unknown",
        "score", "state", "needs_cleaning")


@register("null_counts", "SELECT * FROM (" + _NULL_ROWS + ")", ctes=PROF, rounding=r("null_pct", 6))
def null_counts(spark, sf):
    """AGG-20: nulls and null % for each of the 13 required columns."""
    return _report(spark, sf).null_counts


@register("negative_count", "SELECT rows, negatives FROM prof_", ctes=PROF)
def negative_count(spark, sf):
    """AGG-21: amount < 0."""
    return _report(spark, sf).profile.select("rows", "negatives")


@register("invalid_date_count", "SELECT rows, invalid_dates FROM prof_", ctes=PROF)
def invalid_date_count(spark, sf):
    """AGG-22: null order dates + null request dates."""
    return _report(spark, sf).profile.select("rows", "invalid_dates")


@register("invalid_record_count", "SELECT rows, invalid_rows FROM prof_", ctes=PROF)
def invalid_record_count(spark, sf):
    """AGG-23: amount <= 0 or unknown category or unknown destination."""
    return _report(spark, sf).profile.select("rows", "invalid_rows")


@register("unknown_count", "SELECT rows, unknown FROM prof_", ctes=PROF)
def unknown_count(spark, sf):
    """AGG-24: category = unknown label."""
    return _report(spark, sf).profile.select("rows", "unknown")


@register("quality_score", "SELECT rows, nulls, negatives, invalid_dates, unknown, score FROM prof_",
          ctes=PROF, rounding=PROF_R)
def quality_score(spark, sf):
    """SCA-13: 100 minus four capped penalties."""
    return _report(spark, sf).profile.select("rows", "nulls", "negatives", "invalid_dates", "unknown", "score")


@register("quality_state", "SELECT score, state, needs_cleaning FROM prof_", ctes=PROF, rounding=PROF_R)
def quality_state(spark, sf):
    """SCA-14: state ladder and needs-cleaning flag."""
    return _report(spark, sf).profile.select("score", "state", "needs_cleaning")


@register("quality_problems", "SELECT * FROM probs", ctes=PROBS, rounding=r("pct", 6))
def quality_problems(spark, sf):
    """RUL-4: problems with count and %."""
    return _report(spark, sf).problems


@register("quality_recommendations",
          "SELECT CAST(row_number() OVER (ORDER BY problem_no) AS INTEGER) AS advice_no, advice FROM lines2",
          ctes=ADVICE)
def quality_recommendations(spark, sf):
    """RUL-5: advice lines."""
    return _report(spark, sf).advice


@register("quality_examples", """
SELECT column_label, kind, CAST(rn AS INTEGER) AS example_no, order_date,
       origin, amount, """ + ", ".join(
    f"CASE WHEN kind <> 'valores_negativos_o_cero' THEN {c}{'::VARCHAR' * (c == 'cost_center')} END AS {c}"
    for c in ["request_line", "category", "destination", *_EX_OTHERS]) + """
FROM ranked WHERE rn <= 10""", ctes=EXAMPLES, rounding=r("amount"))
def quality_examples(spark, sf):
    """TOP-10: first 10 example rows per problem, deterministic order (the cost
    centre as text: pandas reads integers with nulls as floats)."""
    return _report(spark, sf).examples.withColumn("cost_center", F.col("cost_center").cast("string"))


@register("quality_summary", """
SELECT rows AS total_rows, state, score, needs_cleaning, (SELECT count(*) FROM probs) AS problems
FROM prof_""", ctes=PROBS, rounding=PROF_R)
def quality_summary(spark, sf):
    """PRJ-2 (quality): quick summary of the report."""
    return _report(spark, sf).summary
