"""Fixed values that must equal the reference service's outputs.

Everything in this module is a value, not logic: labels, word lists,
message fragments and regular expressions that the reports emit or match
verbatim.  They are kept together, in the reference's natural order, so a
reader can check them against the original in one place.
"""

# --- fixed values: month names (Spanish, January first) -------------------
MONTH_NAMES = [
    "Enero", "Febrero", "Marzo", "Abril", "Mayo", "Junio",
    "Julio", "Agosto", "Septiembre", "Octubre", "Noviembre", "Diciembre",
]

# --- fixed values: analysis dimensions (label -> canonical column) --------
DIMENSIONS = {
    "ORIGEN": "origin",
    "UN": "unit",
    "CATEGORIA": "category",
    "CLASE": "class",
    "FAMILIA": "family",
    "DESTINO": "destination",
    "EMPRESA": "company",
}

# --- fixed values: required columns (reference order, canonical names) ----
REQUIRED_COLUMNS = [
    "origin", "company", "unit", "order_date", "cost_center",
    "destination", "amount", "detail", "request_id",
    "line_no", "category", "class", "family",
]
# reference labels of the required columns, same order
REQUIRED_LABELS = [
    "ORIGEN", "EMPRESA", "UN", "FECHAPEDIDO", "CENTROCOSTO",
    "DESTINO", "TOTALPESOS", "DETALLEFINAL", "SOLICITUD",
    "POSICION", "CATEGORIA", "CLASE", "FAMILIA",
]
# columns whose nulls are reported as problems (reference labels)
CRITICAL_NULL_LABELS = ["TOTALPESOS", "CATEGORIA", "DESTINO"]

# --- fixed values: sentinel for an unknown label ---------------------------
UNKNOWN_LABEL = "Desconocido"

# --- fixed values: enumerations ---------------------------------------------
MODE_MONITORING = "monitoreo"
MODE_PROJECTION = "proyeccion"

ALERT_ANOMALY = "anomalia"
ALERT_BUDGET = "desviacion_presupuesto"
ALERT_HIGH_SPEND = "gasto_elevado"
ALERT_PATTERN = "patron_inusual"

SEV_CRITICAL = "critico"
SEV_HIGH = "alto"
SEV_MEDIUM = "medio"

STATE_EXCELLENT = "excelente"
STATE_GOOD = "buena"
STATE_ACCEPTABLE = "aceptable"
STATE_POOR = "deficiente"

ORIGIN_CLASS_HIGH = "alto"
ORIGIN_CLASS_LOW = "bajo"
ORIGIN_CLASS_NORMAL = "normal"

TREND_UP = "creciente"
TREND_DOWN = "decreciente"

# --- fixed values: quantity patterns, in priority order, case-insensitive --
QUANTITY_PATTERNS = [
    r"Cant[.:]?\s*(\d+)",
    r"Cantidad[.:]?\s*(\d+)",
    r"PZA[.:]?\s*(\d+)",
    r"UN[.:]?\s*(\d+)",
]

# --- fixed values: the 26 model features (reference order) -----------------
# canonical column names
FEATURES = [
    "category", "class", "family", "destination", "origin", "unit",
    "cost_center", "year", "month", "quarter", "weekday",
    "iso_week", "is_month_end", "is_month_start", "is_quarter_end",
    "quantity", "cat_mean", "cat_median", "cat_std",
    "dest_mean", "dest_median", "origin_mean",
    "unit_mean", "cat_ratio", "dest_ratio",
    "prev_month_spend",
]
ENCODED_COLUMNS = ["category", "class", "family", "destination", "origin", "unit"]

# --- fixed values: monitoring alert texts ---------------------------------
TXT_DEV_TITLE = "Desviación {dir} lo predicho"          # dir: sobre / bajo
TXT_DEV_OVER = "sobre"
TXT_DEV_UNDER = "bajo"
TXT_DEV_DESC = "El gasto real está {pct}% {dir} la predicción. Real: ${real} vs Predicho: ${pred}"
TXT_BUDGET_TITLE = "Presupuesto cerca de agotarse"
TXT_BUDGET_DESC = "Se ha consumido el {pct}% del presupuesto asignado. Presupuesto: ${budget}"
TXT_PROJ_TITLE = "Proyección excede presupuesto"
TXT_PROJ_DESC = "La proyección de fin de año (${proj}) excede el presupuesto en ${excess}"
# projection-mode alert
TXT_PROJ2_DESC = "La proyección (${proj}) excede el presupuesto en {pct}% (${excess})"

# --- fixed values: anomaly alert texts ------------------------------------
TXT_ANOM_MANY_TITLE = "Alto volumen de anomalías detectadas"
TXT_ANOM_MANY_DESC = "Se detectaron {n} gastos anómalos. Revisar procesos de aprobación y validación."
TXT_ANOM_MAX_TITLE = "Gasto anómalo extremadamente elevado"
TXT_ANOM_MAX_DESC = "Gasto máximo anómalo: ${max} (50x superior al promedio normal de ${mean})"
TXT_ANOM_CONC_TITLE = "Concentración de anomalías en {origin}"
TXT_ANOM_CONC_DESC = "{n} de {total} anomalías provienen de {origin}. Revisar proceso de compra."

# --- fixed values: data-quality problem kinds and advice ------------------
PROBLEM_NULLS = "valores_nulos"
PROBLEM_NEGATIVE = "valores_negativos_o_cero"
PROBLEM_DATES = "fechas_invalidas"
PROBLEM_UNKNOWN = "valores_desconocidos"
DATES_LABEL = "FECHAS"
TXT_Q_CRITICAL = " CRÍTICO: Los datos requieren limpieza exhaustiva antes de análisis"
TXT_Q_REVIEW = "Revisar proceso de captura para {col} ({pct}% nulos)"
TXT_Q_IMPUTE = "Imputar o eliminar registros nulos en {col}"
TXT_Q_FILTER = "Filtrar registros con TOTALPESOS ≤ 0 ({n} registros)"
TXT_Q_ENRICH = "Enriquecer clasificación de {col} ({n} desconocidos)"
TXT_Q_OK = " Calidad de datos aceptable para análisis"

# --- fixed values: recommendation texts -----------------------------------
REC1_TITLE = "Optimizar gastos en {origin}"
REC1_DESC = ("El origen {origin} presenta un gasto promedio de ${mean}, superior al promedio global. "
             "Total acumulado: ${total}")
REC1_AREA = "Optimización de Costos"
REC1_IMPACT = "Ahorro potencial: ${saving} (10%)"
REC1_ACTIONS = [
    "Revisar contratos con proveedores y negociar descuentos por volumen",
    "Consolidar compras para obtener mejores precios",
    "Implementar proceso de validación adicional para compras >$50k",
    "Comparar precios con otros ORIGENes de menor costo",
]
REC2_TITLE = "Consolidar pedidos en {origin}"
REC2_DESC = ("{origin} tiene {n} pedidos, uno de los volúmenes más altos. La consolidación puede "
             "reducir costos operativos.")
REC2_AREA = "Eficiencia Operacional"
REC2_IMPACT = "Reducción de costos administrativos del 15-20%"
REC2_ACTIONS = [
    "Implementar compras programadas mensuales en lugar de diarias",
    "Establecer montos mínimos por pedido",
    "Crear calendario de compras consolidadas",
    "Automatizar pedidos recurrentes",
]
REC3_TITLE = "Revisar procesos de aprobación en {unit}"
REC3_DESC = "La unidad {unit} tiene un gasto promedio 50% superior al global (${mean}). Total: ${total}"
REC3_AREA = "Gobernanza"
REC3_IMPACT = "Reducción potencial: ${saving}"
REC3_ACTIONS = [
    "Revisar niveles de autorización para aprobaciones",
    "Implementar proceso de validación de necesidad",
    "Buscar alternativas más económicas",
    "Establecer presupuestos por categoría",
]
REC4_TITLE = "Estrategia de compra para {category}"
REC4_DESC = "{category} representa ${total} del gasto total. Optimizar esta categoría tiene alto impacto."
REC4_AREA = "Categorización Estratégica"
REC4_IMPACT = "Impacto potencial: ${saving} (8% ahorro)"
REC4_ACTIONS = [
    "Desarrollar estrategia específica para {category}",
    "Identificar proveedores preferentes",
    "Estandarizar especificaciones técnicas",
    "Implementar contratos marco",
]
REC5_TITLE = "Consolidar compras de {unit} con otras unidades"
REC5_DESC = "{unit} tiene solo {n} pedidos. Consolidar con otras UNs puede mejorar poder de negociación."
REC5_AREA = "Sinergia Organizacional"
REC5_IMPACT = "Descuentos por volumen del 5-10%"
REC5_ACTIONS = [
    "Identificar necesidades comunes con otras UNs",
    "Crear comité de compras inter-unidades",
    "Negociar contratos corporativos",
    "Compartir mejores prácticas",
]

# --- fixed values: savings opportunities ----------------------------------
OPP1_KIND = "Negociación de Proveedores"
OPP1_DIMENSION = "ORIGEN"
OPP1_DESC = "Renegociar precios con {origin}"
OPP1_COMPLEXITY = "Media"
OPP1_LEAD_TIME = "3-6 meses"
OPP2_KIND = "Consolidación de Compras"
OPP2_DIMENSION = "OPERACIONAL"
OPP2_VALUE = "Pedidos pequeños"
OPP2_DESC = "Consolidar {n} pedidos pequeños"
OPP2_COMPLEXITY = "Baja"
OPP2_LEAD_TIME = "1-3 meses"

# --- fixed values: executive summary lines --------------------------------
SUM_HEAD = "RESUMEN EJECUTIVO - ANÁLISIS DE COMPRAS"
SUM_NOW = "🔹 Situación Actual:"
SUM_TOTAL = "   • Gasto Total Analizado: ${total}"
SUM_ORDERS = "   • Total de Pedidos: {n}"
SUM_MEAN = "   • Gasto Promedio por Pedido: ${mean}"
SUM_OPPS = " Oportunidades Identificadas:"
SUM_RECS = "   • {n} recomendaciones estratégicas generadas"
SUM_NOPPS = "   • {n} oportunidades de ahorro cuantificadas"
SUM_SAVING = "   • Ahorro Potencial Estimado: ${saving} ({pct}% del gasto total)"
SUM_ACTIONS = " Acciones Prioritarias:"
SUM_NEXT = (" Próximos Pasos: Implementar las {n} acciones prioritarias identificadas para maximizar "
            "el impacto en los próximos 3-6 meses.")

# --- fixed values: dashboard severity colours ------------------------------
SEVERITY_COLORS = {
    "critico": "red",
    "alto": "orange",
    "medio": "yellow",
    "bajo": "blue",
    "info": "gray",
}

# --- fixed values: dashboard stat cards (titles and subtitles) -------------
CARD_ACTUAL = "Gasto Real"
CARD_PROJECTED = "Proyección Total"
CARD_ACTUAL_SUB = "Acumulado a la fecha"
CARD_PROJECTED_SUB = "Año {year}"
CARD_BUDGET = "Presupuesto Asignado"
CARD_REMAINING_SUB = "Restante: {value}"
CARD_DIFFERENCE_SUB = "Diferencia: {value}"
CARD_YEAR_END = "Proyección Fin Año"
CARD_CONFIDENCE = "Confianza"
CARD_YEAR_END_SUB = "Estimado"
CARD_HISTORY_SUB = "{n} meses históricos"
CARD_ALERTS = "Alertas"
CARD_NO_ALERTS = "Sin alertas"

# --- fixed values: dashboard alert colour bands ----------------------------
ALERT_BAND_CRITICAL = "red"
ALERT_BAND_HIGH = "orange"
ALERT_BAND_OTHER = "yellow"

# --- fixed values: short Spanish month names of the medium date format -----
MONTH_ABBR = ["ene", "feb", "mar", "abr", "may", "jun", "jul", "ago", "sept", "oct", "nov", "dic"]

# --- fixed values: field names of the nested report documents --------------
# (name in the document, column of the report table)
DOC_MONTH = [("mes", "month"), ("mes_nombre", "month_name"), ("gasto_predicho", "predicted"), ("gasto_real", "actual"),
             ("desviacion", "deviation"), ("desviacion_porcentual", "deviation_pct"),
             ("intervalo_inferior", "lower"), ("intervalo_superior", "upper")]
DOC_BREAKDOWN = [("dimension", "dimension"), ("valor", "value"), ("gasto_total", "total"), ("gasto_promedio", "mean"),
                 ("cantidad_pedidos", "orders"), ("porcentaje_total", "share_pct")]
DOC_ALERT = [("tipo", "type"), ("severidad", "severity"), ("titulo", "title"), ("descripcion", "description"),
             ("valor_observado", "observed"), ("valor_esperado", "expected"), ("dimension", "dimension")]
DOC_MONITORING = [("modo", "mode"), ("anio", "year"), ("gasto_real_acumulado", "actual"), ("gasto_predicho_total", "predicted"),
                  ("desviacion_total", "deviation"), ("desviacion_porcentual", "deviation_pct"),
                  ("presupuesto_asignado", "budget"), ("presupuesto_restante", "remaining"),
                  ("proyeccion_fin_anio", "year_end_projection")]
DOC_PROJECTION = [("modo", "mode"), ("anio", "year"), ("gasto_proyectado_total", "projected_total"),
                  ("intervalo_confianza_inferior", "lower"), ("intervalo_confianza_superior", "upper"),
                  ("presupuesto_asignado", "budget"), ("diferencia_presupuesto", "difference"),
                  ("diferencia_porcentual", "difference_pct"), ("nivel_confianza", "confidence"),
                  ("datos_historicos_meses", "history_months")]
DOC_QUALITY = [("total_registros", "rows"), ("estado_general", "state"), ("puntuacion_calidad", "score"),
               ("registros_invalidos", "invalid_rows"), ("totalpesos_negativos", "negatives"),
               ("fechas_invalidas", "invalid_dates"), ("requiere_limpieza", "needs_cleaning")]
DOC_PROBLEM = [("columna", "column_label"), ("tipo_problema", "kind"), ("cantidad", "count"), ("porcentaje", "pct")]
DOC_ANOMALIES = [("total_registros_analizados", "rows_analysed"), ("total_anomalias", "anomalies"),
                 ("porcentaje_anomalias", "anomaly_pct"), ("gasto_promedio_normal", "mean_normal"),
                 ("gasto_promedio_anomalo", "mean_anomalous"), ("gasto_maximo_anomalo", "max_anomalous")]
DOC_ANOMALY = [("origen", "origin"), ("categoria", "category"), ("destino", "destination"), ("totalpesos", "amount"),
               ("desviacion_estandar", "relative_excess"), ("score_anomalia", "score"), ("detalle", "detail")]
DOC_CONTEXT = [("solicitud", "ctx_request_id"), ("posicion", "ctx_line_no"), ("empresa", "ctx_company"), ("un", "ctx_unit")]
DOC_RECOMMENDATION = [("titulo", "title"), ("descripcion", "description"), ("prioridad", "priority"), ("categoria", "area"),
                      ("impacto_estimado", "impact"), ("acciones_sugeridas", "actions")]
DOC_PROFILE = [("gasto_total", "total"), ("gasto_promedio", "mean"), ("total_pedidos", "orders")]
DOC_TREND = [("dimension", "dimension"), ("valor", "value"), ("tendencia", "direction"), ("variacion_porcentual", "change_pct"),
             ("gasto_actual", "recent"), ("gasto_anterior", "prior")]
DOC_OPPORTUNITY = [("tipo", "kind"), ("dimension", "dimension"), ("valor", "value"), ("descripcion", "description"),
                   ("gasto_actual", "spend"), ("ahorro_estimado", "saving"), ("porcentaje_ahorro", "saving_pct"),
                   ("complejidad", "complexity"), ("plazo_implementacion", "lead_time")]
