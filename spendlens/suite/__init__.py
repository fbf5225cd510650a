"""Registered queries: one Spark query per inventory item, each paired with an
independent DuckDB oracle where the result has an exact SQL definition.

Importing this package registers everything in ``REGISTRY``.
"""

from .core import REGISTRY, spark_queries, oracle_sqls  # noqa: F401
from . import q_sources, q_monitoring, q_quality, q_recommend, q_projection, q_anomalies, q_extracts, q_io, q_real_input  # noqa: F401
