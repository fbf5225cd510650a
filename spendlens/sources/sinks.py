"""SRC-7: writing reports.

A report is a set of long tables.  ``publish`` writes them, and on request the
nested document (``plans.documents``), as one version of a folder: readers see all
tables of one run of a report, never a mixture (``sources.versions``).
"""

from __future__ import annotations

from typing import Iterable

from pyspark.sql import DataFrame, SparkSession

from . import versions as V

REPORT_TABLES = ("headline", "monthly", "breakdown", "alerts", "profile", "null_counts", "castability", "problems",
                 "advice", "examples", "summary", "stats", "top", "by_dimension", "recommendations",
                 "origins", "units", "trends", "opportunities", "checks")


def report_tables(report, tables: Iterable[str] | None = None) -> dict[str, DataFrame]:
    """The tables that a report has, by name."""
    found = {name: getattr(report, name) for name in tables or REPORT_TABLES if hasattr(type(report), name)}
    return {name: df for name, df in found.items() if isinstance(df, DataFrame)}


def publish(spark: SparkSession, report, root: str, tables: Iterable[str] | None = None, document: DataFrame | None = None,
            keep: int = 2) -> list[str]:
    """Write the tables of a report (and its ``document``) under ``root`` as the new
    current version; returns their names.  Older versions beyond ``keep`` go."""
    version, path = V.begin(root)
    all_ = report_tables(report, tables) | ({} if document is None else {"document": document})
    for name, df in all_.items():
        df.write.parquet(f"{path}/{name}")
    V.commit(spark, root, version, {"tables": sorted(all_), "report": type(report).__name__})
    V.prune(spark, root, keep)
    return sorted(all_)


def read_published(spark: SparkSession, root: str, table: str) -> DataFrame:
    """A table of the current version."""
    return V.table(spark, root, table)


def write_report(report, path: str, tables: Iterable[str] | None = None, fmt: str = "parquet",
                 mode: str = "overwrite") -> list[str]:
    """Write every table of a report to ``path/<table>``, in any format of Spark's."""
    written = report_tables(report, tables)
    for name, df in written.items():
        df.write.mode(mode).format(fmt).save(f"{path.rstrip('/')}/{name}")
    return list(written)


def read_report_table(spark, path: str, table: str, fmt: str = "parquet") -> DataFrame:
    return spark.read.format(fmt).load(f"{path.rstrip('/')}/{table}")
