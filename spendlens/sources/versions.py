"""Sets of tables that become visible at once.

The tables of a version are written under ``<root>/versions/<id>``; the version
is current from the moment when its row is in ``<root>/commits``, which is written
last, as one file.  A reader sees the old version or the new one, never a part; a
writer that dies leaves a folder that nobody reads.  One writer at a time.
"""

from __future__ import annotations

import json
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import delete_path

COMMIT = "seq long, version string, info string"


class NoVersion(LookupError):
    """Nothing has been committed under this folder."""


def begin(root: str) -> tuple[str, str]:
    """The id and the folder of a new version."""
    version = uuid.uuid4().hex[:16]
    return version, f"{root.rstrip('/')}/versions/{version}"


def commits(spark: SparkSession, root: str) -> DataFrame:
    try:
        return spark.read.schema(COMMIT).parquet(f"{root.rstrip('/')}/commits")
    except AnalysisException:                       # the folder does not exist yet
        return spark.createDataFrame([], COMMIT)


def commit(spark: SparkSession, root: str, version: str, info: dict | None = None) -> None:
    """Make a written version the current one."""
    last = commits(spark, root).agg(F.max("seq")).first()[0]
    row = [((last or 0) + 1, version, json.dumps(info or {}, sort_keys=True))]
    spark.createDataFrame(row, COMMIT).coalesce(1).write.mode("append").parquet(f"{root.rstrip('/')}/commits")


def current(spark: SparkSession, root: str) -> tuple[str, dict]:
    """Folder and info of the current version."""
    row = commits(spark, root).orderBy(F.col("seq").desc()).first()
    if row is None:
        raise NoVersion(root)
    return f"{root.rstrip('/')}/versions/{row['version']}", json.loads(row["info"])


def table(spark: SparkSession, root: str, name: str, fmt: str = "parquet") -> DataFrame:
    """A table of the current version; the frame stays with that version."""
    return spark.read.format(fmt).load(f"{current(spark, root)[0]}/{name}")


def prune(spark: SparkSession, root: str, keep: int = 2) -> int:
    """Delete the folders of all but the last ``keep`` committed versions."""
    old = [r["version"] for r in commits(spark, root).orderBy(F.col("seq").desc()).collect()][keep:]
    return sum(delete_path(spark, f"{root.rstrip('/')}/versions/{v}") for v in old)
