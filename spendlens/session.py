"""Session helpers: local sessions for tests/bench and the checkpoint folder.

On a cluster the session is given; the library only reads its settings.
"""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession


def local_session(cores: str | int = "*", shuffle_partitions: int = 8,
                  app: str = "spendlens") -> SparkSession:
    """A local session configured like the tests and the bench expect."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("SPENDLENS_DRIVER_MEMORY", "8g"))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the reliable checkpoint folder, setting one only when unset.

    The cluster names a shared folder in ``spark.checkpoint.dir``; we read it
    from the session.  Only when nothing is configured (local tests) a fresh
    scratch folder is created.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    conf_dir = spark.conf.get("spark.checkpoint.dir", None)
    if not conf_dir:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        conf_dir = tempfile.mkdtemp(prefix="spendlens-ckpt-")
        spark.conf.set("spark.checkpoint.dir", conf_dir)
    sc.setCheckpointDir(conf_dir)
    return sc.getCheckpointDir() or conf_dir


def materialize(df, name: str):
    """Write ``df`` once as a Parquet table in the shared checkpoint folder and
    return it read back.

    Cuts the lineage like a reliable checkpoint (a lost executor re-reads
    files instead of recomputing), computes the plan only once (an eager
    ``checkpoint()`` runs it twice: count, then write), and later readers get
    column pruning and filter pushdown on the written files.
    """
    import uuid

    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/materialized/{name}-{uuid.uuid4().hex[:12]}"
    df.write.mode("overwrite").parquet(path)
    out = spark.read.parquet(path)
    out.materialized_at = path
    return out


def delete_path(spark: SparkSession, path: str) -> bool:
    """Delete a folder through Spark's own file system; true if it was there."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def forget(*frames) -> None:
    """Delete the tables that ``materialize`` wrote for these frames (others are left
    alone); whatever else reads them fails from then on."""
    for df in frames:
        if path := getattr(df, "materialized_at", None):
            delete_path(df.sparkSession, path)
