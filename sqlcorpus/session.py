"""Session settings and the shared scratch folder."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_DIR = "spark.checkpoint.dir"


def build_session(app_name: str = "sqlcorpus", master: str | None = None, **conf) -> SparkSession:
    """A session with the settings the package is tuned for; a running session is reused."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.showConsoleProgress": "false",
    }
    settings.update(conf)
    for key, value in settings.items():
        builder = builder.config(key, str(value))
    return builder.getOrCreate()


def scratch_root(spark: SparkSession) -> str:
    """The shared folder named by the cluster; a temporary one only where none is set in local mode.

    On a cluster a machine's own folder would lose the parts that other machines wrote, so there a
    missing setting is an error.
    """
    root = spark.conf.get(CHECKPOINT_DIR, None)
    if not root:
        root = spark.sparkContext.getCheckpointDir()
    if not root and not spark.sparkContext.master.startswith("local["):
        raise ValueError(f"set {CHECKPOINT_DIR} to a folder that the driver and all executors share")
    if not root:
        root = os.path.join(tempfile.gettempdir(), "sqlcorpus-scratch")
        spark.conf.set(CHECKPOINT_DIR, root)
    return root.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the scratch root; every call gives a new one."""
    return f"{scratch_root(spark)}/sqlcorpus/{name}-{uuid.uuid4().hex}"


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back.

    Used where several jobs read one expensive result: lineage ends at durable files, so a lost
    executor costs a re-read and not a recomputation.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
