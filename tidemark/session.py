"""A session with the settings that the engine's semantics rely on."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession


def session(app: str = "tidemark", master: str | None = None, **conf: str) -> SparkSession:
    """UTC times, adaptive plans, Arrow for Python stages. Cluster settings are left to spark-submit."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {"spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true", "spark.sql.execution.arrow.pyspark.enabled": "true"} | conf
    return builder.config(map=settings).getOrCreate()


def scratch_folder(spark: SparkSession, kind: str) -> str:
    """A new folder name for a table that is written and read again: below the session's checkpoint folder, else its warehouse, both shared by all executors. It goes when the application ends."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.sql.warehouse.dir")
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{base.rstrip('/')}/scratch-{kind}-{uuid.uuid4().hex}")
    system = path.getFileSystem(spark._jsc.hadoopConfiguration())
    system.mkdirs(path)
    system.deleteOnExit(path)
    return f"{path.toString()}/table"
