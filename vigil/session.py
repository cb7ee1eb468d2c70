"""Session settings and the shared folder for tables that cut lineage."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "vigil", master: str | None = None, **settings: str) -> SparkSession:
    """Session with adaptive execution; settings given by the caller win."""
    options = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.ui.enabled": "false",
        # The JVM never compiles methods above 8,000 bytes; wide projections run
        # faster as split projections than as one interpreted method.
        "spark.sql.codegen.hugeMethodLimit": "8000",
        # Call sites of single columns cost more than building the plan itself.
        "spark.python.sql.dataFrameDebugging.enabled": "false",
        **settings,
    }
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in options.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """Folder every executor can reach, named by ``spark.checkpoint.dir``.

    Only where the cluster names none (a local test run) is one made up.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        known = spark.sparkContext._jsc.sc().getCheckpointDir()
        named = os.path.dirname(known.get()) if known.isDefined() else None
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        named = tempfile.mkdtemp(prefix="run-")
        spark.sparkContext.setCheckpointDir(named)
    return named


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark).rstrip('/')}/vigil-{uuid.uuid4().hex}/{name}"


def materialize(df: DataFrame, name: str, partition_by: list[str] | None = None) -> DataFrame:
    """Write a table once and read it back.

    Used where several operators read the same costly result.  The written
    files survive the loss of any executor and cut the lineage.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    writer = df.write.option("compression", "zstd")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
