"""Session settings and the shared scratch folder."""

from __future__ import annotations

import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def build_session(app: str = "terraquilt", master: str | None = None, **extra: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**SETTINGS, **extra}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path under the cluster's shared checkpoint folder. Only a local session that
    names no such folder (tests) falls back to a temporary one; elsewhere executors wouldn't
    see each other's files, so that is an error."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        named = spark.sparkContext._jsc.sc().getCheckpointDir()
        base = named.get() if named.isDefined() else None
    if not base:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="terraquilt-")
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def materialized(df: DataFrame, name: str) -> DataFrame:
    """Write an intermediate result to the scratch folder and read it back, where
    several steps need it and computing it again would cost more. The files stay
    until the folder is cleaned."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def ship_package(spark: SparkSession) -> None:
    """Send this package's code to the Python workers, once per session, so that
    Arrow functions can be imported wherever they run."""
    if getattr(spark.sparkContext, "_terraquilt_shipped", False):
        return
    here = os.path.dirname(os.path.abspath(__file__))
    target = os.path.join(tempfile.mkdtemp(prefix="terraquilt-code-"), "terraquilt")
    archive = shutil.make_archive(target, "zip", os.path.dirname(here), os.path.basename(here))
    spark.sparkContext.addPyFile(archive)
    spark.sparkContext._terraquilt_shipped = True
