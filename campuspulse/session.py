"""Session settings and reliable materialisation."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "campuspulse", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings every job here assumes: UTC and adaptive execution.

    Shuffle width is left to the cluster unless given: adaptive execution
    coalesces small shuffles, so a generous default costs little.
    """
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        # Streams merge the sessions of a very active account inside each task before its events are shuffled.
        .config("spark.sql.streaming.sessionWindow.merge.sessions.in.local.partition", "true")
        .config("spark.ui.enabled", "false")
        # Recording a Python call site per column doubles the cost of building wide plans.
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
    )
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """Folder for checkpoints and intermediate tables, as named by the cluster.

    ``spark.checkpoint.dir`` wins. Only a local master may fall back to a
    machine-local temporary folder; on a cluster that would lose data with the
    machine, so it is refused.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder all executors share")
    path = tempfile.mkdtemp(prefix="campuspulse-")
    spark.conf.set("spark.checkpoint.dir", path)
    return path


def run_dir(spark: SparkSession, label: str) -> str:
    """A fresh sub-folder of the shared folder for one job run."""
    return f"{shared_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"


def materialise(df: DataFrame) -> DataFrame:
    """Checkpoint a frame that several later actions or branches read.

    The copy lives in the shared folder, so it survives lost executors, and the
    expensive part of the plan (scan, hourly pre-aggregation) runs once.
    """
    spark = df.sparkSession
    context = spark.sparkContext
    folder = shared_dir(spark)
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(folder)
    return df.checkpoint(eager=True)
