"""Session helpers shared by jobs, tests and the bench."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import SparkSession


def local_session(cores: str = "8", shuffle_partitions: int = 8, app: str = "wayfind") -> SparkSession:
    """A local session for tests and the bench; clusters bring their own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def checkpointed(df):
    """Cut lineage in the reliable checkpoint folder the cluster names.

    The folder is read from ``spark.checkpoint.dir``, see :func:`_root`.
    """
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(_root(df.sparkSession))
    return df.checkpoint()


def _root(spark: SparkSession) -> str:
    """The folder that all executors share.

    Only a session that runs in one process may leave it out; a cluster without
    it is an error, as executors would write to disks of their own.
    """
    context = spark.sparkContext
    root = context.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not re.fullmatch(r"local(\[[^\]]*\])?", context.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = tempfile.mkdtemp(prefix="wayfind-")
    return root


def shared_folder(spark: SparkSession) -> str:
    """A new folder for tables a job writes, next to the cluster's checkpoints."""
    return f"{_root(spark).rstrip('/')}/wayfind-{uuid.uuid4().hex}"
