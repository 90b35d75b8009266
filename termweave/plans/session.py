"""The folder in which jobs cut their lineage."""

from __future__ import annotations

import tempfile

from pyspark.sql import SparkSession


def checkpoints(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names, set for the session's checkpoints. Where it is unset, a session in one
    process gets a temporary folder; on a cluster that raises, as executors share no folder of their own."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        found = spark.conf.get("spark.checkpoint.dir", None)
        if not found:
            if not context.master.startswith("local") or context.master.startswith("local-cluster"):
                raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
            found = tempfile.mkdtemp(prefix="spark-")
        context.setCheckpointDir(found)
    return context.getCheckpointDir().rstrip("/")
