"""Session defaults."""
from __future__ import annotations

import re
import tempfile

from pyspark.sql import SparkSession


def get_session(app: str = "laborcast", master: str | None = None, conf: dict[str, str] | None = None) -> SparkSession:
    """A session with adaptive execution, skew handling and a UTC clock.

    Cluster sizing (executors, shuffle partitions, checkpoint folder) is left to whoever submits the job;
    pass it in ``conf`` for local runs.
    """
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        **(conf or {}),
    }
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``, the folder that the driver and all executors share. Where it is unset, a local session makes a
    temporary one, as all of it runs on this machine; on a cluster it is an error."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None and not re.fullmatch(r"local(\[.*\])?", context.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors can reach")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="checkpoints-"))
    return context.getCheckpointDir()
