"""Session settings."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import SparkSession


def build_session(app: str = "clickloom", **conf: str) -> SparkSession:
    """A session with adaptive execution, UTC and Arrow; ``conf`` adds to it or overrides it."""
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.sql.optimizer.windowGroupLimitThreshold": "10000",
        "spark.sql.sources.partitionOverwriteMode": "dynamic",
    } | conf
    return SparkSession.builder.appName(app).config(map=settings).getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder driver and executors share: ``spark.checkpoint.dir``; a temporary one only where that is unset and all run on one machine (tests)."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = sc.getConf().get("spark.checkpoint.dir")
        if not folder and not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="clickloom-"))
    return sc.getCheckpointDir()
