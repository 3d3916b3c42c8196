"""The shared work folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the folder that all executors share; a temporary one only where none is set (tests)."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="coursemill-")
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def checkpoint_dir(spark: SparkSession) -> None:
    """See that reliable checkpoints have a folder: the one that ``spark.checkpoint.dir`` names."""
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(shared_path(spark, "checkpoints"))


def short_batches(spark: SparkSession) -> None:
    """Send few and bounded rows to Python at once where they hold whole texts. Settings that the session was made with stay."""
    for name, value in (("spark.sql.execution.arrow.maxRecordsPerBatch", "1000"), ("spark.sql.execution.arrow.maxBytesPerBatch", str(16 << 20))):
        if not spark.sparkContext.getConf().contains(name):
            spark.conf.set(name, value)
