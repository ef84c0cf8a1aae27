"""The folder that all executors share, for tables that a query writes on its way."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import SparkSession


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in ``spark.checkpoint.dir``; a folder of this machine's only where the session names none, as in tests."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not path:
        own = tempfile.mkdtemp(prefix="faultlens-")
        atexit.register(shutil.rmtree, own, ignore_errors=True)
        spark.sparkContext.setCheckpointDir(own)
        path = spark.sparkContext.getCheckpointDir()
    return f"{path.rstrip('/')}/faultlens/{name}-{uuid.uuid4().hex}"
