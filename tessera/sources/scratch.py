"""Folders for intermediate tables that every executor can read.

On a cluster that is the folder in spark.checkpoint.dir; only where it is
unset, as in tests, a local folder serves.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

_local: dict[str, str] = {}


def shared_root(spark: SparkSession) -> str:
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _local:
        _local[app] = "file://" + tempfile.mkdtemp(prefix="tessera-")
    return _local[app]


def scratch_dir(spark: SparkSession, label: str) -> str:
    """A new path below the shared folder of this application; nothing is at it yet."""
    return f"{shared_root(spark)}/{spark.sparkContext.applicationId}/{label}-{uuid.uuid4().hex}"
