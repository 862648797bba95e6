"""Make the package importable on every executor."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import SparkSession

_shipped: set[str] = set()


def ship(spark: SparkSession) -> SparkSession:
    """Send the package's source to the executors, once for each application; functions that run there import it."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return spark
    here = os.path.dirname(os.path.abspath(__file__))
    path = os.path.join(tempfile.mkdtemp(prefix="axisframe-"), "axisframe_package.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as out:
        for folder, _, names in os.walk(here):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    out.write(full, os.path.relpath(full, os.path.dirname(here)))
    context.addPyFile(path)
    _shipped.add(context.applicationId)
    return spark


def scratch(spark: SparkSession, tag: str) -> str:
    """A new path in the folder that the driver and all executors share (spark.checkpoint.dir; a local one is set only where Spark is local)."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        found = held.get() if held.isDefined() else None
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="axisframe-")
        spark.sparkContext.setCheckpointDir(found)
    return f"{found.rstrip('/')}/axisframe/{spark.sparkContext.applicationId}/{tag}-{uuid.uuid4().hex}"
