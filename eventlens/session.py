"""Session settings the jobs rely on."""

from __future__ import annotations

import atexit
import shutil
import tempfile

from pyspark.sql import SparkSession

SETTINGS = {
    # Event timestamps carry no zone; pinning the session keeps every cast neutral.
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Re-running one day of an ingest must replace that day only.
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # Recording a Python call site for every column costs more than planning the query.
    "spark.python.sql.dataFrameDebugging.enabled": "false",
}


def local_session(name: str = "eventlens", cpus: int | str = "*", **extra: str) -> SparkSession:
    """A session for tests and the benchmark. On a cluster, pass ``SETTINGS`` to spark-submit."""
    builder = SparkSession.builder.master(f"local[{cpus}]").appName(name)
    for key, value in {**SETTINGS, "spark.ui.enabled": "false", **extra}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


_own: list[str] = []


def scratch_dir(spark: SparkSession) -> str:
    """The folder for written intermediates, which driver and executors share: ``spark.checkpoint.dir`` names it.

    A session in one process may go without; it gets a folder that goes when the process ends.
    """
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        if not _own:
            _own.append(tempfile.mkdtemp(prefix="eventlens-"))
            atexit.register(shutil.rmtree, _own[0], ignore_errors=True)
        shared = _own[0]
    return f"{shared.rstrip('/')}/eventlens"
