"""Helpers shared by the operators of this package."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

_own: list[str] = []


def work_dir(spark: SparkSession, name: str) -> str:
    """A new folder under the shared folder that the cluster names in ``spark.checkpoint.dir``.

    Only a local session without that setting gets a folder of its own, which goes when the process ends.
    """
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        if not _own:
            _own.append(tempfile.mkdtemp(prefix="eventlens-llm-"))
            atexit.register(shutil.rmtree, _own[0], ignore_errors=True)
        shared = _own[0]
    return f"{shared.rstrip('/')}/eventlens-llm/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table in the shared folder: later reads do not compute it again, and lost executors lose nothing."""
    path = work_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def numbered(df: DataFrame, name: str, number: str = "node") -> DataFrame:
    """``df`` written with a number of its own on each row. What is written stays; no two rows share a number."""
    return written(df.withColumn(number, F.monotonically_increasing_id()), name)


def fields(df: DataFrame) -> StructType:
    """A schema of one's own to add to: the one of a DataFrame is shared by all who ask for it."""
    return StructType(list(df.schema.fields))


def partitions(df: DataFrame) -> int:
    """Number of tasks in which ``df`` is read: it follows the bytes of the input."""
    return max(1, df.rdd.getNumPartitions())


def runs(batches: Iterator[pa.RecordBatch], key: list[str]) -> Iterator[pa.Table]:
    """Rows of equal ``key``, one table for each, from a partition that is sorted by it.

    Only the rows of the present key and one batch are held.
    """
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(k) for k in key]
        changed = np.zeros(batch.num_rows, bool)
        for c in columns:
            a, b = c.slice(0, len(c) - 1), c.slice(1)
            differs = pa.compute.not_equal(a, b).fill_null(True).to_numpy(zero_copy_only=False)
            both_null = (pa.compute.and_(a.is_null(), b.is_null())).to_numpy(zero_copy_only=False)
            changed[1:] |= differs & ~both_null
        if held:
            last = held[-1]
            changed[0] = any(last.column(k)[last.num_rows - 1] != c[0] for k, c in zip(key, columns, strict=True))
        start = 0
        for at in np.flatnonzero(changed):
            if at > start:
                held.append(batch.slice(start, at - start))
            if held:
                yield pa.Table.from_batches(held)
            held, start = [], int(at)
        held.append(batch.slice(start))
    if held:
        yield pa.Table.from_batches(held)
