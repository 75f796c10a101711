from __future__ import annotations

import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
sys.path[:0] = [str(ROOT), str(ROOT / "tests")]

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from eventlens.session import local_session

    session = local_session("tests", 8, **{"spark.sql.shuffle.partitions": "2", "spark.default.parallelism": "2"})
    session.sparkContext.setLogLevel("ERROR")
    return session


@pytest.fixture(scope="session")
def adapted(spark):
    """Events and items of the smallest test scale, read back from Parquet once."""
    import tempfile

    from eventlens.catalog import adapter
    from eventlens.sources.readers import read_events, read_items

    root = tempfile.mkdtemp(prefix="eventlens-test-")
    raw = adapter.source(spark, SMALL)
    adapter.adapt_events(raw).write.parquet(f"{root}/events")
    adapter.adapt_items(raw).write.parquet(f"{root}/items")
    return {"root": root, "events": read_events(spark, root), "items": read_items(spark, root)}
