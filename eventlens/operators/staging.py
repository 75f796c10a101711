"""Which raw rows count, and the session they belong to."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventlens.functions.events import session_key


def placeable_hits(events: DataFrame) -> DataFrame:
    """Rows that can be placed in a session, with their ``session_key``. No shuffle.

    Exact copies are still in. Anything that takes a minimum, a maximum or a set
    over them gives the same answer with or without the copies, so it should read
    this frame and not pay for ``stage_events``.
    """
    return events.dropna(subset=["user_pseudo_id", "ga_session_id"]).withColumn("session_key", session_key())


def row_counts(events: DataFrame) -> DataFrame:
    """Distinct rows and how many ``copies`` each has: the one shuffle of whole rows that a build makes.

    Copies combine before the shuffle, and the rest is spread over all columns, so neither a hot session nor a hot
    group of copies lands in one task. Duplicate checks are sums of the counts, and ``stage_events`` is this table.
    """
    return events.groupBy(*events.columns).agg(F.count(F.lit(1)).alias("copies"))


def stage_events(events: DataFrame) -> DataFrame:
    """Placeable rows with exact copies collapsed: what counts and sums must read.

    A filter on the result is pushed through ``distinct`` to the scan.
    """
    return placeable_hits(events.distinct())


def staged_from_counts(counted: DataFrame) -> DataFrame:
    """The same rows from what ``row_counts`` has written: no shuffle."""
    return placeable_hits(counted.drop("copies"))
