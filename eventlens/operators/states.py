"""What one day says about each session, in a form that the days of a session merge from.

A state is a row by session and day. Times and flags merge by minimum, maximum and bitwise or, earliest values as
(time, value) pairs by minimum, page views by sum: copies of a row are of one day, so they are gone before. The ordered funnel is a
move ("entering at depth s you leave at depth t"); moves of days compose in the order of time, if the seconds they cover
do not overlap. Where they do, which takes an export day that is not cut along the clock, the session is told apart and is
computed from its rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventlens.functions.events import first_row_value_key, url_path
from eventlens.operators.funnel import funnel_moves
from eventlens.operators.purchases import purchases
from eventlens.operators.sessions import FIRST_TOUCH, KEY_USER, page_views
from eventlens.operators.staging import placeable_hits

KEYS = ["session_key", "day"]


def day_states(events: DataFrame, steps: Sequence[str]) -> DataFrame:
    """A row by session and ``day`` (the export's): what ``merged`` needs of it."""
    hits = placeable_hits(events).withColumn("day", F.col("event_date"))
    at = F.col("event_ts")
    # Combinations first, as in ``first_touch``: buffers of rows are numbers.
    combined = hits.groupBy(*KEYS, *FIRST_TOUCH).agg(
        F.min(at).alias("_at"),
        F.max("ga_session_number").alias("session_number"),
        F.max(F.when(F.col("session_engaged") == "1", 1).otherwise(0)).alias("engaged"),
    )
    touched = [
        F.min(F.when(F.col(c).isNotNull() & F.col("_at").isNotNull(), F.struct(F.col("_at").alias("at"), F.col(c).alias("value")))).alias(f"touch_{c}")
        for c in FIRST_TOUCH
    ]
    base = combined.groupBy(*KEYS).agg(F.min("_at").alias("session_start_ts"), F.max("session_number").alias("session_number"), F.max("engaged").alias("engaged"), *touched)
    page = F.col("page_location")
    entry = hits.filter(F.col("event_name") == steps[0]).groupBy(*KEYS).agg(first_row_value_key(url_path(page), at, page).alias("entry"))
    moves = funnel_moves(hits, steps, KEYS)
    views = page_views(hits.distinct(), KEYS)
    return base.join(entry, KEYS, "left").join(moves, KEYS, "left").join(views, KEYS, "left")


def day_orders(events: DataFrame) -> DataFrame:
    """Purchases of each day, by the key of ``purchases``; rows of several days merge in ``merged_orders``."""
    stg = placeable_hits(events.distinct()).withColumn("day", F.col("event_date"))
    return purchases(stg, ["day"])


def merged_orders(orders: DataFrame) -> DataFrame:
    key = ["session_key", "user_pseudo_id", "transaction_id", "purchase_revenue_usd"]
    merged = orders.groupBy(*key).agg(F.min("purchase_ts").alias("purchase_ts"), F.sum("n_rows").alias("n_rows"))
    return merged.select(*key, "purchase_ts", "n_rows")


def merged(states: DataFrame, steps: Sequence[str]) -> DataFrame:
    """One row by session: its attributes, ``page_views``, ``entry``, ``seen`` and ``depth`` of the funnel, and ``overlaps``.

    ``depth`` is NULL where days overlap, ``seen`` where there is no funnel event.
    """
    k = len(steps)
    part = F.when(F.col("from_second").isNotNull(), F.struct("from_second", "to_second", "move"))
    by = states.groupBy("session_key").agg(
        F.min("session_start_ts").alias("session_start_ts"),
        F.max("session_number").alias("session_number"),
        F.max("engaged").alias("engaged"),
        *[F.min(f"touch_{c}")["value"].alias(c) for c in FIRST_TOUCH],
        F.min("entry").alias("entry"),
        F.sum("page_views").alias("page_views"),
        F.bit_or("seen").alias("seen"),
        F.array_sort(F.collect_list(part)).alias("_parts"),
    )
    overlaps = "exists(sequence(1, size(_parts) - 1, 1), i -> _parts[i].from_second <= _parts[i - 1].to_second)"
    depth = f"aggregate(_parts, 0, (depth, p) -> IF(depth < {k}, p.move[depth], depth))"
    told = by.withColumn("overlaps", F.expr(f"size(_parts) > 1 AND {overlaps}"))
    told = told.withColumn("depth", F.when(~F.col("overlaps"), F.expr(depth))).drop("_parts")
    return told.withColumn("user_pseudo_id", F.expr(KEY_USER))


def funnel_of(told: DataFrame, steps: Sequence[str]) -> DataFrame:
    """The columns of ``session_funnel`` from ``seen`` and ``depth``, of sessions with a funnel event."""
    return told.filter(F.col("seen").isNotNull()).selectExpr(
        "session_key",
        *[f"int(getbit(seen, {i})) AS any_{step}" for i, step in enumerate(steps)],
        *[f"int(depth > {i}) AS reached_{step}" for i, step in enumerate(steps)],
    )
