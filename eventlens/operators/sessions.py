"""The session table: who, when, where from, how far, what was bought."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventlens.functions.events import session_channel, week_start
from eventlens.operators.first_touch import first_touch
from eventlens.operators.purchases import session_purchases
from eventlens.schema import MONEY

PAGE_VIEW = "page_view"


FIRST_TOUCH = ("device_category", "country", "session_source", "session_medium", "ft_source", "ft_medium")
#: The user's part of a session key: what stands before the last colon (a session id is a number).
KEY_USER = "left(session_key, length(session_key) - length(substring_index(session_key, ':', -1)) - 1)"


def session_attributes(hits: DataFrame) -> DataFrame:
    """What the first hits say about each session. Copies of a row change nothing.

    Source and medium each come from their own first hit that has one. The user is read off the key, so that the
    aggregate over all rows has numbers only in its buffer.
    """
    merged = {
        "session_number": (F.max("ga_session_number"), F.max),
        "engaged": (F.max(F.when(F.col("session_engaged") == "1", 1).otherwise(0)), F.max),
    }
    first = first_touch(hits, ["session_key"], FIRST_TOUCH, "event_ts", merged)
    return first.withColumnRenamed("event_ts", "session_start_ts").withColumn("user_pseudo_id", F.expr(KEY_USER))


def page_views(stg: DataFrame, keys: Sequence[str] = ("session_key",)) -> DataFrame:
    """Page views per session (or other keys): a count, so it needs the rows without copies."""
    return (
        stg.filter(F.col("event_name") == PAGE_VIEW)
        .groupBy(*keys)
        .agg(F.count(F.lit(1)).alias("page_views"))
    )


def sessions(
    stg: DataFrame,
    orders: DataFrame,
    funnel: DataFrame,
    steps: Sequence[str],
    hits: DataFrame | None = None,
) -> DataFrame:
    """One row per session, dated by the day and week it starts in.

    Every side is already one row per ``session_key`` and hashed by it, so the left
    joins add no shuffle and cannot multiply or skew. ``hits`` may hold rows with
    copies (``placeable_hits``): then only page views and purchases pay for
    de-duplication, not the whole table.
    """
    return from_parts(session_attributes(stg if hits is None else hits), funnel, page_views(stg), orders, steps)


def from_parts(base: DataFrame, funnel: DataFrame, views: DataFrame, orders: DataFrame, steps: Sequence[str]) -> DataFrame:
    """The session table from attributes, funnel, page views and purchases."""
    number = F.col("session_number")
    day = F.to_date("session_start_ts")
    flags = [f"{kind}_{step}" for step in steps for kind in ("reached", "any")]
    zero_money = F.lit(0).cast(MONEY)
    return (
        base.join(funnel, "session_key", "left")
        .join(views, "session_key", "left")
        .join(session_purchases(orders), "session_key", "left")
        .select(
            "session_key",
            "user_pseudo_id",
            "session_start_ts",
            day.alias("session_date"),
            week_start(day).alias("week_start"),
            "session_number",
            (number == 1).alias("is_first_session"),
            "device_category",
            "country",
            session_channel(
                *(F.col(c) for c in ("session_source", "session_medium", "ft_source", "ft_medium", "session_number"))
            ).alias("channel"),
            "engaged",
            F.coalesce("page_views", F.lit(0)).alias("page_views"),
            *[F.coalesce(c, F.lit(0)).alias(c) for c in flags],
            F.coalesce("purchases", F.lit(0)).alias("purchases"),
            F.coalesce("revenue_usd", zero_money).cast(MONEY).alias("revenue_usd"),
        )
    )
