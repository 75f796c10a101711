"""The same measures cut several ways, in one pass."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventlens.functions.events import segment_name, user_type
from eventlens.schema import MONEY


def default_cuts() -> dict[str, Column]:
    return {
        "all": F.lit("all"),
        "device": F.col("device_category"),
        "channel": F.col("channel"),
        "user_type": user_type(F.col("is_first_session")),
    }


def funnel_segments(
    sessions: DataFrame, steps: Sequence[str], cuts: Mapping[str, Column] | None = None
) -> DataFrame:
    """Counts per (segment_type, segment); a NULL segment is its own '(null)' row.

    Each session is emitted once per cut inside the task and summed before the
    shuffle. The distinct users are the only wide part: at most one row per user
    and segment leaves a task.
    """
    cuts = cuts or default_cuts()
    tags = F.array(
        *[F.struct(F.lit(kind).alias("segment_type"), segment_name(c).alias("segment")) for kind, c in cuts.items()]
    )
    flags = [f"{kind}_{step}" for step in steps for kind in ("reached", "any")]
    return (
        sessions.select(
            F.explode(tags).alias("tag"), "user_pseudo_id", *flags, "engaged", "purchases", "revenue_usd"
        )
        .groupBy(F.col("tag.segment_type").alias("segment_type"), F.col("tag.segment").alias("segment"))
        .agg(
            F.count(F.lit(1)).alias("sessions"),
            F.countDistinct("user_pseudo_id").alias("users"),
            *[F.sum(c).alias(c) for c in flags],
            F.sum("engaged").alias("engaged_sessions"),
            F.sum("purchases").alias("purchases"),
            F.sum("revenue_usd").cast(MONEY).alias("revenue_usd"),
        )
    )
