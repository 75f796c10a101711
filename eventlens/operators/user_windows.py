"""Per-user outcome in an experiment window, and history before it."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventlens.functions.events import count_if, sum_if
from eventlens.operators.first_touch import first_touch


def user_windows(sessions: DataFrame, start: date, end: date) -> DataFrame:
    """One row per user active from ``start`` to ``end``; users are what gets randomised."""
    day = F.col("session_date")
    before, inside = day < F.lit(start), day.between(F.lit(start), F.lit(end))
    bought = F.col("purchases") > 0
    # By user and device first, then by user: sums are partial sums of sums.
    merged = {
        "pre_sessions": (count_if(before), F.sum),
        "pre_purchases": (sum_if(F.col("purchases"), before), F.sum),
        "pre_revenue_usd": (sum_if(F.col("revenue_usd"), before), F.sum),
        "exp_sessions": (count_if(inside), F.sum),
        "exp_converting_sessions": (count_if(inside & bought), F.sum),
        "exp_purchases": (sum_if(F.col("purchases"), inside), F.sum),
        "exp_revenue_usd": (sum_if(F.col("revenue_usd"), inside), F.sum),
        "exp_first_date": (F.min(F.when(inside, day)), F.min),
    }
    users = first_touch(sessions, ["user_pseudo_id"], ["device_category"], "session_start_ts", merged)
    return users.drop("session_start_ts").filter(F.col("exp_sessions") > 0)
