"""Weekly revenue and the four factors it is the product of."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from eventlens.functions.events import days_observed
from eventlens.functions.stats import double, ratio
from eventlens.schema import MONEY

def whole_table() -> WindowSpec:
    """All rows as one window: for tables with a row per calendar week, day, or channel only."""
    return Window.partitionBy(F.lit(0))


def with_week_coverage(weeks: DataFrame, first: str, last: str) -> DataFrame:
    """Days of each week inside the data; ``first``/``last`` are each row's own session dates."""
    low, high = F.min(first).over(whole_table()), F.max(last).over(whole_table())
    return weeks.withColumn("days_observed", days_observed(F.col("week_start"), low, high)).withColumn(
        "is_full_week", F.col("days_observed") == 7
    )


def weekly_metrics(sessions: DataFrame, revenue_reliable_through: date) -> DataFrame:
    """Per ISO week: revenue = users x sessions per user x conversion x order value.

    The range of the data is the range of session dates, taken from the weekly rows
    themselves, so the sessions are read once.
    """
    weeks = sessions.groupBy("week_start").agg(
        F.countDistinct("user_pseudo_id").alias("users"),
        F.count(F.lit(1)).alias("sessions"),
        F.sum("purchases").alias("transactions"),
        F.sum("revenue_usd").cast(MONEY).alias("revenue_usd"),
        F.min("session_date").alias("first_day"),
        F.max("session_date").alias("last_day"),
    )
    return with_week_coverage(weeks, "first_day", "last_day").select(
        "week_start",
        "days_observed",
        "is_full_week",
        (F.date_add("week_start", 6) <= F.lit(revenue_reliable_through)).alias("revenue_complete"),
        "users",
        "sessions",
        "transactions",
        "revenue_usd",
        (double("sessions") / double("users")).alias("sessions_per_user"),
        (double("transactions") / double("sessions")).alias("conversion"),
        # Decimal by bigint would keep six digits only: double first.
        ratio("revenue_usd", "transactions").alias("aov"),
    )
