"""Weekly new-user cohorts and who came back."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from eventlens.functions.events import first_value, week_start
from eventlens.functions.stats import double
from eventlens.operators.weekly import whole_table, with_week_coverage


def user_weeks(sessions: DataFrame) -> DataFrame:
    """Each user's active weeks with the week of their first session.

    ``cohort_week`` is NULL for users whose first session seen is not their first
    ever: they came before the data and belong to no cohort here.

    Sessions are reduced to one row per user and week before any row moves, so a
    user with a third of all sessions is a handful of rows when the window by user
    runs, and the join of new users back to their sessions is not needed.
    """
    start = F.col("session_start_ts")
    weeks = sessions.groupBy("user_pseudo_id", "week_start").agg(
        (F.max("purchases") > 0).alias("purchased"),
        F.min(start).alias("first_ts"),
        F.min(F.when(F.col("session_number").isNotNull(), start)).alias("numbered_ts"),
        first_value(F.col("session_number"), start).alias("number"),
        F.min("session_date").alias("first_day"),
        F.max("session_date").alias("last_day"),
    )
    per_user = Window.partitionBy("user_pseudo_id")
    first_number = F.min(F.when(F.col("number").isNotNull(), F.struct("numbered_ts", "number"))).over(per_user)
    return weeks.withColumn("first_seen", F.min("first_ts").over(per_user)).select(
        "user_pseudo_id",
        "week_start",
        "purchased",
        "first_day",
        "last_day",
        F.when(first_number["number"] == 1, week_start(F.to_date("first_seen"))).alias("cohort_week"),
    )


def cohort_retention(sessions: DataFrame) -> DataFrame:
    """Retention over the grid of fully observed weeks, zero-filled inside it only.

    Everything after the one pass over sessions happens on (cohort, week) counts,
    whose number the calendar bounds: users outside any cohort stay in as a NULL
    cohort, because they too say which weeks the data covers.
    """
    counts = (
        user_weeks(sessions)
        .groupBy("cohort_week", "week_start")
        .agg(
            F.count(F.lit(1)).alias("active"),
            F.count_if("purchased").alias("purchasing"),
            F.min("first_day").alias("first_day"),
            F.max("last_day").alias("last_day"),
        )
    )
    covered = with_week_coverage(counts, "first_day", "last_day").withColumn(
        "full_weeks", F.collect_set(F.when(F.col("is_full_week"), F.col("week_start"))).over(whole_table())
    )
    cohorts = (
        covered.filter(F.col("cohort_week").isNotNull())
        .groupBy("cohort_week")
        .agg(
            F.max("full_weeks").alias("full_weeks"),
            F.map_from_entries(
                F.collect_list(F.struct("week_start", F.struct("active", "purchasing")))
            ).alias("activity"),
        )
        .filter(F.array_contains("full_weeks", F.col("cohort_week")))
        # Everyone is active in the week they first came, so that count is the cohort's size.
        .withColumn("cohort_users", F.try_element_at("activity", F.col("cohort_week"))["active"])
    )
    grid = cohorts.select(
        "cohort_week",
        "cohort_users",
        "activity",
        F.explode(F.filter("full_weeks", lambda w: w >= F.col("cohort_week"))).alias("activity_week"),
    ).withColumn("seen", F.try_element_at("activity", F.col("activity_week")))
    zero = F.lit(0).cast("bigint")
    return (
        grid.select(
            "cohort_week",
            "activity_week",
            (F.datediff("activity_week", "cohort_week") / 7).cast("int").alias("week_offset"),
            "cohort_users",
            F.coalesce(F.col("seen.active"), zero).alias("active_users"),
            F.coalesce(F.col("seen.purchasing"), zero).alias("purchasing_users"),
        )
        .withColumn("retention", double("active_users") / double("cohort_users"))
        .withColumn("purchase_retention", double("purchasing_users") / double("cohort_users"))
    )
