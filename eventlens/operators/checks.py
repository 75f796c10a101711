"""Data tests on the models. Each returns the offending rows; empty means pass."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventlens.functions.events import CHANNELS
from eventlens.functions.stats import double

IDENTITY_TOLERANCE = 1e-6


def duplicate_keys(df: DataFrame, key: str) -> DataFrame:
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("rows")).filter(F.col("rows") > 1)


def null_keys(df: DataFrame, *columns: str) -> DataFrame:
    return df.filter(reduce(lambda a, b: a | b, [F.col(c).isNull() for c in columns]))


def unexpected_channels(sessions: DataFrame, accepted: Sequence[str] = CHANNELS) -> DataFrame:
    return sessions.filter(~F.col("channel").isin(*accepted))


def unordered_funnels(sessions: DataFrame, steps: Sequence[str]) -> DataFrame:
    """Sessions that reach a step without the one before it."""
    broken = [F.col(f"reached_{b}") > F.col(f"reached_{a}") for a, b in zip(steps, steps[1:])]
    return sessions.filter(reduce(lambda a, b: a | b, broken)).select("session_key")


def broken_revenue_identity(weekly: DataFrame) -> DataFrame:
    return weekly.filter(_off_identity()).select("week_start")


def _off_identity() -> Column:
    product = double("users") * F.col("sessions_per_user") * F.col("conversion") * F.col("aov")
    revenue = double("revenue_usd")
    return (F.col("transactions") > 0) & (F.abs(product - revenue) > F.greatest(revenue, F.lit(1.0)) * IDENTITY_TOLERANCE)


def cohorts_out_of_bounds(cohorts: DataFrame) -> DataFrame:
    """Week 0 must be everyone, rates must stay in [0, 1], buyers are among the active."""
    return cohorts.filter(_out_of_bounds()).select("cohort_week", "week_offset", "retention")


def _out_of_bounds() -> Column:
    kept = F.col("retention")
    return ((F.col("week_offset") == 0) & (kept != 1)) | ~kept.between(0, 1) | (F.col("purchase_retention") > kept)


def _any_null(*columns: str) -> Column:
    return reduce(lambda a, b: a | b, [F.col(c).isNull() for c in columns])


def row_violations(steps: Sequence[str]) -> dict[str, dict[str, Column]]:
    """By model, the data tests that a row passes or fails by itself: they can be counted while the model is written."""
    broken = [F.col(f"reached_{b}") > F.col(f"reached_{a}") for a, b in zip(steps, steps[1:])]
    return {
        "sessions": {
            "sessions_not_null": _any_null("session_key", "user_pseudo_id"),
            "sessions_channel_accepted": ~F.col("channel").isin(*CHANNELS),
            "funnel_is_ordered": reduce(lambda a, b: a | b, broken),
        },
        "weekly_metrics": {"weekly_not_null": _any_null("week_start"), "revenue_identity": _off_identity()},
        "area_funnel": {"areas_not_null": _any_null("entry_area")},
        "user_windows": {"users_not_null": _any_null("user_pseudo_id")},
        "cohort_retention": {"cohort_bounds": _out_of_bounds()},
    }


#: Keys that must be unique: two rows are needed to break such a test, so it reads the written key column.
UNIQUE = {
    "sessions_key_unique": ("sessions", "session_key"),
    "weekly_key_unique": ("weekly_metrics", "week_start"),
    "areas_key_unique": ("area_funnel", "entry_area"),
    "users_key_unique": ("user_windows", "user_pseudo_id"),
}


def key_failures(models: Mapping[str, DataFrame]) -> DataFrame:
    """(check, failures) of the tests on keys."""
    counted = [
        duplicate_keys(models[name], key).agg(F.count(F.lit(1)).alias("failures")).select(F.lit(check).alias("check"), "failures")
        for check, (name, key) in UNIQUE.items()
    ]
    return reduce(DataFrame.unionByName, counted)


def run_all(
    sessions: DataFrame, weekly: DataFrame, cohorts: DataFrame, areas: DataFrame, users: DataFrame,
    steps: Sequence[str],
) -> DataFrame:
    """(check, failures) for every data test."""
    tests = {
        "sessions_key_unique": duplicate_keys(sessions, "session_key"),
        "sessions_not_null": null_keys(sessions, "session_key", "user_pseudo_id"),
        "sessions_channel_accepted": unexpected_channels(sessions),
        "weekly_key_unique": duplicate_keys(weekly, "week_start"),
        "weekly_not_null": null_keys(weekly, "week_start"),
        "areas_key_unique": duplicate_keys(areas, "entry_area"),
        "areas_not_null": null_keys(areas, "entry_area"),
        "users_key_unique": duplicate_keys(users, "user_pseudo_id"),
        "users_not_null": null_keys(users, "user_pseudo_id"),
        "funnel_is_ordered": unordered_funnels(sessions, steps),
        "revenue_identity": broken_revenue_identity(weekly),
        "cohort_bounds": cohorts_out_of_bounds(cohorts),
    }
    counted = [
        df.agg(F.count(F.lit(1)).alias("failures")).select(F.lit(name).alias("check"), "failures")
        for name, df in tests.items()
    ]
    return reduce(DataFrame.unionByName, counted)
