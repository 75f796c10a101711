"""Checkout and purchase by the store section a visit first looked at."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventlens.functions.events import count_if, first_row_value, path_section, url_path
from eventlens.schema import MONEY


def entry_areas(hits: DataFrame, view_step: str) -> DataFrame:
    """Section of each session's first product view. Copies of a row change nothing."""
    page = F.col("page_location")
    first_path = first_row_value(url_path(page), F.col("event_ts"), page)
    return (
        hits.filter(F.col("event_name") == view_step)
        .groupBy("session_key")
        .agg(first_path.alias("path"))
        .transform(sections)
    )


def sections(entries: DataFrame) -> DataFrame:
    """(session_key, entry_area) of (session_key, path)."""
    return entries.select("session_key", path_section(F.col("path")).alias("entry_area"))


def area_funnel(
    hits: DataFrame,
    sessions: DataFrame,
    revenue_reliable_through: date,
    view_step: str = "view_item",
    checkout_step: str = "begin_checkout",
    purchase_step: str = "purchase",
) -> DataFrame:
    """Per section of the entry page; see ``area_rates``."""
    return area_rates(entry_areas(hits, view_step), sessions, revenue_reliable_through, view_step, checkout_step, purchase_step)


def area_rates(
    entries: DataFrame, sessions: DataFrame, revenue_reliable_through: date, view_step: str, checkout_step: str, purchase_step: str
) -> DataFrame:
    """Per section: visits, checkouts, ordered purchases, and money from reliable days.

    Both join sides hold one row per session, hashed by it.
    """
    bought = F.col(f"reached_{purchase_step}") == 1
    reliable = bought & (F.col("session_date") <= F.lit(revenue_reliable_through))
    zero = F.lit(0).cast(MONEY)
    return (
        entries.join(sessions.filter(F.col(f"reached_{view_step}") == 1), "session_key")
        .groupBy("entry_area")
        .agg(
            F.count(F.lit(1)).alias("sessions"),
            F.sum(f"reached_{checkout_step}").alias("checkouts"),
            F.sum(f"reached_{purchase_step}").alias("purchase_sessions"),
            count_if(reliable).alias("purchase_sessions_reliable"),
            F.coalesce(F.sum(F.when(reliable, F.col("revenue_usd"))), zero).cast(MONEY).alias("revenue_reliable_usd"),
        )
    )
