"""Purchases, one row each, however often the hit was sent."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventlens.schema import MONEY

PURCHASE = "purchase"


def purchases(stg: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Key: session, transaction id, revenue (and ``by``).

    Re-sent hits arrive a second later, so time is not in the key; transaction ids
    are often missing, so they are not the key alone. Two real purchases of equal
    value without an id in one session merge; that is accepted.
    """
    return (
        stg.filter(F.col("event_name") == PURCHASE)
        .groupBy("session_key", "user_pseudo_id", "transaction_id", "purchase_revenue_usd", *by)
        .agg(F.min("event_ts").alias("purchase_ts"), F.count(F.lit(1)).alias("n_rows"))
        .withColumn("purchase_revenue_usd", F.col("purchase_revenue_usd").cast(MONEY))
    )


def session_purchases(orders: DataFrame) -> DataFrame:
    """Purchases and exact revenue per session."""
    return orders.groupBy("session_key").agg(
        F.count(F.lit(1)).alias("purchases"),
        F.sum("purchase_revenue_usd").cast(MONEY).alias("revenue_usd"),
    )
