"""Flattening a nested daily export into the events and items tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventlens.schema import EVENTS, ITEMS, conform

# Where each flat column lives in the nested record.
INT_PARAMS = {
    "ga_session_id": "ga_session_id",
    "ga_session_number": "ga_session_number",
    "engagement_time_msec": "engagement_time_msec",
}
ANY_PARAMS = {"session_engaged": "session_engaged"}
STRING_PARAMS = {
    "page_location": "page_location",
    "session_source": "source",
    "session_medium": "medium",
    "session_campaign": "campaign",
}
STRUCT_PATHS = {
    "ft_source": "traffic_source.source",
    "ft_medium": "traffic_source.medium",
    "ft_name": "traffic_source.name",
    "device_category": "device.category",
    "operating_system": "device.operating_system",
    "browser": "device.web_info.browser",
    "country": "geo.country",
    "transaction_id": "ecommerce.transaction_id",
    "purchase_revenue_usd": "ecommerce.purchase_revenue_in_usd",
    "shipping_usd": "ecommerce.shipping_value_in_usd",
    "tax_usd": "ecommerce.tax_value_in_usd",
    "total_item_quantity": "ecommerce.total_item_quantity",
}
ITEM_PATHS = {
    "item_id": "item_id",
    "item_name": "item_name",
    "item_category": "item_category",
    "price_usd": "price_in_usd",
    "quantity": "quantity",
    "item_revenue_usd": "item_revenue_in_usd",
}
ITEM_EVENTS = ("view_item", "add_to_cart", "begin_checkout", "purchase")


def param(key: str, slot: str, params: str = "event_params") -> Column:
    """Largest value of ``key`` in one typed slot; NULL if absent or in another slot.

    A repeated key must not fail the row, hence the maximum; only such rows look at every element by a lambda, which
    Spark does not compile. The array never leaves its row, so there is no explode and no shuffle.
    """
    return param_by(key, lambda value: value[slot], params)


def param_any(key: str, params: str = "event_params") -> Column:
    """Largest value of ``key`` as a string, whichever of the two slots holds it."""
    return param_by(key, lambda v: F.coalesce(v["string_value"], v["int_value"].cast("string")), params)


def param_by(key: str, pick, params: str = "event_params") -> Column:
    keys = F.col(params)["key"]
    first, from_end = F.array_position(keys, key), F.array_position(F.reverse(keys), key)
    only = pick(F.get(params, (first - 1).cast("int"))["value"])
    matching = F.filter(params, lambda p: p["key"] == key)
    largest = F.array_max(F.transform(matching, lambda p: pick(p["value"])))
    return F.when(first > 0, F.when(first + from_end > F.size(keys), only).otherwise(largest))


def struct_columns() -> list[Column]:
    return [F.col(path).alias(name) for name, path in STRUCT_PATHS.items()]


def event_day(c: str = "event_date") -> Column:
    return F.to_date(c, "yyyyMMdd")


def event_time(c: str = "event_timestamp") -> Column:
    """Microseconds since 1970 as a zone-free timestamp (the session runs in UTC)."""
    return F.timestamp_micros(c).cast("timestamp_ntz")


def _placed() -> list[Column]:
    return [
        event_day().alias("event_date"),
        event_time().alias("event_ts"),
        "event_name",
        "user_pseudo_id",
    ]


def flatten_events(nested: DataFrame) -> DataFrame:
    """One flat row per nested event; a map-only job."""
    return conform(
        nested.select(
            *_placed(),
            *[param(key, "int_value").alias(name) for name, key in INT_PARAMS.items()],
            *[param_any(key).alias(name) for name, key in ANY_PARAMS.items()],
            *[param(key, "string_value").alias(name) for name, key in STRING_PARAMS.items()],
            *struct_columns(),
        ),
        EVENTS,
    )


def flatten_items(nested: DataFrame) -> DataFrame:
    """One row per item of a commerce event; an event without items gives none.

    A table of its own: joined into events, each purchase would count once per line. The columns of the event are read
    once, before its lines; ``coalesce`` keeps Spark from putting a copy of what makes up ``items`` into a filter.
    """
    orders = nested.filter(F.col("event_name").isin(*ITEM_EVENTS)).select(
        *_placed(),
        param("ga_session_id", "int_value").alias("ga_session_id"),
        F.col("ecommerce.transaction_id").alias("transaction_id"),
        "items",
    )
    lines = orders.select("*", F.explode(F.coalesce("items", F.array())).alias("item"))
    return conform(
        lines.select("*", *[F.col(f"item.{path}").alias(name) for name, path in ITEM_PATHS.items()]), ITEMS
    )
