"""The flat tables: column names, order and types, and the gate that enforces them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.types import (
    DateType,
    DecimalType,
    DoubleType,
    LongType,
    StringType,
    StructField,
    StructType,
    TimestampNTZType,
)

_DATE, _TS, _STR, _INT, _DBL = DateType(), TimestampNTZType(), StringType(), LongType(), DoubleType()


def _struct(*columns) -> StructType:
    return StructType([StructField(name, kind) for name, kind in columns])


# The flat export format that every job reads.
EVENTS = _struct(
    ("event_date", _DATE),
    ("event_ts", _TS),
    ("event_name", _STR),
    ("user_pseudo_id", _STR),
    ("ga_session_id", _INT),
    ("ga_session_number", _INT),
    ("engagement_time_msec", _INT),
    ("session_engaged", _STR),
    ("page_location", _STR),
    ("session_source", _STR),
    ("session_medium", _STR),
    ("session_campaign", _STR),
    ("ft_source", _STR),
    ("ft_medium", _STR),
    ("ft_name", _STR),
    ("device_category", _STR),
    ("operating_system", _STR),
    ("browser", _STR),
    ("country", _STR),
    ("transaction_id", _STR),
    ("purchase_revenue_usd", _DBL),
    ("shipping_usd", _DBL),
    ("tax_usd", _DBL),
    ("total_item_quantity", _INT),
)

ITEMS = _struct(
    ("event_date", _DATE),
    ("event_ts", _TS),
    ("event_name", _STR),
    ("user_pseudo_id", _STR),
    ("ga_session_id", _INT),
    ("transaction_id", _STR),
    ("item_id", _STR),
    ("item_name", _STR),
    ("item_category", _STR),
    ("price_usd", _DBL),
    ("quantity", _INT),
    ("item_revenue_usd", _DBL),
)

# What an export writes where it has no real value.
PLACEHOLDERS = ("<Other>", "(not set)", "(data deleted)", "")

# Money is exact inside the models, so sums do not depend on the order of addition.
MONEY = DecimalType(38, 6)


def conform(df: DataFrame, schema: StructType) -> DataFrame:
    """Select ``schema``'s columns in its order and types; refuse a frame that lacks one.

    Reading with a forced schema would turn a missing column into silent NULLs,
    so the check is made on the columns the source really has.
    """
    missing = [f.name for f in schema if f.name not in df.columns]
    if missing:
        raise ValueError(f"source is missing columns: {missing}")
    return df.selectExpr(*[f"CAST(`{f.name}` AS {f.dataType.simpleString()}) AS `{f.name}`" for f in schema])
