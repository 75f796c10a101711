"""The shared ``events`` test table as an event export, quirks included.

Every source row is used. A user's timeline is moved by ``user_id % 21`` days, so
that users arrive over several weeks; arithmetic on ids and the ``k`` of ``props``
fills the other columns and plants what the audit looks for. Nothing is random, so
the SQL in ``oracle`` states the same table on its own.

Planted: purchases re-sent a second later; exact copies; rows without a session or
user; unusable transaction ids; missing and zero revenue; lines that do not add up
or are missing; cart tracking switched on in the third week; shipping within 0.2 ms
of checkout in either order; phones losing half of their payment steps; one section
(Drinkware) where most checkouts are missing.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eventlens.config import Config
from eventlens.schema import EVENTS, ITEMS, conform

CONFIG = Config(
    window_start=date(2024, 1, 1),
    window_end=date(2024, 2, 19),
    experiment_start=date(2024, 1, 22),
    experiment_end=date(2024, 2, 11),
    revenue_reliable_through=date(2024, 2, 11),
    holiday_start=date(2024, 1, 22),
    area_min_sessions=20,
    small_sample=50,
    coverage_min_sessions=5,
    bad_day_min_purchases=5,
    design_min_users=20,
)

SITE = "https://shop.example.com"
SOURCES = {
    0: ("(direct)", "(none)"),
    1: ("google", "organic"),
    2: ("google", "cpc"),
    3: ("x.com", "referral"),
    4: ("<Other>", "<Other>"),
    5: ("news", "email"),
}
PAGES = {
    0: f"{SITE}/Google+Redesign/Apparel?x=1",
    1: f"{SITE}/Google+Redesign/Apparel",
    2: f"{SITE}/Google+Redesign/Bags",
    3: f"{SITE}/Google+Redesign/Shop+by+Brand",
    4: f"{SITE}/store.html",
    5: f"{SITE}/",
}
WEAK_PAGE = f"{SITE}/Google+Redesign/Drinkware"


def _pick(key: str, table: dict) -> str:
    """The text of a key from 0, NULL beyond them; a place in a constant keeps the generated method small enough to compile."""
    texts = ", ".join(f"'{table[i]}'" for i in range(len(table)))
    return f"get(array({texts}), int({key}))"


def _rows(raw: DataFrame) -> DataFrame:
    """Source rows with day and ``k``, once per kind of hit they stand for."""
    return (
        raw.selectExpr(
            "event_id",
            "user_id",
            "event_type",
            "value",
            "user_id % 21 AS shift",
            "ts + make_dt_interval(int(user_id % 21)) AS moved",
            r"bigint(regexp_extract(props, '(\\d+)', 1)) AS k",
        )
        .withColumn("d", F.expr("bigint(datediff(to_date(moved), DATE'2024-01-01'))"))
        .withColumn(
            "kind",
            F.expr(
                """explode(array(
                    'base',
                    IF(event_type = 'purchase' AND event_id % 41 = 0, 'resend', NULL),
                    IF(event_type IN ('view', 'error') AND event_id % 97 = 0, 'copy', NULL),
                    IF(event_type = 'click' AND event_id % 3 = 0, 'ship', NULL),
                    IF(event_type = 'click' AND event_id % 4 = 0 AND d >= 14, 'cart', NULL)))"""
            ),
        )
        .filter("kind IS NOT NULL")
    )


def _flat(raw: DataFrame) -> DataFrame:
    source, medium = ({i: pair[j] for i, pair in SOURCES.items()} for j in (0, 1))
    return (
        _rows(raw)
        .withColumn(
            "event_ts",
            F.expr(
                """moved + CASE
                    WHEN kind = 'resend' THEN interval 1 second
                    WHEN kind = 'ship' AND event_id % 2 = 0 THEN interval 0.0002 seconds
                    WHEN kind = 'ship' THEN interval -0.0002 seconds
                    WHEN kind = 'cart' THEN interval -30 seconds
                    ELSE interval 0 seconds END"""
            ),
        )
        .selectExpr(
            "event_id",
            "value",
            "kind",
            "k",
            "to_date(event_ts) AS event_date",
            "event_ts",
            """CASE
                WHEN kind = 'cart' THEN 'add_to_cart'
                WHEN kind = 'ship' THEN 'add_shipping_info'
                WHEN event_type = 'view' THEN 'view_item'
                WHEN event_type = 'click' THEN IF(user_id % 6 = 5 AND event_id % 4 <> 0, 'page_view', 'begin_checkout')
                WHEN event_type = 'signup' THEN IF(user_id % 3 = 1 AND event_id % 2 = 0, 'page_view', 'add_payment_info')
                WHEN event_type = 'error' THEN 'page_view'
                ELSE 'purchase' END AS event_name""",
            "IF(event_type = 'error' AND event_id % 211 = 0, NULL, string(user_id)) AS user_pseudo_id",
            "IF(event_type IN ('view', 'error') AND event_id % 53 = 0, NULL, d - d % 3) AS ga_session_id",
            "d div 3 - shift div 3 + 1 + IF(user_id % 7 = 0, 3, 0) AS ga_session_number",
            "k * 100 AS engagement_time_msec",
            "IF(k % 2 = 0, '1', '0') AS session_engaged",
            f"IF(user_id % 6 = 5, '{WEAK_PAGE}', {_pick('k % 7', PAGES)}) AS page_location",
            f"{_pick('k % 8', source)} AS session_source",
            f"{_pick('k % 8', medium)} AS session_medium",
            "IF(k % 8 = 2, 'spring', NULL) AS session_campaign",
            f"{_pick('user_id % 8', source)} AS ft_source",
            f"{_pick('user_id % 8', medium)} AS ft_medium",
            "string(NULL) AS ft_name",
            """CASE WHEN user_id % 3 = 0 THEN 'desktop' WHEN user_id % 3 = 1 THEN 'mobile'
                WHEN user_id % 15 <> 2 THEN 'tablet' END AS device_category""",
            "IF(user_id % 4 = 0, '<Other>', 'Web') AS operating_system",
            "IF(user_id % 9 = 0, '', 'Chrome') AS browser",
            "IF(user_id % 20 = 0, '(not set)', 'X') AS country",
            """CASE WHEN event_type <> 'purchase' THEN NULL WHEN event_id % 3 = 0 THEN '(not set)'
                WHEN event_id % 29 <> 0 THEN 'T' || event_id END AS transaction_id""",
            """CASE WHEN event_type <> 'purchase' OR event_id % 37 = 0 THEN NULL
                WHEN d >= 42 AND event_id % 4 <> 0 THEN 0D ELSE value END AS purchase_revenue_usd""",
            "double(NULL) AS shipping_usd",
            "double(NULL) AS tax_usd",
            "IF(event_type = 'purchase', 2L, NULL) AS total_item_quantity",
        )
    )


def _item(line: int, price: str, revenue: str) -> str:
    return f"""struct(
        'I' || (event_id % 100) AS item_id, 'line {line}' AS item_name,
        CASE k % 3 WHEN 0 THEN 'Apparel' WHEN 1 THEN 'Bags' END AS item_category,
        {price} AS price_in_usd, 1L AS quantity, double({revenue}) AS item_revenue_in_usd)"""


def _purchase_items() -> str:
    """Two equal lines; short of the order by a fifth, or missing, for some; none on a re-sent hit."""
    half = "purchase_revenue_usd / 2"
    lines = f"array({', '.join(_item(i, half, f'{half} * IF(event_id % 10 = 0, 0.8D, 1D)') for i in (1, 2))})"
    return f"IF(event_id % 10 = 9 OR kind = 'resend', slice({lines}, 1, 0), {lines})"


def adapt_events(raw: DataFrame) -> DataFrame:
    return conform(_flat(raw), EVENTS)


def adapt_items(raw: DataFrame) -> DataFrame:
    lines = (
        _flat(raw)
        .filter("event_name = 'purchase'")
        .withColumn("item", F.expr(f"explode({_purchase_items()})"))
        .selectExpr(
            "* EXCEPT (item)",
            "item.item_id",
            "item.item_name",
            "item.item_category",
            "item.price_in_usd AS price_usd",
            "item.quantity",
            "item.item_revenue_in_usd AS item_revenue_usd",
        )
    )
    return conform(lines, ITEMS)


def _param(key: str, slot: str, value: str, when: str = "true") -> str:
    text, number = (value, "bigint(NULL)") if slot == "string" else ("string(NULL)", value)
    return (
        f"IF({when} AND {value} IS NOT NULL,"
        f" struct('{key}' AS key, struct({text} AS string_value, {number} AS int_value) AS value), NULL)"
    )


def nest(raw: DataFrame) -> DataFrame:
    """The same export as nested records, with repeated keys, values in the other slot and empty arrays."""
    params = [
        _param("ga_session_id", "int", "ga_session_id"),
        _param("ga_session_number", "int", "ga_session_number"),
        _param("engagement_time_msec", "int", "engagement_time_msec"),
        _param("session_engaged", "string", "session_engaged", "k % 3 <> 0"),
        _param("session_engaged", "int", "bigint(session_engaged)", "k % 3 = 0"),
        _param("page_location", "string", "page_location"),
        _param("page_location", "string", "'about:blank'", "k % 5 = 0 AND page_location IS NOT NULL"),
        _param("source", "string", "session_source"),
        _param("source", "int", "k", "k % 11 = 0"),
        _param("medium", "string", "session_medium"),
        _param("campaign", "string", "session_campaign"),
    ]
    one = f"array({_item(0, 'value', 'NULL')})"
    return _flat(raw).selectExpr(
        "date_format(event_date, 'yyyyMMdd') AS event_date",
        "unix_micros(timestamp(event_ts)) AS event_timestamp",
        "event_name",
        "user_pseudo_id",
        f"array_compact(array({', '.join(params)})) AS event_params",
        "struct(ft_source AS source, ft_medium AS medium, ft_name AS name) AS traffic_source",
        "struct(device_category AS category, operating_system, struct(browser) AS web_info) AS device",
        "struct(country) AS geo",
        """struct(transaction_id, purchase_revenue_usd AS purchase_revenue_in_usd,
            shipping_usd AS shipping_value_in_usd, tax_usd AS tax_value_in_usd, total_item_quantity) AS ecommerce""",
        f"""CASE WHEN event_name = 'purchase' THEN {_purchase_items()}
            WHEN event_name IN ('view_item', 'page_view') THEN {one}
            WHEN event_name <> 'begin_checkout' THEN slice({one}, 1, 0) END AS items""",
    )


def source(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet")
