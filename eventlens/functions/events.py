"""Scalar rules and per-group pickers over event columns. Everything here returns a ``Column``."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from eventlens.schema import PLACEHOLDERS

# Source and medium words, channel names, section labels, URL shape.
HIDDEN = ("<Other>", "(data deleted)")
DIRECT_SOURCE = "(direct)"
DIRECT_MEDIUM = ("(none)", "(not set)")
PAID_MEDIUM = ("cpc", "ppc", "paid")
CHANNELS = (
    "Direct",
    "Organic Search",
    "Paid Search",
    "Referral",
    "Email",
    "Obfuscated",
    "Other",
    "Unknown",
)
UNNAMED_CHANNELS = ("Unknown", "Obfuscated", "Other")
SECTION_LABELS = {"store.html": "Store home page", "asearch.html": "Search results"}
URL_PATH = r"^https?://[^/]+(/[^?#]*)"
SECTION_PREFIX = "/Google+Redesign/"
NOT_SET = "(not set)"


def session_key(user: Column | str = "user_pseudo_id", session: Column | str = "ga_session_id") -> Column:
    """A session id is unique only within its user; NULL if either part is."""
    user, session = (F.col(c) if isinstance(c, str) else c for c in (user, session))
    return F.concat(user, F.lit(":"), session.cast("string"))


def is_placeholder(c: Column) -> Column:
    return c.isNull() | c.isin(*PLACEHOLDERS)


def has_no_transaction_id(c: Column) -> Column:
    return c.isNull() | (c == NOT_SET)


def channel_group(source: Column, medium: Column) -> Column:
    """Source and medium to a channel; the first rule that holds wins, NULL comparisons do not hold."""
    rules = [
        (source.isNull() & medium.isNull(), "Unknown"),
        (source.isin(*HIDDEN) | medium.isin(*HIDDEN), "Obfuscated"),
        ((source == DIRECT_SOURCE) | medium.isin(*DIRECT_MEDIUM), "Direct"),
        (medium == "organic", "Organic Search"),
        (medium.isin(*PAID_MEDIUM), "Paid Search"),
        (medium == "referral", "Referral"),
        (medium == "email", "Email"),
    ]
    out = F.when(rules[0][0], rules[0][1])
    for condition, name in rules[1:]:
        out = out.when(condition, name)
    return out.otherwise("Other")


def session_channel(
    source: Column, medium: Column, ft_source: Column, ft_medium: Column, session_number: Column
) -> Column:
    """The session's own channel; first touch stands in only on the user's first session."""
    return (
        F.when(source.isNotNull() | medium.isNotNull(), channel_group(source, medium))
        .when(session_number == 1, channel_group(ft_source, ft_medium))
        .otherwise("Unknown")
    )


def url_path(url: Column) -> Column:
    """Path part of a URL; '' where it has none, NULL for NULL."""
    return F.regexp_extract(url, URL_PATH, 1)


def path_section(path: Column) -> Column:
    """Store section of a path: the segment after the site prefix, else the first segment."""
    segment = F.when(path.startswith(SECTION_PREFIX), 3).otherwise(2)
    section = F.split_part(path, F.lit("/"), segment)
    return F.coalesce(F.nullif(section, F.lit("")), F.lit("Unknown"))


def section_label(section: Column) -> Column:
    """Readable section name: 'Shop+by+Brand' becomes 'Shop by Brand'."""
    text = F.trim(F.replace(section, F.lit("+"), F.lit(" ")))
    plain = F.concat(F.upper(F.substring(text, 1, 1)), F.substring(text, 2, 2_147_483_647))
    out = plain
    for raw, label in SECTION_LABELS.items():
        out = F.when(section == raw, label).otherwise(out)
    return F.coalesce(F.nullif(out, F.lit("")), F.lit("Unknown"))


def week_start(day: Column) -> Column:
    """Monday of the ISO week. ``trunc`` on a date keeps the result zone-free."""
    return F.trunc(day, "week")


def user_type(is_first_session: Column) -> Column:
    """An unknown session number counts as returning."""
    return F.when(is_first_session, "new").otherwise("returning")


def segment_name(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit("(null)"))


def days_observed(week: Column, first_day: Column, last_day: Column) -> Column:
    """How many days of a week lie inside the observed range."""
    return F.datediff(F.least(F.date_add(week, 6), last_day), F.greatest(week, first_day)) + 1


def first_value(value: Column, at: Column) -> Column:
    """Aggregate: the earliest non-NULL value; equal times go to the smallest value.

    ``min`` over (time, value) merges partial results, so a hot key is reduced
    before its rows are shuffled.
    """
    dated = F.when(value.isNotNull() & at.isNotNull(), F.struct(at.alias("at"), value.alias("value")))
    return F.min(dated)["value"]


def first_row_value(value: Column, *order: Column) -> Column:
    """Aggregate: ``value`` of the first row by ``order``, NULL values kept, NULL keys last."""
    return first_row_value_key(value, *order)["value"]


def first_row_value_key(value: Column, *order: Column) -> Column:
    """The same with the order it was found by, so that results of parts merge by ``min``; its ``value`` is what is asked for."""
    keys = []
    for i, key in enumerate(order):
        keys += [key.isNull().alias(f"n{i}"), key.alias(f"k{i}")]
    return F.min(F.struct(*keys, value.alias("value")))


def count_if(condition: Column) -> Column:
    return F.count_if(F.coalesce(condition, F.lit(False)))


def sum_if(value: Column, condition: Column) -> Column:
    """Conditional sum, zero where nothing qualifies."""
    return F.coalesce(F.sum(F.when(condition, value)), F.lit(0))


def micros(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp"))
