"""Tiny hand-made frames."""

from __future__ import annotations

from datetime import date, datetime, timedelta

from eventlens.schema import EVENTS, ITEMS

T0 = datetime(2024, 1, 1, 12, 0, 0)


def hit(name="page_view", at=0, user="u", session=1, number=1, **other) -> dict:
    """One event ``at`` seconds after T0 (or at a datetime)."""
    ts = at if isinstance(at, datetime) or at is None else T0 + timedelta(seconds=at)
    row = dict.fromkeys(EVENTS.names)
    row.update(
        event_date=ts.date() if ts else date(2024, 1, 1),
        event_ts=ts,
        event_name=name,
        user_pseudo_id=user,
        ga_session_id=session,
        ga_session_number=number,
    )
    unknown = set(other) - set(row)
    assert not unknown, unknown
    row.update(other)
    return row


def events(spark, *rows):
    return spark.createDataFrame([tuple(r[c] for c in EVENTS.names) for r in rows], EVENTS)


def line(at=0, user="u", revenue=1.0, name="purchase") -> dict:
    ts = T0 + timedelta(seconds=at)
    row = dict.fromkeys(ITEMS.names)
    row.update(event_date=ts.date(), event_ts=ts, event_name=name, user_pseudo_id=user, item_revenue_usd=revenue)
    return row


def items(spark, *rows):
    return spark.createDataFrame([tuple(r[c] for c in ITEMS.names) for r in rows], ITEMS)


def rows(df, *keys) -> dict:
    """Rows by key (a value, or a tuple of several)."""
    out = {}
    for r in df.collect():
        k = tuple(r[c] for c in keys)
        assert k not in out, f"repeated {k}"
        out[k[0] if len(k) == 1 else k] = r
    return out
