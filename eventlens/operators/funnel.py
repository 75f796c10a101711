"""Funnel progress per session, ordered and open."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Whole seconds since 1970 from calendar fields, so that no time zone takes part.
SECOND = "unix_date(to_date(event_ts)) * 86400L + hour(event_ts) * 3600 + minute(event_ts) * 60 + int(second(event_ts))"


def funnel_events(hits: DataFrame, steps: Sequence[str], keys: Sequence[str] = ("session_key",)) -> DataFrame:
    """Only the rows and columns a funnel needs: (keys, step number, event_ts)."""
    names = ", ".join(f"'{s}'" for s in steps)
    return hits.filter(f"event_name IN ({names})").selectExpr(
        *keys, f"array_position(array({names}), event_name) - 1 AS step", "event_ts"
    )


def session_funnel(hits: DataFrame, steps: Sequence[str]) -> DataFrame:
    """One row per session with a funnel event.

    ``any_<step>``: the step happened. ``reached_<step>``: it happened at or after
    the previous step was first reached (equal times count).

    The ordered funnel is a walk: a session at depth i moves to i+1 on the first
    event of step i, taken in (time, step) order. Walks over consecutive stretches
    of time compose, so a session is cut into seconds, each reduced to "entering at
    depth s you leave at depth t" for every s, then seconds are composed into hours
    and hours into the session. No group ever holds more than a second's distinct
    events (at most one million time stamps per step), an hour's 3,600 seconds or
    the hours of the data, so one session with a third of all rows is spread over
    its seconds. One narrow scan, and any number of steps, without self-joins.

    Copies of a row change nothing here, so ``placeable_hits`` is the input to use.
    """
    return funnel_moves(hits, steps, ["session_key"]).selectExpr(
        "session_key",
        *[f"int(getbit(seen, {i})) AS any_{step}" for i, step in enumerate(steps)],
        *[f"int(move[0] > {i}) AS reached_{step}" for i, step in enumerate(steps)],
    )


def funnel_moves(hits: DataFrame, steps: Sequence[str], keys: Sequence[str]) -> DataFrame:
    """By ``keys``: ``move`` (entering at depth s you leave at depth ``move[s]``), ``seen`` (a bit for each step), and the
    first and last second that a step was taken in (NULL without any time)."""
    k = len(steps)

    def move(walk) -> str:
        return f"array({', '.join(walk(s) for s in range(k))}) AS move"

    def within_second(start: int) -> str:
        return f"aggregate(hits, {start}, (depth, e) -> IF(e.step = depth, depth + 1, depth))"

    def across(start: int) -> str:
        return f"aggregate(parts, {start}, (depth, p) -> IF(depth < {k}, p.move[depth], depth))"

    in_order = "array_sort(collect_list(struct(at, move))) AS parts"
    merged = ("bit_or(seen) AS seen", "min(from_second) AS from_second", "max(to_second) AS to_second")
    kept = ("seen", "from_second", "to_second")
    seconds = _grouped(
        funnel_events(hits, steps, keys).selectExpr("*", f"{SECOND} AS at"),
        [*keys, "at"],
        "array_sort(collect_set(IF(event_ts IS NULL, NULL, struct(event_ts, step)))) AS hits",
        "bit_or(shiftleft(1, int(step))) AS seen",
    ).selectExpr(*keys, "at div 3600 AS hour", "at", move(within_second), "seen", "at AS from_second", "at AS to_second")
    hours = _grouped(seconds, [*keys, "hour"], in_order, *merged).selectExpr(*keys, "hour AS at", move(across), *kept)
    return _grouped(hours, keys, in_order, *merged).selectExpr(*keys, move(across), *kept)


def _grouped(df: DataFrame, keys: Sequence[str], *aggregates: str) -> DataFrame:
    return df.groupBy(*keys).agg(*[F.expr(a) for a in aggregates])
