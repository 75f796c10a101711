"""Earliest values by key without sorting the rows they come from."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventlens.functions.events import first_value


def first_touch(
    rows: DataFrame,
    keys: Sequence[str],
    values: Sequence[str],
    at: str,
    merged: Mapping[str, tuple[Column, Callable[[str], Column]]] | None = None,
) -> DataFrame:
    """By ``keys``: the earliest non-NULL of each of ``values`` (equal times go to the smallest), and what ``merged`` names.

    ``min(struct(time, text))`` has a buffer of no fixed width, for which Spark sorts every row. So rows are first reduced
    to the combinations of values that a key has, each with its earliest time: keys may be texts, buffers are numbers, and a hash
    aggregate does it, combining before the shuffle. Of a key's few combinations the earliest values are then picked; the
    earliest time of a value is that of its earliest combination, so nothing is lost.

    ``merged``: name to (aggregate over rows, how its partial results combine), say ``(F.max("n"), F.max)``.
    """
    merged = merged or {}
    combinations = rows.groupBy(*keys, *values).agg(F.min(at).alias("_at"), *[part.alias(name) for name, (part, _) in merged.items()])
    return combinations.groupBy(*keys).agg(
        F.min("_at").alias(at),
        *[first_value(F.col(c), F.col("_at")).alias(c) for c in values],
        *[again(name).alias(name) for name, (_, again) in merged.items()],
    )
