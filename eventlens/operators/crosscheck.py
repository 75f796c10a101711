"""A second, independent computation of the headline counts, and its comparison.

It starts from raw rows and chains one join per funnel step; it shares no logic
with the session models, only the definitions.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventlens.schema import MONEY

COLUMNS = ("user_pseudo_id", "ga_session_id", "event_name", "event_ts", "transaction_id", "purchase_revenue_usd")
REVENUE_TOLERANCE = 0.01


# Hours since 1970 from calendar fields; grows with time, which is all the chain needs.
HOUR = "datediff({0}, DATE'1970-01-01') * 24 + hour({0})"


def first_step(rows: DataFrame, steps: Sequence[str]) -> DataFrame:
    """One row per session (k): the first step's first time ``t`` (NULL if none), how many steps it has
    ``reached``, and the ``hours`` in which it has any later step."""
    later = F.when(F.col("event_name").isin(*steps[1:]), F.expr(HOUR.format("event_ts")))
    first = F.min(F.when(F.col("event_name") == steps[0], F.col("event_ts"))).alias("t")
    sessions = rows.groupBy("k").agg(first, F.collect_set(later).alias("hours"))
    return sessions.select("k", "t", F.col("t").isNotNull().cast("int").alias("reached"), "hours")


def next_step(events: DataFrame, chain: DataFrame) -> DataFrame:
    """The chain one step on: ``t`` becomes the first of ``events`` (k, event_ts) at or after it, else NULL.

    A session is matched on (session, hour), for those of its hours that have events and are not before ``t``: a session
    with much of the table is spread over its hours, and a clock that is wrong by decades adds no rows. Minima
    combine before the shuffle by session.
    """
    ahead = F.filter("hours", lambda h: h >= F.expr(HOUR.format("t")))
    asked = chain.select("k", "t", "reached", "hours", F.explode_outer(ahead).alias("hour"))
    found = asked.join(events.withColumn("hour", F.expr(HOUR.format("event_ts"))), ["k", "hour"], "left")
    after = F.min(F.when(F.col("event_ts") >= F.col("t"), F.col("event_ts")))
    by = found.groupBy("k").agg(after.alias("t"), F.max("reached").alias("_before"), F.max("hours").alias("hours"))
    return by.select("k", "t", (F.col("_before") + F.col("t").isNotNull().cast("int")).alias("reached"), "hours")


def recompute(events: DataFrame, steps: Sequence[str]) -> DataFrame:
    """(metric, value) rows: sessions, reached_<step>, purchases, revenue_usd.

    One scan opens the chain, each further step is one scan and one join, and all counts are one aggregate at its end.
    """
    rows = (
        events.select(*COLUMNS)
        .filter(F.col("user_pseudo_id").isNotNull() & F.col("ga_session_id").isNotNull())
        .withColumn("k", F.format_string("%s:%d", "user_pseudo_id", "ga_session_id"))
    )
    chain = first_step(rows, steps)
    for step in steps[1:]:
        chain = next_step(rows.filter(F.col("event_name") == step).select("k", "event_ts"), chain)
    counts = chain.agg(
        F.count(F.lit(1)).cast("double").alias("sessions"),
        *[F.count_if(F.col("reached") > i).cast("double").alias(f"reached_{s}") for i, s in enumerate(steps)],
    )
    orders = (
        rows.filter(F.col("event_name") == "purchase")
        .select("k", "transaction_id", "purchase_revenue_usd")
        .distinct()
        .agg(
            F.count(F.lit(1)).cast("double").alias("purchases"),
            F.round(F.coalesce(F.sum(F.col("purchase_revenue_usd").cast(MONEY)), F.lit(0)).cast("double"), 2).alias("revenue_usd"),
        )
    )
    return _as_rows(counts).unionByName(_as_rows(orders))


def _as_rows(one: DataFrame) -> DataFrame:
    pairs = [F.struct(F.lit(c).alias("metric"), F.col(c).alias("value")) for c in one.columns]
    return one.select(F.inline(F.array(*pairs)))


def model_totals(segments: DataFrame, steps: Sequence[str]) -> DataFrame:
    """The same metrics as the models have them."""
    everyone = segments.filter((F.col("segment_type") == "all") & (F.col("segment") == "all"))
    names = ["sessions", *[f"reached_{s}" for s in steps], "purchases", "revenue_usd"]
    values = [F.round(F.col(c).cast("double"), 2) for c in names]
    pairs = F.array(*[F.struct(F.lit(c).alias("metric"), v.alias("value")) for c, v in zip(names, values)])
    return everyone.select(F.explode(pairs).alias("m")).select("m.*")


def differences(independent: DataFrame, models: DataFrame) -> DataFrame:
    """Metrics on which the two disagree: exact for counts, one cent for money. Empty means agreement."""
    a = independent.withColumnRenamed("value", "independent")
    b = models.withColumnRenamed("value", "models")
    gap = F.abs(F.col("independent") - F.col("models"))
    allowed = F.when(F.col("metric") == "revenue_usd", REVENUE_TOLERANCE + 1e-9).otherwise(0.0)
    return a.join(b, "metric", "full").filter(
        F.col("independent").isNull() | F.col("models").isNull() | (gap > allowed)
    )
