"""A resumable daily ingest, gated by what it has written, with a manifest of one row per day.

Each batch of days is written to folders of its own (``events/run=<id>``, ``items/run=<id>``). What the files hold is counted
from their gated columns alone: rows and NULLs, by day. Only then are days named in ``ingested_days``, an append-only table of
one row per day, which is mark and manifest at once; readers see the days that it names, in the run that it names. So
the source is parsed once for each table, a run cut short or refused leaves nothing that a reader would see, and day n costs
what day n holds.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from datetime import date
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eventlens.sources import readers, sinks
from eventlens.sources.nested import flatten_events, flatten_items

# Largest tolerated share of NULLs per column.
NULL_LIMITS = {
    "event_ts": 0.0,
    "event_name": 0.0,
    "user_pseudo_id": 0.01,
    "ga_session_id": 0.20,
    "ga_session_number": 0.20,
}


class GateFailed(RuntimeError):
    """A column the models depend on came back mostly NULL."""


def null_profile(events: DataFrame, limits: Mapping[str, float] = NULL_LIMITS) -> DataFrame:
    """(column_name, null_share, null_limit, over_limit) for every column, from one aggregate.

    Reading a parameter from the wrong slot gives NULL, not an error, so this gate is
    what catches a wrong flattening.
    """
    shares = events.agg(
        *[F.coalesce(F.avg(F.col(c).isNull().cast("double")), F.lit(0.0)).alias(c) for c in events.columns]
    )
    rows = F.array(
        *[
            F.struct(
                F.lit(c).alias("column_name"),
                F.col(c).alias("null_share"),
                F.lit(limits.get(c)).cast("double").alias("null_limit"),
            )
            for c in events.columns
        ]
    )
    return (
        shares.select(F.explode(rows).alias("r"))
        .select("r.*")
        .withColumn("over_limit", F.coalesce(F.col("null_share") > F.col("null_limit"), F.lit(False)))
    )


def require_populated(events: DataFrame, limits: Mapping[str, float] = NULL_LIMITS) -> None:
    failed = [r["column_name"] for r in null_profile(events, limits).filter("over_limit").collect()]
    if failed:
        raise GateFailed(f"mostly NULL: {sorted(failed)}")


def event_histogram(events: DataFrame, steps: Sequence[str]) -> DataFrame:
    """Rows per event name, funnel steps marked."""
    return (
        events.groupBy("event_name")
        .agg(F.count(F.lit(1)).alias("rows"))
        .withColumn("is_step", F.coalesce(F.col("event_name").isin(*steps), F.lit(False)))
        .orderBy(F.col("rows").desc(), F.col("event_name"))
    )


def absent_steps(events: DataFrame, steps: Sequence[str]) -> DataFrame:
    """Funnel steps no event has: one flag per step from one scan, no join."""
    seen = events.agg(
        *[F.coalesce(F.bool_or(F.col("event_name") == s), F.lit(False)).alias(f"s{i}") for i, s in enumerate(steps)]
    )
    rows = F.array(*[F.when(~F.col(f"s{i}"), F.lit(s)) for i, s in enumerate(steps)])
    return seen.select(F.explode(F.array_compact(rows)).alias("step"))


def finished_days(spark: SparkSession, out: str) -> list[date]:
    """Days that are marked as ingested: a list as long as the calendar. Only a missing table means none."""
    table = readers.day_table(spark, out)
    return [] if table is None else sorted(r["event_date"] for r in table.select("event_date").distinct().collect())


def pending_days(nested: DataFrame, done: Sequence[date], days: Sequence[date] | None = None) -> list[str]:
    """Raw day keys (yyyymmdd) of ``nested`` that are not in ``done``, and among ``days`` if given.

    Of a source that is partitioned by day this reads directory names only.
    """
    skip = {f"{d:%Y%m%d}" for d in done}
    keys = {str(r["event_date"]) for r in nested.select("event_date").distinct().collect() if r["event_date"] is not None}
    wanted = keys if days is None else keys & {f"{d:%Y%m%d}" for d in days}
    return sorted(wanted - skip)


def rows_of_days(nested: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of these days, by literals on the raw column: a partitioned source opens these directories only."""
    kind = nested.schema["event_date"].dataType
    return nested.filter(F.col("event_date").isin(*[F.lit(k).cast(kind) for k in keys]))


#: Days of a batch.
DAYS_AT_ONCE = 7
#: A gated column that is NULL on more than this share of one day's rows holds that day back.
MOSTLY = 0.5


def day_counts(flat: DataFrame, days: Sequence[date], columns: Sequence[str] = ()) -> dict[str, int]:
    """Rows of each day (by its place), and NULLs of each column and day: a row per day from the scan, whatever the rows.

    An observation while ``flat`` is written would take a condition for each column and day, all of them on every row.
    """
    nulls = [F.count_if(F.col(c).isNull()).alias(f"null_{c}") for c in columns]
    by_day = flat.filter(F.col("event_date").isin(*days)).groupBy("event_date").agg(F.count(F.lit(1)).alias("rows"), *nulls)
    found = {r["event_date"]: r for r in by_day.collect()}
    counts = {}
    for k, d in enumerate(days):
        counts[f"rows_{k}"] = found[d]["rows"] if d in found else 0
        counts |= {f"null_{k}_{c}": found[d][f"null_{c}"] if d in found else 0 for c in columns}
    return counts


def refused(counts: Mapping[str, int], n_days: int, limits: Mapping[str, float]) -> dict[int, list[str]]:
    """Columns that hold back each day (by its place): over the limit in the whole batch, or mostly NULL on the day."""
    rows = [counts[f"rows_{k}"] for k in range(n_days)]
    out: dict[int, list[str]] = {}
    for c, limit in limits.items():
        null = [counts[f"null_{k}_{c}"] for k in range(n_days)]
        everywhere = sum(null) > limit * sum(rows)
        for k in range(n_days):
            if everywhere or null[k] > max(limit, MOSTLY) * rows[k]:
                out.setdefault(k, []).append(c)
    return out


def ingest(
    nested: DataFrame,
    out: str,
    days: Sequence[date] | None = None,
    source: str = "export",
    limits: Mapping[str, float] = NULL_LIMITS,
    at_once: int = DAYS_AT_ONCE,
) -> DataFrame:
    """Flatten the days that are missing under ``out``, write them and mark them. Returns the days that are marked now.

    The days are listed once, before anything is read, and writes, gate and marks are about exactly these; rows that the
    source gains meanwhile for other days wait for the next run. Days go in batches of ``at_once``. If a column is over its
    limit in a batch, none of its days is marked; if it is mostly NULL on some days, these are not. What was written of refused
    days is in no reader's way; a batch without any good day is removed. The first batch with refused days is the last one, and
    the error names them.
    """
    spark = nested.sparkSession
    keys = pending_days(nested, finished_days(spark, out), days)
    marked: list[date] = []
    for at in range(0, len(keys), at_once):
        batch = keys[at : at + at_once]
        listed = [date(int(k[:4]), int(k[4:6]), int(k[6:])) for k in batch]
        run, todo, seen = uuid4().hex, rows_of_days(nested, batch), {}
        for name, flat, columns in (("items", flatten_items(todo), ()), ("events", flatten_events(todo), tuple(limits))):
            # Rebalancing needs no sample of the rows: it splits large days and joins small ones when sizes are known.
            flat.hint("rebalance", "event_date").write.partitionBy("event_date").parquet(f"{out}/{name}/run={run}")
            written = spark.read.schema(flat.schema).parquet(f"{out}/{name}/run={run}")
            seen[name] = day_counts(written, listed, columns)
        counts, item_counts = seen["events"], seen["items"]
        bad = refused(counts, len(listed), limits)
        good = [(d, run, source, counts[f"rows_{k}"], item_counts[f"rows_{k}"]) for k, d in enumerate(listed) if k not in bad]
        if good:
            rows = spark.createDataFrame(good, readers.DAY_TABLE).withColumn("ingested_at", F.current_timestamp())
            rows.coalesce(1).write.mode("append").parquet(f"{out}/{readers.DAYS}")
            marked += [g[0] for g in good]
        else:
            for name in ("events", "items"):
                sinks.remove(spark, f"{out}/{name}/run={run}")
        if bad:
            named = sorted({c for columns in bad.values() for c in columns})
            raise GateFailed(f"mostly NULL: {named} on {sorted(str(listed[k]) for k in bad)}")
    return spark.createDataFrame([(d,) for d in marked], "event_date date")


def stored_manifest(spark: SparkSession, out: str) -> DataFrame:
    """One row by source: days with events, and rows of both tables, from the rows by day and nothing else."""
    named = readers.day_table(spark, out)
    if named is None:
        return spark.createDataFrame([], "source string, days bigint, event_rows bigint, item_rows bigint")
    return named.groupBy("source").agg(
        F.count_if(F.col("event_rows") > 0).alias("days"), F.sum("event_rows").alias("event_rows"), F.sum("item_rows").alias("item_rows")
    )


def manifest(events: DataFrame, items: DataFrame, source: str) -> DataFrame:
    """One row: source, days with events, rows of both tables. Counts by day first, then in total."""
    per_day = (
        events.groupBy("event_date").agg(F.count(F.lit(1)).alias("events"), F.lit(0).cast("bigint").alias("items"))
    ).unionByName(
        items.groupBy("event_date").agg(F.lit(0).cast("bigint").alias("events"), F.count(F.lit(1)).alias("items"))
    )
    return per_day.agg(
        F.countDistinct(F.when(F.col("events") > 0, F.col("event_date"))).alias("days"),
        F.coalesce(F.sum("events"), F.lit(0)).alias("event_rows"),
        F.coalesce(F.sum("items"), F.lit(0)).alias("item_rows"),
    ).select(F.lit(source).alias("source"), "days", "event_rows", "item_rows")


def write_manifest(events: DataFrame, items: DataFrame, source: str, path: str) -> None:
    row = manifest(events, items, source).withColumn("ingested_at", F.current_timestamp())
    row.coalesce(1).write.mode("overwrite").json(path)


class WrongSource(RuntimeError):
    """The manifest does not name the source the caller expects."""


def require_source(spark: SparkSession, root: str, source: str) -> None:
    """Refuse to build on tables whose manifest, by day or of a whole table, names another source."""
    told = stored_manifest(spark, root) if readers.day_table(spark, root) is not None else spark.read.json(f"{root}/manifest")
    found = sorted(r["source"] for r in told.select("source").distinct().limit(2).collect())
    if found != [source]:
        raise WrongSource(f"expected source {source!r}, manifest says {found}")
