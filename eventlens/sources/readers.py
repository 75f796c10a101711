"""Flat tables from Parquet: plain ones, or what an ingest has published day by day."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from pyspark.sql.utils import AnalysisException

from eventlens.schema import EVENTS, ITEMS, conform


#: The table of ingested days: each with the run that holds it, its source and its rows.
DAYS = "ingested_days"
DAY_TABLE = "event_date date, run string, source string, event_rows bigint, item_rows bigint"


def day_table(spark: SparkSession, root: str) -> DataFrame | None:
    """The newest row of each ingested day, or None for a table that no ingest has written."""
    try:
        table = spark.read.parquet(f"{root.rstrip('/')}/{DAYS}")
    except AnalysisException as problem:
        if problem.getCondition() != "PATH_NOT_FOUND":
            raise
        return None
    names = ("run", "source", "event_rows", "item_rows")
    newest = table.groupBy("event_date").agg(F.max_by(F.struct(*names), F.struct("ingested_at", "run")).alias("r"))
    return newest.select("event_date", *[f"r.{c}" for c in names])


def read_table(spark: SparkSession, root: str, name: str, schema: StructType) -> DataFrame:
    """All Parquet files of ``<root>/<name>``, conformed. Pruning and pushdown reach the scan.

    Of an ingested table only the days and runs that ``day_table`` names: literals on partition columns, so that
    Spark opens these folders and no others.
    """
    stored = spark.read.parquet(f"{root.rstrip('/')}/{name}")
    days = day_table(spark, root)
    if days is None:
        return conform(stored, schema)
    by_run: dict[str, list[date]] = {}
    for r in days.select("run", "event_date").collect():  # a row per day of the calendar
        by_run.setdefault(r["run"], []).append(r["event_date"])
    named = F.lit(False)
    for run, held in sorted(by_run.items()):
        named = named | ((F.col("run") == run) & F.col("event_date").isin(*held))
    return conform(stored.filter(named), schema)


def read_events(spark: SparkSession, root: str) -> DataFrame:
    return read_table(spark, root, "events", EVENTS)


def read_items(spark: SparkSession, root: str) -> DataFrame:
    return read_table(spark, root, "items", ITEMS)


def narrow(events: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Only some columns; the Parquet reader then opens no others."""
    return events.select(*columns)


def one_day(events: DataFrame, day: date) -> DataFrame:
    """One day's rows. On a table partitioned by ``event_date`` no other directory is opened."""
    return events.filter(F.col("event_date") == F.lit(day))
