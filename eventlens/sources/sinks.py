"""Writing models, flat exports and the results document."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from functools import partial
from typing import TypeVar

from pyspark import inheritable_thread_target
from pyspark.sql import Column, DataFrame, Observation, Row, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from eventlens.functions.stats import double

T = TypeVar("T")

# Step names as a dashboard shows them.
STEP_LABELS = {
    "view_item": "1 Viewed products",
    "begin_checkout": "2 Checkout",
    "add_payment_info": "3 Payment",
    "purchase": "4 Purchase",
}


def materialise(df: DataFrame, path: str, *by: str) -> DataFrame:
    """Write a model as a Parquet table, in folders ``by`` columns if any, and continue from what was written.

    Cuts the lineage in shared storage, so a lost executor repeats a read and not the
    build, and models that several others use are computed once.
    """
    df.write.mode("overwrite").partitionBy(*by).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def materialise_observed(df: DataFrame, path: str, violations: Mapping[str, Column], *by: str) -> tuple[DataFrame, dict[str, int]]:
    """``materialise``, with the number of rows on which each of ``violations`` is true, counted while the rows are written."""
    if not violations:
        return materialise(df, path, *by), {}
    seen = Observation()
    counted = [F.count_if(F.coalesce(v, F.lit(False))).alias(name) for name, v in violations.items()]
    written = materialise(df.observe(seen, *counted), path, *by)
    # A write without any row may leave nothing to observe.
    return written, {name: int(seen.get.get(name) or 0) for name in violations}


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder, through the file system that Spark uses for it. A missing one is no error."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop, True)


RUNS, LOG = "runs", "published"


def publish(spark: SparkSession, out: str, run: str) -> int:
    """Append ``run`` to the log of published runs and return its number. Nothing is overwritten: a file of its own is
    committed, and whoever reads meanwhile sees the log with it or without it."""
    number = 1 + max((r["number"] for r in published_runs(spark, out)), default=0)
    row = spark.createDataFrame([(number, run)], "number bigint, run string")
    row.coalesce(1).write.mode("append").json(f"{out}/{LOG}")
    return number


def published_runs(spark: SparkSession, out: str) -> list[Row]:
    """(number, run) of all published runs, the oldest first: one short row for each build."""
    try:
        log = spark.read.schema("number bigint, run string").json(f"{out}/{LOG}")
    except AnalysisException as problem:
        if problem.getCondition() != "PATH_NOT_FOUND":
            raise
        return []
    return log.filter("number IS NOT NULL").orderBy("number", "run").collect()


def remove_old_runs(spark: SparkSession, out: str, keep: int) -> list[str]:
    """Delete the files of published runs but the newest ``keep`` (at least one); their log entries stay. Returns what went."""
    old = [r["run"] for r in published_runs(spark, out)][: -max(1, keep)]
    for run in old:
        remove(spark, run)
    return old


# The keys each model is read in.
MODEL_ORDER = {
    "funnel_segments": ("segment_type", "segment"),
    "weekly_metrics": ("week_start",),
    "cohort_retention": ("cohort_week", "week_offset"),
    "user_windows": ("user_pseudo_id",),
    "area_funnel": ("entry_area",),
}


def ordered(model: DataFrame, name: str) -> DataFrame:
    """A model in its stated order, for output. No job here depends on row order."""
    return model.orderBy(*MODEL_ORDER[name])


def ordered_load(model: DataFrame, name: str, path: str) -> DataFrame:
    """A model written in its stated order, file after file, with ``position``: the place of each row in that order, from 1.

    The sort deals ranges of keys to tasks. A row's number in its task and the task's number are kept while the rows are written;
    the rows of the tasks before it, one number for each task, make the position. No row goes through one task for it.
    """
    placed = materialise(ordered(model, name).withColumn("_at", F.monotonically_increasing_id()), path)
    # An id is the task's number times 2^33 and the row's number in it.
    task = F.shiftright("_at", 33)
    tasks = placed.groupBy(task.alias("_task")).agg(F.count(F.lit(1)).alias("_n"))
    before = tasks.select("_task", (F.sum("_n").over(Window.orderBy("_task")) - F.col("_n")).alias("_before"))
    position = F.col("_before") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)) + 1
    return placed.withColumn("_task", task).join(before, "_task").withColumn("position", position).select(*model.columns, "position")


def export_headline(summary: DataFrame, headline: DataFrame) -> DataFrame:
    h = headline.select(F.struct("*").alias("h")).scalar()
    return summary.withColumn("h", h).select(
        F.col("events"),
        F.col("h.users").alias("users"),
        F.col("h.sessions").alias("sessions"),
        F.col("h.transactions").alias("orders"),
        F.round("h.revenue_usd", 2).alias("revenue_usd"),
        F.col("h.conversion").alias("session_conversion"),
        F.col("h.aov").alias("order_value_usd"),
        F.col("first_day").alias("window_start"),
        F.col("last_day").alias("window_end"),
    )


def export_funnel_by_device(rates: DataFrame) -> DataFrame:
    """Per device and for all; input: ordered rates of all segments."""
    label = F.col("step")
    for step, text in STEP_LABELS.items():
        label = F.when(F.col("step") == step, text).otherwise(label)
    return rates.filter(F.col("segment_type").isin("device", "all")).select(
        F.col("segment").alias("device"),
        label.alias("step"),
        "step_order",
        "sessions",
        F.col("step_rate").alias("rate_from_previous"),
        F.col("from_start").alias("rate_from_all_sessions"),
    )


def export_store_sections(opportunity: DataFrame) -> DataFrame:
    return opportunity.select(
        F.col("label").alias("section"),
        "sessions",
        "checkout_rate",
        "ci_low",
        "ci_high",
        F.col("median_rate").alias("typical_section_rate"),
        F.col("finish_rate").alias("checkouts_that_finish"),
        F.col("order_value").alias("order_value_usd"),
        F.col("clearly_below").alias("clearly_below_typical"),
        F.col("broken_checkout").alias("possible_checkout_fault"),
        F.round("extra_orders", 1).alias("extra_orders_if_typical"),
        F.round("extra_revenue_usd", 2).alias("extra_revenue_if_typical"),
    )


def export_weekly_revenue(tree: DataFrame) -> DataFrame:
    return tree.select(
        "week_start",
        F.round("revenue_usd", 2).alias("revenue_usd"),
        "users",
        "sessions_per_user",
        "conversion",
        F.col("aov").alias("order_value_usd"),
        F.col("log_users").alias("change_visitors"),
        F.col("log_sessions_per_user").alias("change_visits_per_visitor"),
        F.col("log_conversion").alias("change_conversion"),
        F.col("log_aov").alias("change_order_size"),
        F.col("log_total").alias("change_total"),
        F.col("pct_change").alias("pct_vs_baseline"),
    )


def export_channels(channels: DataFrame) -> DataFrame:
    return channels.select(
        "channel",
        "sessions",
        F.col("share").alias("share_of_sessions"),
        "engaged_rate",
        "conversion",
        "ci_low",
        "ci_high",
        F.col("revenue_per_session").alias("revenue_per_session_usd"),
        "small_sample",
    )


def export_retention(cohorts: DataFrame) -> DataFrame:
    return cohorts.filter(F.col("week_offset") > 0).select(
        "cohort_week",
        "week_offset",
        "cohort_users",
        "active_users",
        double("retention").alias("retention"),
        double("purchase_retention").alias("purchase_retention"),
    )


# Row order of each export; '-' means descending.
EXPORT_ORDER = {
    "headline": (),
    "funnel_by_device": ("device", "step_order"),
    "store_sections": ("-sessions", "section"),
    "weekly_revenue": ("week_start",),
    "channels": ("-sessions", "channel"),
    "retention": ("cohort_week", "week_offset"),
}


def _sorted(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    if not keys:
        return df
    return df.orderBy(*[F.col(k[1:]).desc() if k.startswith("-") else F.col(k).asc() for k in keys])


def side_by_side(jobs: Mapping[str, Callable[[], T]], at_once: int = 8) -> dict[str, T]:
    """Run independent Spark jobs from several threads, so small ones do not wait for each other."""
    inherit = inheritable_thread_target(SparkSession.active())
    with ThreadPoolExecutor(max_workers=at_once) as pool:
        started = {name: pool.submit(inherit(job)) for name, job in jobs.items()}
        return {name: job.result() for name, job in started.items()}


def write_exports(exports: Mapping[str, DataFrame], out: str) -> None:
    """One CSV with a header per export; each is a few aggregated rows."""

    def write(name: str) -> None:
        rows = _sorted(exports[name], EXPORT_ORDER[name]).coalesce(1)
        rows.write.mode("overwrite").option("header", True).csv(f"{out}/{name}")

    side_by_side({name: partial(write, name) for name in exports})


def write_results(blocks: Mapping[str, DataFrame], out: str) -> None:
    """The results document: one JSON part per block, written by Spark, nothing collected."""

    def write(name: str) -> None:
        rows = blocks[name].coalesce(1)
        rows.write.mode("overwrite").option("ignoreNullFields", False).json(f"{out}/{name}")

    side_by_side({name: partial(write, name) for name in blocks})
