"""Answers from the models: rates, gaps, opportunities, decompositions.

All input frames here are aggregates (segments, weeks, cohorts, sections).
Values one row needs from all rows come from a window over a calendar-sized table
or from a scalar subquery, so no frame is cross-joined and no value is collected
on the driver while a plan is being built.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from eventlens.config import Config
from eventlens.functions.events import UNNAMED_CHANNELS, section_label
from eventlens.functions.stats import (
    double,
    nan,
    pooled_z,
    quantile,
    ratio,
    two_sided_p,
    wilson,
    with_wilson,
)
from eventlens.operators.weekly import whole_table

COMPONENTS = ("users", "sessions_per_user", "conversion", "aov")


# ---- segments ------------------------------------------------------------------


def one_segment(segments: DataFrame, segment_type: str, segment: str) -> DataFrame:
    """The row of one segment; running the plan fails if there is none."""
    found = segments.filter((F.col("segment_type") == segment_type) & (F.col("segment") == segment))
    row = F.max(F.struct(*segments.columns))
    missing = F.raise_error(F.lit(f"no {segment_type}={segment} segment"))
    return found.agg(row.alias("row")).select(
        F.when(F.col("row").isNull(), missing.cast(found.schema)).otherwise(F.col("row")).alias("row")
    ).select("row.*")


def headline(segments: DataFrame, segment_type: str = "all", segment: str = "all") -> DataFrame:
    return one_segment(segments, segment_type, segment).select(
        "sessions",
        "users",
        F.col("purchases").alias("transactions"),
        double("revenue_usd").alias("revenue_usd"),
        ratio("purchases", "sessions").alias("conversion"),
        ratio("revenue_usd", "purchases").alias("aov"),
    )


def step_counts(segments: DataFrame, steps: Sequence[str], kind: str = "reached") -> DataFrame:
    """Segments unpivoted to one row per step: ``k`` sessions of the ``n`` at the step before."""
    before = ["sessions", *[f"{kind}_{s}" for s in steps[:-1]]]
    rows = F.array(
        *[
            F.struct(
                F.lit(i + 1).alias("step_order"),
                F.lit(step).alias("step"),
                F.col(f"{kind}_{step}").alias("k"),
                F.col(previous).alias("n"),
            )
            for i, (step, previous) in enumerate(zip(steps, before))
        ]
    )
    return segments.withColumn("at", F.explode(rows)).select(*segments.columns, "at.*")


def funnel_rates(segments: DataFrame, steps: Sequence[str], kind: str = "reached") -> DataFrame:
    """Per segment and step: rate from the step before with its interval, and from all sessions.

    ``kind``: 'reached' for the ordered funnel, 'any' for the open one.
    """
    rows = step_counts(segments, steps, kind)
    return with_wilson(rows, "k", "n").select(
        "segment_type",
        "segment",
        "step_order",
        "step",
        F.col("k").alias("sessions"),
        F.coalesce(ratio("k", "n"), nan()).alias("step_rate"),
        "ci_low",
        "ci_high",
        (double("k") / double(rows["sessions"])).alias("from_start"),
    )


def segment_gap(
    segments: DataFrame,
    steps: Sequence[str],
    a: str = "mobile",
    b: str = "desktop",
    segment_type: str = "device",
    alpha: float = 0.05,
) -> DataFrame:
    """What it would be worth if segment ``a`` kept sessions at each step as ``b`` does.

    An upper bound: part of a gap is intent. Steps without a base, or that ``a``
    never reaches, are left out. A segment that does not exist fails the job: silence would read as "no gap".
    """
    last = f"reached_{steps[-1]}"
    pair = segments.filter((F.col("segment_type") == segment_type) & F.col("segment").isin(a, b))
    counts = step_counts(pair, steps)

    def of(name: str, column: str) -> Column:
        return F.max(F.when(F.col("segment") == name, F.col(column)))

    sides = counts.groupBy("step_order", "step").agg(
        of(a, "n").alias("n_a"),
        of(a, "k").alias("k_a"),
        of(b, "n").alias("n_b"),
        of(b, "k").alias("k_b"),
        of(a, last).alias("bought_a"),
        of(a, "purchases").alias("orders_a"),
        of(a, "revenue_usd").alias("revenue_a"),
    )
    usable = sides.filter((F.col("n_a") > 0) & (F.col("n_b") > 0) & (F.col("k_a") > 0))
    rates = usable.select(
        "*",
        ratio("k_a", "n_a").alias("rate_a"),
        ratio("k_b", "n_b").alias("rate_b"),
        pooled_z(F.col("k_a"), F.col("n_a"), F.col("k_b"), F.col("n_b")).alias("z"),
    ).withColumn("gap", F.col("rate_b") - F.col("rate_a"))
    extra = double("n_a") * F.greatest(F.col("gap"), F.lit(0.0)) * ratio("bought_a", "k_a")
    value = F.coalesce(ratio("revenue_a", "orders_a"), F.lit(0.0))
    known = pair.agg(*[F.count_if(F.col("segment") == name).alias(side) for side, name in (("a", a), ("b", b))])
    missing = known.filter("a = 0 OR b = 0").select(
        F.raise_error(F.lit(f"{segment_type} has no segment {a!r} or no segment {b!r}")).cast("int").alias("step_order")
    )
    found = rates.select(
        "step_order",
        "step",
        "rate_a",
        "rate_b",
        "gap",
        "z",
        two_sided_p(F.col("z")).alias("p_value"),
        # z above its critical value is p below alpha, decided without the tail.
        ((F.col("z") > quantile(1 - alpha / 2)) & (F.col("gap") > 0)).alias("significant"),
        extra.alias("extra_purchases"),
        (extra * value).alias("extra_revenue_usd"),
    )
    return found.unionByName(missing, allowMissingColumns=True)


def biggest_leak(rates: DataFrame) -> DataFrame:
    """The step that keeps the smallest share, the first step aside: there nothing was started yet."""
    return (
        rates.filter(F.col("step_order") > 1)
        .orderBy(F.col("step_rate").asc(), F.col("step_order").asc())
        .limit(1)
    )


def target_step(gap: DataFrame, rates: DataFrame) -> DataFrame:
    """Where to act: the most valuable significant gap, else the biggest leak for everyone."""
    significant = gap.filter("significant").select(
        F.lit(0).alias("rank"),
        "step",
        F.lit(True).alias("segment_only"),
        F.col("extra_revenue_usd").alias("weight"),
        "step_order",
    )
    leak = biggest_leak(rates).select(
        F.lit(1).alias("rank"), "step", F.lit(False).alias("segment_only"), F.lit(0.0).alias("weight"), "step_order"
    )
    return (
        significant.unionByName(leak)
        .orderBy(F.col("rank").asc(), F.col("weight").desc(), F.col("step_order").asc())
        .limit(1)
        .select("step", "segment_only")
    )


def channels(segments: DataFrame, purchase_step: str = "purchase", small_sample: int = 1_000) -> DataFrame:
    """Per channel: share of sessions, engagement, open conversion with interval, money per session."""
    rows = segments.filter(F.col("segment_type") == "channel")
    total = F.sum("sessions").over(whole_table())  # nine channels at most
    low, high = wilson(F.col(f"any_{purchase_step}"), F.col("sessions"))
    return rows.select(
        F.col("segment").alias("channel"),
        "sessions",
        ratio(F.col("sessions"), total).alias("share"),
        ratio("engaged_sessions", "sessions").alias("engaged_rate"),
        ratio(f"any_{purchase_step}", "sessions").alias("conversion"),
        low.alias("ci_low"),
        high.alias("ci_high"),
        ratio("revenue_usd", "sessions").alias("revenue_per_session"),
        (F.col("sessions") < small_sample).alias("small_sample"),
    )


# ---- sections ------------------------------------------------------------------


def area_benchmark(areas: DataFrame, cfg: Config) -> DataFrame:
    """One row: median checkout rate of the large named sections, and site totals.

    The median is exact: only sections with enough visits take part, and there are
    at most total visits / ``area_min_sessions`` of those.
    """
    large = (F.col("sessions") >= cfg.area_min_sessions) & (section_label(F.col("entry_area")) != "Unknown")
    totals = areas.agg(
        F.count_if(large).alias("large_sections"),
        F.percentile(F.when(large, ratio("checkouts", "sessions")), 0.5).alias("median_rate"),
        F.coalesce(ratio(F.sum("purchase_sessions"), F.sum("checkouts")), F.lit(0.0)).alias("site_finish_rate"),
        F.coalesce(F.sum("sessions"), F.lit(0)).alias("all_sessions"),
        F.coalesce(F.sum(F.when(large, F.col("sessions"))), F.lit(0)).alias("large_sessions"),
    )
    enough = F.col("large_sections") >= cfg.area_min_sections
    return totals.select(
        "large_sections",
        enough.alias("enough"),
        F.when(enough, F.col("median_rate")).alias("median_rate"),
        "site_finish_rate",
        F.when(enough, F.col("all_sessions") - F.col("large_sessions"))
        .otherwise(F.col("all_sessions"))
        .alias("sessions_in_small_sections"),
    )


def area_opportunity(areas: DataFrame, cfg: Config) -> DataFrame:
    """Large sections against the typical one; empty if fewer than ``area_min_sections``.

    Clearly below: the whole interval is under the median. Possibly broken: enough
    checkouts, finishing at under half the site's rate.
    """
    benchmark = area_benchmark(areas, cfg).select(F.struct("*").alias("all")).scalar()
    rows = (
        areas.withColumn("label", section_label(F.col("entry_area")))
        .filter((F.col("sessions") >= cfg.area_min_sessions) & (F.col("label") != "Unknown"))
        .withColumn("benchmark", benchmark)
        .filter("benchmark.enough")
        .withColumn("checkout_rate", ratio("checkouts", "sessions"))
        .withColumn("finish_rate", F.coalesce(ratio("purchase_sessions", "checkouts"), F.lit(0.0)))
        .withColumn("order_value", ratio("revenue_reliable_usd", "purchase_sessions_reliable"))
        .withColumn("median_rate", F.col("benchmark.median_rate"))
    )
    rows = with_wilson(rows, "checkouts", "sessions").withColumn(
        "clearly_below", F.col("ci_high") < F.col("median_rate")
    )
    extra = double("sessions") * (F.col("median_rate") - F.col("checkout_rate")) * F.col("finish_rate")
    return (
        rows.withColumn("extra_orders", F.when(F.col("clearly_below"), extra).otherwise(0.0))
        .withColumn("extra_revenue_usd", F.col("extra_orders") * F.coalesce("order_value", F.lit(0.0)))
        .select(
            "label",
            "sessions",
            "checkout_rate",
            "ci_low",
            "ci_high",
            "median_rate",
            "finish_rate",
            "order_value",
            "clearly_below",
            "extra_orders",
            "extra_revenue_usd",
            (
                (F.col("checkouts") >= cfg.broken_min_checkouts)
                & (F.col("finish_rate") < F.col("benchmark.site_finish_rate") * 0.5)
            ).alias("broken_checkout"),
        )
    )


def area_totals(areas: DataFrame, cfg: Config) -> DataFrame:
    """One row beside ``area_opportunity``: benchmark, summed opportunity, what was left out."""
    gained = area_opportunity(areas, cfg).agg(
        F.coalesce(F.sum("extra_orders"), F.lit(0.0)).alias("orders"),
        F.coalesce(F.sum("extra_revenue_usd"), F.lit(0.0)).alias("revenue"),
    )
    both = gained.select(F.struct("*").alias("all")).scalar()
    return area_benchmark(areas, cfg).withColumn("gained", both).select(
        F.col("median_rate").alias("median"),
        F.col("gained.orders").alias("extra_orders"),
        F.col("gained.revenue").alias("extra_revenue_usd"),
        "site_finish_rate",
        F.lit(cfg.area_min_sessions).alias("min_sessions"),
        "sessions_in_small_sections",
    )


# ---- weeks ---------------------------------------------------------------------


def metric_tree(weekly: DataFrame, holiday_start: date) -> DataFrame:
    """Each comparable week's log change against the weeks before the holidays, by factor.

    The logs of the four factors add up to the log of revenue, so the parts add up
    to the whole. Fails if no full week lies before ``holiday_start``.
    """
    weeks = weekly.filter("is_full_week AND revenue_complete AND transactions > 0")
    base = F.col("week_start") < F.lit(holiday_start)
    out = weeks.withColumn("is_baseline", base)
    for c in COMPONENTS:
        logged = F.log(double(c))
        mean = F.avg(F.when(base, logged)).over(whole_table())
        error = F.raise_error(F.lit("no full week before the holidays to compare with")).cast("double")
        out = out.withColumn(f"log_{c}", logged - F.coalesce(mean, error))
    total = F.col(f"log_{COMPONENTS[0]}")
    for c in COMPONENTS[1:]:
        total = total + F.col(f"log_{c}")
    return out.withColumn("log_total", total).select(
        "week_start",
        "is_baseline",
        double("revenue_usd").alias("revenue_usd"),
        "users",
        "sessions_per_user",
        "conversion",
        "aov",
        *[f"log_{c}" for c in COMPONENTS],
        "log_total",
        F.expm1("log_total").alias("pct_change"),
    )


def peak_week(tree: DataFrame) -> DataFrame:
    """The week with most revenue, its change, and each factor's share of it."""
    best = tree.orderBy(F.col("revenue_usd").desc(), F.col("week_start").asc()).limit(1)
    return best.select(
        F.col("week_start").alias("peak_week"),
        F.col("pct_change").alias("peak_pct_change"),
        *[ratio(f"log_{c}", "log_total").alias(f"share_{c}") for c in COMPONENTS],
    )


# ---- retention -----------------------------------------------------------------


def retention_cells(cohorts: DataFrame) -> DataFrame:
    """Observed cells of the retention table, one row each."""
    return cohorts.select("cohort_week", "cohort_users", "week_offset", "retention")


def retention_matrix(cohorts: DataFrame) -> DataFrame:
    """Cohort by week offset, with a column for every offset in the data. Cells past the data stay NULL.

    Finding the offsets is a pass over a calendar-sized table.
    """
    return cohorts.groupBy("cohort_week", "cohort_users").pivot("week_offset").agg(F.first("retention"))


def unpivoted_matrix(matrix: DataFrame) -> DataFrame:
    """The matrix as rows again, empty cells included."""
    keys = ["cohort_week", "cohort_users"]
    offsets = [c for c in matrix.columns if c not in keys]
    if not offsets:  # no cohort at all
        return matrix.select(*keys, F.lit(0).alias("week_offset"), F.lit(0.0).alias("retention"))
    rows = matrix.unpivot(keys, [F.col(f"`{c}`") for c in offsets], "week_offset", "retention")
    return rows.withColumn("week_offset", F.col("week_offset").cast("int"))


def weighted_retention(cohorts: DataFrame, offsets: Sequence[int]) -> DataFrame:
    """Per offset: active over cohort users summed over cohorts, and how many cohorts."""
    return (
        cohorts.filter(F.col("week_offset").isin(*offsets))
        .groupBy("week_offset")
        .agg(
            ratio(F.sum("active_users"), F.sum("cohort_users")).alias("retention"),
            F.count(F.lit(1)).alias("cohorts"),
        )
    )


# ---- facts for a report ----------------------------------------------------------


def largest_gap(gap: DataFrame) -> DataFrame:
    return gap.agg(F.max(F.abs("gap")).alias("max_gap"))


def quietest_week(tree: DataFrame) -> DataFrame:
    """The lowest week, if below the baseline, and the factor that fell most."""
    parts = F.array_sort(
        F.array(
            *[
                F.struct(F.col(f"log_{c}").alias("change"), F.lit(i).alias("rank"), F.lit(c).alias("name"))
                for i, c in enumerate(COMPONENTS)
            ]
        )
    )
    lowest = tree.orderBy(F.col("log_total").asc(), F.col("week_start").asc()).limit(1)
    return lowest.filter(F.col("log_total") < 0).select(
        "week_start", "pct_change", parts[0]["name"].alias("worst_component")
    )


def growth_drivers(peak: DataFrame) -> DataFrame:
    """What carried the peak week: the largest positive shares, and whether order size moved.

    Two shares between 35% and 65% read as half and half; order size is flat under 10%.
    """
    gains = F.array_sort(
        F.filter(
            F.array(
                *[
                    F.struct((-F.col(f"share_{c}")).alias("order"), F.lit(i).alias("rank"), F.lit(c).alias("name"))
                    for i, c in enumerate(COMPONENTS)
                ]
            ),
            lambda g: g["order"] < 0,
        )
    )
    ranked = peak.withColumn("gains", gains)
    first, second = F.get("gains", F.lit(0)), F.get("gains", F.lit(1))
    halves = (-first["order"]).between(0.35, 0.65) & (-second["order"]).between(0.35, 0.65)
    return ranked.select(
        "peak_week",
        first["name"].alias("driver"),
        second["name"].alias("second_driver"),
        F.coalesce(halves, F.lit(False)).alias("half_and_half"),
        F.coalesce(F.abs("share_aov") < 0.1, F.lit(False)).alias("order_size_flat"),
    )


def channel_facts(rows: DataFrame) -> DataFrame:
    """Best and worst named channel of sufficient size, whether the worst is even below Direct, and small ones that beat the best.

    Needs two named channels; no row otherwise.
    """
    named = ~F.col("small_sample") & ~F.col("channel").isin(*UNNAMED_CHANNELS)
    rate = F.col("conversion")
    best = F.max(F.when(named, F.struct(rate.alias("conversion"), (-F.col("sessions")).alias("n"), "channel")))
    worst = F.min(F.when(named, F.struct(rate.alias("conversion"), F.col("sessions").alias("n"), "channel")))
    listed = rows.agg(
        F.count_if(named).alias("named"),
        best.alias("best"),
        worst.alias("worst"),
        F.max(F.when(named & (F.col("channel") == "Direct"), rate)).alias("direct"),
        F.collect_list(F.when(F.col("small_sample"), F.struct("channel", "conversion"))).alias("small"),
    )
    better = F.filter("small", lambda s: s["conversion"] > F.col("best.conversion"))
    return listed.filter(F.col("named") >= 2).select(
        F.col("best.channel").alias("best_channel"),
        F.col("best.conversion").alias("best_conversion"),
        F.col("worst.channel").alias("worst_channel"),
        F.col("worst.conversion").alias("worst_conversion"),
        F.coalesce(F.col("worst.conversion") < F.col("direct"), F.lit(False)).alias("worst_below_direct"),
        F.array_join(F.array_sort(F.transform(better, lambda s: s["channel"])), ", ").alias("small_but_better"),
    )


def observed_cohorts(cohorts: DataFrame) -> DataFrame:
    """Cohorts that some later full week can say anything about."""
    return cohorts.filter(F.col("week_offset") > 0).groupBy("cohort_week").agg(
        F.max("cohort_users").alias("cohort_users"), F.count(F.lit(1)).alias("later_weeks")
    )


def step_lag(rates: DataFrame) -> DataFrame:
    """Sessions lost between consecutive steps, by a lag over the step order of each segment."""
    by_segment = Window.partitionBy("segment_type", "segment").orderBy("step_order")
    return rates.withColumn("previous", F.lag("sessions").over(by_segment)).withColumn(
        "lost", F.col("previous") - F.col("sessions")
    )
