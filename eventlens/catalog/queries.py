"""Every operator of the inventory as a named query over the shared test tables.

frame and, where SQL can say it, a statement for DuckDB with the same columns. All
run over the whole ``events`` table through ``adapter``.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from datetime import date, timedelta
from functools import cached_property, reduce
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from eventlens.catalog import adapter
from eventlens.catalog import oracle as o
from eventlens.catalog.oracle import day, n, r, sql
from eventlens.functions import events as fe
from eventlens.functions import stats
from eventlens.operators import (
    analysis,
    areas,
    audit,
    checks,
    cohorts,
    crosscheck,
    experiment,
    funnel,
    purchases,
    sessions,
    staging,
    user_windows,
    weekly,
)
from eventlens.plans.incremental import Incremental
from eventlens.plans.models import Models
from eventlens.plans.results import export_frames, result_blocks
from eventlens.session import scratch_dir
from eventlens.sources import ingest, nested, readers, sinks

CFG = adapter.CONFIG
STEPS = CFG.steps


class Tables:
    """The adapted test tables of one scale, and the models over them."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    @cached_property
    def raw(self) -> DataFrame:
        return adapter.source(self.spark, self.sf_dir)

    @cached_property
    def events(self) -> DataFrame:
        return adapter.adapt_events(self.raw)

    @cached_property
    def items(self) -> DataFrame:
        return adapter.adapt_items(self.raw)

    @cached_property
    def nested(self) -> DataFrame:
        return adapter.nest(self.raw)

    @cached_property
    def m(self) -> Models:
        return Models(self.events, CFG)

    @cached_property
    def rates(self) -> DataFrame:
        return analysis.funnel_rates(self.m.funnel_segments, STEPS)

    @cached_property
    def everyone(self) -> DataFrame:
        return self.rates.filter("segment_type = 'all'")

    @cached_property
    def gap(self) -> DataFrame:
        return analysis.segment_gap(self.m.funnel_segments, STEPS, *CFG.gap_pair, alpha=CFG.alpha)

    @cached_property
    def tree(self) -> DataFrame:
        return analysis.metric_tree(self.m.weekly_metrics, CFG.holiday_start)

    @cached_property
    def channels(self) -> DataFrame:
        return analysis.channels(self.m.funnel_segments, STEPS[-1], CFG.small_sample)

    @cached_property
    def target(self) -> DataFrame:
        return analysis.target_step(self.gap, self.everyone)

    @cached_property
    def session_totals(self) -> DataFrame:
        return audit.session_totals(
            audit.session_steps(self.events, *audit.AUDIT_STEPS), CFG.coverage_min_sessions
        )

    @cached_property
    def populations(self) -> DataFrame:
        return experiment.with_populations(self.m.user_windows, CFG.gap_pair[0])


def comparable(df: DataFrame) -> DataFrame:
    """Types and precision in which Spark and DuckDB results can be compared value by value."""
    columns = []
    for f in df.schema:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.DoubleType, T.FloatType, T.DecimalType)):
            c = F.round(c.cast("double"), 6) + F.lit(0.0)
        elif isinstance(f.dataType, (T.ByteType, T.ShortType, T.IntegerType)):
            c = c.cast("bigint")
        elif isinstance(f.dataType, T.DateType):
            c = c.cast("string")
        elif isinstance(f.dataType, (T.TimestampNTZType, T.TimestampType)):
            c = fe.micros(c)
        columns.append(c.alias(f.name))
    return df.select(*columns)


@dataclass(frozen=True)
class Query:
    frame: Callable[[Tables], DataFrame]
    oracle: str | None

    def __call__(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        spark.conf.set("spark.sql.session.timeZone", "UTC")  # zone-free times are read as UTC
        return comparable(self.frame(Tables(spark, sf_dir)))


CATALOG: dict[str, Query] = {}


def add(key: str, frame: Callable[[Tables], DataFrame], oracle: str | None = None) -> None:
    CATALOG[key] = Query(frame, oracle)


def count_by(df: DataFrame, *columns: str) -> DataFrame:
    return df.groupBy(*columns).agg(F.count(F.lit(1)).alias("rows"))


def flags_sql(prefix: str = "") -> str:
    return ", ".join(f"{n(prefix + c)} AS {c}" for c in o.FLAGS)


def columns_sql(schema, names=None) -> str:
    """A select list that matches ``comparable`` for a flat table."""
    out = []
    for f in schema:
        if names and f.name not in names:
            continue
        if isinstance(f.dataType, T.DateType):
            out.append(f"{day(f.name)} AS {f.name}")
        elif isinstance(f.dataType, T.TimestampNTZType):
            out.append(f"epoch_us({f.name}) AS {f.name}")
        elif isinstance(f.dataType, T.DoubleType):
            out.append(f"{r(f.name)} AS {f.name}")
        elif isinstance(f.dataType, T.LongType):
            out.append(f"{n(f.name)} AS {f.name}")
        else:
            out.append(f.name)
    return ", ".join(out)


EV, IT = readers.EVENTS, readers.ITEMS

# ---- 2.1 scans, sources, sinks, ingest -------------------------------------------

add(
    "s1_scan",
    lambda t: t.spark.read.parquet(f"{t.sf_dir}/events.parquet")
    .groupBy("event_type")
    .agg(F.count(F.lit(1)).alias("rows"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts")),
    f"SELECT event_type, {n('count(*)')} AS rows, epoch_us(min(ts)) AS first_ts, epoch_us(max(ts)) AS last_ts FROM events GROUP BY 1",
)
add(
    "s2_narrow_scan",
    lambda t: readers.narrow(t.events, crosscheck.COLUMNS),
    sql(f"SELECT {columns_sql(EV, crosscheck.COLUMNS)} FROM ev", "ev"),
)
add(
    "s3_one_day",
    lambda t: count_by(readers.one_day(t.events, date(2024, 1, 25)), "event_date", "event_name"),
    sql(
        f"SELECT {day('event_date')} AS event_date, event_name, {n('count(*)')} AS rows FROM ev WHERE event_date = DATE '2024-01-25' GROUP BY 1, 2",
        "ev",
    ),
)
add(
    "s4_conform",
    lambda t: readers.conform(t.events.withColumn("extra", F.lit(1)), EV),
    sql(f"SELECT {columns_sql(EV)} FROM ev", "ev"),
)
PARAMS = [*nested.INT_PARAMS, *nested.STRING_PARAMS]
add(
    "s5_params_by_slot",
    lambda t: nested.flatten_events(t.nested).select("user_pseudo_id", "event_ts", *PARAMS),
    sql(f"SELECT {columns_sql(EV, ['user_pseudo_id', 'event_ts', *PARAMS])} FROM ev", "ev"),
)
add(
    "s6_param_any_slot",
    lambda t: count_by(nested.flatten_events(t.nested), "user_pseudo_id", "session_engaged"),
    sql(f"SELECT user_pseudo_id, session_engaged, {n('count(*)')} AS rows FROM ev GROUP BY 1, 2", "ev"),
)
add(
    "s7_struct_paths",
    lambda t: nested.flatten_events(t.nested).select("user_pseudo_id", "event_ts", *nested.STRUCT_PATHS),
    sql(f"SELECT {columns_sql(EV, ['user_pseudo_id', 'event_ts', *nested.STRUCT_PATHS])} FROM ev", "ev"),
)
add(
    "s8_time_decoding",
    lambda t: nested.flatten_events(t.nested).select("event_date", "event_ts", "event_name"),
    sql(f"SELECT {columns_sql(EV, ['event_date', 'event_ts', 'event_name'])} FROM ev", "ev"),
)
add(
    "s9_item_flatten",
    lambda t: nested.flatten_items(t.nested),
    sql(
        f"""SELECT {columns_sql(IT)} FROM (SELECT * FROM it UNION ALL
            SELECT event_date, event_ts, event_name, user_pseudo_id, ga_session_id, transaction_id,
                   'I' || (event_id % 100), 'line 0', CASE k % 3 WHEN 0 THEN 'Apparel' WHEN 1 THEN 'Bags' END,
                   value, 1, NULL FROM flat WHERE event_name = 'view_item')""",
        "flat",
        "it",
    ),
)
add(
    "s10_pending_days",
    # What the second run takes, if the first stopped where the experiment window starts.
    lambda t: count_by(
        ingest.rows_of_days(t.nested, ingest.pending_days(t.nested, days_before_experiment(t))), "event_date"
    ),
    sql(
        f"""SELECT strftime(event_date, '%Y%m%d') AS event_date, {n('count(*)')} AS rows FROM ev
            WHERE event_date >= DATE '{CFG.experiment_start}' GROUP BY 1""",
        "ev",
    ),
)


def days_before_experiment(t: Tables) -> list[date]:
    return [CFG.window_start + timedelta(days=k) for k in range((CFG.experiment_start - CFG.window_start).days)]


def ingested(t: Tables) -> DataFrame:
    """Two runs of the ingest into the shared folder; what both wrote, and what the manifest says of it."""
    out = f"{scratch_dir(t.spark)}/ingest-{uuid4()}"
    ingest.ingest(t.nested, out, days_before_experiment(t), at_once=31)
    ingest.ingest(t.nested, out, at_once=31)
    told = ingest.stored_manifest(t.spark, out)
    events, items = (count_by(f(t.spark, out), "event_date") for f in (readers.read_events, readers.read_items))
    by_day = events.withColumnRenamed("rows", "events").join(items.withColumnRenamed("rows", "items"), "event_date", "left")
    total = F.struct("days", "event_rows", "item_rows")
    return by_day.select("*", told.select(total.alias("m")).scalar().alias("m")).select("event_date", "events", "items", "m.*")


add(
    "s10_ingested",
    ingested,
    sql(
        f"""SELECT {day('event_date')} AS event_date, {n('e')} AS events, {n('i')} AS items, {n('count(*) OVER ()')} AS days,
            {n('sum(e) OVER ()')} AS event_rows, {n('sum(i) OVER ()')} AS item_rows
        FROM (SELECT event_date, count(*) AS e FROM ev GROUP BY 1) LEFT JOIN
            (SELECT event_date, count(*) AS i FROM (SELECT event_date FROM it UNION ALL SELECT event_date FROM flat WHERE event_name = 'view_item') GROUP BY 1) USING (event_date)""",
        "ev",
        "it",
        "flat",
    ),
)
add(
    "s11_manifest",
    lambda t: ingest.manifest(t.events, t.items, "export"),
    sql(
        f"""SELECT 'export' AS source, (SELECT {n('count(DISTINCT event_date)')} FROM ev) AS days,
            (SELECT {n('count(*)')} FROM ev) AS event_rows, (SELECT {n('count(*)')} FROM it) AS item_rows""",
        "ev",
        "it",
    ),
)
add(
    "s12_null_profile",
    lambda t: ingest.null_profile(t.events),
    sql(
        " UNION ALL ".join(
            f"SELECT '{c}' AS column_name, {r(f'avg(CASE WHEN {c} IS NULL THEN 1.0 ELSE 0.0 END)')} AS null_share,"
            f" {'NULL::DOUBLE' if c not in ingest.NULL_LIMITS else f'{ingest.NULL_LIMITS[c]}::DOUBLE'} AS null_limit,"
            f" {'false' if c not in ingest.NULL_LIMITS else f'avg(CASE WHEN {c} IS NULL THEN 1.0 ELSE 0.0 END) > {ingest.NULL_LIMITS[c]}'} AS over_limit FROM ev"
            for c in EV.names
        ),
        "ev",
    ),
)
add(
    "s13_event_histogram",
    lambda t: ingest.event_histogram(t.events, STEPS),
    sql(
        f"SELECT event_name, {n('count(*)')} AS rows, event_name IN {STEPS} AS is_step FROM ev GROUP BY 1 ORDER BY 2 DESC, 1",
        "ev",
    ),
)
add(
    "s13_absent_steps",
    lambda t: ingest.absent_steps(t.events, ("session_start", *STEPS, "refund")),
    sql(
        f"SELECT step FROM (SELECT unnest({['session_start', *STEPS, 'refund']}) AS step) WHERE step NOT IN (SELECT event_name FROM ev)",
        "ev",
    ),
)
SES_SQL = (
    f"session_key, user_pseudo_id, epoch_us(session_start_ts) AS session_start_ts, {day('session_date')} AS session_date,"
    f" {day('week_start')} AS week_start, session_number, is_first_session, device_category, country, channel,"
    f" {n('engaged')} AS engaged, {n('page_views')} AS page_views, {flags_sql()}, {n('purchases')} AS purchases,"
    f" {r('revenue_usd')} AS revenue_usd"
)
add(
    "s14_materialised_sessions",
    lambda t: sinks.materialise(t.m.sessions, f"{scratch_dir(t.spark)}/sessions-{uuid4()}"),
    sql(f"SELECT {SES_SQL} FROM ses", "ses"),
)


def grown(t: Tables) -> Incremental:
    """The models of the table, grown in two steps: the second says a day again that the first has said."""
    inc = Incremental(t.spark, f"{scratch_dir(t.spark)}/grown-{uuid4()}", CFG)
    days = [CFG.window_start + timedelta(days=k) for k in range(CFG.expected_days)]
    at = len(days_before_experiment(t))
    for some in (days[:at], days[at - 1 :]):
        inc.update(t.events, some)
    return inc


add(
    "s10_grown_sessions",
    lambda t: grown(t).models(t.events).sessions,
    sql(f"SELECT {SES_SQL} FROM ses", "ses"),
)

add(
    "s15_ordered_model",
    lambda t: sinks.ordered(t.m.area_funnel, "area_funnel").select("entry_area", "sessions"),
    sql(f"SELECT entry_area, {n('sessions')} AS sessions FROM area ORDER BY 1", "area"),
)


def export(name: str) -> Callable[[Tables], DataFrame]:
    return lambda t: export_frames(t.m)[name]


add(
    "s16_headline",
    export("headline"),
    sql(
        f"""SELECT (SELECT {n('count(*)')} FROM ev) AS events, {n('users')} AS users, {n('sessions')} AS sessions,
            {n('purchases')} AS orders, {r('revenue_usd', 2)} AS revenue_usd, {r('purchases::DOUBLE / sessions')} AS session_conversion,
            {r('revenue_usd::DOUBLE / purchases')} AS order_value_usd,
            (SELECT {day('min(event_date)')} FROM ev) AS window_start, (SELECT {day('max(event_date)')} FROM ev) AS window_end
        FROM seg WHERE segment_type = 'all'""",
        "ev",
        "seg",
    ),
)
add(
    "s16_funnel_by_device",
    export("funnel_by_device"),
    sql(
        f"""SELECT segment AS device, {o.case('step', {repr(k): v for k, v in sinks.STEP_LABELS.items()})} AS step, {n('step_order')} AS step_order,
            {n('k')} AS sessions, coalesce({r('k::DOUBLE / nullif(n, 0)')}, 'nan'::DOUBLE) AS rate_from_previous,
            {r('k::DOUBLE / all_sessions')} AS rate_from_all_sessions
        FROM steps_reached WHERE segment_type IN ('device', 'all')""",
        "steps_reached",
    ),
)
add(
    "s16_store_sections",
    export("store_sections"),
    sql(
        f"""SELECT label AS section, {n('sessions')} AS sessions, {r('checkout_rate')} AS checkout_rate, ci_low, ci_high,
            {r('median_rate')} AS typical_section_rate, {r('finish_rate')} AS checkouts_that_finish, {r('order_value')} AS order_value_usd,
            clearly_below AS clearly_below_typical, checkouts >= 30 AND finish_rate < 0.5 * site_finish_rate AS possible_checkout_fault,
            {r('extra_orders', 1)} AS extra_orders_if_typical, {r('extra_orders * coalesce(order_value, 0)', 2)} AS extra_revenue_if_typical
        FROM opportunity""",
        "opportunity",
    ),
)
LOGS = {
    "users": "visitors",
    "sessions_per_user": "visits_per_visitor",
    "conversion": "conversion",
    "aov": "order_size",
}
TOTAL = " + ".join(f"log_{c}" for c in LOGS)
add(
    "s16_weekly_revenue",
    export("weekly_revenue"),
    sql(
        f"""SELECT {day('week_start')} AS week_start, {r('revenue_usd', 2)} AS revenue_usd, {n('users')} AS users,
            {r('sessions_per_user')} AS sessions_per_user, {r('conversion')} AS conversion, {r('aov')} AS order_value_usd,
            {', '.join(f"{r(f'log_{c}')} AS change_{v}" for c, v in LOGS.items())},
            {r(TOTAL)} AS change_total, {r(f'exp({TOTAL}) - 1')} AS pct_vs_baseline FROM tree""",
        "tree",
    ),
)
CHAN_SQL = f"{r('engaged_rate')} AS engaged_rate, {r('conversion')} AS conversion, ci_low, ci_high"
add(
    "s16_channels",
    export("channels"),
    sql(
        f"""SELECT channel, {n('sessions')} AS sessions, {r('share')} AS share_of_sessions, {CHAN_SQL},
            {r('revenue_per_session')} AS revenue_per_session_usd, small_sample FROM chan""",
        "chan",
    ),
)
COH_RATES = f"{r('active_users::DOUBLE / cohort_users')} AS retention, {r('purchasing_users::DOUBLE / cohort_users')} AS purchase_retention"
add(
    "s16_retention",
    export("retention"),
    sql(
        f"""SELECT {day('cohort_week')} AS cohort_week, week_offset, {n('cohort_users')} AS cohort_users,
            {n('active_users')} AS active_users, {COH_RATES} FROM coh WHERE week_offset > 0""",
        "coh",
    ),
)



# ---- 2.2 projections, filters, predicates -----------------------------------------

add(
    "p1_exact_copies_removed",
    lambda t: count_by(t.events.distinct(), "event_name"),
    sql(f"SELECT event_name, {n('count(*)')} AS rows FROM (SELECT DISTINCT * FROM ev) GROUP BY 1", "ev"),
)
add(
    "p2_placeable_rows",
    lambda t: count_by(staging.placeable_hits(t.events), "event_name"),
    sql(f"SELECT event_name, {n('count(*)')} AS rows FROM hits GROUP BY 1", "hits"),
)
add(
    "p3_session_key",
    lambda t: count_by(t.m.hits, "session_key"),
    sql(f"SELECT session_key, {n('count(*)')} AS rows FROM hits GROUP BY 1", "hits"),
)
add(
    "p4_funnel_events",
    lambda t: funnel.funnel_events(t.m.hits, STEPS),
    sql(
        f"SELECT session_key, {n(f'list_position({list(STEPS)}, event_name) - 1')} AS step, epoch_us(event_ts) AS event_ts FROM hits WHERE event_name IN {STEPS}",
        "hits",
    ),
)
add(
    "p5_channel_group",
    lambda t: count_by(
        t.events.withColumn("channel", fe.channel_group(F.col("session_source"), F.col("session_medium"))),
        "session_source",
        "session_medium",
        "channel",
    ),
    sql(
        f"SELECT session_source, session_medium, {o.channel('session_source', 'session_medium')} AS channel, {n('count(*)')} AS rows FROM ev GROUP BY 1, 2",
        "ev",
    ),
)
add(
    "p6_session_channel",
    lambda t: t.m.sessions.select("session_key", "session_number", "channel"),
    sql("SELECT session_key, session_number, channel FROM ses", "ses"),
)
add(
    "p7_entry_section",
    lambda t: areas.entry_areas(t.m.hits, STEPS[0]),
    sql("SELECT session_key, entry_area FROM entry", "entry"),
)
add(
    "p8_section_label",
    lambda t: t.m.area_funnel.select("entry_area", fe.section_label(F.col("entry_area")).alias("label")),
    sql("SELECT entry_area, label FROM label", "label"),
)
add(
    "p9_session_week",
    lambda t: t.m.sessions.select("session_key", "session_date", "week_start"),
    sql(f"SELECT session_key, {day('session_date')} AS session_date, {day('week_start')} AS week_start FROM ses", "ses"),
)
add(
    "p10_user_type",
    lambda t: count_by(
        t.m.sessions.withColumn("user_type", fe.user_type(F.col("is_first_session"))), "is_first_session", "user_type"
    ),
    sql(
        f"SELECT is_first_session, CASE is_first_session WHEN true THEN 'new' ELSE 'returning' END AS user_type, {n('count(*)')} AS rows FROM ses GROUP BY 1",
        "ses",
    ),
)
add(
    "p11_null_segment",
    lambda t: count_by(t.m.sessions.withColumn("device", fe.segment_name(F.col("device_category"))), "device"),
    sql(f"SELECT ifnull(device_category, '(null)') AS device, {n('count(*)')} AS rows FROM ses GROUP BY 1", "ses"),
)
add(
    "p12_zero_fill",
    lambda t: t.m.sessions.filter("purchases = 0").select("session_key", "reached_purchase", "purchases", "revenue_usd"),
    sql(
        f"""SELECT session_key, {n('reached_purchase')} AS reached_purchase, {n('0')} AS purchases, 0.0::DOUBLE AS revenue_usd
            FROM ses WHERE session_key NOT IN (SELECT session_key FROM pur)""",
        "ses",
        "pur",
    ),
)
add(
    "p13_placeholders",
    lambda t: count_by(t.events.withColumn("no_country", fe.is_placeholder(F.col("country"))), "country", "no_country"),
    sql(f"SELECT country, {o.placeholder('country')} AS no_country, {n('count(*)')} AS rows FROM ev GROUP BY 1", "ev"),
)
add(
    "p14_windows",
    lambda t: t.m.user_windows.select("user_pseudo_id", "pre_sessions", "exp_sessions", "exp_first_date"),
    sql(
        f"SELECT user_pseudo_id, {n('pre_sessions')} AS pre_sessions, {n('exp_sessions')} AS exp_sessions, {day('exp_first_date')} AS exp_first_date FROM uw",
        "uw",
    ),
)
add(
    "p15_week_coverage",
    lambda t: t.m.weekly_metrics.select("week_start", "days_observed", "is_full_week", "revenue_complete"),
    sql(
        f"SELECT {day('week_start')} AS week_start, {n('days_observed')} AS days_observed, is_full_week, revenue_complete FROM wk",
        "wk",
    ),
)

# ---- 2.3 joins ---------------------------------------------------------------------


def chained_step(t: Tables) -> DataFrame:
    rows = t.m.hits.select(F.col("session_key").alias("k"), "event_name", "event_ts")
    second = rows.filter(F.col("event_name") == STEPS[1]).select("k", "event_ts")
    return crosscheck.next_step(second, crosscheck.first_step(rows, STEPS)).filter("t IS NOT NULL").select("k", "t")


add(
    "j1_step_chain",
    chained_step,
    sql("SELECT session_key AS k, epoch_us(t2) AS t FROM fun WHERE t2 IS NOT NULL", "fun"),
)
add(
    "j2_open_and_ordered",
    lambda t: t.m.session_funnel.groupBy(*[f"any_{s}" for s in STEPS], *[f"reached_{s}" for s in STEPS]).agg(
        F.count(F.lit(1)).alias("rows")
    ),
    sql(
        f"SELECT {flags_sql()}, {n('count(*)')} AS rows FROM fun WHERE any_view_item + any_begin_checkout + any_add_payment_info + any_purchase > 0 GROUP BY ALL",
        "fun",
    ),
)
add(
    "j3_session_joins",
    lambda t: t.m.sessions.select("session_key", "page_views", "any_purchase", "purchases", "revenue_usd"),
    sql(
        f"SELECT session_key, {n('page_views')} AS page_views, {n('any_purchase')} AS any_purchase, {n('purchases')} AS purchases, {r('revenue_usd')} AS revenue_usd FROM ses",
        "ses",
    ),
)
add(
    "j4_section_sessions",
    lambda t: areas.entry_areas(t.m.hits, STEPS[0])
    .join(t.m.sessions, "session_key")
    .select("session_key", "entry_area", "session_date", "reached_begin_checkout"),
    sql(
        f"SELECT session_key, entry_area, {day('session_date')} AS session_date, {n('reached_begin_checkout')} AS reached_begin_checkout FROM entry JOIN ses USING (session_key)",
        "entry",
        "ses",
    ),
)
add(
    "j5_bounds_on_every_week",
    lambda t: weekly.with_week_coverage(
        t.m.sessions.groupBy("week_start").agg(
            F.min("session_date").alias("first_day"), F.max("session_date").alias("last_day")
        ),
        "first_day",
        "last_day",
    ),
    sql(
        f"""SELECT {day('week_start')} AS week_start, {day('min(session_date)')} AS first_day, {day('max(session_date)')} AS last_day,
            {n('any_value(days_observed)')} AS days_observed, any_value(is_full_week) AS is_full_week
        FROM ses JOIN wk USING (week_start) GROUP BY ses.week_start""",
        "ses",
        "wk",
    ),
)
add(
    "j6_full_week_cohorts",
    lambda t: t.m.cohort_retention.select("cohort_week", "cohort_users").distinct(),
    sql(
        f"SELECT {day('cohort_week')} AS cohort_week, {n('count(*)')} AS cohort_users FROM newcomers WHERE cohort_week IN (SELECT week_start FROM wk WHERE is_full_week) GROUP BY 1",
        "newcomers",
        "wk",
    ),
)
add(
    "j7_newcomer_weeks",
    lambda t: cohorts.user_weeks(t.m.sessions)
    .filter(F.col("cohort_week").isNotNull())
    .select("user_pseudo_id", "cohort_week", "week_start", "purchased"),
    sql(
        f"""SELECT user_pseudo_id, {day('cohort_week')} AS cohort_week, {day('week_start')} AS week_start, max(purchases) > 0 AS purchased
            FROM newcomers JOIN ses USING (user_pseudo_id) GROUP BY ALL""",
        "newcomers",
        "ses",
    ),
)
add(
    "j8_cohort_grid",
    lambda t: t.m.cohort_retention.select("cohort_week", "activity_week", "week_offset"),
    sql(
        f"""SELECT DISTINCT {day('c.cohort_week')} AS cohort_week, {day('f.week_start')} AS activity_week, date_diff('day', c.cohort_week, f.week_start) // 7 AS week_offset
            FROM newcomers c JOIN wk f ON f.week_start >= c.cohort_week JOIN wk own ON own.week_start = c.cohort_week
            WHERE f.is_full_week AND own.is_full_week""",
        "newcomers",
        "wk",
    ),
)
add(
    "j9_grid_activity",
    lambda t: t.m.cohort_retention.select("cohort_week", "activity_week", "active_users", "purchasing_users"),
    sql(
        f"SELECT {day('cohort_week')} AS cohort_week, {day('activity_week')} AS activity_week, {n('active_users')} AS active_users, {n('purchasing_users')} AS purchasing_users FROM coh",
        "coh",
    ),
)
RECON_OFF = "abs(item_revenue - revenue) > greatest(0.01, 0.01 * abs(revenue))"
RECON_SQL = f"{n('count(*) FILTER (WHERE NOT found)')} AS without_items, {n(f'count(*) FILTER (WHERE found AND revenue IS NOT NULL AND {RECON_OFF})')} AS mismatched, {n('count(*) FILTER (WHERE found)')} AS with_items"
add(
    "j10_purchases_to_items",
    lambda t: audit.item_reconciliation(t.events, t.items),
    sql(f"SELECT {RECON_SQL} FROM recon", "recon"),
)
KEYLESS = "(SELECT count(*) > 0 FROM audit_sessions WHERE user_pseudo_id IS NULL AND n_purchase > 0)::INTEGER"
Q16_SQL = f"""SELECT {n(f"count(*) FILTER (WHERE user_pseudo_id IS NOT NULL AND n_purchase > 0) + {KEYLESS}")} AS purchase_sessions,
    {n(f"count(*) FILTER (WHERE user_pseudo_id IS NOT NULL AND n_purchase > 0 AND NOT coalesce(t_begin_checkout <= t_purchase, false)) + {KEYLESS}")} AS without_checkout
    FROM audit_sessions"""
add(
    "j11_purchase_and_checkout",
    lambda t: audit.purchase_before_checkout(t.session_totals),
    sql(Q16_SQL, "audit_sessions"),
)

# ---- 2.4 aggregations ----------------------------------------------------------------

add(
    "a1_session_aggregates",
    lambda t: sessions.session_attributes(t.m.hits),
    sql(
        f"SELECT session_key, user_pseudo_id, epoch_us(session_start_ts) AS session_start_ts, session_number, device_category, country, session_source, session_medium, ft_source, ft_medium, {n('engaged')} AS engaged FROM att",
        "att",
    ),
)
add(
    "a2_conditional_counts",
    lambda t: t.m.stg_events.groupBy("session_key").agg(
        *[fe.count_if(F.col("event_name") == s).alias(s) for s in (*STEPS, "page_view")]
    ),
    sql(
        f"SELECT session_key, {', '.join(n(f'''count(*) FILTER (WHERE event_name = '{s}')''') + f' AS {s}' for s in (*STEPS, 'page_view'))} FROM stg GROUP BY 1",
        "stg",
    ),
)
add(
    "a3_value_at_first_hit",
    lambda t: t.m.hits.groupBy("user_pseudo_id").agg(
        fe.first_value(F.col("session_source"), F.col("event_ts")).alias("source"),
        fe.first_value(F.col("device_category"), F.col("event_ts")).alias("device"),
    ),
    sql(
        f"SELECT user_pseudo_id, {o._first('session_source')} AS source, {o._first('device_category')} AS device FROM hits GROUP BY 1",
        "hits",
    ),
)
add(
    "a4_first_path",
    lambda t: t.m.hits.filter(F.col("event_name") == STEPS[0])
    .groupBy("session_key")
    .agg(
        fe.first_row_value(
            fe.url_path(F.col("page_location")), F.col("event_ts"), F.col("page_location")
        ).alias("path")
    ),
    sql("SELECT session_key, path FROM entry", "entry"),
)
add(
    "a5_any_value",
    lambda t: t.m.hits.groupBy("session_key").agg(F.max("user_pseudo_id").alias("user_pseudo_id")),
    sql("SELECT session_key, any_value(user_pseudo_id) AS user_pseudo_id FROM hits GROUP BY 1", "hits"),
)
add(
    "a6_distinct_users",
    lambda t: t.m.sessions.groupBy("week_start", "channel").agg(
        F.countDistinct("user_pseudo_id").alias("users"), F.count(F.lit(1)).alias("sessions")
    ),
    sql(
        f"SELECT {day('week_start')} AS week_start, channel, {n('count(DISTINCT user_pseudo_id)')} AS users, {n('count(*)')} AS sessions FROM ses GROUP BY 1, 2",
        "ses",
    ),
)
add(
    "a7_distinct_tuples",
    lambda t: audit.tuple_counts(staging.row_counts(t.events), ["user_pseudo_id", "ga_session_id", "event_name"]),
    sql(
        f"SELECT {n('sum(c)')} AS rows, {n('count(*)')} AS distinct_rows FROM (SELECT count(*) AS c FROM ev GROUP BY user_pseudo_id, ga_session_id, event_name)",
        "ev",
    ),
)
SEG_SQL = (
    f"segment_type, segment, {n('sessions')} AS sessions, {n('users')} AS users, {flags_sql()},"
    f" {n('engaged_sessions')} AS engaged_sessions, {n('purchases')} AS purchases, {r('revenue_usd')} AS revenue_usd"
)
add(
    "a8_multi_cut",
    lambda t: t.m.funnel_segments.select("segment_type", "segment", "sessions", "users"),
    sql(
        f"SELECT segment_type, segment, {n('sessions')} AS sessions, {n('users')} AS users FROM seg",
        "seg",
    ),
)
add(
    "a9_having",
    lambda t: t.m.sessions.groupBy("user_pseudo_id").agg(F.count(F.lit(1)).alias("sessions")).filter("sessions >= 10"),
    sql(f"SELECT user_pseudo_id, {n('count(*)')} AS sessions FROM ses GROUP BY 1 HAVING count(*) >= 10", "ses"),
)
add(
    "a10_exact_money",
    lambda t: t.m.purchases.groupBy("user_pseudo_id").agg(F.sum("purchase_revenue_usd").alias("revenue_usd")),
    sql(f"SELECT user_pseudo_id, {r('sum(purchase_revenue_usd)')} AS revenue_usd FROM pur GROUP BY 1", "pur"),
)
add(
    "a11_any_purchase",
    lambda t: t.m.sessions.groupBy("user_pseudo_id", "week_start").agg((F.max("purchases") > 0).alias("bought")),
    sql(
        f"SELECT user_pseudo_id, {day('week_start')} AS week_start, bool_or(purchases > 0) AS bought FROM ses GROUP BY 1, 2",
        "ses",
    ),
)
add(
    "a12_median",
    lambda t: analysis.area_benchmark(t.m.area_funnel, CFG),
    sql(
        f"""SELECT {n('count(*) FILTER (WHERE big)')} AS large_sections, count(*) FILTER (WHERE big) >= 3 AS enough,
            CASE WHEN count(*) FILTER (WHERE big) >= 3 THEN {r('median(checkouts::DOUBLE / sessions) FILTER (WHERE big)')} END AS median_rate,
            {r('sum(purchase_sessions)::DOUBLE / sum(checkouts)')} AS site_finish_rate,
            {n('CASE WHEN count(*) FILTER (WHERE big) >= 3 THEN coalesce(sum(sessions) FILTER (WHERE NOT big), 0) ELSE sum(sessions) END')} AS sessions_in_small_sections
        FROM (SELECT *, sessions >= {CFG.area_min_sessions} AND label <> 'Unknown' AS big FROM label)""",
        "label",
    ),
)
add(
    "a13_geometric_mean",
    lambda t: t.m.weekly_metrics.filter("is_full_week AND transactions > 0").agg(
        F.exp(F.avg(F.log("aov"))).alias("aov"), F.exp(F.avg(F.log("conversion"))).alias("conversion")
    ),
    sql(
        f"SELECT {r('geometric_mean(aov)')} AS aov, {r('geometric_mean(conversion)')} AS conversion FROM wk WHERE is_full_week AND transactions > 0",
        "wk",
    ),
)
add(
    "a14_variance_and_correlation",
    lambda t: t.m.user_windows.groupBy("device_category").agg(
        F.var_samp(stats.double("exp_sessions")).alias("variance"),
        F.covar_samp(stats.double("exp_sessions"), stats.double("pre_sessions")).alias("covariance"),
        F.corr(stats.double("exp_sessions"), stats.double("pre_sessions")).alias("correlation"),
    ),
    sql(
        f"""SELECT device_category, {r('var_samp(exp_sessions)')} AS variance, {r('covar_samp(exp_sessions, pre_sessions)')} AS covariance,
            {r('corr(exp_sessions, pre_sessions)')} AS correlation FROM uw GROUP BY 1""",
        "uw",
    ),
)
WEIGHTED_SQL = sql(
    f"""SELECT week_offset, {r('sum(active_users)::DOUBLE / sum(cohort_users)')} AS retention, {n('count(*)')} AS cohorts
        FROM coh WHERE week_offset IN {CFG.retention_offsets} GROUP BY 1""",
    "coh",
)
add("a15_weighted_rate", lambda t: analysis.weighted_retention(t.m.cohort_retention, CFG.retention_offsets), WEIGHTED_SQL)
Y, N, FIRST = experiment.Y, experiment.N, experiment.FIRST
add(
    "a16_ratio_sums",
    lambda t: experiment.ratio_spread(t.m.user_windows, Y, N, ["device_category"]),
    sql(
        f"""SELECT device_category, {n('count(*)')} AS cnt, {r(f'sum({Y})')} AS y_total, {r(f'sum({N})')} AS n_total,
            {r(f'var_samp({Y})')} AS y_variance, {r(f'var_samp({N})')} AS n_variance, {r(f'covar_samp({Y}, {N})')} AS covariance FROM uw GROUP BY 1""",
        "uw",
    ),
)

# ---- 2.5 windows, sorts, limits, pivots, set operations ------------------------------

CURVE_SQL = sql(
    f"SELECT {n('day_number')} AS day_number, {day('day')} AS day, {n('new_users')} AS new_users, {n('total_users')} AS total_users FROM curve WHERE population = 'all users'",
    "curve",
)
add("w1_running_total", lambda t: experiment.enrolment_curve(t.m.user_windows, FIRST), CURVE_SQL)
add(
    "w2_last_seven_days",
    lambda t: experiment.recent_rate(experiment.enrolment_curve(t.populations, FIRST, ["population"]), ["population"]).drop(
        "curve"
    ),
    sql(f"SELECT population, {n('days')} AS days, {n('enrolled')} AS enrolled, {r('rate')} AS rate FROM curve_end", "curve_end"),
)
add(
    "w3_step_lag",
    lambda t: analysis.step_lag(t.rates).select("segment_type", "segment", "step_order", "sessions", "previous", "lost"),
    sql(
        f"""SELECT segment_type, segment, {n('step_order')} AS step_order, {n('k')} AS sessions,
            {n('CASE WHEN step_order > 1 THEN n END')} AS previous, {n('CASE WHEN step_order > 1 THEN n - k END')} AS lost FROM steps_reached""",
        "steps_reached",
    ),
)
add(
    "w4_share_of_total",
    lambda t: t.channels.select("channel", "share"),
    sql(f"SELECT channel, {r('share')} AS share FROM chan", "chan"),
)
add(
    "o1_ordered_output",
    lambda t: t.m.weekly_metrics.orderBy("week_start").select("week_start", "sessions"),
    sql(f"SELECT {day('week_start')} AS week_start, {n('sessions')} AS sessions FROM wk ORDER BY 1", "wk"),
)
add(
    "o2_extreme_rows",
    lambda t: t.m.weekly_metrics.agg(
        F.max_by("week_start", F.struct("revenue_usd", -F.datediff("week_start", F.lit(date(2024, 1, 1))))).alias("peak_week"),
        F.min_by("week_start", F.struct("revenue_usd", "week_start")).alias("low_week"),
    ),
    sql(
        f"""SELECT (SELECT {day('week_start')} FROM wk ORDER BY revenue_usd DESC, week_start LIMIT 1) AS peak_week,
            (SELECT {day('week_start')} FROM wk ORDER BY revenue_usd, week_start LIMIT 1) AS low_week""",
        "wk",
    ),
)
add(
    "o3_pivot",
    lambda t: analysis.unpivoted_matrix(analysis.retention_matrix(t.m.cohort_retention)),
    sql(
        f"""SELECT {day('c.cohort_week')} AS cohort_week, {n('c.cohort_users')} AS cohort_users, {n('k.week_offset')} AS week_offset,
            {r('coh.active_users::DOUBLE / coh.cohort_users')} AS retention
        FROM (SELECT DISTINCT cohort_week, cohort_users FROM coh) c CROSS JOIN (SELECT DISTINCT week_offset FROM coh) k
        LEFT JOIN coh ON coh.cohort_week = c.cohort_week AND coh.week_offset = k.week_offset""",
        "coh",
    ),
)
add("o4_dense_calendar", lambda t: experiment.enrolment_curve(t.m.user_windows, FIRST), CURVE_SQL)
add(
    "u1_union_all",
    lambda t: t.everyone.unionByName(t.rates.filter("segment_type = 'device'")).select(
        "segment_type", "segment", "step", "sessions"
    ),
    sql(
        f"""SELECT segment_type, segment, step, {n('k')} AS sessions FROM steps_reached WHERE segment_type = 'all'
            UNION ALL SELECT segment_type, segment, step, {n('k')} FROM steps_reached WHERE segment_type = 'device'""",
        "steps_reached",
    ),
)
add(
    "u2_distinct_rows",
    lambda t: t.m.hits.select("session_key", "event_name").distinct(),
    sql("SELECT DISTINCT session_key, event_name FROM hits", "hits"),
)
add(
    "u3_set_difference",
    # Sessions without a purchase, as a difference of key sets.
    lambda t: t.m.hits.select("session_key").distinct().join(t.m.purchases, "session_key", "left_anti"),
    sql("SELECT session_key FROM hits EXCEPT SELECT session_key FROM pur", "hits", "pur"),
)

# ---- 2.7 models -----------------------------------------------------------------------

add(
    "m0_stage_events",
    lambda t: t.m.stg_events,
    sql(f"SELECT {columns_sql(EV)}, session_key FROM stg", "stg"),
)
add(
    "m1_purchases",
    lambda t: t.m.purchases,
    sql(
        f"SELECT session_key, user_pseudo_id, transaction_id, {r('purchase_revenue_usd')} AS purchase_revenue_usd, epoch_us(purchase_ts) AS purchase_ts, {n('n_rows')} AS n_rows FROM pur",
        "pur",
    ),
)
add(
    "m2_session_funnel",
    lambda t: t.m.session_funnel,
    sql(
        f"SELECT session_key, {flags_sql()} FROM fun WHERE any_view_item + any_begin_checkout + any_add_payment_info + any_purchase > 0",
        "fun",
    ),
)
add("m3_sessions", lambda t: t.m.sessions, sql(f"SELECT {SES_SQL} FROM ses", "ses"))
add("m4_funnel_segments", lambda t: t.m.funnel_segments, sql(f"SELECT {SEG_SQL} FROM seg", "seg"))
add(
    "m5_weekly_metrics",
    lambda t: t.m.weekly_metrics,
    sql(
        f"""SELECT {day('week_start')} AS week_start, {n('days_observed')} AS days_observed, is_full_week, revenue_complete, {n('users')} AS users,
            {n('sessions')} AS sessions, {n('transactions')} AS transactions, {r('revenue_usd')} AS revenue_usd,
            {r('sessions_per_user')} AS sessions_per_user, {r('conversion')} AS conversion, {r('aov')} AS aov FROM wk""",
        "wk",
    ),
)
COH_SQL = f"""SELECT {day('cohort_week')} AS cohort_week, {day('activity_week')} AS activity_week, week_offset, {n('cohort_users')} AS cohort_users,
    {n('active_users')} AS active_users, {n('purchasing_users')} AS purchasing_users, {COH_RATES} FROM coh"""
add("m6_cohort_retention", lambda t: t.m.cohort_retention, sql(COH_SQL, "coh"))
add(
    "m7_area_funnel",
    lambda t: t.m.area_funnel,
    sql(
        f"""SELECT entry_area, {', '.join(f'{n(c)} AS {c}' for c in ('sessions', 'checkouts', 'purchase_sessions', 'purchase_sessions_reliable'))},
            {r('revenue_reliable_usd')} AS revenue_reliable_usd FROM area""",
        "area",
    ),
)
add(
    "m8_user_windows",
    lambda t: t.m.user_windows,
    sql(
        f"""SELECT user_pseudo_id, device_category, {', '.join(f'{n(c)} AS {c}' for c in ('pre_sessions', 'pre_purchases', 'exp_sessions', 'exp_converting_sessions', 'exp_purchases'))},
            {r('pre_revenue_usd')} AS pre_revenue_usd, {r('exp_revenue_usd')} AS exp_revenue_usd, {day('exp_first_date')} AS exp_first_date FROM uw""",
        "uw",
    ),
)


def in_order(name: str, key: str) -> None:
    """The ordered load of a model: all of its columns, and the place of each row. NULL keys come first."""
    place = f"row_number() OVER (ORDER BY {', '.join(f'{c} NULLS FIRST' for c in sinks.MODEL_ORDER[name])})"
    add(
        f"s15_load_{name}",
        lambda t: sinks.ordered_load(getattr(t.m, name), name, f"{scratch_dir(t.spark)}/load-{name}-{uuid4()}"),
        f"SELECT *, {n(place)} AS position FROM ({CATALOG[key].oracle})",
    )


for _name, _key in (
    ("funnel_segments", "m4_funnel_segments"), ("weekly_metrics", "m5_weekly_metrics"), ("cohort_retention", "m6_cohort_retention"),
    ("area_funnel", "m7_area_funnel"), ("user_windows", "m8_user_windows"),
):
    in_order(_name, _key)

# ---- 2.8 audit -------------------------------------------------------------------------

add(
    "q0_summary",
    lambda t: audit.summary(t.events),
    sql(
        f"""SELECT {n('count(*)')} AS events, {n('count(DISTINCT user_pseudo_id)')} AS users, {day('min(event_date)')} AS first_day,
            {day('max(event_date)')} AS last_day, {n('count(DISTINCT event_date)')} AS days FROM ev""",
        "ev",
    ),
)


def check(*names: str) -> Callable[[Tables], DataFrame]:
    return lambda t: (
        audit.scan_checks(audit.daily_profile(t.events), CFG)
        .filter(F.col("name").isin(*names))
        .select("name", "value", "severity")
    )


def check_sql(name: str, value: str, warn: str = "false", fail: str = "false", source: str = "FROM ev") -> str:
    severity = f"CASE WHEN {fail} THEN 'fail' WHEN {warn} THEN 'warn' ELSE 'info' END"
    return f"SELECT '{name}' AS name, {r(value)} AS value, {severity} AS severity {source}"


SHARE = "count(*) FILTER (WHERE {0} IS NULL)::DOUBLE / count(*)"
PURCHASE_ROWS = "FROM ev WHERE event_name = 'purchase'"
SCAN_SQL = {
    "q1_missing_days": check_sql(
        "missing_days",
        f"{CFG.expected_days} - count(DISTINCT event_date)",
        fail=f"count(DISTINCT event_date) < {CFG.expected_days}",
    ),
    "q2_null_session_events": check_sql(
        "null_session_events",
        "count(*) FILTER (WHERE ga_session_id IS NULL)",
        "count(*) > count(ga_session_id)",
        f"{SHARE.format('ga_session_id')} > 0.2",
    ),
    "q3_null_user_events": check_sql(
        "null_user_events",
        "count(*) FILTER (WHERE user_pseudo_id IS NULL)",
        fail=f"{SHARE.format('user_pseudo_id')} > 0.01",
    ),
    **{
        f"q{5 + i}_placeholder_{c}": check_sql(
            f"placeholder_share:{c}",
            f"round(avg(CASE WHEN {o.placeholder(c)} THEN 1.0 ELSE 0.0 END), 4)",
            f"avg(CASE WHEN {o.placeholder(c)} THEN 1.0 ELSE 0.0 END) > 0.25",
        )
        for i, c in enumerate(audit.PLACEHOLDER_COLUMNS)
    },
    "q11_not_set_transaction_ids": check_sql(
        "not_set_transaction_ids",
        "count(*) FILTER (WHERE coalesce(transaction_id, '(not set)') = '(not set)')",
        "bool_or(coalesce(transaction_id, '(not set)') = '(not set)')",
        source=PURCHASE_ROWS,
    ),
    "q13_null_revenue_purchases": check_sql(
        "null_revenue_purchases",
        "count(*) - count(purchase_revenue_usd)",
        "count(*) > count(purchase_revenue_usd)",
        source=PURCHASE_ROWS,
    ),
    "q19_zero_revenue_purchases": check_sql(
        "zero_revenue_purchases",
        "count(*) FILTER (WHERE purchase_revenue_usd = 0)",
        "bool_or(purchase_revenue_usd = 0)",
        source=PURCHASE_ROWS,
    ),
}
for _key, _text in SCAN_SQL.items():
    _name = _text.split("'")[1]
    add(_key, check(_name), sql(_text, "ev"))
DUP_SQL = {
    "exact_duplicate_rows": check_sql(
        "exact_duplicate_rows",
        "(SELECT count(*) FROM ev) - (SELECT count(*) FROM (SELECT DISTINCT * FROM ev))",
        "(SELECT count(*) FROM ev) > (SELECT count(*) FROM (SELECT DISTINCT * FROM ev))",
        source="",
    ),
    "duplicate_purchase_rows": check_sql(
        "duplicate_purchase_rows",
        "sum(c - 1)",
        "sum(c - 1) > 0",
        source=f"FROM (SELECT count(*) AS c {PURCHASE_ROWS} GROUP BY user_pseudo_id, ga_session_id, transaction_id, purchase_revenue_usd)",
    ),
}


def check_rows(frame: Callable[[Tables], DataFrame], *names: str) -> Callable[[Tables], DataFrame]:
    return lambda t: frame(t).filter(F.col("name").isin(*names)).select("name", "value", "severity")


add(
    "q4_exact_duplicate_rows",
    check_rows(lambda t: audit.duplicate_checks(staging.row_counts(t.events)), "exact_duplicate_rows"),
    sql(DUP_SQL["exact_duplicate_rows"], "ev"),
)
add(
    "q12_duplicate_purchase_rows",
    check_rows(lambda t: audit.duplicate_checks(staging.row_counts(t.events)), "duplicate_purchase_rows"),
    sql(DUP_SQL["duplicate_purchase_rows"], "ev"),
)
ITEM_SQL = {
    "item_revenue_mismatch": check_sql(
        "item_revenue_mismatch",
        f"count(*) FILTER (WHERE found AND {RECON_OFF})",
        f"coalesce(bool_or(found AND {RECON_OFF}), false)",
        source="FROM recon",
    ),
    "purchases_without_items": check_sql(
        "purchases_without_items", "count(*) FILTER (WHERE NOT found)", "bool_or(NOT found)", source="FROM recon"
    ),
}
add(
    "q14_item_revenue_mismatch",
    check_rows(lambda t: audit.item_checks(t.events, t.items), "item_revenue_mismatch"),
    sql(ITEM_SQL["item_revenue_mismatch"], "recon"),
)
add(
    "q15_purchases_without_items",
    check_rows(lambda t: audit.item_checks(t.events, t.items), "purchases_without_items"),
    sql(ITEM_SQL["purchases_without_items"], "recon"),
)
add(
    "q16_purchase_without_prior_checkout",
    lambda t: audit.purchase_before_checkout(t.session_totals),
    sql(Q16_SQL, "audit_sessions"),
)
COVER = {
    "rate_low": "coalesce(min(k::DOUBLE / n) FILTER (WHERE judged), sum(k)::DOUBLE / sum(n))",
    "rate_high": "coalesce(max(k::DOUBLE / n) FILTER (WHERE judged), sum(k)::DOUBLE / sum(n))",
}
COVER_CHANGED = f"{COVER['rate_low']} < 0.1 AND {COVER['rate_high']} > 0.5"
add(
    "q17_add_to_cart_coverage",
    lambda t: audit.step_coverage(t.session_totals),
    sql(
        f"""SELECT {n('sum(n)')} AS given_sessions, {n('sum(k)')} AS with_step, {r(COVER['rate_low'])} AS min_weekly, {r(COVER['rate_high'])} AS max_weekly,
            {day('min(week) FILTER (WHERE judged AND k >= 0.1 * n)')} AS first_tracked_week,
            {day('min(week) FILTER (WHERE judged AND k > 0.5 * n)')} AS first_majority_week,
            {r('sum(k)::DOUBLE / sum(n)')} AS coverage, {COVER_CHANGED} AS changed FROM coverage""",
        "coverage",
    ),
)
GAP_US = "abs(epoch_us(t_add_shipping_info) - epoch_us(t_begin_checkout))"
add(
    "q18_checkout_shipping_simultaneous",
    lambda t: audit.simultaneous_events(t.session_totals),
    sql(
        f"""SELECT {n(f'count({GAP_US})')} AS both, {n(f'count(*) FILTER (WHERE {GAP_US} < 1000000)')} AS near,
            {n('count(*) FILTER (WHERE t_add_shipping_info < t_begin_checkout)')} AS second_first,
            {r(f'count(*) FILTER (WHERE {GAP_US} < 1000000)::DOUBLE / count({GAP_US})')} AS near_share FROM audit_sessions""",
        "audit_sessions",
    ),
)
add(
    "q19_zero_revenue_days",
    lambda t: audit.scan_totals(audit.daily_profile(t.events), CFG.bad_day_min_purchases).select(
        "zero_revenue", "purchase_rows", "bad_days", "first_bad_day", "last_bad_day"
    ),
    sql(
        f"""SELECT (SELECT {n('count(*)')} FROM ev WHERE event_name = 'purchase' AND purchase_revenue_usd = 0) AS zero_revenue,
            (SELECT {n('count(*)')} {PURCHASE_ROWS}) AS purchase_rows, {n('count(*)')} AS bad_days,
            {day('min(event_date)')} AS first_bad_day, {day('max(event_date)')} AS last_bad_day FROM zero_days""",
        "ev",
        "zero_days",
    ),
)
add(
    "q20_left_censored_users",
    lambda t: audit.left_censored(t.events),
    sql(f"SELECT {n('count(*) FILTER (WHERE number > 1)')} AS censored, {n('count(*)')} AS measured FROM firsts", "firsts"),
)
add(
    "q21_sessions_without_source",
    lambda t: audit.source_coverage(t.session_totals),
    sql(f"SELECT {r('1 - count(source)::DOUBLE / count(*)')} AS no_source FROM audit_sessions", "audit_sessions"),
)
REST_SQL = [
    f"SELECT 'purchase_without_prior_checkout' AS name, {r('without_checkout')} AS value, CASE WHEN without_checkout > 0 THEN 'warn' ELSE 'info' END AS severity FROM ({Q16_SQL})",
    check_sql(
        "add_to_cart_coverage",
        "round(sum(k)::DOUBLE / sum(n), 4)",
        f"sum(k)::DOUBLE / sum(n) < 0.5 OR ({COVER_CHANGED})",
        source="FROM coverage",
    ),
    check_sql(
        "checkout_shipping_simultaneous",
        f"round(count(*) FILTER (WHERE {GAP_US} < 1000000)::DOUBLE / count({GAP_US}), 4)",
        f"count(*) FILTER (WHERE {GAP_US} < 1000000)::DOUBLE / count({GAP_US}) > 0.5",
        source="FROM audit_sessions",
    ),
    check_sql(
        "sessions_without_source",
        "round(1 - count(source)::DOUBLE / count(*), 4)",
        "1 - count(source)::DOUBLE / count(*) > 0.25",
        source="FROM audit_sessions",
    ),
    check_sql("left_censored_users", "count(*) FILTER (WHERE number > 1)", source="FROM firsts"),
]
add(
    "q_audit_report",
    lambda t: audit.audit(t.events, t.items, CFG).select("name", "value", "severity"),
    sql(
        " UNION ALL ".join([*SCAN_SQL.values(), *DUP_SQL.values(), *ITEM_SQL.values(), *REST_SQL]),
        "ev",
        "recon",
        "audit_sessions",
        "coverage",
        "firsts",
    ),
)

# ---- 2.9 data tests and cross-check -------------------------------------------------------

@dataclass
class Broken:
    """The models with mistakes in all of them, made from all their rows, so that every data test has something to find."""

    t: Tables

    @property
    def sessions(self) -> DataFrame:
        """Open flags in place of ordered ones, a session in seven twice, no user on a session in eleven, one channel renamed."""
        number = F.col("ga_session")
        ses = self.t.m.sessions.withColumn("ga_session", F.regexp_extract("session_key", ":(.*)$", 1).cast("bigint") + F.col("page_views"))
        ses = ses.withColumns({f"reached_{s}": F.col(f"any_{s}") for s in STEPS})
        ses = ses.withColumn("channel", F.when(F.col("channel") == "Email", "Post").otherwise(F.col("channel")))
        ses = ses.withColumn("user_pseudo_id", F.when(number % 11 != 0, F.col("user_pseudo_id")))
        return ses.unionByName(ses.filter(number % 7 == 0)).drop("ga_session")

    @property
    def weekly(self) -> DataFrame:
        """Each week with a hundredth more revenue than its factors make, and every second one twice."""
        wk = self.t.m.weekly_metrics.withColumn("revenue_usd", F.col("revenue_usd") * F.lit(1.01).cast("decimal(3,2)"))
        return wk.unionByName(wk.filter(F.datediff("week_start", F.lit(CFG.window_start)) % 14 == 0))

    @property
    def cohorts(self) -> DataFrame:
        """Retention of purchasing users in place of active ones and the other way round."""
        return self.t.m.cohort_retention.withColumns({"retention": F.col("purchase_retention"), "purchase_retention": F.col("retention")})

    @property
    def areas(self) -> DataFrame:
        """Sections of which nothing but the first letter is left, and none for those on B."""
        first = F.substring("entry_area", 1, 1)
        return self.t.m.area_funnel.withColumn("entry_area", F.when(first != "B", first))

    @property
    def users(self) -> DataFrame:
        """Users by the last digit of their id, and none for 7."""
        last = F.substring("user_pseudo_id", -1, 1)
        return self.t.m.user_windows.withColumn("user_pseudo_id", F.when(last != "7", last))


BROKEN = {
    "bses": (
        f"SELECT * REPLACE ({', '.join(f'any_{s} AS reached_{s}' for s in STEPS)}, CASE channel WHEN 'Email' THEN 'Post' ELSE channel END AS channel,"
        " CASE WHEN mark % 11 <> 0 THEN user_pseudo_id END AS user_pseudo_id) FROM"
        " (SELECT *, split_part(session_key, ':', 2)::BIGINT + page_views AS mark FROM ses) s, (SELECT unnest([1, 2]) AS copy) WHERE copy = 1 OR mark % 7 = 0"
    ),
    "bwk": (
        f"SELECT * REPLACE (revenue_usd * 1.01 AS revenue_usd) FROM wk, (SELECT unnest([1, 2]) AS copy) WHERE copy = 1 OR (week_start - DATE '{CFG.window_start}') % 14 = 0"
    ),
    "bareas": "SELECT CASE WHEN entry_area[1] <> 'B' THEN entry_area[1] END AS entry_area FROM area",
    "busers": "SELECT CASE WHEN right(user_pseudo_id, 1) <> '7' THEN right(user_pseudo_id, 1) END AS user_pseudo_id FROM uw",
}


def broken_sql(body: str, *needs: str) -> str:
    """``sql`` with the mistaken models as expressions of their own."""
    return sql(body, *needs).replace("\n" + body, "".join(f",\n{k} AS ({v})" for k, v in BROKEN.items()) + "\n" + body)


MODELS = ("ses", "wk", "coh", "area", "uw")
IDENTITY = "transactions > 0 AND abs(users * sessions_per_user * conversion * aov / greatest(revenue_usd, 1) - revenue_usd / greatest(revenue_usd, 1)) > 1e-6"
UNORDERED = " OR ".join(f"reached_{b} > reached_{a}" for a, b in zip(STEPS, STEPS[1:]))
# Buying for active and active for buying: week 0 not everyone, a rate above one, more buyers than active.
OUT = "(week_offset = 0 AND purchasing_users <> cohort_users) OR purchasing_users > cohort_users OR active_users > purchasing_users"
ACCEPTED = ", ".join(f"'{c}'" for c in fe.CHANNELS)
add(
    "t1_unique_keys",
    lambda t: checks.duplicate_keys(Broken(t).sessions, "session_key"),
    broken_sql(f"SELECT session_key, {n('count(*)')} AS rows FROM bses GROUP BY 1 HAVING count(*) > 1", *MODELS),
)
add(
    "t1_not_null",
    lambda t: checks.null_keys(Broken(t).sessions, "session_key", "user_pseudo_id").select("session_key"),
    broken_sql("SELECT session_key FROM bses WHERE session_key IS NULL OR user_pseudo_id IS NULL", *MODELS),
)
add(
    "t1_repeated_users",
    # The same test on a key that does repeat: every user with several sessions is reported.
    lambda t: checks.duplicate_keys(t.m.sessions, "user_pseudo_id"),
    sql(f"SELECT user_pseudo_id, {n('count(*)')} AS rows FROM ses GROUP BY 1 HAVING count(*) > 1", "ses"),
)
add(
    "t2_accepted_channels",
    lambda t: checks.unexpected_channels(t.m.sessions, ("Direct", "Email", "Referral")).select("session_key", "channel"),
    sql("SELECT session_key, channel FROM ses WHERE channel NOT IN ('Direct', 'Email', 'Referral')", "ses"),
)
add(
    "t3_ordered_funnel",
    lambda t: checks.unordered_funnels(Broken(t).sessions, STEPS),
    broken_sql(f"SELECT session_key FROM bses WHERE {UNORDERED}", *MODELS),
)
add(
    "t4_revenue_identity",
    lambda t: checks.broken_revenue_identity(Broken(t).weekly),
    broken_sql(f"SELECT {day('week_start')} AS week_start FROM bwk WHERE {IDENTITY}", *MODELS),
)
add(
    "t5_cohort_bounds",
    lambda t: checks.cohorts_out_of_bounds(Broken(t).cohorts),
    sql(
        f"""SELECT {day('cohort_week')} AS cohort_week, week_offset, {r('purchasing_users::DOUBLE / cohort_users')} AS retention FROM coh WHERE {OUT}""",
        "coh",
    ),
)


def all_tests_sql(ses: str, wk: str, areas: str, users: str, out: str) -> str:
    """The twelve counts, each from its own statement."""
    repeated = "SELECT {1} FROM {0} WHERE {1} IS NOT NULL GROUP BY 1 HAVING count(*) > 1 UNION ALL SELECT {1} FROM {0} WHERE {1} IS NULL GROUP BY 1 HAVING count(*) > 1"
    counted = {
        "sessions_key_unique": repeated.format(ses, "session_key"),
        "sessions_not_null": f"SELECT 1 FROM {ses} WHERE session_key IS NULL OR user_pseudo_id IS NULL",
        "sessions_channel_accepted": f"SELECT 1 FROM {ses} WHERE channel NOT IN ({ACCEPTED})",
        "weekly_key_unique": repeated.format(wk, "week_start"),
        "weekly_not_null": f"SELECT 1 FROM {wk} WHERE week_start IS NULL",
        "areas_key_unique": repeated.format(areas, "entry_area"),
        "areas_not_null": f"SELECT 1 FROM {areas} WHERE entry_area IS NULL",
        "users_key_unique": repeated.format(users, "user_pseudo_id"),
        "users_not_null": f"SELECT 1 FROM {users} WHERE user_pseudo_id IS NULL",
        "funnel_is_ordered": f"SELECT 1 FROM {ses} WHERE {UNORDERED}",
        "revenue_identity": f"SELECT 1 FROM {wk} WHERE {IDENTITY}",
        "cohort_bounds": f"SELECT 1 FROM coh WHERE {out}",
    }
    return " UNION ALL ".join(f"""SELECT '{name}' AS "check", {n('count(*)')} AS failures FROM ({body})""" for name, body in counted.items())


IN_ORDER = "(week_offset = 0 AND active_users <> cohort_users) OR active_users > cohort_users OR purchasing_users > active_users"
add(
    "t_all_tests",
    lambda t: checks.run_all(
        t.m.sessions, t.m.weekly_metrics, t.m.cohort_retention, t.m.area_funnel, t.m.user_windows, STEPS
    ),
    sql(all_tests_sql("ses", "wk", "area", "uw", IN_ORDER), *MODELS),
)
add(
    "t_all_tests_on_mistakes",
    lambda t: checks.run_all(Broken(t).sessions, Broken(t).weekly, Broken(t).cohorts, Broken(t).areas, Broken(t).users, STEPS),
    broken_sql(all_tests_sql("bses", "bwk", "bareas", "busers", OUT), *MODELS),
)
METRICS = ["sessions", *[f"reached_{s}" for s in STEPS], "purchases", "revenue_usd"]
V1_BODY = " UNION ALL ".join(
    [
        f"SELECT 'sessions' AS metric, {r('count(DISTINCT session_key)')} AS value FROM hits",
        *[f"SELECT 'reached_{s}', {r(f'sum(reached_{s})')} FROM fun" for s in STEPS],
        f"SELECT 'purchases', {r('count(*)')} FROM pur",
        f"SELECT 'revenue_usd', {r('sum(purchase_revenue_usd)', 2)} FROM pur",
    ]
)
V1_SQL = sql(V1_BODY, "hits", "fun", "pur")
add("v1_recompute", lambda t: crosscheck.recompute(t.events, STEPS), V1_SQL)
add(
    "v2_differences",
    # Against the open funnel's totals in place of the ordered ones, so that there is something to find.
    lambda t: crosscheck.differences(
        crosscheck.recompute(t.events, STEPS),
        crosscheck.model_totals(
            t.m.funnel_segments.select(
                "segment_type", "segment", "sessions", "purchases", "revenue_usd",
                *[F.col(f"any_{s}").alias(f"reached_{s}") for s in STEPS],
            ),
            STEPS,
        ),
    ),
    sql(
        " UNION ALL ".join(
            f"SELECT 'reached_{s}' AS metric, {r(f'sum(reached_{s})')} AS independent, {r(f'sum(any_{s})')} AS models FROM fun HAVING sum(reached_{s}) <> sum(any_{s})"
            for s in STEPS
        ),
        "fun",
    ),
)
add(
    "v2_agreement",
    # Metric by metric, both sides and whether they agree: the comparison itself keeps only those that do not.
    lambda t: crosscheck.recompute(t.events, STEPS)
    .join(crosscheck.model_totals(t.m.funnel_segments, STEPS).withColumnRenamed("value", "models"), "metric")
    .join(
        crosscheck.differences(crosscheck.recompute(t.events, STEPS), crosscheck.model_totals(t.m.funnel_segments, STEPS)).select("metric", F.lit(1).alias("odd")),
        "metric",
        "left",
    )
    .select("metric", "value", "models", F.col("odd").isNull().alias("agrees")),
    sql(f"SELECT metric, value, value AS models, true AS agrees FROM ({V1_BODY})", "hits", "fun", "pur"),
)

# ---- 2.10 analysis --------------------------------------------------------------------------

add(
    "x1_headline",
    lambda t: analysis.headline(t.m.funnel_segments),
    sql(
        f"""SELECT {n('sessions')} AS sessions, {n('users')} AS users, {n('purchases')} AS transactions, {r('revenue_usd')} AS revenue_usd,
            {r('purchases::DOUBLE / sessions')} AS conversion, {r('revenue_usd::DOUBLE / nullif(purchases, 0)')} AS aov FROM seg WHERE segment_type = 'all'""",
        "seg",
    ),
)


def rates_sql(source: str) -> str:
    low, high = o.wilson("k", "n")
    return sql(
        f"""SELECT segment_type, segment, {n('step_order')} AS step_order, step, {n('k')} AS sessions,
            coalesce({r('k::DOUBLE / nullif(n, 0)')}, 'nan'::DOUBLE) AS step_rate, {low} AS ci_low, {high} AS ci_high,
            {r('k::DOUBLE / all_sessions')} AS from_start FROM {source}""",
        source,
    )


add("x2_funnel_rates_ordered", lambda t: t.rates, rates_sql("steps_reached"))
add(
    "x2_funnel_rates_open",
    lambda t: analysis.funnel_rates(t.m.funnel_segments, STEPS, "any"),
    rates_sql("steps_any"),
)
add(
    "x3_segment_gap",
    lambda t: t.gap,
    sql(
        f"""SELECT {n('step_order')} AS step_order, step, {r('rate_a')} AS rate_a, {r('rate_b')} AS rate_b, {r('gap')} AS gap, {r('z')} AS z,
            {r(o.two_sided_p('z'))} AS p_value, z > {o.ZA} AND gap > 0 AS significant, {r('extra_purchases')} AS extra_purchases,
            {r('extra_purchases * order_value')} AS extra_revenue_usd FROM gap""",
        "gap",
    ),
)
LEAK = "SELECT * FROM steps_reached WHERE segment_type = 'all' AND step_order > 1 ORDER BY k::DOUBLE / n, step_order LIMIT 1"
add(
    "x4_biggest_leak",
    lambda t: analysis.biggest_leak(t.everyone).select("step", "step_rate"),
    sql(f"SELECT step, {r('k::DOUBLE / n')} AS step_rate FROM ({LEAK})", "steps_reached"),
)
add(
    "x5_target_step",
    lambda t: t.target,
    sql(
        f"""SELECT step, segment_only FROM (
            SELECT 0 AS rank, step, true AS segment_only, extra_purchases * order_value AS weight, step_order FROM gap WHERE z > {o.ZA} AND gap > 0
            UNION ALL SELECT 1, step, false, 0, step_order FROM ({LEAK})) ORDER BY rank, weight DESC, step_order LIMIT 1""",
        "gap",
        "steps_reached",
    ),
)
add(
    "x6_area_opportunity",
    lambda t: analysis.area_opportunity(t.m.area_funnel, CFG),
    sql(
        f"""SELECT label, {n('sessions')} AS sessions, {r('checkout_rate')} AS checkout_rate, ci_low, ci_high, {r('median_rate')} AS median_rate,
            {r('finish_rate')} AS finish_rate, {r('order_value')} AS order_value, clearly_below, {r('extra_orders')} AS extra_orders,
            {r('extra_orders * coalesce(order_value, 0)')} AS extra_revenue_usd,
            checkouts >= 30 AND finish_rate < 0.5 * site_finish_rate AS broken_checkout FROM opportunity""",
        "opportunity",
    ),
)
add(
    "x6_area_totals",
    lambda t: analysis.area_totals(t.m.area_funnel, CFG),
    sql(
        f"""SELECT {r('any_value(median_rate)')} AS median, {r('coalesce(sum(extra_orders), 0)')} AS extra_orders,
            {r('coalesce(sum(extra_orders * coalesce(order_value, 0)), 0)')} AS extra_revenue_usd,
            (SELECT {r('sum(purchase_sessions)::DOUBLE / sum(checkouts)')} FROM label) AS site_finish_rate, {n(CFG.area_min_sessions)} AS min_sessions,
            {n('(SELECT sum(sessions) FROM label) - coalesce(sum(sessions), 0)')} AS sessions_in_small_sections FROM opportunity""",
        "opportunity",
    ),
)
TREE_SQL = f"""SELECT {day('week_start')} AS week_start, is_baseline, {r('revenue_usd')} AS revenue_usd, {n('users')} AS users, {r('sessions_per_user')} AS sessions_per_user,
    {r('conversion')} AS conversion, {r('aov')} AS aov, {', '.join(f"{r(f'log_{c}')} AS log_{c}" for c in LOGS)}, {r(TOTAL)} AS log_total,
    {r(f'exp({TOTAL}) - 1')} AS pct_change FROM tree"""
add("x7_metric_tree", lambda t: t.tree, sql(TREE_SQL, "tree"))
PEAK = f"SELECT *, {TOTAL} AS total FROM tree ORDER BY revenue_usd DESC, week_start LIMIT 1"
add(
    "x7_peak_week",
    lambda t: analysis.peak_week(t.tree),
    sql(
        f"""SELECT {day('week_start')} AS peak_week, {r('exp(total) - 1')} AS peak_pct_change,
            {', '.join(f"{r(f'log_{c} / nullif(total, 0)')} AS share_{c}" for c in LOGS)} FROM ({PEAK})""",
        "tree",
    ),
)
add(
    "x8_channels",
    lambda t: t.channels,
    sql(
        f"""SELECT channel, {n('sessions')} AS sessions, {r('share')} AS share, {CHAN_SQL}, {r('revenue_per_session')} AS revenue_per_session, small_sample FROM chan""",
        "chan",
    ),
)
add(
    "x9_retention_matrix",
    lambda t: analysis.retention_cells(t.m.cohort_retention),
    sql(
        f"""SELECT {day('cohort_week')} AS cohort_week, {n('cohort_users')} AS cohort_users, {n('week_offset')} AS week_offset,
            {r('active_users::DOUBLE / cohort_users')} AS retention FROM coh""",
        "coh",
    ),
)
add("x9_retention_weighted", lambda t: analysis.weighted_retention(t.m.cohort_retention, CFG.retention_offsets), WEIGHTED_SQL)
add("x10_largest_gap", lambda t: analysis.largest_gap(t.gap), sql(f"SELECT {r('max(abs(gap))')} AS max_gap FROM gap", "gap"))
add(
    "x10_quietest_week",
    lambda t: analysis.quietest_week(t.tree),
    sql(
        f"""SELECT {day('week_start')} AS week_start, {r('exp(total) - 1')} AS pct_change,
            CASE least({', '.join(f'log_{c}' for c in LOGS)}) {' '.join(f"WHEN log_{c} THEN '{c}'" for c in LOGS)} END AS worst_component
        FROM (SELECT *, {TOTAL} AS total FROM tree ORDER BY {TOTAL}, week_start LIMIT 1) WHERE total < 0""",
        "tree",
    ),
)
GAINS = f"""SELECT week_start, share_aov, list_filter(list_reverse_sort([{', '.join(f"{{'share': share_{c}, 'name': '{c}'}}" for c in LOGS)}]), lambda g: g.share > 0) AS gains
    FROM (SELECT week_start, {', '.join(f'log_{c} / nullif(total, 0) AS share_{c}' for c in LOGS)} FROM ({PEAK}))"""
add(
    "x10_growth_drivers",
    lambda t: analysis.growth_drivers(analysis.peak_week(t.tree)),
    sql(
        f"""SELECT {day('week_start')} AS peak_week, gains[1].name AS driver, gains[2].name AS second_driver,
            coalesce(gains[1].share BETWEEN 0.35 AND 0.65 AND gains[2].share BETWEEN 0.35 AND 0.65, false) AS half_and_half,
            coalesce(abs(share_aov) < 0.1, false) AS order_size_flat FROM ({GAINS})""",
        "tree",
    ),
)
NAMED = "NOT small_sample AND channel NOT IN ('Unknown', 'Obfuscated', 'Other')"
add(
    "x10_channel_facts",
    lambda t: analysis.channel_facts(t.channels),
    sql(
        f"""SELECT b.channel AS best_channel, {r('b.conversion')} AS best_conversion, w.channel AS worst_channel, {r('w.conversion')} AS worst_conversion,
            coalesce(w.conversion < (SELECT conversion FROM chan WHERE {NAMED} AND channel = 'Direct'), false) AS worst_below_direct,
            coalesce((SELECT string_agg(channel, ', ' ORDER BY channel) FROM chan WHERE small_sample AND conversion > b.conversion), '') AS small_but_better
        FROM (SELECT * FROM chan WHERE {NAMED} ORDER BY conversion DESC, sessions, channel DESC LIMIT 1) b,
             (SELECT * FROM chan WHERE {NAMED} ORDER BY conversion, sessions, channel LIMIT 1) w
        WHERE (SELECT count(*) FROM chan WHERE {NAMED}) >= 2""",
        "chan",
    ),
)
add(
    "x10_observed_cohorts",
    lambda t: analysis.observed_cohorts(t.m.cohort_retention),
    sql(
        f"SELECT {day('cohort_week')} AS cohort_week, {n('max(cohort_users)')} AS cohort_users, {n('count(*)')} AS later_weeks FROM coh WHERE week_offset > 0 GROUP BY 1",
        "coh",
    ),
)

# ---- 2.11 experiment design ---------------------------------------------------------------------

SEGMENT_COUNTS = ["segment_type", "segment", "sessions", "engaged_sessions"]
add(
    "e1_wilson",
    lambda t: stats.with_wilson(t.m.funnel_segments.select(*SEGMENT_COUNTS), "engaged_sessions", "sessions"),
    sql(
        f"""SELECT segment_type, segment, {n('sessions')} AS sessions, {n('engaged_sessions')} AS engaged_sessions,
            {o.wilson('engaged_sessions', 'sessions')[0]} AS ci_low, {o.wilson('engaged_sessions', 'sessions')[1]} AS ci_high FROM seg""",
        "seg",
    ),
)
add(
    "e2_two_proportions",
    lambda t: stats.with_two_prop_z(
        t.m.area_funnel.select("entry_area", "sessions", "checkouts", "purchase_sessions"),
        "purchase_sessions",
        "checkouts",
        "checkouts",
        "sessions",
    ),
    sql(
        f"""SELECT entry_area, {n('sessions')} AS sessions, {n('checkouts')} AS checkouts, {n('purchase_sessions')} AS purchase_sessions,
            {r('p2 - p1')} AS difference, {r('z')} AS z, {r(o.two_sided_p('z'))} AS p_value
        FROM (SELECT *, CASE WHEN se = 0 THEN 0 ELSE (p2 - p1) / nullif(se, 0) END AS z
              FROM (SELECT *, sqrt(pool * (1 - pool) * (1.0::DOUBLE / nullif(checkouts, 0) + 1.0::DOUBLE / nullif(sessions, 0))) AS se
                    FROM (SELECT *, purchase_sessions::DOUBLE / nullif(checkouts, 0) AS p1, checkouts::DOUBLE / nullif(sessions, 0) AS p2,
                                 (purchase_sessions + checkouts)::DOUBLE / nullif(checkouts + sessions, 0) AS pool FROM area)))""",
        "area",
    ),
)
add(
    "e3_ratio_moments",
    lambda t: experiment.ratio_moments(t.populations, Y, N, ["population"]).select(
        "population", "cnt", "ratio", "unit_variance"
    ),
    sql(
        f"SELECT population, {n('cnt')} AS cnt, {r('ratio')} AS ratio, {r('unit_variance')} AS unit_variance FROM moments",
        "moments",
    ),
)


def split_arms(users: DataFrame) -> DataFrame:
    """Two arms by the first hex digit of the user's hash."""
    return users.withColumn("arm", F.when(F.substring(F.md5("user_pseudo_id"), 1, 1) < "8", "A").otherwise("B"))


add(
    "e4_delta_method_test",
    lambda t: experiment.delta_method_test(split_arms(t.m.user_windows), "arm", Y, N).select(
        "ratio_a", "ratio_b", "difference", "z", "p_value"
    ),
    sql(
        f"""SELECT {r('a.ratio')} AS ratio_a, {r('b.ratio')} AS ratio_b, {r('b.ratio - a.ratio')} AS difference,
            {r('(b.ratio - a.ratio) / sqrt(a.v + b.v)')} AS z, {r(o.two_sided_p('((b.ratio - a.ratio) / sqrt(a.v + b.v))'))} AS p_value
        FROM (SELECT arm, max(t.ratio) AS ratio, sum(power({Y} - t.ratio * {N}, 2)) / (count(*) - 1) / (count(*) * power(avg({N}), 2)) AS v
              FROM split JOIN (SELECT arm, sum({Y})::DOUBLE / sum({N}) AS ratio FROM split GROUP BY 1) t USING (arm) GROUP BY 1) a
        JOIN (SELECT arm, max(t.ratio) AS ratio, sum(power({Y} - t.ratio * {N}, 2)) / (count(*) - 1) / (count(*) * power(avg({N}), 2)) AS v
              FROM split JOIN (SELECT arm, sum({Y})::DOUBLE / sum({N}) AS ratio FROM split GROUP BY 1) t USING (arm) GROUP BY 1) b
          ON a.arm = 'A' AND b.arm = 'B'""",
        "split",
    ),
)
POWER_SQL = f"""SELECT population, {r('m')} AS rel_mde, users_per_arm, naive_sessions_per_arm, {r('users_per_arm * mean_n / naive_sessions_per_arm')} AS design_effect FROM power"""
add(
    "e5_power_ratio",
    lambda t: experiment.power_table(
        experiment.ratio_moments(t.populations, Y, N, ["population"]), CFG.mde_grid, CFG.alpha, CFG.power
    ).select("population", "rel_mde", "users_per_arm", "naive_sessions_per_arm", "design_effect"),
    sql(POWER_SQL, "power"),
)
GRID = f"(SELECT unnest([{', '.join(f'{m}::DOUBLE' for m in CFG.mde_grid)}]) AS m)"


def segment_rates(t: Tables) -> DataFrame:
    return t.m.funnel_segments.select(
        "segment_type", "segment", "sessions", stats.ratio("reached_purchase", "sessions").alias("p")
    )


P_SQL = "SELECT segment_type, segment, sessions, reached_purchase::DOUBLE / sessions AS p FROM seg"
add(
    "e6_power_proportion",
    lambda t: experiment.proportion_power(segment_rates(t), "p", CFG.mde_grid, CFG.alpha, CFG.power),
    sql(
        f"""SELECT segment_type, segment, {n('sessions')} AS sessions, {r('p')} AS p, {r('m')} AS rel_mde,
            CASE WHEN p > 0 THEN {n(f"ceil({o.proportion_units('p', 'm')})")} END AS units_per_arm FROM ({P_SQL}) CROSS JOIN {GRID}""",
        "seg",
    ),
)
add(
    "e6_detectable_lift",
    lambda t: experiment.with_proportion_mde(segment_rates(t), "p", "sessions", CFG.alpha, CFG.power).withColumn(
        # The units the found lift needs are the units given.
        "units_at_mde", F.round(stats.proportion_units(F.col("p"), F.col("rel_mde"), CFG.alpha, CFG.power), 3),
    ).select("segment_type", "segment", "sessions", "rel_mde", "units_at_mde"),
    sql(
        f"""SELECT segment_type, segment, {n('sessions')} AS sessions, CASE WHEN solvable THEN {r('(lo + hi) / 2')} END AS rel_mde,
            CASE WHEN solvable THEN {r('sessions')} END AS units_at_mde
        FROM (WITH RECURSIVE halving AS (
                SELECT *, 1e-6::DOUBLE AS lo, least(50.0, (1 - 1e-9::DOUBLE) / nullif(p, 0) - 1) AS hi, 0 AS i,
                       p > 0 AND {o.proportion_units('p', 'least(50.0, (1 - 1e-9::DOUBLE) / nullif(p, 0) - 1)')} <= sessions
                         AND {o.proportion_units('p', '1e-6::DOUBLE')} >= sessions AS solvable FROM ({P_SQL})
                UNION ALL
                SELECT segment_type, segment, sessions, p,
                       CASE WHEN {o.proportion_units('p', '((lo + hi) / 2)')} > sessions THEN (lo + hi) / 2 ELSE lo END,
                       CASE WHEN {o.proportion_units('p', '((lo + hi) / 2)')} > sessions THEN hi ELSE (lo + hi) / 2 END, i + 1, solvable
                FROM halving WHERE i < 60)
              SELECT * FROM halving WHERE i = 60)""",
        "seg",
    ),
)
add(
    "e7_power_mean",
    lambda t: experiment.mean_power(t.populations, "exp_revenue_usd", CFG.mde_grid, ["population"], CFG.alpha, CFG.power),
    sql(
        f"""SELECT population, {r('mean')} AS mean, {r('variance')} AS variance, {r('m')} AS rel_mde,
            {n(f'ceil(2 * {o.ZA + o.ZP} * {o.ZA + o.ZP} * variance / (mean * m * mean * m))')} AS units_per_arm
        FROM (SELECT population, avg(exp_revenue_usd::DOUBLE) AS mean, var_samp(exp_revenue_usd::DOUBLE) AS variance FROM pops GROUP BY 1) CROSS JOIN {GRID}""",
        "pops",
    ),
)
add(
    "e8_detectable",
    lambda t: experiment.detectable(
        t.populations, Y, N, FIRST, CFG.detectable_windows, ["population"], CFG.alpha, CFG.power
    ),
    sql(
        f"""SELECT population, {r('ratio')} AS ratio, {n('days')} AS days, {n('seen // 2')} AS users_per_arm,
            {r(f'{o.ZA + o.ZP} * sqrt(2 * unit_variance / nullif(seen // 2, 0)) / ratio')} AS rel_mde
        FROM moments JOIN (SELECT p.population, w.days, count(*) FILTER (WHERE p.exp_first_date < s.start + w.days::INTEGER) AS seen
                           FROM pops p JOIN (SELECT population, min(exp_first_date) AS start FROM pops GROUP BY 1) s USING (population)
                           CROSS JOIN (SELECT unnest({list(CFG.detectable_windows)}) AS days) w GROUP BY 1, 2) USING (population)""",
        "moments",
    ),
)


def rate_sql(test: str) -> str:
    hits = f"count(*) FILTER (WHERE abs(z_{test}) > {o.ZA})"
    low, high = o.wilson(hits, "count(*)")
    return f"{r(f'{hits}::DOUBLE / count(*)')} AS fpr_{test}, {low} AS fpr_{test}_low, {high} AS fpr_{test}_high"


AA_SQL = sql(
    f"SELECT {n('count(*)')} AS n_sims, {r(CFG.alpha)} AS alpha, {rate_sql('naive')}, {rate_sql('delta')} FROM aa", "aa"
)
add(
    "e9_aa_replay",
    lambda t: experiment.aa_replay(t.m.user_windows, Y, N, n_sims=CFG.aa_sims, seed=CFG.aa_seed, alpha=CFG.alpha),
    AA_SQL,
)
add(
    "e9_aa_tests",
    lambda t: experiment.aa_tests(
        experiment.aa_contrasts(t.m.user_windows, Y, N, "user_pseudo_id", CFG.aa_sims, CFG.aa_seed)
    ),
    sql(f"SELECT {n('sim')} AS sim, {r('z_delta')} AS z_delta, {r('z_naive')} AS z_naive FROM aa", "aa"),
)
CUPED = """SELECT use, count(*) AS users, covar_samp(y, x) / nullif(var_samp(x), 0) AS theta, corr(y, x) AS corr,
    avg(x) AS mean_x, var_samp(x) AS vx FROM ({0}) GROUP BY 1"""
USES = f"""SELECT 'revenue_all' AS use, exp_revenue_usd::DOUBLE AS y, pre_revenue_usd::DOUBLE AS x FROM uw
    UNION ALL SELECT 'conversions_all', {Y}, pre_sessions FROM uw
    UNION ALL SELECT 'conversions_with_history', {Y}, pre_sessions FROM uw WHERE pre_sessions > 0"""
CUPED_SQL = sql(
    f"""SELECT use, {n('users')} AS users, CASE WHEN vx > 0 THEN {r('theta')} ELSE 0.0::DOUBLE END AS theta,
        CASE WHEN vx > 0 THEN {r('corr * corr')} ELSE 0.0::DOUBLE END AS variance_reduction, CASE WHEN vx > 0 THEN {r('corr')} ELSE 0.0::DOUBLE END AS corr,
        (SELECT {r('avg(CASE WHEN pre_sessions > 0 THEN 1.0 ELSE 0.0 END)')} FROM uw) AS share_with_history
    FROM ({CUPED.format(USES)}) WHERE use <> 'conversions_with_history' OR users > 2""",
    "uw",
)
add("e10_cuped", lambda t: experiment.cuped_uses(t.m.user_windows), CUPED_SQL)
add(
    "e10_adjusted_values",
    lambda t: experiment.with_cuped(t.m.user_windows, "exp_revenue_usd", "pre_revenue_usd").select(
        "user_pseudo_id", "y_adjusted"
    ),
    sql(
        f"""SELECT user_pseudo_id, {r("exp_revenue_usd::DOUBLE - coalesce((SELECT regr_slope(exp_revenue_usd::DOUBLE, pre_revenue_usd::DOUBLE) FROM uw), 0) * (pre_revenue_usd::DOUBLE - (SELECT avg(pre_revenue_usd::DOUBLE) FROM uw))")} AS y_adjusted FROM uw""",
        "uw",
    ),
)


def enrolment(t: Tables) -> DataFrame:
    by = ["population"]
    power = experiment.power_table(experiment.ratio_moments(t.populations, Y, N, by), CFG.mde_grid, CFG.alpha, CFG.power)
    targets = power.select("population", "rel_mde", (F.col("users_per_arm") * 2).alias("needed"))
    return experiment.days_to_reach(experiment.enrolment_curve(t.populations, FIRST, by), targets, "needed", by)


DAYS = """coalesce((SELECT min(c.day_number)::DOUBLE FROM curve c WHERE c.population = p.population AND c.total_users >= 2 * p.users_per_arm),
    e.days + (2 * p.users_per_arm - e.enrolled) / nullif(e.rate, 0), 'inf'::DOUBLE)"""
add(
    "e11_days_to_reach",
    enrolment,
    sql(
        f"""SELECT p.population, {r('p.m')} AS rel_mde, {n('2 * p.users_per_arm')} AS needed, {r(DAYS)} AS days_needed
            FROM power p JOIN curve_end e USING (population)""",
        "power",
        "curve_end",
        "curve",
    ),
)
add(
    "e12_sample_ratio",
    lambda t: experiment.srm_check(split_arms(t.m.user_windows), "arm"),
    sql(
        f"""SELECT {n('a')} AS n_a, {n('b')} AS n_b, {r('chi2')} AS chi2, {r(o.two_sided_p('sqrt(chi2)'))} AS p_value, {o.two_sided_p('sqrt(chi2)')} < 0.001 AS stop
        FROM (SELECT a, b, power(a - (a + b) / 2.0, 2) / ((a + b) / 2.0) + power(b - (a + b) / 2.0, 2) / ((a + b) / 2.0) AS chi2
              FROM (SELECT count(*) FILTER (WHERE arm = 'A')::DOUBLE AS a, count(*) FILTER (WHERE arm = 'B')::DOUBLE AS b FROM split))""",
        "split",
    ),
)


def design(name: str) -> Callable[[Tables], DataFrame]:
    return lambda t: experiment.experiment_design(t.m.user_windows, t.target, CFG)[name]


TARGET_ONLY = f"(SELECT count(*) > 0 FROM gap WHERE z > {o.ZA} AND gap > 0)"
CHOSEN = f"""SELECT CASE WHEN {TARGET_ONLY} AND (SELECT count(*) FROM pops WHERE population = 'segment users') >= {CFG.design_min_users}
    THEN 'segment users' ELSE 'all users' END"""
add(
    "e13_design",
    design("design"),
    sql(
        f"""SELECT (SELECT step FROM (SELECT 0 AS rank, step, extra_purchases * order_value AS weight, step_order FROM gap WHERE z > {o.ZA} AND gap > 0
                UNION ALL SELECT 1, step, 0, step_order FROM ({LEAK})) ORDER BY rank, weight DESC, step_order LIMIT 1) AS target_step,
            population = 'segment users' AS segment_only, CASE population WHEN 'all users' THEN population ELSE 'mobile users' END AS population,
            {n('cnt')} AS window_users, {r('ratio')} AS baseline_rate, {r('mean_n')} AS sessions_per_user,
            (SELECT {n('count(*)')} FROM pops WHERE population = 'segment users') AS segment_users,
            CASE WHEN NOT {TARGET_ONLY} THEN 'no significant gap' WHEN (SELECT count(*) FROM pops WHERE population = 'segment users') < {CFG.design_min_users}
                THEN 'too few users in the segment' ELSE 'the gap is significant' END AS reason
        FROM moments WHERE population = ({CHOSEN})""",
        "moments",
        "gap",
        "steps_reached",
    ),
)
add(
    "e13_power",
    design("power"),
    sql(
        f"""SELECT {r('p.m')} AS rel_mde, users_per_arm, {r(DAYS)} AS days, naive_sessions_per_arm, {r('users_per_arm * mean_n / naive_sessions_per_arm')} AS design_effect
            FROM power p JOIN curve_end e USING (population) WHERE population = ({CHOSEN})""",
        "power",
        "curve_end",
        "curve",
        "gap",
    ),
)


# ---- the results document, of all the above --------------------------------------------------------

#: Block of the document to the query that states it in SQL; the query's columns are compared.
BLOCKS = {
    "summary": "q0_summary",
    "audit": "q_audit_report",
    "headline": "x1_headline",
    "leak": "x4_biggest_leak",
    "target": "x5_target_step",
    "funnel_ordered": "x2_funnel_rates_ordered",
    "funnel_open": "x2_funnel_rates_open",
    "opportunity": "x3_segment_gap",
    "areas": "x6_area_opportunity",
    "area_totals": "x6_area_totals",
    "metric_tree": "x7_metric_tree",
    "peak_week": "x7_peak_week",
    "channels": "x8_channels",
    "retention": "m6_cohort_retention",
    "retention_matrix": "x9_retention_matrix",
    "retention_weighted": "x9_retention_weighted",
    "largest_gap": "x10_largest_gap",
    "quietest_week": "x10_quietest_week",
    "growth_drivers": "x10_growth_drivers",
    "channel_facts": "x10_channel_facts",
    "observed_cohorts": "x10_observed_cohorts",
    "experiment_design": "e13_design",
    "experiment_power": "e13_power",
    "experiment_aa": "e9_aa_replay",
    "experiment_cuped": "e10_cuped",
}


def results_document(t: Tables) -> DataFrame:
    """Every block as (block, row, key, number, text): a row is named by its texts, values are numbers or texts."""
    frames = result_blocks(t.m, t.items, source="export")
    out = []
    for block, key in BLOCKS.items():
        columns = CATALOG[key].frame(t).columns
        df = comparable(frames[block].select(*[F.col(f"`{c}`") for c in columns]))
        texts = sorted(f.name for f in df.schema if isinstance(f.dataType, T.StringType))
        name = F.concat_ws("|", *[F.col(f"`{c}`") for c in texts]) if texts else F.lit("")
        cells = []
        for f in sorted(df.schema, key=lambda f: f.name):
            c = F.col(f"`{f.name}`")
            text = isinstance(f.dataType, T.StringType)
            number = F.lit(None).cast("double") if text else c.cast("int").cast("double") if isinstance(f.dataType, T.BooleanType) else F.nanvl(c.cast("double"), F.lit(None))
            cells.append(F.struct(F.lit(f.name).alias("key"), number.alias("number"), (c if text else F.lit(None).cast("string")).alias("text")))
        out.append(df.select(F.lit(block).alias("block"), name.alias("row"), F.inline(F.array(*cells))))
    plain = [(frames["source"], ["source"]), (frames["baseline_weeks"], ["week_start"])]
    for block, (df, (column,)) in zip(("source", "baseline_weeks"), plain, strict=True):
        text = F.col(column).cast("string")
        out.append(df.select(F.lit(block).alias("block"), text.alias("row"), F.lit(column).alias("key"), F.lit(None).cast("double").alias("number"), text.alias("text")))
    return reduce(DataFrame.unionByName, out)


def _cells(block: str, body: str) -> str:
    """Rows of a statement as cells, whatever its columns are, by way of JSON."""
    return f"""SELECT '{block}' AS block,
        coalesce(array_to_string(list_transform(list_sort(list_filter(map_entries(from_json(j, '"MAP(VARCHAR, JSON)"')), lambda e: json_type(e.value) = 'VARCHAR' AND (e.value ->> '$') <> 'nan')), lambda e: e.value ->> '$'), '|'), '') AS "row",
        c.key, CASE json_type(c.value) WHEN 'BOOLEAN' THEN (c.value::BOOLEAN)::INT::DOUBLE WHEN 'VARCHAR' THEN NULL ELSE nullif(try_cast(c.value AS DOUBLE), 'nan'::DOUBLE) END AS number,
        CASE WHEN json_type(c.value) = 'VARCHAR' THEN nullif(c.value ->> '$', 'nan') END AS text
        FROM (SELECT to_json(q) AS j FROM ({body}) q), LATERAL (SELECT unnest(map_entries(from_json(j, '"MAP(VARCHAR, JSON)"')), recursive := true)) c"""


def results_sql() -> str:
    parts = [_cells(block, CATALOG[key].oracle) for block, key in BLOCKS.items()]
    weeks = sql(f"SELECT {day('week_start')} AS week_start FROM tree WHERE is_baseline", "tree")
    parts += [f"SELECT 'source', 'export', 'source', NULL::DOUBLE, 'export'", f"SELECT 'baseline_weeks', week_start, 'week_start', NULL::DOUBLE, week_start FROM ({weeks})"]
    return "\nUNION ALL\n".join(parts)


add("s17_results_document", results_document, results_sql())


def queries() -> dict[str, Query]:
    return dict(CATALOG)


def oracle_sql() -> dict[str, str]:
    return {key: q.oracle for key, q in CATALOG.items() if q.oracle}
