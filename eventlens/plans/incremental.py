"""Models that grow by days: new days touch their own rows and the sessions they continue."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from eventlens.config import Config
from eventlens.operators import areas, funnel, sessions, staging, states
from eventlens.plans.models import Models
from eventlens.schema import EVENTS
from eventlens.sources import sinks
from eventlens.sources.daystore import DayStore

STATES, ORDERS, SESSIONS = "states", "orders", "sessions"


class Incremental:
    """Session states and purchases by day of the export, sessions by the day they start in, all in one ``DayStore``.

    ``update`` reads the raw rows of its days, the states of the sessions in them, and the session table on those days on which
    such a session starts or started. Everything else stays as it is, in the files it is in. A day that comes again replaces
    what it said before. Which earlier days hold a session of the new ones is asked of the key column of the states alone.
    """

    def __init__(self, spark: SparkSession, root: str, cfg: Config):
        self.spark, self.cfg = spark, cfg
        self.store = DayStore(spark, root)
        nothing = spark.createDataFrame([], EVENTS)
        self.states_schema = states.day_states(nothing, cfg.steps).schema
        self.orders_schema = states.day_orders(nothing).schema
        told = states.merged(spark.createDataFrame([], self.states_schema), cfg.steps)
        self.merged_schema = told.schema
        self.sessions_schema = self._rows(told, spark.createDataFrame([], self.orders_schema), nothing).schema

    def _read(self, table: str, schema: StructType, days: Sequence[date | None] | None = None) -> DataFrame:
        return self.store.read(table, StructType(list(schema.fields)), days)

    def _rows(self, told: DataFrame, day_orders: DataFrame, raw: DataFrame | None) -> DataFrame:
        """Session rows, with ``path`` (of the entry page) and ``day`` (they start in). ``raw``: hits of sessions whose days overlap, if any do."""
        steps = self.cfg.steps
        walked = states.funnel_of(told.filter("NOT overlaps"), steps)
        if raw is not None:
            again = told.filter("overlaps").select("session_key")
            hits = staging.placeable_hits(raw).join(again, "session_key", "left_semi")
            walked = walked.unionByName(funnel.session_funnel(hits, steps))
        views = told.filter("page_views IS NOT NULL").select("session_key", "page_views")
        base = told.drop("page_views", "entry", "seen", "depth", "overlaps")
        made = sessions.from_parts(base, walked, views, states.merged_orders(day_orders), steps)
        paths = told.select("session_key", F.col("entry.value").alias("path"))
        return made.join(paths, "session_key").withColumn("day", F.col("session_date"))

    def update(self, raw: DataFrame, days: Sequence[date]) -> list[date | None]:
        """Take in ``days`` of ``raw`` (all of its rows may be given). Returns the start days of sessions that were written."""
        store, run = self.store, uuid4().hex
        new = raw.filter(F.col("event_date").isin(*days))
        store.write(states.day_states(new, self.cfg.steps), STATES, run)
        store.write(states.day_orders(new), ORDERS, run)
        written = {t: self.spark.read.schema(s).parquet(f"{store.root}/{t}/run={run}") for t, s in ((STATES, self.states_schema), (ORDERS, self.orders_schema))}
        before = self._read(STATES, self.states_schema)
        keys = written[STATES].select("session_key").unionByName(before.filter(F.col("day").isin(*days)).select("session_key")).distinct()
        # Rows of the calendar, from key columns.
        held = [r[0] for r in before.select("session_key", "day").join(keys, "session_key", "left_semi").select("day").distinct().collect()]
        mine = self._read(STATES, self.states_schema, held).join(keys, "session_key", "left_semi")
        earlier = mine.filter(~F.col("day").isin(*days))
        rows = earlier.unionByName(written[STATES])
        orders = self._read(ORDERS, self.orders_schema, held).filter(~F.col("day").isin(*days)).join(keys, "session_key", "left_semi")
        scratch = f"{store.root}/scratch/run={run}"
        told = sinks.materialise(states.merged(rows, self.cfg.steps), f"{scratch}/merged")
        # Raw rows of other days are opened only for sessions whose days overlap in time.
        hits = None if told.filter("overlaps").isEmpty() else raw.filter(F.col("event_date").isin(*{*days, *held}))
        fresh = sinks.materialise(self._rows(told, orders.unionByName(written[ORDERS]), hits), f"{scratch}/sessions")
        left = mine.groupBy("session_key").agg(F.to_date(F.min("session_start_ts")).alias("day"))
        touched = [r[0] for r in left.select("day").unionByName(fresh.select("day")).distinct().collect()]
        kept = self._read(SESSIONS, self.sessions_schema, touched).join(keys, "session_key", "left_anti")
        store.write(kept.unionByName(fresh), SESSIONS, run)
        store.commit(run, {STATES: days, ORDERS: days, SESSIONS: touched})
        sinks.remove(self.spark, scratch)
        return touched

    def models(self, events: DataFrame) -> Models:
        """All models over what is stored. ``events`` is only for what asks for raw rows."""
        m, steps = Models(events, self.cfg), self.cfg.steps
        stored = self._read(SESSIONS, self.sessions_schema)
        m.sessions = stored.drop("path", "day")
        m.purchases = states.merged_orders(self._read(ORDERS, self.orders_schema))
        flags = [f"{kind}_{s}" for kind in ("any", "reached") for s in steps]
        seen = sum((F.col(f"any_{s}") for s in steps[1:]), F.col(f"any_{steps[0]}")) > 0
        m.session_funnel = stored.filter(seen).select("session_key", *flags)
        # A session without a view of a product has no path and no section.
        entries = stored.filter(F.col(f"any_{steps[0]}") == 1).select("session_key", "path")
        m.area_funnel = areas.area_rates(areas.sections(entries), m.sessions, self.cfg.revenue_reliable_through, steps[0], steps[1], steps[-1])
        return m
