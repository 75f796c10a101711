"""All models of one events table, lazily composed or built table by table."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame

from eventlens.config import Config
from eventlens.operators import areas, cohorts, funnel, purchases, segments, sessions, staging, user_windows, weekly


@dataclass
class Models:
    """Lazy frames. Each is a plan over the raw table until ``build`` writes it.

    Minima, maxima and flags read ``hits`` (copies still in, no shuffle); only page
    views and purchases, which are counts, read the de-duplicated ``stg_events``, and
    their event filter is pushed below the de-duplication. The whole table is never
    shuffled to answer a session question. With ``counted`` (``staging.row_counts``, written) nothing is
    de-duplicated again.
    """

    events: DataFrame
    cfg: Config
    counted: DataFrame | None = None

    @property
    def rows(self) -> DataFrame:
        """Raw rows, or the distinct ones with their copies where these are written."""
        return self.events if self.counted is None else self.counted

    @cached_property
    def hits(self) -> DataFrame:
        return staging.placeable_hits(self.events) if self.counted is None else self.stg_events

    @cached_property
    def stg_events(self) -> DataFrame:
        return staging.stage_events(self.events) if self.counted is None else staging.staged_from_counts(self.counted)

    @cached_property
    def purchases(self) -> DataFrame:
        return purchases.purchases(self.stg_events)

    @cached_property
    def session_funnel(self) -> DataFrame:
        return funnel.session_funnel(self.hits, self.cfg.steps)

    @cached_property
    def sessions(self) -> DataFrame:
        return sessions.sessions(
            self.stg_events, self.purchases, self.session_funnel, self.cfg.steps, hits=self.hits
        )

    @cached_property
    def funnel_segments(self) -> DataFrame:
        return segments.funnel_segments(self.sessions, self.cfg.steps)

    @cached_property
    def weekly_metrics(self) -> DataFrame:
        return weekly.weekly_metrics(self.sessions, self.cfg.revenue_reliable_through)

    @cached_property
    def cohort_retention(self) -> DataFrame:
        return cohorts.cohort_retention(self.sessions)

    @cached_property
    def area_funnel(self) -> DataFrame:
        return areas.area_funnel(
            self.hits,
            self.sessions,
            self.cfg.revenue_reliable_through,
            view_step=self.cfg.steps[0],
            checkout_step=self.cfg.steps[1],
            purchase_step=self.cfg.steps[-1],
        )

    @cached_property
    def user_windows(self) -> DataFrame:
        return user_windows.user_windows(self.sessions, self.cfg.experiment_start, self.cfg.experiment_end)
