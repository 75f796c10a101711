"""Every parameter a job depends on, in one immutable object."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date


@dataclass(frozen=True)
class Config:
    # The default funnel, windows, thresholds and grids. They have
    # to stay as they are for results on the default export to be comparable.
    steps: tuple[str, ...] = ("view_item", "begin_checkout", "add_payment_info", "purchase")
    window_start: date = date(2020, 11, 1)
    window_end: date = date(2021, 1, 31)
    experiment_start: date = date(2021, 1, 4)
    experiment_end: date = date(2021, 1, 24)
    revenue_reliable_through: date = date(2021, 1, 25)
    holiday_start: date = date(2020, 11, 23)
    area_min_sessions: int = 1_000
    area_min_sections: int = 3
    broken_min_checkouts: int = 30
    small_sample: int = 1_000
    coverage_min_sessions: int = 50
    bad_day_min_purchases: int = 10
    mde_grid: tuple[float, ...] = (0.05, 0.10, 0.15, 0.20)
    detectable_windows: tuple[int, ...] = (7, 14, 21)
    retention_offsets: tuple[int, ...] = (1, 2, 4, 8)
    alpha: float = 0.05
    power: float = 0.80
    gap_pair: tuple[str, str] = ("mobile", "desktop")
    design_min_users: int = 1_000
    aa_sims: int = 1_000
    aa_seed: int = 11

    def __post_init__(self) -> None:
        if len(self.steps) < 2:
            raise ValueError("a funnel needs at least two steps")
        if self.window_end < self.window_start or self.experiment_end < self.experiment_start:
            raise ValueError("a window must not end before it starts")

    @property
    def expected_days(self) -> int:
        return (self.window_end - self.window_start).days + 1
