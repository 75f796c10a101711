"""Models grown by days are the models of all days at once."""

from __future__ import annotations

import random
from datetime import date, datetime, timedelta

import pytest
from helpers import events, hit

from eventlens.catalog import adapter
from eventlens.config import Config
from eventlens.plans.incremental import Incremental
from eventlens.plans.models import Models
from eventlens.sources.daystore import DayStore

NAMES = ("session_funnel", "purchases", "sessions", "funnel_segments", "weekly_metrics", "cohort_retention", "area_funnel", "user_windows")
CFG = Config(window_start=date(2024, 1, 1), window_end=date(2024, 1, 4), experiment_start=date(2024, 1, 2), experiment_end=date(2024, 1, 3), revenue_reliable_through=date(2024, 1, 3))


def differences(grown: Models, whole: Models) -> dict[str, int]:
    out = {}
    for name in NAMES:
        a, b = getattr(grown, name), getattr(whole, name)
        b = b.select(*a.columns)
        assert [f.dataType for f in a.schema] == [f.dataType for f in b.schema], name
        out[name] = a.exceptAll(b).count() + b.exceptAll(a).count()
    return out


def crossing(spark):
    """Sessions over midnight, over three days, with copies, without times, and one whose export days overlap on the clock."""
    rng, rows = random.Random(7), []
    steps = (*CFG.steps, "page_view", "scroll")
    for user in range(25):
        for session in range(2):
            start = datetime(2024, 1, 1 + rng.randint(0, 2), rng.choice([1, 12, 23]), 50)
            for _ in range(rng.randint(1, 14)):
                at = start + timedelta(minutes=rng.randint(0, 90) + 1440 * rng.choice([0, 0, 0, 1]))
                more = {"transaction_id": rng.choice([None, "T"]), "purchase_revenue_usd": rng.choice([None, 5.0])}
                row = hit(rng.choice(steps), at, f"u:{user}", session, rng.choice([None, 1, 2]), device_category=rng.choice([None, "mobile", "desktop"]),
                          session_source=rng.choice([None, "google"]), page_location=rng.choice([None, "https://x/a/b", "https://x/store.html"]), session_engaged=rng.choice([None, "1"]), **more)
                rows += [row] * rng.choice([1, 1, 2])
    late = hit("purchase", datetime(2024, 1, 1, 12, 0, 30), "late", 1, 1, purchase_revenue_usd=9.0)
    late["event_date"] = date(2024, 1, 3)  # sent two days later: its day is not its clock's
    rows += [hit("view_item", datetime(2024, 1, 1, 12), "late"), hit("begin_checkout", datetime(2024, 1, 1, 12, 0, 10), "late"), hit("add_payment_info", datetime(2024, 1, 1, 12, 1), "late"), hit("add_payment_info", datetime(2024, 1, 1, 12, 0, 20), "late"), late]
    rows += [hit("view_item", None, "untimed"), hit("page_view", None, "untimed"), hit(user=None), hit(session=None)]
    return events(spark, *rows)


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("crossing") / "events")
    crossing(spark).coalesce(2).write.parquet(path)
    return spark.read.parquet(path)


def test_day_by_day_is_the_full_build(spark, stored, tmp_path):
    inc = Incremental(spark, str(tmp_path), CFG)
    days = sorted(r[0] for r in stored.select("event_date").distinct().collect())
    assert len(days) >= 4
    touched = [inc.update(stored, [d]) for d in days]
    whole = Models(stored, CFG)
    assert set(differences(inc.models(stored), whole).values()) == {0}
    assert whole.sessions.filter("session_key = 'late:1'").first()["reached_purchase"] == 1
    # A day rewrites the days on which its sessions start, not those before.
    assert set(touched[-1]) < set(inc.store.runs("sessions")) and len(touched[-1]) <= 3


def test_a_day_said_again_replaces_itself(spark, stored, tmp_path):
    inc = Incremental(spark, str(tmp_path), CFG)
    days = sorted(r[0] for r in stored.select("event_date").distinct().collect())
    inc.update(stored, days)
    less = stored.filter("event_date <> '2024-01-02' OR (user_pseudo_id > 'u:2' AND event_name <> 'view_item')")
    inc.update(less, [date(2024, 1, 2)])
    assert set(differences(inc.models(less), Models(less, CFG)).values()) == {0}
    assert Models(less, CFG).sessions.count() < Models(stored, CFG).sessions.count(), "some sessions are gone"


def test_a_new_day_opens_no_raw_row_of_another(spark, adapted, tmp_path):
    """Sessions go on from their states: raw rows of earlier days may be gone."""
    inc = Incremental(spark, str(tmp_path), adapter.CONFIG)
    events_, cut = adapted["events"], date(2024, 1, 25)
    days = [date(2024, 1, 1) + timedelta(days=k) for k in range(50)]
    inc.update(events_.filter(events_.event_date < cut), [d for d in days if d < cut])
    inc.update(events_.filter(events_.event_date >= cut), [d for d in days if d >= cut])
    assert set(differences(inc.models(events_), Models(events_, adapter.CONFIG)).values()) == {0}


def test_a_commit_is_seen_whole(spark, tmp_path):
    from pyspark.sql import functions as F

    store = DayStore(spark, str(tmp_path))
    rows = spark.createDataFrame([(1, date(2024, 1, 1)), (2, date(2024, 1, 2)), (3, None)], "x int, day date")
    assert store.read("t", rows.schema).count() == 0
    store.write(rows, "t", "a")
    assert store.read("t", rows.schema).count() == 0, "written and not named yet"
    store.commit("a", {"t": [date(2024, 1, 1), date(2024, 1, 2), None]})
    store.write(rows.filter("x = 2").withColumn("x", F.lit(20)), "t", "b")
    store.commit("b", {"t": [date(2024, 1, 2), None]})
    assert sorted(r.x for r in store.read("t", rows.schema).collect()) == [1, 20]  # the day without a date is empty now
    assert [r.x for r in store.read("t", rows.schema, [date(2024, 1, 1)]).collect()] == [1]
