from __future__ import annotations

import random
from datetime import date, datetime, timedelta

import pytest
from helpers import T0, events, hit, rows
from pyspark.sql import functions as F

from eventlens.config import Config
from eventlens.operators import areas, cohorts, funnel, purchases, segments, staging
from eventlens.operators.crosscheck import differences, first_step, model_totals, next_step, recompute
from eventlens.plans.models import Models

STEPS = Config().steps
VIEW, CHECKOUT, PAY, BUY = STEPS
CFG = Config(
    window_start=date(2024, 1, 1),
    window_end=date(2024, 1, 31),
    experiment_start=date(2024, 1, 8),
    experiment_end=date(2024, 1, 14),
    revenue_reliable_through=date(2024, 1, 14),
    holiday_start=date(2024, 1, 8),
)


def depth_by_hand(times: list[tuple[datetime | None, str]]) -> list[int]:
    """Reference: scan for the first event of each step at or after the step before."""
    reached, t = [], None
    for i, step in enumerate(STEPS):
        found = [ts for ts, name in times if name == step and ts is not None and (i == 0 or (t is not None and ts >= t))]
        t = min(found) if found and (i == 0 or reached[-1]) else None
        reached.append(int(t is not None))
    return reached


def funnel_of(spark, *hits):
    return rows(funnel.session_funnel(staging.placeable_hits(events(spark, *hits)), STEPS), "session_key")


def test_equal_times_count_as_reached(spark):
    got = funnel_of(spark, hit(BUY, 5), hit(PAY, 5), hit(CHECKOUT, 5), hit(VIEW, 5))["u:1"]
    assert [got[f"reached_{s}"] for s in STEPS] == [1, 1, 1, 1]


def test_steps_out_of_order_are_open_but_not_reached(spark):
    got = funnel_of(spark, hit(CHECKOUT, 1), hit(VIEW, 2))["u:1"]
    assert [got[f"reached_{s}"] for s in STEPS] == [1, 0, 0, 0]
    assert [got[f"any_{s}"] for s in STEPS] == [1, 1, 0, 0]


def test_first_qualifying_event_counts_not_the_first_event(spark):
    got = funnel_of(spark, hit(CHECKOUT, 1), hit(VIEW, 2), hit(CHECKOUT, 4000), hit(PAY, 90_000), hit(BUY, 90_001))["u:1"]
    assert [got[f"reached_{s}"] for s in STEPS] == [1, 1, 1, 1]


def test_missing_time_is_open_only(spark):
    got = funnel_of(spark, hit(VIEW, None))["u:1"]
    assert (got["any_view_item"], got["reached_view_item"]) == (1, 0)


def test_sessions_without_funnel_events_have_no_row(spark):
    assert funnel_of(spark, hit("page_view", 1)) == {}


@pytest.mark.parametrize("seed", range(3))
def test_funnel_and_join_chain_against_brute_force(spark, seed):
    """Random sessions, many ties, spans from one second to days, one session with half of all rows."""
    rng = random.Random(seed)
    hits, by_session = [], {}
    for s in range(60):
        span = rng.choice([2, 30, 4_000, 200_000])
        for _ in range(400 if s == 0 else rng.randint(1, 8)):
            ts = T0 + timedelta(seconds=rng.randint(0, span), microseconds=rng.choice([0, 0, 250_000]))
            name = rng.choice(STEPS)
            hits.append(hit(name, ts, session=s))
            by_session.setdefault(f"u:{s}", []).append((ts, name))
    raw = events(spark, *hits)
    got = funnel_of(spark, *hits)
    assert {k: [r[f"reached_{s}"] for s in STEPS] for k, r in got.items()} == {
        k: depth_by_hand(v) for k, v in by_session.items()
    }
    independent = {r["metric"]: r["value"] for r in recompute(raw, STEPS).collect()}
    for i, step in enumerate(STEPS):
        assert independent[f"reached_{step}"] == sum(depth_by_hand(v)[i] for v in by_session.values())


def test_any_number_of_steps(spark):
    steps = [f"s{i}" for i in range(9)]
    hits = staging.placeable_hits(events(spark, *[hit(s, i * 700) for i, s in enumerate(steps)]))
    got = funnel.session_funnel(hits, steps).first()
    assert all(got[f"reached_{s}"] == 1 for s in steps)
    two = funnel.session_funnel(hits, steps[:2]).first()
    assert two["reached_s1"] == 1


def test_chain_finds_the_first_hit_at_or_after(spark):
    raw = events(spark, hit(VIEW, 100), hit(CHECKOUT, 50), hit(CHECKOUT, 100), hit(CHECKOUT, 9_000))
    named = raw.select(F.lit("k").alias("k"), "event_name", "event_ts")
    found = next_step(named.filter(F.col("event_name") == CHECKOUT).select("k", "event_ts"), first_step(named, STEPS)).first()
    assert found["t"] == T0 + timedelta(seconds=100) and found["reached"] == 2


def test_chain_with_wrong_clocks_and_a_hot_hour(spark):
    """Hits decades apart and an hour with most of the rows: as many rows as there are hours with events, and the same counts."""
    years = 3600 * 24 * 365
    hits = [hit(VIEW, -51 * years), hit(VIEW, 10), hit(CHECKOUT, 79 * years), hit(CHECKOUT, -51 * years - 5)]
    hits += [hit(VIEW, k) for k in range(300)] + [hit(CHECKOUT, k) for k in range(300, 340)]
    raw = events(spark, *hits)
    named = raw.select(F.lit("k").alias("k"), "event_name", "event_ts")
    start = first_step(named, STEPS).first()
    assert len(start["hours"]) == 3 and start["reached"] == 1
    got = {r["metric"]: r["value"] for r in recompute(raw, STEPS).collect()}
    assert got[f"reached_{VIEW}"] == got[f"reached_{CHECKOUT}"] == got["sessions"] == 1


def test_the_cross_check_needs_few_scans_and_joins(spark, adapted):
    plan = recompute(adapted["events"], STEPS)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") <= 5 and plan.count("Join [") <= 3 and "sequence(" not in plan


def test_staging_drops_copies_and_unplaceable_rows(spark):
    raw = events(spark, hit(at=1), hit(at=1), hit(at=2), hit(at=3, user=None), hit(at=3, session=None))
    assert staging.stage_events(raw).count() == 2
    assert staging.placeable_hits(raw).count() == 3


def test_resent_purchases_merge_and_missing_ids_group(spark):
    raw = events(
        spark,
        hit(BUY, 1, transaction_id="A", purchase_revenue_usd=10.0),
        hit(BUY, 2, transaction_id="A", purchase_revenue_usd=10.0),
        hit(BUY, 3, transaction_id="A", purchase_revenue_usd=11.0),
        hit(BUY, 4, transaction_id=None, purchase_revenue_usd=5.0),
        hit(BUY, 5, transaction_id=None, purchase_revenue_usd=5.0),
        hit(BUY, 6, transaction_id=None, purchase_revenue_usd=None),
    )
    got = {
        (r["transaction_id"], None if r["purchase_revenue_usd"] is None else float(r["purchase_revenue_usd"])): r
        for r in purchases.purchases(staging.stage_events(raw)).collect()
    }
    assert {k: r["n_rows"] for k, r in got.items()} == {("A", 10.0): 2, ("A", 11.0): 1, (None, 5.0): 2, (None, None): 1}
    assert got[("A", 10.0)]["purchase_ts"] == T0 + timedelta(seconds=1)


def sessions_of(spark, *hits):
    return rows(Models(events(spark, *hits), CFG).sessions, "session_key")


def test_session_row(spark):
    got = sessions_of(
        spark,
        hit("page_view", datetime(2024, 1, 7, 23, 59), device_category=None, session_engaged="0"),
        hit("page_view", datetime(2024, 1, 7, 23, 59), device_category=None, session_engaged="0"),
        hit(VIEW, datetime(2024, 1, 8, 0, 1), device_category="mobile", session_engaged="1"),
        hit(BUY, datetime(2024, 1, 8, 0, 2), transaction_id="T", purchase_revenue_usd=0.1),
        hit(BUY, datetime(2024, 1, 8, 0, 3), transaction_id="T2", purchase_revenue_usd=0.2),
    )["u:1"]
    assert str(got["session_date"]) == "2024-01-07" and str(got["week_start"]) == "2024-01-01"
    assert got["device_category"] == "mobile" and got["engaged"] == 1
    assert got["page_views"] == 1, "the copy must not count"
    assert got["purchases"] == 2 and str(got["revenue_usd"]) == "0.300000"
    assert got["any_purchase"] == 1 and got["reached_purchase"] == 0 and got["is_first_session"] is True


def test_session_without_purchase_is_filled_with_zero(spark):
    got = sessions_of(spark, hit("scroll", 1))["u:1"]
    assert [got[c] for c in ("purchases", "revenue_usd", "page_views", "reached_view_item", "any_purchase")] == [0] * 5


def test_source_and_medium_may_come_from_different_hits(spark):
    got = sessions_of(
        spark,
        hit(at=1, session_source="google"),
        hit(at=2, session_medium="organic"),
        hit(at=3, session_source="z", session_medium="email"),
    )["u:1"]
    assert got["channel"] == "Organic Search"


@pytest.mark.parametrize("number,expected", [(1, "Email"), (2, "Unknown"), (None, "Unknown")])
def test_first_touch_stands_in_on_the_first_session_only(spark, number, expected):
    got = sessions_of(spark, hit(at=1, number=number, ft_source="n", ft_medium="email"))["u:1"]
    assert got["channel"] == expected


def test_segments_cover_all_cuts_and_keep_null(spark):
    m = Models(
        events(spark, hit(at=1), hit(at=2, user="v", device_category="mobile", number=3), hit(at=3, user="v", session=2)),
        CFG,
    )
    got = rows(m.funnel_segments, "segment_type", "segment")
    assert (got[("all", "all")]["sessions"], got[("all", "all")]["users"]) == (3, 2)
    assert got[("device", "(null)")]["sessions"] == 2 and got[("device", "mobile")]["users"] == 1
    assert got[("user_type", "new")]["sessions"] == 2 and got[("user_type", "returning")]["sessions"] == 1
    only = segments.funnel_segments(m.sessions, STEPS, {"country": F.col("country")})
    assert [r["segment"] for r in only.collect()] == ["(null)"]


def at(day: int, hour: int = 12) -> datetime:
    return datetime(2024, 1, day, hour)


def test_weeks_are_flagged_by_coverage_and_reliability(spark):
    m = Models(events(spark, *[hit(BUY, at(d), session=d, purchase_revenue_usd=2.0) for d in (3, 8, 14, 15, 18)]), CFG)
    got = rows(m.weekly_metrics.withColumn("w", F.col("week_start").cast("string")), "w")
    assert [(k, r["days_observed"], r["is_full_week"], r["revenue_complete"]) for k, r in sorted(got.items())] == [
        ("2024-01-01", 5, False, True),
        ("2024-01-08", 7, True, True),
        ("2024-01-15", 4, False, False),
    ]
    w = got["2024-01-08"]
    assert (w["users"], w["sessions"], w["transactions"], float(w["revenue_usd"])) == (1, 2, 2, 4.0)
    assert (w["sessions_per_user"], w["conversion"], w["aov"]) == (2.0, 1.0, 2.0)


def test_cohorts_are_censored_on_both_sides(spark):
    hits = [
        hit(at=at(1, 0), user="a", session=1, number=1),
        hit(BUY, at(9), user="a", session=2, number=2, purchase_revenue_usd=1.0),
        hit(at=at(2), user="b", session=1, number=1),
        hit(at=at(3), user="old", session=1, number=5),
        hit(at=at(10), user="old", session=2, number=6),
        hit(at=at(4), user="nonumber", session=1, number=None),
        hit(at=at(21), user="c", session=1, number=1),
        hit(at=at(22, 1), user="a", session=3, number=3),
    ]
    got = rows(
        Models(events(spark, *hits), CFG).cohort_retention.withColumn("c", F.col("cohort_week").cast("string")),
        "c",
        "week_offset",
    )
    # The week of the 22nd holds one day: neither a cohort week nor an activity week.
    assert sorted(got) == [("2024-01-01", 0), ("2024-01-01", 1), ("2024-01-01", 2), ("2024-01-15", 0)]
    assert [(got[("2024-01-01", k)]["active_users"], got[("2024-01-01", k)]["purchasing_users"]) for k in range(3)] == [
        (2, 0),
        (1, 1),
        (0, 0),
    ]
    assert got[("2024-01-01", 1)]["retention"] == 0.5


def test_one_user_with_most_sessions_counts_once_a_week(spark):
    hits = [hit(at=at(1 + i % 14, i % 24), user="bot", session=i, number=i + 1) for i in range(300)]
    weeks = cohorts.user_weeks(Models(events(spark, *hits), CFG).sessions).collect()
    assert len(weeks) == 2 and {str(r["cohort_week"]) for r in weeks} == {"2024-01-01"}


def test_sections_follow_the_first_view_and_reliable_days(spark):
    bags, caps = "https://s/Google+Redesign/Bags", "https://s/Google+Redesign/Caps"
    chain = [(VIEW, 1), (CHECKOUT, 2), (PAY, 3), (BUY, 4)]

    def visit(session, day, page):
        return [
            hit(n, at(day) + timedelta(seconds=s), session=session, page_location=page, purchase_revenue_usd=7.0 if n == BUY else None)
            for n, s in chain
        ]

    m = Models(
        events(
            spark,
            *visit(1, 10, bags),
            *visit(2, 20, bags),
            hit(VIEW, at(11), session=3, page_location=caps),
            hit(VIEW, at(11) + timedelta(seconds=5), session=3, page_location=bags),
            hit(VIEW, at(11), session=4),
        ),
        CFG,
    )
    got = rows(m.area_funnel, "entry_area")
    assert set(got) == {"Bags", "Caps", "Unknown"}
    b = got["Bags"]
    assert (b["sessions"], b["checkouts"], b["purchase_sessions"], b["purchase_sessions_reliable"]) == (2, 2, 2, 1)
    assert float(b["revenue_reliable_usd"]) == 7.0 and float(got["Caps"]["revenue_reliable_usd"]) == 0.0
    assert areas.entry_areas(m.hits, VIEW).count() == 4


def test_user_windows(spark):
    m = Models(
        events(
            spark,
            hit(BUY, at(2), session=1, purchase_revenue_usd=3.0, device_category="tablet"),
            hit(at=at(8), session=2, device_category="mobile"),
            hit(BUY, at(14), session=3, purchase_revenue_usd=4.0),
            hit(at=at(15), session=4),
            hit(at=at(2), user="only before"),
        ),
        CFG,
    )
    got = rows(m.user_windows, "user_pseudo_id")
    assert set(got) == {"u"}
    u = got["u"]
    assert u["device_category"] == "tablet" and str(u["exp_first_date"]) == "2024-01-08"
    assert (u["pre_sessions"], u["pre_purchases"], float(u["pre_revenue_usd"])) == (1, 1, 3.0)
    assert (u["exp_sessions"], u["exp_converting_sessions"], u["exp_purchases"], float(u["exp_revenue_usd"])) == (2, 1, 1, 4.0)


def test_cross_check_agrees_and_reports_a_difference(spark):
    raw = events(
        spark,
        hit(VIEW, 1),
        hit(CHECKOUT, 2),
        hit(BUY, 3, purchase_revenue_usd=1.5),
        hit(BUY, 4, purchase_revenue_usd=1.5),
        hit(VIEW, 1, session=None),
    )
    m = Models(raw, CFG)
    models = model_totals(m.funnel_segments, STEPS)
    assert differences(recompute(raw, STEPS), models).count() == 0
    wrong = models.withColumn("value", F.when(F.col("metric") == "purchases", 2.0).otherwise(F.col("value")))
    assert [r["metric"] for r in differences(recompute(raw, STEPS), wrong).collect()] == ["purchases"]


def test_weekly_identity_holds(spark, adapted):
    from eventlens.catalog import adapter

    m = Models(adapted["events"], adapter.CONFIG)
    for r in m.weekly_metrics.filter("transactions > 0").collect():
        product = r["users"] * r["sessions_per_user"] * r["conversion"] * r["aov"]
        assert product == pytest.approx(float(r["revenue_usd"]), rel=1e-9)


def test_first_touch_reduces_rows_without_a_sort(spark, adapted):
    """Raw rows meet hash aggregates only; what is sorted has been reduced and shuffled before."""
    from eventlens.operators import sessions, staging

    df = sessions.session_attributes(staging.placeable_hits(adapted["events"]))
    plan = df._jdf.queryExecution().sparkPlan().toString()
    steps = [line.strip(" :+-*()0123456789").split("(")[0].split(" ")[0] for line in plan.splitlines() if line.strip()]
    first, last = min(steps.index("HashAggregate"), len(steps)), max(k for k, s in enumerate(steps) if s == "HashAggregate")
    assert steps.count("HashAggregate") == 2 and not any(s.startswith("Sort") for s in steps[first:]), steps
    assert last > max(k for k, s in enumerate(steps) if s.startswith("SortAggregate"))


def test_first_touch_against_a_walk_over_rows(spark):
    """Ties, NULL times, NULL values, copies, and values that come and go."""
    import random

    from eventlens.operators.first_touch import first_touch

    rng = random.Random(2)
    rows = [(rng.choice("abc"), rng.choice([None, 1, 1, 2, 3]), rng.choice([None, "x", "y", ""]), rng.choice([None, "p", "q"]), rng.randint(0, 9)) for _ in range(300)]
    rows += rows[:40] + [("d", None, "x", "p", 1), ("e", 1, None, None, 2)]
    df = spark.createDataFrame(rows, "k string, t int, v string, w string, n int").repartition(3)
    got = {r.k: (r.t, r.v, r.w, r.most, r.all) for r in first_touch(df, ["k"], ["v", "w"], "t", {"most": (F.max("n"), F.max), "all": (F.sum("n"), F.sum)}).collect()}
    want = {}
    for k in {r[0] for r in rows}:
        own = [r for r in rows if r[0] == k]
        firsts = [min(((r[1], r[c]) for r in own if r[1] is not None and r[c] is not None), default=(None, None))[1] for c in (2, 3)]
        want[k] = (min((r[1] for r in own if r[1] is not None), default=None), *firsts, max(r[4] for r in own), sum(r[4] for r in own))
    assert got == want
