from __future__ import annotations

import math
from datetime import date

import pytest
from helpers import rows

from eventlens.config import Config
from eventlens.operators import analysis

STEPS = ("a", "b", "c")
SEG = (
    "segment_type string, segment string, sessions long, users long, reached_a long, any_a long, reached_b long, any_b long,"
    " reached_c long, any_c long, engaged_sessions long, purchases long, revenue_usd decimal(38,6)"
)


def segments(spark, *extra):
    from decimal import Decimal

    base = [
        ("all", "all", 3000, 900, 1500, 1500, 300, 400, 60, 80, 2000, 70, Decimal(700)),
        ("device", "desktop", 1000, 400, 500, 500, 150, 200, 38, 50, 800, 45, Decimal(450)),
        ("device", "mobile", 2000, 500, 1000, 1000, 150, 200, 20, 30, 1200, 25, Decimal(250)),
        ("channel", "Direct", 2000, 500, 0, 0, 0, 0, 0, 40, 1000, 40, Decimal(400)),
        ("channel", "Email", 980, 380, 0, 0, 0, 0, 0, 38, 990, 28, Decimal(290)),
        ("channel", "Other", 20, 20, 0, 0, 0, 0, 0, 2, 10, 2, Decimal(10)),
    ]
    return spark.createDataFrame([*base, *extra], SEG)


def test_headline_and_unknown_segment(spark):
    h = analysis.headline(segments(spark)).first()
    assert (h["sessions"], h["transactions"], h["aov"]) == (3000, 70, 10.0)
    with pytest.raises(Exception, match="no device=watch segment"):
        analysis.headline(segments(spark), "device", "watch").collect()


def test_funnel_rates(spark):
    got = rows(analysis.funnel_rates(segments(spark), STEPS), "segment", "step")
    assert got[("all", "a")]["step_rate"] == 0.5 and got[("all", "c")]["from_start"] == 0.02
    assert got[("all", "b")]["step_rate"] == 0.2
    assert math.isnan(got[("Direct", "b")]["step_rate"]) and math.isnan(got[("Direct", "b")]["ci_low"])
    opened = rows(analysis.funnel_rates(segments(spark), STEPS, "any"), "segment", "step")
    assert opened[("all", "b")]["sessions"] == 400


def test_gap_is_sized_to_purchases_and_revenue(spark):
    got = rows(analysis.segment_gap(segments(spark), STEPS), "step")
    b = got["b"]
    assert (b["rate_a"], b["rate_b"]) == (0.15, 0.3) and b["significant"] and b["p_value"] < 1e-6
    # 1000 visits x gap x the share that goes on to buy, at 10 an order.
    assert b["extra_purchases"] == pytest.approx(1000 * 0.15 * 20 / 150)
    assert b["extra_revenue_usd"] == pytest.approx(200.0)
    assert got["a"]["gap"] == 0 and not got["a"]["significant"]


def test_steps_without_a_base_are_left_out(spark):
    flat = segments(spark).replace({150: 0}, subset=["reached_b"])
    assert set(rows(analysis.segment_gap(flat, STEPS), "step")) == {"a"}


def test_target_is_the_largest_significant_gap_else_the_leak(spark):
    rates = analysis.funnel_rates(segments(spark).filter("segment = 'all'"), STEPS)
    assert analysis.biggest_leak(rates).first()["step"] == "b"
    gap = analysis.segment_gap(segments(spark), STEPS)
    got = analysis.target_step(gap, rates).first()
    best = max((r for r in gap.collect() if r["significant"]), key=lambda r: r["extra_revenue_usd"])
    assert (got["step"], got["segment_only"]) == (best["step"], True)
    none = analysis.target_step(gap.filter("false"), rates).first()
    assert (none["step"], none["segment_only"]) == ("b", False)


def test_channels_and_their_facts(spark):
    table = analysis.channels(segments(spark), "c", small_sample=100)
    got = rows(table, "channel")
    assert got["Direct"]["share"] == pytest.approx(2 / 3) and got["Other"]["small_sample"]
    assert got["Email"]["conversion"] == pytest.approx(38 / 980)
    facts = analysis.channel_facts(table).first()
    assert (facts["best_channel"], facts["worst_channel"], facts["small_but_better"]) == ("Email", "Direct", "Other")
    assert analysis.channel_facts(table.filter("channel <> 'Email'")).count() == 0


AREA = (
    "entry_area string, sessions long, checkouts long, purchase_sessions long, purchase_sessions_reliable long,"
    " revenue_reliable_usd decimal(38,6)"
)


def areas(spark, *weak):
    from decimal import Decimal

    data = [
        ("Bags", 2000, 300, 120, 100, Decimal(5000)),
        ("Shop+by+Brand", 4000, 640, 300, 250, Decimal(9000)),
        ("store.html", 1000, 150, 60, 60, Decimal(3000)),
        ("tiny", 10, 9, 9, 9, Decimal(100)),
        ("Unknown", 5000, 700, 300, 300, Decimal(9000)),
        *weak,
    ]
    return spark.createDataFrame(data, AREA)


def test_only_the_weak_section_is_flagged(spark):
    from decimal import Decimal

    cfg = Config()
    frame = areas(spark, ("Accessories", 3000, 100, 40, 30, Decimal(600)), ("Joggers", 1000, 580, 20, 0, Decimal(0)))
    got = rows(analysis.area_opportunity(frame, cfg), "label")
    assert set(got) == {"Bags", "Shop by Brand", "Store home page", "Accessories", "Joggers"}
    assert [k for k, r in got.items() if r["clearly_below"]] == ["Accessories"]
    a = got["Accessories"]
    assert a["median_rate"] == 0.15
    assert a["extra_orders"] == pytest.approx(3000 * (0.15 - 100 / 3000) * 0.4)
    assert a["extra_revenue_usd"] == pytest.approx(a["extra_orders"] * 20)
    assert [k for k, r in got.items() if r["broken_checkout"]] == ["Joggers"]
    assert got["Joggers"]["order_value"] is None and got["Joggers"]["extra_revenue_usd"] == 0
    t = analysis.area_totals(frame, cfg).first()
    assert t["median"] == 0.15 and t["extra_orders"] == pytest.approx(a["extra_orders"])
    assert t["sessions_in_small_sections"] == 5010


def test_too_few_sections_give_no_rows_but_totals(spark):
    cfg = Config(area_min_sections=4)
    assert analysis.area_opportunity(areas(spark), cfg).count() == 0
    t = analysis.area_totals(areas(spark), cfg).first()
    assert (t["median"], t["extra_orders"], t["sessions_in_small_sections"]) == (None, 0.0, 12010)


WEEK = (
    "week_start date, is_full_week boolean, revenue_complete boolean, users long, transactions long, revenue_usd double,"
    " sessions_per_user double, conversion double, aov double"
)


def weeks(spark):
    def row(day, users, spu, conv, aov, full=True, complete=True):
        tx = users * spu * conv
        return (day, full, complete, users, int(tx), tx * aov, spu, conv, aov)

    return spark.createDataFrame(
        [
            row(date(2020, 11, 2), 100, 2.0, 0.1, 10.0),
            row(date(2020, 11, 9), 400, 2.0, 0.1, 10.0),
            row(date(2020, 11, 23), 400, 2.0, 0.2, 10.2),
            row(date(2020, 11, 30), 100, 1.0, 0.1, 10.0),
            row(date(2020, 12, 7), 9000, 2.0, 0.2, 10.0, complete=False),
            row(date(2020, 10, 26), 9000, 2.0, 0.2, 10.0, full=False),
        ],
        WEEK,
    )


def test_log_parts_add_up_and_peak(spark):
    tree = analysis.metric_tree(weeks(spark), date(2020, 11, 23))
    got = {str(r["week_start"]): r for r in tree.collect()}
    assert sorted(got) == ["2020-11-02", "2020-11-09", "2020-11-23", "2020-11-30"]
    base = sum(math.log(got[w]["revenue_usd"]) for w in ("2020-11-02", "2020-11-09")) / 2
    for r in got.values():
        assert r["log_total"] == pytest.approx(math.log(r["revenue_usd"]) - base, abs=1e-9)
    peak = analysis.peak_week(tree)
    p = peak.first()
    assert str(p["peak_week"]) == "2020-11-23"
    assert sum(p[f"share_{c}"] for c in analysis.COMPONENTS) == pytest.approx(1)
    drivers = analysis.growth_drivers(peak).first()
    assert {drivers["driver"], drivers["second_driver"]} == {"users", "conversion"}
    assert drivers["half_and_half"] and drivers["order_size_flat"]
    low = analysis.quietest_week(tree).first()
    assert (str(low["week_start"]), low["worst_component"]) == ("2020-11-30", "users") or low["worst_component"] == "sessions_per_user"


def test_no_baseline_is_an_error(spark):
    with pytest.raises(Exception, match="no full week before"):
        analysis.metric_tree(weeks(spark), date(2020, 1, 1)).collect()


def test_retention_summary(spark):
    grid = spark.createDataFrame(
        [("w1", 0, 100, 100, 1.0), ("w1", 1, 100, 30, 0.3), ("w2", 0, 50, 50, 1.0), ("w2", 1, 50, 0, 0.0), ("w1", 2, 100, 5, 0.05)],
        "cohort_week string, week_offset int, cohort_users long, active_users long, retention double",
    )
    got = rows(analysis.weighted_retention(grid, (1, 2, 4)), "week_offset")
    assert got[1]["retention"] == pytest.approx(0.2) and got[1]["cohorts"] == 2 and 4 not in got
    matrix = rows(analysis.retention_matrix(grid), "cohort_week")
    assert matrix["w2"]["1"] == 0.0 and matrix["w2"]["2"] is None
    assert {r["cohort_week"]: r["later_weeks"] for r in analysis.observed_cohorts(grid).collect()} == {"w1": 2, "w2": 1}
