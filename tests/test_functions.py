from __future__ import annotations

import math

import pytest
from pyspark.sql import functions as F

from eventlens.functions import events as fe
from eventlens.functions import stats


def _one(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


@pytest.mark.parametrize(
    "source,medium,expected",
    [
        (None, None, "Unknown"),
        ("<Other>", None, "Obfuscated"),
        (None, "(data deleted)", "Obfuscated"),
        ("(direct)", None, "Direct"),
        ("x", "(not set)", "Direct"),
        (None, "organic", "Organic Search"),
        ("google", "ppc", "Paid Search"),
        ("x", "referral", "Referral"),
        ("x", "email", "Email"),
        ("x", None, "Other"),
        ("", "", "Other"),
    ],
)
def test_channel_rules_in_order(spark, source, medium, expected):
    column = fe.channel_group(F.lit(source).cast("string"), F.lit(medium).cast("string"))
    assert _one(spark, column) == expected


@pytest.mark.parametrize(
    "url,expected",
    [
        ("https://a.b/Google+Redesign/Apparel?x=1", "Apparel"),
        ("https://a.b/Google+Redesign/Bags#top", "Bags"),
        ("https://a.b/store.html", "store.html"),
        ("https://a.b/", "Unknown"),
        ("https://a.b", "Unknown"),
        ("https://a.b/Google+Redesign/", "Unknown"),
        ("not a url", "Unknown"),
        (None, "Unknown"),
    ],
)
def test_section_of_url(spark, url, expected):
    assert _one(spark, fe.path_section(fe.url_path(F.lit(url).cast("string")))) == expected


@pytest.mark.parametrize(
    "raw,expected",
    [
        ("Shop+by+Brand", "Shop by Brand"),
        ("eco+friendly", "Eco friendly"),
        ("store.html", "Store home page"),
        ("asearch.html", "Search results"),
        ("+", "Unknown"),
    ],
)
def test_section_labels(spark, raw, expected):
    assert _one(spark, fe.section_label(F.lit(raw))) == expected


def test_week_starts_on_monday(spark):
    days = spark.sql("SELECT explode(sequence(DATE'2024-01-01', DATE'2024-01-14')) AS d")
    weeks = [str(r[0]) for r in days.select(fe.week_start(F.col("d"))).collect()]
    assert weeks == ["2024-01-01"] * 7 + ["2024-01-08"] * 7


def test_unknown_session_number_is_returning(spark):
    assert _one(spark, fe.user_type(F.lit(None).cast("boolean"))) == "returning"


def test_first_value_skips_null_and_breaks_ties_by_value(spark):
    df = spark.createDataFrame([(1, None), (2, "b"), (2, "a"), (3, "0"), (None, "-")], "t int, v string")
    assert df.agg(fe.first_value(F.col("v"), F.col("t")).alias("v")).first()["v"] == "a"


def test_first_row_value_keeps_null_and_puts_null_keys_last(spark):
    df = spark.createDataFrame([(None, "x", "p"), (1, None, "q"), (1, "z", None)], "t int, k string, v string")
    got = df.agg(fe.first_row_value(F.col("v"), F.col("t"), F.col("k")).alias("v"), F.count("*")).first()
    assert got["v"] is None


def test_erfc_against_the_standard_library(spark):
    xs = [i / 20 for i in range(0, 200)]
    df = spark.createDataFrame([(x,) for x in xs], "x double")
    for r in df.select("x", stats.erfc(F.col("x")).alias("v")).collect():
        assert r["v"] == pytest.approx(math.erfc(r["x"]), rel=1e-10)


def test_two_sided_p_of_critical_value(spark):
    assert _one(spark, stats.two_sided_p(F.lit(-1.959963985))) == pytest.approx(0.05, rel=1e-8)


def test_wilson_stays_inside_zero_and_one(spark):
    df = spark.createDataFrame([(0, 10), (10, 10), (1, 0), (50, 100)], "k long, n long")
    got = [(r["ci_low"], r["ci_high"]) for r in stats.with_wilson(df, "k", "n").collect()]
    assert got[0][0] == pytest.approx(0, abs=1e-12) and 0 < got[0][1] < 1
    assert 0 < got[1][0] < 1 and got[1][1] == pytest.approx(1)
    assert math.isnan(got[2][0]) and math.isnan(got[2][1])
    # p = 1/2, n = 100: half width z / (2 sqrt(n + z^2)).
    half = stats.WILSON_Z / 2 / math.sqrt(100 + stats.WILSON_Z**2)
    assert got[3] == pytest.approx((0.5 - half, 0.5 + half))


def test_two_proportions(spark):
    df = spark.createDataFrame([(10, 100, 20, 100), (0, 10, 0, 10)], "k1 long, n1 long, k2 long, n2 long")
    a, b = stats.with_two_prop_z(df, "k1", "n1", "k2", "n2").collect()
    z = 0.1 / math.sqrt(0.15 * 0.85 * 0.02)
    assert a["difference"] == pytest.approx(0.1) and a["z"] == pytest.approx(z)
    assert a["p_value"] == pytest.approx(math.erfc(z / math.sqrt(2)))
    assert b["z"] == 0 and b["p_value"] == 1


def test_sample_size_by_hand(spark):
    assert _one(spark, F.ceil(stats.proportion_units(F.lit(0.10), F.lit(0.10)))) == 14_751


def test_detectable_lift_inverts_sample_size(spark):
    units = F.ceil(stats.proportion_units(F.lit(0.04), F.lit(0.15)))
    assert _one(spark, stats.proportion_mde(F.lit(0.04), units)) == pytest.approx(0.15, rel=1e-3)


def test_lift_that_cannot_be_detected_is_null(spark):
    assert _one(spark, stats.proportion_mde(F.lit(0.5), F.lit(1))) is None
    assert _one(spark, stats.proportion_units(F.lit(0.9), F.lit(0.2))) is None
