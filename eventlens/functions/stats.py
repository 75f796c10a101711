"""Interval, test and sample-size formulas as ``Column`` arithmetic.

They run on aggregated rows inside the JVM: no Python worker, and any number of
segments at once. Normal tails come from two textbook expansions (Abramowitz and
Stegun 7.1.6 and 7.1.14) because Spark has no error function.
"""

from __future__ import annotations

import math
from statistics import NormalDist

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WILSON_Z = 1.959964  # fixed value: interval half-width in standard errors

_SERIES_TERMS = 60
_FRACTION_TERMS = 80
_SWITCH = 2.0


def quantile(q: float) -> float:
    """Standard normal quantile; a driver-side constant."""
    return NormalDist().inv_cdf(q)


def double(c: Column | str) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("double")


def ratio(a: Column | str, b: Column | str) -> Column:
    """a / b in double precision; NULL where b is zero (ANSI mode would raise)."""
    return double(a) / F.nullif(double(b), F.lit(0.0))


def nan() -> Column:
    return F.lit(float("nan"))


def erfc(x: Column) -> Column:
    """Complementary error function for x >= 0, accurate in the far tail as well."""
    square = x * x
    # erf(x) = 2/sqrt(pi) * exp(-x^2) * sum of 2^i x^(2i+1) / (1*3*...*(2i+1)): no cancellation.
    series = F.aggregate(
        F.sequence(F.lit(1), F.lit(_SERIES_TERMS)),
        F.struct(x.alias("term"), x.alias("total")),
        lambda acc, i: F.struct(
            (acc["term"] * square * 2.0 / (i * 2 + 1)).alias("term"),
            (acc["total"] + acc["term"] * square * 2.0 / (i * 2 + 1)).alias("total"),
        ),
        lambda acc: acc["total"],
    )
    near = 1.0 - series * F.exp(-square) * (2.0 / math.sqrt(math.pi))
    # erfc(x) = exp(-x^2)/sqrt(pi) / (x + (1/2)/(x + (2/2)/(x + ...))), from the inside out.
    fraction = F.aggregate(
        F.sequence(F.lit(_FRACTION_TERMS), F.lit(1), F.lit(-1)),
        x,
        lambda acc, i: x + (i / 2.0) / acc,
    )
    far = F.exp(-square) / (fraction * math.sqrt(math.pi))
    return F.when(x < _SWITCH, near).otherwise(far)


def two_sided_p(z: Column) -> Column:
    return erfc(F.abs(z) / math.sqrt(2.0))


def wilson(k: Column, n: Column, z: float = WILSON_Z) -> tuple[Column, Column]:
    """Wilson score interval of k out of n; NaN where n is not positive."""
    size = F.when(n > 0, double(n))
    p = double(k) / size
    scale = 1.0 + (z * z) / size
    middle = (p + (z * z) / (2.0 * size)) / scale
    spread = F.sqrt(p * (1.0 - p) / size + (z * z) / (4.0 * size * size)) * z / scale
    return F.coalesce(middle - spread, nan()), F.coalesce(middle + spread, nan())


def with_wilson(df: DataFrame, k: str, n: str, low: str = "ci_low", high: str = "ci_high") -> DataFrame:
    lower, upper = wilson(F.col(k), F.col(n))
    return df.withColumn(low, lower).withColumn(high, upper)


def pooled_z(k1: Column, n1: Column, k2: Column, n2: Column) -> Column:
    """z of p2 - p1 with pooled variance; zero where the standard error is, NULL where a side has no units."""
    pool = ratio(double(k1) + double(k2), double(n1) + double(n2))
    se = F.sqrt(pool * (1.0 - pool) * (ratio(F.lit(1.0), n1) + ratio(F.lit(1.0), n2)))
    difference = ratio(k2, n2) - ratio(k1, n1)
    return F.when(se == 0.0, F.lit(0.0)).otherwise(difference / F.nullif(se, F.lit(0.0)))


def with_two_prop_z(df: DataFrame, k1: str, n1: str, k2: str, n2: str) -> DataFrame:
    """Add ``difference`` (second minus first), ``z`` and two-sided ``p_value``; NULL where a side has no units."""
    return (
        df.withColumn("difference", ratio(k2, n2) - ratio(k1, n1))
        .withColumn("z", pooled_z(*(F.col(c) for c in (k1, n1, k2, n2))))
        .withColumn("p_value", two_sided_p(F.col("z")))
    )


def proportion_units(p: Column, lift: Column, alpha: float = 0.05, power: float = 0.8) -> Column:
    """Units per arm (not rounded) to detect a relative lift in a proportion; NULL if it would reach 100%."""
    q = p * (1.0 + lift)
    mid = (p + q) / 2.0
    root = F.sqrt(2.0 * mid * (1.0 - mid)) * quantile(1 - alpha / 2) + F.sqrt(
        p * (1.0 - p) + q * (1.0 - q)
    ) * quantile(power)
    return F.when(q < 1.0, root * root / F.nullif((q - p) * (q - p), F.lit(0.0)))


def proportion_mde(p: Column, n: Column, alpha: float = 0.05, power: float = 0.8, rounds: int = 60) -> Column:
    """Smallest relative lift n units per arm can detect: bisection with a fixed number of halvings.

    NULL where no lift that keeps the rate below one is detectable.
    """
    low, high = F.lit(1e-6), F.least(F.lit(50.0), F.lit(1.0 - 1e-9) / F.nullif(p, F.lit(0.0)) - 1.0)
    units = double(n)

    def halve(acc, _):
        middle = (acc["low"] + acc["high"]) / 2.0
        too_small = proportion_units(p, middle, alpha, power) > units
        return F.struct(
            F.when(too_small, middle).otherwise(acc["low"]).alias("low"),
            F.when(too_small, acc["high"]).otherwise(middle).alias("high"),
        )

    found = F.aggregate(
        F.sequence(F.lit(1), F.lit(rounds)),
        F.struct(low.alias("low"), high.alias("high")),
        halve,
        lambda acc: (acc["low"] + acc["high"]) / 2.0,
    )
    solvable = (high > low) & (proportion_units(p, high, alpha, power) <= units)
    return F.when(solvable & (proportion_units(p, low, alpha, power) >= units), found)


def mean_units(variance: Column, effect: Column, alpha: float = 0.05, power: float = 0.8) -> Column:
    """Units per arm (not rounded) to detect a difference ``effect`` given a per-unit variance."""
    z = quantile(1 - alpha / 2) + quantile(power)
    return variance * (2.0 * z * z) / F.nullif(effect * effect, F.lit(0.0))


def mean_mde(variance: Column, base: Column, units: Column, alpha: float = 0.05, power: float = 0.8) -> Column:
    """Smallest relative lift detectable with ``units`` per arm; NULL where there are none."""
    z = quantile(1 - alpha / 2) + quantile(power)
    return F.sqrt(variance * 2.0 / F.nullif(double(units), F.lit(0.0))) * z / F.nullif(base, F.lit(0.0))


def chi_square_p(chi2: Column) -> Column:
    """Upper tail of a chi-square with one degree of freedom."""
    return erfc(F.sqrt(chi2 / 2.0))
