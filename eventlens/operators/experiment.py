"""Designing a test on real baselines: power, A/A replay, CUPED, enrolment, sample ratio.

Users are randomised while the metric is per session, so variances come from the
delta method for a ratio. Every statistic is a closed form of moments, so a user table
of any size is combined in each task, and grouped by any segment.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from eventlens.functions.stats import (
    chi_square_p,
    double,
    mean_mde,
    mean_units,
    proportion_mde,
    proportion_units,
    quantile,
    ratio,
    two_sided_p,
    wilson,
)

SRM_STOP = 0.001  # fixed value: p below which an experiment must stop


# ---- ratio metrics ---------------------------------------------------------------


def ratio_spread(df: DataFrame, y: str, n: str, by: Sequence[str] = ()) -> DataFrame:
    """Users, totals, sample variances and covariance of a metric and its denominator.

    Spark merges moments of parts, so large totals do not eat the digits of small variances.
    """
    top, bottom = double(y), double(n)
    return df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("cnt"),
        F.sum(top).alias("y_total"),
        F.sum(bottom).alias("n_total"),
        F.var_samp(top).alias("y_variance"),
        F.var_samp(bottom).alias("n_variance"),
        F.covar_samp(top, bottom).alias("covariance"),
    )


def linear_variance(r: Column, y_variance: Column, n_variance: Column, covariance: Column) -> Column:
    """Variance of y - r n."""
    return y_variance + r * (r * n_variance - covariance * 2.0)


def ratio_moments(df: DataFrame, y: str, n: str, by: Sequence[str] = ()) -> DataFrame:
    """``ratio_spread`` with ``ratio`` and ``unit_variance``, the per-user variance of the linearised ratio."""
    per_user = ratio("n_total", "cnt")
    spread = linear_variance(F.col("ratio"), F.col("y_variance"), F.col("n_variance"), F.col("covariance"))
    return (
        ratio_spread(df, y, n, by)
        .withColumn("ratio", ratio("y_total", "n_total"))
        .withColumn("unit_variance", spread / F.nullif(per_user * per_user, F.lit(0.0)))
    )


def delta_method_test(df: DataFrame, arm: str, y: str, n: str, a: str = "A", b: str = "B") -> DataFrame:
    """R_b - R_a with user-level randomisation: difference, z, two-sided p."""
    arms = ratio_moments(df.filter(F.col(arm).isin(a, b)), y, n, [arm]).withColumn(
        "variance", F.col("unit_variance") / double("cnt")
    )

    def of(name: str, column: str) -> Column:
        return F.max(F.when(F.col(arm) == name, F.col(column)))

    return (
        arms.agg(
            of(a, "ratio").alias("ratio_a"),
            of(b, "ratio").alias("ratio_b"),
            of(a, "variance").alias("variance_a"),
            of(b, "variance").alias("variance_b"),
        )
        .withColumn("difference", F.col("ratio_b") - F.col("ratio_a"))
        .withColumn("z", F.col("difference") / F.nullif(F.sqrt(F.col("variance_a") + F.col("variance_b")), F.lit(0.0)))
        .withColumn("p_value", two_sided_p(F.col("z")))
    )


# ---- sample sizes ----------------------------------------------------------------


def _lifts(grid: Sequence[float]) -> Column:
    return F.explode(F.array(*[F.lit(float(m)) for m in grid]))


def power_table(
    moments: DataFrame, grid: Sequence[float], alpha: float = 0.05, power: float = 0.8
) -> DataFrame:
    """Users per arm to detect each relative lift in a ratio, beside the naive count of sessions.

    ``design_effect``: sessions the right design needs over what treating sessions
    as independent would ask for; above one, the naive test lacks power.
    """
    rows = moments.withColumn("rel_mde", _lifts(grid))
    users = F.ceil(mean_units(F.col("unit_variance"), F.col("ratio") * F.col("rel_mde"), alpha, power))
    naive = F.ceil(proportion_units(F.col("ratio"), F.col("rel_mde"), alpha, power))
    per_user = ratio("n_total", "cnt")
    return (
        rows.withColumn("users_per_arm", users)
        .withColumn("naive_sessions_per_arm", naive)
        .withColumn("sessions_per_user", per_user)
        .withColumn(
            "design_effect",
            ratio(double("users_per_arm") * F.col("sessions_per_user"), F.col("naive_sessions_per_arm")),
        )
    )


def proportion_power(
    rates: DataFrame, p: str, grid: Sequence[float], alpha: float = 0.05, power: float = 0.8
) -> DataFrame:
    """Units per arm for each relative lift in an independent proportion."""
    return rates.withColumn("rel_mde", _lifts(grid)).withColumn(
        "units_per_arm", F.ceil(proportion_units(double(p), F.col("rel_mde"), alpha, power))
    )


def with_proportion_mde(rates: DataFrame, p: str, units: str, alpha: float = 0.05, power: float = 0.8) -> DataFrame:
    """Smallest relative lift detectable with ``units`` per arm, per row."""
    return rates.withColumn("rel_mde", proportion_mde(double(p), F.col(units), alpha, power))


def mean_power(
    df: DataFrame, value: str, grid: Sequence[float], by: Sequence[str] = (), alpha: float = 0.05, power: float = 0.8
) -> DataFrame:
    """Units per arm for each relative lift in a mean, such as revenue per user."""
    stats = df.groupBy(*by).agg(
        F.avg(double(value)).alias("mean"), F.var_samp(double(value)).alias("variance")
    )
    return stats.withColumn("rel_mde", _lifts(grid)).withColumn(
        "units_per_arm", F.ceil(mean_units(F.col("variance"), F.col("mean") * F.col("rel_mde"), alpha, power))
    )


# ---- enrolment -------------------------------------------------------------------


def arrivals(users: DataFrame, first_date: str, by: Sequence[str] = ()) -> DataFrame:
    """New users per day."""
    return users.groupBy(*by, F.col(first_date).alias("day")).agg(F.count(F.lit(1)).alias("new_users"))


def enrolment_curve(users: DataFrame, first_date: str, by: Sequence[str] = ()) -> DataFrame:
    """Every day from the first to the last arrival, days without arrivals included, with the running total."""
    per_day = arrivals(users, first_date, by)
    seen = per_day.groupBy(*by).agg(
        F.min("day").alias("start"),
        F.max("day").alias("end"),
        # One entry per day of the calendar.
        F.map_from_entries(F.collect_list(F.when(F.col("day").isNotNull(), F.struct("day", "new_users")))).alias("on"),
    )
    days = seen.filter(F.col("start").isNotNull()).select(
        *by, "on", F.posexplode(F.sequence("start", "end", F.expr("interval 1 day"))).alias("day_index", "day")
    )
    so_far = (
        Window.partitionBy(*(by or [F.lit(0)]))
        .orderBy("day_number")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    return days.select(
        *by,
        (F.col("day_index") + 1).alias("day_number"),
        "day",
        F.coalesce(F.try_element_at("on", F.col("day")), F.lit(0).cast("bigint")).alias("new_users"),
    ).select("*", F.sum("new_users").over(so_far).alias("total_users"))


def recent_rate(curve: DataFrame, by: Sequence[str] = (), days: int = 7) -> DataFrame:
    """Days on the curve, users on it, and new users a day over its last ``days`` days."""
    from_end = Window.partitionBy(*(by or [F.lit(0)])).orderBy(F.col("day_number").desc())
    ranked = curve.withColumn("from_end", F.row_number().over(from_end))
    return ranked.groupBy(*by).agg(
        F.max("day_number").alias("days"),
        F.max("total_users").alias("enrolled"),
        F.avg(F.when(F.col("from_end") <= days, F.col("new_users"))).alias("rate"),
        F.array_sort(F.collect_list(F.struct("day_number", "total_users"))).alias("curve"),
    )


def days_to_reach(curve: DataFrame, targets: DataFrame, needed: str, by: Sequence[str] = ()) -> DataFrame:
    """Days until ``needed`` distinct users were seen.

    Inside the curve: the first day that reaches it. Beyond it: at the rate of new
    users over the last seven days (returning users add no sample). Infinite where
    no one arrives.
    """
    key = list(by) or ["_one"]
    if not by:
        curve, targets = (d.withColumn("_one", F.lit(1)) for d in (curve, targets))
    summary = recent_rate(curve, key)
    hits = F.filter("curve", lambda d: d["total_users"] >= F.col(needed))
    inside = double(F.get(hits, F.lit(0))["day_number"])
    beyond = double("days") + (double(needed) - double("enrolled")) / F.nullif(F.col("rate"), F.lit(0.0))
    joined = targets.join(summary, key, "left").withColumn(
        "days_needed", F.coalesce(inside, beyond, F.lit(float("inf")))
    )
    return joined.select(*[c for c in targets.columns if c != "_one"], "days_needed")


def detectable(
    users: DataFrame,
    y: str,
    n: str,
    first_date: str,
    windows: Sequence[int] = (7, 14, 21),
    by: Sequence[str] = (),
    alpha: float = 0.05,
    power: float = 0.8,
) -> DataFrame:
    """Smallest relative lift a test of each length could see with the traffic there is.

    Users of each window are counted from the calendar of arrivals, a row per day.
    """
    key = list(by) or ["_one"]
    users = users if by else users.withColumn("_one", F.lit(1))
    calendar = arrivals(users, first_date, key)
    since = F.datediff("day", F.min("day").over(Window.partitionBy(*key)))
    seen = [F.coalesce(F.sum(F.when(F.col("_since") < w, F.col("new_users"))), F.lit(0)) for w in windows]
    pairs = F.array(*[F.struct(F.lit(w).alias("days"), c.alias("seen")) for w, c in zip(windows, seen, strict=True)])
    counted = calendar.withColumn("_since", since).groupBy(*key).agg(pairs.alias("_windows"))
    found = ratio_moments(users, y, n, key).join(counted, key).select("*", F.explode("_windows").alias("w"))
    per_arm = F.floor(F.col("w.seen") / 2)
    lift = mean_mde(F.col("unit_variance"), F.col("ratio"), per_arm, alpha, power)
    return found.select(*by, "ratio", "w.days", per_arm.alias("users_per_arm"), lift.alias("rel_mde"))


# ---- A/A replay ------------------------------------------------------------------


def _checked(value: Column, name: str) -> Column:
    """A NULL metric or key would turn every split into NULL or put all such users on one side."""
    return F.when(value.isNull(), F.raise_error(F.lit(f"A/A replay: {name} is NULL"))).otherwise(value)


#: What a split is judged by: for each user, deviations from the means of all users and their products.
CONTRASTS = ("users", "y", "n", "yy", "nn", "yn")
#: Splits that a task draws together.
TOGETHER = 32
#: Users with equal answers that one row stands for, in whole blocks of 128; no draw depends on it, it bounds a row's work.
PORTION = 1 << 20


def answer_counts(users: DataFrame, y: str, n: str, key: str) -> DataFrame:
    """(_y, _n, _users): how many users gave each answer. A NULL in answer or key is an error."""
    answers = [_checked(double(c), c).alias(name) for c, name in ((y, "_y"), (n, "_n"))]
    return users.groupBy(*answers).agg(F.count(_checked(F.col(key), key)).alias("_users"))


def in_portions(answers: DataFrame, portion: int = PORTION) -> DataFrame:
    """Answers with ``_users`` cut into rows of at most ``portion`` users, each from the start of block ``_block`` on."""
    blocks = -(-portion // 128)
    cut = answers.select("*", F.explode(F.expr(f"sequence(0L, (_users - 1) div {128 * blocks})")).alias("_cut"))
    first = F.col("_cut") * blocks
    return cut.select("_y", "_n", F.least(F.col("_users") - first * 128, F.lit(128 * blocks)).alias("_users"), first.alias("_block"))


def in_arm_b(seed: int) -> Column:
    """How many of a row's ``_users``, the ones from block ``_block`` of their answer on, are in arm B of the split named ``_name``.

    User i of the answer is in arm B if bit i is set in md5(answer:split:block:seed), 128 bits to a block, however many users there
    are: a binomial draw with even odds. So it does not depend on the order or the partition of rows.
    """
    name = f"md5(concat_ws(':', _name, _block + {{0}}, {seed}))"
    whole = "aggregate(sequence(0, int(_users div 128)), 0L, (sum, b) -> sum + IF(b < _users div 128, bitmap_count(unhex({0})), 0L))".format(name.format("b"))
    last, rest = name.format("_users div 128"), "int(_users % 128)"
    digits = f"bitmap_count(unhex(rpad(left({last}, {rest} div 4), 32, '0')))"
    bits = f"bit_count(shiftright(instr('0123456789abcdef', substr({last}, {rest} div 4 + 1, 1)) - 1, 4 - {rest} % 4))"
    return F.expr(f"{whole} + {digits} + {bits}")


def aa_contrasts(users: DataFrame, y: str, n: str, key: str, n_sims: int, seed: int, portion: int = PORTION) -> DataFrame:
    """Per split: arm B minus arm A, for each of ``CONTRASTS``, beside their totals (``t_``) and the means of all users.

    Users are first reduced to their distinct answers, of which a split only needs to know how many are in arm B: work
    is answers times splits and a bit for each user and split, all of it in the JVM. Deviations are centred, so that products keep their digits.
    """
    answers = answer_counts(users, y, n, key)
    weight = double("_users")
    middle = answers.agg(
        F.struct((F.sum(F.col("_y") * weight) / F.sum(weight)).alias("y"), (F.sum(F.col("_n") * weight) / F.sum(weight)).alias("n"))
    ).scalar()
    chunks = F.sequence(F.lit(0), F.lit((n_sims - 1) // TOGETHER))
    # Answers are few, splits and users of one answer are many: splits and portions of users are what is dealt to tasks.
    tasks = max((n_sims - 1) // TOGETHER + 1, int(users.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    dealt = in_portions(answers, portion).select("*", F.explode(chunks).alias("_chunk")).repartition(tasks, "_chunk", "_block")
    sims = F.sequence(F.col("_chunk") * TOGETHER, F.least(F.col("_chunk") * TOGETHER + TOGETHER, F.lit(n_sims)) - 1)
    split = dealt.select("_y", "_n", "_users", "_block", F.explode(sims).alias("sim")).withColumn("_middle", middle)
    named = split.withColumn("_name", F.concat_ws(":", "_y", "_n", "sim"))
    signed = named.withColumn("_signed", 2.0 * in_arm_b(seed) - weight)
    dy, dn = F.col("_y") - F.col("_middle.y"), F.col("_n") - F.col("_middle.n")
    parts = dict(zip(CONTRASTS, (F.lit(1.0), dy, dn, dy * dy, dn * dn, dy * dn), strict=True))
    return signed.groupBy("sim").agg(
        *[F.sum(F.col("_signed") * part).alias(c) for c, part in parts.items()],
        *[F.sum(weight * part).alias(f"t_{c}") for c, part in parts.items()],
        F.first("_middle.y").alias("mean_y"),
        F.first("_middle.n").alias("mean_n"),
    )


def arm_summary(arm: str) -> dict[str, Column]:
    """Ratio, its variance, and totals of one arm (``a`` or ``b``), from contrasts and totals."""
    sign = 1.0 if arm == "b" else -1.0
    users, dy, dn, yy, nn, yn = ((F.col(f"t_{c}") + F.col(c) * sign) / 2.0 for c in CONTRASTS)
    blank = F.lit(0.0)
    free = F.nullif(users - 1.0, blank)
    mean_y, mean_n = F.col("mean_y") + dy / F.nullif(users, blank), F.col("mean_n") + dn / F.nullif(users, blank)
    r = mean_y / F.nullif(mean_n, blank)
    spread = linear_variance(
        r, (yy - dy * dy / F.nullif(users, blank)) / free, (nn - dn * dn / F.nullif(users, blank)) / free, (yn - dy * dn / F.nullif(users, blank)) / free
    )
    return {"ratio": r, "variance": spread / F.nullif(users * mean_n * mean_n, blank), "y": mean_y * users, "n": mean_n * users}


def aa_tests(contrasts: DataFrame) -> DataFrame:
    """z of the delta-method and of the naive session test, per split."""
    a, b = arm_summary("a"), arm_summary("b")
    gap = b["ratio"] - a["ratio"]
    pool = (a["y"] + b["y"]) / F.nullif(a["n"] + b["n"], F.lit(0.0))
    as_sessions = pool * (1.0 - pool) * (1.0 / F.nullif(a["n"], F.lit(0.0)) + 1.0 / F.nullif(b["n"], F.lit(0.0)))

    def z(variance: Column) -> Column:
        # Rounding can leave a variance of nothing a hair below zero.
        return gap / F.nullif(F.sqrt(F.greatest(variance, F.lit(0.0))), F.lit(0.0))

    return contrasts.select("sim", z(a["variance"] + b["variance"]).alias("z_delta"), z(as_sessions).alias("z_naive"))


def aa_replay(
    users: DataFrame,
    y: str,
    n: str,
    key: str = "user_pseudo_id",
    n_sims: int = 1_000,
    seed: int = 11,
    alpha: float = 0.05,
) -> DataFrame:
    """Split all users at random ``n_sims`` times without a treatment; how often does each test cry wolf?"""
    limit = quantile(1 - alpha / 2)
    tests = aa_tests(aa_contrasts(users, y, n, key, n_sims, seed))
    hits = tests.agg(
        F.count(F.lit(1)).alias("n_sims"),
        F.count_if(F.coalesce(F.abs("z_naive") > limit, F.lit(False))).alias("naive"),
        F.count_if(F.coalesce(F.abs("z_delta") > limit, F.lit(False))).alias("delta"),
    )
    columns = [F.col("n_sims"), F.lit(alpha).alias("alpha")]
    for test in ("naive", "delta"):
        low, high = wilson(F.col(test), F.col("n_sims"))
        columns += [
            ratio(test, "n_sims").alias(f"fpr_{test}"),
            low.alias(f"fpr_{test}_low"),
            high.alias(f"fpr_{test}_high"),
        ]
    return hits.select(*columns)


# ---- CUPED, sample ratio -----------------------------------------------------------


def cuped(df: DataFrame, y: str, x: str, by: Sequence[str] = ()) -> DataFrame:
    """Effect of adjusting y by a pre-period covariate x: theta, variance reduction, correlation.

    The adjusted variance is var(y) - 2 theta cov + theta^2 var(x); a constant x
    adjusts nothing and gives zeros.
    """
    a, b = double(y), double(x)
    stats = df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("cnt"),
        F.var_samp(a).alias("vy"),
        F.var_samp(b).alias("vx"),
        F.covar_samp(a, b).alias("cov"),
        F.avg(b).alias("mean_x"),
    )
    moves = F.col("vx") > 0
    theta = ratio("cov", "vx")
    adjusted = F.col("vy") - theta * F.col("cov") * 2.0 + theta * theta * F.col("vx")
    corr = F.col("cov") / F.nullif(F.sqrt(F.col("vx")) * F.sqrt(F.col("vy")), F.lit(0.0))

    def unless_constant(value: Column) -> Column:
        return F.when(moves, value).otherwise(0.0)

    return stats.select(
        *by,
        "cnt",
        "mean_x",
        unless_constant(theta).alias("theta"),
        unless_constant(1.0 - ratio(adjusted, F.col("vy"))).alias("variance_reduction"),
        unless_constant(corr).alias("corr"),
    )


def with_cuped(df: DataFrame, y: str, x: str, out: str = "y_adjusted") -> DataFrame:
    """Add y - theta (x - mean x), theta and mean over the whole frame (two scalars, no join)."""
    fit = cuped(df, y, x).select(F.struct("theta", "mean_x").alias("fit")).scalar()
    return (
        df.withColumn("_fit", fit)
        .withColumn(out, double(y) - F.col("_fit.theta") * (double(x) - F.col("_fit.mean_x")))
        .drop("_fit")
    )


def srm_check(assignments: DataFrame, arm: str, a: str = "A", b: str = "B", expected_share_a: float = 0.5) -> DataFrame:
    """Chi-square of the split into two arms; stop the experiment below p = 0.001."""
    counts = assignments.agg(
        F.count_if(F.col(arm) == a).alias("n_a"), F.count_if(F.col(arm) == b).alias("n_b")
    )
    total = double("n_a") + double("n_b")
    want_a, want_b = total * expected_share_a, total * (1.0 - expected_share_a)
    off = lambda n, want: (double(n) - want) * (double(n) - want) / F.nullif(want, F.lit(0.0))
    return (
        counts.withColumn("chi2", off("n_a", want_a) + off("n_b", want_b))
        .withColumn("p_value", chi_square_p(F.col("chi2")))
        .withColumn("stop", F.col("p_value") < SRM_STOP)
    )


# ---- the design --------------------------------------------------------------------

EVERYONE, SEGMENT_ONLY = "all users", "segment users"
Y, N, FIRST = "exp_converting_sessions", "exp_sessions", "exp_first_date"


def with_populations(users: DataFrame, segment: str, column: str = "device_category") -> DataFrame:
    """Each user once per population a test could run on: everyone, and the one segment."""
    names = F.array_compact(F.array(F.lit(EVERYONE), F.when(F.col(column) == segment, F.lit(SEGMENT_ONLY))))
    return users.withColumn("population", F.explode(names))


def choose_population(moments: DataFrame, target: DataFrame, min_users: int) -> DataFrame:
    """The segment if its gap is significant and it has enough users, else everyone.

    ``segment_users`` and ``reason`` say which of the two decided.
    """
    wanted = target.agg(F.max(F.col("segment_only"))).scalar()
    allowed = (F.col("population") == EVERYONE) | (wanted & (F.col("cnt") >= min_users))
    rank = Window.partitionBy(F.lit(0)).orderBy((F.col("population") == EVERYONE).cast("int"))  # two rows
    inside = F.coalesce(F.max(F.when(F.col("population") == SEGMENT_ONLY, F.col("cnt"))).over(Window.partitionBy(F.lit(0))), F.lit(0))
    return (
        moments.withColumn("segment_users", inside)
        .withColumn(
            "reason",
            F.when(~F.coalesce(wanted, F.lit(False)), "no significant gap")
            .when(F.col("segment_users") < min_users, "too few users in the segment")
            .otherwise("the gap is significant"),
        )
        .filter(allowed)
        .withColumn("rank", F.row_number().over(rank))
        .filter(F.col("rank") == 1)
        .drop("rank")
    )


def experiment_design(users: DataFrame, target: DataFrame, cfg) -> dict[str, DataFrame]:
    """The test the analysis points at, as small frames.

    ``design``: population, baseline, sessions per user. ``power``: users per arm and
    days per lift. ``detectable``: lift per test length. ``aa``: false-positive rates
    on all users. ``cuped``: effect of history for three metric pairs.
    """
    segment = cfg.gap_pair[0]
    tagged = with_populations(users, segment)
    by = ["population"]
    chosen = choose_population(ratio_moments(tagged, Y, N, by), target, cfg.design_min_users)
    step = target.agg(F.max("step")).scalar()
    design = chosen.select(
        step.alias("target_step"),
        (F.col("population") == SEGMENT_ONLY).alias("segment_only"),
        F.when(F.col("population") == EVERYONE, F.lit(EVERYONE)).otherwise(f"{segment} users").alias("population"),
        F.col("cnt").alias("window_users"),
        F.col("ratio").alias("baseline_rate"),
        ratio("n_total", "cnt").alias("sessions_per_user"),
        "segment_users",
        "reason",
    )
    power = power_table(chosen, cfg.mde_grid, cfg.alpha, cfg.power).withColumn(
        "needed", F.col("users_per_arm") * 2
    )
    power = days_to_reach(enrolment_curve(tagged, FIRST, by), power, "needed", by).select(
        "rel_mde", "users_per_arm", F.col("days_needed").alias("days"), "naive_sessions_per_arm", "design_effect"
    )
    found = (
        detectable(tagged, Y, N, FIRST, cfg.detectable_windows, by, cfg.alpha, cfg.power)
        .join(chosen.select("population"), "population", "left_semi")
        .select("days", "users_per_arm", "rel_mde")
    )
    return {
        "design": design,
        "power": power,
        "detectable": found,
        "aa": aa_replay(users, Y, N, n_sims=cfg.aa_sims, seed=cfg.aa_seed, alpha=cfg.alpha),
        "cuped": cuped_uses(users),
    }


def cuped_uses(users: DataFrame) -> DataFrame:
    """Revenue on past revenue, conversions on past visits, and the latter for users with history.

    The last is reported only if more than two users have any.
    """
    known = F.col("pre_sessions") > 0
    pairs = F.array_compact(
        F.array(
            F.struct(
                F.lit("revenue_all").alias("use"),
                double("exp_revenue_usd").alias("y"),
                double("pre_revenue_usd").alias("x"),
            ),
            F.struct(F.lit("conversions_all").alias("use"), double(Y).alias("y"), double("pre_sessions").alias("x")),
            F.when(
                known,
                F.struct(
                    F.lit("conversions_with_history").alias("use"),
                    double(Y).alias("y"),
                    double("pre_sessions").alias("x"),
                ),
            ),
        )
    )
    each = users.select(F.explode(pairs).alias("p")).select("p.*")
    share = users.agg(F.avg(known.cast("double"))).scalar()
    out = cuped(each, "y", "x", ["use"])
    return out.filter((F.col("use") != "conversions_with_history") | (F.col("cnt") > 2)).select(
        "use", F.col("cnt").alias("users"), "theta", "variance_reduction", "corr", share.alias("share_with_history")
    )
