"""Wall time of the headline jobs. Prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) names the input, BENCH_CPUS the local cores.
Each job runs once unmeasured on the smallest scale at hand, so that class loading is
not counted, then once measured from Parquet to fully computed rows. ``full_build`` is
the whole batch: audit, tables written, data tests, cross-check, results, exports, from raw tables that
are written before. ``full_build_large`` is the same over BENCH_COPIES (8) times the users, each copy
under user ids of its own; ``events`` has the rows of both, so that the slope can be read off.
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from pyspark.sql import functions as F  # noqa: E402

from eventlens.catalog import adapter, queries  # noqa: E402
from eventlens.plans.build import build  # noqa: E402
from eventlens.session import local_session  # noqa: E402

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
COPIES = int(os.environ.get("BENCH_COPIES", "8"))
HEADLINE = (
    "s5_params_by_slot",
    "s9_item_flatten",
    "m0_stage_events",
    "m2_session_funnel",
    "m3_sessions",
    "m4_funnel_segments",
    "m5_weekly_metrics",
    "m6_cohort_retention",
    "m7_area_funnel",
    "m8_user_windows",
    "q_audit_report",
    "v1_recompute",
    "x2_funnel_rates_ordered",
    "x3_segment_gap",
    "x6_area_opportunity",
    "x7_metric_tree",
    "e5_power_ratio",
    "e9_aa_replay",
    "e10_cuped",
)


def run(df) -> None:
    """Compute every row and column without moving them to the driver."""
    df.write.format("noop").mode("overwrite").save()


def main() -> None:
    spark = local_session("bench", CPUS, **{"spark.sql.shuffle.partitions": CPUS, "spark.driver.memory": "8g"})
    spark.sparkContext.setLogLevel("ERROR")
    small = Path(SF_DIR).parent / "sf0.001"
    warm = str(small) if small.exists() else SF_DIR
    times: dict[str, float] = {}
    for key in HEADLINE:
        run(queries.CATALOG[key](spark, warm))
        start = time.perf_counter()
        run(queries.CATALOG[key](spark, SF_DIR))
        times[key] = round(time.perf_counter() - start, 3)
    work = tempfile.mkdtemp(prefix="eventlens-bench-")
    raw = adapter.source(spark, SF_DIR)
    adapter.adapt_events(raw).write.parquet(f"{work}/raw/events")
    adapter.adapt_items(raw).write.parquet(f"{work}/raw/items")
    copies = F.explode(F.sequence(F.lit(1), F.lit(COPIES))).alias("_copy")
    for name in ("events", "items"):
        one = spark.read.parquet(f"{work}/raw/{name}")
        many = one.select("*", copies).withColumn("user_pseudo_id", F.concat_ws("-", "user_pseudo_id", "_copy"))
        many = many.withColumn("user_pseudo_id", F.when(F.col("user_pseudo_id").contains("-"), F.col("user_pseudo_id")))
        many.drop("_copy").repartition(int(CPUS)).write.parquet(f"{work}/large/{name}")
    events = {}
    for name, raw_dir in (("full_build", "raw"), ("full_build_large", "large")):
        start = time.perf_counter()
        build(spark, f"{work}/{raw_dir}", f"{work}/out-{raw_dir}", adapter.CONFIG)
        times[name] = round(time.perf_counter() - start, 3)
        events[name] = spark.read.parquet(f"{work}/{raw_dir}/events").count()
    print(
        json.dumps(
            {
                "metric": "total wall time of headline jobs",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": Path(SF_DIR).name.removeprefix("sf"),
                "cpus": CPUS,
                "events": events,
                "seconds_per_million_events": {k: round(times[k] / n * 1e6, 1) for k, n in events.items()},
            }
        )
    )


if __name__ == "__main__":
    main()
