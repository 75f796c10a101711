from __future__ import annotations

import re
from dataclasses import replace
from datetime import date, timedelta
from pathlib import Path

import pytest

from eventlens.catalog import adapter
from eventlens.operators.audit import AuditFailed
from eventlens.plans.build import STAGES, build, published


def test_full_build_writes_models_results_and_exports(spark, adapted, tmp_path):
    out = str(tmp_path)
    days = adapted["events"].select("event_date").distinct().count()
    cfg = replace(adapter.CONFIG, window_end=adapter.CONFIG.window_start + timedelta(days=days - 1))
    base, m = out, build(spark, adapted["root"], out, cfg)
    out = published(spark, base)
    assert [str(p) for p in Path(base, "runs").iterdir()] == [out]
    assert {p.name for p in Path(out, "models").iterdir()} == {name for stage in STAGES for name in stage}
    everyone = m.funnel_segments.filter("segment_type = 'all'").first()
    assert everyone["sessions"] == m.sessions.count()
    exports = {p.name for p in Path(out, "exports").iterdir()}
    assert exports == {"headline", "funnel_by_device", "store_sections", "weekly_revenue", "channels", "retention"}
    device = spark.read.option("header", True).csv(f"{out}/exports/funnel_by_device")
    assert "1 Viewed products" in {r["step"] for r in device.collect()}
    headline = spark.read.json(f"{out}/results/headline").first()
    assert headline["sessions"] == everyone["sessions"]
    assert spark.read.json(f"{out}/results/audit").count() == 21
    rate = spark.read.json(f"{out}/results/experiment_aa").first()["fpr_delta"]
    assert 0 <= rate <= 0.2


def test_whole_rows_are_shuffled_once(spark, adapted):
    """Counting copies moves all columns; audit and models from its table do not."""
    from eventlens.operators import audit, staging
    from eventlens.plans.models import Models

    def wide(df) -> int:
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        names = adapted["events"].columns
        groups = re.findall(r"Aggregate \[([^\]]*)\]", plan)
        return sum(all(f"{c}#" in g for c in names) for g in groups)

    counted = staging.row_counts(adapted["events"])
    assert wide(counted) == 1
    stored = spark.createDataFrame([], counted.schema)
    m = Models(adapted["events"], adapter.CONFIG, stored)
    frames = [audit.audit(adapted["events"], adapted["items"], adapter.CONFIG, stored), m.session_funnel, m.purchases, m.sessions]
    assert [wide(df) for df in frames] == [0, 0, 0, 0]


def test_raw_rows_are_read_once_beside_the_crosscheck(spark, adapted, tmp_path):
    """Audit, summary, models and results start from the counted rows."""
    from eventlens.operators import audit, staging
    from eventlens.plans.models import Models
    from eventlens.plans.results import export_frames, result_blocks
    from eventlens.sources import sinks

    counted = sinks.materialise(staging.row_counts(adapted["events"]), str(tmp_path / "counted"))
    m = Models(adapted["events"], adapter.CONFIG, counted)
    frames = [audit.audit(m.events, adapted["items"], m.cfg, counted), m.sessions, m.area_funnel, *result_blocks(m, adapted["items"]).values(), *export_frames(m).values()]
    raw = re.escape(f"{adapted['root']}/events")
    for df in frames:
        files = [f for f in df.inputFiles() if re.search(raw, f)]
        assert files == [], df.columns
    plain = {r["name"]: (r["value"], r["detail"], r["severity"], r["facts"]) for r in audit.audit(m.events, adapted["items"], m.cfg).collect()}
    weighted = {r["name"]: (r["value"], r["detail"], r["severity"], r["facts"]) for r in frames[0].collect()}
    assert plain == weighted and len(plain) == 21
    assert audit.summary(m.events).collect() == audit.summary(counted).collect()


def test_observed_tests_agree_with_scans(spark, adapted, tmp_path):
    """A broken model: what is counted while it is written is what the test finds afterwards."""
    from pyspark.sql import functions as F

    from eventlens.operators import checks
    from eventlens.plans.build import ChecksFailed, materialise_models, require_tests
    from eventlens.plans.models import Models

    m = Models(adapted["events"], adapter.CONFIG)
    steps = m.cfg.steps
    odd = F.xxhash64("session_key") % 5 == 0
    m.sessions = m.sessions.withColumn("channel", F.when(odd, "Elsewhere").otherwise(F.col("channel"))).withColumn(f"reached_{steps[0]}", F.when(odd, 0).otherwise(F.col(f"reached_{steps[0]}")))
    m, observed = materialise_models(m, str(tmp_path / "models"))
    found = {r["check"]: r["failures"] for r in checks.run_all(m.sessions, m.weekly_metrics, m.cohort_retention, m.area_funnel, m.user_windows, steps).collect()}
    assert observed["sessions_channel_accepted"] > 0 and observed["funnel_is_ordered"] > 0
    keys = {r["check"]: r["failures"] for r in checks.key_failures({n: getattr(m, n) for n, _ in checks.UNIQUE.values()}).collect()}
    assert observed | keys == found
    with pytest.raises(ChecksFailed, match="sessions_channel_accepted"):
        require_tests(m, observed)
    _, none = materialise_models(Models(adapted["events"].limit(0), adapter.CONFIG), str(tmp_path / "empty"))
    assert set(none.values()) == {0}


def test_a_reader_never_fails_while_runs_are_published(spark, tmp_path):
    """Three runs are published and old ones removed while a reader asks for the newest again and again."""
    import threading

    from eventlens.sources import sinks

    out, stop, seen, problems = str(tmp_path), threading.Event(), set(), []
    spark.range(1).write.parquet(f"{out}/runs/a")
    sinks.publish(spark, out, f"{out}/runs/a")

    def read():
        while not stop.is_set():
            try:
                seen.add(spark.read.parquet(published(spark, out)).count())
            except Exception as problem:  # noqa: BLE001
                problems.append(problem)

    reader = threading.Thread(target=read)
    reader.start()
    for k, name in enumerate("bcd"):
        spark.range(k + 2).write.parquet(f"{out}/runs/{name}")
        assert sinks.publish(spark, out, f"{out}/runs/{name}") == k + 2
        sinks.remove_old_runs(spark, out, keep=2)
    stop.set()
    reader.join()
    assert not problems and seen <= {1, 2, 3, 4} and published(spark, out).endswith("/d")
    assert sorted(p.name for p in Path(out, "runs").iterdir()) == ["c", "d"]


def test_a_failing_audit_stops_the_build(spark, adapted, tmp_path):
    longer = replace(adapter.CONFIG, window_end=date(2024, 3, 31))
    with pytest.raises(AuditFailed, match="missing_days"):
        build(spark, adapted["root"], str(tmp_path), longer)
    assert not Path(tmp_path, "published").exists() and not list(Path(tmp_path).glob("runs/*/models"))
    with pytest.raises(ValueError, match="nothing is published"):
        published(spark, str(tmp_path))


def test_another_source_is_refused(spark, adapted, tmp_path):
    from eventlens.sources.ingest import WrongSource, write_manifest

    write_manifest(adapted["events"], adapted["items"], "synthetic", f"{adapted['root']}/manifest")
    with pytest.raises(WrongSource):
        build(spark, adapted["root"], str(tmp_path), adapter.CONFIG, source="export")
    assert not list(Path(tmp_path).iterdir())
