"""The full batch: audit, models, data tests, cross-check, results, exports."""

from __future__ import annotations

from functools import partial
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession

from eventlens.config import Config
from eventlens.operators import audit, checks, crosscheck, staging
from eventlens.plans.models import Models
from eventlens.plans.results import export_frames, result_blocks
from eventlens.sources import readers, sinks
from eventlens.sources.ingest import require_source

# Build order. Tables of one stage do not depend on each other and are written side by
# side; the next stage starts from the files.
STAGES = (
    ("session_funnel", "purchases"),
    ("sessions",),
    ("funnel_segments", "weekly_metrics", "cohort_retention", "area_funnel", "user_windows"),
)


class ChecksFailed(RuntimeError):
    """The models contradict a data test or the independent computation."""


#: Tables that are read by date are stored by date.
FOLDERS = {"sessions": ("session_date",)}


def materialise_models(m: Models, out: str) -> tuple[Models, dict[str, int]]:
    """Write every model under ``out``; the frames of the models returned read what was written.

    Assigning a written table replaces the cached plan, so each later model is a plan over that table. Data tests that
    concern single rows are counted while the rows are written, and returned by name.
    """
    failures: dict[str, int] = {}
    violations = checks.row_violations(m.cfg.steps)
    for stage in STAGES:
        plans = {name: getattr(m, name) for name in stage}
        jobs = {}
        for name, plan in plans.items():
            folders = FOLDERS.get(name, ())
            plan = plan.hint("rebalance", *folders) if folders else plan
            jobs[name] = partial(sinks.materialise_observed, plan, f"{out}/{name}", violations.get(name, {}), *folders)
        for name, (table, found) in sinks.side_by_side(jobs).items():
            setattr(m, name, table)
            failures |= found
    return m, failures


def require_agreement(m: Models, observed: dict[str, int]) -> None:
    """Data tests and cross-check, side by side; raise on the first that fails."""
    sinks.side_by_side({"tests": lambda: require_tests(m, observed), "crosscheck": lambda: require_crosscheck(m)})


def require_tests(m: Models, observed: dict[str, int]) -> None:
    """What was observed while the models were written, and the tests that need two rows of a key."""
    tables = {name: getattr(m, name) for name, _ in checks.UNIQUE.values()}
    broken = {name: n for name, n in observed.items() if n}
    broken |= {r["check"]: r["failures"] for r in checks.key_failures(tables).filter("failures > 0").collect()}  # a row per check
    if broken:
        raise ChecksFailed(f"data tests failed: {broken}")


def require_crosscheck(m: Models) -> None:
    gaps = crosscheck.differences(
        crosscheck.recompute(m.events, m.cfg.steps), crosscheck.model_totals(m.funnel_segments, m.cfg.steps)
    )
    found = [r.asDict() for r in gaps.collect()]  # a row per metric
    if found:
        raise ChecksFailed(f"cross-check failed: {found}")


def build(
    spark: SparkSession, raw: str, out: str, cfg: Config | None = None, source: str | None = None, keep_runs: int = 3
) -> Models:
    """Raw Parquet under ``raw`` to models, results and exports under ``out``; stops at the first failure.

    A run writes to a folder of its own, ``out/runs/<id>``, and is appended to the log of published runs only after audit,
    data tests and cross-check have passed: a run that fails leaves readers where they were. ``events`` there holds the distinct raw
    rows with their number of copies. Of older runs the newest ``keep_runs`` stay, this one included, for those who are still
    reading. With ``source`` the manifest that ``ingest`` wrote must name it.

    The raw events are read twice: to count whole rows, and by the cross-check, which shares nothing with the models.
    """
    cfg = cfg or Config()
    if source is not None:
        require_source(spark, raw, source)
    run = f"{out}/{sinks.RUNS}/{uuid4().hex}"
    events, items = readers.read_events(spark, raw), readers.read_items(spark, raw)
    # Whole rows are shuffled here and nowhere else; audit and models read what this wrote, by day.
    counted = sinks.materialise(staging.row_counts(events), f"{run}/events", "event_date")
    told = sinks.side_by_side(
        {
            "audit": lambda: sinks.materialise(audit.audit(events, items, cfg, counted), f"{run}/audit"),
            "summary": lambda: sinks.materialise(audit.summary(counted), f"{run}/summary"),
        }
    )
    report, summary = told["audit"], told["summary"]
    audit.require_pass(report)  # nothing is built on rows that fail
    m, observed = materialise_models(Models(events, cfg, counted), f"{run}/models")
    require_agreement(m, observed)
    blocks: dict[str, DataFrame] = result_blocks(m, items, source, summary, report)
    exports = export_frames(m, summary)
    sinks.side_by_side(
        {
            "results": lambda: sinks.write_results(blocks, f"{run}/results"),
            "exports": lambda: sinks.write_exports(exports, f"{run}/exports"),
        }
    )
    sinks.publish(spark, out, run)
    sinks.remove_old_runs(spark, out, keep_runs)
    return m


def published(spark: SparkSession, out: str) -> str:
    """The folder of the newest run that passed."""
    runs = sinks.published_runs(spark, out)
    if not runs:
        raise ValueError(f"nothing is published under {out}")
    return runs[-1]["run"]
