"""Every result block and export, as frames over the models."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventlens.operators import analysis, audit, experiment
from eventlens.plans.models import Models
from eventlens.sources import sinks


def result_blocks(
    m: Models, items: DataFrame, source: str | None = None, summary: DataFrame | None = None, report: DataFrame | None = None
) -> dict[str, DataFrame]:
    """Name to frame; each is small, and none is computed until it is written or shown.

    ``summary`` and ``report`` (audit) may be written already; else they are computed from the counted or raw rows.
    """
    cfg, seg = m.cfg, m.funnel_segments
    ordered = analysis.funnel_rates(seg, cfg.steps)
    everyone = ordered.filter("segment_type = 'all'")
    gap = analysis.segment_gap(seg, cfg.steps, *cfg.gap_pair, alpha=cfg.alpha)
    target = analysis.target_step(gap, everyone)
    tree = analysis.metric_tree(m.weekly_metrics, cfg.holiday_start)
    peak = analysis.peak_week(tree)
    channels = analysis.channels(seg, cfg.steps[-1], cfg.small_sample)
    design = experiment.experiment_design(m.user_windows, target, cfg)
    return {
        "source": m.events.sparkSession.range(1).select(F.lit(source).cast("string").alias("source")),
        "summary": audit.summary(m.rows) if summary is None else summary,
        "audit": audit.audit(m.events, items, cfg, m.counted) if report is None else report,
        "headline": analysis.headline(seg),
        "leak": analysis.biggest_leak(everyone),
        "target": target,
        "funnel_ordered": ordered,
        "funnel_open": analysis.funnel_rates(seg, cfg.steps, "any"),
        "opportunity": gap,
        "areas": analysis.area_opportunity(m.area_funnel, cfg),
        "area_totals": analysis.area_totals(m.area_funnel, cfg),
        "metric_tree": tree,
        "baseline_weeks": tree.filter("is_baseline").select("week_start"),
        "peak_week": peak,
        "channels": channels,
        "retention": m.cohort_retention,
        "retention_matrix": analysis.retention_cells(m.cohort_retention),
        "retention_weighted": analysis.weighted_retention(m.cohort_retention, cfg.retention_offsets),
        "largest_gap": analysis.largest_gap(gap),
        "quietest_week": analysis.quietest_week(tree),
        "growth_drivers": analysis.growth_drivers(peak),
        "channel_facts": analysis.channel_facts(channels),
        "observed_cohorts": analysis.observed_cohorts(m.cohort_retention),
        **{f"experiment_{name}": df for name, df in design.items()},
    }


def export_frames(m: Models, summary: DataFrame | None = None) -> dict[str, DataFrame]:
    """The six flat tables a dashboard reads."""
    cfg, seg = m.cfg, m.funnel_segments
    return {
        "headline": sinks.export_headline(audit.summary(m.rows) if summary is None else summary, analysis.headline(seg)),
        "funnel_by_device": sinks.export_funnel_by_device(analysis.funnel_rates(seg, cfg.steps)),
        "store_sections": sinks.export_store_sections(analysis.area_opportunity(m.area_funnel, cfg)),
        "weekly_revenue": sinks.export_weekly_revenue(analysis.metric_tree(m.weekly_metrics, cfg.holiday_start)),
        "channels": sinks.export_channels(analysis.channels(seg, cfg.steps[-1], cfg.small_sample)),
        "retention": sinks.export_retention(m.cohort_retention),
    }
