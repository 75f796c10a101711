from __future__ import annotations

import re
from datetime import date

import pytest
from helpers import events, hit
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from eventlens.catalog import adapter
from eventlens.config import Config
from eventlens.schema import EVENTS, ITEMS, conform
from eventlens.sources import ingest, nested, readers, sinks

from conftest import SMALL

STEPS = Config().steps
NESTED = (
    "event_date string, event_timestamp long, event_name string, user_pseudo_id string,"
    " event_params array<struct<key string, value struct<string_value string, int_value bigint>>>,"
    " traffic_source struct<source string, medium string, name string>,"
    " device struct<category string, operating_system string, web_info struct<browser string>>,"
    " geo struct<country string>,"
    " ecommerce struct<transaction_id string, purchase_revenue_in_usd double, shipping_value_in_usd double,"
    " tax_value_in_usd double, total_item_quantity bigint>,"
    " items array<struct<item_id string, item_name string, item_category string, price_in_usd double, quantity bigint,"
    " item_revenue_in_usd double>>"
)


def record(name="purchase", params=(), items=None, day="20240101"):
    return (
        day,
        1_704_067_200_000_001,
        name,
        "u",
        [(k, (s, i)) for k, s, i in params] if params is not None else None,
        ("src", "med", "nm"),
        ("mobile", "iOS", ("Safari",)),
        ("NL",),
        ("T1", 9.5, 1.0, 0.5, 3),
        items,
    )


def test_params_are_read_by_key_and_slot(spark):
    params = [
        ("ga_session_id", None, 5),
        ("ga_session_id", None, 7),
        ("ga_session_number", "3", None),
        ("session_engaged", None, 1),
        ("page_location", "https://x/", None),
        ("source", None, 4),
        ("medium", "organic", None),
        ("medium", "email", None),
    ]
    got = nested.flatten_events(spark.createDataFrame([record(params=params)], NESTED)).first()
    assert got["ga_session_id"] == 7, "a repeated key gives its largest value"
    assert got["ga_session_number"] is None and got["session_source"] is None, "another slot is not read"
    assert got["session_engaged"] == "1" and got["session_medium"] == "organic"
    assert got["session_campaign"] is None and got["page_location"] == "https://x/"
    assert str(got["event_date"]) == "2024-01-01" and got["event_ts"].isoformat() == "2024-01-01T00:00:00.000001"
    assert (got["browser"], got["country"], got["tax_usd"], got["total_item_quantity"]) == ("Safari", "NL", 0.5, 3)


def test_empty_and_missing_params(spark):
    flat = nested.flatten_events(spark.createDataFrame([record(params=()), record(params=None)], NESTED))
    assert flat.schema.names == EVENTS.names and flat.filter("ga_session_id IS NULL").count() == 2


def test_a_repeated_key_among_nulls(spark):
    params = [
        *[("ga_session_id", None, i) for i in (4, None, 9)],
        *[("source", t, None) for t in (None, None)],
        ("medium", "first", None),
        (None, "of no key", 1),
        ("page_location", "b", None),
        ("page_location", "a", None),
    ]
    row = list(record(params=params))
    row[4] = [None, *row[4], None, ("campaign", None), ("ga_session_number", (None, 2))]
    got = nested.flatten_events(spark.createDataFrame([tuple(row)], NESTED)).first()
    assert (got["ga_session_id"], got["ga_session_number"], got["page_location"]) == (9, 2, "b")
    assert (got["session_source"], got["session_medium"], got["session_campaign"]) == (None, "first", None)


def test_flattening_runs_as_compiled_code(spark, capsys):
    """The JVM interprets methods beyond 8,000 bytes; what makes up the items is not stated again in a filter."""
    nest = adapter.nest(adapter.source(spark, SMALL))
    todo = ingest.rows_of_days(nest, [f"202401{d:02d}" for d in range(1, 32)])
    for flat in (nested.flatten_events(todo), nested.flatten_items(todo)):
        assert not re.search(r"Filter .*size\(", flat._jdf.queryExecution().optimizedPlan().toString())
        flat.explain("codegen")
        sizes = [int(n) for n in re.findall(r"maxMethodCodeSize:(\d+)", capsys.readouterr().out)]
        assert sizes and max(sizes) <= 8000


def test_counts_by_day_come_from_one_aggregate(spark):
    days = [date(2024, 1, d) for d in (1, 2, 3)]
    rows = events(spark, hit(user=None), hit(at=1), hit(at=90_000), hit(at=5 * 86_400)).unionByName(
        events(spark, hit()).withColumn("event_date", F.lit(None).cast("date"))
    )
    want = {"rows_0": 2, "rows_1": 1, "rows_2": 0, "null_0_user_pseudo_id": 1, "null_1_user_pseudo_id": 0, "null_2_user_pseudo_id": 0}
    assert ingest.day_counts(rows, days, ("user_pseudo_id",)) == want
    assert ingest.day_counts(rows.limit(0), days[:1]) == {"rows_0": 0}


def test_items_of_commerce_events_only(spark):
    one = ("I", "name", "cat", 2.0, 1, 2.0)
    frame = spark.createDataFrame(
        [record(items=[one, one]), record(items=[]), record(items=None), record("page_view", items=[one])], NESTED
    )
    lines = nested.flatten_items(frame)
    assert lines.count() == 2 and lines.schema.names == ITEMS.names and lines.first()["price_usd"] == 2.0


def test_missing_column_is_refused_and_extra_dropped(spark):
    with pytest.raises(ValueError, match="missing columns"):
        conform(spark.createDataFrame([("page_view",)], "event_name string"), EVENTS)
    df = conform(events(spark, hit()).withColumn("extra", F.lit(1)).withColumn("event_date", F.col("event_date").cast("string")), EVENTS)
    assert [(f.name, f.dataType) for f in df.schema] == [(f.name, f.dataType) for f in EVENTS]


def test_reading_refuses_a_file_without_a_column(spark, tmp_path):
    events(spark, hit()).drop("country").write.parquet(f"{tmp_path}/events")
    with pytest.raises(ValueError, match="country"):
        readers.read_events(spark, str(tmp_path))


def test_flattening_undoes_nesting(spark):
    raw = adapter.source(spark, SMALL)
    flat, want = nested.flatten_events(adapter.nest(raw)), adapter.adapt_events(raw)
    assert flat.exceptAll(want).count() == 0 and want.exceptAll(flat).count() == 0


def test_gate_finds_a_wrong_slot(spark):
    good = events(spark, *[hit(at=i) for i in range(10)])
    ingest.require_populated(good)
    with pytest.raises(ingest.GateFailed, match="ga_session_id"):
        ingest.require_populated(good.withColumn("ga_session_id", F.lit(None).cast("bigint")))


def test_histogram_and_absent_steps(spark):
    df = events(spark, hit("purchase"), hit("purchase", 1), hit("scroll"))
    assert [(r["event_name"], r["rows"], r["is_step"]) for r in ingest.event_histogram(df, STEPS).collect()] == [
        ("purchase", 2, True),
        ("scroll", 1, False),
    ]
    assert {r["step"] for r in ingest.absent_steps(df, STEPS).collect()} == set(STEPS) - {"purchase"}


def test_ingest_resumes_where_it_stopped(spark, tmp_path):
    out = str(tmp_path / "raw")
    whole = adapter.nest(adapter.source(spark, SMALL))
    some = [date(2024, 1, 5), date(2024, 1, 6)]
    first = ingest.ingest(whole, out, some)
    assert [r["event_date"] for r in first.orderBy("event_date").collect()] == some
    second = ingest.ingest(whole, out, at_once=40)
    assert not set(some) & {r["event_date"] for r in second.collect()}
    assert ingest.ingest(whole, out).count() == 0
    stored, want = readers.read_events(spark, out), nested.flatten_events(whole)
    assert stored.count() == want.count() and stored.exceptAll(want).count() == 0
    assert readers.read_items(spark, out).count() == nested.flatten_items(whole).count()
    plan = readers.one_day(stored, some[0])._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(event_date" in plan, "only one directory is opened"


def test_a_run_cut_short_is_not_seen(spark, tmp_path):
    out = str(tmp_path / "raw")
    whole = adapter.nest(adapter.source(spark, SMALL))
    day = [date(2024, 1, 5)]
    # Events written, but the run ended before the day was marked as finished.
    half = nested.flatten_events(whole).filter(F.col("event_date") == F.lit(day[0])).limit(3)
    half.write.partitionBy("event_date").parquet(f"{out}/events/run=lost")
    assert ingest.finished_days(spark, out) == []
    ingest.ingest(whole, out, day)
    want = nested.flatten_events(whole).filter(F.col("event_date") == F.lit(day[0])).count()
    assert readers.read_events(spark, out).count() == want


def test_each_day_is_parsed_once_for_each_table(spark, tmp_path):
    """Gate and counts come from the writes themselves: two jobs read the source, and its rows twice in all."""
    out, src = str(tmp_path / "raw"), str(tmp_path / "nested")
    adapter.nest(adapter.source(spark, SMALL)).write.partitionBy("event_date").parquet(src)
    whole = spark.read.schema(adapter.nest(adapter.source(spark, SMALL)).schema).parquet(src)
    read = spark.sparkContext.accumulator(0)

    @F.udf("boolean")
    def seen(name):
        read.add(1)
        return True

    rows = whole.filter("event_date in ('20240105', '20240106')").count()
    watched = whole.filter(seen("event_name"))
    with_names = ingest.ingest(watched, out, [date(2024, 1, 5), date(2024, 1, 6)])
    # Listing the days asks for the filter of all rows; lines of orders are looked for in rows of commerce only.
    beyond = whole.count()
    assert with_names.count() == 2 and beyond + rows < read.value <= beyond + 2 * rows
    stored = ingest.stored_manifest(spark, out).first()
    assert stored["event_rows"] == readers.read_events(spark, out).count() and stored["item_rows"] == readers.read_items(spark, out).count()


def test_a_mostly_null_day_is_held_back(spark, tmp_path):
    out = str(tmp_path / "raw")
    whole = adapter.nest(adapter.source(spark, SMALL))
    bad = F.col("event_date").cast("string") == "20240107"
    broken = whole.withColumn("user_pseudo_id", F.when(~bad, F.col("user_pseudo_id")))
    loose = {**ingest.NULL_LIMITS, "user_pseudo_id": 0.2}
    january = [date(2024, 1, d) for d in range(1, 32)]
    with pytest.raises(ingest.GateFailed, match=r"user_pseudo_id.*2024-01-07"):
        ingest.ingest(broken, out, january, limits=loose, at_once=31)
    done = ingest.finished_days(spark, out)
    assert date(2024, 1, 7) not in done and len(done) > 20
    assert readers.read_events(spark, out).filter("user_pseudo_id is null").count() == whole.filter("user_pseudo_id is null").filter(~bad).count()
    # The day comes again, whole.
    assert [r["event_date"] for r in ingest.ingest(whole, out, january).collect()] == [date(2024, 1, 7)]
    assert readers.read_events(spark, out).exceptAll(nested.flatten_events(whole)).count() == 0


def test_manifest_of_a_day_is_one_row_of_that_run(spark, tmp_path):
    out = str(tmp_path / "raw")
    whole = adapter.nest(adapter.source(spark, SMALL))
    days = [date(2024, 1, d) for d in (5, 6, 7, 8)]
    ingest.ingest(whole, out, days[:1])
    ingest.ingest(whole, out, days, at_once=2, source="other")
    table = readers.day_table(spark, out)
    counts = {r["event_date"]: r["n"] for r in nested.flatten_events(whole).groupBy("event_date").agg(F.count("*").alias("n")).collect()}
    assert {r["event_date"]: r["event_rows"] for r in table.collect()} == {d: counts[d] for d in days}
    assert table.select("run").distinct().count() == 3  # one day, then two batches (two days and one)
    assert {r["source"]: r["days"] for r in ingest.stored_manifest(spark, out).collect()} == {"export": 1, "other": 3}
    with pytest.raises(ingest.WrongSource):
        ingest.require_source(spark, out, "export")
    # A day that is taken again replaces its rows for readers.
    again = whole.filter("event_date = '20240105'").limit(4).withColumn("event_date", F.lit("20240105"))
    spark.createDataFrame([(days[0], "again", "export", 4, 0)], readers.DAY_TABLE).withColumn("ingested_at", F.current_timestamp()).write.mode("append").parquet(f"{out}/{readers.DAYS}")
    nested.flatten_events(again).write.partitionBy("event_date").parquet(f"{out}/events/run=again")
    assert readers.one_day(readers.read_events(spark, out), days[0]).count() == 4


def test_ingest_reads_pending_days_only(spark, tmp_path):
    out, src = str(tmp_path / "raw"), str(tmp_path / "nested")
    adapter.nest(adapter.source(spark, SMALL)).write.partitionBy("event_date").parquet(src)
    whole = spark.read.schema(adapter.nest(adapter.source(spark, SMALL)).schema).parquet(src)
    ingest.ingest(whole, out, [date(2024, 1, 5)])
    keys = ingest.pending_days(whole, ingest.finished_days(spark, out))
    assert "20240105" not in keys and len(keys) > 10
    plan = ingest.rows_of_days(whole, keys[:2])._jdf.queryExecution().executedPlan().toString()
    assert re.search(rf"PartitionFilters: \[[^\]]*{keys[0]}", plan)
    assert ingest.stored_manifest(spark, out).first()["event_rows"] == readers.read_events(spark, out).count()


def test_a_broken_table_of_days_is_not_taken_for_none(spark, tmp_path):
    spark.createDataFrame([(1,)], "other int").write.parquet(str(tmp_path / "ingested_days"))
    with pytest.raises(AnalysisException):
        ingest.finished_days(spark, str(tmp_path))
    assert ingest.finished_days(spark, str(tmp_path / "none")) == []


def test_nothing_is_written_behind_a_failed_gate(spark, tmp_path):
    whole = adapter.nest(adapter.source(spark, SMALL)).withColumn("event_params", F.array().cast("array<struct<key:string,value:struct<string_value:string,int_value:bigint>>>"))
    with pytest.raises(ingest.GateFailed, match="ga_session_id"):
        ingest.ingest(whole, str(tmp_path / "raw"), at_once=100)
    assert not (tmp_path / "raw" / readers.DAYS).exists() and not list((tmp_path / "raw").glob("*/run=*"))


def test_manifest_and_source_gate(spark, tmp_path, adapted):
    path = str(tmp_path / "manifest")
    ingest.write_manifest(adapted["events"], adapted["items"], "export", path)
    got = spark.read.json(path).first()
    assert got["event_rows"] == adapted["events"].count() and got["item_rows"] == adapted["items"].count()
    assert got["days"] == adapted["events"].select("event_date").distinct().count()
    ingest.require_source(spark, str(tmp_path), "export")
    with pytest.raises(ingest.WrongSource):
        ingest.require_source(spark, str(tmp_path), "other")


def test_materialise_returns_what_was_written(spark, tmp_path):
    df = sinks.materialise(spark.range(5), str(tmp_path / "t"))
    assert df.count() == 5 and "FileScan" in df._jdf.queryExecution().executedPlan().toString()
