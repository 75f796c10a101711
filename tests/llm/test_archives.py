"""WARC archives: which records revisit, and that everything is read back."""

from __future__ import annotations

import base64
import hashlib

import pytest

from conftest import SMALL
from eventlens.llm import warc
from eventlens.llm.queries import op9_warc


def wanted(rows: list[tuple], min_bytes: int = 0) -> list[tuple]:
    payload = [(h or "").encode() for _, h in rows]
    out = []
    for (i, _), p in zip(rows, payload, strict=True):
        ids = [rows[k][0] for k, q in enumerate(payload) if q == p and rows[k][0] is not None]
        first = min(ids) if ids else None
        revisit = first is not None and i != first and len(p) >= min_bytes
        digest = base64.b32encode(hashlib.sha1(p).digest()).decode()
        out.append((i, len(p), digest, "revisit" if revisit else "response", first if revisit else None))
    return sorted(out, key=str)


def stored(spark, df, path: str, **kw) -> list:
    warc.write(df, path, **kw)
    return warc.read(spark, path).collect()


@pytest.mark.parametrize("min_bytes", [0, 6])
def test_archives_against_brute_force(spark, tmp_path, min_bytes):
    rows = [(k, f"page {k % 7} é\r\n\r\nWARC/1.1 \n\x00" * (k % 3)) for k in range(40)]
    rows += [(50, None), (51, ""), (None, "page"), (None, "page"), (60, "page"), (61, "x" * 300_000), (62, "x" * 300_000), (63, "lone"), (None, "no other")]
    df = spark.createDataFrame([(i, None if i and i % 5 == 0 else f"http://h/{i}?a b\r\nX: y", h, "x") for i, h in rows], "page_id long, url string, html string, revisit string").repartition(4)
    got = stored(spark, df, str(tmp_path / "w"), min_bytes=min_bytes)
    assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got), key=str) == wanted(rows, min_bytes)
    text = {i: h or "" for i, h in rows if i is not None}
    assert all(bytes(r.payload).decode() == text[r.page_id] for r in got if r.record_type == "response" and r.page_id is not None)
    assert all(r.payload is None for r in got if r.record_type == "revisit")


@pytest.mark.parametrize(("hot", "most_bits"), [(2, 1 << 20), (1 << 16, 64), (3, 1024)])
def test_hot_digests_and_crowded_bitmaps(spark, tmp_path, hot, most_bits):
    """Half of all pages under one digest, by the broadcast way and not; bitmaps so small that responses share the bits of revisits."""
    rows = [(k, "the same page") for k in range(0, 600, 2)] + [(k, f"page {k % 250}") for k in range(1, 600, 2)] + [(None, "the same page"), (700, "y" * 200_000)]
    df = spark.createDataFrame([(i, f"http://h/{i}", h) for i, h in rows], "page_id long, url string, html string").repartition(5)
    got = stored(spark, df, str(tmp_path / "w"), hot=hot, most_bits=most_bits, file_bytes=50_000)
    assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got), key=str) == wanted(rows)
    assert (tmp_path / "w" / "rest").exists() == (most_bits <= 1024)
    text = dict(rows)
    assert all(bytes(r.payload).decode() == text[r.page_id] for r in got if r.record_type == "response")


def test_payloads_are_not_shuffled(spark, tmp_path):
    """What goes through an exchange are headers; pages meet maps only."""
    df = spark.createDataFrame([(k, "u", f"p{k % 3}") for k in range(30)], "page_id long, url string, html string")
    headers = warc.with_headers(df).drop("_payload")
    again = warc.revisits(headers)
    told = spark.sparkContext.broadcast([warc.bitmap(again, 1, 1024)])
    assert "_payload" not in again.columns and again.count() == 27
    plan = warc.marked(warc.with_headers(df), told, (1,), False)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan


def test_repeated_rows_and_an_empty_table(spark, tmp_path):
    df = spark.createDataFrame([(1, "u", "same"), (1, "u", "same"), (2, "u", "same")], "page_id long, url string, html string")
    assert sorted((r.page_id, r.record_type, r.refers_to) for r in stored(spark, df, str(tmp_path / "a"))) == [(1, "response", None), (1, "response", None), (2, "revisit", 1)]
    assert stored(spark, df.limit(0), str(tmp_path / "b")) == []


def test_files_hold_only_records_and_damage_is_found():
    payload = b"<p>\r\n\r\n</p>"
    sha1 = hashlib.sha1(payload).hexdigest()
    one = warc.record(3, "http://h", sha1, len(payload), payload, None, "2000-01-01T00:00:00Z")
    two = warc.record(4, None, sha1, len(payload), None, 3, "2000-01-01T00:00:00Z")
    found = list(warc.records(one + warc.END + two + warc.END))
    assert [f["WARC-Type"] for f, _ in found] == ["response", "revisit"] and found[0][1].endswith(b"\r\n\r\n<p>\r\n\r\n</p>")
    assert found[1][0]["WARC-Profile"] == warc.REVISIT_PROFILE and found[1][0]["WARC-Refers-To"] == "<urn:page:3>"
    for damaged in (one[:-1] + warc.END, b"x" + one + warc.END):
        with pytest.raises(ValueError, match="record"):
            list(warc.records(damaged))


def test_query_over_the_whole_table(spark):
    rows = [(r.page_id, r.html) for r in spark.read.parquet(f"{SMALL}/pages.parquet").collect()]
    assert sorted(map(tuple, op9_warc(spark, SMALL).collect()), key=str) == wanted(rows)
