"""Targets against a plain reading of the rule, and what the cube method keeps."""

from __future__ import annotations

import re

import numpy as np
import pytest

from conftest import SMALL
from eventlens.llm import mixing
from eventlens.llm.queries import op8_mixing


def wanted(size: dict, total: float = 1.5, cap: float = 2.0, weights=(3, 1, 2)) -> dict:
    """Share by weight, cap, share the excess again until none is above."""
    order = sorted(size, key=lambda s: (s is None, s or ""))
    weight = {s: weights[k % len(weights)] for k, s in enumerate(order)}
    target, open_, left = {}, set(order), total * sum(size.values())
    while True:
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = [s for s in open_ if share[s] > cap * size[s]]
        if not over:
            return target | share
        for s in over:
            target[s] = cap * size[s]
            left -= target[s]
            open_.discard(s)
        if not open_:
            return target


def words(text: str | None) -> int:
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


@pytest.mark.parametrize("size", [{"a": 100, "b": 100, "c": 100}, {"a": 5, "b": 1000, "c": 10, None: 7}, {"a": 0, "b": 3}, {"é": 4, "z": 1, "": 90, "b": 8, "c": 8, "d": 2}, {"a": 9}])
def test_targets(spark, size):
    rows = [(s, n) for s, n in size.items()]
    got = {r.source: r.target for r in mixing.targets(spark.createDataFrame(rows, "source string, size long"), mixing.Mix()).collect()}
    assert got == pytest.approx(wanted(size))


def test_flight_keeps_both_totals_and_its_probabilities():
    rng = np.random.default_rng(1)
    size = rng.integers(1, 500, 60).astype(float)
    share = rng.uniform(0.2, 0.8, 60)
    hits = np.zeros(60)
    for seed in range(400):
        p = mixing.flight(share, share, size, np.random.default_rng(seed))
        assert ((p > 0) & (p < 1)).sum() <= 2 and (p >= 0).all() and (p <= 1).all()
        assert p @ (size / share) == pytest.approx(size.sum()) and (p / share).sum() == pytest.approx(60)
        hits += mixing.landing(p, share, size, np.random.default_rng(seed + 1000))
    assert np.abs(hits / 400 - share).max() < 0.12
    equal = mixing.flight(np.full(9, 1 / 3), np.full(9, 1 / 3), np.full(9, 5.0), np.random.default_rng(0))
    assert equal.sum() == pytest.approx(3) and ((equal > 0) & (equal < 1)).sum() <= 2


def documents(spark, n: int, blocks: int = 3):
    rng = np.random.default_rng(n)
    rows = [(k, "w " * int(rng.integers(0, 60)), [None, "s", "t", "u"][min(3, int(rng.integers(0, 9)) // 2)], k) for k in range(n)]
    return spark.createDataFrame(rows + rows[:5] + [(None, None, None, None)], "doc_id long, text string, source string, taken long").repartition(blocks)


def test_mix_comes_near_its_targets_and_repeats(spark):
    docs = documents(spark, 3000)
    conf = mixing.Mix(block=16)  # three levels
    got = mixing.mix(mixing.sizes(docs).select("doc_id", "source", "size", "text"), conf).collect()
    assert len(got) == 3006 and all(r.size == words(r.text) and 0 <= r.taken <= 2 * r.size and r.taken == r.size * r.copies for r in got)
    for source in {r.source for r in got}:
        own = [r for r in got if r.source == source]
        assert {r.source_size for r in own} == {sum(r.size for r in own)}
        assert sum(r.taken for r in own) == pytest.approx(own[0].target, abs=2 * 60)
        part = own[0].target / own[0].source_size
        assert sum(r.copies for r in own if r.size) == pytest.approx(part * sum(r.size > 0 for r in own), abs=6)
    again = mixing.mix(mixing.sizes(docs.repartition(5)).select("doc_id", "source", "size", "text"), conf).collect()
    assert sorted(map(str, again)) == sorted(map(str, got))


def test_mixed_rows_and_clashing_columns(spark):
    docs = documents(spark, 200).withColumn("size", docs_size()).withColumn("copies", docs_size())
    out = mixing.mixed(docs)
    assert out.columns == docs.columns
    rows, have = out.collect(), docs.count()
    assert sum(words(r.text) for r in rows) == pytest.approx(1.5 * sum(words(r.text) for r in docs.collect()), rel=0.05)
    assert have and {tuple(r) for r in rows} <= {tuple(r) for r in docs.collect()}
    assert mixing.mixed(docs.limit(0)).count() == 0
    assert mixing.mixed(docs.filter("text is null")).count() == 0


def docs_size():
    from pyspark.sql import functions as F

    return F.lit("own")


def test_query_over_the_whole_table(spark):
    rows = {r.doc_id: (r.source, words(r.text)) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    size: dict = {}
    for source, n in rows.values():
        size[source] = size.get(source, 0) + n
    target = wanted(size)
    got = op8_mixing(spark, SMALL).collect()
    assert len(got) == len(rows)
    taken: dict = {}
    for r in got:
        source, n = rows[r.doc_id]
        assert (r["size"], r.source_size) == (n, size[source]) and r.target == pytest.approx(target[source])
        assert r.taken in (0, n, 2 * n)
        taken[source] = taken.get(source, 0) + r.taken
    biggest = max(n for _, n in rows.values())
    assert all(abs(taken[s] - target[s]) <= 2 * biggest for s in size)
    assert sum(taken.values()) == pytest.approx(sum(target.values()), rel=0.1)
