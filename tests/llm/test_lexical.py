"""Ranked search against scores of all documents, and what the bounds let through."""

from __future__ import annotations

import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from conftest import SMALL
from eventlens.llm import lexical
from eventlens.llm.queries import op12_lexical

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text: str | None) -> list[str]:
    return TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def wanted(items: list[tuple], docs: list[tuple], top: int) -> list[tuple]:
    counts = [(i, Counter(terms(t))) for i, t in docs]
    counts = [(i, c) for i, c in counts if c]
    n_docs, n_terms = len(counts), sum(sum(c.values()) for _, c in counts)
    df = Counter(t for _, c in counts for t in c)
    out = []
    for item, text in items:
        asked = {t: math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) for t in terms(text)}
        scores = []
        for i, c in counts:
            m = 50 + (50 * sum(c.values()) * n_docs) // n_terms
            scores.append((-sum(w * ((1_000_000_000 * c[t]) // (1000 * c[t] + 20 * m)) for t, w in asked.items()), i is None, i))
        out += [(item, k + 1, i, -s) for k, (s, _, i) in enumerate(sorted(x for x in scores if x[0] < 0)[:top])]
    return sorted(out, key=str)


def tables(spark, items: list[tuple], docs: list[tuple], parts: int = 4):
    return (
        spark.createDataFrame([(*r, "x") for r in items], "item_id long, text string, score string"),
        spark.createDataFrame([(*r, 1.0) for r in docs], "doc_id long, text string, norm double").repartition(parts),
    )


def found(df) -> list[tuple]:
    return sorted(((r.item_id, r.rank, r.doc_id, r.score) for r in df.collect()), key=str)


def corpus(n: int, seed: int = 1) -> tuple[list[tuple], list[tuple]]:
    rng = random.Random(seed)
    words = [f"w{int(rng.paretovariate(0.7)) % 200}" for _ in range(4000)] + ["É漢", "ABC-def", "x1y", "￿"]
    docs = [(k, " ".join(rng.choices(words, k=rng.choice([0, 1, 5, 30, 200])))) for k in range(n)]
    docs += [(n + k, docs[5 + k % 3][1]) for k in range(n // 3)]  # copies
    docs += [docs[7], (None, docs[7][1]), (n * 2, None), (n * 2 + 1, ".,!"), (n * 2 + 2, "W1 " * 60_000)]
    items = [(k, " ".join(rng.choices(words, k=rng.choice([1, 3, 20])))) for k in range(12)]
    return [*items, (0, "w3 w4"), (90, None), (91, "no such"), (92, "É漢")], docs


@pytest.mark.parametrize(("conf", "parts"), [(lexical.Search(), 4), (lexical.Search(top=7, head=20, bucket=16), 3), (lexical.Search(top=3, head=1, bucket=4, block_terms=25, focus=2), 1)])
def test_search_against_all_scores(spark, conf, parts):
    items, docs = corpus(300)
    got = lexical.search(*tables(spark, items, docs, parts), conf)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert found(got) == wanted(items, docs, conf.top)


def test_empty_tables(spark):
    items, docs = tables(spark, [(1, "a b")], [(1, "a b"), (2, "c")])
    assert lexical.search(items.limit(0), docs).collect() == []
    assert lexical.search(items, docs.limit(0)).collect() == []
    assert lexical.search(items, docs.filter("doc_id = 2")).collect() == []
    assert [r.doc_id for r in lexical.search(items, docs).collect()] == [1]


def bucket_of(rows: list[dict[int, int]]) -> lexical.Bucket:
    norm = [math.sqrt(sum(x * x for x in r.values())) for r in rows]
    columns = [pa.array([list(r) for r in rows], pa.list_(pa.int32())), pa.array([list(r.values()) for r in rows], pa.list_(pa.int64())), pa.array(norm)]
    return lexical.Bucket(pa.RecordBatch.from_arrays(columns, ["term", "impact", "norm"]))


def test_bounds_pass_over_rows_but_never_a_hit():
    rng = np.random.default_rng(4)
    passed_over = pruned = 0
    for _ in range(300):
        rows = [{int(t): int(rng.integers(1, 1000)) for t in rng.choice(12, rng.integers(1, 8), replace=False)} for _ in range(40)]
        term = rng.choice(12, 5, replace=False)
        weight = np.sort(rng.integers(1, 9000, 5))[::-1]
        score = np.array([sum(int(w) * r.get(int(t), 0) for t, w in zip(term, weight, strict=True)) for r in rows])
        length = math.sqrt(float((weight.astype(float) ** 2).sum()))
        for threshold in (1, int(np.median(score)) + 1, int(score.max()), int(score.max()) + 1, int(score.max() * 1.5) + 1):
            alive = lexical.survivors(bucket_of(rows), term, weight, length, threshold, 5)
            if alive is None:
                pruned += 1
                assert score.max() < threshold
            else:
                assert alive[score >= threshold].all()
                passed_over += int((~alive).sum())
    assert passed_over > 1000 and pruned > 50


def test_query_over_the_whole_table(spark):
    items, docs = ([tuple(r) for r in spark.read.parquet(f"{SMALL}/{t}.parquet").select(c, "text").collect()] for t, c in (("benchmark", "item_id"), ("documents", "doc_id")))
    assert found(op12_lexical(spark, SMALL)) == wanted(items, docs, 50)
