"""Held-out accuracy, edge cases and the bound of the training sample."""

from __future__ import annotations

import random
import zlib

import numpy as np
import pytest

from conftest import SMALL
from eventlens.llm import classify, quality, toxicity
from eventlens.llm.queries import op1_quality, op3_toxicity
from eventlens.llm.subword import Subwords, train

FAST = Subwords(buckets=1 << 14, epochs=6)


def prose(rng: random.Random, n: int) -> str:
    parts = ["an", "er", "the", "ing", "on", "ti", "re", "nd", "ha", "st"]
    return " ".join("".join(rng.choice(parts) for _ in range(rng.randint(1, 4))) for _ in range(n))


def insulted(rng: random.Random, word: str) -> str:
    return f"{prose(rng, 15)} {word} {prose(rng, 15)} {word}"


def test_unseen_misspellings_share_vectors():
    rng = random.Random(1)
    texts = [prose(rng, 32) for _ in range(150)] + [insulted(rng, rng.choice(["blockhead", "blockheads", "blokhead", "blockhed"])) for _ in range(150)]
    model = train(texts, [0] * 150 + [1] * 150, FAST)
    seen = model.probabilities([insulted(rng, w) for w in ("blockheadz", "bblockhead", "blockhe4d")])[:, 1]
    assert (seen > 0.6).all()
    assert np.mean(model.probabilities([prose(rng, 32) for _ in range(50)])[:, 1] < 0.5) > 0.9


def test_repetition_is_learned_apart_from_the_word():
    rng = random.Random(2)
    junk = lambda: " ".join([prose(rng, 1)] * 30)
    model = train([prose(rng, 30) for _ in range(100)] + [junk() for _ in range(100)], [1] * 100 + [0] * 100, FAST)
    unseen = ["".join(rng.choice("bcdfgjklmpqvwxyz") for _ in range(5)) for _ in range(30)]
    once, again = " ".join(unseen), [" ".join([w] * 30) for w in unseen]
    assert np.mean(model.probabilities(again)[:, 1]) < model.probabilities([once])[0, 1] - 0.1


def test_score_is_the_softmax_of_the_mean_vector():
    model = train(["a b", "c d"], [0, 1], Subwords(buckets=64, epochs=2))
    p = model.probabilities(["a b", "", None, "a b " * 4000])
    assert np.allclose(p.sum(axis=1), 1) and np.allclose(p[1], p[2])
    assert np.allclose(p[1], np.exp(model.bias) / np.exp(model.bias).sum())


@pytest.mark.parametrize("labels,want", [([], 0.0), ([(1, 1, 1)], 1.0), ([(1, 0, 0)], 0.0), ([(1, None, None), (None, 1, 1)], 0.0)])
def test_one_class_or_none(spark, labels, want):
    docs = spark.createDataFrame([(1, "x y", 0.5), (None, None, None), (1, "x y", 0.5)], "doc_id long, text string, score double")
    table = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    conf = quality.Quality(folds=7, model=FAST)
    rows = quality.quality_scores(docs, table, conf).collect()
    assert len(rows) == 3 and {r.score for r in rows} == {want} and {r.predicted for r in rows} == {int(want >= 0.3)}
    assert {r.held_out for r in rows if r.doc_id is None} == {False}


def test_extra_columns_stay_and_tables_may_be_empty(spark):
    docs = spark.createDataFrame([(k, f"word{k % 2} said", "own", k, [k]) for k in range(20)], "doc_id long, text string, predicted string, toxic long, held_out array<long>")
    labels = spark.createDataFrame([(k, k % 2, k % 2) for k in range(20)], "doc_id long, quality int, toxic int")
    out = toxicity.toxicity_scores(docs, labels, toxicity.Toxicity(model=FAST))
    assert out.columns == ["doc_id", "text", "predicted", "toxic", "held_out", "score"] and out.count() == 20
    assert toxicity.toxicity_scores(docs.limit(0), labels, toxicity.Toxicity(model=FAST)).count() == 0


def test_sample_is_bounded_and_leaves_held_out_rows(spark, monkeypatch):
    docs = spark.createDataFrame([(k, f"text {k}") for k in range(200)] + [(3, "text of the same id")], "doc_id long, text string")
    labels = spark.createDataFrame([(k, k % 2) for k in range(200)], "doc_id long, quality int")
    seen: list = []
    monkeypatch.setattr(classify, "train", lambda texts, y, conf: seen.append((texts, y)) or train(texts, y, conf))
    conf = quality.Quality(model=Subwords(buckets=64, epochs=1, max_docs_per_class=10))
    quality.quality_scores(docs, labels, conf)
    texts, y = seen[0]
    assert len(texts) == 20 and sum(y) == 10
    assert all(zlib.crc32(t.split()[1].encode()) % 5 != 0 for t in texts if t.split()[1].isdigit())
    quality.quality_scores(docs, labels, quality.Quality(model=Subwords(buckets=64, epochs=1, max_chars=60)))
    assert sum(map(len, seen[1][0])) <= 60


# The small table has 33 toxic documents to learn from, in four languages; on 20,000 labelled ones the area is above 0.99.
@pytest.mark.parametrize("query,target,threshold,folds,held,least", [(op1_quality, "quality", 0.3, 5, 0, 0.9), (op3_toxicity, "toxic", 0.7, 3, 1, 0.7)])
def test_held_out_accuracy(spark, query, target, threshold, folds, held, least):
    sf = SMALL.replace("sf0.001", "sf0.01")
    rows = {r.doc_id: r for r in query(spark, sf).collect()}
    assert len(rows) == spark.read.parquet(f"{sf}/documents.parquet").count()
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= threshold) for r in rows.values())
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % folds == held) for i, r in rows.items())
    known = [(rows[r.doc_id].score, r[target]) for r in spark.read.parquet(f"{sf}/labels.parquet").collect() if r.doc_id in rows and rows[r.doc_id].held_out]
    one, none = [s for s, y in known if y == 1], [s for s, y in known if y == 0]
    auc = np.mean([(a > b) + (a == b) / 2 for a in one for b in none])
    assert auc > least, auc
