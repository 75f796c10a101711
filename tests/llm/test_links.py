"""Components, candidate buckets, the Jaccard join and embedding near-duplicates against brute force."""

from __future__ import annotations

import math
import random
import re

import numpy as np
import pytest

from conftest import SMALL
from eventlens.llm import candidates, embeddings, exact, jaccard
from eventlens.llm.graph import components
from eventlens.llm.queries import op5_jaccard, op6_embeddings


def closure(nodes, links) -> dict:
    root = {n: n for n in nodes}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


@pytest.mark.parametrize("shape", ["chain", "star", "random", "none"])
def test_components(spark, shape):
    rng = random.Random(3)
    links = {
        "chain": [(k, k + 1) for k in range(60)],
        "star": [(99, k) for k in range(60)],
        "random": [(rng.randrange(80), rng.randrange(80)) for _ in range(60)],
        "none": [(5, 5)],
    }[shape]
    rng.shuffle(links)
    got = {r.node: r.root for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    ends = {n for a, b in links if a != b for n in (a, b)}
    assert got == closure(ends, [x for x in links if x[0] != x[1]])


def shingles(text: str | None, n: int = 5) -> frozenset:
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    return frozenset(tuple(w[k : k + n]) for k in range(max(len(w) - n + 1, min(len(w), 1))))


def brute(rows: list[tuple], threshold: float = 0.8) -> dict:
    """By place in ``rows``: class_id, n_links, group_id, kept."""
    sets = [shingles(t) for _, t in rows]
    key = [(i is None, i if i is not None else 0) for i, _ in rows]
    alike = lambda a, b: a == b or (len(a | b) > 0 and len(a & b) / len(a | b) >= threshold)
    links = [(a, b) for a in range(len(rows)) for b in range(len(rows)) if a != b and alike(sets[a], sets[b])]
    group = closure(range(len(rows)), [x for x in links if x[0] < x[1]])
    out = {}
    for k in range(len(rows)):
        first = min((j for j in range(len(rows)) if sets[j] == sets[k]), key=lambda j: key[j])
        head = min((j for j in range(len(rows)) if group[j] == group[k]), key=lambda j: key[j])
        same = sets[head] == sets[k] and rows[k][0] == rows[head][0]
        out[k] = (rows[k][0], rows[first][0], sum(a == k for a, _ in links), rows[head][0], same)
    return out


def edited(rng: random.Random, words: list[str], share: float) -> str:
    return " ".join(f"e{rng.randrange(10**6)}" if rng.random() < share else w for w in words)


def corpus(rng: random.Random, groups: int, size: int) -> list[str | None]:
    texts: list[str | None] = [None, "", "  ", "one two", "one two", "one  two three four five", "single"]
    for _ in range(groups):
        base = [f"w{rng.randrange(10**6)}" for _ in range(rng.randint(6, 120))]
        texts += [edited(rng, base, rng.choice([0, 0.01, 0.02, 0.03, 0.05])) for _ in range(size)]
    passage = " ".join(f"p{k}" for k in range(60))
    texts += [f"{' '.join(f'u{rng.randrange(10**6)}' for _ in range(150))} {passage}" for _ in range(12)]
    return texts


@pytest.mark.parametrize("limit", [4096, 4])
def test_jaccard_join_against_brute_force(spark, limit):
    rng = random.Random(limit)
    texts = corpus(rng, 12, 6) + [" ".join(["long"] * 40_000), " ".join(f"x{k}" for k in range(20_000))] * 2
    rows = [(k, t) for k, t in enumerate(texts)]
    rng.shuffle(rows)
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, set_id string").repartition(3)
    got = {tuple(r) for r in jaccard.linked_documents(docs, jaccard.Join(limit=limit)).collect()}
    assert got == set(brute(rows).values())
    kept = {r.doc_id for r in jaccard.deduplicated(docs, jaccard.Join(limit=limit)).collect()}
    assert kept == {i for i, _, _, _, keep in brute(rows).values() if keep}


@pytest.mark.parametrize("limit", [4096, 16])
def test_one_large_group_and_block_pairs(spark, monkeypatch, limit):
    monkeypatch.setattr(exact, "LEAST", 8)
    rng = random.Random(9)
    base = [f"w{k}" for k in range(200)]
    rows = [(k, edited(rng, base, rng.choice([0.005, 0.01, 0.02]))) for k in range(300 if limit > 300 else 90)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {tuple(r) for r in jaccard.linked_documents(docs, jaccard.Join(limit=limit)).collect()}
    assert got == set(brute(rows).values())


def test_nulls_repeats_and_an_empty_table(spark):
    rows = [(None, "a b c d e f"), (4, "a b c d e f"), (4, "a b c d e f"), (None, "q r s t u v w"), (2, "other words here and there"), (2, "a second text of one id"), (None, None)]
    docs = spark.createDataFrame([(i, t, 1.5) for i, t in rows], "doc_id long, text string, node double")
    got = sorted(map(tuple, jaccard.linked_documents(docs).collect()), key=str)
    assert got == sorted(brute(rows).values(), key=str)
    left = jaccard.deduplicated(docs)
    assert left.columns == docs.columns
    assert sorted(map(str, ((r.doc_id, r.text) for r in left.collect()))) == sorted(map(str, {rows[1], rows[3], rows[4], rows[5], rows[6]}))
    assert jaccard.linked_documents(docs.limit(0)).count() == 0 and jaccard.deduplicated(docs.limit(0)).count() == 0


def test_jaccard_query_over_the_whole_table(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()]
    assert {tuple(r) for r in op5_jaccard(spark, SMALL).collect()} == set(brute(rows).values())


def brute_vectors(rows: list[tuple], threshold: float = 0.93) -> list[tuple]:
    def usable(v, label):
        return label is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)

    def alike(a, b):
        (_, u, x), (_, v, y) = rows[a], rows[b]
        if x != y or len(u) != len(v):
            return False
        u, v = np.array(u, float), np.array(v, float)
        u, v = u / np.abs(u).max(), v / np.abs(v).max()
        return u @ v / np.sqrt((u @ u) * (v @ v)) >= threshold

    ok = [k for k, (_, v, label) in enumerate(rows) if usable(v, label)]
    links = [(a, b) for a in ok for b in ok if a < b and alike(a, b)]
    group = closure(range(len(rows)), links)
    out = []
    for k, (i, _, _) in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if group[j] == group[k] and rows[j][0] is not None]
        smallest = min(ids) if ids else None
        out.append((i, sum(k in x for x in links), smallest, i == smallest))
    return sorted(out, key=str)


def vectors(rng: np.random.Generator, dims: int) -> list[tuple]:
    rows, k = [], 0
    for label in range(4):
        for _ in range(15):
            base = rng.standard_normal(dims)
            for noise in (0, 0, 0.05, 0.15, 0.25, 0.35):
                rows.append((k, [float(np.float32(x)) for x in base + noise * rng.standard_normal(dims)], label))
                k += 1
    return rows


@pytest.mark.parametrize("limit,dims", [(4096, 32), (8, 32), (4096, 6)])
def test_embedding_links_against_brute_force(spark, limit, dims):
    rows = vectors(np.random.default_rng(limit), dims)
    got = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<float>, label int, unit string")
    got = embeddings.near_duplicates(got.repartition(3), embeddings.Near(limit=limit))
    assert got.columns == ["vec_id", "n_links", "component_id", "kept"]
    want = brute_vectors(rows)
    found = sorted(map(tuple, got.collect()), key=str)
    assert sum(r[1] for r in found) >= 0.99 * sum(r[1] for r in want)
    assert all(a[1] <= b[1] for a, b in zip(found, want, strict=True))
    if limit == 4096:
        assert found == want


def test_unusable_vectors_link_with_nothing(spark):
    nan, inf, v = float("nan"), float("inf"), [1.0, 2.0, 3.0]
    rows = [(1, v, 1), (2, [2.0, 4.0, 6.0], 1), (3, v, 2), (4, v, None), (5, None, 1), (6, [], 1), (7, [0.0, 0.0, 0.0], 1), (8, [1.0, None, 3.0], 1)]
    rows += [(9, [1.0, nan, 3.0], 1), (10, [1.0, inf, 3.0], 1), (None, v, 1), (1, v, 1), (11, [1.0, 2.0, 3.0, 0.0], 1), (12, [1e300, 2e300, 3e300], 1), (None, None, 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = sorted(map(tuple, embeddings.near_duplicates(df).collect()), key=str)
    assert got == brute_vectors(rows)
    for part in (df.limit(0), df.filter("vec_id = 5")):
        assert embeddings.near_duplicates(part).count() == part.count()


def test_embedding_query_over_the_whole_table(spark):
    rows = [(r.vec_id, r.embedding, r.label) for r in spark.read.parquet(f"{SMALL}/embeddings.parquet").collect()]
    assert sorted(map(tuple, op6_embeddings(spark, SMALL).collect()), key=str) == brute_vectors(rows)


def test_recall_of_tables_before_ranking():
    """At the threshold itself: the share of pairs that some table brings together."""
    rng = np.random.default_rng(4)
    base = rng.standard_normal((4000, 64))
    base /= np.linalg.norm(base, axis=1, keepdims=True)
    noise = rng.standard_normal(base.shape)
    noise -= (noise * base).sum(axis=1, keepdims=True) * base
    noise /= np.linalg.norm(noise, axis=1, keepdims=True)
    other = 0.93 * base + np.sqrt(1 - 0.93**2) * noise
    conf = embeddings.Near()
    codes = embeddings.quantiser(base, 1 << 16, conf)
    a, b = (codes.of(x)[:, : codes.tables * codes.length].reshape(len(x), codes.tables, codes.length) for x in (base, other))
    assert (a == b).all(axis=2).any(axis=1).mean() >= 0.95
    assert 0.4 < codes.of(base).mean() < 0.6


def test_forest():
    linked = np.zeros((6, 6), bool)
    for a, b in ((5, 3), (3, 1), (4, 2)):
        linked[a, b] = linked[b, a] = True
    assert candidates.forest(linked).tolist() == [0, 1, 2, 1, 2, 1]


def test_classes_are_numbered_apart(spark):
    """Nodes of the graph are numbers of classes, not parts of hashes: no two classes are ever one."""
    docs = spark.createDataFrame([(k, f"text number {k} of many unlike others {k * 7}") for k in range(300)], "doc_id long, text string").repartition(5)
    _, by = jaccard.classes(docs, jaccard.Join())
    assert by.select("node").distinct().count() == by.count() == 300


def test_kept_ids_with_several_rows(spark):
    """One id with different texts: of the same words one row stays, of other words each; equal rows are one."""
    words = "one two three four five six seven eight nine ten"
    rows = [(1, words), (1, words), (1, words.replace(" ", "  ")), (1, "quite another text that is like nothing else here"), (2, words), (3, None), (3, None), (3, ""), (None, words)]
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, digest string").repartition(3)
    out = jaccard.deduplicated(docs)
    assert out.columns == docs.columns
    got = sorted(((r.doc_id, " ".join((r.text or "").split())) for r in out.collect()), key=str)
    assert got == [(1, words), (1, "quite another text that is like nothing else here"), (3, "")]


def at_threshold(n: int, dims: int, crowd: float, seed: int, cosine: float = 0.9301) -> np.ndarray:
    """Unit vectors in pairs at one cosine; ``crowd`` is about the mean cosine of any two of different pairs."""
    rng = np.random.default_rng(seed)
    base = rng.standard_normal((n, dims))
    base *= math.sqrt(1 - crowd) / np.linalg.norm(base, axis=1, keepdims=True)
    common = rng.standard_normal(dims)
    base += math.sqrt(crowd) * common / np.linalg.norm(common)
    base /= np.linalg.norm(base, axis=1, keepdims=True)
    off = rng.standard_normal((n, dims))
    off -= (off * base).sum(axis=1, keepdims=True) * base
    off /= np.linalg.norm(off, axis=1, keepdims=True)
    return np.concatenate([base, cosine * base + math.sqrt(1 - cosine**2) * off])


@pytest.mark.parametrize(("dims", "crowd"), [(32, 0.0), (256, 0.8), (768, 0.8)])
def test_recall_at_the_threshold(spark, dims, crowd):
    """Pairs just above it, of vectors that point anywhere and of vectors that crowd around one direction."""
    n = 600
    v = at_threshold(n, dims, crowd, dims)
    rows = spark.createDataFrame([(k, "a", x.tolist()) for k, x in enumerate(v)], "vec_id long, label string, embedding array<double>").repartition(4)
    links = {r.vec_id: r.n_links for r in embeddings.near_duplicates(rows).collect()}
    met = v @ v.T >= 0.93
    np.fill_diagonal(met, False)
    want = met.sum(axis=1)
    assert all(links[k] <= want[k] for k in range(2 * n))
    assert sum(links.values()) >= 0.97 * want.sum()


@pytest.mark.parametrize("spread", [1.0, 0.3, 0.05])
def test_a_vector_has_a_bounded_number_of_keys(spread):
    rng = np.random.default_rng(3)
    unit = rng.standard_normal((500, 64)) * math.sqrt(spread / 64)
    unit[:, 0] += math.sqrt(max(0.0, 1 - spread))
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    for size in (1_000, 10**7, 10**10):
        codes = embeddings.quantiser(unit, size, embeddings.Near(rounds=2))
        assert codes.tables <= 128 and codes.axes.shape[1] >= codes.tables * codes.length
