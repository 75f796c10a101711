"""Fingerprints, the search for all within a radius, and edited texts, against brute force."""

from __future__ import annotations

import hashlib
import random

import numpy as np
import pytest

from conftest import SMALL
from eventlens.llm import simhash
from eventlens.llm.queries import op2_simhash


def likeness(a: str, b: str) -> float:
    return 1 - (int(a, 16) ^ int(b, 16)).bit_count() / (4 * len(a))


def test_votes_follow_their_definition():
    from collections import Counter

    from eventlens.llm.textscan import mix, scan

    text = "a b c a b c a b d é"
    term, _ = next(iter(scan([text]))).word_runs(2)
    votes = np.zeros(64)
    for t, n in Counter(term.tolist()).items():
        h = int(mix(np.array([t], np.uint64))[0])
        votes += (1 + np.log(n)) * np.array([1 if h >> (63 - k) & 1 else -1 for k in range(64)])
    want = int("".join("1" if v > 1e-3 else "0" for v in votes), 2)
    assert simhash.as_hex(simhash.fingerprints([text])) == [f"{want:016x}"]


def test_order_of_batches_and_nulls():
    texts = ["one two three", None, "", "word", "one two three", "one  two\nthree", "x " * 50_000]
    made = simhash.as_hex(simhash.fingerprints(texts))
    assert made[0] == made[4] == made[5] and made[1] == made[2] == "0" * 16 and made[3] != "0" * 16
    assert made == [simhash.as_hex(simhash.fingerprints([t]))[0] for t in texts]
    assert len(simhash.as_hex(simhash.fingerprints(["a b"], simhash.Votes(bits=128)))[0]) == 32


@pytest.mark.parametrize("bits,radius,spare", [(64, 3, 2), (64, 4, 1), (128, 2, 2)])
def test_search_finds_all_within_the_radius(spark, bits, radius, spare):
    rng = random.Random(bits + radius)
    prints = [rng.getrandbits(bits) for _ in range(40)]
    for base in prints[:20]:
        near = base
        for k in rng.sample(range(bits), rng.randint(0, radius + 2)):
            near ^= 1 << k
        prints.append(near)
    text = [f"{p:0{bits // 4}x}" for p in prints]
    rows = spark.createDataFrame([(t,) for t in [*text, text[0], None]], "fingerprint string")
    asked = spark.createDataFrame([(t,) for t in [*text[::3], None]], "fingerprint string")
    got = [tuple(r) for r in simhash.search(asked, rows, radius, spare, simhash.Votes(bits=bits)).collect()]
    want = {(a, b, d) for a in text[::3] for b in text if (d := (int(a, 16) ^ int(b, 16)).bit_count()) <= radius}
    assert len(got) == len(set(got)) and set(got) == want and any(d for _, _, d in want)
    assert simhash.search(asked.limit(0), rows, radius, spare, simhash.Votes(bits=bits)).count() == 0


def expected(rows: list[tuple]) -> dict:
    rows = sorted(((i, t or "") for i, t in rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    out = {}
    for k, (i, t) in enumerate(rows):
        after = rows[(k + 1) % len(rows)][1]
        half = len(t) // 2
        changed = t[: len(t) - half] + after[:half]
        own, other, following = simhash.as_hex(simhash.fingerprints([t, changed, after]))
        out[i] = (len(t), hashlib.sha256(changed.encode()).hexdigest(), own, other, likeness(own, other), likeness(own, following))
    return out


def check(got: list, rows: list[tuple]) -> None:
    assert len(got) == len(rows)
    want = expected(rows)
    for r in got:
        assert tuple(r[1:3]) == want[r[0]][:2] and tuple(r[3:5]) == want[r[0]][2:4]
        assert r[5:] == pytest.approx(want[r[0]][4:])


@pytest.mark.parametrize("parts", [1, 3, 7])
def test_edited_texts_across_ranges(spark, parts):
    rng = random.Random(parts)
    rows = [(3 * k, " ".join(rng.choice(["ab", "cé", "漢d", "ef\n"]) for _ in range(rng.randint(0, 30)))) for k in range(25)]
    rows += [(1, None), (4, ""), (None, "no id"), (7, "long " * 30_000)]
    rng.shuffle(rows)
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, fingerprint string").repartition(parts)
    check([tuple(r) for r in simhash.edited_likeness(docs).collect()], rows)


def test_one_document_no_document_and_repeats(spark):
    docs = spark.createDataFrame([(1, "a b c d")], "doc_id long, text string")
    check([tuple(r) for r in simhash.edited_likeness(docs).collect()], [(1, "a b c d")])
    assert simhash.edited_likeness(docs.limit(0)).count() == 0
    same = simhash.edited_likeness(docs.unionByName(docs)).collect()
    assert len(same) == 2 and all(r.near_next == 1 for r in same)


def test_query_over_the_whole_table(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()]
    got = [tuple(r) for r in op2_simhash(spark, SMALL).collect()]
    check(got, rows)
    assert np.mean([r[5] for r in got]) > np.mean([r[6] for r in got]) + 0.05
