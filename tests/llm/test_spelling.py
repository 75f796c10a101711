"""Near words against a comparison of all pairs, and the bound that decides which lists are merged."""

from __future__ import annotations

import random
import re
import zlib
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from conftest import SMALL
from eventlens.llm import spelling
from eventlens.llm.queries import op11_spelling

WORD = st.text(st.sampled_from("abcé"), min_size=2, max_size=18)


def edits(word: str, letters: str = "abcé") -> set[str]:
    out = {word[:k] + c + word[k:] for k in range(len(word) + 1) for c in letters}
    out |= {word[:k] + c + word[k + 1 :] for k in range(len(word)) for c in letters}
    return out - {word}


def is_near(a: str, b: str) -> bool:
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def wanted(rows: list[tuple], conf: spelling.Variants) -> dict[str, tuple]:
    count: Counter = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate({c: c + 32 for c in range(65, 91)})
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if conf.spoil and h % conf.spoil == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            count[run] += 1
    n = {w: c for w, c in count.items() if len(w) >= conf.min_length and c >= conf.min_count}
    near = {w: [x for x in n if is_near(w, x)] for w in n}
    form = {}
    for w in n:
        best = min(near[w], key=lambda x: (-n[x], x), default=None)
        form[w] = best if best and n[best] >= conf.ratio * n[w] else None
    out = {}
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out[w] = (n[w], len(near[w]), form[w], n.get(form[w]), root)
    return out


@settings(max_examples=200, deadline=None)
@given(WORD, st.sets(st.text(st.sampled_from("^abcé$"), min_size=2, max_size=5), max_size=60), st.randoms())
def test_one_merged_list_is_shared(word, frequent, rng):
    """Whatever the dictionary holds: a longer or an equally long near word is found in a list that both merge."""
    kept = {g: rng.randint(65, 70) for g in frequent} | {g[:k]: 99 for g in frequent for k in range(2, len(g))}
    conf = spelling.Variants(min_length=2)
    assert spelling.bound(spelling.grams(word, kept, 2, (len(word) + 2) // 2)) >= 1
    for other in edits(word):
        longer, shorter = max(word, other, key=len), min(word, other, key=len)
        own = {(at, g) for at, g in spelling.merged_lists(longer, len(longer), kept, conf)}
        asked = spelling.merged_lists(shorter, len(longer), kept, conf)
        moved = {(at + k, g) for at, g in asked for k in range(1 + (len(longer) > len(shorter)))}
        assert own & moved, (word, other)


@settings(max_examples=200, deadline=None)
@given(WORD, WORD, st.randoms())
def test_verification(word, other, rng):
    other = rng.choice(sorted(edits(word)) + [other, word])
    a, b = sorted((word, other), key=len, reverse=True)
    lanes = [spelling._lanes([w.encode("latin-1")], len(a)) for w in (a, a[1:], b)]
    if len(a) == len(b):
        assert bool(spelling.replaced(lanes[0], lanes[2])[0]) == is_near(a, b)
    elif len(a) == len(b) + 1:
        assert bool(spelling.inserted(*lanes)[0]) == is_near(a, b)


def corpus(n: int, seed: int = 3) -> list[tuple]:
    rng = random.Random(seed)
    stems = ["".join(rng.choices(["an", "ti", "re", "on", "ée", "sh"], k=rng.randint(3, 7))) for _ in range(40)]
    out: list[tuple] = []
    for k in range(n):
        words = []
        for _ in range(rng.randint(0, 60)):
            w = rng.choice(stems[: rng.randint(1, 40)])
            words.append(rng.choice(sorted(edits(w, "aé"))) if rng.random() < 0.2 else rng.choice([w, w.upper()]))
        out.append((k, " ".join(words)))
    return [*out, *out[:3], (None, "Anticipation anticipation"), (n, None), (n + 1, ""), (n + 2, "÷".join(["x" * 3000] * 2))]


@pytest.mark.parametrize(("kept", "block"), [(1 << 16, 4096), (64, 3)])
def test_variants_against_all_pairs(spark, kept, block):
    """Also with a tiny dictionary threshold, so that grams grow long, and with lists cut into blocks."""
    rows, conf = corpus(120), spelling.Variants(rare=64 if kept > 100 else 2, kept=kept, block=block)
    docs = spark.createDataFrame([(i, t, "x", 7) for i, t in rows], "doc_id long, text string, word string, n int").repartition(3)
    got = {r.word: (r.n, r.n_near, r.form, r.form_n, r.root) for r in spelling.variants(docs, conf).collect()}
    assert got == wanted(rows, conf) and len(got) > 50 and any(v[2] for v in got.values())


def test_dictionary_counts_places_of_grams(spark):
    words = sorted({w for _, t in corpus(60) for w in re.findall("[a-zé]{7,}", t or "")})
    conf = spelling.Variants(rare=3, longest=5)
    kept, threshold = spelling.dictionary(spark.createDataFrame([(w, 1) for w in words], "word string, n long"), conf)
    want: dict[str, int] = {}
    for q in range(2, 6):
        count = Counter(f"^{w}$"[k : k + q] for w in words for k in range(len(w) + 3 - q))
        want |= {g: n for g, n in count.items() if n > 3 and (q == 2 or g[:-1] in want)}
    assert threshold == 3 and kept == want and {len(g) for g in kept} == {2, 3, 4, 5}


def test_forms_are_followed_to_the_last(spark):
    text = " ".join(["abcdefgh"] * 1000 + ["abcdefgx"] * 100 + ["abcdefyx"] * 10 + ["zbcdefyx"])
    conf = spelling.Variants(spoil=0, min_count=1)
    got = {r.word: r for r in spelling.variants(spark.createDataFrame([(1, text)], "doc_id long, text string"), conf).collect()}
    assert {w: r.root for w, r in got.items()} == dict.fromkeys(got, "abcdefgh") and got["zbcdefyx"].form == "abcdefyx"
    tie = " ".join(["aaaaaaab"] * 10 + ["aaaaaaac"] * 10 + ["aaaaaaaa"])
    got = {r.word: r for r in spelling.variants(spark.createDataFrame([(1, tie)], "doc_id long, text string"), conf).collect()}
    assert got["aaaaaaaa"].form == "aaaaaaab" and got["aaaaaaaa"].n_near == 2


def test_no_words(spark):
    for rows in ([], [(1, None), (2, "short words only")]):
        assert spelling.variants(spark.createDataFrame(rows, "doc_id long, text string")).collect() == []
    with pytest.raises(ValueError, match="single letter"):
        spelling.Variants(min_length=1)


def test_query_over_the_whole_table(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    conf = spelling.Variants()
    got = {r.word: (r.n, r.n_near, r.form, r.form_n, r.root) for r in op11_spelling(spark, SMALL).collect()}
    assert got == wanted(rows, conf)
