"""Notices against edit distances of all places, and base phrases against a plain word search."""

from __future__ import annotations

import random
import re

import pytest

from conftest import SMALL
from eventlens.llm import licenses
from eventlens.llm.licenses import NOTICES, Notice, Scanner
from eventlens.llm.queries import op13_licenses

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
BASE = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}


def words_of(text: str | None) -> list[str]:
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def base_places(words: list[str]) -> list[tuple[int, str]]:
    return [(k, label) for phrase, label in BASE.items() for k in range(len(words)) if words[k : k + len(phrase.split())] == phrase.split()]


def distance(a: str, b: str) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        last, row[0] = row[0], i + 1
        for j, y in enumerate(b):
            last, row[j + 1] = row[j + 1], min(row[j + 1] + 1, row[j] + 1, last + (x != y))
    return row[-1]


def near_places(words: list[str], notice: Notice) -> list[tuple[int, int, int]]:
    """(first word, last word, errors) of all word ranges within the notice's errors that hold its keys."""
    out = []
    for a in range(len(words)):
        for b in range(a, min(len(words), a + 2 * len(notice.text.split()) + 2)):
            errors = distance(" ".join(words[a : b + 1]), notice.text)
            rest = iter(words[a : b + 1])
            if errors <= notice.errors and all(k in rest for k in notice.keys):
                out.append((a, b, errors))
    return out


def edited(text: str, n: int, rng: random.Random) -> str:
    for _ in range(n):
        k = rng.randrange(len(text))
        text = rng.choice([text[:k] + text[k + 1 :], text[:k] + rng.choice("ae x") + text[k:], text[:k] + rng.choice("ae x") + text[k + 1 :]])
    return text


@pytest.mark.parametrize("notice", NOTICES, ids=lambda n: n.text)
def test_places_against_edit_distances(notice):
    """A place is reported exactly where one is, with its errors; of places that overlap the best is."""
    rng, own, seen = random.Random(5), Scanner((notice,)), 0
    for _ in range(250):
        parts = [rng.choice(["mit", "the", "license", "2", "cc by", "x", "", edited(notice.text, rng.randint(0, notice.errors + 1), rng)]) for _ in range(rng.randint(1, 6))]
        text = rng.choice([" ", ", ", "\n-"]).join(parts).title()
        words = words_of(text)
        n, spans = own.spans(text)
        got = [(s["first_word"], s["last_word"], s["errors"]) for s in spans]
        near = near_places(words, notice)
        assert n == len(words) and set(got) <= set(near)
        for a, b, errors in near:  # each place that fits is there, or one that overlaps it and is as good
            assert any(x <= b and a <= y and e <= errors for x, y, e in got), (text, (a, b, errors), got)
        for s in spans:
            assert words_of(text[s["start"] : s["end"]]) == words[s["first_word"] : s["last_word"] + 1]
        assert all(b < c for (_, b, _), (c, _, _) in zip(got, got[1:], strict=False))
        seen += len(got)
    assert seen > 50


@pytest.mark.parametrize(("text", "labels"), [
    ("Released under the MIT License.", "mit"), ("released under the MTI license", ""), ("Released under te MIT Licence", "mit"), ("under the BSD license", ""),
    ("Apache License, Version 2.0", "apache-2"), ("Apache Licence, Versoin 2", ""), ("Apache Licence, Versin 2", "apache-2"), ("Apache License, Version 1.1", ""),
    ("CC-BY-NC", "cc-by-nc"), ("CC-BY-ND", ""), ("GNU General Public License, version 3", "gpl-3"), ("Permision is hereby granted, free of charge", "mit"), ("", ""), (None, ""),
])
def test_what_is_a_notice(text, labels):
    assert ",".join(sorted({s["label"] for s in licenses.scanner(NOTICES).spans(text)[1]})) == labels


def test_frames_with_clashing_columns(spark):
    long = "lorem ipsum " * 100_000 + "under the MIT license; under the MIT license"
    rows = [(1, long), (1, long), (2, None), (None, "CC BY NC cc by nc"), (3, ""), (4, "Apache License Version 2 Apache Licence Version 2")]
    docs = spark.createDataFrame([(i, t, 9, "o") for i, t in rows], "doc_id long, text string, score int, other string")
    out = licenses.scan(docs)
    assert out.columns == ["doc_id", "text", "other", *licenses.ADDED]
    got = out.collect()
    assert len(got) == 6
    for r in got:
        base = base_places(words_of(r.text))
        assert (r.n_words, r.n_base) == (len(words_of(r.text)), len(base))
        assert (r.first_word, r.last_word) == (min((k for k, _ in base), default=None), max((k for k, _ in base), default=None))
        assert r.base_labels == ",".join(sorted({x for _, x in base})) and r.score == (1.0 if base else 0.0)
    assert [len(r.spans) for r in got if r.doc_id == 4] == [2]
    assert licenses.scan(docs.limit(0)).collect() == []


def test_query_over_the_whole_table(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    got, hits = op13_licenses(spark, SMALL).collect(), 0
    assert len(got) == len(texts)
    for r in got:
        words = words_of(texts[r.doc_id])
        base = base_places(words)
        hits += bool(base)
        assert (r.n_words, r.n_base, r.base_labels) == (len(words), len(base), ",".join(sorted({x for _, x in base})))
        assert (r.first_word, r.last_word) == (min((k for k, _ in base), default=None), max((k for k, _ in base), default=None))
        assert set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) and 0 <= r.score <= 1
    assert hits
