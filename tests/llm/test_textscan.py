"""Hashes of words and windows against a plain Python reading of the same texts."""

from __future__ import annotations

import re

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from eventlens.llm.textscan import SLICE_BYTES, scan, sums

TEXTS = st.lists(st.one_of(st.none(), st.text("ab é漢\n\t.", max_size=30)), max_size=6)


def named(made: list[tuple[np.ndarray, list]]) -> bool:
    """Equal hashes stand for equal things and only for these."""
    pairs = {(int(h), x) for hashes, things in made for h, x in zip(hashes, things, strict=True)}
    return len({h for h, _ in pairs}) == len(pairs) == len({x for _, x in pairs})


def words_of(text: str | None) -> list[str]:
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def windows_of(text: str | None, n: int) -> list[str]:
    return [w for word in re.findall(r"[^\x20\x09-\x0D]+", text or "") for s in [f" {word} "] for w in (s[k : k + n] for k in range(len(s) - n + 1))]


def cut(texts, take):
    out = []
    for part in scan(texts):
        hashes, bounds = take(part)
        out += [hashes[bounds[k] : bounds[k + 1]] for k in range(part.n_texts)]
    return out


@settings(max_examples=60, deadline=None)
@given(TEXTS)
def test_words_and_windows(texts):
    assert named(list(zip(cut(texts, lambda p: p.words()), map(words_of, texts), strict=True)))
    for n in (3, 4):
        assert named(list(zip(cut(texts, lambda p, n=n: p.windows(n)), (windows_of(t, n) for t in texts), strict=True)))


@settings(max_examples=60, deadline=None)
@given(TEXTS, st.integers(1, 5))
def test_runs_of_words(texts, size):
    made = []
    for part in scan(texts):
        term, text = part.word_runs(size)
        made += [term[text == k] for k in range(part.n_texts)]
    want = []
    for t in texts:
        w = words_of(t)
        want.append([tuple(w[k : k + size]) for k in range(max(len(w) - size + 1, min(len(w), 1)))])
    assert named(list(zip(made, want, strict=True)))


def test_slices_do_not_change_hashes():
    long = "word " * (SLICE_BYTES // 4)
    texts = ["a b", long, None, "a b", long + "c"]
    made = cut(texts, lambda p: p.words())
    assert (made[0] == made[3]).all() and len(made[2]) == 0
    assert len(set(made[1].tolist())) == 1 and (made[4][:-1] == made[1]).all() and made[4][-1] != made[1][0]


def test_lower_case_and_sums():
    a, b = (next(iter(scan(["Word wORD"], lower=low))).words()[0] for low in (True, False))
    assert a[0] == a[1] and b[0] != b[1]
    assert sums(np.array([1.0, 2.0, 4.0]), np.array([0, 0, 2, 3])).tolist() == [0, 3, 4]
