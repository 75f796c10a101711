"""Features, scores and a training step, computed once more in plain Python."""

from __future__ import annotations

import math

import numpy as np
import pytest

from conftest import SMALL
from eventlens.llm.quality import Quality
from eventlens.llm.subword import Subwords, train
from eventlens.llm.toxicity import Toxicity

WRAP = (1 << 64) - 1
SPACES = {9, 10, 11, 12, 13, 32}


def mixed(x: int) -> int:
    x = ((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9) & WRAP
    x = ((x ^ (x >> 27)) * 0x94D049BB133111EB) & WRAP
    return x ^ (x >> 31)


def value(byte: int, lower: bool) -> int:
    byte = 32 if byte in SPACES else byte
    if lower and 65 <= byte <= 90:
        byte += 32
    return mixed(((byte + 1) * 0x9E3779B97F4A7C15) & WRAP)


def hashed(raw: bytes, lower: bool) -> int:
    total, power = 0, 1
    for byte in raw:
        total = (total + value(byte, lower) * power) & WRAP
        power = (power * 0x9E3779B97F4A7C17) & WRAP
    return mixed((total + 0x632BE59BD9B4E019) & WRAP)


def bag(text: str | None, conf: Subwords) -> list[int]:
    """Buckets of all features of one text: words, pairs of neighbours, and windows of characters that hold no space but at an edge."""
    text = text or ""
    words = ["".join(w) for w in _runs(text)]
    shift = 64 - (conf.buckets.bit_length() - 1)
    own = [hashed(w.encode(), conf.lower) for w in words]
    out = [h >> shift for h in own]
    if conf.pairs and own:
        pairs = [1 if a == b else (a * 3 + b) & WRAP for a, b in zip(own, own[1:], strict=False)] + [2]
        out += [mixed(p) >> shift for p in pairs]
    padded = " " + text + " "
    for n in range(conf.min_n, conf.max_n + 1):
        for k in range(len(padded) - n + 1):
            window = padded[k : k + n]
            if not any(ord(c) in SPACES for c in window[1:-1]):
                out.append(mixed((hashed(window.encode(), conf.lower) + n) & WRAP) >> shift)
    return out


def _runs(text: str) -> list[list[str]]:
    out: list[list[str]] = [[]]
    for c in text:
        if ord(c) in SPACES:
            out.append([])
        else:
            out[-1].append(c)
    return [r for r in out if r]


def softmax(x: list[float]) -> list[float]:
    e = [math.exp(v - max(x)) for v in x]
    return [v / sum(e) for v in e]


@pytest.fixture(scope="module")
def texts(spark):
    rows = spark.read.parquet(f"{SMALL}/documents.parquet").select("text").limit(46).collect()
    return [*[r.text for r in rows], None, "", "É漢 a  a\na", " lone "]


@pytest.mark.parametrize("conf", [Quality().model, Toxicity().model], ids=["quality", "toxicity"])
def test_scores_of_fifty_texts(texts, conf):
    """With the production features of both classifiers: mean of the features' rows, softmax."""
    small = Subwords(**{**conf.__dict__, "epochs": 1, "buckets": 1 << 12})
    model = train(texts[:20], [k % 2 for k in range(20)], small)
    got = model.probabilities(texts)
    for text, row in zip(texts, got, strict=True):
        found = bag(text, small)
        mean = [sum(float(model.logits[b][c]) for b in found) / max(len(found) + small.rest, 1) for c in range(2)]
        assert row == pytest.approx(softmax([m + float(b) for m, b in zip(mean, model.bias, strict=True)]), abs=1e-6), text


def test_one_step_of_training_by_hand():
    """Three texts, one batch, one step: gradients of the cross-entropy by every parameter, divided by their own size (Adagrad)."""
    conf = Subwords(dim=3, buckets=64, epochs=1, batch=8, rate=0.25, rest=2, seed=5)
    said, y = ["ab cd", "cd cd ef", "ab"], [0, 1, 1]
    rng = np.random.default_rng(5)
    table, out = rng.uniform(-1 / 3, 1 / 3, (64, 3)).tolist(), rng.uniform(-1, 1, (3, 2)).tolist()
    weight = [3 / 2 / y.count(c) for c in y]
    g_table, g_out, g_bias = [[0.0] * 3 for _ in range(64)], [[0.0] * 2 for _ in range(3)], [0.0] * 2
    for text, label, w in zip(said, y, weight, strict=True):
        found = bag(text, conf)
        mean = [sum(table[b][d] for b in found) / (len(found) + 2) for d in range(3)]
        p = softmax([sum(mean[d] * out[d][c] for d in range(3)) for c in range(2)])
        error = [(p[c] - (c == label)) * w / 3 for c in range(2)]
        for c in range(2):
            g_bias[c] += error[c]
            for d in range(3):
                g_out[d][c] += mean[d] * error[c]
        for b in found:
            for d in range(3):
                g_table[b][d] += sum(error[c] * out[d][c] for c in range(2)) / (len(found) + 2)

    def stepped(x: float, g: float) -> float:
        return x - 0.25 * g / math.sqrt(g * g + 1e-12)

    table = [[stepped(x, g) for x, g in zip(r, s, strict=True)] for r, s in zip(table, g_table, strict=True)]
    after = [[stepped(x, g) for x, g in zip(r, s, strict=True)] for r, s in zip(out, g_out, strict=True)]
    model = train(said, y, conf)
    want = [[sum(table[b][d] * after[d][c] for d in range(3)) for c in range(2)] for b in range(64)]
    assert np.allclose(model.logits, want, atol=2e-4)
    assert np.allclose(model.bias, [stepped(0.0, g) for g in g_bias], atol=1e-6)


def test_very_long_and_tied_texts():
    conf = Subwords(buckets=1 << 10, epochs=1)
    model = train(["good words here", "bad thing"], [1, 0], conf)
    long = "words and more words " * 100_000
    p = model.probabilities([long, long, "words and more words", ""])
    assert np.isfinite(p).all() and (p[0] == p[1]).all()
    assert p.shape == (4, 2)
