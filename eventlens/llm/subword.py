"""Supervised subword embeddings: a document is the mean of learned vectors, a softmax names its class.

Features are words, pairs of neighbouring words and the character n-grams of each word with
its edges. Each is hashed to one of ``buckets`` rows of a table of vectors. A pair of one word
with itself is hashed by that fact and not by the word, so that words never seen in training
show their repetition. Vectors and softmax are trained together by stochastic gradient
descent, with step sizes by Adagrad, in numpy. Training sees a bounded sample only, so the
model is small, and scoring is map-only: the softmax is linear in the mean, so that the
product of table and weights, one number per bucket and class, is all a task needs.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np

from eventlens.llm.textscan import mix, scan, sums


@dataclass(frozen=True)
class Subwords:
    """``max_docs_per_class`` and ``max_chars`` bound the sample that a model is fitted on.

    ``rest`` zero vectors join every mean: a text of few words says less than a long one.
    """

    dim: int = 8
    buckets: int = 1 << 17
    min_n: int = 3
    max_n: int = 5
    pairs: bool = True
    lower: bool = False
    rest: int = 0
    epochs: int = 4
    batch: int = 32
    rate: float = 0.5
    seed: int = 7
    max_docs_per_class: int = 2500
    max_chars: int = 20_000_000


def features(texts: list[str | None], conf: Subwords) -> Iterator[tuple[int, int, list[tuple[np.ndarray, np.ndarray]]]]:
    """By slice: place of its first text, number of texts, and (buckets, bounds by text) for each kind of feature."""
    shift = np.uint64(64 - (conf.buckets.bit_length() - 1))
    for part in scan(texts, conf.lower):
        kinds = []
        word, bounds = part.words()
        kinds.append((word >> shift, bounds))
        if conf.pairs:
            # The pair that reaches into the next text takes a constant's place, so bounds stay those of words.
            after = np.roll(word, -1)
            pair = np.where(word == after, np.uint64(1), word * np.uint64(3) + after)
            last = bounds[1:][bounds[1:] > bounds[:-1]] - 1
            pair[last] = 2
            kinds.append((mix(pair) >> shift, bounds))
        for n in range(conf.min_n, conf.max_n + 1):
            window, edges = part.windows(n)
            kinds.append((mix(window + np.uint64(n)) >> shift, edges))
        yield part.first, part.n_texts, kinds


@dataclass
class Model:
    conf: Subwords
    classes: list[int]
    logits: np.ndarray = field(repr=False)  # buckets x classes
    bias: np.ndarray

    def probabilities(self, texts: list[str | None]) -> np.ndarray:
        """Softmax by text; a text without words gets the bias alone."""
        out = np.empty((len(texts), len(self.classes)))
        for first, n, kinds in features(texts, self.conf):
            total, count = np.zeros((n, len(self.classes))), np.zeros(n)
            for bucket, bounds in kinds:
                count += np.diff(bounds)
                for k in range(len(self.classes)):
                    total[:, k] += sums(self.logits[:, k][bucket], bounds)
            out[first : first + n] = total / np.maximum(count + self.conf.rest, 1)[:, None] + self.bias
        out = np.exp(out - out.max(axis=1, keepdims=True))
        return out / out.sum(axis=1, keepdims=True)


def train(texts: list[str | None], labels: list[int], conf: Subwords) -> Model:
    """Fit on texts at hand. Classes weigh alike, however many texts each has. One class only: it is certain."""
    classes = sorted(set(labels))
    if len(classes) < 2:
        return Model(conf, classes or [0], np.zeros((conf.buckets, 1), np.float32), np.zeros(1))
    rng = np.random.default_rng(conf.seed)
    y = np.searchsorted(classes, labels)
    weight = (len(y) / len(classes) / np.bincount(y))[y]
    table = rng.uniform(-1 / conf.dim, 1 / conf.dim, (conf.buckets, conf.dim))
    out = rng.uniform(-1, 1, (conf.dim, len(classes)))
    bias = np.zeros(len(classes))
    g_table, g_out, g_bias = np.full_like(table, 1e-12), np.full_like(out, 1e-12), np.full_like(bias, 1e-12)
    order = rng.permutation(len(y))
    batches = [order[at : at + conf.batch] for at in range(0, len(y), conf.batch)]
    bags = [_bag([texts[i] for i in chosen], conf) for chosen in batches]
    for epoch in range(conf.epochs):
        for done, k in enumerate(rng.permutation(len(batches))):
            rate = conf.rate * (1 - (epoch + done / len(batches)) / conf.epochs)
            chosen, bag = batches[k], bags[k]
            vectors = table[bag.rows]
            mean = sums(vectors[bag.place] * bag.share[:, None], bag.bounds)
            score = mean @ out + bias
            p = np.exp(score - score.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            p[np.arange(len(chosen)), y[chosen]] -= 1
            p *= weight[chosen][:, None] / len(chosen)
            back = np.repeat(p @ out.T, np.diff(bag.bounds), axis=0) * bag.share[:, None]
            step = np.stack([np.bincount(bag.place, back[:, d], len(bag.rows)) for d in range(conf.dim)], axis=1)
            for values, seen, g, at in ((table, g_table, step, bag.rows), (out, g_out, mean.T @ p, ...), (bias, g_bias, p.sum(axis=0), ...)):
                seen[at] += g * g
                values[at] -= rate * g / np.sqrt(seen[at])
    return Model(conf, [int(c) for c in classes], (table @ out).astype(np.float32), bias)


@dataclass
class _Bag:
    """Distinct (text, bucket) of a batch: rows of the table in use, each entry's row among them, its share of its text."""

    rows: np.ndarray
    place: np.ndarray
    share: np.ndarray
    bounds: np.ndarray


def _bag(texts: list[str | None], conf: Subwords) -> _Bag:
    key, share = [], []
    for first, n, kinds in features(texts, conf):
        doc = np.concatenate([np.repeat(np.arange(n), np.diff(bounds)) for _, bounds in kinds])
        found, times = np.unique(doc * conf.buckets + np.concatenate([b for b, _ in kinds]).astype(np.int64), return_counts=True)
        key.append(found + first * conf.buckets)
        share.append((times / np.maximum(np.bincount(doc, minlength=n) + conf.rest, 1)[found // conf.buckets]).astype(np.float32))
    key = np.concatenate(key)
    rows, place = np.unique(key % conf.buckets, return_inverse=True)
    bounds = np.searchsorted(key // conf.buckets, np.arange(len(texts) + 1))
    return _Bag(rows.astype(np.int32), place.astype(np.int32), np.concatenate(share), bounds)
