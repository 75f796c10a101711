"""Word and character n-gram hashes of many texts at once, in numpy.

A prefix sum of byte values times powers of an odd number gives the hash of any byte
range by one subtraction and one multiplication (modulo 2^64), so that all words and all
character windows of a batch are hashed without a Python loop over them. Texts are laid
out one after another between spaces; a window may begin or end with one space, which
marks a word's edge, and never holds one inside.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np

#: Bytes of text that are hashed together: the arrays of a slice stay in the caches.
SLICE_BYTES = 1 << 20
_BASE = 0x9E3779B97F4A7C17 | 1
_SPACES = [9, 10, 11, 12, 13, 32]
_WRAP = (1 << 64) - 1


def mix(x: np.ndarray) -> np.ndarray:
    """Spread every input bit over all 64 output bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _byte_values(lower: bool) -> np.ndarray:
    values = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    values[_SPACES] = values[32]
    if lower:
        values[65:91] = values[97:123]
    return values


_VALUES = {flag: _byte_values(flag) for flag in (False, True)}
_IS_SPACE = np.isin(np.arange(256), _SPACES)
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers_to(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, grown on demand."""
    if len(_powers[0]) < n:
        size = max(n, SLICE_BYTES + 4096)
        for k, base in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _powers[k] = np.cumprod(steps)
    return _powers[0], _powers[1]


@dataclass
class Scan:
    """One slice of texts. ``first`` is the place of its first text among all texts."""

    first: int
    n_texts: int
    data: np.ndarray
    text_start: np.ndarray  # byte where each text begins, in ``data``
    prefix: np.ndarray
    unpower: np.ndarray

    def hashes(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.prefix[end] - self.prefix[start]) * self.unpower[start] + np.uint64(0x632BE59BD9B4E019))

    def words(self) -> tuple[np.ndarray, np.ndarray]:
        """Hash of each word, and for each text the place of its first word (one place more at the end)."""
        space = _IS_SPACE[self.data]
        edge = np.flatnonzero(space[1:] != space[:-1]) + 1
        start, end = edge[0::2], edge[1::2]
        return self.hashes(start, end), np.append(np.searchsorted(start, self.text_start), len(start))

    def word_runs(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Hash of each run of ``size`` words, and its text. A text of fewer words, if any, is one run."""
        word, bounds = self.words()
        n = np.diff(bounds)
        count = np.maximum(n - size + 1, np.minimum(n, 1))
        text = np.repeat(np.arange(self.n_texts), count)
        first = np.repeat(bounds[:-1], count) + np.arange(len(text)) - np.repeat(np.cumsum(count) - count, count)
        term = np.zeros(len(text), np.uint64)
        end = bounds[1:][text]
        for k in range(size if len(text) else 0):
            inside = first + k < end
            term = np.where(inside, mix(term * np.uint64(5) + word[np.minimum(first + k, len(word) - 1)]), term)
        return term, text

    def windows(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Hash of each window of ``n`` characters (code points), and bounds by text as in ``words``."""
        char = np.flatnonzero((self.data & 0xC0) != 0x80)
        if len(char) <= n:
            return np.zeros(0, np.uint64), np.zeros(self.n_texts + 1, np.int64)
        space = _IS_SPACE[self.data[char]]
        seen = np.concatenate(([0], np.cumsum(space, dtype=np.int32)))
        at = np.flatnonzero(seen[n - 1 : -1] == seen[1 : len(seen) - n + 1])
        at = at[: np.searchsorted(at, len(char) - n)]
        start, end = char[at], char[at + n]
        # A window that starts with the space before a text belongs to that text.
        return self.hashes(start, end), np.append(np.searchsorted(start, self.text_start - 1), len(start))


def scan(texts: list[str | None], lower: bool = False) -> Iterator[Scan]:
    """Slices over ``texts``; a null text counts as an empty one."""
    values, at = _VALUES[lower], 0
    while at < len(texts):
        parts, size, first = [], 1, at
        while at < len(texts) and (not parts or size + 4 * len(texts[at] or "") <= 4 * SLICE_BYTES) and size < SLICE_BYTES:
            parts.append((texts[at] or "").encode("utf-8", "surrogatepass"))
            size += len(parts[-1]) + 1
            at += 1
        data = np.frombuffer(b" " + b" ".join(parts) + b"  ", np.uint8)
        length = np.fromiter(map(len, parts), np.int64, len(parts))
        start = np.concatenate(([1], 1 + np.cumsum(length + 1)[:-1]))
        power, unpower = _powers_to(len(data) + 1)
        prefix = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(values[data] * power[: len(data)], out=prefix[1:])
        yield Scan(first, len(parts), data, start, prefix, unpower)


def sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sum of ``values`` between neighbouring bounds; 0 where there are none."""
    total = np.concatenate((np.zeros((1, *values.shape[1:])), np.cumsum(values, axis=0, dtype=np.float64)))
    return total[bounds[1:]] - total[bounds[:-1]]
