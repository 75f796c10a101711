"""Candidate graph from sketches: rows that meet in a bucket and look alike become connected.

A row has a sketch of fixed length and keys of the buckets it starts in. Buckets of one row go; in buckets of up to
``limit`` rows all sketches are compared; a larger bucket is split again by more of the sketch, after all its
rows were compared with one of them, the pivot (the same in all buckets that hold the same rows). Rows that are surely like the pivot leave the bucket: whatever
is like them is near enough to the pivot to be connected with it (``attach`` allows for that). So a large group of near
copies goes in a few rounds of linear work, and no bucket larger than the limit is ever gathered in a task.

Only a spanning forest of each bucket is put out, never its pairs. That suffices, as all pairs
of one component are compared exactly later (``exact``).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventlens.llm.common import written


@dataclass(frozen=True)
class Rule:
    """``alike(a, b)``: estimated likeness of rows of two sketch arrays, over their last axis, with numpy's broadcasting.
    ``children(keys, sketches)``: (row, new key).

    ``near`` is the likeness from which two rows are connected, ``leave`` that from which a row is done with
    once it is connected with its pivot, and ``attach`` that from which a row is connected with a pivot.
    """

    width: int
    kind: str
    alike: Callable[[np.ndarray, np.ndarray], np.ndarray]
    children: Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]
    near: float
    attach: float
    leave: float
    limit: int = 4096
    depth: int = 24

    def matrix(self, column: pa.Array | pa.ChunkedArray) -> np.ndarray:
        if isinstance(column, pa.ChunkedArray):
            column = column.combine_chunks()
        return np.frombuffer(b"".join(column.to_pylist()), self.kind).reshape(-1, self.width)


def forest(linked: np.ndarray) -> np.ndarray:
    """For each row of a symmetric boolean matrix, the first row of its component."""
    n = len(linked)
    label = np.arange(n)
    linked = linked | np.eye(n, dtype=bool)
    while True:
        lower = np.where(linked, label[None, :], n).min(axis=1)
        lower = lower[lower]
        if (lower == label).all():
            return label
        label = lower


def edges(starts: DataFrame, sketches: DataFrame, rule: Rule, name: str) -> DataFrame:
    """Edges (a, b) of the candidate graph.

    ``starts``: (node, key), repeated keys of a node allowed. ``sketches``: (node, sketch), one row per node.
    """
    found, rows, with_sketch, level = None, starts, False, 0
    while True:
        sizes = written(rows.groupBy("key").agg(F.count(F.lit(1)).alias("_rows")).filter("_rows > 1"), f"{name}-sizes")
        kept = rows.join(sizes, "key")
        if not with_sketch:
            kept = written(kept.join(sketches, "node"), f"{name}-rows")
        small = kept.filter((F.col("_rows") <= rule.limit) if level < rule.depth else F.lit(True)).select("key", "node", "sketch")
        leaf = small.repartition("key").sortWithinPartitions("key", "node").mapInArrow(_leaves(rule), "a long, b long")
        leaf = written(leaf.distinct(), f"{name}-leaves")
        found = leaf if found is None else found.unionByName(leaf)
        large = kept.filter(F.col("_rows") > rule.limit)
        largest = sizes.agg(F.max("_rows")).first()[0] or 0
        if level >= rule.depth or largest <= rule.limit:
            return found
        pivot = large.groupBy("key").agg(F.min_by(F.struct("node", "sketch"), F.xxhash64("node", F.lit(level))).alias("_pivot"))
        pivot = written(pivot.select("key", F.col("_pivot.node").alias("_to"), F.col("_pivot.sketch").alias("_like")), f"{name}-pivots")
        split = large.select("key", "node", "sketch").join(pivot, "key")
        split = written(split.mapInArrow(_split(rule), "a long, b long, key long, node long, sketch binary"), f"{name}-split")
        found = found.unionByName(split.filter("a is not null").select("a", "b"))
        rows, with_sketch, level = split.filter("key is not null").select("key", "node", "sketch"), True, level + 1


#: Buckets of up to so many rows are compared many at a time, pair by pair, and put out their pairs.
SMALL = 8


def _leaves(rule: Rule) -> Callable:
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _whole_buckets(batches):
            key, node = rows.column("key").to_numpy(), rows.column("node").to_numpy()
            sketch = rule.matrix(rows.column("sketch"))
            start = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
            size = np.diff(np.append(start, len(key)))
            a: list[np.ndarray] = []
            b: list[np.ndarray] = []
            for n in range(2, SMALL + 1):
                first = start[size == n]
                x, y = (np.ravel(first[:, None] + at[None, :]) for at in np.triu_indices(n, 1))
                for k in range(0, len(x), 8192):
                    u, v = x[k : k + 8192], y[k : k + 8192]
                    near = (rule.alike(sketch[u], sketch[v]) >= rule.near) & (node[u] != node[v])
                    a.append(np.maximum(node[u], node[v])[near])
                    b.append(np.minimum(node[u], node[v])[near])
            for at, n in zip(start[size > SMALL], size[size > SMALL], strict=True):
                _forest_of(node[at : at + n], sketch[at : at + n], rule, a, b)
            yield _edges(a, b)

    return work


def _whole_buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Batches of a sorted partition, cut where a bucket ends."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        key = batch.column("key").to_numpy()
        last = int(np.searchsorted(key, key[-1]))
        before = held[-1].column("key")[held[-1].num_rows - 1].as_py() if held else None
        if held and before == key[-1]:
            held.append(batch)
            continue
        table = pa.Table.from_batches([*held, batch.slice(0, last)])
        if table.num_rows:
            yield table
        held = [batch.slice(last)]
    if held:
        yield pa.Table.from_batches(held)


#: Rows of a bucket that are compared all with all; more are first thinned out by pivots.
DENSE = 256


def _forest_of(node: np.ndarray, sketch: np.ndarray, rule: Rule, a: list[np.ndarray], b: list[np.ndarray]) -> None:
    """Forest of one bucket in memory that grows with its rows: row after row is the pivot of those that are left."""
    node, first = np.unique(node, return_index=True)
    sketch = sketch[first]
    label, left = np.arange(len(node)), np.arange(len(node))

    def join(rows: np.ndarray) -> None:
        known = np.unique(label[rows])
        if len(known) > 1:
            label[np.isin(label, known)] = known[0]

    while len(left) > DENSE:
        like = rule.alike(sketch[left], sketch[left[:1]])
        join(left[like >= rule.attach])
        left = left[like < rule.leave]
    own = sketch[left]
    alike = [rule.alike(own[k : k + 64, None], own[None]) for k in range(0, len(left), 64)]
    if alike:
        tree = forest(np.concatenate(alike) >= rule.near)
        for root in np.unique(tree):
            join(left[tree == root])
    moved = np.flatnonzero(label != np.arange(len(node)))
    a.append(node[moved])
    b.append(node[label[moved]])


def _edges(a: list[np.ndarray], b: list[np.ndarray]) -> pa.RecordBatch:
    empty = [np.zeros(0, np.int64)]
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate(a + empty)), pa.array(np.concatenate(b + empty))], ["a", "b"])


def _split(rule: Rule) -> Callable:
    names = ["a", "b", "key", "node", "sketch"]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            node, key, to = (batch.column(c).to_numpy() for c in ("node", "key", "_to"))
            sketch, pivot = rule.matrix(batch.column("sketch")), rule.matrix(batch.column("_like"))
            like = np.concatenate([rule.alike(sketch[k : k + 8192], pivot[k : k + 8192]) for k in range(0, len(node), 8192)])
            tied = np.flatnonzero((like >= rule.attach) & (node != to))
            none = [pa.nulls(len(tied), t) for t in (pa.int64(), pa.int64(), pa.binary())]
            yield pa.RecordBatch.from_arrays([pa.array(node[tied]), pa.array(to[tied]), *none], names)
            stay = np.flatnonzero(like < rule.leave)
            row, child = rule.children(key[stay], sketch[stay])
            none = [pa.nulls(len(row), pa.int64())] * 2
            yield pa.RecordBatch.from_arrays([*none, pa.array(child), pa.array(node[stay][row]), batch.column("sketch").take(pa.array(stay[row]))], names)

    return work
