"""Ranked lexical search by buckets of impact vectors, in the manner of LEMP.

A document's impact vector has an integer for each term, which depends on the term's count and the document's length
only; an item's vector has the term weights; a score is their inner product. The vectors are ordered by length
(Euclidean norm) and taken in buckets, longest first:

* a bucket whose longest vector times the item's length is below the item's threshold cannot hold a hit
  (Cauchy-Schwarz), nor can any later one of the same task;
* inside a bucket, the item's heaviest coordinates bound the unit vectors that can reach the threshold: a vector
  outside of the feasible range in one of them is passed over;
* survivors are scored exactly, in 64-bit integers.

The threshold of an item is the score of its k-th best document so far. It starts from a first round over the longest
vectors of all (``head`` of them, about), which is a complete search of its own, and rises within each task. Bounds are
in doubles with a margin far above their rounding; a document that ties with the threshold is kept.

Counts cover all documents. Items are taken in blocks of ``block_terms`` terms: their vectors and dictionary are what
a task is sent, and vectors of documents keep the terms of the block only. Nothing else depends on the number of items;
documents are read once for the counts and once for each block.

Defined results: a null or empty text has no terms, and an item without terms (or with none that a document has) has no
rows; a null doc_id comes last among equal scores; rows that repeat are documents of their own; items that repeat an
id are searched on their own and give their rows each; no items or no documents give no rows.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from eventlens.llm.common import written

#: Bytes of terms: ASCII digits and letters, and all bytes of further characters. Fixed by the task.
TERM = re.compile(rb"[0-9a-z\x80-\xff]+")


@dataclass(frozen=True)
class Search:
    top: int = 50
    block_terms: int = 1 << 16
    head: int = 1 << 14
    bucket: int = 2048
    focus: int = 5  # coordinates of an item that are bounded

    def weight(self, n_docs: int, df: int) -> int:
        return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def terms(text: str | None) -> list[bytes]:
    """Terms of a whole text: maximal runs, only A-Z in lower case."""
    return TERM.findall((text or "").encode("utf-8", "surrogatepass").lower())


@dataclass
class Item:
    """``number`` tells items apart that share an id."""

    number: int
    item_id: object
    terms: list[bytes]


def blocks(items: DataFrame, conf: Search) -> Iterator[list[Item]]:
    """Items in blocks of at most ``block_terms`` terms (an item of more is a block of its own); one partition at a time is held."""
    held: list[Item] = []
    size = number = 0
    for row in items.select("item_id", "text").toLocalIterator():
        own = sorted(set(terms(row.text)))
        if held and size + len(own) > conf.block_terms:
            yield held
            held, size = [], 0
        held.append(Item(number, row.item_id, own))
        size += len(own)
        number += 1
    if held:
        yield held


def counted(docs: DataFrame, vocabulary: list[bytes], name: str) -> DataFrame:
    """(doc_id, n, term, tf) of every document with terms; ``term`` and ``tf`` hold those of the vocabulary only."""
    place = {t: k for k, t in enumerate(vocabulary)}
    kind = docs.schema["doc_id"].dataType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size, term, tf, bounds = [], [], [], [0]
            for text in batch.column("text"):
                found = terms(text.as_py())
                known = Counter(map(place.get, found))
                known.pop(None, None)
                size.append(len(found))
                term.extend(known)
                tf.extend(known.values())
                bounds.append(len(term))
            ends = pa.array(bounds, pa.int32())
            lists = [pa.ListArray.from_arrays(ends, pa.array(x, t)) for x, t in ((term, pa.int32()), (tf, pa.int64()))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(size, pa.int64()), *lists], ["doc_id", "n", "term", "tf"])

    made = docs.select("doc_id", "text").mapInArrow(work, f"doc_id {kind}, n long, term array<int>, tf array<long>")
    return written(made.filter("n > 0"), name)


def impacts(found: DataFrame, n_docs: int, n_terms: int) -> DataFrame:
    """(doc_id, term, impact, norm): the impact vector and its length."""
    m = F.lit(50) + F.expr(f"(50 * n * {n_docs}L) div {max(n_terms, 1)}L")
    impact = F.transform("tf", lambda f: F.call_function("div", F.lit(1_000_000_000) * f, F.lit(1000) * f + F.lit(20) * F.col("_m")))
    own = found.filter(F.size("term") > 0).withColumn("_m", m).select("doc_id", "term", impact.alias("impact"))
    square = F.aggregate("impact", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    return own.withColumn("norm", F.sqrt(square))


class Bucket:
    """Vectors of about one length: by row, and by coordinate (rows that have it, with their impacts)."""

    def __init__(self, batch: pa.RecordBatch):
        self.norm = batch.column("norm").to_numpy()
        term, impact = batch.column("term"), batch.column("impact")
        bounds = term.offsets.to_numpy()
        row = np.repeat(np.arange(batch.num_rows), np.diff(bounds))
        order = np.argsort(term.flatten().to_numpy(), kind="stable")
        self.row, self.impact = row[order], impact.flatten().to_numpy()[order]
        self.term, self.start = np.unique(term.flatten().to_numpy()[order], return_index=True)
        self.end = np.append(self.start[1:], len(order))

    def column(self, term: int) -> tuple[np.ndarray, np.ndarray]:
        k = np.searchsorted(self.term, term)
        if k == len(self.term) or self.term[k] != term:
            return self.row[:0], self.impact[:0]
        return self.row[self.start[k] : self.end[k]], self.impact[self.start[k] : self.end[k]]


#: Relative margin of bounds in doubles over exact integers.
MARGIN = 1e-9


def survivors(bucket: Bucket, term: np.ndarray, weight: np.ndarray, length: float, threshold: int, focus: int) -> np.ndarray | None:
    """Rows that can reach ``threshold`` (a mask), or None if no row of the bucket can."""
    theta = threshold * (1 - MARGIN) / (length * bucket.norm.max())
    if theta > 1:
        return None
    alive = bucket.norm * (length * (1 + MARGIN)) >= threshold
    if theta <= 0:
        return alive
    for t, w in zip(term[:focus], weight[:focus], strict=True):
        q = w / length
        # q p + sqrt(1 - q^2) sqrt(1 - p^2) >= theta holds between these two values of p only.
        spread = math.sqrt(max(0.0, 1 - theta * theta)) * math.sqrt(max(0.0, 1 - q * q)) + MARGIN
        low, high = q * theta - spread, q * theta + spread if q < theta else 1.0
        row, impact = bucket.column(int(t))
        p = impact / bucket.norm[row]
        fits = np.full(len(alive), low <= 0)
        fits[row] = (p >= low) & (p <= high)
        alive &= fits
    return alive


def _best(items: list[tuple[int, np.ndarray, np.ndarray]], start: dict[int, int], conf: Search):
    """``items``: (number, terms, weights), heaviest first. ``start``: thresholds known before."""
    def ranked(ids: list, scores: np.ndarray) -> np.ndarray:
        return np.array(sorted(range(len(ids)), key=lambda k: (-scores[k], ids[k] is None, ids[k] if ids[k] is not None else 0))[: conf.top], np.int64)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        threshold = {k: start.get(k, 1) for k, _, _ in items}
        best = {k: ([], np.zeros(0, np.int64)) for k, _, _ in items}
        open_, id_type = items, None
        length = {k: math.sqrt(float((w.astype(np.float64) ** 2).sum())) for k, _, w in items}
        for batch in (b.slice(at, conf.bucket) for b in batches for at in range(0, b.num_rows, conf.bucket)):
            if not batch.num_rows:
                continue
            bucket, still = Bucket(batch), []
            ids = batch.column("doc_id")
            id_type = ids.type
            for entry in open_:
                number, term, weight = entry
                alive = survivors(bucket, term, weight, length[number], threshold[number], conf.focus)
                if alive is None:
                    continue  # later buckets of this task are shorter still
                still.append(entry)
                if not alive.any():
                    continue
                score = np.zeros(len(alive), np.int64)
                for t, w in zip(term, weight, strict=True):
                    row, impact = bucket.column(int(t))
                    score[row] += int(w) * impact
                hit = np.flatnonzero(alive & (score >= threshold[number]))
                if not len(hit):
                    continue
                if len(hit) > 4 * conf.top:  # ties with the last one stay
                    least = np.partition(score[hit], len(hit) - conf.top)[len(hit) - conf.top]
                    hit = hit[score[hit] >= least]
                known, before = best[number]
                all_ids, all_scores = known + ids.take(pa.array(hit)).to_pylist(), np.concatenate([before, score[hit]])
                keep = ranked(all_ids, all_scores)
                best[number] = [all_ids[k] for k in keep], all_scores[keep]
                if len(keep) == conf.top:
                    threshold[number] = max(threshold[number], int(all_scores[keep[-1]]))
            open_ = still
        rows = [(number, i, int(s)) for number, (known, scores) in best.items() for i, s in zip(known, scores, strict=True)]
        if rows:
            columns = zip(*rows, strict=True)
            kinds = (pa.int64(), id_type, pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["_item", "doc_id", "score"])

    return work


def _top(found: DataFrame, conf: Search) -> DataFrame:
    order = Window.partitionBy("_item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= conf.top)


def search(items: DataFrame, docs: DataFrame, conf: Search = Search(), name: str = "lexical") -> DataFrame:
    """(item_id, rank, doc_id, score): for each item its ``top`` documents of highest score above 0."""
    spark = docs.sparkSession
    item_kind, doc_kind = (f.schema[c].dataType.simpleString() for f, c in ((items, "item_id"), (docs, "doc_id")))
    parts = []
    for block in blocks(items, conf):
        vocabulary = sorted({t for item in block for t in item.terms})
        found = counted(docs, vocabulary, f"{name}-terms")
        sums = found.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
        n_docs, n_terms = sums[0], sums[1]
        # As many rows as the block has terms.
        df = {r[0]: r[1] for r in found.select(F.explode("term").alias("t")).groupBy("t").count().collect()}
        place = {t: k for k, t in enumerate(vocabulary)}
        asked = []
        for item in block:
            weighted = sorted(((conf.weight(n_docs, df[place[t]]), place[t]) for t in item.terms if place[t] in df), reverse=True)
            # No weight is below 0, and a term of weight 0 adds nothing.
            weighted = [(w, t) for w, t in weighted if w]
            asked.append((item.number, np.array([t for _, t in weighted], np.int32), np.array([w for w, _ in weighted], np.int64)))
        asked = [a for a in asked if len(a[1])]
        vectors = written(impacts(found, n_docs, n_terms).sortWithinPartitions(F.desc("norm")), f"{name}-vectors")
        count = vectors.count()
        cut = vectors.agg(F.percentile_approx("norm", F.lit(max(0.0, 1 - conf.head / max(count, 1))), F.lit(10_000))).first()[0] or 0.0
        schema = f"_item long, doc_id {doc_kind}, score long"

        def round_of(rows: DataFrame, start: dict[int, int], asked=asked, schema=schema) -> DataFrame:
            ordered = rows.sortWithinPartitions(F.desc("norm"))
            return _top(ordered.mapInArrow(_best(asked, start, conf), schema), conf)

        first = written(round_of(vectors.filter(F.col("norm") >= cut), {}), f"{name}-head")
        # One number for each item of the block.
        start = {r[0]: r[1] for r in first.filter(F.col("rank") == conf.top).select("_item", "score").collect()}
        rest = round_of(vectors.filter(F.col("norm") < cut), start)
        both = _top(first.drop("rank").unionByName(rest.drop("rank")), conf)
        names = spark.createDataFrame([(i.number, i.item_id) for i in block], f"_item long, item_id {item_kind}")
        parts.append(written(both.join(names, "_item").select("item_id", "rank", "doc_id", "score"), f"{name}-found"))
    if not parts:
        return docs.sparkSession.createDataFrame([], f"item_id {item_kind}, rank int, doc_id {doc_kind}, score long")
    return reduce(DataFrame.unionByName, parts)
