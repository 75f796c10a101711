"""N-gram Jaccard join by chosen paths.

A text is its set of runs of five words (a text of fewer words is one run; texts without words are one another's
copies). Texts with one set are a class. A set is embedded by 128 minimum hashes ("tokens"), which two sets share in about the
share of their Jaccard likeness. Each run of the join sends a set to every token that the run's hash samples, with
probability 1 / (threshold x tokens), so that two sets at the threshold are expected to meet once; buckets that are too
large are split again in the same way, and their rows compared with a pivot (``candidates``); small ones are compared by
brute force on the sketches. ``runs`` repetitions make the chance that a pair at the threshold never
meets e^-runs. What met and looks alike is then compared exactly on whole sets (``exact``).

Classes, not rows, take part, so copies never multiply; pairs are counted where they are compared and never put out.

Defined results: a null text counts as empty; null ids are rows like others and come last in groups; rows that repeat are
copies; ties keep the smallest id; further columns stay where rows are returned.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventlens.llm import candidates, exact
from eventlens.llm.common import fields, numbered, written
from eventlens.llm.graph import components
from eventlens.llm.textscan import mix, scan


@dataclass(frozen=True)
class Join:
    words: int = 5
    threshold: float = 0.8
    tokens: int = 128
    runs: int = 16
    limit: int = 4096


def _set_id(members: np.ndarray) -> bytes:
    return hashlib.blake2b(members.tobytes(), digest_size=16).digest()


def sets(texts: list[str | None], words: int) -> Iterator[np.ndarray]:
    """The sorted hashes of each text's runs of words."""
    for part in scan(texts):
        term, text = part.word_runs(words)
        order = np.lexsort((term, text))
        term, text = term[order], text[order]
        new = np.ones(len(term), bool)
        new[1:] = (term[1:] != term[:-1]) | (text[1:] != text[:-1])
        term, text = term[new], text[new]
        bounds = np.searchsorted(text, np.arange(part.n_texts + 1))
        for k in range(part.n_texts):
            yield term[bounds[k] : bounds[k + 1]]


def _multipliers(n: int) -> np.ndarray:
    return mix(np.arange(1, n + 1, dtype=np.uint64)) | np.uint64(1)


def minima(members: np.ndarray, tokens: int) -> np.ndarray:
    """The smallest hash of a set under each of ``tokens`` functions; zeros for an empty set."""
    if not len(members):
        return np.zeros(tokens, np.uint64)
    out = np.full(tokens, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(members), 4096):
        h = members[None, at : at + 4096] * _multipliers(tokens)[:, None]
        h ^= h >> np.uint64(32)
        out = np.minimum(out, h.min(axis=1))
    return out


def _chosen(value: np.ndarray, conf: Join) -> np.ndarray:
    return value < np.uint64(int(2**64 / (conf.threshold * conf.tokens)))


def rule(conf: Join) -> candidates.Rule:
    def alike(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return np.count_nonzero(a == b, axis=-1) / conf.tokens

    def children(keys: np.ndarray, sketches: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        places = mix(np.arange(conf.tokens, dtype=np.uint64) + np.uint64(1 << 20))
        value = mix(mix(keys.astype(np.int64).view(np.uint64))[:, None] + places[None, :] + sketches.astype(np.uint64))
        row, token = np.nonzero(_chosen(value, conf))
        return row, mix(value[row, token]).view(np.int64)

    # Standard error of a likeness from 128 tokens: 0.035 at 0.8. Sets at 0.8 show 0.6 or more (5.7 errors); a set that
    # shows 0.85 with its pivot is within 0.8 of it (1.4), and all within 0.8 of that set are within 0.6 of the pivot.
    return candidates.Rule(conf.tokens, "<u2", alike, children, conf.threshold - 0.2, conf.threshold - 0.35, conf.threshold + 0.05, conf.limit)


def sketched(docs: DataFrame, conf: Join) -> DataFrame:
    """(doc_id, set_id, n, sketch, keys) of every document, by a map."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        salt = mix(np.arange(conf.runs * conf.tokens, dtype=np.uint64)).reshape(conf.runs, conf.tokens)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                ids, n, sketch, keys = [], [], [], []
                for members in sets(part.column("text").to_pylist(), conf.words):
                    low = minima(members, conf.tokens)
                    value = mix(low[None, :] ^ salt)
                    ids.append(_set_id(members))
                    n.append(len(members))
                    sketch.append((mix(low) >> np.uint64(48)).astype("<u2").tobytes())
                    keys.append(mix(value[_chosen(value, conf)]).view(np.int64) if len(members) else np.zeros(0, np.int64))
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), part.column("digest"), pa.array(ids, pa.binary()), pa.array(n, pa.int32()), pa.array(sketch, pa.binary()), pa.array(keys, pa.list_(pa.int64()))],
                    ["doc_id", "digest", "set_id", "n", "sketch", "keys"],
                )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text", _digest().alias("digest")).mapInArrow(work, f"doc_id {kind}, digest string, set_id binary, n int, sketch binary, keys array<long>")


def _with_sets(docs: DataFrame, conf: Join) -> DataFrame:
    """``docs`` with _set_id and _set, by a map."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                made = list(sets(part.column("text").to_pylist(), conf.words))
                part = part.append_column("_set_id", pa.array(map(_set_id, made), pa.binary()))
                yield part.append_column("_set", pa.array([m.tobytes() for m in made], pa.binary()))

    return docs.mapInArrow(work, fields(docs).add("_set_id", "binary").add("_set", "binary"))


def _digest(text: str = "text") -> F.Column:
    """Tells texts of one id apart; a null text is none of the others."""
    return F.coalesce(F.md5(F.col(text).cast("binary")), F.lit("null"))


def _linked(threshold: float):
    def linked(group: pa.Table) -> np.ndarray:
        members = [np.frombuffer(b, np.uint64) for b in group.column("_set").to_pylist()]
        size = np.array([len(m) for m in members], np.int64)
        row = np.repeat(np.arange(len(members)), size)
        found, value, times = np.unique(np.concatenate(members), return_inverse=True, return_counts=True)
        shared = times > 1
        place = np.cumsum(shared) - 1
        kept = shared[value]
        row, value = row[kept], place[value[kept]]
        order = np.argsort(value, kind="stable")
        row, value = row[order], value[order]
        both = np.zeros((len(members), len(members)), np.float64)
        step = 4096
        for at in range(0, int(shared.sum()), step):
            low, high = np.searchsorted(value, [at, at + step])
            has = np.zeros((len(members), step), np.float32)
            has[row[low:high], value[low:high] - at] = 1
            both += has @ has.T
        union = size[:, None] + size[None, :] - both
        return both / np.maximum(union, 1) >= threshold

    return linked


def classes(docs: DataFrame, conf: Join) -> tuple[DataFrame, DataFrame]:
    """(doc_id, set_id, digest of the text) by row, and by class: set_id, node, first_id, copies, n, sketch, keys."""
    rows = written(sketched(docs, conf), "jaccard-rows")
    by = rows.groupBy("set_id").agg(
        F.min("doc_id").alias("first_id"),
        F.count(F.lit(1)).alias("copies"),
        F.first("n").alias("n"),
        F.first("sketch").alias("sketch"),
        F.first("keys").alias("keys"),
    )
    # Classes are numbered, not named by a part of their id: two of them must never be one node of the graph.
    return rows.select("doc_id", "set_id", "digest"), numbered(by, "jaccard-classes")


def join(docs: DataFrame, conf: Join = Join()) -> tuple[DataFrame, DataFrame]:
    """Membership (doc_id, set_id) and, by class: set_id, class_id, n_links of its members, group_id, group_set.

    ``n_links`` counts all other documents at the threshold or above. ``group_set`` is the class whose smallest id
    is the group's.
    """
    members, by = classes(docs, conf)
    edges = candidates.edges(by.select("node", F.explode("keys").alias("key")), by.select("node", "sketch"), rule(conf), "jaccard")
    maybe = components(edges, "jaccard-maybe")
    asked = written(by.select("node", "set_id", "first_id", "copies").join(maybe, "node"), "jaccard-asked")
    # One document of each class brings the text; another text under the same id is told apart by its set.
    # A sorted merge at every size: what is asked for grows with the documents and is never broadcast.
    texts = docs.select("doc_id", "text").join(asked.hint("merge"), F.col("doc_id").eqNullSafe(F.col("first_id")))
    texts = _with_sets(texts.select("text", "set_id", "node", F.col("root").alias("component"), "copies"), conf).filter("set_id = _set_id")
    one = texts.select("set_id", "node", "component", "copies", "_set").dropDuplicates(["set_id"])
    found = exact.links(written(one.drop("set_id"), "jaccard-sets"), _linked(conf.threshold), "jaccard-links")
    counts = found.groupBy("node").agg(F.sum("links").alias("_links"))
    groups = components(found.select(F.col("node").alias("a"), F.col("forest").alias("b")), "jaccard-groups")
    whole = by.select("set_id", "node", "first_id", "copies").join(counts, "node", "left").join(groups, "node", "left")
    whole = written(whole.withColumn("root", F.coalesce("root", "node")), "jaccard-whole")
    order = F.struct(F.col("first_id").isNull(), "first_id", "set_id")
    heads = written(whole.groupBy("root").agg(F.min(order).alias("_head")), "jaccard-heads")
    out = whole.join(heads, "root").select(
        "set_id",
        F.col("first_id").alias("class_id"),
        (F.coalesce("_links", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
        F.col("_head.first_id").alias("group_id"),
        F.col("_head.set_id").alias("group_set"),
    )
    return members, written(out, "jaccard-out")


def linked_documents(docs: DataFrame, conf: Join = Join()) -> DataFrame:
    """One row per document: doc_id, class_id (smallest id with the same set), n_links, group_id, kept (it is its group's smallest)."""
    members, by = join(docs, conf)
    out = members.join(by, "set_id")
    kept = (F.col("set_id") == F.col("group_set")) & F.col("doc_id").eqNullSafe(F.col("group_id"))
    return out.select("doc_id", "class_id", "n_links", "group_id", kept.alias("kept"))


def deduplicated(docs: DataFrame, conf: Join = Join()) -> DataFrame:
    """Rows of ``docs``, one document of each group: the one with the smallest id."""
    members, by = join(docs, conf)
    marked = members.join(by.select("set_id", "group_id", "group_set"), "set_id")
    same = F.col("doc_id").eqNullSafe(F.col("group_id")) & (F.col("set_id") == F.col("group_set"))
    gone = marked.filter(~same).select("doc_id", "digest")
    # Rarely the kept document's id has more rows of the same words: of different texts one stays, of equal rows one.
    key = ["group_id", "group_set"]
    more = written(marked.filter(same).groupBy(*key).agg(F.min("digest").alias("_first"), F.count(F.lit(1)).alias("_n")).filter("_n > 1"), "jaccard-more")
    repeated = not more.isEmpty()
    if repeated:
        first = more.select(F.col("group_id").alias("_id"), F.col("group_set").alias("_set"), "_first")
        others = marked.filter(same).join(first, F.col("group_id").eqNullSafe(F.col("_id")) & (F.col("group_set") == F.col("_set")))
        gone = gone.unionByName(others.filter(F.col("digest") != F.col("_first")).select("doc_id", "digest"))
    gone = written(gone.select(F.col("doc_id").alias("_gone_id"), F.col("digest").alias("_gone")).distinct(), "jaccard-gone")
    left = docs.withColumn("_digest", _digest()).join(gone, F.col("doc_id").eqNullSafe(F.col("_gone_id")) & (F.col("_digest") == F.col("_gone")), "left_anti")
    if repeated:
        left = left.dropDuplicates(["doc_id", "_digest"])
    return left.select(docs.columns)
