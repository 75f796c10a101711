"""Document fingerprints by SimHash, and the search for all of them within a Hamming radius.

Every distinct term of a text (a run of ``size`` words; a shorter text is one term) votes on each bit of
the fingerprint, for or against it by the term's hash, with a weight of 1 + ln(its count). A fingerprint
is a hex string of ``bits`` bits. Texts without words get zeros.

Search: split the bits into ``radius + spare`` blocks; two fingerprints at most ``radius`` apart agree on
at least ``spare`` whole blocks, so a table for each choice of ``spare`` blocks, keyed by their bits, holds
every such pair in one bucket. A query that meets a fingerprint in several tables keeps it in the first.

Defined results: null texts count as empty; equal texts have equal fingerprints; further columns stay.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from eventlens.llm.common import fields, partitions, written
from eventlens.llm.textscan import mix, scan


@dataclass(frozen=True)
class Votes:
    bits: int = 64
    size: int = 2


def fingerprints(texts: list[str | None], conf: Votes = Votes()) -> np.ndarray:
    """One row of ``bits / 64`` unsigned integers by text."""
    out = np.zeros((len(texts), conf.bits // 64), np.uint64)
    for part in scan(texts):
        term, text = part.word_runs(conf.size)
        order = np.lexsort((term, text))
        text, term = text[order], term[order]
        new = np.ones(len(term), bool)
        new[1:] = (term[1:] != term[:-1]) | (text[1:] != text[:-1])
        at = np.flatnonzero(new)
        weight = 1 + np.log(np.diff(np.append(at, len(term))))
        text, term = text[at], term[at]
        edges = np.searchsorted(text, np.arange(part.n_texts + 1))
        for block in range(conf.bits // 64):
            vote = _votes(mix(term + np.uint64(block)), weight, edges)
            packed = np.packbits(vote > 0, axis=1).view(">u8").astype(np.uint64)
            out[part.first : part.first + part.n_texts, block] = packed[:, 0]
    return out


def _votes(term: np.ndarray, weight: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """Sum of signed weights for each of 64 bits, by text."""
    out = np.zeros((len(edges) - 1, 64))
    bits = np.unpackbits(term.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
    for i in np.flatnonzero(np.diff(edges)):
        w = weight[edges[i] : edges[i + 1]].astype(np.float32)
        out[i] = 2 * (w @ bits[edges[i] : edges[i + 1]].astype(np.float32)) - w.sum(dtype=np.float64)
    return np.round(out, 3)


def as_hex(fingerprint: np.ndarray) -> list[str]:
    return ["".join(f"{int(x):016x}" for x in row) for row in fingerprint]


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Share of equal bits, by row."""
    return 1 - np.bitwise_count(a ^ b).sum(axis=1) / (64 * a.shape[1])


def add_fingerprints(docs: DataFrame, conf: Votes = Votes(), name: str = "fingerprint") -> DataFrame:
    """``docs`` with the fingerprint of ``text``; a map without a shuffle. A column of that name is replaced."""
    docs = docs.drop(name)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.append_column(name, pa.array(as_hex(fingerprints(batch.column("text").to_pylist(), conf)), pa.string()))

    return docs.mapInArrow(work, fields(docs).add(name, "string"))


def block_keys(fingerprint: Column, bits: int, radius: int, spare: int) -> list[Column]:
    """A key for each table: the bits of ``spare`` of the ``radius + spare`` blocks, as a string of 0 and 1."""
    n = radius + spare
    edges = [bits * k // n for k in range(n + 1)]
    binary = F.concat(*[F.lpad(F.conv(F.substring(fingerprint, 1 + 8 * k, 8), 16, 2), 32, "0") for k in range(bits // 32)])
    return [
        F.concat(*[F.substring(binary, edges[b] + 1, edges[b + 1] - edges[b]) for b in chosen])
        for chosen in combinations(range(n), spare)
    ]


def distance(a: Column, b: Column, bits: int) -> Column:
    """Hamming distance of two hex strings, in the JVM."""
    parts = [
        F.bit_count(F.conv(F.substring(a, 1 + 8 * k, 8), 16, 10).cast("long").bitwiseXOR(F.conv(F.substring(b, 1 + 8 * k, 8), 16, 10).cast("long")))
        for k in range(bits // 32)
    ]
    return sum(parts[1:], parts[0])


def search(queries: DataFrame, prints: DataFrame, radius: int = 3, spare: int = 3, conf: Votes = Votes()) -> DataFrame:
    """All (query, fingerprint, distance) at most ``radius`` apart, by permuted block tables.

    ``queries`` and ``prints`` have a column ``fingerprint``; equal ones count once on either side, so copies
    never multiply, and rows of documents are had by joining on the fingerprint. Nulls match nothing. With
    ``spare`` blocks of ``radius + spare`` a key has about ``bits * spare / (radius + spare)`` bits: choose
    ``spare`` so that this exceeds log2 of the number of distinct fingerprints.
    """
    def table(df: DataFrame, name: str) -> DataFrame:
        one = df.select(F.col("fingerprint").alias(name)).filter(F.col(name).isNotNull()).distinct()
        keys = block_keys(F.col(name), conf.bits, radius, spare)
        return one.select(name, F.posexplode(F.array(*keys)).alias("_table", "_key"))

    met = table(queries, "query").join(table(prints, "fingerprint"), ["_table", "_key"])
    met = met.withColumn("distance", distance(F.col("query"), F.col("fingerprint"), conf.bits)).filter(F.col("distance") <= radius)
    a, b = (F.array(*block_keys(F.col(c), conf.bits, radius, spare)) for c in ("query", "fingerprint"))
    first = F.array_position(F.zip_with(a, b, lambda x, y: x == y), True) - 1
    return met.filter(F.col("_table") == first).select("query", "fingerprint", "distance")


#: What ``edited_likeness`` adds.
EDITED = "n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def edited(text: str, after: str) -> str:
    """The last half of the code points replaced by as many of the next text, or by all of it."""
    half = len(text) // 2
    return text[: len(text) - half] + after[:half]


def edited_likeness(docs: DataFrame, conf: Votes = Votes()) -> DataFrame:
    """Fingerprint of every document and of its edited text, and how near both and the next document are.

    The next document is the one after it by ascending ``doc_id`` (null first; equal ids by their text); after
    the last comes the first. Documents are dealt by ranges of id, one shuffle of the texts. The one document
    of each range whose successor is the first of a later range is finished by a join on the range's number.
    """
    ordered = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    # Bounds are drawn from ids and hashes: a sample of texts would go to the driver.
    order = ["doc_id", F.xxhash64("text")]
    ordered = ordered.repartitionByRange(partitions(docs), *order).sortWithinPartitions(*order, "text")
    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, {EDITED}, part int, head string, tail string"
    kept = written(ordered.withColumn("part", F.spark_partition_id()).mapInArrow(_by_pairs(conf), schema), "simhash")
    heads = kept.filter(F.col("head").isNotNull()).select("part", "head")
    tails = kept.filter(F.col("tail").isNotNull()).select("doc_id", "part", "tail")
    # A number for each range, not its texts: which range comes next, and the first after the last.
    every = Window.orderBy("part")
    order = heads.select("part", F.lead("part").over(every).alias("_next"), F.min("part").over(Window.partitionBy()).alias("_first"))
    order = order.select("part", F.coalesce("_next", "_first").alias("_next"))
    last = tails.join(order, "part").join(heads.select(F.col("part").alias("_next"), "head"), "_next")
    last = last.select("doc_id", F.col("tail").alias("text"), F.col("head").alias("_after"))
    columns = ["doc_id", *[c.split()[0] for c in EDITED.split(", ")]]
    done = last.mapInArrow(_of_pairs(conf), f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, {EDITED}")
    return kept.filter(F.col("tail").isNull() & F.col("n_chars").isNotNull()).select(columns).unionByName(done.select(columns))


def _measures(texts: list[str], after: list[str], conf: Votes, next_prints: np.ndarray | None = None) -> list[pa.Array]:
    changed = [edited(a, b) for a, b in zip(texts, after, strict=True)]
    own, other = fingerprints(texts, conf), fingerprints(changed, conf)
    following = fingerprints(after, conf) if next_prints is None else next_prints(own)
    return [
        pa.array([len(t) for t in texts], pa.int64()),
        pa.array([hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest() for t in changed], pa.string()),
        pa.array(as_hex(own), pa.string()),
        pa.array(as_hex(other), pa.string()),
        pa.array(likeness(own, other), pa.float64()),
        pa.array(likeness(own, following), pa.float64()),
    ]


def _of_pairs(conf: Votes) -> Callable:
    names = ["doc_id", *[c.split()[0] for c in EDITED.split(", ")]]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = _measures(batch.column("text").to_pylist(), batch.column("_after").to_pylist(), conf)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *values], names)

    return work


def _by_pairs(conf: Votes) -> Callable:
    """Rows of a sorted range with the next row at hand. Its first text is kept as ``head`` and its last as ``tail``."""
    names = ["doc_id", *[c.split()[0] for c in EDITED.split(", ")], "part", "head", "tail"]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, texts, part, head = None, [], None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            part = batch.column("part")[0].as_py()
            more = batch.column("text").to_pylist()
            ids = batch.column("doc_id") if ids is None else pa.concat_arrays([ids.slice(len(ids) - 1), batch.column("doc_id")])
            head = more[0] if head is None else head
            texts = texts[-1:] + more
            if len(texts) > 1:
                last = fingerprints(texts[-1:], conf)
                values = _measures(texts[:-1], texts[1:], conf, lambda own, last=last: np.concatenate([own[1:], last]))
                n = len(texts) - 1
                blank = pa.nulls(n, pa.string())
                yield pa.RecordBatch.from_arrays([ids.slice(0, n), *values, pa.array([part] * n, pa.int32()), blank, blank], names)
        if texts:
            blank = [pa.nulls(1, t) for t in (pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64())]
            yield pa.RecordBatch.from_arrays([ids.slice(len(ids) - 1), *blank, pa.array([part], pa.int32()), pa.array([head]), pa.array(texts[-1:])], names)

    return work
