"""Embedding near-duplicates by iterative quantisation and multi-index Hamming tables.

Equal vectors of one label are a class. On a bounded sample of classes, principal axes and a rotation of them are
learned, which alternates between the signs of the rotated vectors and the rotation that fits these signs best; signs
are the code. Several such rotations, from different starts, make one long code. Each table is keyed by a substring
of the code, as long as the logarithm of the number of classes asks, and there are as many tables as the wanted
recall at the threshold needs. Vectors that crowd around one direction agree in fewer bits at the threshold: where that would
take more than ``most_tables``, substrings are shorter, and buckets larger, so that a vector has never more keys. Rows that meet in a table and have near codes are connected
(``candidates``), and everything connected is ranked by the cosine of the original vectors, in double precision (``exact``).

Only equal labels are compared. Defined results: vectors that are null, empty, zero or hold null or non-finite components,
and rows of a null label, link with nothing and are components of their own; vectors of different lengths never link;
rows that repeat are copies and link with each other; null ids come last in a component; an empty table stays empty; of further
columns none is returned.
"""

from __future__ import annotations

import hashlib
import math
import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventlens.llm import candidates, exact
from eventlens.llm.common import numbered, written
from eventlens.llm.graph import components
from eventlens.llm.textscan import mix


@dataclass(frozen=True)
class Near:
    """``sample`` bounds the vectors that rotations are learned on; ``bucket`` is the wanted mean size of a table's bucket."""

    threshold: float = 0.93
    recall: float = 0.99
    bucket: int = 16
    most_tables: int = 128
    sample: int = 8192
    rounds: int = 20
    limit: int = 4096
    seed: int = 5


@dataclass
class Codes:
    """Sign codes and where each table's substring lies in them."""

    mean: np.ndarray
    axes: np.ndarray  # dimensions x bits
    length: int
    tables: int
    likeness: float  # expected share of equal bits at the threshold

    @property
    def width(self) -> int:
        return -(-self.axes.shape[1] // 8)

    def of(self, unit: np.ndarray) -> np.ndarray:
        """Bits (0 or 1) of unit vectors; shorter vectors count as padded by zeros, longer ones as cut."""
        d = len(self.mean)
        fitted = np.zeros((len(unit), d))
        fitted[:, : min(d, unit.shape[1])] = unit[:, :d]
        return ((fitted - self.mean) @ self.axes > 0).astype(np.uint8)


def quantiser(unit: np.ndarray, n: int, conf: Near) -> Codes:
    """Learn codes for a table of ``n`` classes from a sample of unit vectors."""
    mean = unit.mean(axis=0)
    centred = unit - mean
    spread = max(float((centred**2).sum(axis=1).mean()), 1e-9)
    # Centring widens angles; at worst bits of linked vectors agree no more often than those of others.
    likeness = max(0.5, 1 - math.acos(max(-1.0, min(1.0, 1 - (1 - conf.threshold) / spread))) / math.pi)
    length = max(4, math.ceil(math.log2(max(n, 2) / conf.bucket)))

    def asked(bits: int) -> int:
        return max(4, math.ceil(math.log(1 - conf.recall) / math.log(1 - likeness**bits)))

    while length > 1 and asked(length) > conf.most_tables:
        length -= 1
    tables = asked(length)
    _, axes = np.linalg.eigh(centred.T @ centred)
    bits = min(unit.shape[1], 64)
    main = axes[:, ::-1][:, :bits]
    projected = centred @ main
    rng = np.random.default_rng(conf.seed)
    found = []
    while sum(r.shape[1] for r in found) < max(length * tables, 128):
        rotation, _ = np.linalg.qr(rng.standard_normal((bits, bits)))
        for _ in range(conf.rounds):
            signs = np.where(projected @ rotation > 0, 1.0, -1.0)
            left, _, right = np.linalg.svd(signs.T @ projected)
            rotation = (left @ right).T
        found.append(main @ rotation)
    return Codes(mean, np.concatenate(found, axis=1), length, tables, likeness)


def rule(codes: Codes, conf: Near) -> candidates.Rule:
    def alike(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return 1 - np.bitwise_count(a ^ b).sum(axis=-1, dtype=np.int32) / bits

    def children(keys: np.ndarray, sketches: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        # Four more bits, the same ones for all rows of a bucket.
        place = mix(keys.astype(np.int64).view(np.uint64)[:, None] + np.arange(4, dtype=np.uint64)) % np.uint64(bits)
        bit = np.take_along_axis(np.unpackbits(sketches, axis=1), place.astype(np.int64), axis=1)
        value = bit @ np.array([1, 2, 4, 8], np.uint64)
        return np.arange(len(keys)), mix(keys.astype(np.int64).view(np.uint64) * np.uint64(16) + value + np.uint64(1)).view(np.int64)

    bits = codes.axes.shape[1]
    # Margins in standard errors of a share of some 64 independent bits, about 0.04.
    return candidates.Rule(codes.width, "u1", alike, children, codes.likeness - 0.12, codes.likeness - 0.2, codes.likeness + 0.04, conf.limit)


def _usable(vectors: DataFrame) -> F.Column:
    v = F.col("embedding")
    odd = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.col("label").isNotNull() & v.isNotNull() & (F.size(v) > 0) & ~odd & F.exists(v, lambda x: x != 0)


def _numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Identity of a class and its unit vector as bytes of doubles."""
    for batch in batches:
        ids, units = [], []
        for label, v in zip(batch.column("_label").to_pylist(), batch.column("_vector"), strict=True):
            v = v.values.to_numpy(zero_copy_only=False) + 0.0  # -0 and 0 are one number
            ids.append(hashlib.blake2b(label.encode() + b"\0" + v.tobytes(), digest_size=16).digest())
            v = v / np.abs(v).max()
            units.append((v / np.sqrt(v @ v)).tobytes())
        yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(ids, pa.binary()), batch.column("_label"), pa.array(units, pa.binary())], ["vec_id", "set_id", "label", "unit"])


def _coded(codes: Codes):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = np.uint64(1) << np.arange(codes.length, dtype=np.uint64)
        for batch in batches:
            if not batch.num_rows:
                continue
            label = np.array([struct.unpack("<Q", hashlib.blake2b(f"{x}/{len(u)}".encode(), digest_size=8).digest())[0] for x, u in zip(batch.column("label").to_pylist(), batch.column("unit").to_pylist(), strict=True)], np.uint64)
            bits = np.concatenate([codes.of(np.frombuffer(u, np.float64)[None, :]) for u in batch.column("unit").to_pylist()])
            keys = np.stack([mix(mix(label + np.uint64(t)) + bits[:, t * codes.length : (t + 1) * codes.length] @ weights) for t in range(codes.tables)], axis=1)
            yield pa.RecordBatch.from_arrays(
                [batch.column("node"), pa.array([r.tobytes() for r in np.packbits(bits, axis=1)], pa.binary()), pa.array(list(keys.view(np.int64)), pa.list_(pa.int64()))],
                ["node", "sketch", "keys"],
            )

    return work


def _linked(threshold: float):
    def linked(group: pa.Table) -> np.ndarray:
        label = np.array(group.column("label").to_pylist())
        raw = group.column("unit").to_pylist()
        size = np.array([len(u) for u in raw])
        out = np.zeros((len(raw), len(raw)), bool)
        for n in np.unique(size):
            at = np.flatnonzero(size == n)
            unit = np.frombuffer(b"".join(raw[i] for i in at), np.float64).reshape(len(at), -1)
            out[np.ix_(at, at)] = (unit @ unit.T >= threshold) & (label[at][:, None] == label[at][None, :])
        return out

    return linked


def near_duplicates(vectors: DataFrame, conf: Near = Near()) -> DataFrame:
    """One row per vector: vec_id, n_links (other vectors at the threshold or above), component_id (smallest id reachable), kept."""
    ok = F.coalesce(_usable(vectors), F.lit(False))
    kind = vectors.schema["vec_id"].dataType.simpleString()
    usable = vectors.filter(ok).select("vec_id", F.col("label").cast("string").alias("_label"), F.col("embedding").cast("array<double>").alias("_vector"))
    rows = written(usable.mapInArrow(_numbered, f"vec_id {kind}, set_id binary, label string, unit binary"), "embed-rows")
    by = rows.groupBy("set_id").agg(F.min("vec_id").alias("first_id"), F.count(F.lit(1)).alias("copies"), F.first("label").alias("label"), F.first("unit").alias("unit"))
    by = numbered(by, "embed-classes")
    n = by.count()
    sample = [r[0] for r in by.select("unit").orderBy(F.xxhash64(F.lit(conf.seed), "set_id"), "set_id").limit(conf.sample).collect()]
    if n:
        dims = max(map(len, sample)) // 8
        unit = np.zeros((len(sample), dims))
        for k, u in enumerate(sample):
            unit[k, : len(u) // 8] = np.frombuffer(u, np.float64)
        codes = quantiser(unit, n, conf)
        coded = written(by.select("node", "label", "unit").mapInArrow(_coded(codes), "node long, sketch binary, keys array<long>"), "embed-codes")
        edges = candidates.edges(coded.select("node", F.explode("keys").alias("key")), coded.select("node", "sketch"), rule(codes, conf), "embed")
        maybe = components(edges, "embed-maybe").withColumnRenamed("root", "component")
        found = exact.links(written(by.select("node", "label", "unit", "copies").join(maybe, "node"), "embed-asked"), _linked(conf.threshold), "embed-links")
        counts = found.groupBy("node").agg(F.sum("links").alias("_links"))
        groups = components(found.select(F.col("node").alias("a"), F.col("forest").alias("b")), "embed-groups")
        whole = by.select("set_id", "node", "first_id", "copies").join(counts, "node", "left").join(groups, "node", "left")
        whole = written(whole.withColumn("root", F.coalesce("root", "node")), "embed-whole")
        heads = written(whole.groupBy("root").agg(F.min("first_id").alias("component_id")), "embed-heads")
        result = whole.join(heads, "root").select("set_id", (F.coalesce("_links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "component_id")
        linked = rows.select("vec_id", "set_id").join(written(result, "embed-out"), "set_id").drop("set_id")
    else:
        linked = rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    alone = vectors.filter(~ok).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
