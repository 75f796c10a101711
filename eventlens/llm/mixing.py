"""Mixing sources to target weights by balanced sampling with the cube method.

Each source gets a share of the words wanted by its weight, at most ``cap`` times what it has; what goes over is
shared again by weight. A document is then taken a whole number of times: the whole part of target / source size,
and once more with the rest as inclusion probability. Those probabilities are moved to 0 or 1 by the cube method:
steps in the null space of the constraints (words, documents) keep both totals, until at most two documents are
undecided. It runs in blocks of about ``block`` documents, drawn by hash, so that a source with a third of all rows is
many tasks; what blocks leave undecided, two rows each, is balanced again in blocks of blocks, level by level, and the
last one or two of each source land by giving up one constraint and then drawing.

Sources number as many rows as there are sources and are never collected; rows keep all their columns on the way.

Defined results: a null text has no words; documents without words are taken 0 times; a null source is a source
and comes last; rows that repeat are separate documents; an empty table, or one without words, mixes to nothing; columns named like
those that are added are replaced. Equal input gives equal output: draws depend on hashes of rows only.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from eventlens.llm.common import written

WORD = r"[^\x20\x09-\x0D]+"
ADDED = ("source_size", "target", "copies", "taken")


@dataclass(frozen=True)
class Mix:
    weights: tuple[float, ...] = (3, 1, 2)
    total: float = 1.5
    cap: float = 2.0
    block: int = 512
    seed: int = 11


def targets(sized: DataFrame, conf: Mix) -> DataFrame:
    """(source, source_size, target, docs) by source.

    Capped shares solve sum(min(cap * size, level * weight)) = total: sources by rising cap / weight are capped up to
    the first whose cap is above the level that the uncapped ones would share.
    """
    by = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("docs"))
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weights = F.array(*[F.lit(float(w)) for w in conf.weights])
    by = by.withColumn("_weight", F.element_at(weights, F.pmod(place, F.lit(len(conf.weights))).cast("int") + 1))
    by = by.withColumn("_cap", F.col("source_size") * F.lit(conf.cap))
    rising = Window.orderBy(F.col("_cap") / F.col("_weight"), F.col("source").asc_nulls_last())
    every = Window.partitionBy()
    by = by.withColumns({
        "_capped_before": F.sum("_cap").over(rising) - F.col("_cap"),
        "_weight_from": F.sum("_weight").over(every) - F.sum("_weight").over(rising) + F.col("_weight"),
        "_total": F.sum("source_size").over(every) * F.lit(conf.total),
    })
    # The level if this source and all after it share what the ones before leave.
    by = by.withColumn("_level", (F.col("_total") - F.col("_capped_before")) / F.col("_weight_from"))
    # Among all these levels the right one is the largest: it rises as long as sources are capped that must be.
    level = F.max("_level").over(every)
    by = by.withColumn("target", F.coalesce(F.least(F.col("_cap"), level * F.col("_weight")), F.col("_cap")))
    return by.select("source", "source_size", "target", "docs")


def flight(chance: np.ndarray, share: np.ndarray, size: np.ndarray, draw: np.random.Generator) -> np.ndarray:
    """Move ``chance`` to 0 or 1 for all but two units, keeping the expected totals of size and of units.

    Constraints are in units of size / share and 1 / share, with ``share`` the first inclusion probabilities. Three
    units are in play at a time; the vector that two constraints leave free is their cross product.
    """
    p = chance.astype(float).tolist()
    a, b = (size / share).tolist(), (1 / share).tolist()
    draws = iter(draw.random(2 * len(p) + 2).tolist())
    play: list[int] = []
    for unit in range(len(p)):
        if not 0 < p[unit] < 1:
            continue
        play.append(unit)
        if len(play) == 3:
            i, j, k = play
            u = (a[j] * b[k] - a[k] * b[j], a[k] * b[i] - a[i] * b[k], a[i] * b[j] - a[j] * b[i])
            if max(map(abs, u)) <= 1e-12 * (abs(a[i]) + abs(a[j]) + abs(a[k])) * (b[i] + b[j] + b[k]):
                u = (1 / b[i], -1 / b[j], 0.0)  # equal sizes: two units can trade alone
            play = _step(p, play, u, next(draws))
    return np.array(p)


def _step(p: list[float], units: list[int], u: tuple[float, ...], r: float) -> list[int]:
    """One step along ``u`` to a face of the cube; the units that are still open."""
    up = min((1 - p[i]) / x if x > 0 else -p[i] / x for i, x in zip(units, u, strict=True) if x)
    down = min(p[i] / x if x > 0 else (p[i] - 1) / x for i, x in zip(units, u, strict=True) if x)
    step = up if r * (up + down) < down else -down
    for i, x in zip(units, u, strict=True):
        q = p[i] + step * x
        p[i] = 0.0 if q < 1e-9 else 1.0 if q > 1 - 1e-9 else q
    return [i for i in units if 0 < p[i] < 1]


def landing(chance: np.ndarray, share: np.ndarray, size: np.ndarray, draw: np.random.Generator) -> np.ndarray:
    """Decide the last units: pairs trade with the words kept, then the last one is drawn."""
    p = chance.astype(float).tolist()
    open_ = [i for i, x in enumerate(p) if 0 < x < 1]
    while len(open_) > 1:
        i, j = open_[:2]
        open_ = _step(p, [i, j], (size[j] / share[j], -size[i] / share[i]), draw.random()) + open_[2:]
    for i in open_:
        p[i] = float(draw.random() < p[i])
    return np.array(p)


def _balance(seed: int, last: bool):
    def work(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        order = np.lexsort((rows.column("size").to_numpy(), rows.column("_order").to_numpy()))
        rows = rows.take(pa.array(order))
        start = hashlib.sha256(repr((seed, last, [k.as_py() for k in key])).encode()).digest()
        draw = np.random.default_rng(int.from_bytes(start[:8], "big"))
        args = (rows.column("_share").to_numpy(), rows.column("size").to_numpy().astype(float), draw)
        chance = flight(rows.column("_chance").to_numpy(), *args)
        chance = landing(chance, *args) if last else chance
        return rows.set_column(rows.column_names.index("_chance"), "_chance", pa.array(chance))

    return work


def sizes(docs: DataFrame) -> DataFrame:
    """``docs`` with ``size``: the words of ``text``."""
    return docs.withColumn("size", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long"))


def mix(sized: DataFrame, conf: Mix = Mix()) -> DataFrame:
    """Rows of ``sized`` (doc_id, source, size and any others) with source_size, target (of the source), copies (how
    often the document is taken) and taken (words).

    All columns travel with the one shuffle into blocks, so leave out what is not needed after.
    """
    columns = [c for c in sized.columns if c not in ADDED]
    sized = sized.select(*columns)
    others = [c for c in columns if c not in ("doc_id", "source", "size")]
    # Other columns keep out of the way under names of their own until the end.
    own = {c: f"_own{k}" for k, c in enumerate(others)}
    plain = sized.select("doc_id", "source", F.coalesce("size", F.lit(0)).cast("long").alias("size"), *[F.col(f"`{c}`").alias(n) for c, n in own.items()])
    by = written(targets(plain, conf), "mix-targets")
    most = by.agg(F.max("docs")).first()[0] or 0
    joined = plain.alias("d").join(by.alias("t"), F.col("d.source").eqNullSafe(F.col("t.source"))).select("d.*", "t.source_size", "t.target", "t.docs")
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    joined = joined.withColumn("_base", F.floor(ratio)).withColumn("_rest", ratio - F.col("_base"))
    joined = joined.withColumns({
        "_order": F.xxhash64(F.lit(conf.seed), "doc_id", "size", *own.values()),
        "_chance": F.when((F.col("size") == 0) | (F.col("_rest") < 1e-9), 0.0).otherwise(F.col("_rest")),
        "_share": F.greatest("_rest", F.lit(1e-9)),  # divides only where the chance is above 0
    })
    spot = F.pmod(F.xxhash64("_order", F.lit("block")), F.ceil(F.col("docs") / conf.block))
    joined = joined.withColumn("_block", spot).drop("docs", "_rest")
    blocks, parts, level = -(-most // conf.block), [], 0
    while True:
        last = blocks <= 1
        made = joined.groupBy("source", "_block").applyInArrow(_balance(conf.seed + level, last), joined.schema)
        made = written(made, f"mix-{level}")
        if last:
            parts.append(made)
            break
        is_open = (F.col("_chance") > 0) & (F.col("_chance") < 1)
        parts.append(made.filter(~is_open))
        # Two rows are left of each block, so this many blocks make one of the next level.
        joined = made.filter(is_open).withColumn("_block", F.floor(F.col("_block") / (conf.block // 2)))
        blocks, level = -(-blocks // (conf.block // 2)), level + 1
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    copies = F.when(F.col("size") > 0, (F.col("_base") + F.col("_chance")).cast("int")).otherwise(0)
    back = [F.col(own.get(c, c)).alias(c) for c in columns]
    return whole.select(*back, "source_size", "target", copies.alias("copies"), (F.col("size") * copies).alias("taken"))


def mixed(docs: DataFrame, conf: Mix = Mix()) -> DataFrame:
    """The mix itself: rows of ``docs``, each as often as it is taken."""
    row = docs.select("doc_id", "source", "text", F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "text"]).alias("row"))
    taken = mix(sizes(row), conf).filter(F.col("copies") > 0)
    times = taken.select("text", "row", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    return times.select(*["text" if c == "text" else F.col("row")[c].alias(c) for c in docs.columns])
