"""Fit a text classifier on a bounded labelled sample and score whole tables with it."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventlens.llm.common import fields
from eventlens.llm.subword import Model, Subwords, train


def fit(docs: DataFrame, labels: DataFrame, target: str, usable: Column, conf: Subwords) -> Model:
    """Train on the labelled rows that ``usable`` (a condition on ``doc_id``) allows.

    The sample holds at most ``conf.max_docs_per_class`` documents of each class, those with the smallest
    hash of their id, and stops at ``conf.max_chars`` characters; texts enter whole. Rows with a null id
    or label are not learned from. An id that is labelled twice counts by its smallest label.
    """
    known = labels.filter(usable & F.col("doc_id").isNotNull() & F.col(target).isNotNull())
    known = known.groupBy("doc_id").agg(F.min(target).cast("int").alias("_label"))
    classes = [r[0] for r in known.select("_label").distinct().orderBy("_label").limit(64).collect()]
    mix = F.xxhash64(F.col("doc_id"), F.lit(conf.seed))
    chosen = None
    for c in classes:
        part = known.filter(F.col("_label") == c).orderBy(mix, "doc_id").limit(conf.max_docs_per_class)
        chosen = part if chosen is None else chosen.unionByName(part)
    texts: list[str | None] = []
    y: list[int] = []
    if chosen is not None:
        rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("doc_id", "_label", "text")
        room = conf.max_chars
        # One row per id (repeated ids keep their smallest text), in hash order, streamed until the room is used up.
        rows = rows.groupBy("doc_id", "_label").agg(F.min("text").alias("text"))
        for row in rows.orderBy(mix, "doc_id").toLocalIterator():
            room -= len(row["text"] or "")
            if room < 0 and len(set(y)) == len(classes):
                break
            texts.append(row["text"])
            y.append(row["_label"])
    return train(texts, y, conf)


def score(docs: DataFrame, model: Model, name: str = "score") -> DataFrame:
    """All columns of ``docs`` and the probability of class 1, from whole texts; a null text counts as empty.

    A map over Arrow batches without a shuffle; the model (buckets x classes numbers) travels with the task.
    A column of ``docs`` called like the score is replaced.
    """
    docs = docs.drop(name)
    one = model.classes.index(1) if 1 in model.classes else None
    logits = docs.sparkSession.sparkContext.broadcast(model.logits)
    conf, classes, bias = model.conf, model.classes, model.bias

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Model(conf, classes, logits.value, bias)
        for batch in batches:
            texts = batch.column("text").to_pylist()
            p = own.probabilities(texts)[:, one] if one is not None else [0.0] * len(texts)
            yield batch.append_column(name, pa.array(p, pa.float64()))

    schema = fields(docs).add(name, "double")
    return docs.mapInArrow(work, schema)
