"""Quality classifier: supervised subword embeddings, see ``subword``.

Learned vectors of hashed words, word pairs and character n-grams, averaged per document, go into a
softmax trained by numpy stochastic gradient descent.

Defined results: a null or empty text is scored by the model's bias; without labelled rows of class 1
every score is 0, and with no other class it is 1; equal texts score alike; rows and further columns
(also ones named like those of ``labels``) are kept as they are, repeated rows included.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventlens.llm import classify
from eventlens.llm.subword import Subwords


@dataclass(frozen=True)
class Quality:
    """Every ``folds``-th document by crc32 of its id is held out of training."""

    folds: int = 5
    held: int = 0
    threshold: float = 0.3
    model: Subwords = field(default_factory=lambda: Subwords(rest=50, max_docs_per_class=3000))


def held_out(conf: Quality) -> Column:
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % conf.folds == conf.held


def quality_scores(docs: DataFrame, labels: DataFrame, conf: Quality = Quality()) -> DataFrame:
    """``docs`` with ``score`` (likelihood of label 1), ``held_out`` and ``predicted`` (1: keep)."""
    model = classify.fit(docs, labels, "quality", ~held_out(conf), conf.model)
    scored = classify.score(docs, model)
    return scored.withColumns({
        "held_out": F.coalesce(held_out(conf), F.lit(False)),
        "predicted": (F.col("score") >= conf.threshold).cast("int"),
    })
