"""Toxicity: bags of subword vectors averaged into a linear softmax, see ``subword``.

Words and their character n-grams are hashed into one table of vectors, which is trained jointly with
the softmax in numpy; a misspelling that training never saw shares most of its n-grams, and so its
vectors, with the word it stands for. Case is ignored for ASCII letters.

Defined results: as for ``quality``: a null or empty text is scored by the bias; without labelled toxic
rows every score is 0; equal texts score alike; all rows and further columns are kept.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventlens.llm import classify
from eventlens.llm.subword import Subwords


@dataclass(frozen=True)
class Toxicity:
    """Documents whose crc32 of the id leaves ``held`` modulo ``folds`` are held out of training."""

    folds: int = 3
    held: int = 1
    threshold: float = 0.7
    model: Subwords = field(default_factory=lambda: Subwords(lower=True, epochs=6, rest=100, max_docs_per_class=4000))


def held_out(conf: Toxicity) -> Column:
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % conf.folds == conf.held


def toxicity_scores(docs: DataFrame, labels: DataFrame, conf: Toxicity = Toxicity()) -> DataFrame:
    """``docs`` with ``score`` (likelihood of being toxic), ``held_out`` and ``predicted`` (1: toxic)."""
    model = classify.fit(docs, labels, "toxic", ~held_out(conf), conf.model)
    scored = classify.score(docs, model)
    return scored.withColumns({
        "held_out": F.coalesce(held_out(conf), F.lit(False)),
        "predicted": (F.col("score") >= conf.threshold).cast("int"),
    })
