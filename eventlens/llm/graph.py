"""Connected components of a graph of longs, by contraction, as joins and minima over written tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventlens.llm.common import written


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """(node, root): for each end of the edges (a, b), the smallest node that can be reached from it.

    In a round every node moves to its smallest neighbour, if that is smaller, and on to where this one moves; the
    edges between the places reached are the next round's graph, which is smaller: a star or a group of copies is gone after
    a round, a chain shrinks to a quarter or less. Both sides of each join are read from the shared folder: a node of very many
    edges is a skewed join, which Spark splits; minima combine before they are shuffled.
    """
    rest = written(_between(edges.select("a", "b")), f"{name}-edges")
    labels = None
    while not rest.isEmpty():
        both = rest.unionByName(rest.select(F.col("b").alias("a"), F.col("a").alias("b")))
        moved = both.groupBy(F.col("a").alias("node")).agg(F.least(F.first("a"), F.min("b")).alias("to"))
        moved = written(moved, f"{name}-moved")
        for _ in range(2):
            onward = moved.select(F.col("node").alias("to"), F.col("to").alias("_on"))
            moved = written(moved.join(onward, "to").select("node", F.col("_on").alias("to")), f"{name}-moved")
        if labels is None:
            labels = moved.withColumnRenamed("to", "root")
        else:
            further = moved.select(F.col("node").alias("root"), F.col("to").alias("_on"))
            labels = labels.join(further, "root", "left").select("node", F.coalesce("_on", "root").alias("root"))
            labels = written(labels, f"{name}-labels")
        ends = [moved.select(F.col("node").alias(c), F.col("to").alias(f"_{c}")) for c in ("a", "b")]
        placed = rest.join(ends[0], "a").join(ends[1], "b")
        rest = written(_between(placed.select(F.col("_a").alias("a"), F.col("_b").alias("b"))), f"{name}-edges")
    if labels is None:
        return rest.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return labels


def _between(edges: DataFrame) -> DataFrame:
    """Edges of different ends, each once."""
    return edges.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
