"""Exact links inside candidate components, by pairs of blocks.

A component is cut into blocks of rows by hash, and every two blocks (and each with itself) are one group, so that
no group holds a whole large component and each pair of rows is compared once. A group puts out, for each row, how
many it is linked to, and a spanning forest of the links: no pairs. Small components are one block.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventlens.llm.candidates import forest
from eventlens.llm.common import runs, written

#: Rows of a block: at least, at most, and the number of blocks that a component is cut into between those.
LEAST, MOST, BLOCKS = 64, 1024, 40


def links(members: DataFrame, linked: Callable[[pa.Table], np.ndarray], name: str) -> DataFrame:
    """(node, links, forest): how many rows the node is linked to, and the smallest node of each block's tree that it is in.

    ``members``: component, node (long), copies (long) and what ``linked`` needs; it is told the rows of a group and
    returns a symmetric boolean matrix. A link to a node counts as often as the node has copies.
    """
    sizes = written(members.groupBy("component").agg(F.count(F.lit(1)).alias("_n")), f"{name}-sizes")
    sized = members.join(sizes, "component").filter("_n > 1")
    size = F.least(F.greatest(F.ceil(F.col("_n") / BLOCKS), F.lit(LEAST)), F.lit(MOST))
    sized = sized.withColumn("_m", F.ceil(F.col("_n") / size).cast("int")).drop("_n")
    sized = sized.withColumn("_own", F.pmod(F.xxhash64("node"), F.col("_m")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("_m") - 1))
    dealt = sized.select("*", other.alias("_other"))
    dealt = dealt.select(
        *[c for c in members.columns], "_own",
        F.least("_own", "_other").alias("_low"), F.greatest("_own", "_other").alias("_high"),
    )
    key = ["component", "_low", "_high"]
    dealt = dealt.repartition(*key).sortWithinPartitions(*key, "node")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        for group in runs(batches, key):
            if group.num_rows < 2:
                continue
            block = group.column("_own").to_numpy()
            met = linked(group)
            np.fill_diagonal(met, False)
            if group.column("_low")[0] != group.column("_high")[0]:
                met = met & (block[:, None] != block[None, :])
            node, copies = group.column("node").to_numpy(), group.column("copies").to_numpy()
            first = forest(met)
            has = np.flatnonzero(met.any(axis=1))
            out.append((node[has], (met @ copies)[has], node[first[has]]))
            if sum(len(o[0]) for o in out) > 10_000:
                yield _rows(out)
                out = []
        yield _rows(out)

    return written(dealt.mapInArrow(work, "node long, links long, forest long"), name)


def _rows(out: list[tuple]) -> pa.RecordBatch:
    columns = [np.concatenate([np.zeros(0, np.int64), *[o[k] for o in out]]).astype(np.int64) for k in range(3)]
    return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["node", "links", "forest"])
