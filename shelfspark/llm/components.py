"""Connected components: by contraction while the links are many, then in one task of bounded size.

In each round of contraction every node points to the neighbour (or itself) with the smallest hash, the hash changing
by round; the pointed-at nodes stay, links between them are made distinct, and the labels are rewritten.  A constant
share of the nodes goes in each round, whatever the shape of the component, so the rounds are logarithmic.  No list of
a node's neighbours is ever gathered, and each round is written to the shared folder.  Once TASK_LINKS links or fewer
are left, which is counted first, one task joins them: a fixed bound, whatever the table's size.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfspark.llm.storage import cut
from shelfspark.llm.text_arrays import forest

TASK_LINKS = 250_000


def _join(batches):
    ends = [(np.empty(0, np.int64), np.empty(0, np.int64))] + [tuple(b.column(c).to_numpy().astype(np.int64) for c in ("a", "b")) for b in batches]
    a, b = (np.concatenate(x) for x in zip(*ends, strict=True))
    nodes, number = np.unique(np.concatenate([a, b]), return_inverse=True)
    label = forest(len(nodes), number[: len(a)], number[len(a) :])
    yield pa.RecordBatch.from_pydict({"node": nodes, "component": nodes[label]})


def _contract(links: DataFrame, labels: DataFrame, turn: int) -> tuple[DataFrame, DataFrame]:
    weigh = lambda c: F.xxhash64(F.lit(turn), c)
    both = links.union(links.select("b", "a"))
    near = both.groupBy("a").agg(F.min(weigh(F.col("b"))).alias("w"))
    # the neighbour with that weight; a tie of two 64-bit hashes is settled by the smaller node
    near = both.join(near, "a").where(weigh(F.col("b")) == F.col("w")).groupBy("a").agg(F.min("b").alias("b"), F.min("w").alias("w"))
    up = cut(near.select(F.col("a").alias("node"), F.when(F.col("w") < weigh(F.col("a")), F.col("b")).otherwise(F.col("a")).alias("up")))
    labels = labels.join(up.select(F.col("node").alias("component"), "up"), "component", "left")
    labels = cut(labels.select("node", F.coalesce("up", "component").alias("component")))
    ends = lambda side: up.select(F.col("node").alias(side), F.col("up").alias(f"{side}_up"))
    raised = links.join(ends("a"), "a").join(ends("b"), "b").select(F.col("a_up").alias("a"), F.col("b_up").alias("b"))
    return cut(raised.where(F.col("a") != F.col("b")).distinct()), labels


def components(links: DataFrame, task_links: int = TASK_LINKS) -> DataFrame:
    """``links`` (a, b: long) to (node, component); component is a node of it. Only nodes with a link are returned."""
    links = cut(links.where(F.col("a") != F.col("b")).select("a", "b"))
    labels, turn = None, 0
    while links.count() > task_links:
        if labels is None:
            labels = cut(links.select(F.col("a").alias("node")).union(links.select("b")).distinct().withColumn("component", F.col("node")))
        turn += 1
        links, labels = _contract(links, labels, turn)
    joined = cut(links.coalesce(1).mapInArrow(_join, "node long, component long"))
    if labels is None:
        return joined
    joined = joined.select(F.col("node").alias("component"), F.col("component").alias("up"))
    return cut(labels.join(joined, "component", "left").select("node", F.coalesce("up", "component").alias("component")))
