"""Connected components of a graph that lives in DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meritgraph.llm.common import checkpointed, gathered, packed


#: Labels are broadcast up to this many nodes (16 MB), beyond it they are joined by shuffle.
BROADCAST_NODES = 500_000


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every end of ``edges`` (a, b): the least node that can be reached. Nulls are no nodes.

    Labels spread to neighbours and then jump to the label of their label, so the rounds grow with the logarithm of
    the longest path; a round is one aggregation with partial sums, and hot nodes are split like any skewed join.
    Labels only ever sink, so a round that leaves their sum as it was is the last. Partitions follow the number of rows,
    so that rounds over a few links don't pay for each of the session's shuffle partitions.
    """
    both = edges.where("a IS NOT NULL AND b IS NOT NULL AND a <> b")
    both = packed(both.select(F.col("a").alias("node"), F.col("b").alias("other")).union(both.select("b", "a")).distinct())
    labels = packed(both.groupBy("node").agg(F.min("other").alias("m")).select("node", F.least("node", "m").alias("component")))
    held = lambda x: x.agg(F.sum(F.col("component").cast("decimal(38,0)")), F.count(F.lit(1))).first()
    before, n = held(labels)
    few = F.broadcast if n <= BROADCAST_NODES else lambda x: x
    while n:
        heard = both.join(few(labels.withColumnRenamed("node", "other")), "other").select("node", "component")
        spread = labels.union(heard).groupBy("node").agg(F.min("component").alias("component"))
        jump = labels.select(F.col("node").alias("j"), F.col("component").alias("jumped"))
        labels = gathered(checkpointed(spread.join(few(jump), F.col("component") == F.col("j"), "left").select("node", F.least("component", "jumped").alias("component"))), n)
        after, _ = held(labels)
        if after == before:
            break
        before = after
    return labels
