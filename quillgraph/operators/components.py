"""Connected components as a loop of DataFrames."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import saved


def components(edges: DataFrame, *, src: str = "a", dst: str = "b", by: Sequence[str] = ()) -> DataFrame:
    """(*by, node, component): the smallest node reachable over undirected edges, for every node on an edge.

    by names columns that keep graphs apart, such as doc_id. Minimum labels spread along
    edges, then each label jumps to its label's label, so a path of n nodes takes O(log n)
    rounds. Every round ends in the shared folder, which also cuts the lineage.
    """
    by = list(by)
    both = edges.select(*by, F.col(src).alias("u"), F.col(dst).alias("v")).union(edges.select(*by, F.col(dst), F.col(src))).distinct()
    both = saved(both, "cc-edges")
    labels = saved(both.groupBy(*by, "u").agg(F.min("v").alias("m")).select(*by, F.col("u").alias("node"), F.least("u", "m").alias("component")), "cc-labels")
    while True:
        near = both.join(labels.withColumnRenamed("node", "v"), [*by, "v"]).groupBy(*by, "u").agg(F.min("component").alias("m"))
        step = labels.join(near.withColumnRenamed("u", "node"), [*by, "node"]).select(*by, "node", F.least("component", "m").alias("l"), F.col("component").alias("was"))
        hop = step.select(*by, F.col("node").alias("l"), F.col("l").alias("ll"))
        new = saved(step.join(hop, [*by, "l"]).select(*by, "node", F.col("ll").alias("component"), "was"), "cc-labels")
        changed = new.filter("component <> was").limit(1).count()
        labels = new.select(*by, "node", "component")
        if not changed:
            return labels
