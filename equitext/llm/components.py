"""Connected components of an edge table, as joins and aggregates.

Each round gives every vertex the smallest label among its own and its
neighbours' labels, then follows the label once (pointer jumping), so chains
halve from round to round.  Labels of a round are written to the shared
checkpoint folder: lineage stays one round long and both sides of every join
are plain exchanges, which adaptive execution splits when one vertex (a hub)
has many edges.  Only one count per round reaches the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from equitext.llm.util import saved


def connected(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) for every vertex that occurs in ``edges``; root is the
    smallest vertex of its component.  Self-loops and repeated edges are
    harmless; an edge with a NULL end is ignored; no edges: an empty result.
    """
    ends = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).dropna()
    both = saved(ends.union(ends.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct(), "cc-edges")
    labels = saved(both.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("m"))
                   .select("node", F.least("node", "m").alias("root")), "cc-labels")
    while True:
        nearest = (
            both.join(labels, F.col("u") == F.col("node"))
            .groupBy("v").agg(F.min("root").alias("near"))
        )
        hooked = saved(
            labels.join(nearest, F.col("node") == F.col("v"), "left")
            .select("node", F.least("root", F.coalesce("near", "root")).alias("root"),
                    F.col("root").alias("before")), "cc-hooked")
        parent = hooked.select(F.col("node").alias("p"), F.col("root").alias("up"))
        jumped = saved(
            hooked.join(parent, F.col("root") == F.col("p"), "left")
            .select("node", F.least("root", F.coalesce("up", "root")).alias("root"), "before"),
            "cc-labels")
        labels = jumped.select("node", "root")
        if jumped.filter(F.col("root") != F.col("before")).limit(1).count() == 0:
            return labels
