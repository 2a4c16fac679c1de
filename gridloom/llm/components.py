"""Connected components of an edge table, by contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import materialize


def components(edges: DataFrame, label: str = "components") -> DataFrame:
    """``node, label``: nodes of one component share a label, which is one of them.

    ``edges``: columns ``a`` and ``b``. A round gives each node the least of its
    neighbours and itself, then contracts the edges to labels. Nodes are hashes or
    ids in no particular order, so a constant share of the labels goes each round
    and the rounds are logarithmic in the component's size, a star takes one. Every
    round is written to the shared folder, so lost executors cost one round at most.
    A node of many edges is no hot spot: the minimum is aggregated before the
    shuffle, and the joins can be split where a key is skewed.
    """
    pairs = materialize(edges.select("a", "b").where("a <> b").distinct(), f"{label}-edges")
    labels = None
    while not pairs.isEmpty():
        both = pairs.select("a", "b").union(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
        step = materialize(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("node")).alias("to")), f"{label}-step")
        if labels is None:
            labels = step.select("node", F.col("to").alias("label"))
        else:
            moved = step.select(F.col("node").alias("label"), "to")
            labels = materialize(labels.join(moved, "label", "left").select("node", F.coalesce("to", "label").alias("label")), f"{label}-labels")
        first = pairs.join(step.select(F.col("node").alias("a"), F.col("to").alias("la")), "a")
        second = first.join(step.select(F.col("node").alias("b"), F.col("to").alias("lb")), "b")
        pairs = materialize(second.where("la <> lb").select(F.least("la", "lb").alias("a"), F.greatest("la", "lb").alias("b")).distinct(), f"{label}-edges")
    if labels is None:
        return pairs.select(F.col("a").alias("node"), F.col("b").alias("label"))
    return labels
