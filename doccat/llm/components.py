"""Connected components of an edge table by repeated hooking and contraction.

Every round hooks each node onto its smallest neighbour, shortens the paths, renames the edges by
their roots and drops loops; at least half of the nodes that still have edges disappear, so the
rounds are logarithmic in the number of nodes.  All state is tables in the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from doccat.llm.common import materialize


def _renamed(labels: DataFrame, hooks: DataFrame) -> DataFrame:
    """``labels`` (node, root) with every root replaced by its own root in ``hooks``."""
    up = hooks.select(F.col("node").alias("_n"), F.col("root").alias("_r"))
    return labels.join(up, labels["root"] == up["_n"], "left").select("node", F.coalesce("_r", "root").alias("root"))


def connected_components(edges: DataFrame) -> DataFrame:
    """``node, root`` for every node of ``edges`` (columns a, b of one ordered type); the root is the
    smallest node of the component.  Loops, repeated edges and an empty table are fine."""
    edges = materialize(edges.select("a", "b").filter("a <> b").distinct(), "edges")
    rounds: list[DataFrame] = []
    while not edges.isEmpty():
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        hooks = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("root"))
        hooks = materialize(_renamed(_renamed(hooks, hooks), hooks), "hooks")
        rounds.append(hooks)
        left = hooks.select(F.col("node").alias("a"), F.col("root").alias("ra"))
        right = hooks.select(F.col("node").alias("b"), F.col("root").alias("rb"))
        edges = materialize(edges.join(left, "a").join(right, "b").filter("ra <> rb").select(
            F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct(), "edges")
    if not rounds:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    labels = rounds[0]
    for hooks in rounds[1:]:
        labels = _renamed(labels, hooks)
    return materialize(labels, "labels") if len(rounds) > 1 else labels
