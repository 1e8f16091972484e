"""Connected components of an edge table, by contraction: no driver-side graph.

Each round hooks every vertex to its smallest neighbour, flattens the resulting
trees by pointer jumping, and contracts the edges onto the roots. A round removes
every vertex that has a smaller neighbour, so rounds grow with the logarithm of
the longest path. Every round starts from tables in the shared scratch folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import materialize


def _flatten(parent: DataFrame, name: str) -> DataFrame:
    """``parent`` (v, p) with p < v or p = v, until every p is a root."""
    while True:
        up = parent.select(F.col("v").alias("p"), F.col("p").alias("q"))
        parent = materialize(
            parent.join(up, "p", "left").select("v", F.coalesce("q", "p").alias("p"), (F.coalesce("q", "p") != F.col("p")).alias("moved")),
            name,
        )
        if parent.where("moved").limit(1).isEmpty():
            return parent.select("v", "p")
        parent = parent.select("v", "p")


def connected_components(edges: DataFrame, name: str = "cc") -> DataFrame:
    """``edges`` (a, b) of longs -> (v, component), component the least vertex reachable.

    Only vertices that occur in an edge are returned; null ends, loops and repeats
    are ignored; an empty edge table gives an empty result.
    """
    edges = materialize(
        edges.where("a IS NOT NULL AND b IS NOT NULL AND a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(),
        f"{name}-e",
    )
    labels = None
    while not edges.limit(1).isEmpty():
        hook = edges.groupBy(F.col("b").alias("v")).agg(F.min("a").alias("p"))
        roots = edges.select(F.col("a").alias("v")).distinct().join(hook.select("v"), "v", "left_anti").select("v", F.col("v").alias("p"))
        tree = _flatten(materialize(hook.unionByName(roots), f"{name}-p"), f"{name}-p")
        if labels is None:
            labels = tree.select("v", F.col("p").alias("component"))
        else:
            step = tree.select(F.col("v").alias("component"), F.col("p").alias("next"))
            labels = materialize(labels.join(step, "component", "left").select("v", F.coalesce("next", "component").alias("component")), f"{name}-l")
        left = tree.select(F.col("v").alias("a"), F.col("p").alias("pa"))
        right = tree.select(F.col("v").alias("b"), F.col("p").alias("pb"))
        edges = materialize(
            edges.join(left, "a").join(right, "b").where("pa <> pb").select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b")).distinct(),
            f"{name}-e",
        )
    if labels is None:
        labels = edges.select(F.col("a").alias("v"), F.col("b").alias("component"))
    return labels
