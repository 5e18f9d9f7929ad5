"""Connected components by hooking and contraction, on tables in the shared folder."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillveil.session import materialize


def _flatten(parents: DataFrame) -> DataFrame:
    """Parents (a, p) with p < a, each p replaced by the root of its tree: pointer jumping, so rounds are the logarithm of the depth."""
    while True:
        up = parents.select(F.col("a").alias("p"), F.col("p").alias("_up"))
        jumped = materialize(parents.join(up, "p", "left").select("a", F.coalesce("_up", "p").alias("p"), F.col("_up").isNotNull().alias("_moved")), "cc-jump")
        parents = jumped.select("a", "p")
        if jumped.filter("_moved").isEmpty():
            return parents


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for every node of an edge; the component is its smallest node.

    Every node with a smaller neighbour hooks to the smallest one (an aggregate
    that is combined before its shuffle), trees are flattened, and edges are
    contracted to roots until none is left. Joins read written tables, so
    adaptive execution can split a hub's rows.
    """
    pairs = edges.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).filter("a > b").distinct()
    pairs = materialize(pairs, "cc-edges")
    maps: list[DataFrame] = []
    while not pairs.isEmpty():
        parents = _flatten(materialize(pairs.groupBy("a").agg(F.min("b").alias("p")), "cc-hook"))
        maps.append(parents)
        other = parents.select(F.col("a").alias("b"), F.col("p").alias("_pb"))
        moved = pairs.join(parents, "a").join(other, "b", "left").select(F.col("p").alias("x"), F.coalesce("_pb", "b").alias("y"))
        pairs = materialize(moved.filter("x != y").select(F.greatest("x", "y").alias("a"), F.least("x", "y").alias("b")).distinct(), "cc-edges")
    if not maps:
        return pairs.select(F.col("a").alias("node"), F.col("b").alias("component"))

    def then(labels: DataFrame, step: DataFrame) -> DataFrame:
        up = step.select(F.col("a").alias("p"), F.col("p").alias("_up"))
        return labels.join(up, "p", "left").select("a", F.coalesce("_up", "p").alias("p")).unionByName(step)

    labels = reduce(then, maps)
    roots = labels.select(F.col("p").alias("a"), "p").distinct()
    return materialize(labels.unionByName(roots).select(F.col("a").alias("node"), F.col("p").alias("component")), "cc-labels")
