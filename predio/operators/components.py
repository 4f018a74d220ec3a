"""Connected components of an undirected graph by repeated contraction.

Each round every node hooks to its smallest neighbour if that is smaller, the hooks are
followed to their ends by pointer jumping, and the graph is contracted to the ends.
Node numbers are mixed first, so that neighbours in space do not form long chains.  All
steps are joins and minima; each round's tables are settled in the shared folder.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from predio.scale import settle


def _mix(node: str) -> Column:
    """An invertible scrambling of a 64-bit number (one xorshift step)."""
    x = F.col(node).cast("bigint")
    x = x.bitwiseXOR(F.shiftleft(x, 13))
    x = x.bitwiseXOR(F.shiftrightunsigned(x, 7))
    return x.bitwiseXOR(F.shiftleft(x, 17))


def _follow(parents: DataFrame) -> DataFrame:
    """Replace every node's parent by the end of its chain of parents."""
    while True:
        jumped = settle(
            parents.join(parents.toDF("parent", "_up"), "parent")
            .join(parents.toDF("_up", "_end"), "_up")
            .select("node", F.col("_end").alias("parent"), (F.col("_end") != F.col("_up")).alias("_more")),
            "parents",
        )
        parents = jumped.drop("_more")
        if jumped.filter("_more").isEmpty():
            return parents


def connected_components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``(node, component)``: equal components are connected by ``(a, b)`` edges."""
    labels = nodes.select("node", _mix("node").alias("component"))
    graph = settle(
        edges.filter("a != b").select(_mix("a").alias("a"), _mix("b").alias("b")).distinct(), "graph"
    )
    while not graph.isEmpty():
        both = graph.unionByName(graph.select(F.col("b").alias("a"), F.col("a").alias("b")))
        hooks = both.groupBy(F.col("a").alias("node")).agg(
            F.least(F.min("b"), F.first("a")).alias("parent")
        )
        parents = _follow(settle(hooks, "hooks"))
        labels = settle(
            labels.join(parents.toDF("component", "_root"), "component", "left").select(
                "node", F.coalesce("_root", "component").alias("component")
            ),
            "labels",
        )
        ends = graph.join(parents.toDF("a", "_ra"), "a").join(parents.toDF("b", "_rb"), "b")
        graph = settle(
            ends.filter("_ra != _rb")
            .select(F.least("_ra", "_rb").alias("a"), F.greatest("_ra", "_rb").alias("b"))
            .distinct(),
            "graph",
        )
    return labels
