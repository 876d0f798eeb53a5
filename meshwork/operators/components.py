"""Connected components by alternating large and small stars.

Each round hangs every node's larger neighbours, then its smaller ones, on the
smallest of them.  Edges never multiply, and the table ends as stars around
each component's smallest node.  Every round is a stored table, and a round's
table goes when the next is there.

The join of a round brings a node's least neighbour to all of the node's
edges.  The least neighbour itself is a partial aggregation.  Nodes with more
than a thousandth of the edges are two thousand at most, so their least
neighbours are broadcast, and no task meets such a node's edges together.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from ..sources.shared import discard, stored

Store = Callable[[DataFrame, str], DataFrame]

#: Edges of a table from which on hot nodes are looked for, and the share of them that makes a node hot.
MANY_EDGES, HOT_SHARE = 1_000_000, 1000


def _with_least(table: DataFrame, least: DataFrame, rows: int) -> DataFrame:
    """``table`` (node, near) with the node's ``least``; rows: of the table, at most."""
    if rows < MANY_EDGES:
        return table.join(least.drop("n"), "node")
    hot = F.broadcast(least.where(F.col("n") > rows // HOT_SHARE).select("node", F.col("least").alias("hot")))
    marked = table.join(hot, "node", "left")
    cold = marked.where("hot is null").drop("hot").join(least.drop("n"), "node")
    return marked.where("hot is not null").withColumnRenamed("hot", "least").unionByName(cold)


def _hang(edges: DataFrame, larger: bool, count: int) -> DataFrame:
    """One star operation on ``count`` edges (a, b) with b < a."""
    down = edges.select(F.col("a").alias("node"), F.col("b").alias("near"))
    table = down.unionByName(edges.select(F.col("b").alias("node"), F.col("a").alias("near"))) if larger else down
    least = table.groupBy("node").agg(F.min("near").alias("least"), F.count(F.lit(1)).alias("n")).select("node", F.least("node", "least").alias("least"), "n")
    met = _with_least(table, least, 2 * count)
    if larger:
        hung = met.where("near > node").select(F.col("near").alias("a"), F.col("least").alias("b"))
    else:
        hung = met.select(F.col("near").alias("a"), F.col("least").alias("b")).unionByName(least.select(F.col("node").alias("a"), F.col("least").alias("b")))
    return hung.where("a <> b")


def _mark(edges: DataFrame) -> Row:
    """Tells an edge table from another: its count and two sums over the edges."""
    return edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b")), F.sum(F.col("b").cast("decimal(38,0)"))).first()


def stars(edges: DataFrame, a: str, b: str, store: Store = stored) -> DataFrame:
    """(a, b): every node that an edge touches, but for the smallest of its component, and that one.

    Self-loops and nulls are no edges; repeated and reversed edges are one.
    """
    found = store(edges.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).where("a <> b").distinct(), "stars")
    seen, now = None, _mark(found)
    while now != seen and now[0]:
        last = found
        found = store(_hang(_hang(last, True, now[0]), False, now[0]).distinct(), "stars")
        discard(last)
        seen, now = now, _mark(found)
    return found


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, component) of every node; component: the smallest id that edges reach, in either direction."""
    found = stars(edges, "src", "dst").select(F.col("a").alias("id"), F.col("b").alias("root"))
    return nodes.select("id").join(found, "id", "left").select("id", F.coalesce("root", "id").alias("component"))
