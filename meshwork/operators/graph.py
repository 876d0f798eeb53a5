"""Edge tables: symmetric and mutual forms, budgets, self-loops, shared entities."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.cleaning import null_like
from .ranking import ranked


@dataclass(frozen=True)
class Graph:
    """nodes(id) and edges(src, dst, ...); isolated nodes are in nodes alone."""

    nodes: DataFrame
    edges: DataFrame


def reversed_edges(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), *(c for c in edges.columns if c not in ("src", "dst")))


def symmetrized(edges: DataFrame) -> DataFrame:
    """Edges and their reverses; where both exist, each keeps its own score."""
    both = edges.withColumn("_turn", F.lit(0)).unionByName(reversed_edges(edges).withColumn("_turn", F.lit(1)))
    return both.groupBy("src", "dst").agg(F.min_by("score", F.struct("_turn", -F.col("score"))).alias("score"))


def mutual(edges: DataFrame) -> DataFrame:
    """Edges whose reverse exists, with their own scores."""
    return edges.join(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")), ["src", "dst"], "left_semi")


def strongest(edges: DataFrame, most: int) -> DataFrame:
    """The best edges of all by score, then src, then dst."""
    return edges.orderBy(F.desc("score"), "src", "dst").limit(most)


def edge_budget(nodes: int, degree: float, directed: bool = True) -> int:
    return int(nodes * degree) if directed else int(nodes * degree / 2)


def pruned(edges: DataFrame, most: int) -> DataFrame:
    """All edges where there are at most ``most``, else the strongest."""
    return strongest(edges, most)


def adjacency(edges: DataFrame, weight: str = "score", order: str | None = None) -> DataFrame:
    """One edge a pair; of repeated ones the first by ``order`` stays, or where rows have no order the heaviest."""
    first = F.max(weight) if order is None else F.min_by(weight, F.struct(order, -F.col(weight)))
    return edges.groupBy("src", "dst").agg(first.alias(weight))


def directedness(edges: DataFrame, mode: str) -> DataFrame:
    """directed: as it is; sym, mutual: pairs without weights."""
    pairs = edges.select("src", "dst")
    if mode == "directed":
        return edges
    if mode == "sym":
        return pairs.unionByName(reversed_edges(pairs)).distinct()
    if mode == "mutual":
        return pairs.intersect(reversed_edges(pairs))
    raise ValueError(f"unknown directedness {mode!r}")


def isolated(graph: Graph) -> DataFrame:
    """Nodes that no edge touches; a self-loop does."""
    touched = graph.edges.select(F.col("src").alias("id")).unionByName(graph.edges.select(F.col("dst").alias("id")))
    return graph.nodes.select("id").join(touched, "id", "left_anti")


def self_loops(graph: Graph, policy: str) -> DataFrame:
    """none, all, or isolated_only; pairs without weights where loops are added."""
    if policy == "none":
        return graph.edges
    pairs = graph.edges.select("src", "dst")
    if policy not in ("all", "isolated_only"):
        raise ValueError(f"unknown self-loop policy {policy!r}")
    looped = graph.nodes if policy == "all" else isolated(graph)
    return pairs.unionByName(looped.select(F.col("id").alias("src"), F.col("id").alias("dst"))).distinct()


def shared_entity_ring(df: DataFrame, key: str, entities: list[str], cap: int) -> DataFrame:
    """(src, dst, entity_column): each row to the next ``cap`` rows of its entity, in a ring by key.

    A group of L rows gives at most L * cap edges, never L * L.  Null-like
    values are no entity; columns that do not exist are skipped.
    """
    there = [c for c in entities if c in df.columns]
    long = df.select(F.col(key).cast("long").alias("id"), F.inline(F.array(*(F.struct(F.lit(c).alias("entity_column"), null_like(F.col(c)).alias("value")) for c in there)))).where("value is not null")
    placed = ranked(long, ["entity_column", "value"], F.floor(F.col("id") / 4096), [F.col("id")], "pos", "size").where("size > 1")
    steps = F.explode(F.sequence(F.lit(1).cast("long"), F.least(F.lit(cap).cast("long"), F.col("size") - 1)))
    ahead = placed.select("entity_column", "value", F.col("id").alias("src"), "pos", "size", steps.alias("step"))
    ahead = ahead.withColumn("pos", F.pmod(F.col("pos") - 1 + F.col("step"), F.col("size")) + 1)
    target = placed.select("entity_column", "value", "pos", F.col("id").alias("dst"))
    return ahead.join(target, ["entity_column", "value", "pos"]).select("src", "dst", "entity_column")


def similarity_id(k: int, metric: str, pca: int | None, scope: str) -> str:
    return f"base_sim_knn_k{k}_{metric}_{f'pca{pca}' if pca else 'nopca'}_{scope}"


def sweep_id(prefix: str, method: str, budget: int, pca: int) -> str:
    return f"{prefix}_{method}_d{budget}_pca{pca}"


#: The quick preset of a graph grid.
QUICK_GRID = {"graph_scope": "train_only", "ks": (8, 16, 32), "directedness": "directed", "self_loops": "none", "metric": "cosine", "pca_dim": 64}

#: Entity columns by dataset.
ENTITIES = {
    "kdd": ("protocol_type", "service", "flag"),
    "unsw-nb15": ("proto", "service", "state"),
    "ton-iot": ("src_ip", "dst_ip", "src_port", "dst_port", "proto", "service"),
}
