"""Graph measures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import components
from .graph import Graph, isolated, reversed_edges


def degrees(graph: Graph) -> DataFrame:
    """id, out_degree, in_degree; nodes without edges have zeros."""
    out = graph.edges.groupBy(F.col("src").alias("id")).agg(F.count(F.lit(1)).alias("o"))
    into = graph.edges.groupBy(F.col("dst").alias("id")).agg(F.count(F.lit(1)).alias("i"))
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long"))
    return graph.nodes.select("id").join(out, "id", "left").join(into, "id", "left").select("id", zero("o").alias("out_degree"), zero("i").alias("in_degree"))


def undirected(edges: DataFrame) -> DataFrame:
    pairs = edges.select("src", "dst")
    return pairs.unionByName(reversed_edges(pairs)).distinct()


def undirected_degrees(graph: Graph) -> DataFrame:
    """id, undirected_degree and deg_u, which counts both ends of the doubled edges."""
    both = undirected(graph.edges)
    ends = both.groupBy(F.col("src").alias("id")).agg(F.count(F.lit(1)).alias("d"))
    zero = F.coalesce(F.col("d"), F.lit(0).cast("long"))
    return graph.nodes.select("id").join(ends, "id", "left").select("id", zero.alias("undirected_degree"), (2 * zero).alias("deg_u"))


def degree_stats(graph: Graph) -> DataFrame:
    """One row: least, median, 95th percentile and largest of deg_u and of the undirected degree."""
    d = undirected_degrees(graph)
    fields = lambda c, p: [F.min(c).alias(f"{p}min"), F.median(c).alias(f"{p}median"), F.round(F.percentile(c, 0.95), 6).alias(f"{p}p95"), F.max(c).alias(f"{p}max")]
    return d.agg(*fields("deg_u", "degree_"), *fields("undirected_degree", "undirected_degree_"))


def _share(part: Column, whole: Column) -> Column:
    return F.round(part / F.greatest(whole, F.lit(1)), 6)


def density_reciprocity(graph: Graph) -> DataFrame:
    """One row: num_nodes, num_edges, density, reciprocity, mean degrees."""
    pairs = graph.edges.select("src", "dst").distinct()
    back = pairs.join(reversed_edges(pairs), ["src", "dst"], "left_semi").agg(F.count(F.lit(1)).alias("answered"))
    n, e = graph.nodes.agg(F.count(F.lit(1)).alias("num_nodes")), graph.edges.agg(F.count(F.lit(1)).alias("num_edges"))
    one = n.join(F.broadcast(e)).join(F.broadcast(back))
    nodes, edges = F.col("num_nodes"), F.col("num_edges")
    mean = F.round(F.when(nodes == 0, 0.0).otherwise(edges / nodes), 6)
    return one.select("num_nodes", "num_edges", _share(edges, nodes * (nodes - 1)).alias("density"), _share(F.col("answered"), edges).alias("reciprocity"), mean.alias("mean_out_degree"), mean.alias("mean_in_degree"), mean.alias("achieved_avg_degree"))


def component_sizes(graph: Graph) -> DataFrame:
    """One row: num_components, lcc_fraction."""
    sizes = components(graph.nodes, graph.edges).groupBy("component").agg(F.count(F.lit(1)).alias("size"))
    return sizes.agg(F.count(F.lit(1)).alias("num_components"), F.coalesce(F.round(F.max("size") / F.sum("size"), 6), F.lit(0.0)).alias("lcc_fraction"))


def isolated_nodes(graph: Graph) -> DataFrame:
    """One row: isolated_count, isolated_pct."""
    alone = isolated(graph).agg(F.count(F.lit(1)).alias("isolated_count"))
    total = graph.nodes.agg(F.count(F.lit(1)).alias("n"))
    return alone.join(F.broadcast(total)).select("isolated_count", F.round(100.0 * F.col("isolated_count") / F.greatest("n", F.lit(1)), 6).alias("isolated_pct"))


def graph_bytes(graph: Graph, features: int) -> DataFrame:
    """One row: edge bytes with 32-bit and 64-bit ids, feature bytes, total, and the memory estimate with weights."""
    e, n = graph.edges.agg(F.count(F.lit(1)).alias("e")), graph.nodes.agg(F.count(F.lit(1)).alias("n"))
    return e.join(F.broadcast(n)).select(
        (2 * F.col("e") * 4).alias("edge_bytes"),
        (2 * F.col("e") * 8).alias("edge_bytes_wide"),
        (F.col("n") * features * 4).alias("feature_bytes"),
        (2 * F.col("e") * 4 + F.col("n") * features * 4).alias("total_bytes"),
        (2 * F.col("e") * 8 + F.col("e") * 4).alias("memory_estimate"),
    )


def graph_stats(graph: Graph) -> DataFrame:
    """One row of all the measures above."""
    parts = [density_reciprocity(graph), degree_stats(graph), component_sizes(graph), isolated_nodes(graph)]
    one = parts[0]
    for more in parts[1:]:
        one = one.join(F.broadcast(more))
    return one
