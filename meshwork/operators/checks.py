"""Validation jobs: a row for each rule, with how often it is broken."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graph import Graph


def processed_violations(df: DataFrame, features: list[str], labels: list[str], label: str = "y_bin", split: str = "split") -> DataFrame:
    """rule, violations: no features, features that are labels, labels outside 0 and 1, a split without any label."""
    listed = df.sparkSession.createDataFrame([("features_present", 0 if features else 1), ("features_are_not_labels", len(set(features) & set(labels)))], "rule string, violations long")
    bad = df.agg(F.count_if(F.col(label).isNotNull() & ~F.col(label).isin(0, 1)).alias("violations")).select(F.lit("label_is_binary").alias("rule"), "violations")
    bare = df.groupBy(split).agg(F.count(label).alias("n")).agg(F.count_if(F.col("n") == 0).alias("violations")).select(F.lit("each_split_has_labels").alias("rule"), "violations")
    return listed.unionByName(bad).unionByName(bare)


def graph_violations(graph: Graph, label: str, split: str, k: int | None, low: float = 0.85, high: float = 1.05) -> DataFrame:
    """rule, violations: unknown ends, labels outside 0 and 1, nodes in several splits, edge count against N * k.

    ``k`` is that of a base graph, all of whose edges are there; None, or a
    graph without nodes, has no count to hold the edges against.
    """
    ids = graph.nodes.select("id").distinct()
    ends = graph.edges.select(F.col("src").alias("id")).unionByName(graph.edges.select(F.col("dst").alias("id")))
    rule = lambda df, name: df.select(F.lit(name).alias("rule"), F.col("violations").cast("long").alias("violations"))
    unknown = ends.join(ids, "id", "left_anti").agg(F.count(F.lit(1)).alias("violations"))
    binary = graph.nodes.agg(F.count_if(~F.coalesce(F.col(label).isin(0, 1), F.lit(False))).alias("violations"))
    torn = graph.nodes.groupBy("id").agg(F.count_distinct(split).alias("n")).agg(F.count_if(F.col("n") > 1).alias("violations"))
    counts = graph.edges.agg(F.count(F.lit(1)).alias("e")).join(F.broadcast(graph.nodes.agg(F.count(F.lit(1)).alias("n"))))
    wanted = F.col("n") * (k or 0)
    size = counts.select(((wanted > 0) & ~(F.col("e") / F.greatest(wanted, F.lit(1))).between(low, high)).cast("long").alias("violations"))
    return rule(unknown, "ends_are_nodes").unionByName(rule(binary, "label_is_binary")).unionByName(rule(torn, "splits_are_disjoint")).unionByName(rule(size, "edge_count_near_nodes_times_k"))
