"""Tables over run results."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Columns of a flat result, and where they lie in a nested one.
FLAT = {
    "dataset": "dataset",
    "model": "model",
    "graph_id": "graph_id",
    "seed": "seed",
    "method": "graph_metadata.method",
    "budget": "graph_metadata.budget",
    "mcc_val": "val.mcc",
    "mcc_test": "test.mcc",
    "edge_creation_time_seconds": "graph_metadata.edge_creation_time_seconds",
    "estimated_graph_memory_bytes": "graph_metadata.estimated_graph_memory_bytes",
    "total_training_time_seconds": "total_training_time_seconds",
    "auc_pr_test": "test.auc_pr",
    "auc_roc_test": "test.auc_roc",
}
GROUP = ["dataset", "model", "budget", "method"]


def flattened(results: DataFrame, prefix: str = "") -> DataFrame:
    """The 13 flat columns of nested results whose graph_id begins with prefix."""
    return results.where(F.col("graph_id").startswith(prefix)).select(*(F.col(path).alias(name) for name, path in FLAT.items()))


def _keyed(flat: DataFrame) -> DataFrame:
    return flat.dropna(subset=GROUP)


def mean_mcc(flat: DataFrame) -> DataFrame:
    return _keyed(flat).groupBy(*GROUP).agg(F.round(F.avg("mcc_test"), 6).alias("mean_mcc"))


def mean_cost(flat: DataFrame) -> DataFrame:
    return _keyed(flat).groupBy(*GROUP).agg(F.round(F.avg("edge_creation_time_seconds"), 6).alias("construct_seconds"), F.round(F.avg("total_training_time_seconds"), 6).alias("train_seconds"))


def mean_auc(flat: DataFrame) -> DataFrame:
    """Means over rows that have both areas."""
    both = _keyed(flat).dropna(subset=["auc_pr_test", "auc_roc_test"])
    return both.groupBy(*GROUP).agg(F.round(F.avg("auc_pr_test"), 6).alias("auc_pr"), F.round(F.avg("auc_roc_test"), 6).alias("auc_roc"))


def cost_quality(flat: DataFrame) -> DataFrame:
    """Mean quality against total cost, which is null where a part is."""
    out = _keyed(flat).groupBy(*GROUP).agg(F.avg("mcc_test").alias("q"), F.avg("edge_creation_time_seconds").alias("a"), F.avg("total_training_time_seconds").alias("b"))
    return out.select(*GROUP, F.round("q", 6).alias("mean_mcc"), F.round(F.col("a") + F.col("b"), 6).alias("total_cost"))
