"""Queries of the engine's own operators over the driver tables.

Stand-ins: ``events`` and ``orders`` are record tables, ``embeddings`` is a
feature matrix, ``documents`` with ``labels`` are scored binary labels.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.cleaning import as_number, attack_flag, clean_label, filled
from ..functions.scoring import positive_probability
from ..operators import analysis, checks, evaluate, features, gnn, knn, metrics, prepare, profile, split
from ..operators import graph as graphs
from ..operators.components import components
from ..operators.graph import Graph
from ..operators.ranking import draw
from ..sources.files import best_delimiter

Query = Callable[[SparkSession, str], DataFrame]
K = 8
#: Fixed weights of the attention query: they repeat over the positions.
A_SRC, A_DST = (0.5, -0.25, 0.125), (-0.5, 0.25, 0.75)

REGISTRY: dict[str, Query] = {}


def query(f: Query) -> Query:
    REGISTRY[f.__name__] = f
    return f


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("v"), "label")


def near(spark: SparkSession, sf_dir: str, metric: str = "cosine", k: int = K) -> DataFrame:
    return knn.knn(vectors(spark, sf_dir), "id", "v", k, metric)


def base_graph(spark: SparkSession, sf_dir: str) -> Graph:
    return Graph(vectors(spark, sf_dir).select("id"), near(spark, sf_dir))


def mutual_graph(spark: SparkSession, sf_dir: str) -> Graph:
    return Graph(vectors(spark, sf_dir).select("id"), graphs.mutual(near(spark, sf_dir)))


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").withColumn("y_multi", F.col("event_type")).withColumn("y_bin", (F.col("event_type") == "error").cast("int"))


def orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With nulls where the tables have none."""
    return table(spark, sf_dir, "orders").withColumn("status", F.expr("nullif(o_orderstatus, 'P')")).withColumn("price", F.expr("case when o_orderkey % 7 = 0 then null else o_totalprice end"))


# Graph construction


@query
def knn_cosine(spark, sf_dir):
    return near(spark, sf_dir)


@query
def knn_euclidean(spark, sf_dir):
    return near(spark, sf_dir, "euclidean")


@query
def knn_budget_sweep(spark, sf_dir):
    return knn.knn_sweep(vectors(spark, sf_dir), "id", "v", [8, 16, 32]).withColumn("k", F.col("k").cast("long"))


@query
def knn_guarded(spark, sf_dir):
    return knn.knn(vectors(spark, sf_dir), "id", "v", 0).agg(F.count(F.lit(1)).alias("edges"))


@query
def knn_symmetric(spark, sf_dir):
    return graphs.symmetrized(near(spark, sf_dir))


@query
def knn_mutual(spark, sf_dir):
    return graphs.mutual(near(spark, sf_dir))


@query
def topm_budget(spark, sf_dir):
    """The best N * 4 edges of a candidate graph of max(2k, 16) neighbours."""
    n = vectors(spark, sf_dir).count()
    return graphs.strongest(near(spark, sf_dir, k=max(2 * K, 16)), graphs.edge_budget(n, 4))


@query
def prune_budget(spark, sf_dir):
    n = vectors(spark, sf_dir).count()
    return graphs.pruned(graphs.symmetrized(near(spark, sf_dir)), graphs.edge_budget(n, 4, directed=False))


@query
def edge_budgets(spark, sf_dir):
    n = vectors(spark, sf_dir).count()
    rows = [(float(d), graphs.edge_budget(n, d), graphs.edge_budget(n, d, False)) for d in (2.5, 4, 8, 16)]
    return spark.createDataFrame(rows, "degree double, directed_edges long, undirected_edges long")


@query
def dedupe_edges(spark, sf_dir):
    edges = near(spark, sf_dir).select("src", "dst", "score")
    halved = edges.withColumn("score", F.round(F.col("score") / 2, 6))
    return graphs.adjacency(edges.withColumn("turn", F.lit(0)).unionByName(halved.withColumn("turn", F.lit(1))), order="turn")


@query
def directed_sym(spark, sf_dir):
    return graphs.directedness(near(spark, sf_dir), "sym")


@query
def directed_mutual(spark, sf_dir):
    return graphs.directedness(near(spark, sf_dir), "mutual")


@query
def selfloops_all(spark, sf_dir):
    return graphs.self_loops(base_graph(spark, sf_dir), "all")


@query
def selfloops_isolated(spark, sf_dir):
    return graphs.self_loops(mutual_graph(spark, sf_dir), "isolated_only")


@query
def graph_ids(spark, sf_dir):
    rows = [(graphs.similarity_id(k, "cosine", p, "train_only"), graphs.sweep_id("sweep", "mutual", k, 32)) for k in (8, 16, 32) for p in (None, 64)]
    return spark.createDataFrame(rows, "graph_id string, sweep_id string")


@query
def shared_entity_ring_orders(spark, sf_dir):
    return graphs.shared_entity_ring(table(spark, sf_dir, "orders"), "o_orderkey", ["o_custkey"], 3)


@query
def shared_entity_ring_events(spark, sf_dir):
    return graphs.shared_entity_ring(events(spark, sf_dir), "event_id", ["user_id", "event_type", "absent"], 2)


# Graph measures


@query
def node_degrees(spark, sf_dir):
    return metrics.degrees(base_graph(spark, sf_dir))


@query
def undirected_view(spark, sf_dir):
    return metrics.undirected(near(spark, sf_dir))


@query
def degree_stats(spark, sf_dir):
    return metrics.degree_stats(base_graph(spark, sf_dir))


@query
def density_reciprocity(spark, sf_dir):
    return metrics.density_reciprocity(base_graph(spark, sf_dir))


@query
def connected_components(spark, sf_dir):
    g = mutual_graph(spark, sf_dir)
    return components(g.nodes, g.edges)


@query
def lcc_fraction(spark, sf_dir):
    return metrics.component_sizes(mutual_graph(spark, sf_dir))


@query
def isolated_nodes(spark, sf_dir):
    return metrics.isolated_nodes(mutual_graph(spark, sf_dir))


@query
def graph_bytes(spark, sf_dir):
    return metrics.graph_bytes(base_graph(spark, sf_dir), 64)


@query
def graph_stats(spark, sf_dir):
    """The flagship: normalise, k nearest, mutual graph, one row of measures."""
    unit = vectors(spark, sf_dir).withColumn("v", features.l2_normalized(F.col("v")))
    edges = graphs.mutual(knn.knn(unit, "id", "v", K)).cache()
    return metrics.graph_stats(Graph(unit.select("id"), edges))


# Profiles


@query
def missing_profile(spark, sf_dir):
    return profile.missing_profile(orders(spark, sf_dir), ["o_orderkey", "status", "price"])


@query
def numeric_summary(spark, sf_dir):
    return profile.numeric_summary(table(spark, sf_dir, "lineitem"), ["l_quantity", "l_extendedprice", "l_discount", "l_tax"])


@query
def categorical_top10(spark, sf_dir):
    return profile.categorical_top(orders(spark, sf_dir), ["status", "o_orderpriority", "o_custkey"])


@query
def class_distribution(spark, sf_dir):
    return profile.class_distribution(orders(spark, sf_dir), "status")


@query
def numeric_coercion(spark, sf_dir):
    df = orders(spark, sf_dir).select(F.col("o_orderkey").cast("string").alias("key"), "o_orderpriority", F.when(F.col("o_orderkey") % 10 == 0, "n/a").otherwise(F.col("o_totalprice").cast("string")).alias("price"))
    return profile.numeric_coercion(df, ["key", "o_orderpriority", "price"])


@query
def timestamp_detect(spark, sf_dir):
    df = events(spark, sf_dir).select(F.lit("no time").alias("stime"), F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("ts"), F.when(F.col("event_id") % 2 == 0, F.date_format("ts", "yyyy-MM-dd HH:mm:ss")).otherwise("?").alias("ltime"))
    return profile.timestamp_detect(df, ["stime", "ts", "ltime"])


@query
def profile_sample(spark, sf_dir):
    return profile.profile_sample(events(spark, sf_dir).select("event_id", "user_id"), "event_id", 500)


@query
def delimiter_sniff(spark, sf_dir):
    line = F.concat_ws("\t", F.col("o_orderkey").cast("string"), F.col("o_orderstatus"), F.replace("o_orderpriority", F.lit(" "), F.lit(";")))
    return orders(spark, sf_dir).select("o_orderkey", best_delimiter(line).alias("delimiter"))


@query
def detected_columns(spark, sf_dir):
    df = events(spark, sf_dir).withColumn("Set", F.lit(1))
    found = {"entity": profile.entity_columns(df, ["USER_ID", "Event_Type", "proto"]), "label": profile.label_columns(df, ["y_multi", "absent"]), "split": profile.split_columns(df)}
    return profile.as_rows(df, found)


@query
def type_suggestion(spark, sf_dir):
    df = table(spark, sf_dir, "orders")
    return profile.as_rows(df, profile.type_suggestion(df))


# Cleaning


@query
def label_clean(spark, sf_dir):
    raw = F.concat(F.lit("  "), F.upper("event_type"), F.when(F.col("event_id") % 2 == 0, "..").otherwise(". "))
    df = events(spark, sf_dir).select("event_id", clean_label(raw).alias("label"))
    return df.withColumn("flag", attack_flag(F.col("label"), "click"))


@query
def fill_missing(spark, sf_dir):
    return orders(spark, sf_dir).select("o_orderkey", filled(F.col("status")).alias("status"), as_number(F.col("o_orderpriority").substr(1, 1)).alias("priority"))


@query
def bool_hint(spark, sf_dir):
    df = events(spark, sf_dir).select("event_id", F.when(F.col("event_id") % 3 == 0, F.lit(None)).otherwise((F.col("event_id") % 2).cast("string")).alias("land"), F.col("event_type").alias("label"))
    return prepare.with_flags(df)


@query
def drop_all_null(spark, sf_dir):
    df = events(spark, sf_dir).select("event_id", F.lit(None).cast("string").alias("nothing"), "event_type")
    return prepare.drop_empty(df)


@query
def column_roles(spark, sf_dir):
    df = events(spark, sf_dir).withColumn("_split_source", F.lit("single_file"))
    roles = prepare.resolve_roles(df, ["event_type"], "ts", ["user_id"])
    return profile.as_rows(df, {"label": roles.labels, "meta": roles.meta, "numeric": roles.numeric, "categorical": roles.categorical})


@query
def union_of_files(spark, sf_dir):
    df = events(spark, sf_dir)
    first = df.where("event_id % 2 = 0").select("event_id", "value").withColumn("_split_source", F.lit("train_file"))
    second = df.where("event_id % 2 = 1").select("event_id", "user_id").withColumn("_split_source", F.lit("test_file"))
    return first.unionByName(second, allowMissingColumns=True)


# Splits and samples


def split_events(spark, sf_dir):
    return split.split_threeway(events(spark, sf_dir), "event_id", "y_multi", 0.2, 0.1)


@query
def split_stratified(spark, sf_dir):
    return split.split_stratified(events(spark, sf_dir), "event_id", "y_multi", 0.1).select("event_id", "split")


@query
def split_by_file(spark, sf_dir):
    df = events(spark, sf_dir).withColumn("_split_source", F.when(F.col("event_id") % 4 == 0, "test_file").otherwise("train_file"))
    return split.split_by_file(df, "event_id", "y_multi", "_split_source", 0.1).select("event_id", "split")


@query
def split_threeway(spark, sf_dir):
    return split_events(spark, sf_dir).select("event_id", "split")


@query
def split_entity_disjoint(spark, sf_dir):
    return split.split_entity_disjoint(events(spark, sf_dir), "event_id", "y_multi", "user_id", 0.2, 0.1).select("event_id", "split")


@query
def sample_label(spark, sf_dir):
    return split.sample_by_label(events(spark, sf_dir), "event_id", "y_bin", 501).select("event_id", "y_bin")


@query
def sample_split_label_topup(spark, sf_dir):
    return split.sample_topped_up(split_events(spark, sf_dir), "event_id", "split", "y_bin", 503).select("event_id", "split", "y_bin")


@query
def sample_grouped(spark, sf_dir):
    return split.sample_grouped(split_events(spark, sf_dir), "event_id", "split", "y_bin", 499).select("event_id", "split", "y_bin")


@query
def split_positions(spark, sf_dir):
    return split.positions(split_events(spark, sf_dir).select("event_id", "split"), "event_id")


@query
def split_distribution(spark, sf_dir):
    return prepare.split_distribution(split_events(spark, sf_dir), "y_multi")


@query
def split_checks(spark, sf_dir):
    df = split.split_entity_disjoint(events(spark, sf_dir), "event_id", "y_multi", "user_id", 0.2, 0.1)
    return prepare.quality_checks(df, "y_bin", "user_id", ["value"], ["y_bin", "y_multi"])


@query
def scope_train_only(spark, sf_dir):
    return features.scope(split_events(spark, sf_dir), "train_only").groupBy("split").agg(F.count(F.lit(1)).alias("rows"))


# Features


def split_orders(spark, sf_dir):
    return split.split_threeway(orders(spark, sf_dir), "o_orderkey", "o_orderpriority", 0.2, 0.1)


@query
def standardize_train(spark, sf_dir):
    df = split_orders(spark, sf_dir)
    columns = ["price", "o_custkey"]
    return features.long_form(df, "o_orderkey", features.standardized(df, columns, features.moments(df, columns)))


@query
def onehot_train_levels(spark, sf_dir):
    df = split_orders(spark, sf_dir)
    return features.long_form(df, "o_orderkey", features.one_hot(features.levels(df, ["status", "o_orderpriority"])))


@query
def dummies_null_indicator(spark, sf_dir):
    df = orders(spark, sf_dir)
    return features.long_form(df, "o_orderkey", features.dummies(df, ["price"], ["status"]))


@query
def feature_vectors(spark, sf_dir):
    """Blocks side by side, of length 1, as rows of (key, pos, value)."""
    df = split_orders(spark, sf_dir)
    out = features.feature_matrix(df, "o_orderkey", "o_orderstatus", ["price"], ["status"], graph_scope="train_only")
    return out.select("o_orderkey", F.posexplode("v").alias("pos", "value")).select("o_orderkey", F.col("pos").cast("long").alias("pos"), F.round("value", 6).alias("value"))


@query
def l2_normalize(spark, sf_dir):
    scaled = vectors(spark, sf_dir).select("id", F.transform("v", lambda x: 3 * x).alias("v"))
    return scaled.select("id", F.posexplode(features.l2_normalized(F.col("v"))).alias("pos", "value")).select("id", F.col("pos").cast("long").alias("pos"), F.round("value", 6).alias("value"))


@query
def pca_project(spark, sf_dir):
    out = features.pca(vectors(spark, sf_dir).select("id", "v"), "v", 16)
    return out.select("id", F.transform("v", lambda x: F.round(x, 6)).alias("v"))


@query
def svd_project(spark, sf_dir):
    out = features.pca(vectors(spark, sf_dir).select("id", "v"), "v", 16, centred=False)
    return out.select("id", F.transform("v", lambda x: F.round(x, 6)).alias("v"))


# Evaluation


def scored(spark, sf_dir):
    """Labels with a length in (0, 1] as the score."""
    docs = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id")
    return docs.select("doc_id", F.col("quality").alias("y"), (F.least("n_chars", F.lit(8000)) / 8000.0).alias("p"))


@query
def confusion(spark, sf_dir):
    return evaluate.confusion(scored(spark, sf_dir), "y", "p", 0.25)


@query
def mcc(spark, sf_dir):
    return evaluate.with_mcc(evaluate.confusion(scored(spark, sf_dir), "y", "p", 0.25))


@query
def threshold_table(spark, sf_dir):
    return evaluate.threshold_table(scored(spark, sf_dir), "y", "p").withColumn("threshold", F.round("threshold", 6))


@query
def threshold_search_mcc(spark, sf_dir):
    return evaluate.best_threshold(scored(spark, sf_dir), "y", "p")


@query
def roc_auc(spark, sf_dir):
    return evaluate.ranking_scores(scored(spark, sf_dir), "y", "p").select("auc_roc")


@query
def average_precision(spark, sf_dir):
    return evaluate.ranking_scores(scored(spark, sf_dir), "y", "p").select("auc_pr")


@query
def metric_record(spark, sf_dir):
    return evaluate.metric_record(scored(spark, sf_dir), "y", "p", 0.25)


@query
def class_weight(spark, sf_dir):
    return evaluate.class_weight(scored(spark, sf_dir).withColumn("y", 1 - F.col("y")), "y")


@query
def positive_probabilities(spark, sf_dir):
    df = scored(spark, sf_dir)
    return df.select("doc_id", F.round(positive_probability(F.col("p"), 2 * F.col("p") - 0.5), 6).alias("probability"))


# Graph networks


@query
def gcn_norm_adjacency(spark, sf_dir):
    return gnn.normalized_adjacency(base_graph(spark, sf_dir)).withColumn("weight", F.round("weight", 6))


@query
def gcn_propagate(spark, sf_dir):
    g = base_graph(spark, sf_dir)
    out = gnn.propagated(gnn.normalized_adjacency(g), vectors(spark, sf_dir))
    return out.withColumn("value", F.round("value", 6))


def _attention(spark, sf_dir):
    repeat = lambda a: [a[i % len(a)] for i in range(64)]
    return gnn.attention(near(spark, sf_dir), vectors(spark, sf_dir), repeat(A_SRC), repeat(A_DST))


@query
def gat_attention(spark, sf_dir):
    return _attention(spark, sf_dir).withColumn("alpha", F.round("alpha", 6))


@query
def gat_propagate(spark, sf_dir):
    return gnn.attended(_attention(spark, sf_dir), vectors(spark, sf_dir)).withColumn("value", F.round("value", 6))


def _runs(spark, sf_dir, model):
    nodes = vectors(spark, sf_dir).withColumn("y_bin", (F.col("label") < 5).cast("int"))
    nodes = split.split_threeway(nodes, "id", "y_bin", 0.2, 0.1).withColumn("graph_id", F.lit(graphs.similarity_id(K, "cosine", None, "transductive")))
    edges = near(spark, sf_dir).select(F.lit(graphs.similarity_id(K, "cosine", None, "transductive")).alias("graph_id"), "src", "dst")
    return gnn.train_runs(nodes, edges, [0, 1, 2], gnn.Training(model=model)).drop(*gnn.TIMES)


@query
def train_gcn(spark, sf_dir):
    return _runs(spark, sf_dir, "gcn")


@query
def train_gat(spark, sf_dir):
    return _runs(spark, sf_dir, "gat")


# Results


def results(spark, sf_dir):
    """Nested run results made of events: nulls in budgets, areas and costs."""
    e = table(spark, sf_dir, "events")
    i = F.col("event_id")
    area = F.when(i % 11 != 0, F.round(F.col("value") % 1, 6))
    return e.select(
        F.lit("events").alias("dataset"),
        F.when(i % 2 == 0, "gcn").otherwise("gat").alias("model"),
        F.concat(F.lit("sweep_"), F.col("event_type")).alias("graph_id"),
        (i % 3).alias("seed"),
        F.struct(F.col("event_type").alias("method"), F.when(i % 5 != 0, F.element_at(F.array(*map(F.lit, (4, 8, 16, 32))), (i % 4 + 1).cast("int"))).cast("long").alias("budget"), F.when(i % 13 != 0, (i % 17).cast("double")).alias("edge_creation_time_seconds"), (8 * i).alias("estimated_graph_memory_bytes")).alias("graph_metadata"),
        F.struct(F.round(F.col("value") % 1, 6).alias("mcc")).alias("val"),
        F.struct(F.round(F.col("value") % 1, 6).alias("mcc"), area.alias("auc_pr"), area.alias("auc_roc")).alias("test"),
        (i % 19).cast("double").alias("total_training_time_seconds"),
    )


@query
def analysis_flatten(spark, sf_dir):
    return analysis.flattened(results(spark, sf_dir), "sweep_c")


@query
def analysis_mean_mcc(spark, sf_dir):
    return analysis.mean_mcc(analysis.flattened(results(spark, sf_dir)))


@query
def analysis_cost(spark, sf_dir):
    return analysis.mean_cost(analysis.flattened(results(spark, sf_dir)))


@query
def analysis_auc(spark, sf_dir):
    return analysis.mean_auc(analysis.flattened(results(spark, sf_dir)))


@query
def cost_quality_table(spark, sf_dir):
    return analysis.cost_quality(analysis.flattened(results(spark, sf_dir)))


# Validation


@query
def processed_check_violations(spark, sf_dir):
    return checks.processed_violations(split_events(spark, sf_dir), ["value"], ["y_bin", "y_multi"])


@query
def graph_check_violations(spark, sf_dir):
    nodes = vectors(spark, sf_dir).withColumn("y_bin", (F.col("label") < 5).cast("int"))
    nodes = split.split_stratified(nodes, "id", "y_bin", 0.1)
    return checks.graph_violations(Graph(nodes, near(spark, sf_dir)), "y_bin", "split", K)


@query
def draws(spark, sf_dir):
    return events(spark, sf_dir).select("event_id", draw(42, F.col("event_id")).alias("draw"))


def queries() -> dict[str, Query]:
    return dict(REGISTRY)
