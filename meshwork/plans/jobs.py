"""The jobs behind the command line: inspect, prepare, build, sweep, train, analyse, check.

Each reads what the one before it has stored, through Spark's file systems.
"""

from __future__ import annotations

from dataclasses import asdict
from functools import reduce
from pathlib import Path
from time import perf_counter

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import analysis, checks, features, gnn, graph, knn, metrics, prepare, profile, split
from ..operators.graph import Graph
from ..operators.ranking import ranked
from ..sources import store
from ..sources.catalog import DATASETS, dataset
from ..sources.files import missing_files, read_dataset, resolved

#: Where folders that are given as relative paths may also lie.
BASES = (str(Path(__file__).resolve().parents[2]), str(Path(__file__).resolve().parents[3]))
SPLIT_MODES = ("random_stratified", "entity_disjoint")
METHODS = ("knn", "sym", "mutual", "topm")


def with_row_id(df: DataFrame) -> DataFrame:
    """``row_id``: the row's place in the order of a hash of its values; equal rows are interchangeable."""
    hashed = df.withColumn("_hash", F.xxhash64(*(F.col(f"`{c}`") for c in df.columns)))
    out = ranked(hashed, [], F.shiftright("_hash", 52), [F.col("_hash")], "row_id", None)
    return out.withColumn("row_id", F.col("row_id") - 1).drop("_hash")


def inspect(spark: SparkSession, data_dir: str, out_dir: str, sample_rows: int = 200_000, seed: int = 42) -> list[str]:
    """Profile, schema and summary of every dataset whose files are there."""
    done, summary, data_dir = [], [], resolved(spark, data_dir, BASES)
    for spec in DATASETS.values():
        if missing_files(spark, spec.paths(data_dir)):
            continue
        df = read_dataset(spark, spec, data_dir).drop("y_multi", "y_bin", "_split_source")
        sampled = profile.profile_sample(with_row_id(df), "row_id", sample_rows, seed).drop("row_id", "sampled").cache()
        found = profile.report(sampled, list(spec.labels.listed), list(spec.candidates["time"]), list(spec.candidates["entity"]))
        found["missing"] = [r.asDict() for r in profile.missing_profile(df, df.columns).collect()]  # of the whole table
        chosen = [t["column_name"] for t in found["timestamps"] if t["chosen"]]
        kinds = found["suggested"]
        schema = {"dataset": spec.name, "label_columns": [c for c in spec.labels.listed if c in df.columns], "timestamp": chosen[0] if chosen else None, "entity_columns": found["entity_columns"], "categorical": kinds["categorical"], "numeric": kinds["numeric"]}
        store.write_json(spark, f"{out_dir}/{spec.name}/profile.json", found)
        store.write_text(spark, f"{out_dir}/{spec.name}/schema.yaml", store.format_flat_yaml(schema))
        summary.append(store.markdown_summary(spec.name, {"columns": len(df.columns), "entities": found["entity_columns"], "timestamp": schema["timestamp"]}))
        sampled.unpersist()
        done.append(spec.name)
    store.write_text(spark, f"{out_dir}/README.md", "\n".join(summary))
    return done


def prepare_dataset(spark: SparkSession, name: str, data_dir: str, schema_dir: str, out_dir: str, seed: int = 42, val_ratio: float = 0.1, split_mode: str = "random_stratified", test_ratio: float = 0.2) -> dict:
    """Labelled, split, typed rows as Parquet, with a metadata document, which is returned."""
    if not (0 < val_ratio < 1 and 0 < test_ratio < 1):
        raise ValueError("ratios must lie strictly between 0 and 1")
    if split_mode not in SPLIT_MODES:
        raise ValueError(f"unknown split mode {split_mode!r}")
    spec = dataset(name)
    data_dir, schema_dir = resolved(spark, data_dir, BASES), resolved(spark, schema_dir, BASES)
    schema = store.parse_flat_yaml(store.read_text(spark, f"{schema_dir}/{name}/schema.yaml"))
    df = with_row_id(read_dataset(spark, spec, data_dir).drop("_source_file"))
    by_file = len(spec.parts) == 2
    if by_file:
        parted = split.split_by_file(df, "row_id", "y_multi", "_split_source", val_ratio, seed)
    elif split_mode == "entity_disjoint":
        parted = split.split_entity_disjoint(df, "row_id", "y_multi", "src_ip", test_ratio, val_ratio, seed)
    else:
        parted = split.split_threeway(df, "row_id", "y_multi", test_ratio, val_ratio, seed)
    empty = prepare.empty_columns(parted)
    parted = parted.drop(*empty)
    entities = [c for c in schema.get("entity_columns") or [] if c in parted.columns]
    roles = prepare.resolve_roles(parted.drop("row_id", "split"), list(schema.get("label_columns") or []), schema.get("timestamp"), entities, schema.get("categorical") or [], schema.get("numeric") or [])
    out = prepare.typed(parted, roles)
    store.write_processed(out, f"{out_dir}/{name}/data")
    stored = store.read_processed(spark, f"{out_dir}/{name}/data")
    rows = lambda t: [r.asDict() for r in t.collect()]  # noqa: E731  a row for each split and class
    document = {
        "dataset_name": name,
        "split_mode": "file" if by_file else split_mode,
        "seed": seed,
        "fingerprint": store.fingerprint(stored),
        "split_counts": {r["split"]: r["count"] for r in stored.groupBy("split").count().collect()},
        "y_bin_distribution": rows(prepare.split_distribution(stored, "y_bin")),
        "y_multi_distribution": rows(prepare.split_distribution(stored, "y_multi")),
        "roles": asdict(roles),
        "entity_columns": entities,
        "timestamp_column": schema.get("timestamp"),
        "warnings": [*roles.warnings, *([f"dropped empty columns: {', '.join(empty)}"] if empty else [])],
        "sanity_checks": rows(prepare.quality_checks(stored, "y_bin", entities[0] if entities else "row_id", roles.features or ["row_id"], roles.labels)),
    }
    store.write_json(spark, f"{out_dir}/{name}/metadata.json", document)
    return document


def _metadata(spark: SparkSession, processed_dir: str, name: str) -> dict:
    """The metadata document; its ``path`` is the folder of the rows."""
    processed_dir = resolved(spark, processed_dir, BASES)
    return {"path": f"{processed_dir}/{name}/data"} | store.read_json(spark, f"{processed_dir}/{name}/metadata.json")


def _stored_config(spark: SparkSession, path: str) -> dict | None:
    return store.read_json(spark, f"{path}/config.json") if not missing_files(spark, [f"{path}/config.json"]) else None


def _built(make) -> tuple[DataFrame, float]:
    """A cached table and the seconds that an action over it took."""
    begun = perf_counter()
    out = make().cache()
    out.count()
    return out, perf_counter() - begun


def _same(stored: dict | None, config: dict) -> bool:
    """Whether a stored configuration is this one; measured times are no setting."""
    return stored is not None and {k: v for k, v in stored.items() if not k.endswith("_seconds")} == config


def _store_graph(spark: SparkSession, path: str, nodes: DataFrame, edges: DataFrame, config: dict, seconds: dict[str, float]) -> None:
    """``seconds``: of the stages before; the measures are timed here."""
    g = Graph(nodes.withColumnRenamed("row_id", "id"), edges)
    stats, measured = _built(lambda: metrics.graph_stats(Graph(g.nodes.select("id"), edges)))
    timed = {f"{stage}_seconds": s for stage, s in ({"feature": 0.0} | seconds | {"metrics": measured}).items()}
    store.write_graph(g, path, stats, {**config, **timed, "edge_creation_time_seconds": timed["knn_seconds"] + timed["ops_seconds"]})
    stats.unpersist()


def build_graphs(spark: SparkSession, name: str, processed_dir: str, out_dir: str, graph_scope: str = "transductive", ks: tuple[int, ...] = (8, 16, 32), directedness: str = "directed", self_loops: str = "none", metric: str = "cosine", pca_dim: int | None = None, seed: int = 42, max_nodes: int | None = None, overwrite: bool = False, stage: str = "all", quick: bool = False, centred: bool = True) -> list[str]:
    """A stored graph for each k; those whose stored configuration and data are equal stay as they are.

    Seconds of features, neighbour search, edge operations and measures are
    stored with a graph.  Its edge creation time is that of the neighbour
    search, which all k share and each would need alone, and of its own edges.
    """
    if quick:
        preset = graph.QUICK_GRID
        graph_scope, ks, directedness, self_loops, metric, pca_dim = preset["graph_scope"], preset["ks"], preset["directedness"], preset["self_loops"], preset["metric"], pca_dim or preset["pca_dim"]
    document = _metadata(spark, processed_dir, name)
    roles = document["roles"]
    df = store.read_processed(spark, document["path"])
    data = document.get("fingerprint") or store.fingerprint(df)
    key = {"dataset": name, "data": data, "scope": graph_scope, "metric": metric, "pca": pca_dim, "kind": "features", "roles": roles, "centred": centred}
    begun = perf_counter()
    matrix = store.cached(spark, f"{out_dir}/_features", key, lambda: features.feature_matrix(df, "row_id", "y_bin", roles["numeric"], roles["categorical"], "split", graph_scope, pca_dim, metric == "cosine", centred), overwrite)
    encoded = perf_counter() - begun
    if stage == "featurize":
        return []
    nodes = split.sample_by_label(matrix, "row_id", "y_bin", max_nodes, seed) if max_nodes else matrix
    swept, searched, made = None, 0.0, []
    for k in ks:
        graph_id = graph.similarity_id(k, metric, pca_dim, graph_scope)
        path = f"{out_dir}/{name}/{graph_id}"
        config = {"dataset": name, "graph_id": graph_id, "k": k, "scope": graph_scope, "metric": metric, "pca": pca_dim, "directedness": directedness, "self_loops": self_loops, "seed": seed, "max_nodes": max_nodes, "data": data, "centred": centred}
        if overwrite or not _same(_stored_config(spark, path), config):
            if swept is None:
                nodes = nodes.cache()
                nodes.count()
                swept, searched = _built(lambda: knn.knn_sweep(nodes, "row_id", "v", list(ks), metric))

            def own(k=k):
                edges = graph.directedness(graph.adjacency(swept.where(F.col("k") == k).drop("k")), directedness)
                return graph.self_loops(Graph(nodes.select(F.col("row_id").alias("id")), edges), self_loops)

            edges, seconds = _built(own)
            _store_graph(spark, path, nodes, edges, config, {"feature": encoded, "knn": searched, "ops": seconds})
            edges.unpersist()
        made.append(path)
    if swept is not None:
        swept.unpersist()
        nodes.unpersist()
    write_graph_summary(spark, made, f"{out_dir}/{name}/summary")
    return made


def build_budget_graphs(spark: SparkSession, name: str, processed_dir: str, out_dir: str, budgets: tuple[int, ...] = (4, 8, 16, 32), method: str = "knn", pca_dim: int = 32, max_nodes: int = 5000, seed: int = 42, prefix: str = "sweep") -> list[str]:
    """A stored graph for each edge budget, over the unscaled dummies matrix of a sample of nodes.

    A graph's edge creation time is that of the neighbour search, which all
    budgets share and each would need alone, and of its own edges.
    """
    if method not in METHODS:
        raise ValueError(f"unknown method {method!r}")
    document = _metadata(spark, processed_dir, name)
    roles, rows = document["roles"], store.read_processed(spark, document["path"])
    data = document.get("fingerprint") or store.fingerprint(rows)
    begun = perf_counter()
    df = split.sample_grouped(rows, "row_id", "split", "y_bin", max_nodes, seed).cache()
    matrix = features.assembled(df, ["row_id", "y_bin", "split"], features.dummies(df, roles["numeric"], roles["categorical"]))
    nodes = features.pca(matrix, "v", pca_dim, strict=True).withColumn("v", features.l2_normalized(F.col("v"))).cache()
    n, made = nodes.count(), []
    encoded = perf_counter() - begun
    wanted = {b: max(2 * max(1, b), 16) if method == "topm" else max(1, b) for b in budgets}
    swept, searched = _built(lambda: knn.knn_sweep(nodes, "row_id", "v", sorted(set(wanted.values()))))
    for budget, k in wanted.items():
        most = graph.edge_budget(n, budget)

        def own(k=k, most=most):
            edges = swept.where(F.col("k") == k).drop("k")
            edges = graph.symmetrized(edges) if method == "sym" else graph.mutual(edges) if method == "mutual" else edges
            return graph.pruned(edges, most)

        edges, seconds = _built(own)
        graph_id = graph.sweep_id(prefix, method, budget, pca_dim)
        path = f"{out_dir}/{name}/{graph_id}"
        _store_graph(spark, path, nodes, edges, {"dataset": name, "graph_id": graph_id, "k": k, "method": method, "budget": budget, "target_edges": most, "seed": seed, "data": data}, {"feature": encoded, "knn": searched, "ops": seconds})
        edges.unpersist()
        made.append(path)
    for table in (swept, nodes, df):
        table.unpersist()
    return made


def write_graph_summary(spark: SparkSession, paths: list[str], out: str) -> None:
    """One CSV over all stored statistics."""
    if paths:
        store.write_summary_csv(reduce(DataFrame.unionByName, (spark.read.parquet(f"{p}/stats").withColumn("path", F.lit(p)) for p in paths)), out)


def train(spark: SparkSession, paths: list[str], out_dir: str, model: str = "gcn", seeds: tuple[int, ...] = (0, 1, 2), epochs: int = 100, rate: float = 1e-3, hidden: int = 64, strict: bool = False) -> DataFrame:
    """Results of every graph and seed, also as nested JSON in a folder a run; earlier results of other runs stay.

    A run is known by dataset, graph, model and seed; a path that names the
    same graph twice is an error.
    """
    loaded = [(store.read_graph(spark, p)) for p in paths]
    names = [f"{c['dataset']}/{c['graph_id']}" for _, c in loaded]
    if len(set(names)) < len(names):
        raise ValueError("two paths hold the same graph")
    nodes = reduce(DataFrame.unionByName, (g.nodes.select(F.lit(n).alias("graph_id"), "id", "v", "y_bin", "split") for n, (g, _) in zip(names, loaded)))
    edges = reduce(DataFrame.unionByName, (g.edges.select(F.lit(n).alias("graph_id"), "src", "dst") for n, (g, _) in zip(names, loaded)))
    configs = spark.createDataFrame([(n, c["graph_id"], c["dataset"], c.get("method"), c.get("budget"), c.get("edge_creation_time_seconds")) for n, (_, c) in zip(names, loaded)], "graph string, graph_id string, dataset string, method string, budget long, edge_creation_time_seconds double")
    runs = gnn.train_runs(nodes, edges, list(seeds), gnn.Training(model=model, epochs=epochs, rate=rate, hidden=hidden), strict)
    # One row a path that the caller has named.
    out = runs.withColumnRenamed("graph_id", "graph").join(F.broadcast(configs), "graph").drop("graph")
    record = lambda s: F.struct("threshold", *(F.col(f"{name}_{s}").alias(name) for name in gnn.RECORD)).alias(s)
    nested = out.select(
        "dataset", "model", "graph_id", "seed", "error", "epochs_ran",
        F.struct("method", "budget", "edge_creation_time_seconds", (20 * F.col("num_edges")).alias("estimated_graph_memory_bytes")).alias("graph_metadata"),
        record("val"), record("test"), *gnn.TIMES,
    )
    store.write_results(nested, out_dir)
    stored = spark.read.schema(nested.schema).json(out_dir)
    return stored.where((F.col("model") == model) & F.col("seed").isin(list(seeds)) & F.concat_ws("/", "dataset", "graph_id").isin(names))


RESULT = "dataset string, model string, graph_id string, seed long, graph_metadata struct<method string, budget long, edge_creation_time_seconds double, estimated_graph_memory_bytes long>, val struct<mcc double>, test struct<mcc double, auc_pr double, auc_roc double>, total_training_time_seconds double"


def analyse(spark: SparkSession, results_dir: str, out_dir: str, prefix: str = "") -> DataFrame:
    """The flat table and the means over it, as CSV; a line of JSON is a result, and a broken one is left out with a warning."""
    flat = analysis.flattened(store.read_results(spark, results_dir, RESULT), prefix)
    for name, table in (("summary", flat), ("mean_mcc", analysis.mean_mcc(flat)), ("mean_cost", analysis.mean_cost(flat)), ("mean_auc", analysis.mean_auc(flat)), ("cost_quality", analysis.cost_quality(flat))):
        store.write_summary_csv(table, f"{out_dir}/{name}")
    return flat


def check_processed(spark: SparkSession, processed_dir: str, name: str) -> DataFrame:
    document = _metadata(spark, processed_dir, name)
    roles = document["roles"]
    return checks.processed_violations(store.read_processed(spark, document["path"]), roles["features"], roles["labels"])


def check_graphs(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Violations of every stored graph; edge counts are held against base graphs, which keep all directed edges."""
    out = []
    for p in paths:
        g, config = store.read_graph(spark, p)
        base = config.get("directedness") == "directed" and config.get("self_loops") == "none"
        out.append(checks.graph_violations(g, "y_bin", "split", config["k"] if base else None).withColumn("path", F.lit(p)))
    return reduce(DataFrame.unionByName, out)
