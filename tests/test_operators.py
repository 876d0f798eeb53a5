"""Edges of the operators, on small tables made by hand."""

from __future__ import annotations

import random

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from meshwork.functions.cleaning import clean_label, null_like
from meshwork.operators import checks, evaluate, features, gnn, graph, knn, metrics, prepare, profile, split
from meshwork.operators.components import components
from meshwork.operators.graph import Graph
from meshwork.operators.ranking import ranked
from meshwork.sources import store
from meshwork.sources.catalog import dataset
from meshwork.sources.files import best_delimiter, labelled, missing_files, read_headerless, read_with_header, resolved, typed_texts, with_provenance


def rows(df, *names):
    return sorted(tuple(r[n] for n in names or df.columns) for r in df.collect())


def test_times_from_odd_values(spark):
    df = spark.createDataFrame([("2024-01-02 03:04:05",), ("1700000000",), ("1e300",), ("NaN",), ("x",), (None,)], "ts string")
    got = profile.timestamp_detect(df.withColumn("never", F.lit("-")), ["never", "ts"])
    assert rows(got) == [("never", 0.0, False), ("ts", 33.333333, True)]


def edges(spark, pairs):
    return spark.createDataFrame([(a, b, float(s)) for a, b, s in pairs], "src long, dst long, score double")


def nodes(spark, n):
    return spark.range(n)


def test_labels_and_null_words(spark):
    df = spark.createDataFrame([("  Smurf..",), ("normal.",), (None,), ("nan",)], "x string")
    got = [(r[0], r[1]) for r in df.select(clean_label(F.col("x")), null_like(F.col("x"))).collect()]
    assert got == [("smurf", "  Smurf.."), ("normal", "normal."), (None, None), ("nan", None)]


def test_null_label_is_normal(spark):
    df = spark.createDataFrame([("normal.",), (None,), ("Smurf.",)], "label string")
    assert [r.y_bin for r in labelled(df, dataset("kdd")).collect()] == [0, 0, 1]


def test_text_label_is_no_flag(spark):
    df = spark.createDataFrame([("a", "1", None), ("b", None, "2")], "label string, land string, logged_in string")
    assert prepare.flag_columns(df) == ["land"]
    assert rows(prepare.with_flags(df), "label", "land") == [("a", 1), ("b", 0)]


def test_empty_table_profiles(spark):
    df = spark.createDataFrame([], "a string, b double")
    assert rows(profile.missing_profile(df, ["a", "b"]), "n_missing") == [(0,), (0,)]
    assert profile.numeric_summary(df, ["b"]).first()["mean_value"] is None
    assert profile.class_distribution(df, "a").count() == 0
    assert prepare.empty_columns(df) == ["a", "b"]


@pytest.mark.parametrize(("n", "ratio", "wanted"), [(1, 0.1, 1), (5, 0.1, 1), (15, 0.1, 2), (25, 0.1, 2), (10, 0.0, 0), (3, 1.0, 3)])
def test_quotas_round_half_to_even(spark, n, ratio, wanted):
    df = spark.range(n).withColumn("y", F.lit(1))
    assert split.stratified_pick(df, "id", "y", ratio).where("picked").count() == wanted


def test_null_class_is_never_picked(spark):
    df = spark.range(20).withColumn("y", F.when(F.col("id") < 10, 1))
    assert split.stratified_pick(df, "id", "y", 0.5).where("picked and y is null").count() == 0


def test_three_parts_hold_every_row_once(spark):
    df = spark.range(300).withColumn("y", F.col("id") % 7)
    got = split.split_threeway(df, "id", "y", 0.2, 0.1)
    assert got.count() == got.select("id").distinct().count() == 300


def test_entities_keep_to_one_side(spark):
    df = spark.range(200).withColumn("y", F.col("id") % 2).withColumn("e", F.when(F.col("id") % 5 != 0, F.col("id") % 9))
    got = split.split_entity_disjoint(df, "id", "y", "e", 0.3, 0.2)
    assert got.count() == 200
    assert got.where("e is null and split = 'test'").count() == 0
    assert got.where("e is not null").groupBy("e").agg(F.count_distinct(F.col("split") == "test").alias("n")).where("n > 1").count() == 0
    assert split.split_entity_disjoint(df, "id", "y", "absent", 0.3, 0.2).count() == 200


@pytest.mark.parametrize("most", [10, 50, 200])
def test_topped_up_sample_is_exact(spark, most):
    df = spark.range(120).withColumn("y", F.col("id") % 40).withColumn("split", F.when(F.col("id") % 3 == 0, "train"))
    assert split.sample_topped_up(df, "id", "split", "y", most).count() == min(most, 120)


def test_scaler_keeps_distance_from_a_constant(spark):
    df = spark.createDataFrame([("train", 5.0), ("train", 5.0), ("test", 9.0), ("test", None)], "split string, x double")
    scaled = features.standardized(df, ["x"], features.moments(df, ["x"]))
    assert [r[0] for r in df.select(scaled["x"]).collect()] == [0.0, 0.0, 4.0, 0.0]


def test_unseen_level_is_zeros(spark):
    df = spark.createDataFrame([("train", "a"), ("train", None), ("test", "z")], "split string, c string")
    hot = features.one_hot(features.levels(df, ["c"]))
    assert list(hot) == ["c=__MISSING__", "c=a"]
    assert [tuple(r) for r in df.select(*hot.values()).collect()] == [(0.0, 1.0), (1.0, 0.0), (0.0, 0.0)]


def test_pca_keeps_products(spark):
    x = np.random.default_rng(0).normal(size=(40, 5))
    df = spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(x)], "id long, v array<double>")
    got = np.array([r.v for r in features.pca(df, "v", 4).orderBy("id").collect()])
    centred = x - x.mean(0)
    best = np.linalg.svd(centred)[2][:4]
    assert got.shape == (40, 4)
    np.testing.assert_allclose(got @ got.T, centred @ best.T @ best @ centred.T, atol=1e-8)
    assert len(features.pca(df, "v", 5, strict=True).first()["v"]) == 5
    assert features.pca(df.limit(2), "v", 4).first()["v"] == df.first()["v"]


VECTORS = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, [0.0, 1.0]), (4, [1.0, 1.0])]


@pytest.mark.parametrize("block", [2, 100])
@pytest.mark.parametrize("metric", ["cosine", "euclidean"])
def test_knn_against_all_pairs(spark, block, metric):
    df = spark.createDataFrame(VECTORS, "id long, v array<double>")
    got = rows(knn.knn(df, "id", "v", 2, metric, block))
    v = np.array([x for _, x in VECTORS])
    table = np.round(knn.METRICS[metric](v, v), 6) + 0.0
    wanted = sorted((i, j, float(table[i, j])) for i in range(5) for j in sorted((j for j in range(5) if j != i), key=lambda j: (-table[i, j], j))[:2])
    assert got == wanted


def test_knn_of_few_rows(spark):
    df = spark.createDataFrame(VECTORS, "id long, v array<double>")
    assert knn.knn(df.limit(1), "id", "v", 3).count() == 0
    assert knn.knn(df.limit(0), "id", "v", 3).count() == 0
    assert knn.knn(df, "id", "v", 0).count() == 0
    assert knn.knn(df, "id", "v", 50).count() == 20


def test_edge_forms(spark):
    e = edges(spark, [(0, 1, 0.9), (1, 0, 0.7), (1, 2, 0.5), (3, 3, 1.0)])
    assert rows(graph.symmetrized(e)) == [(0, 1, 0.9), (1, 0, 0.7), (1, 2, 0.5), (2, 1, 0.5), (3, 3, 1.0)]
    assert rows(graph.mutual(e)) == [(0, 1, 0.9), (1, 0, 0.7), (3, 3, 1.0)]
    assert rows(graph.strongest(e, 2)) == [(0, 1, 0.9), (3, 3, 1.0)]
    g = Graph(nodes(spark, 5), e)
    assert rows(graph.isolated(g)) == [(4,)]
    assert graph.self_loops(g, "none").columns == ["src", "dst", "score"]
    assert (4, 4) in rows(graph.self_loops(g, "isolated_only"))
    assert graph.self_loops(g, "all").count() == 8
    with pytest.raises(ValueError):
        graph.directedness(e, "sideways")


def test_path_degrees(spark):
    g = Graph(nodes(spark, 4), edges(spark, [(0, 1, 1), (1, 2, 1)]))
    assert rows(metrics.undirected_degrees(g), "id", "deg_u") == [(0, 2), (1, 4), (2, 2), (3, 0)]
    assert rows(metrics.isolated_nodes(g)) == [(1, 25.0)]
    assert rows(metrics.component_sizes(g)) == [(2, 0.75)]


def test_graph_without_edges(spark):
    g = Graph(nodes(spark, 3), spark.createDataFrame([], "src long, dst long, score double"))
    assert rows(metrics.component_sizes(g)) == [(3, 0.333333)]
    assert metrics.graph_stats(g).first()["density"] == 0.0


@settings(max_examples=5, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.tuples(st.integers(0, 30), st.integers(0, 30)), max_size=40))
def test_components_are_least_reachable(spark, pairs):
    label = list(range(31))
    for _ in range(31):
        for a, b in pairs:
            label[a] = label[b] = min(label[a], label[b])
    e = spark.createDataFrame([(a, b) for a, b in pairs], "src long, dst long")
    assert rows(components(nodes(spark, 31), e)) == list(enumerate(label))


def test_ring_is_linear_in_the_group(spark):
    df = spark.createDataFrame([(i, "x") for i in range(6)] + [(9, "solo"), (10, None), (11, "nan")], "id long, e string")
    got = rows(graph.shared_entity_ring(df, "id", ["e", "none"], 2), "src", "dst")
    assert got == sorted((i, (i + t) % 6) for i in range(6) for t in (1, 2))


def test_stars_around_hot_nodes(spark, monkeypatch):
    """With every node of two edges and more taken for hot, and dealt by broadcast, the result stays."""
    from meshwork.operators import components as module

    draws = random.Random(2)
    pairs = [(0, i) for i in range(1, 25)] + [(draws.randrange(25, 60), draws.randrange(25, 60)) for _ in range(25)]
    e = spark.createDataFrame(pairs, "src long, dst long")
    wanted = rows(components(nodes(spark, 60), e))
    monkeypatch.setattr(module, "MANY_EDGES", 1)
    monkeypatch.setattr(module, "HOT_SHARE", 40)
    assert rows(components(nodes(spark, 60), e)) == wanted


def test_stored_tables_are_deleted(spark):
    from meshwork.sources import shared

    before = shared.written(spark)
    kept, gone = shared.stored(spark.range(3), "kept"), shared.stored(spark.range(3), "gone")
    shared.discard(gone)
    assert shared.written(spark) - before == {kept._stored_at} and kept.count() == 3
    shared.release(spark, before)
    assert shared.written(spark) == before


def test_groups_of_equal_hash_text_stay_apart(spark):
    df = spark.createDataFrame([("a", None, 1), (None, "a", 2), (None, None, 3), ("a", None, 4), (None, None, 5)], "x string, y string, i int")
    got = ranked(df, ["x", "y"], F.col("i"), [F.col("i")])
    assert rows(got, "i", "rn", "n") == [(1, 1, 2), (2, 1, 1), (3, 1, 2), (4, 2, 2), (5, 2, 2)]


def test_too_many_levels_are_an_error(spark, monkeypatch):
    monkeypatch.setattr(features, "MAX_LEVELS", 3)
    df = spark.createDataFrame([("train", str(i), "x") for i in range(4)], "split string, many string, one string")
    assert features.levels(df, ["one"]) == {"one": ["x"]}
    with pytest.raises(ValueError, match="many"):
        features.levels(df, ["one", "many"])


def test_uncentred_features_keep_their_mean(spark):
    df = spark.createDataFrame([(0, 0, "train", 1.0), (1, 1, "train", 3.0), (2, 0, "test", 5.0)], "id long, y int, split string, x double")
    got = features.feature_matrix(df, "id", "y", ["x"], [], cosine=False, centred=False)
    assert rows(got, "id", "v") == [(0, [1.0]), (1, [3.0]), (2, [5.0])]


def test_first_of_repeated_edges_stays(spark):
    e = spark.createDataFrame([(0, 1, 0.2, 0), (0, 1, 0.9, 1), (1, 0, 0.5, 0)], "src long, dst long, score double, turn int")
    assert rows(graph.adjacency(e, order="turn")) == [(0, 1, 0.2), (1, 0, 0.5)]
    assert rows(graph.adjacency(e)) == [(0, 1, 0.9), (1, 0, 0.5)]


def test_graph_checks_of_pruned_and_empty_graphs(spark):
    g = Graph(nodes(spark, 4).withColumn("y", F.lit(1)).withColumn("split", F.lit("train")), edges(spark, [(0, 1, 1)]))
    bad = lambda graph_, k: {r.rule for r in checks.graph_violations(graph_, "y", "split", k).collect() if r.violations}
    assert bad(g, 3) == {"edge_count_near_nodes_times_k"} and bad(g, None) == set()
    assert bad(Graph(g.nodes.limit(0), g.edges.limit(0)), 3) == set()


def test_typed_texts(spark):
    df = spark.createDataFrame([("1", " 2.5", "x", None, "1"), (None, "3", "4", None, "1e400")], "a string, b string, c string, d string, e string")
    assert [f.dataType.simpleString() for f in typed_texts(df).schema] == ["bigint", "double", "string", "string", "double"]


def test_folders_are_found_below_bases(spark, tmp_path):
    (tmp_path / "base/data").mkdir(parents=True)
    assert resolved(spark, "data", (str(tmp_path), f"{tmp_path}/base")) == f"{tmp_path}/base/data"
    assert resolved(spark, str(tmp_path), ()) == str(tmp_path)
    with pytest.raises(FileNotFoundError):
        resolved(spark, "data", (str(tmp_path),))


@pytest.mark.parametrize("k", [1, 3, 40])
def test_best_of_tied_scores(k):
    draws = np.random.default_rng(k)
    table, ids = draws.integers(0, 4, (9, 30)) / 4, draws.permutation(30)
    own = ids[:9]
    got = knn._best(table.copy(), own, ids, k)
    wanted = [(i, j) for i in range(9) for j in sorted((j for j in range(30) if ids[j] != own[i]), key=lambda j: (-table[i, j], ids[j]))[:k]]
    assert list(zip(got[0].tolist(), got[1].tolist())) == wanted


def test_one_class_has_no_area(spark):
    df = spark.createDataFrame([(1, 0.5), (1, 0.7)], "y int, p double")
    assert rows(evaluate.ranking_scores(df, "y", "p")) == [(None, None)]
    assert evaluate.class_weight(df, "y").first()["pos_weight"] == 1.0


def test_ranking_scores_with_ties(spark):
    data = [(1, 0.9), (0, 0.9), (1, 0.4), (0, 0.1), (0, 0.4)]
    df = spark.createDataFrame(data, "y int, p double")
    pairs = [(a > b) + 0.5 * (a == b) for y, a in data if y for z, b in data if not z]
    assert evaluate.ranking_scores(df, "y", "p").first()["auc_roc"] == round(sum(pairs) / len(pairs), 6)


@pytest.mark.parametrize("model", ["gcn", "gat"])
def test_gradients_by_differences(model):
    draws = np.random.default_rng(1)
    n, src, dst = 6, np.array([0, 1, 2, 3, 4, 5, 0]), np.array([1, 2, 0, 4, 3, 0, 5])
    x, y, rows_ = draws.normal(size=(n, 3)), np.array([0, 1, 0, 1, 1, 0]), np.arange(4)
    net = gnn.MODELS[model](n, src, dst, 3, 4, draws)
    loss = lambda: gnn.weighted_loss(net.forward(x, 1.0), y, rows_, 2.0)
    grads = net.backward(loss()[1])
    for p, g in zip(net.params, grads):
        for at in np.ndindex(p.shape):
            kept = p[at]
            p[at] = kept + 1e-6
            up = loss()[0]
            p[at] = kept - 1e-6
            down = loss()[0]
            p[at] = kept
            assert abs((up - down) / 2e-6 - g[at]) < 1e-5


def test_failed_runs_are_rows_where_asked(spark):
    n = spark.createDataFrame([("g", 0, [1.0], 1, "train"), ("g", 1, [0.0], 0, "train")], "graph_id string, id long, v array<double>, y_bin int, split string")
    e = spark.createDataFrame([("g", 0, 99)], "graph_id string, src long, dst long")
    got = gnn.train_runs(n, e, [0], gnn.Training(epochs=1), strict=False).collect()
    assert len(got) == 1 and got[0]["error"]


def test_sources(spark, tmp_path):
    (tmp_path / "a.txt").write_text("1,tcp,x\n2,udp,y\n")
    (tmp_path / "b.csv").write_text("k;v\n1;NA\n2;-\n")
    df = with_provenance(read_headerless(spark, str(tmp_path / "a.txt"), ("a", "b", "c")), "train_file")
    assert rows(df, "a", "_source_file", "_split_source") == [("1", "a.txt", "train_file"), ("2", "a.txt", "train_file")]
    with pytest.raises(ValueError):
        read_headerless(spark, str(tmp_path / "a.txt"), ("a", "b"))
    assert [r.v for r in read_with_header(spark, str(tmp_path / "b.csv"), ";").orderBy("k").collect()] == [None, "-"]
    assert missing_files(spark, [str(tmp_path / "a.txt"), str(tmp_path / "zzz")]) == [str(tmp_path / "zzz")]
    lines = spark.createDataFrame([("a,b,c",), ("a\tb",), ("plain",), ("a;b,c",)], "x string")
    assert [r[0] for r in lines.select(best_delimiter(F.col("x"))).collect()] == [",", "\t", ",", ","]


def test_stores(spark, tmp_path):
    g = Graph(nodes(spark, 3), edges(spark, [(0, 1, 0.5)]))
    store.write_graph(g, f"{tmp_path}/g", metrics.density_reciprocity(g), {"k": 8})
    back, config = store.read_graph(spark, f"{tmp_path}/g")
    assert rows(back.edges) == [(0, 1, 0.5)] and config == {"k": 8}
    df = spark.createDataFrame([(1, "train"), (2, "val")], "id int, split string")
    store.write_processed(df, f"{tmp_path}/p")
    assert store.read_processed(spark, f"{tmp_path}/p", "val").count() == 1
    with pytest.raises(ValueError):
        store.read_processed(spark, f"{tmp_path}/p", "holdout")
    made = []
    for _ in range(2):
        assert store.cached(spark, f"{tmp_path}/c", {"a": 1}, lambda: made.append(1) or df).count() == 2
    assert made == [1]
    record = {"name": "x", "items": ["a", 1], "none": None}
    assert store.parse_flat_yaml("# note\n" + store.format_flat_yaml(record)) == record


def test_streamed_classes(spark, tmp_path):
    from meshwork.streaming.classes import windowed_classes

    df = spark.createDataFrame([("2024-01-01 10:00:00", "a"), ("2024-01-01 11:00:00", None), ("2024-01-05 00:00:00", "b")], "ts string, label string")
    df.withColumn("ts", F.to_timestamp("ts")).coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("ts timestamp, label string").parquet(f"{tmp_path}/in")
    q = windowed_classes(stream, "ts", "label").writeStream.outputMode("complete").format("memory").queryName("classes").start()
    q.processAllAvailable()
    q.stop()
    assert rows(spark.table("classes"), "class", "count") == [("<NA>", 1), ("a", 1), ("b", 1)]
