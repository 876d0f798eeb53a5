"""From raw files to analysed results, on files made here."""

from __future__ import annotations

import glob
import random

import numpy as np
import pytest

from meshwork.__main__ import parser
from meshwork.operators import evaluate, gnn
from meshwork.plans import jobs
from meshwork.sources import store
from meshwork.sources.catalog import KDD_COLUMNS


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    root = tmp_path_factory.mktemp("jobs")
    (root / "raw/kdd").mkdir(parents=True)
    draws = random.Random(4)
    for name, n in (("KDDTrain+.txt", 80), ("KDDTest+.txt", 30)):
        lines = []
        for _ in range(n):
            bad = draws.random() < 0.4
            row = {c: f"{draws.random() + bad:.3f}" for c in KDD_COLUMNS} | {"protocol_type": draws.choice(("tcp", "udp")), "service": "http", "flag": "SF", "land": "0", "label": "smurf." if bad else "normal.", "difficulty_level": "3"}
            lines.append(",".join(row[c] for c in KDD_COLUMNS))
        (root / "raw/kdd" / name).write_text("\n".join(lines) + "\n")
    return str(root)


def test_from_files_to_results(spark, folder):
    raw, schemas, processed, built = (f"{folder}/{x}" for x in ("raw", "schemas", "processed", "graphs"))
    assert jobs.inspect(spark, raw, schemas) == ["kdd"]
    document = jobs.prepare_dataset(spark, "kdd", raw, schemas, processed)
    assert sum(document["split_counts"].values()) == 110 and document["split_counts"]["test"] == 30
    assert "label" not in document["roles"]["features"] and "protocol_type" not in document["roles"]["features"]
    assert len(document["roles"]["numeric"]) == 36 and document["roles"]["categorical"] == []
    profiled = store.read_json(spark, f"{schemas}/kdd/profile.json")
    assert "duration" in {r["column_name"] for r in profiled["numeric"]} and "service" in {r["column_name"] for r in profiled["categorical"]}
    assert all(r.violations == 0 for r in jobs.check_processed(spark, processed, "kdd").collect())
    paths = jobs.build_graphs(spark, "kdd", processed, built, ks=(3, 5), pca_dim=8)
    assert all(r.violations == 0 for r in jobs.check_graphs(spark, paths).collect())
    stats = spark.read.parquet(f"{paths[0]}/stats").first()
    assert (stats.num_nodes, stats.num_edges) == (110, 330)
    assert jobs.build_graphs(spark, "kdd", processed, built, ks=(3, 5), pca_dim=8) == paths
    budget = jobs.build_budget_graphs(spark, "kdd", processed, built, budgets=(2,), method="mutual", pca_dim=4, max_nodes=60)
    assert store.read_graph(spark, budget[0])[1]["target_edges"] >= 100
    jobs.train(spark, budget, f"{folder}/results", seeds=(0, 1), epochs=3, hidden=4)
    flat = jobs.analyse(spark, f"{folder}/results", f"{folder}/analysis")
    assert flat.count() == 2 and {r.method for r in flat.collect()} == {"mutual"}
    assert jobs.train(spark, budget, f"{folder}/results", model="gat", seeds=(1, 2), epochs=2, hidden=4).count() == 2
    jobs.train(spark, budget, f"{folder}/results", model="gat", seeds=(2,), epochs=2, hidden=4)
    (run,) = glob.glob(f"{folder}/results/dataset=kdd/model=gcn/*/seed=0")
    with open(f"{run}/broken.json", "w") as out:
        out.write('{"epochs_ran": ')
    with pytest.warns(UserWarning, match="1 unreadable"):
        both = jobs.analyse(spark, f"{folder}/results", f"{folder}/analysis").collect()
    assert sorted((r.model, r.seed) for r in both) == [("gat", 1), ("gat", 2), ("gcn", 0), ("gcn", 1)]
    with pytest.raises(ValueError):
        jobs.train(spark, budget * 2, f"{folder}/results")
    assert spark.read.csv(f"{folder}/analysis/mean_mcc", header=True).count() == 2


def test_results_have_areas_and_costs(spark, folder):
    processed, built, draws = f"{folder}/processed2", f"{folder}/graphs2", random.Random(5)
    rows = [(i, ("train", "train", "val", "test")[i // 2 % 4], i % 2, draws.random() + i % 2, draws.random(), draws.random()) for i in range(64)]
    store.write_processed(spark.createDataFrame(rows, "row_id long, split string, y_bin int, a double, b double, c double"), f"{processed}/kdd/data")
    store.write_json(spark, f"{processed}/kdd/metadata.json", {"roles": {"numeric": ["a", "b", "c"], "categorical": []}})
    budget = jobs.build_budget_graphs(spark, "kdd", processed, built, budgets=(2,), method="mutual", pca_dim=2, max_nodes=60)
    assert store.read_graph(spark, budget[0])[1]["edge_creation_time_seconds"] > 0
    jobs.train(spark, budget, f"{folder}/results2", seeds=(0, 1), epochs=3, hidden=4)
    for r in spark.read.json(f"{folder}/results2").collect():
        n = store.read_graph(spark, budget[0])[0].nodes.where("split = 'test'").count()
        assert r.test.tp + r.test.tn + r.test.fp + r.test.fn == n
        assert abs(r.test.pred_pos_rate - (r.test.tp + r.test.fp) / n) < 1e-9 and abs(r.test.y_pos_rate - (r.test.tp + r.test.fn) / n) < 1e-9
        assert r.total_training_time_seconds >= 3 * r.training_time_per_epoch_seconds > 0
    jobs.analyse(spark, f"{folder}/results2", f"{folder}/analysis2")
    read = lambda name: spark.read.csv(f"{folder}/analysis2/{name}", header=True, inferSchema=True).collect()
    (auc,), (cost,), (both,) = read("mean_auc"), read("mean_cost"), read("cost_quality")
    assert 0 <= auc.auc_pr <= 1 and 0 <= auc.auc_roc <= 1
    assert cost.construct_seconds > 0 and cost.train_seconds > 0
    assert abs(both.total_cost - cost.construct_seconds - cost.train_seconds) < 1e-5


def test_built_graphs_keep_their_time(spark, folder):
    processed, built = f"{folder}/processed3", f"{folder}/graphs3"
    rows = [(i, ("train", "val", "test")[i % 3], i % 2, i * 0.37 % 1, i * 0.61 % 1) for i in range(30)]
    store.write_processed(spark.createDataFrame(rows, "row_id long, split string, y_bin int, a double, b double"), f"{processed}/kdd/data")
    store.write_json(spark, f"{processed}/kdd/metadata.json", {"roles": {"numeric": ["a", "b"], "categorical": []}})
    (path,) = jobs.build_graphs(spark, "kdd", processed, built, ks=(3,))
    g, config = store.read_graph(spark, path)
    assert g.edges.count() == 90 and config["edge_creation_time_seconds"] > 0
    assert all(config[f"{stage}_seconds"] > 0 for stage in ("feature", "knn", "ops", "metrics"))
    assert jobs.build_graphs(spark, "kdd", processed, built, ks=(3,)) == [path]
    assert store.read_graph(spark, path)[1] == config
    changed = [(i, s, y, a + 5 * y, b) for i, s, y, a, b in rows]
    store.write_processed(spark.createDataFrame(changed, "row_id long, split string, y_bin int, a double, b double"), f"{processed}/kdd/data")
    jobs.build_graphs(spark, "kdd", processed, built, ks=(3,))
    anew, now = store.read_graph(spark, path)
    assert now["data"] != config["data"] and anew.nodes.orderBy("id").first()["v"] != [0.0, 0.0]
    jobs.build_graphs(spark, "kdd", processed, built, ks=(3,), centred=False, overwrite=True)
    assert store.read_graph(spark, path)[1]["centred"] is False


def test_metric_record_equals_the_one_over_tables(spark):
    draws = random.Random(9)
    rows = [(draws.randrange(2), draws.randrange(20) / 20) for _ in range(300)]
    got = gnn.metric_record(np.array([r[0] for r in rows]), np.array([r[1] for r in rows]), 0.4)
    wanted = evaluate.metric_record(spark.createDataFrame(rows, "y int, p double"), "y", "p", 0.4).first().asDict()
    assert wanted.pop("threshold") == 0.4 and set(got) == set(wanted)
    assert all(abs(got[k] - wanted[k]) < 1e-6 for k in wanted)
    assert gnn.ranking_areas(np.array([1, 1]), np.array([0.2, 0.3])) == (None, None)


def test_ratios_and_names_are_checked(spark, folder):
    with pytest.raises(ValueError):
        jobs.prepare_dataset(spark, "kdd", folder, folder, folder, val_ratio=1.0)
    with pytest.raises(ValueError):
        jobs.build_budget_graphs(spark, "kdd", folder, folder, method="other")


def test_command_line():
    got = vars(parser().parse_args(["build-graphs", "--name", "kdd", "--processed-dir", "p", "--out-dir", "o", "--ks", "4", "8", "--overwrite", "--no-centred"]))
    assert got["ks"] == [4, 8] and got["overwrite"] and got["max_nodes"] is None and got["graph_scope"] == "transductive" and got["centred"] is False
    assert vars(parser().parse_args(["build-graphs", "--name", "kdd", "--processed-dir", "p", "--out-dir", "o"]))["centred"] is True
