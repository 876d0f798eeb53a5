"""SQL that gives the same rows as the queries, for DuckDB over the same tables."""

from __future__ import annotations

from .queries import A_DST, A_SRC


def r6(x: str) -> str:
    """Six places, and never a negative zero."""
    return f"(round({x}, 6) + 0.0::double)"


def knn(k: int, score: str | None = None) -> str:
    """A list of common table expressions that ends in knn(src, dst, score)."""
    score = score or "list_cosine_similarity(a.v, b.v)"
    return f"""
    emb AS (SELECT vec_id AS id, embedding::double[] AS v, label FROM embeddings),
    pairs AS (SELECT a.id AS src, b.id AS dst, {r6(score)} AS score FROM emb a, emb b WHERE a.id <> b.id),
    ordered AS (SELECT *, row_number() OVER (PARTITION BY src ORDER BY score DESC, dst) AS rn FROM pairs),
    knn AS (SELECT src, dst, score FROM ordered WHERE rn <= {k})"""


MUTUAL = "mutual AS (SELECT k.* FROM knn k WHERE EXISTS (SELECT 1 FROM knn r WHERE r.src = k.dst AND r.dst = k.src))"
SYM = """both_ways AS (SELECT src, dst, score, 0 AS turn FROM knn UNION ALL SELECT dst, src, score, 1 FROM knn),
    sym AS (SELECT src, dst, score FROM (SELECT *, row_number() OVER (PARTITION BY src, dst ORDER BY turn, score DESC) AS first FROM both_ways) WHERE first = 1)"""
UNDIRECTED = "und AS (SELECT src, dst FROM {edges} UNION SELECT dst, src FROM {edges})"
DEGREE = """deg AS (SELECT emb.id, count(und.src) AS d FROM emb LEFT JOIN und ON und.src = emb.id GROUP BY emb.id)"""
REACH = """reach AS (SELECT id, id AS other FROM emb UNION SELECT reach.id, und.dst FROM reach JOIN und ON und.src = reach.other),
    comp AS (SELECT id, min(other) AS component FROM reach GROUP BY id)"""


def half_even(n: str, ratio: str, least: int = 1) -> str:
    return f"least({n}, greatest({least}, round_even({n}::double * {ratio}, 0)::bigint))"


EVENTS = "ev AS (SELECT *, event_type AS y_multi, (event_type = 'error')::int AS y_bin FROM events)"
ORDERS = "ord AS (SELECT *, nullif(o_orderstatus, 'P') AS status, CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_totalprice END AS price FROM orders)"


def drawn(source: str, key: str, by: str, ratio: float, seed: int, name: str) -> str:
    """Expressions name_r (ranks) and name (with picked)."""
    return f"""{name}_r AS (SELECT *, row_number() OVER (PARTITION BY {by} ORDER BY md5(concat('{seed}:', {key})), {key}) AS rn, count(*) OVER (PARTITION BY {by}) AS n FROM {source}),
    {name} AS (SELECT * EXCLUDE (rn, n), rn <= {half_even("n", str(ratio))} AS picked FROM {name}_r)"""


def threeway(source: str, key: str, by: str) -> str:
    """Expressions that end in parted(..., split)."""
    return f"""{drawn(source, key, by, 0.2, 42, "tested")},
    rest AS (SELECT * EXCLUDE (picked) FROM tested WHERE NOT picked),
    {drawn("rest", key, by, 0.1, 43, "carved")},
    parted AS (SELECT * EXCLUDE (picked), 'test' AS split FROM tested WHERE picked
               UNION ALL SELECT * EXCLUDE (picked), CASE WHEN picked THEN 'val' ELSE 'train' END FROM carved)"""


ENTITY_SPLIT = f"""{EVENTS},
    users AS (SELECT DISTINCT user_id AS u FROM ev WHERE user_id IS NOT NULL),
    user_ranks AS (SELECT u, row_number() OVER (ORDER BY md5(concat('42:', u)), u) AS rn, count(*) OVER () AS n FROM users),
    chosen AS (SELECT u FROM user_ranks WHERE rn <= greatest(1, round_even(n * 0.2, 0))),
    rest AS (SELECT * FROM ev WHERE user_id IS NULL OR user_id NOT IN (SELECT u FROM chosen)),
    {drawn("rest", "event_id", "y_multi", 0.1, 43, "carved")},
    parted AS (SELECT *, 'test' AS split FROM ev WHERE user_id IN (SELECT u FROM chosen)
               UNION ALL SELECT * EXCLUDE (picked), CASE WHEN picked THEN 'val' ELSE 'train' END FROM carved)"""

EVENT_SPLIT = f"{EVENTS}, {threeway('ev', 'event_id', 'y_multi')}"
ORDER_SPLIT = f"{ORDERS}, {threeway('ord', 'o_orderkey', 'o_orderpriority')}"

RING = """long AS ({long}),
    placed AS (SELECT *, row_number() OVER (PARTITION BY entity_column, value ORDER BY id) - 1 AS pos, count(*) OVER (PARTITION BY entity_column, value) AS size FROM long WHERE value IS NOT NULL),
    steps AS (SELECT p.*, t.step FROM placed p, (SELECT unnest(range(1, {cap} + 1)) AS step) t WHERE p.size > 1 AND t.step <= p.size - 1)
SELECT s.id AS src, t.id AS dst, s.entity_column
FROM steps s JOIN placed t ON s.entity_column = t.entity_column AND s.value = t.value AND t.pos = (s.pos + s.step) % s.size"""

SCORED = "sc AS (SELECT doc_id, l.quality AS y, least(d.n_chars, 8000) / 8000.0::double AS p FROM documents d JOIN labels l USING (doc_id))"
CELLS = "cells AS (SELECT count(*) FILTER (y = 1 AND p >= 0.25) AS tp, count(*) FILTER (y = 0 AND NOT p >= 0.25) AS tn, count(*) FILTER (y = 0 AND p >= 0.25) AS fp, count(*) FILTER (y = 1 AND NOT p >= 0.25) AS fn FROM sc)"
MCC = r6("CASE WHEN (tp::double + fp) * (tp + fn) * (tn + fp) * (tn + fn) = 0 THEN 0 ELSE (tp::double * tn - fp::double * fn) / sqrt((tp::double + fp) * (tp + fn) * (tn + fp) * (tn + fn)) END")
THRESHOLDS = f"""th AS (SELECT i / 199.0::double AS t FROM (SELECT unnest(range(0, 200)) AS i)),
    table_ AS (SELECT t, count(*) FILTER (y = 1 AND p >= t) AS tp, count(*) FILTER (y = 0 AND p < t) AS tn, count(*) FILTER (y = 0 AND p >= t) AS fp, count(*) FILTER (y = 1 AND p < t) AS fn FROM th, sc GROUP BY t),
    tries AS (SELECT {r6("t")} AS threshold, tp, tn, fp, fn, {MCC} AS mcc FROM table_)"""
RANKS = f"""grouped AS (SELECT p AS score, count(*) FILTER (y = 1) AS gp, count(*) FILTER (y = 0) AS gn FROM sc GROUP BY p),
    summed AS (SELECT *, sum(gp) OVER w AS tp, sum(gn) OVER w AS fp, sum(gp) OVER () AS pp, sum(gn) OVER () AS nn FROM grouped WINDOW w AS (ORDER BY score DESC ROWS UNBOUNDED PRECEDING)),
    areas AS (SELECT {r6("sum(gp::double * (nn - fp) + gp::double * gn / 2) / (max(pp)::double * max(nn))")} AS auc_roc, {r6("sum(gp::double * tp / (tp + fp)) / max(pp)::double")} AS auc_pr FROM summed)"""

GCN = """pairs_ AS (SELECT src, dst, count(*)::double AS w FROM (SELECT src, dst FROM knn UNION ALL SELECT id, id FROM emb) GROUP BY src, dst),
    rows_ AS (SELECT src AS id, greatest(sum(w), 1.0) AS d FROM pairs_ GROUP BY src),
    adj AS (SELECT src, dst, w / sqrt(a.d) / sqrt(b.d) AS weight FROM pairs_ JOIN rows_ a ON a.id = src JOIN rows_ b ON b.id = dst)"""
CELLS_OF = "flat AS (SELECT id, unnest(range(0, len(v))) AS pos, unnest(v) AS x FROM emb)"


def _dot(a: tuple[float, ...]) -> str:
    return f"list_dot_product(v, [{', '.join(str(a[i % len(a)]) for i in range(64))}]::double[])"


GAT = f"""own AS (SELECT id, {_dot(A_SRC)} AS s, {_dot(A_DST)} AS d FROM emb),
    raw AS (SELECT k.src, k.dst, a.s + b.d AS e FROM knn k JOIN own a ON a.id = k.src JOIN own b ON b.id = k.dst),
    leaky AS (SELECT src, dst, CASE WHEN e > 0 THEN e ELSE 0.2 * e END AS e FROM raw),
    shifted AS (SELECT src, dst, exp(e - max(e) OVER ()) AS z FROM leaky),
    att AS (SELECT src, dst, z / (sum(z) OVER (PARTITION BY dst) + 1e-9) AS alpha FROM shifted)"""

RESULTS = """res AS (SELECT 'events' AS dataset, CASE WHEN event_id % 2 = 0 THEN 'gcn' ELSE 'gat' END AS model, 'sweep_' || event_type AS graph_id, event_id % 3 AS seed,
        event_type AS method, CASE WHEN event_id % 5 <> 0 THEN [4, 8, 16, 32][event_id % 4 + 1]::bigint END AS budget,
        {m} AS mcc_val, {m} AS mcc_test, CASE WHEN event_id % 13 <> 0 THEN (event_id % 17)::double END AS edge_creation_time_seconds, 8 * event_id AS estimated_graph_memory_bytes,
        (event_id % 19)::double AS total_training_time_seconds, CASE WHEN event_id % 11 <> 0 THEN {m} END AS auc_pr_test, CASE WHEN event_id % 11 <> 0 THEN {m} END AS auc_roc_test FROM events),
    keyed AS (SELECT * FROM res WHERE budget IS NOT NULL AND method IS NOT NULL)""".replace("{m}", r6("value % 1"))
GROUPED = "dataset, model, budget, method"


def _profile(table: str, columns: list[str], fields: str) -> str:
    return " UNION ALL ".join(f"SELECT '{c}' AS column_name, {fields.replace('$', c)} FROM {table}" for c in columns)


def _one_hot(source: str, key: str, columns: dict[str, str]) -> str:
    return " UNION ALL ".join(f"SELECT {key}, '{c}=' || level AS feature, (coalesce({c}, '__MISSING__') = level)::int::double AS value FROM {source}, ({levels})" for c, levels in columns.items())


def _moments(columns: list[str]) -> str:
    return "mom AS (SELECT " + ", ".join(f"coalesce(avg({c}), 0) AS m_{c}, coalesce(nullif(stddev_pop({c}), 0), 1) AS s_{c}" for c in columns) + " FROM parted WHERE split = 'train')"


def _train_levels(c: str) -> str:
    return f"SELECT DISTINCT coalesce({c}, '__MISSING__') AS level FROM parted WHERE split = 'train'"


def _share(n: str, total: str) -> str:
    return r6(f"100.0::double * {n} / {total}")


STATS = {
    "density": r6("e::double / greatest(n * (n - 1), 1)"),
    "reciprocity": r6("answered::double / greatest(e, 1)"),
    "mean": r6("e::double / n"),
}


def _density(edges: str) -> str:
    return f"""counts AS (SELECT (SELECT count(*) FROM emb) AS n, (SELECT count(*) FROM {edges}) AS e,
        (SELECT count(*) FROM {edges} a WHERE EXISTS (SELECT 1 FROM {edges} b WHERE b.src = a.dst AND b.dst = a.src)) AS answered),
    density AS (SELECT n AS num_nodes, e AS num_edges, {STATS["density"]} AS density, {STATS["reciprocity"]} AS reciprocity, {STATS["mean"]} AS mean_out_degree, {STATS["mean"]} AS mean_in_degree, {STATS["mean"]} AS achieved_avg_degree FROM counts)"""


DEGREE_STATS = f"""degrees AS (SELECT min(2 * d) AS degree_min, median(2 * d)::double AS degree_median, {r6("quantile_cont(2 * d, 0.95)")} AS degree_p95, max(2 * d) AS degree_max,
        min(d) AS undirected_degree_min, median(d)::double AS undirected_degree_median, {r6("quantile_cont(d, 0.95)")} AS undirected_degree_p95, max(d) AS undirected_degree_max FROM deg)"""
SIZES = f"""sizes AS (SELECT component, count(*) AS size FROM comp GROUP BY component),
    lcc AS (SELECT count(*) AS num_components, {r6("max(size)::double / sum(size)")} AS lcc_fraction FROM sizes)"""
ISOLATED = f"""alone AS (SELECT count(*) FILTER (d = 0) AS isolated_count, {r6("100.0::double * count(*) FILTER (d = 0) / greatest(count(*), 1)")} AS isolated_pct FROM deg)"""


def oracle_sql() -> dict[str, str]:
    near = f"WITH {knn(8)}"
    recursive = f"WITH RECURSIVE {knn(8)}"
    und_knn, und_mutual = UNDIRECTED.format(edges="knn"), UNDIRECTED.format(edges="mutual")
    sql = {
        "knn_cosine": f"{near} SELECT * FROM knn",
        "knn_euclidean": f"WITH {knn(8, 'exp(-list_distance(a.v, b.v))')} SELECT * FROM knn",
        "knn_budget_sweep": f"WITH {knn(32)} SELECT k, src, dst, score FROM ordered, (SELECT unnest([8, 16, 32])::bigint AS k) WHERE rn <= k",
        "knn_guarded": "SELECT 0::bigint AS edges",
        "knn_symmetric": f"{near}, {SYM} SELECT * FROM sym",
        "knn_mutual": f"{near}, {MUTUAL} SELECT * FROM mutual",
        "topm_budget": f"WITH {knn(16)} SELECT * FROM knn ORDER BY score DESC, src, dst LIMIT (SELECT count(*) * 4 FROM embeddings)",
        "prune_budget": f"{near}, {SYM} SELECT * FROM sym ORDER BY score DESC, src, dst LIMIT (SELECT count(*) * 4 // 2 FROM embeddings)",
        "edge_budgets": "SELECT d AS degree, floor(n * d)::bigint AS directed_edges, floor(n * d / 2)::bigint AS undirected_edges FROM (SELECT count(*) AS n FROM embeddings), (SELECT unnest([2.5, 4, 8, 16])::double AS d)",
        "dedupe_edges": f"{near} SELECT src, dst, arg_min(score, turn) AS score FROM (SELECT *, 0 AS turn FROM knn UNION ALL SELECT src, dst, {r6('score / 2')}, 1 FROM knn) GROUP BY src, dst",
        "directed_sym": f"{near}, {und_knn} SELECT * FROM und",
        "directed_mutual": f"{near}, {MUTUAL} SELECT src, dst FROM mutual",
        "selfloops_all": f"{near} SELECT src, dst FROM knn UNION SELECT id, id FROM emb",
        "selfloops_isolated": f"{near}, {MUTUAL}, {und_mutual} SELECT src, dst FROM mutual UNION SELECT id, id FROM emb WHERE id NOT IN (SELECT src FROM und)",
        "graph_ids": "SELECT 'base_sim_knn_k' || k || '_cosine_' || p || '_train_only' AS graph_id, 'sweep_mutual_d' || k || '_pca32' AS sweep_id FROM (SELECT unnest([8, 16, 32]) AS k), (SELECT unnest(['nopca', 'pca64']) AS p)",
        "shared_entity_ring_orders": "WITH " + RING.format(long="SELECT o_orderkey AS id, 'o_custkey' AS entity_column, o_custkey::varchar AS value FROM orders", cap=3),
        "shared_entity_ring_events": "WITH " + RING.format(long="SELECT event_id AS id, 'user_id' AS entity_column, user_id::varchar AS value FROM events UNION ALL SELECT event_id, 'event_type', event_type FROM events", cap=2),
        "node_degrees": f"{near} SELECT id, (SELECT count(*) FROM knn WHERE src = id) AS out_degree, (SELECT count(*) FROM knn WHERE dst = id) AS in_degree FROM emb",
        "undirected_view": f"{near}, {und_knn} SELECT * FROM und",
        "degree_stats": f"{near}, {und_knn}, {DEGREE}, {DEGREE_STATS} SELECT * FROM degrees",
        "density_reciprocity": f"{near}, {_density('knn')} SELECT * FROM density",
        "connected_components": f"{recursive}, {MUTUAL}, {und_mutual}, {REACH} SELECT * FROM comp",
        "lcc_fraction": f"{recursive}, {MUTUAL}, {und_mutual}, {REACH}, {SIZES} SELECT * FROM lcc",
        "isolated_nodes": f"{near}, {MUTUAL}, {und_mutual}, {DEGREE}, {ISOLATED} SELECT * FROM alone",
        "graph_bytes": f"{near} SELECT 8 * e AS edge_bytes, 16 * e AS edge_bytes_wide, 256 * n AS feature_bytes, 8 * e + 256 * n AS total_bytes, 20 * e AS memory_estimate FROM (SELECT count(*) AS e FROM knn), (SELECT count(*) AS n FROM emb)",
        "graph_stats": f"{recursive}, {MUTUAL}, {und_mutual}, {REACH}, {SIZES}, {DEGREE}, {ISOLATED}, {DEGREE_STATS}, {_density('mutual')} SELECT * FROM density, degrees, lcc, alone",
        "missing_profile": f"WITH {ORDERS} " + _profile("ord", ["o_orderkey", "status", "price"], f"count(*) AS n_rows, count(*) FILTER ($ IS NULL) AS n_missing, {_share('count(*) FILTER ($ IS NULL)', 'count(*)')} AS pct_missing"),
        "numeric_summary": _profile("lineitem", ["l_quantity", "l_extendedprice", "l_discount", "l_tax"], f"{r6('min($ + 0.0::double)')} AS min_value, {r6('max($ + 0.0::double)')} AS max_value, {r6('avg($)')} AS mean_value, {r6('stddev_pop($)')} AS std_value, {_share('count(*) FILTER ($ = 0)', 'count($)')} AS pct_zero"),
        "categorical_top10": f"""WITH {ORDERS}, vals AS ({_profile('ord', ['status', 'o_orderpriority', 'o_custkey'], "coalesce($::varchar, '<NA>') AS value")}),
            counts AS (SELECT column_name, value, count(*) AS count FROM vals GROUP BY column_name, value),
            ranked AS (SELECT *, row_number() OVER (PARTITION BY column_name ORDER BY count DESC, value) AS rank, count(*) OVER (PARTITION BY column_name) AS n_unique FROM counts)
            SELECT * FROM ranked WHERE rank <= 10""",
        "class_distribution": f"WITH {ORDERS} SELECT coalesce(status, '<NA>') AS class, count(*) AS count, {_share('count(*)', 'sum(count(*)) OVER ()')} AS pct FROM ord GROUP BY 1",
        "numeric_coercion": """WITH raw AS (SELECT o_orderkey::varchar AS key, o_orderpriority, CASE WHEN o_orderkey % 10 = 0 THEN 'n/a' ELSE o_totalprice::varchar END AS price FROM orders),
            ratios AS ("""
        + _profile("raw", ["key", "o_orderpriority", "price"], r6("count(try_cast($ AS double))::double / count($)") + " AS ratio")
        + ") SELECT *, ratio >= 0.95 AS is_numeric FROM ratios",
        "timestamp_detect": f"SELECT 'stime' AS column_name, 0.0::double AS success_pct, false AS chosen UNION ALL SELECT 'ts', 100.0, true UNION ALL SELECT 'ltime', {_share('count(*) FILTER (event_id % 2 = 0)', 'count(*)')}, false FROM events",
        "profile_sample": "SELECT event_id, user_id, (SELECT count(*) > 500 FROM events) AS sampled FROM events ORDER BY md5(concat('42:', event_id)), event_id LIMIT 500",
        "delimiter_sniff": "SELECT o_orderkey, chr(9) AS delimiter FROM orders",
        "detected_columns": "SELECT unnest(['entity', 'entity', 'label', 'split']) AS role, unnest(['event_type', 'user_id', 'y_multi', 'Set']) AS column_name",
        "type_suggestion": "SELECT CASE WHEN data_type IN ('BIGINT', 'INTEGER', 'DOUBLE', 'FLOAT', 'BOOLEAN') THEN 'numeric' ELSE 'categorical' END AS role, column_name FROM (SELECT column_name, column_type AS data_type FROM (DESCRIBE orders))",
        "label_clean": "SELECT event_id, lower(event_type) AS label, (lower(event_type) <> 'click')::int AS flag FROM events",
        "fill_missing": f"WITH {ORDERS} SELECT o_orderkey, coalesce(status, '__MISSING__') AS status, try_cast(o_orderpriority[1] AS double) AS priority FROM ord",
        "bool_hint": "SELECT event_id, (CASE WHEN event_id % 3 = 0 THEN 0 ELSE event_id % 2 END)::int AS land, event_type AS label FROM events",
        "drop_all_null": "SELECT event_id, event_type FROM events",
        "column_roles": "SELECT unnest(['label', 'label', 'label', 'meta', 'meta', 'meta', 'numeric', 'numeric', 'categorical']) AS role, unnest(['event_type', 'y_multi', 'y_bin', 'ts', 'user_id', '_split_source', 'event_id', 'value', 'props']) AS column_name",
        "union_of_files": "SELECT event_id, CASE WHEN event_id % 2 = 0 THEN value END AS value, CASE WHEN event_id % 2 = 0 THEN 'train_file' ELSE 'test_file' END AS _split_source, CASE WHEN event_id % 2 = 1 THEN user_id END AS user_id FROM events",
        "split_stratified": f"WITH {EVENTS}, {drawn('ev', 'event_id', 'y_multi', 0.1, 42, 'carved')} SELECT event_id, CASE WHEN picked THEN 'val' ELSE 'train' END AS split FROM carved",
        "split_by_file": f"WITH {EVENTS}, pool AS (SELECT * FROM ev WHERE event_id % 4 <> 0), {drawn('pool', 'event_id', 'y_multi', 0.1, 42, 'carved')} SELECT event_id, CASE WHEN picked THEN 'val' ELSE 'train' END AS split FROM carved UNION ALL SELECT event_id, 'test' FROM ev WHERE event_id % 4 = 0",
        "split_threeway": f"WITH {EVENT_SPLIT} SELECT event_id, split FROM parted",
        "split_entity_disjoint": f"WITH {ENTITY_SPLIT} SELECT event_id, split FROM parted",
        "sample_label": f"""WITH {EVENTS}, r AS (SELECT *, row_number() OVER (PARTITION BY y_bin ORDER BY md5(concat('42:', event_id)), event_id) AS rn, count(*) OVER (PARTITION BY y_bin) AS n, count(*) OVER () AS total FROM ev)
            SELECT event_id, y_bin FROM r WHERE total <= 501 OR rn <= {half_even('n', '(501.0::double / total)')} ORDER BY event_id LIMIT (SELECT CASE WHEN count(*) <= 501 THEN count(*) ELSE 501 END FROM events)""",
        "sample_split_label_topup": f"""WITH {EVENT_SPLIT}, r AS (SELECT *, row_number() OVER (PARTITION BY split, y_bin ORDER BY md5(concat('42:', event_id)), event_id) AS rn, count(*) OVER (PARTITION BY split, y_bin) AS n, count(*) OVER () AS total FROM parted),
            f AS (SELECT *, rn <= {half_even('n', '(503.0::double / total)')} AS flag FROM r), s AS (SELECT *, count(*) FILTER (flag) OVER () AS chosen FROM f)
            SELECT event_id, split, y_bin FROM s ORDER BY flag DESC, CASE WHEN chosen > 503 THEN event_id ELSE 0 END, md5(concat('42:', event_id)), event_id LIMIT 503""",
        "sample_grouped": f"""WITH {EVENT_SPLIT}, r AS (SELECT *, row_number() OVER (PARTITION BY split, y_bin ORDER BY md5(concat('42:', event_id)), event_id) AS rn, count(*) OVER (PARTITION BY split, y_bin) AS n, count(*) OVER () AS total FROM parted)
            SELECT event_id, split, y_bin FROM r WHERE rn <= {half_even('n', '(499.0::double / total)')}""",
        "split_positions": f"WITH {EVENT_SPLIT} SELECT event_id, split, row_number() OVER (ORDER BY event_id) - 1 AS pos FROM parted",
        "split_distribution": f"WITH {EVENT_SPLIT} SELECT split, y_multi AS class, count(*) AS count, {_share('count(*)', 'sum(count(*)) OVER (PARTITION BY split)')} AS pct FROM parted GROUP BY split, y_multi",
        "split_checks": f"""WITH {ENTITY_SPLIT}, varied AS (SELECT split, count(DISTINCT y_bin) > 1 AS ok FROM parted GROUP BY split)
            SELECT 'features_labels_disjoint' AS check_name, true AS passed UNION ALL SELECT 'label_varies_in_each_split', bool_and(ok) FROM varied
            UNION ALL SELECT 'no_empty_feature', count(value) > 0 FROM parted
            UNION ALL SELECT 'entities_train_test_disjoint', count(*) = 0 FROM (SELECT user_id FROM parted WHERE split = 'train' INTERSECT SELECT user_id FROM parted WHERE split = 'test')
            UNION ALL SELECT 'entities_val_test_disjoint', count(*) = 0 FROM (SELECT user_id FROM parted WHERE split = 'val' INTERSECT SELECT user_id FROM parted WHERE split = 'test')""",
        "scope_train_only": f"WITH {EVENT_SPLIT} SELECT split, count(*) AS rows FROM parted WHERE split IN ('train', 'val') GROUP BY split",
        "standardize_train": f"""WITH {ORDER_SPLIT}, {_moments(['price', 'o_custkey'])}
            SELECT o_orderkey, 'price' AS feature, {r6('(coalesce(price, m_price) - m_price) / s_price')} AS value FROM parted, mom UNION ALL SELECT o_orderkey, 'o_custkey', {r6('(o_custkey - m_o_custkey) / s_o_custkey')} FROM parted, mom""",
        "onehot_train_levels": f"WITH {ORDER_SPLIT} {_one_hot('parted', 'o_orderkey', {c: _train_levels(c) for c in ('status', 'o_orderpriority')})}",
        "dummies_null_indicator": f"""WITH {ORDERS}, m AS (SELECT avg(price) AS mean FROM ord)
            SELECT o_orderkey, 'price' AS feature, {r6('coalesce(price, mean)')} AS value FROM ord, m
            UNION ALL SELECT o_orderkey, 'status=' || level, coalesce((status = level)::int::double, 0.0) FROM ord, (SELECT DISTINCT status AS level FROM ord WHERE status IS NOT NULL)
            UNION ALL SELECT o_orderkey, 'status=null', (status IS NULL)::int::double FROM ord""",
        "feature_vectors": f"""WITH {ORDER_SPLIT}, {_moments(['price'])}, lev AS (SELECT level, row_number() OVER (ORDER BY level) AS pos FROM ({_train_levels('status')})),
            long AS (SELECT o_orderkey, 0::bigint AS pos, (coalesce(price, m_price) - m_price) / s_price AS x FROM parted, mom WHERE split IN ('train', 'val')
                     UNION ALL SELECT o_orderkey, pos, (coalesce(status, '__MISSING__') = level)::int::double FROM parted, lev WHERE split IN ('train', 'val')),
            lengths AS (SELECT o_orderkey, sqrt(sum(x * x)) AS len FROM long GROUP BY o_orderkey)
            SELECT o_orderkey, pos, {r6('x / CASE WHEN len = 0 THEN 1 ELSE len END')} AS value FROM long JOIN lengths USING (o_orderkey)""",
        "l2_normalize": f"""WITH emb AS (SELECT vec_id AS id, embedding::double[] AS v FROM embeddings), {CELLS_OF}, lengths AS (SELECT id, sqrt(sum(9 * x * x)) AS len FROM flat GROUP BY id)
            SELECT id, pos, {r6('3 * x / len')} AS value FROM flat JOIN lengths USING (id)""",
        "confusion": f"WITH {SCORED}, {CELLS} SELECT * FROM cells",
        "mcc": f"WITH {SCORED}, {CELLS} SELECT *, {MCC} AS mcc FROM cells",
        "threshold_table": f"WITH {SCORED}, {THRESHOLDS} SELECT * FROM tries",
        "threshold_search_mcc": f"WITH {SCORED}, {THRESHOLDS} SELECT * FROM tries ORDER BY mcc DESC, threshold LIMIT 1",
        "roc_auc": f"WITH {SCORED}, {RANKS} SELECT auc_roc FROM areas",
        "average_precision": f"WITH {SCORED}, {RANKS} SELECT auc_pr FROM areas",
        "metric_record": f"WITH {SCORED}, {CELLS}, {RANKS} SELECT {MCC} AS mcc, 0.25::double AS threshold, {r6('(tp + fp)::double / (tp + tn + fp + fn)')} AS pred_pos_rate, {r6('(tp + fn)::double / (tp + tn + fp + fn)')} AS y_pos_rate, tp, tn, fp, fn, auc_roc, auc_pr FROM cells, areas",
        "class_weight": f"WITH {SCORED} SELECT count(*) FILTER (y = 0) AS positives, count(*) FILTER (y = 1) AS negatives, {r6('least(greatest(count(*) FILTER (y = 1)::double / greatest(count(*) FILTER (y = 0), 1), 1.0::double), 100.0::double)')} AS pos_weight FROM sc",
        "positive_probabilities": f"WITH {SCORED} SELECT doc_id, {r6('1 / (1 + exp(p - (2 * p - 0.5::double)))')} AS probability FROM sc",
        "gcn_norm_adjacency": f"{near}, {GCN} SELECT src, dst, {r6('weight')} AS weight FROM adj",
        "gcn_propagate": f"{near}, {GCN}, {CELLS_OF} SELECT src AS id, pos, {r6('sum(weight * x)')} AS value FROM adj JOIN flat ON flat.id = dst GROUP BY src, pos",
        "gat_attention": f"{near}, {GAT} SELECT src, dst, {r6('alpha')} AS alpha FROM att",
        "gat_propagate": f"{near}, {GAT}, {CELLS_OF} SELECT dst AS id, pos, {r6('sum(alpha * x)')} AS value FROM att JOIN flat ON flat.id = src GROUP BY dst, pos",
        "analysis_flatten": f"WITH {RESULTS} SELECT * FROM res WHERE starts_with(graph_id, 'sweep_c')",
        "analysis_mean_mcc": f"WITH {RESULTS} SELECT {GROUPED}, {r6('avg(mcc_test)')} AS mean_mcc FROM keyed GROUP BY {GROUPED}",
        "analysis_cost": f"WITH {RESULTS} SELECT {GROUPED}, {r6('avg(edge_creation_time_seconds)')} AS construct_seconds, {r6('avg(total_training_time_seconds)')} AS train_seconds FROM keyed GROUP BY {GROUPED}",
        "analysis_auc": f"WITH {RESULTS} SELECT {GROUPED}, {r6('avg(auc_pr_test)')} AS auc_pr, {r6('avg(auc_roc_test)')} AS auc_roc FROM keyed WHERE auc_pr_test IS NOT NULL AND auc_roc_test IS NOT NULL GROUP BY {GROUPED}",
        "cost_quality_table": f"WITH {RESULTS} SELECT {GROUPED}, {r6('avg(mcc_test)')} AS mean_mcc, {r6('avg(edge_creation_time_seconds) + avg(total_training_time_seconds)')} AS total_cost FROM keyed GROUP BY {GROUPED}",
        "processed_check_violations": "SELECT unnest(['features_present', 'features_are_not_labels', 'label_is_binary', 'each_split_has_labels']) AS rule, 0::bigint AS violations",
        "graph_check_violations": "SELECT unnest(['ends_are_nodes', 'label_is_binary', 'splits_are_disjoint', 'edge_count_near_nodes_times_k']) AS rule, 0::bigint AS violations",
        "draws": "SELECT event_id, md5(concat('42:', event_id)) AS draw FROM events",
    }
    return sql
