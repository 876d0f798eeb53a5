"""Graph convolution and graph attention.

Propagation and attention are DataFrame joins, so they work at any size.
Training is full-batch on one graph a task, as many runs at once as there are
tasks: ``train_runs`` deals (graph, seed) pairs out.
"""

from __future__ import annotations

from dataclasses import asdict, dataclass
from time import perf_counter

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .evaluate import STEPS
from .graph import Graph

SLOPE, TINY = 0.2, 1e-9
#: Nodes of one graph that a training task takes.
MAX_TRAINING_NODES = 200_000


def normalized_adjacency(graph: Graph) -> DataFrame:
    """(src, dst, weight) of the graph with a loop at every node, by the roots of its row sums."""
    loops = graph.nodes.select(F.col("id").alias("src"), F.col("id").alias("dst"))
    pairs = graph.edges.select("src", "dst").unionByName(loops).groupBy("src", "dst").agg(F.count(F.lit(1)).cast("double").alias("w"))
    deg = pairs.groupBy("src").agg(F.greatest(F.sum("w"), F.lit(1.0)).alias("d"))
    rows, columns = deg.select("src", F.col("d").alias("ds")), deg.select(F.col("src").alias("dst"), F.col("d").alias("dd"))
    return pairs.join(rows, "src").join(columns, "dst").select("src", "dst", (F.col("w") / F.sqrt("ds") / F.sqrt("dd")).alias("weight"))


def propagated(weights: DataFrame, nodes: DataFrame, vector: str = "v") -> DataFrame:
    """(id, pos, value): each source takes the weighted sum of its targets' vectors."""
    x = nodes.select(F.col("id").alias("dst"), F.posexplode(vector).alias("pos", "x"))
    return weights.join(x, "dst").groupBy(F.col("src").alias("id"), F.col("pos").cast("long").alias("pos")).agg(F.sum(F.col("weight") * F.col("x")).alias("value"))


def attention(edges: DataFrame, nodes: DataFrame, a_src: list[float], a_dst: list[float], vector: str = "v") -> DataFrame:
    """(src, dst, alpha): softmax by target of the leaky score of both ends."""
    dot = lambda a: F.aggregate(F.zip_with(vector, F.array(*map(F.lit, a)), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    own = nodes.select("id", dot(a_src).alias("s"), dot(a_dst).alias("d"))
    scored = edges.select("src", "dst").join(own.select(F.col("id").alias("src"), "s"), "src").join(own.select(F.col("id").alias("dst"), "d"), "dst")
    raw = F.col("s") + F.col("d")
    scored = scored.select("src", "dst", F.when(raw > 0, raw).otherwise(SLOPE * raw).alias("e"))
    shifted = scored.join(F.broadcast(scored.agg(F.max("e").alias("top")))).select("src", "dst", F.exp(F.col("e") - F.col("top")).alias("z"))
    sums = shifted.groupBy("dst").agg(F.sum("z").alias("below"))
    return shifted.join(sums, "dst").select("src", "dst", (F.col("z") / (F.col("below") + TINY)).alias("alpha"))


def attended(alphas: DataFrame, nodes: DataFrame, vector: str = "v") -> DataFrame:
    """(id, pos, value): each target takes its sources' vectors by alpha."""
    x = nodes.select(F.col("id").alias("src"), F.posexplode(vector).alias("pos", "x"))
    return alphas.join(x, "src").groupBy(F.col("dst").alias("id"), F.col("pos").cast("long").alias("pos")).agg(F.sum(F.col("alpha") * F.col("x")).alias("value"))


@dataclass(frozen=True)
class Training:
    model: str = "gcn"
    epochs: int = 100
    rate: float = 1e-3
    decay: float = 0.0
    hidden: int = 64
    dropout: float = 0.3
    patience: int = 20


def best_mcc(y: np.ndarray, p: np.ndarray) -> tuple[float, float]:
    """(threshold, MCC), the first of the highest; .5 and 0 without rows."""
    if not len(y):
        return 0.5, 0.0
    t = np.linspace(0, 1, STEPS)
    flagged = p[None, :] >= t[:, None]
    tp, fp = (flagged & (y == 1)).sum(1).astype(float), (flagged & (y == 0)).sum(1).astype(float)
    fn, tn = (y == 1).sum() - tp, (y == 0).sum() - fp
    below = np.sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn))
    score = np.divide(tp * tn - fp * fn, below, out=np.zeros(STEPS), where=below > 0)
    return float(t[np.argmax(score)]), float(score.max())


def ranking_areas(y: np.ndarray, p: np.ndarray) -> tuple[float | None, float | None]:
    """(auc_roc, auc_pr), as ``evaluate.ranking_scores`` has them: ties count half; step-wise; null with one class only."""
    positives, negatives = int((y == 1).sum()), int((y == 0).sum())
    if not positives or not negatives:
        return None, None
    at = np.unique(-p, return_inverse=True)[1]
    pos, neg = np.bincount(at, y == 1), np.bincount(at, y == 0)
    tp, fp = np.cumsum(pos), np.cumsum(neg)
    return float((pos * (negatives - fp) + pos * neg / 2).sum() / (positives * negatives)), float((pos * tp / (tp + fp)).sum() / positives)


def metric_record(y: np.ndarray, p: np.ndarray, threshold: float) -> dict:
    """MCC, rates, confusion and areas at score >= threshold; nulls in place of them on no rows, but for the counts."""
    flagged, truth, n = p >= threshold, y == 1, len(y)
    tp, tn, fp, fn = (int((a & b).sum()) for a, b in ((flagged, truth), (~flagged, ~truth), (flagged, ~truth), (~flagged, truth)))
    below = (float(tp + fp) * (tp + fn) * (tn + fp) * (tn + fn)) ** 0.5
    roc, pr = ranking_areas(y, p)
    return {"mcc": None if not n else (tp * tn - fp * fn) / below if below else 0.0, "pred_pos_rate": (tp + fp) / n if n else None, "y_pos_rate": (tp + fn) / n if n else None, "tp": tp, "tn": tn, "fp": fp, "fn": fn, "auc_roc": roc, "auc_pr": pr}


def _sum_by(index: np.ndarray, rows: np.ndarray, n: int) -> np.ndarray:
    out = np.zeros((n, rows.shape[1]))
    np.add.at(out, index, rows)
    return out


class Gcn:
    """Two graph convolutions: A relu(A x W1 + b1) W2 + b2, with hand-written gradients."""

    def __init__(self, n, src, dst, features, hidden, draws):
        pairs = np.unique(np.stack([np.append(src, np.arange(n)), np.append(dst, np.arange(n))]), axis=1)
        self.n, (self.src, self.dst) = n, pairs
        deg = np.maximum(np.bincount(self.src, minlength=n), 1.0)
        self.w = (deg[self.src] * deg[self.dst]) ** -0.5
        spread = lambda a, b: draws.uniform(-1, 1, (a, b)) / np.sqrt(a)
        self.params = [spread(features, hidden), np.zeros(hidden), spread(hidden, 2), np.zeros(2)]

    def pull(self, x):
        return _sum_by(self.src, self.w[:, None] * x[self.dst], self.n)

    def push(self, g):
        return _sum_by(self.dst, self.w[:, None] * g[self.src], self.n)

    def forward(self, x, mask):
        w1, b1, w2, b2 = self.params
        ax = self.pull(x)
        z = ax @ w1 + b1
        h = np.maximum(z, 0) * mask
        ah = self.pull(h)
        self.kept = ax, z, ah, mask
        return ah @ w2 + b2

    def backward(self, g):
        ax, z, ah, mask = self.kept
        gh = self.push(g @ self.params[2].T) * mask * (z > 0)
        return [ax.T @ gh, gh.sum(0), ah.T @ g, g.sum(0)]


class Gat:
    """One attention layer and a linear one: relu(sum alpha x W) W2 + b2."""

    def __init__(self, n, src, dst, features, hidden, draws):
        self.n, self.src, self.dst = n, src, dst
        spread = lambda a, b: draws.uniform(-1, 1, (a, b)) / np.sqrt(a)
        self.params = [spread(features, hidden), spread(hidden, 1)[:, 0], spread(hidden, 1)[:, 0], spread(hidden, 2), np.zeros(2)]

    def forward(self, x, mask):
        w, a, b, w2, b2 = self.params
        h = x @ w
        raw = (h @ a)[self.src] + (h @ b)[self.dst]
        e = np.where(raw > 0, raw, SLOPE * raw)
        z = np.exp(e - (e.max() if len(e) else 0))
        below = np.bincount(self.dst, z, minlength=self.n) + TINY
        alpha = z / below[self.dst]
        m = _sum_by(self.dst, alpha[:, None] * h[self.src], self.n)
        out = np.maximum(m, 0) * mask
        self.kept = x, h, raw, alpha, m, out, mask
        return out @ w2 + b2

    def backward(self, g):
        x, h, raw, alpha, m, out, mask = self.kept
        w, a, b, w2, _ = self.params
        gm = (g @ w2.T) * mask * (m > 0)
        galpha = (gm[self.dst] * h[self.src]).sum(1)
        mean = np.bincount(self.dst, alpha * galpha, minlength=self.n)
        graw = alpha * (galpha - mean[self.dst]) * np.where(raw > 0, 1.0, SLOPE)
        gs, gd = np.bincount(self.src, graw, minlength=self.n), np.bincount(self.dst, graw, minlength=self.n)
        gh = _sum_by(self.src, alpha[:, None] * gm[self.dst], self.n) + gs[:, None] * a + gd[:, None] * b
        return [x.T @ gh, h.T @ gs, h.T @ gd, out.T @ g, g.sum(0)]


MODELS = {"gcn": Gcn, "gat": Gat}


def weighted_loss(logits, y, rows, pos_weight):
    """(loss, gradient) of cross-entropy over the rows, weighted by class and divided by the weights' sum."""
    p = np.exp(logits - logits.max(1, keepdims=True))
    p /= p.sum(1, keepdims=True)
    w = np.zeros(len(y))
    w[rows] = np.where(y[rows] == 1, pos_weight, 1.0)
    total = max(w.sum(), 1e-12)
    loss = -(w * np.log(np.maximum(p[np.arange(len(y)), y], 1e-12))).sum() / total
    g = p.copy()
    g[np.arange(len(y)), y] -= 1
    return loss, g * (w / total)[:, None]


def train_one(x, y, split, src, dst, how: Training, seed: int) -> dict:
    """Adam on the train rows; the weights of the best validation MCC stay.

    Seconds an epoch are those of the gradient steps; the total also has
    validation and the evaluation at the end.
    """
    begun, steps = perf_counter(), []
    draws = np.random.default_rng(seed)
    net = MODELS[how.model](len(y), src, dst, x.shape[1], how.hidden, draws)
    rows = {s: np.flatnonzero(split == s) for s in ("train", "val", "test")}
    train = y[rows["train"]]
    neg, pos = (train == 0).sum(), (train == 1).sum()
    pos_weight = float(np.clip(neg / max(pos, 1), 1, 100)) if neg else 1.0
    m, v = [np.zeros_like(p) for p in net.params], [np.zeros_like(p) for p in net.params]
    best, waited, stored, ran = (0.5, -1.0), 0, [p.copy() for p in net.params], 0
    positive = lambda: 1 / (1 + np.exp(-np.clip((lambda z: z[:, 1] - z[:, 0])(net.forward(x, 1.0)), -500, 500)))
    for t in range(1, how.epochs + 1):
        step = perf_counter()
        mask = (draws.random((len(y), how.hidden)) >= how.dropout) / (1 - how.dropout)
        _, g = weighted_loss(net.forward(x, mask), y, rows["train"], pos_weight)
        for k, grad in enumerate(net.backward(g)):
            grad = grad + how.decay * net.params[k]
            m[k] = 0.9 * m[k] + 0.1 * grad
            v[k] = 0.999 * v[k] + 0.001 * grad * grad
            net.params[k] = net.params[k] - how.rate * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)
        ran = t
        steps.append(perf_counter() - step)
        if len(rows["val"]):
            found = best_mcc(y[rows["val"]], positive()[rows["val"]])
            if found[1] > best[1]:
                best, waited, stored = found, 0, [p.copy() for p in net.params]
            else:
                waited += 1
                if waited >= how.patience:
                    break
        else:
            best, stored = (0.5, 0.0), [p.copy() for p in net.params]
    net.params = stored
    p = positive()
    out = {"epochs_ran": ran, "threshold": best[0], "mcc_val": best[1], "pos_weight": pos_weight}
    for s in ("val", "test"):
        record = metric_record(y[rows[s]], p[rows[s]], best[0])
        out |= {f"{name}_{s}": value for name, value in record.items() if (name, s) != ("mcc", "val")}
    out["training_time_per_epoch_seconds"] = float(np.mean(steps)) if steps else 0.0
    out["total_training_time_seconds"] = perf_counter() - begun
    return out


#: Fields of a metric record.
RECORD = {"mcc": "double", "pred_pos_rate": "double", "y_pos_rate": "double", "tp": "long", "tn": "long", "fp": "long", "fn": "long", "auc_roc": "double", "auc_pr": "double"}
#: Measured times, which differ from run to run.
TIMES = ["training_time_per_epoch_seconds", "total_training_time_seconds"]
_RECORDS = ", ".join(f"{name}_{s} {kind}" for s in ("val", "test") for name, kind in RECORD.items() if name != "mcc")
RESULT = f"graph_id string, model string, seed long, num_nodes long, num_edges long, epochs_ran long, threshold double, mcc_val double, mcc_test double, pos_weight double, error string, {_RECORDS}, {', '.join(f'{t} double' for t in TIMES)}"


def train_runs(nodes: DataFrame, edges: DataFrame, seeds: list[int], how: Training = Training(), strict: bool = True) -> DataFrame:
    """A result row for each (graph_id, seed).

    nodes: graph_id, id, v, y_bin, split; edges: graph_id, src, dst.  A run
    that fails is an error, or with ``strict`` false a row that says why.
    """
    every = F.explode(F.array(*(F.lit(s).cast("long") for s in seeds)))
    settings = asdict(how)

    def run(key, own: pd.DataFrame, links: pd.DataFrame) -> pd.DataFrame:
        graph_id, seed = key
        row = {"graph_id": str(graph_id), "model": settings["model"], "seed": int(seed), "num_nodes": len(own), "num_edges": len(links)}
        try:
            if len(own) > MAX_TRAINING_NODES:
                raise ValueError(f"more than {MAX_TRAINING_NODES} nodes in one graph")
            own = own.sort_values("id").reset_index(drop=True)
            place = pd.Series(own.index, own["id"])
            x = np.stack(own["v"].map(np.asarray))
            row |= train_one(x, own["y_bin"].to_numpy(int), own["split"].to_numpy(), place[links["src"]].to_numpy(), place[links["dst"]].to_numpy(), Training(**settings), int(seed))
        except Exception as failure:
            if strict:
                raise
            row["error"] = f"{type(failure).__name__}: {failure}"
        names = [c.split()[0] for c in RESULT.split(", ")]
        return pd.DataFrame([[row.get(name) for name in names]], columns=names, dtype=object)

    left = nodes.select("graph_id", "id", "v", "y_bin", "split", every.alias("seed"))
    right = edges.select("graph_id", "src", "dst", every.alias("seed"))
    return left.groupBy("graph_id", "seed").cogroup(right.groupBy("graph_id", "seed")).applyInPandas(run, RESULT)
