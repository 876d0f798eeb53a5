"""Exact k nearest neighbours in a grid of blocks.

Vectors are dealt into blocks of as many rows as fit a task's memory.  Each
cell of the grid holds one block of sources and one of candidates, multiplies
them strip by strip and keeps the k best candidates of each source; the best of
all cells come from a ranking that Spark limits before its shuffle.  A vector
is copied twice for every block, so large blocks are what keeps the shuffle
small.  Memory is that of a cell, at any number of vectors; nothing is
broadcast.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Bytes of vectors in one block, rows in one at least and at most, and products that are held at once.
BLOCK_BYTES, LEAST_ROWS, MOST_ROWS = 16 << 20, 1024, 32_768
STRIP_CELLS = 4 << 20
EDGES = "src long, dst long, score double"


def cosine(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    length = lambda m: np.sqrt((m * m).sum(1, keepdims=True))
    unit = lambda m: m / np.where((n := length(m)) == 0, 1, n)
    return unit(x) @ unit(y).T


def euclidean(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """exp(-distance), so that nearer is larger."""
    squares = (x * x).sum(1)[:, None] + (y * y).sum(1)[None, :] - 2 * x @ y.T
    return np.exp(-np.sqrt(np.maximum(squares, 0)))


METRICS = {"cosine": cosine, "euclidean": euclidean}


def no_edges(df: DataFrame) -> DataFrame:
    return df.sparkSession.createDataFrame([], EDGES)


def _best(table: np.ndarray, own: np.ndarray, others: np.ndarray, k: int):
    """(row, column) of the k best of each row by rounded score, then by smaller id; never the row itself."""
    by_id = np.argsort(others, kind="stable")
    table = (np.round(table, 6) + 0.0)[:, by_id]
    table[own[:, None] == others[by_id][None, :]] = -np.inf
    if k < table.shape[1]:  # all that reach the k-th best score, so that ties are still decided by id
        least = -np.partition(-table, k - 1, axis=1)[:, k - 1 : k]
        table = np.where(table >= least, table, -np.inf)
        wanted = min(int((table > -np.inf).sum(1).max()), table.shape[1])
        at = np.sort(np.argpartition(-table, max(wanted - 1, 0), axis=1)[:, :wanted], axis=1)
        inner = np.argsort(-np.take_along_axis(table, at, 1), axis=1, kind="stable")[:, :k]
        columns = np.take_along_axis(at, inner, 1)
    else:
        columns = np.argsort(-table, axis=1, kind="stable")[:, :k]
    return _kept(table, columns, by_id)


def _kept(table: np.ndarray, columns: np.ndarray, by_id: np.ndarray):
    """(row, column, score) of the chosen cells that hold a score; columns are places in the order of ids."""
    rows, chosen = np.repeat(np.arange(len(columns)), columns.shape[1]), columns.ravel()
    scores = table[rows, chosen]
    good = scores > -np.inf
    return rows[good], by_id[chosen[good]], scores[good]


def block_rows(n: int, dims: int) -> int:
    """Rows of a block: four blocks where they are few, as many as memory allows where they are many."""
    return min(max(LEAST_ROWS, math.ceil(n / 4)), max(LEAST_ROWS, min(MOST_ROWS, BLOCK_BYTES // (8 * max(dims, 1)))))


def knn(df: DataFrame, key: str, vector: str, k: int, metric: str = "cosine", block: int | None = None) -> DataFrame:
    """(src, dst, score) of the min(k, N - 1) nearest of every row, itself left out.

    Scores are rounded to six places before they are ranked; ties go to the
    smaller dst.  No rows, or k of 0, give no edges.
    """
    similarity = METRICS[metric]
    if k <= 0:
        return no_edges(df)
    n, dims = df.agg(F.count(F.lit(1)), F.max(F.size(vector))).first()
    blocks = max(1, math.ceil(n / (block or block_rows(n, dims or 1))))
    own = df.select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v")).withColumn("b", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int"))
    every = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    sources, candidates = own.select("id", "v", F.col("b").alias("i"), every.alias("j")), own.select("id", "v", every.alias("i"), F.col("b").alias("j"))
    rows = sources.withColumn("asks", F.lit(True)).unionByName(candidates.withColumn("asks", F.lit(False)))

    def cell(table: pa.Table) -> pa.Table:
        asks = table.column("asks").to_numpy(zero_copy_only=False)
        if not asks.any() or asks.all():
            return pa.table({"src": pa.array([], pa.int64()), "dst": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
        v, ids = np.stack([np.asarray(r.values, float) for r in table.column("v")]), table.column("id").to_numpy()
        mine, others = ids[asks], ids[~asks]
        left, right, strip, best = v[asks], v[~asks], max(1, STRIP_CELLS // len(others)), []
        for at in range(0, len(mine), strip):
            found, columns, scores = _best(similarity(left[at : at + strip], right), mine[at : at + strip], others, k)
            best.append((mine[at : at + strip][found], others[columns], scores))
        return pa.table(dict(zip(("src", "dst", "score"), map(np.concatenate, zip(*best)))))

    cells = rows.groupBy("i", "j").applyInArrow(cell, EDGES)
    if blocks == 1:
        return cells
    return top_per_source(cells, k)


def top_per_source(edges: DataFrame, k: int) -> DataFrame:
    """The k best edges of each source."""
    order = W.partitionBy("src").orderBy(F.desc("score"), "dst")
    return edges.withColumn("_rn", F.row_number().over(order)).where(F.col("_rn") <= k).drop("_rn")


def knn_sweep(df: DataFrame, key: str, vector: str, ks: list[int], metric: str = "cosine") -> DataFrame:
    """Edges for every k of a sweep, from one pass at the largest."""
    best = knn(df, key, vector, max(ks), metric)
    order = W.partitionBy("src").orderBy(F.desc("score"), "dst")
    ranked = best.withColumn("_rn", F.row_number().over(order))
    return ranked.select(F.explode(F.array(*map(F.lit, sorted(ks)))).alias("k"), "*").where("_rn <= k").drop("_rn")
