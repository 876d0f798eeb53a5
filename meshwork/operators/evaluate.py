"""Evaluation of scored binary labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.scoring import mcc
from .ranking import running

#: Thresholds tried: evenly spaced from 0 to 1.
STEPS = 200
#: Buckets of a score in [0, 1] for prefix sums.
BUCKETS = 4096


def _cells(y: Column, flagged: Column) -> list[Column]:
    return [F.count_if((y == 1) & flagged).alias("tp"), F.count_if((y == 0) & ~flagged).alias("tn"), F.count_if((y == 0) & flagged).alias("fp"), F.count_if((y == 1) & ~flagged).alias("fn")]


def confusion(df: DataFrame, y: str, score: str, threshold: float) -> DataFrame:
    """One row: tp, tn, fp, fn at score >= threshold."""
    return df.agg(*_cells(F.col(y), F.col(score) >= threshold))


def with_mcc(cells: DataFrame) -> DataFrame:
    return cells.withColumn("mcc", F.round(mcc(*(F.col(c) for c in ("tp", "tn", "fp", "fn"))), 6))


def class_weight(df: DataFrame, y: str) -> DataFrame:
    """One row: negatives over positives between 1 and 100; 1 without negatives."""
    counts = df.agg(F.count_if(F.col(y) == 1).alias("positives"), F.count_if(F.col(y) == 0).alias("negatives"))
    ratio = F.col("negatives") / F.greatest("positives", F.lit(1))
    weight = F.when(F.col("negatives") == 0, 1.0).otherwise(F.least(F.greatest(ratio, F.lit(1.0)), F.lit(100.0)))
    return counts.select("positives", "negatives", F.round(weight, 6).alias("pos_weight"))


def threshold_table(df: DataFrame, y: str, score: str, steps: int = STEPS) -> DataFrame:
    """threshold, tp, tn, fp, fn, mcc for each threshold.

    Scores become counts by the last threshold that they reach, so the rows
    are met once and the cumulative sums run over ``steps`` counts.
    """
    top = float(steps - 1)
    guess = F.floor(F.col(score) * top).cast("int")
    reached = F.when((guess + 1) / top <= F.col(score), guess + 1).when(guess / top > F.col(score), guess - 1).otherwise(guess)
    reached = F.greatest(F.lit(-1), F.least(F.lit(steps - 1), reached))
    counts = df.groupBy(reached.alias("at")).agg(F.count_if(F.col(y) == 1).alias("p"), F.count_if(F.col(y) == 0).alias("n"))
    every = df.sparkSession.range(-1, steps, numPartitions=1).select(F.col("id").cast("int").alias("at"))
    full = every.join(F.broadcast(counts), "at", "left").fillna(0, ["p", "n"])
    above, whole = W.partitionBy().orderBy("at").rowsBetween(0, W.unboundedFollowing), W.partitionBy()
    cells = full.select("at", F.sum("p").over(above).alias("tp"), F.sum("n").over(above).alias("fp"), F.sum("p").over(whole).alias("pp"), F.sum("n").over(whole).alias("nn")).where("at >= 0")
    return with_mcc(cells.select((F.col("at") / top).alias("threshold"), "tp", (F.col("nn") - F.col("fp")).alias("tn"), "fp", (F.col("pp") - F.col("tp")).alias("fn")))


def best_threshold(df: DataFrame, y: str, score: str, steps: int = STEPS) -> DataFrame:
    """One row: the first threshold of the highest MCC."""
    return threshold_table(df, y, score, steps).orderBy(F.desc("mcc"), "threshold").limit(1).withColumn("threshold", F.round("threshold", 6))


def rank_table(df: DataFrame, y: str, score: str) -> DataFrame:
    """score, p, n, tp, fp, positives, negatives, from the highest score down; running counts without one sorting task."""
    groups = df.groupBy(F.col(score).alias("score")).agg(F.count_if(F.col(y) == 1).alias("p"), F.count_if(F.col(y) == 0).alias("n"))
    summed = running(groups, F.floor(-F.col("score") * BUCKETS), [F.desc("score")], {"tp": "p", "fp": "n"})
    totals = groups.agg(F.sum("p").alias("positives"), F.sum("n").alias("negatives"))
    return summed.join(F.broadcast(totals))


def ranking_scores(df: DataFrame, y: str, score: str) -> DataFrame:
    """One row: auc_roc (ties count half) and auc_pr (step-wise); null with one class only."""
    t = rank_table(df, y, score)
    p, n = F.max("positives"), F.max("negatives")
    roc = F.sum(F.col("p") * (F.col("negatives") - F.col("fp")) + F.col("p") * F.col("n") / 2)
    pr = F.sum(F.try_divide(F.col("p") * F.col("tp"), F.col("tp") + F.col("fp")))
    both = (p > 0) & (n > 0)
    return t.agg(F.round(F.when(both, roc / F.when(both, p * n)), 6).alias("auc_roc"), F.round(F.when(both, pr / F.when(both, p)), 6).alias("auc_pr"))


def metric_record(df: DataFrame, y: str, score: str, threshold: float) -> DataFrame:
    """One row: mcc, threshold, rates, confusion and ranking scores; nulls in place of them on no rows."""
    cells = with_mcc(confusion(df, y, score, threshold))
    n = F.col("tp") + F.col("tn") + F.col("fp") + F.col("fn")
    share = lambda part: F.round(F.when(n > 0, part / F.when(n > 0, n)), 6)
    out = cells.select("mcc", F.lit(threshold).alias("threshold"), share(F.col("tp") + F.col("fp")).alias("pred_pos_rate"), share(F.col("tp") + F.col("fn")).alias("y_pos_rate"), "tp", "tn", "fp", "fn")
    return out.join(F.broadcast(ranking_scores(df, y, score)))
