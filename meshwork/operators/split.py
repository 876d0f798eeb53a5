"""Deterministic splits and samples with exact quotas.

A draw is the md5 of seed and key, so any engine can repeat it.  Quotas are
rounded half to even.  Ranks come from ``ranking``, so one large class does
not become one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ranking import drawn, ranked

SEED = 42


def quota(n: Column, ratio: float | Column, least: int = 1) -> Column:
    """n * ratio rounded half to even, at least ``least``, at most n."""
    share = F.bround(n.cast("double") * (F.lit(ratio) if isinstance(ratio, float) else ratio)).cast("long")
    return F.least(n, F.greatest(F.lit(least).cast("long"), share))


def stratified_pick(df: DataFrame, key: str, label: str, ratio: float, seed: int = SEED, name: str = "picked") -> DataFrame:
    """``df`` with a boolean: picked by the quota of its class; rows of a null class never are."""
    out = drawn(df, [label], seed, key, "_rn", "_n")
    wanted = F.col("_rn") <= (quota(F.col("_n"), ratio) if ratio > 0 else F.lit(0))
    return out.withColumn(name, F.coalesce(F.col(label).isNotNull() & wanted, F.lit(False))).drop("_rn", "_n")


def split_stratified(df: DataFrame, key: str, label: str, val_ratio: float, seed: int = SEED) -> DataFrame:
    """``split``: val by quota of each class, else train."""
    out = stratified_pick(df, key, label, val_ratio, seed, "_val")
    return out.withColumn("split", F.when(F.col("_val"), "val").otherwise("train")).drop("_val")


def split_by_file(df: DataFrame, key: str, label: str, source: str, val_ratio: float, seed: int = SEED) -> DataFrame:
    """The test file is test; val is carved out of the train file."""
    train = split_stratified(df.where(F.col(source) == "train_file"), key, label, val_ratio, seed)
    return train.unionByName(df.where(F.col(source) == "test_file").withColumn("split", F.lit("test")))


def split_threeway(df: DataFrame, key: str, label: str, test_ratio: float, val_ratio: float, seed: int = SEED) -> DataFrame:
    """test by quota of all rows, val by quota of the rest."""
    tested = stratified_pick(df, key, label, test_ratio, seed, "_test")
    rest = split_stratified(tested.where(~F.col("_test")), key, label, val_ratio, seed + 1)
    return tested.where("_test").withColumn("split", F.lit("test")).unionByName(rest).drop("_test")


def split_entity_disjoint(df: DataFrame, key: str, label: str, entity: str, test_ratio: float, val_ratio: float, seed: int = SEED) -> DataFrame:
    """Whole entities are test; rows without one, and all others, are train or val.

    A missing entity column falls back to the three-way split.
    """
    if entity not in df.columns:
        return split_threeway(df, key, label, test_ratio, val_ratio, seed)
    entities = drawn(df.where(F.col(entity).isNotNull()).select(F.col(entity).alias("_e")).distinct(), [], seed, "_e")
    chosen = entities.where(F.col("rn") <= F.greatest(F.lit(1), F.bround(F.col("n") * F.lit(test_ratio)))).select("_e")
    test = df.join(chosen, F.col(entity) == F.col("_e"), "left_semi").withColumn("split", F.lit("test"))
    rest = df.join(chosen, F.col(entity) == F.col("_e"), "left_anti")
    return test.unionByName(split_stratified(rest, key, label, val_ratio, seed + 1))


def _by_key(key: str) -> Column:
    """Buckets that follow an integer key."""
    return F.floor(F.col(key) / 4096)


def sample_by_label(df: DataFrame, key: str, label: str, most: int, seed: int = SEED) -> DataFrame:
    """Quotas by class where there are more than ``most`` rows; the largest keys go where quotas give too many."""
    total = df.agg(F.count(F.lit(1)).alias("_total"))
    out = drawn(df, [label], seed, key, "_rn", "_n").join(F.broadcast(total))
    share = quota(F.col("_n"), F.lit(float(most)) / F.col("_total"))
    kept = out.where((F.col("_total") <= most) | (F.col("_rn") <= share))
    kept = ranked(kept.drop("_rn", "_n"), [], _by_key(key), [F.col(key)], "_pos", None)
    return kept.where((F.col("_total") <= most) | (F.col("_pos") <= most)).drop("_total", "_pos")


def sample_topped_up(df: DataFrame, key: str, split: str, label: str, most: int, seed: int = SEED) -> DataFrame:
    """Quotas by (split, class), nulls included; cut to, or filled up to, exactly ``most`` rows."""
    total = df.agg(F.count(F.lit(1)).alias("_total"))
    out = drawn(df, [split, label], seed, key, "_rn", "_n").join(F.broadcast(total))
    out = out.withColumn("_picked", F.col("_rn") <= quota(F.col("_n"), F.lit(float(most)) / F.col("_total")))
    sums = out.agg(F.count_if("_picked").alias("_sum"))
    out = out.drop("_rn", "_n").join(F.broadcast(sums))
    # Too many: the picked ones by key.  Too few: the picked ones, then the rest by draw.
    by_key = ranked(out.where("_picked and _sum > " + str(most)), [], _by_key(key), [F.col(key)], "_pos", None)
    filling = drawn(out.where("not _picked"), [], seed, key, "_pos", None)
    enough = out.where("_picked and _sum <= " + str(most)).withColumn("_pos", F.lit(0).cast("long"))
    chosen = by_key.where(F.col("_pos") <= most).unionByName(enough).unionByName(filling.where(F.col("_pos") + F.col("_sum") <= most))
    return chosen.drop("_pos", "_picked", "_sum", "_total")


def sample_grouped(df: DataFrame, key: str, split: str, label: str, most: int, seed: int = SEED) -> DataFrame:
    """Quotas by (split, class) alone: the total may differ from ``most``."""
    total = df.agg(F.count(F.lit(1)).alias("_total"))
    out = drawn(df, [split, label], seed, key, "_rn", "_n").join(F.broadcast(total))
    return out.where(F.col("_rn") <= quota(F.col("_n"), F.lit(float(most)) / F.col("_total"))).drop("_rn", "_n", "_total")


def positions(df: DataFrame, key: str) -> DataFrame:
    """``df`` with 0-based positions in the order of an integer key."""
    out = ranked(df, [], _by_key(key), [F.col(key)], "pos", None)
    return out.withColumn("pos", F.col("pos") - 1)
