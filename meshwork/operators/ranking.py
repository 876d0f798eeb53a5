"""Exact ranks and prefix sums that no single task has to sort.

A window over one class sorts that class in one task.  Here rows are first
dealt into buckets that follow the wanted order; ranks inside a bucket come
from a window over (keys, bucket), and what lies before it from a window over
the bucket counts, of which there are few.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Hex digits of a draw that make its bucket: 65536 buckets, and no more rows than that of counts for a group.
PREFIX = 4


def draw(seed: int, key: Column) -> Column:
    """A reproducible pseudo-random text for a key."""
    return F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string")))


def ranked(df: DataFrame, keys: list[str], bucket: Column, order: list[Column], rank: str = "rn", size: str | None = "n") -> DataFrame:
    """``df`` with each row's 1-based rank among the rows of equal keys, and their number.

    ``bucket`` must not decrease along ``order``.  Null keys are a group.
    """
    dealt = df.withColumn("_bucket", bucket).withColumn("_group", F.struct(*keys) if keys else F.lit(0))
    before = W.partitionBy("_group").orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    counts = dealt.groupBy("_group", "_bucket").agg(F.count(F.lit(1)).alias("_k"))
    counts = counts.select("_group", "_bucket", F.coalesce(F.sum("_k").over(before), F.lit(0)).alias("_before"), F.sum("_k").over(W.partitionBy("_group")).alias("_all"))
    inside = F.row_number().over(W.partitionBy("_group", "_bucket").orderBy(*order))
    out = dealt.withColumn("_inside", inside).join(counts, ["_group", "_bucket"]).withColumn(rank, F.col("_before") + F.col("_inside"))
    out = out.withColumn(size, F.col("_all")) if size else out
    return out.drop("_bucket", "_group", "_inside", "_before", "_all")


def drawn(df: DataFrame, keys: list[str], seed: int, key: str, rank: str = "rn", size: str | None = "n") -> DataFrame:
    """Ranks in the order of the draws of ``key``."""
    hashed = df.withColumn("_draw", draw(seed, F.col(key)))
    return ranked(hashed, keys, F.substring("_draw", 1, PREFIX), [F.col("_draw"), F.col(key)], rank, size).drop("_draw")


def running(df: DataFrame, bucket: Column, order: list[Column], sums: dict[str, str]) -> DataFrame:
    """``df`` with inclusive running sums over the whole table in the given order; sums: new name to column."""
    dealt = df.withColumn("_bucket", bucket)
    totals = dealt.groupBy("_bucket").agg(*(F.sum(c).alias(f"_{n}") for n, c in sums.items()))
    before = W.orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    totals = totals.select("_bucket", *(F.coalesce(F.sum(f"_{n}").over(before), F.lit(0)).alias(f"_{n}") for n in sums))
    inside = W.partitionBy("_bucket").orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    out = dealt.select("*", *(F.sum(c).over(inside).alias(f"_in_{n}") for n, c in sums.items())).join(totals, "_bucket")
    out = out.withColumns({n: F.col(f"_{n}") + F.col(f"_in_{n}") for n in sums})
    return out.drop("_bucket", *(f"_{n}" for n in sums), *(f"_in_{n}" for n in sums))
