"""Exact dedup: a tree-merge of sorted digest runs, in DataFrame functions only.

Texts are read and hashed once; their digests are stored, and everything else
works on digests.  Every document is dealt to a run by a hash of its id.  A run
is the sorted list of its distinct digests, each with the identifier that stays
and a count.  In each round groups of ``fan_in`` neighbouring runs are
exchanged and merged (run r goes to run r div ``fan_in``): rows meet in sorted
order, by digest and then by falling identifier, and the first of each digest
stays with the sum of the counts, until one run is left.  A digest has at most
one row in a run, so a text that fills a third of the corpus gives a merge
``fan_in`` rows at most: no key is hot at any level.  The winners go back down
by the same runs, of which there are more where the corpus is larger.

Equality is verified at every level: rows merge only when the SHA-256, the
byte length and a second, unrelated 64-bit hash of the texts all agree.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .runtime import documents, materialize

KEY = ["digest", "bytes", "check"]
#: Documents in one run, about; and runs at least.
RUN_ROWS, RUNS = 100_000, 64


def digests(docs: DataFrame, text: Column | None = None) -> DataFrame:
    """Per row: doc_id, digest, bytes, check."""
    body = F.coalesce(F.col("text") if text is None else text, F.lit(""))
    return documents(docs).select("doc_id", F.unhex(F.sha2(body, 256)).alias("digest"), F.octet_length(body).cast("long").alias("bytes"), F.xxhash64(body).alias("check"))


def merge_runs(runs: DataFrame, fan_in: int) -> DataFrame:
    """One round: every ``fan_in`` neighbouring sorted runs become one sorted run."""
    met = runs.withColumn("run", F.expr(f"run div {fan_in}"))
    same = W.partitionBy("run", *KEY)
    first = met.withColumn("turn", F.row_number().over(same.orderBy(F.col("best").desc_nulls_last())))
    counted = first.withColumn("n", F.sum("n").over(same.orderBy(F.col("best").desc_nulls_last()).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)))
    return counted.where("turn = 1").select("run", *KEY, "best", "n")


def exact_dedup(docs: DataFrame, runs: int | None = None, fan_in: int = 8, text: Column | None = None) -> DataFrame:
    """Per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256.

    Null text counts as empty text.  Of equal texts the largest doc_id stays.
    A row with a null doc_id counts in group_size and never stays, so its
    ``kept`` is false; where all rows of a text have one, keep_id is null.
    Repeated rows of one doc_id all carry its decision.  An empty table gives
    an empty result.  Without ``runs`` there are as many as the rows ask for.
    """
    if runs is not None and runs < 1 or fan_in < 2:
        raise ValueError("runs must be positive and fan_in at least 2")
    stored = materialize(digests(docs, text), "digests")
    left = runs or max(RUNS, math.ceil(stored.count() / RUN_ROWS))
    leaves = stored.withColumn("run", F.pmod(F.xxhash64("doc_id"), F.lit(left)))
    first = leaves.groupBy("run", *KEY).agg(F.max("doc_id").alias("best"), F.count(F.lit(1)).alias("n"))
    merged = first
    while left > 1:
        merged, left = merge_runs(merged, fan_in), -(-left // fan_in)
    winners = merged.select(*KEY, F.col("best").alias("keep_id"), F.col("n").alias("group_size"))
    by_run = first.select("run", *KEY).join(winners, KEY)
    return leaves.join(by_run, ["run", *KEY]).select(
        "doc_id",
        "keep_id",
        "group_size",
        F.coalesce(F.col("doc_id") == F.col("keep_id"), F.lit(False)).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )
