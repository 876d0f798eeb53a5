"""The corpus pipeline: documents through the training-data operators, stage by stage.

Every stage takes (spark, docs, sf_dir) and works on all rows its predecessor
kept.  All but the last return the columns of ``documents``; ``n_chars`` is
counted anew where a stage changes texts.  ``run`` writes each stage's rows to
the shared folder and reads them again, so a lost executor never costs an
earlier stage.

In every stage an empty table gives an empty result, columns other than those
of ``documents`` are left out, and repeated rows are rows like others unless
the stage says otherwise.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meshwork.llm.language_id import UNKNOWN, classify, fit
from meshwork.llm.line_dedup import line_dedup
from meshwork.llm.near_dedup import Near, near_groups
from meshwork.llm.packing import best_fit_packing
from meshwork.llm.runtime import materialize, release, written
from meshwork.llm.span_dedup import span_dedup

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: A language is believed from this probability on.
LEAST_SCORE = 0.5


def _cleaned(found: DataFrame) -> DataFrame:
    """Texts after removal; a document goes when nothing but white space is left of it and something was removed."""
    left = (F.col("n_removed") == 0) | F.coalesce(F.col("text").rlike(r"\S"), F.lit(False))
    counted = F.when(F.col("n_removed") > 0, F.length("text")).otherwise(F.col("n_chars"))
    return found.where(left).select("doc_id", "text", "lang", "source", counted.cast("long").alias("n_chars"))


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised; null, empty and letterless texts go.

    A null doc_id or lang teaches nothing and is classified like others; equal
    probabilities go to the language that sorts first.
    """
    found = classify(docs, fit(docs), carry=["lang", "source", "n_chars"])
    return found.where((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= LEAST_SCORE)).select(*COLUMNS)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without later copies of runs of lines.

    Null texts and rows with a null doc_id stay as they are; of equal runs the
    first in (doc_id, line) order stays; rows of equal id and text lose the
    same lines.  A document of which only white space is left goes, one that
    was empty before does not.
    """
    return _cleaned(line_dedup(docs, carry=["lang", "source", "n_chars"]))


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The smallest doc_id of each group of near duplicates: five words, similarity 0.8 or more.

    Null, empty and blank texts are nobody's duplicates, and rows with a null
    doc_id stay; rows that share a doc_id are one document and stay or go
    together.
    """
    dropped = near_groups(docs, Near(words=5, percent=80)).where("doc_id is not null and not kept").select("doc_id").distinct()
    return docs.select(*COLUMNS).join(materialize(dropped, "dropped").hint("merge"), "doc_id", "left_anti").select(*COLUMNS)


def span_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without sentences that lie in a repeated span.

    Null texts and rows with a null doc_id stay as they are; of equal spans
    that of the smallest doc_id stays, and rows that share a doc_id take none
    from one another.  A document of which only white space is left goes, one
    that was empty before does not.
    """
    return _cleaned(span_dedup(docs, carry=["lang", "source", "n_chars"]))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences of at most 2048 tokens.

    Null and empty texts are the one token 0; rows with a null or a repeated
    doc_id are packed like others; pieces of equal length are ranked by doc_id,
    piece, start and checksum.
    """
    return best_fit_packing(docs)


STAGES = [
    ("language_id", language_stage),
    ("line_dedup", line_stage),
    ("near_dedup", near_stage),
    ("substring_dedup", span_stage),
    ("best_fit_packing", packing_stage),
]

#: SQL cannot train a model, draw MinHash bins or run a tokenizer; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``; what a stage has stored on its way goes once its rows are written."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), written(spark)
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialize(docs, name)
            release(spark, before | {docs._stored_at})
    return docs
