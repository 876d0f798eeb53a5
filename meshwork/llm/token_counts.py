"""Token counts by a separator scan over flat, unindexed token files.

``write_token_file`` makes such files: one unbroken run of ids a shard, in
blocks of equal size, a document's end marked by the end-of-document id alone.
``separator_scan`` finds documents again.  Each block is searched on its own
with one vectorised comparison; a prefix scan over the blocks' separator
counts then says which document a block's first and last tokens belong to, and
pieces of a document that crosses blocks are added up.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .bpe import codec, vocabulary_path
from .runtime import documents, materialize, prepare

#: Ids in one block of a token file.
BLOCK = 65_536
END_OF_DOCUMENT = "<|endoftext|>"

FILE = "shard long, number long, ids binary, doc_id long"
SUMMARY = "shard long, block long, size long, separators long, head long, tail long, inner array<long>, starts array<long>"


def write_token_file(docs: DataFrame, path: str | None = None, block: int = BLOCK) -> DataFrame:
    """Rows of token files, in the shared folder: a shard for each input partition.

    A row with ``ids`` is block ``number`` of its shard: unsigned 16-bit ids
    (32-bit where the vocabulary is larger).  A row without ids names the
    document that was written as the shard's ``number``-th, and holds no
    position in the file.
    """
    spark = prepare(docs.sparkSession)
    path = path or vocabulary_path()
    parts = documents(docs).select(F.spark_partition_id().cast("long").alias("shard"), "doc_id", "text")

    def run(batches):
        own = codec(path, plain_specials=True)
        end, kind = own.library.token_to_id(END_OF_DOCUMENT), id_kind(len(own.token_bytes))
        pending, held, blocks, written, shard = [], 0, 0, 0, None

        def rows(ids, names):
            n, first = len(ids) + len(names), blocks
            number = [*range(first, first + len(ids)), *range(written, written + len(names))]
            return pa.RecordBatch.from_arrays([pa.array([shard] * n, pa.int64()), pa.array(number, pa.int64()), pa.array(ids + [None] * len(names), pa.binary()), pa.array([None] * len(ids) + names, pa.int64())], ["shard", "number", "ids", "doc_id"])

        for batch in batches:
            names = batch.column(1).to_pylist()
            if names:
                shard = batch.column(0)[0].as_py()
            ids = []
            for text in batch.column(2).to_pylist():
                pending += [own.encode(text or "").astype(kind), np.array([end], kind)]
                held += len(pending[-2]) + 1
                if held >= block:
                    flat = np.concatenate(pending)
                    ids += [flat[k : k + block].tobytes() for k in range(0, held - held % block, block)]
                    pending, held = [flat[held - held % block :]], held % block
            yield rows(ids, names)
            blocks, written = blocks + len(ids), written + len(names)
        if held:
            yield rows([np.concatenate(pending).tobytes()], [])

    return materialize(parts.mapInArrow(run, FILE), "tokens")


def id_kind(vocabulary: int) -> str:
    """The width in which ids of such a vocabulary are stored."""
    return "<u2" if vocabulary <= 1 << 16 else "<u4"


def scan_block(ids: np.ndarray, end: int) -> tuple[int, int, int, int, np.ndarray, np.ndarray]:
    """size, separators, tokens before the first and after the last, lengths and starts between."""
    at = np.flatnonzero(ids == end)
    if not len(at):
        return len(ids), 0, len(ids), 0, at, at
    return len(ids), len(at), int(at[0]), len(ids) - 1 - int(at[-1]), np.diff(at) - 1, at[:-1] + 1


def separator_scan(blocks: DataFrame, end: int, kind: str) -> DataFrame:
    """Per document of flat token blocks (shard, block, ids): shard, ordinal, start, n_tokens, ended.

    ``ended`` is false for tokens after a shard's last separator.  An empty
    file has no documents; two separators in a row are a document of 0 tokens.
    """
    prepare(blocks.sparkSession)

    def run(batches):
        for batch in batches:
            found = [scan_block(np.frombuffer(x or b"", kind), end) for x in batch.column(2).to_pylist()]
            columns = list(zip(*found)) or [()] * 6
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(x, pa.int64()) for x in columns[:4]), *(pa.array(x, pa.list_(pa.int64())) for x in columns[4:])], ["shard", "block", "size", "separators", "head", "tail", "inner", "starts"])

    summary = materialize(blocks.select("shard", "block", "ids").mapInArrow(run, SUMMARY), "blocks")
    before = W.partitionBy("shard").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    whole = W.partitionBy("shard")
    scanned = summary.select(
        "*",
        F.coalesce(F.sum("separators").over(before), F.lit(0)).alias("ordinal"),
        F.coalesce(F.sum("size").over(before), F.lit(0)).alias("at"),
        F.sum("separators").over(whole).alias("documents"),
    )
    piece = lambda ordinal, start, n: F.struct(ordinal.alias("ordinal"), start.alias("start"), n.alias("n_tokens"))
    first, last = F.col("ordinal"), F.col("ordinal") + F.col("separators")
    edges = F.when(F.col("separators") == 0, F.array(piece(first, F.col("at"), F.col("head")))).otherwise(
        F.array(piece(first, F.col("at"), F.col("head")), piece(last, F.col("at") + F.col("size") - F.col("tail"), F.col("tail")))
    )
    crossing = scanned.select("shard", "documents", F.inline(edges)).groupBy("shard", "ordinal", "documents").agg(F.min("start").alias("start"), F.sum("n_tokens").alias("n_tokens"))
    crossing = crossing.where("ordinal < documents or n_tokens > 0").select("shard", "ordinal", "start", "n_tokens", (F.col("ordinal") < F.col("documents")).alias("ended"))
    inner = F.transform("inner", lambda n, k: piece(F.col("ordinal") + k + 1, F.col("at") + F.get("starts", k), n))
    return scanned.select("shard", F.inline(inner)).select("shard", "ordinal", "start", "n_tokens", F.lit(True).alias("ended")).unionByName(crossing)


def token_counts(docs: DataFrame, path: str | None = None, block: int = BLOCK) -> DataFrame:
    """Per row of ``docs``: doc_id, n_tokens, and where it lies: shard, ordinal, start.

    Null text counts as empty: a document of 0 tokens.  Null doc_ids and
    repeated rows are documents like others; an empty table gives no rows.
    """
    path = path or vocabulary_path()
    files = write_token_file(docs, path, block)
    own = codec(path, plain_specials=True)
    blocks = files.where("ids is not null").select("shard", F.col("number").alias("block"), "ids")
    names = files.where("ids is null").select("shard", F.col("number").alias("ordinal"), "doc_id")
    counts = separator_scan(blocks, own.library.token_to_id(END_OF_DOCUMENT), id_kind(len(own.token_bytes)))
    return names.join(counts.where("ended"), ["shard", "ordinal"]).select("doc_id", "n_tokens", "shard", "ordinal", "start")
