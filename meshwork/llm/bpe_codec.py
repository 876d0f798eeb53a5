"""BPE encoding and decoding with content-defined chunk reuse.

A text is cut where a rolling hash over its last bytes meets a mask, so equal
passages in different documents give equal chunks.  The digests of all chunks
are counted over the corpus.  A chunk that occurs more than once is sent to one
task, is encoded there once, and its ids go to the texts that hold it, as a
head, a core and a tail.  Core ids hold wherever the chunk stands, because the
core begins and ends at positions where the pattern always splits: before a
lone space between two other characters that are not white space.  What lies
outside the cores of two neighbours is joined and encoded again, and grows over
whole chunks where a chunk has no core; then head, core and tail agree with the
whole text's ids.

Only texts that hold a shared chunk are shuffled.  Which ones those are, and
which chunks, tell two bitmaps of fixed size; what a bitmap lets through by
chance is shuffled too and gives the same ids.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import Codec, codec, vocabulary_path
from .runtime import bitmap, documents, has_bit, prepare

#: Chunks are cut on average every 2**CUT_BITS bytes, and never below MIN_CHUNK.
CUT_BITS, MIN_CHUNK = 9, 128
#: Bits of each of the two filters: 2 MB, broadcast with the function that uses it.
FILTER_BITS = 1 << 24
#: Where a text can be encoded in two parts: fixed by the split pattern.
SAFE = re.compile(r"(?<=\S) (?=\S)")

SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
TEXTS = "doc_id long, raw binary, tx long, ty long"
HELD = "tx long, ty long, x long, y long"
CODES = "x long, y long, head binary, core binary, tail binary"

Entry = tuple[bytes, bytes | None, bytes]


def cut_points(raw: bytes) -> list[int]:
    """Content-defined cuts of UTF-8 bytes, never inside a character.

    The hash of a position is a multiplicative sum over the eight bytes before
    it, so a cut depends on nothing else.
    """
    if len(raw) <= 2 * MIN_CHUNK:
        return [0, len(raw)]
    data = np.frombuffer(raw, np.uint8)
    padded = np.concatenate([data, np.zeros(8 - len(data) % 8 + 8, np.uint8)])
    window = np.lib.stride_tricks.as_strided(padded, (len(data) - 7, 8), (1, 1))
    rolled = np.ascontiguousarray(window).view("<u8").ravel() * np.uint64(0x9E3779B97F4A7C15)
    at = np.flatnonzero(rolled >> np.uint64(64 - CUT_BITS) == 0) + 8
    at = at[at < len(data)]
    at = at[(data[at] & 0xC0) != 0x80]
    cuts = [0]
    for x in at.tolist():
        if x - cuts[-1] >= MIN_CHUNK:
            cuts.append(x)
    return [*cuts, len(raw)]


def chunks_of(raw: bytes, specials: dict[str, int]) -> list[bytes]:
    """The chunks of a text; none of a text that holds an added token's string, which is encoded whole."""
    if not raw or any(s.encode() in raw for s in specials):
        return []
    cuts = cut_points(raw)
    return [raw[a:b] for a, b in zip(cuts, cuts[1:])]


def chunk_keys(chunks: list[bytes]) -> np.ndarray:
    """Two 64-bit numbers for each chunk."""
    return np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, chunks)), np.int64).reshape(-1, 2)


def width(own: Codec) -> str:
    """How the ids of cores are stored: in 16 bits where the vocabulary fits."""
    return "<u2" if len(own.token_bytes) <= 1 << 16 else "<u4"


def coded(chunk: bytes, own: Codec) -> Entry:
    """(head, ids of the core, tail) of a chunk; without a core it is all head."""
    text = chunk.decode()
    safe = SAFE.search(text)
    last = text.rfind(" ", 0, len(text) - 1) if safe else -1
    while safe and last > safe.start() and not SAFE.match(text, last):
        last = text.rfind(" ", 0, last)
    if not safe or last <= safe.start():
        return chunk, None, b""
    return text[: safe.start()].encode(), own.encode(text[safe.start() : last]).astype(width(own)).tobytes(), text[last:].encode()


def joined(chunks: list[bytes], known: dict[tuple[int, int], Entry], own: Codec) -> np.ndarray:
    """Ids of the text that the chunks make up: cores where they are known, all else encoded."""
    parts, joint = [], []
    for chunk, key in zip(chunks, map(tuple, chunk_keys(chunks).tolist())):
        head, core, tail = known.get(key, (chunk, None, b""))
        joint.append(head)
        if core is not None:
            if any(joint):
                parts.append(own.encode(b"".join(joint).decode()))
            parts.append(np.frombuffer(core, width(own)).astype("<u4"))
            joint = [tail]
    if any(joint):
        parts.append(own.encode(b"".join(joint).decode()))
    return np.concatenate(parts) if parts else np.zeros(0, "<u4")


def _texts(docs: DataFrame) -> DataFrame:
    """doc_id, raw, and a key of the text: texts that share one by chance only know chunks they do not hold."""
    return documents(docs).select("doc_id", F.col("text").cast("binary").alias("raw"), F.xxhash64("text").alias("tx"), F.xxhash64(F.lit(1), "text").alias("ty"))


def _slot(key: str):
    return F.col(key).bitwiseAND(F.lit(FILTER_BITS - 1)).alias("slot")


def repeated(texts: DataFrame, path: str) -> np.ndarray:
    """The bitmap of the chunks that occur more than once."""

    def count(batches):
        specials = codec(path).specials
        for batch in batches:
            chunks = [c for raw in batch.column(1).to_pylist() for c in chunks_of(raw or b"", specials)]
            keys, n = np.unique(chunk_keys(chunks), axis=0, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(keys[:, 0])), pa.array(np.ascontiguousarray(keys[:, 1])), pa.array(n.astype(np.int64))], ["x", "y", "n"])

    counts = texts.mapInArrow(count, "x long, y long, n long").groupBy("x", "y").agg(F.sum("n").alias("n"))
    return bitmap(counts.where("n > 1").select(_slot("x")), FILTER_BITS)


def _picked(batch: pa.RecordBatch, holding: np.ndarray, wanted: bool) -> pa.RecordBatch:
    return batch.filter(pa.array(has_bit(holding, batch.column(2).to_numpy() & (FILTER_BITS - 1)) == wanted))


def _held(texts: DataFrame, path: str, often: np.ndarray, holding: np.ndarray | None, with_chunks: bool) -> DataFrame:
    """A row for each text and repeated chunk in it; with ``holding``, other texts are not looked at."""

    def hold(batches):
        specials = codec(path).specials
        for batch in batches:
            batch = batch if holding is None else _picked(batch, holding, True)
            rows = ([], [], [], [], [])
            for raw, tx, ty in zip(*(batch.column(k).to_pylist() for k in (1, 2, 3))):
                chunks = chunks_of(raw or b"", specials)
                keys = chunk_keys(chunks)
                found = {tuple(keys[k].tolist()): chunks[k] for k in np.flatnonzero(has_bit(often, keys[:, 0] & (FILTER_BITS - 1))).tolist()}
                for (x, y), chunk in found.items():
                    for column, value in zip(rows, (tx, ty, x, y, chunk)):
                        column.append(value)
            columns = [pa.array(r, pa.int64()) for r in rows[:4]] + [pa.array(rows[4], pa.binary())] * with_chunks
            yield pa.RecordBatch.from_arrays(columns, ["tx", "ty", "x", "y", "chunk"][: len(columns)])

    return texts.mapInArrow(hold, HELD + ", chunk binary" * with_chunks)


def shared_chunks(texts: DataFrame, path: str, often: np.ndarray | None = None, holding: np.ndarray | None = None) -> tuple[DataFrame, DataFrame]:
    """(links, codes): which texts hold which shared chunks, and each of those encoded once.

    Neither is stored: the texts are cut again for each, which costs some time
    and saves files of all copies of the chunks.
    """
    often = repeated(texts, path) if often is None else often

    def encode(batches):
        own = codec(path)
        for batch in batches:
            found = [coded(chunk, own) for chunk in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array([f[k] for f in found], pa.binary()) for k in range(3))], ["x", "y", "head", "core", "tail"])

    chunks = _held(texts, path, often, holding, True).groupBy("x", "y").agg(F.first("chunk").alias("chunk"))
    return _held(texts, path, often, holding, False).distinct(), chunks.mapInArrow(encode, CODES)


def encoded(docs: DataFrame, path: str, finish: Callable, schema: str) -> DataFrame:
    """A row for each document: doc_id and what ``finish(ids, codec)`` makes of its ids; schema: all columns."""
    prepare(docs.sparkSession)
    texts = _texts(docs)
    often = repeated(texts, path)
    holding = bitmap(_held(texts, path, often, None, False).select(_slot("tx")), FILTER_BITS)
    links, codes = shared_chunks(texts, path, often, holding)
    names = [c.split()[0] for c in schema.split(", ")]
    kinds = [{"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}[c.split()[1]] for c in schema.split(", ")]

    def rows(doc_ids, found):
        return pa.RecordBatch.from_arrays([doc_ids, *(pa.array([f[k] for f in found], kind) for k, kind in enumerate(kinds[1:]))], names)

    def alone(batches):
        own = codec(path)
        for batch in batches:
            batch = _picked(batch, holding, False)
            yield rows(batch.column(0), [finish(own.encode((raw or b"").decode()), own) for raw in batch.column(1).to_pylist()])

    def sharing(batches):
        for batch in batches:
            yield _picked(batch, holding, True)

    def together(batches):
        own = codec(path)
        for batch in batches:
            found = []
            for raw, marks in zip(batch.column(1).to_pylist(), batch.column(2)):
                fields = [f.to_pylist() for f in marks.values.flatten()] if marks.is_valid else [[]] * 5
                known = {(x, y): entry for x, y, *entry in zip(*fields)}
                chunks = chunks_of(raw or b"", own.specials) if known else []
                found.append(finish(joined(chunks, known, own) if chunks else own.encode((raw or b"").decode()), own))
            yield rows(batch.column(0), found)

    known = links.join(codes.hint("merge"), ["x", "y"]).groupBy("tx", "ty").agg(F.collect_list(F.struct("x", "y", "head", "core", "tail")).alias("known"))
    met = texts.mapInArrow(sharing, TEXTS).join(known.hint("merge"), ["tx", "ty"], "left").select("doc_id", "raw", "known")
    return texts.mapInArrow(alone, schema).unionByName(met.mapInArrow(together, schema))


def bpe_round_trip(docs: DataFrame, path: str | None = None) -> DataFrame:
    """Per row: doc_id, n_tokens, ids_sha256, decoded_sha256.

    Null text counts as empty and has no ids.  Null doc_ids and repeated rows
    are rows like others, and equal texts have equal values; an empty table
    gives an empty result.
    """

    def finish(ids, own):
        return len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256(own.decode(ids)).hexdigest()

    # The rows are small: dealt again, they are not written in a file for each task that encoded some.
    return encoded(docs, path or vocabulary_path(), finish, SCHEMA).hint("rebalance")


def encode_documents(docs: DataFrame, path: str | None = None) -> DataFrame:
    """Per row: doc_id and its ids as little-endian unsigned 32-bit integers."""
    return encoded(docs, path or vocabulary_path(), lambda ids, own: (ids.tobytes(),), "doc_id long, ids binary")


def decode_documents(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """Per row: doc_id and the text that its ids stand for."""
    spark = prepare(encoded.sparkSession)
    path = path or vocabulary_path()

    def run(batches):
        own = codec(path)
        for batch in batches:
            texts = [own.decode(np.frombuffer(x or b"", "<u4")).decode() for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return encoded.select(F.col("doc_id").cast("long"), "ids").mapInArrow(run, "doc_id long, text string")
