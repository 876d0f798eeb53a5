"""Substring dedup by sliding sentence spans.

A text is a chain of sentences, each with the white space after it.  A
sentence ends after closing punctuation, at a line's end, or before a
capitalised word that follows another, so that a passage pasted into another
sentence still begins a sentence of its own.  From every sentence a span slides
forwards over the sentences that follow and backwards over those before, until
it has ``words`` words; the last sentence that it reaches may be cut, and a
longer sentence is a span by itself.  Spans are hashed to 128 bits over their
words and joined over all documents, and the whole sentences of a span go when
an earlier copy of it exists: in a smaller doc_id, or before it in its own
document.

A passage of n words that repeats loses every whole sentence that has
``words`` words of the passage from its start on or up to its end; with
2 * words <= n + 1 that is every sentence.

Only one row for each distinct span of a document leaves its task, so a span
repeated within a document is no hot key, and the smallest doc_id of a span is
found by partial aggregation.  A document that repeats itself leaves one row
more, without a span; texts that nothing was found of are not split again.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .runtime import documents, materialize, prepare, unpacked
from .shingles import WORD_HASHES

#: Ends of sentences: after closing punctuation, a line's end, or before a capital.
SENTENCE_END = re.compile(r"(?<=[.!?…。！？])\s+|\n+|(?<=[^\sA-ZÀ-ÖØ-Þ])\s+(?=[A-ZÀ-ÖØ-Þ])")


@dataclass(frozen=True)
class Spans:
    """words: the words of a span, at least."""

    words: int = 40


def sentences(text: str) -> list[str]:
    """The sentences of a text; joined they are the text."""
    ends = [m.end() for m in SENTENCE_END.finditer(text)]
    ends = [*ends, len(text)] if not ends or ends[-1] < len(text) else ends
    return [text[a:b] for a, b in zip([0, *ends], ends)]


def spans_of(parts: list[str], rule: Spans) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(first sentence, sentences, first word, key) of each span; a key is two 64-bit numbers.

    The sentences are those that lie wholly in the span.  Sentences without
    words between them belong to the span but give nothing to its key.
    """
    words = [p.lower().encode().split() for p in parts]
    n = np.fromiter(map(len, words), np.int64, len(words))
    full = np.flatnonzero(n)
    h = np.fromiter(map(WORD_HASHES.__getitem__, chain.from_iterable(words)), np.uint64, int(n.sum()))
    ends = np.cumsum(n[full])
    starts = ends - n[full]
    to, since = np.maximum(ends, starts + rule.words), np.minimum(starts, ends - rule.words)
    ahead, back = np.flatnonzero(to <= len(h)), np.flatnonzero(since >= 0)
    a, b = np.append(starts[ahead], since[back]), np.append(to[ahead], ends[back])
    first = np.append(ahead, np.searchsorted(starts, since[back]))
    last = np.append(np.searchsorted(ends, to[ahead], "right") - 1, back)
    _, own = np.unique(a * (len(h) + 1) + b, return_index=True)
    a, b, first, last = a[own], b[own], first[own], last[own]
    raw = h.tobytes()
    keys = np.frombuffer(b"".join([xxhash.xxh3_128_digest(raw[i:j]) for i, j in zip((8 * a).tolist(), (8 * b).tolist())]), np.int64).reshape(-1, 2)
    return full[first], full[last] - full[first] + 1, a, keys


def kept_sentences(parts: list[str], known: set[tuple[int, int]], rule: Spans) -> np.ndarray:
    """Which sentences stay: those in no span that is known from elsewhere or from before."""
    first, size, _, keys = spans_of(parts, rule)
    covered = np.zeros(len(parts) + 1, np.int64)
    before = set(known)
    for i, n, key in zip(first.tolist(), size.tolist(), map(tuple, keys.tolist())):  # in the order of first words
        if key in before:
            covered[i] += 1
            covered[i + n] -= 1
        else:
            before.add(key)
    return np.cumsum(covered[:-1]) == 0


def span_dedup(docs: DataFrame, rule: Spans = Spans(), carry: list[str] | None = None) -> DataFrame:
    """Per row of ``docs``: doc_id, text, n_removed and the ``carry`` columns.

    n_removed counts sentences.  Null text stays null and empty text empty; a
    text of fewer words than a span loses nothing.  Rows with a null doc_id
    stay as they are.  Rows that share a doc_id are one document: they never
    take a span from one another.  Of equal spans in several documents the
    smallest doc_id keeps its own.  An empty table gives an empty result.
    """
    spark = prepare(docs.sparkSession)
    docs = documents(docs, carry=carry or [])

    def emit(batches):
        for batch in batches:
            names, keys = [], []
            for name, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                every = spans_of(sentences(text), rule)[3]
                found = np.unique(every, axis=0)
                names.append(np.full(len(found), name, np.int64))
                keys.append(found)
                if len(found) < len(every):
                    names.append(np.full(1, name, np.int64))
                    keys.append(None)
            if names:
                span = lambda k: pa.concat_arrays([pa.nulls(1, pa.int64()) if x is None else pa.array(x[:, k]) for x in keys])
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(names)), span(0), span(1)], ["doc_id", "span", "check"])

    found = docs.where("doc_id is not null and text is not null").select("doc_id", "text").mapInArrow(emit, "doc_id long, span long, check long")
    found = materialize(found, "emitted")
    spans = found.where("span is not null")
    first = spans.groupBy("span", "check").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("first < last").select("span", "check", "first")
    later = spans.join(materialize(first, "repeated").hint("merge"), ["span", "check"]).where("doc_id > first").select("doc_id", "span", "check").unionByName(found.where("span is null"))
    known = materialize(later.groupBy("doc_id").agg(F.collect_list(F.when(F.col("span").isNotNull(), F.struct("span", "check"))).alias("known")), "known")

    def remove(batches):
        for batch in batches:
            texts, gone = [], []
            for text, marks in zip(batch.column(1).to_pylist(), batch.column(2)):
                if not text or not marks.is_valid:
                    texts.append(text)
                    gone.append(0)
                    continue
                parts = sentences(text)
                keys = marks.values.flatten()
                stay = kept_sentences(parts, set(zip(keys[0].to_pylist(), keys[1].to_pylist())), rule)
                texts.append("".join(p for p, s in zip(parts, stay) if s))
                gone.append(int((~stay).sum()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string()), pa.array(gone, pa.int64()), batch.column(3)], ["doc_id", "text", "n_removed", "more"])

    kind = docs.schema["more"].dataType.simpleString()
    cleaned = docs.join(known.hint("merge"), "doc_id", "left").select("doc_id", "text", "known", "more").mapInArrow(remove, f"doc_id long, text string, n_removed long, more {kind}")
    return unpacked(cleaned, carry or [])
