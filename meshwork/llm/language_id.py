"""Language identification by sparse multinomial logistic regression.

Features are hashed character n-grams of the whole lower-cased text, weighted
by log counts and inverse document frequency and scaled to length 1.  Document
frequencies are counted over every training document.  The weights are learnt
with follow-the-regularised-leader and an elastic net from a bounded sample of
labelled documents (``Learning.max_rows``, dealt evenly over the labels), and a
temperature is fitted on a part of the sample that training leaves out.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .runtime import documents, prepare, unpacked

SLOT_BITS, GRAMS = 13, (1, 2, 3)
SLOTS = 1 << SLOT_BITS
#: Characters of a text that are looked at together.
BLOCK = 1 << 18
UNKNOWN = "und"
#: Values of the hash that draws the sample.
HASHES = 1 << 31


@dataclass(frozen=True)
class Learning:
    """max_rows: labelled documents that the weights are learnt from, at most."""

    max_rows: int = 1500
    epochs: int = 4
    alpha: float = 0.5
    beta: float = 1.0
    l1: float = 1e-3
    l2: float = 1e-3
    calibration: float = 0.2


@dataclass(frozen=True)
class Model:
    """weights: a row for each language, the bias last."""

    languages: tuple[str, ...]
    idf: np.ndarray
    weights: np.ndarray
    temperature: float


def gram_counts(text: str) -> tuple[np.ndarray, np.ndarray]:
    """(slots, counts) of the n-grams of the whole text."""
    total = np.zeros(SLOTS, np.int64)
    longest = max(GRAMS)
    for at in range(0, len(text), BLOCK):
        codes = np.frombuffer(text[at : at + BLOCK + longest - 1].lower().encode("utf-32-le", "surrogatepass"), "<u4")
        for n in GRAMS:
            starts = min(BLOCK, len(codes) - n + 1)
            if starts <= 0:
                continue
            h = np.full(starts, n, np.uint32)
            for k in range(n):
                h = (h ^ codes[k : starts + k]) * np.uint32(0x9E3779B1)
                h ^= h >> np.uint32(15)
            total += np.bincount((h * np.uint32(0x85EBCA77)) >> np.uint32(32 - SLOT_BITS), minlength=SLOTS)
    slots = np.flatnonzero(total)
    return slots, total[slots]


def weighted(slots: np.ndarray, counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Log counts times idf, of length 1."""
    v = np.log1p(counts) * idf[slots]
    return v / (np.linalg.norm(v) or 1.0)


def has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


def held_out(doc_id: Column) -> Column:
    """Whether crc32 of the id as text leaves 2 divided by 4; false for a null id."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def document_frequencies(texts: DataFrame) -> tuple[np.ndarray, int]:
    """By slot the number of texts with it, and the number of texts; SLOTS numbers reach the driver."""

    def run(batches):
        found, n = np.zeros(SLOTS + 1, np.int64), 0
        for batch in batches:
            for text in batch.column(0).to_pylist():
                found[gram_counts(text)[0]] += 1
                n += 1
        found[SLOTS] = n
        at = np.flatnonzero(found)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(found[at])], ["slot", "n"])

    counts = np.zeros(SLOTS + 1, np.int64)
    for row in texts.mapInArrow(run, "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n")).collect():
        counts[row["slot"]] = row["n"]
    return counts[:SLOTS], int(counts[SLOTS])


def sample(labelled: DataFrame, rows: int) -> list[tuple[str, np.ndarray, np.ndarray]]:
    """(language, slots, counts) of at most ``rows`` documents: the first by hash of each language in turn.

    Of a language with many documents only the hashes below a bound that its
    count gives are ranked, so that no task meets a whole language.
    """
    spread = F.pmod(F.xxhash64("doc_id", F.lit("sample")), F.lit(HASHES))
    hashed = labelled.select("doc_id", "lang", spread.alias("spread"))
    counts = hashed.groupBy("lang").agg((HASHES * 3.0 * rows / F.count(F.lit(1))).alias("below"))
    near_first = hashed.join(counts, "lang").where("spread < below").drop("below")
    turn = F.row_number().over(W.partitionBy("lang").orderBy("spread", "doc_id"))
    chosen = near_first.withColumn("turn", turn).where(F.col("turn") <= rows)
    names = [r["doc_id"] for r in chosen.orderBy("turn", "spread", "doc_id", "lang").limit(rows).select("doc_id").collect()]
    if not names:
        return []
    wanted = labelled.sparkSession.createDataFrame([(i,) for i in names], "doc_id long")
    found = labelled.join(F.broadcast(wanted), "doc_id", "left_semi").select("doc_id", "lang", "text")

    def run(batches):
        for batch in batches:
            counted = [gram_counts(text) for text in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([c[0].astype(np.int16) for c in counted], pa.list_(pa.int16())), pa.array([c[1].astype(np.int32) for c in counted], pa.list_(pa.int32()))], ["doc_id", "lang", "slots", "counts"])

    got = found.mapInArrow(run, "doc_id long, lang string, slots array<short>, counts array<int>").toArrow().sort_by([("doc_id", "ascending")])
    rank = {name: k for k, name in enumerate(names)}
    rows_here = sorted(range(got.num_rows), key=lambda k: (rank[got["doc_id"][k].as_py()], got["lang"][k].as_py()))[:rows]
    return [(got["lang"][k].as_py(), np.asarray(got["slots"][k].values), np.asarray(got["counts"][k].values)) for k in rows_here]


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def ftrl(examples: list[tuple[int, np.ndarray, np.ndarray]], classes: int, how: Learning) -> np.ndarray:
    """Weights (classes, SLOTS + 1) of multinomial logistic regression; examples: (class, slots, values)."""
    z, n = np.zeros((classes, SLOTS + 1)), np.zeros((classes, SLOTS + 1))

    def weights(at) -> np.ndarray:
        pull = z[:, at]
        w = -(pull - np.sign(pull) * how.l1) / ((how.beta + np.sqrt(n[:, at])) / how.alpha + how.l2)
        return np.where(np.abs(pull) <= how.l1, 0.0, w)

    draws = np.random.default_rng(0)
    for _ in range(how.epochs):
        for k in draws.permutation(len(examples)):
            y, slots, values = examples[k]
            at, x = np.append(slots, SLOTS), np.append(values, 1.0)
            w = weights(at)
            miss = _softmax(w @ x)
            miss[y] -= 1
            g = miss[:, None] * x
            z[:, at] += g - (np.sqrt(n[:, at] + g * g) - np.sqrt(n[:, at])) / how.alpha * w
            n[:, at] += g * g
    return weights(slice(None))


def temperature(logits: np.ndarray, classes: np.ndarray) -> float:
    """The divisor of the logits that makes their softmax likeliest, by golden-section search on its logarithm."""
    if not len(classes):
        return 1.0

    def loss(log_t: float) -> float:
        p = _softmax(logits / np.exp(log_t))[np.arange(len(classes)), classes]
        return -np.log(np.maximum(p, 1e-12)).mean()

    low, high, part = -3.0, 3.0, (5**0.5 - 1) / 2
    for _ in range(40):
        a, b = high - part * (high - low), low + part * (high - low)
        low, high = (low, b) if loss(a) <= loss(b) else (a, high)
    return float(np.exp((low + high) / 2))


def fit(docs: DataFrame, how: Learning = Learning()) -> Model:
    """Learns from text and lang of the documents that are not held out; null langs and letterless texts teach nothing."""
    prepare(docs.sparkSession)
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.col("lang").cast("string").alias("lang"))
    labelled = own.where(F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")) & F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    found, n = document_frequencies(labelled.select("text"))
    idf = np.log((1 + n) / (1 + found)) + 1
    rows = sample(labelled, how.max_rows)
    languages = tuple(sorted({lang for lang, _, _ in rows}))
    examples = [(languages.index(lang), slots, weighted(slots, counts, idf)) for lang, slots, counts in rows]
    aside = int(len(examples) * how.calibration)
    weights = ftrl(examples[aside:], len(languages), how) if languages else np.zeros((0, SLOTS + 1))
    logits = np.array([weights[:, s] @ v + weights[:, SLOTS] for _, s, v in examples[:aside]]).reshape(aside, len(languages))
    return Model(languages, idf, weights, temperature(logits, np.array([y for y, _, _ in examples[:aside]], int)))


def predict(model: Model, text: str | None) -> tuple[str, float]:
    """(language, probability); UNKNOWN and 0 for null or letterless text, or where nothing was learnt."""
    if not model.languages or not has_letter(text):
        return UNKNOWN, 0.0
    slots, counts = gram_counts(text)
    p = _softmax((model.weights[:, slots] @ weighted(slots, counts, model.idf) + model.weights[:, SLOTS]) / model.temperature)
    k = int(np.argmax(p))
    return model.languages[k], min(1.0, float(p[k]))


def classify(docs: DataFrame, model: Model, carry: list[str] | None = None) -> DataFrame:
    """Per row: doc_id, text, lang_pred, score and the ``carry`` columns."""
    prepare(docs.sparkSession)
    table = documents(docs, carry=carry or [])

    def run(batches):
        for batch in batches:
            found = [predict(model, text) for text in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64()), batch.column(2)], ["doc_id", "text", "lang_pred", "score", "more"])

    kind = table.schema["more"].dataType.simpleString()
    return unpacked(table.mapInArrow(run, f"doc_id long, text string, lang_pred string, score double, more {kind}"), carry or [])


def language_id(docs: DataFrame, how: Learning = Learning()) -> DataFrame:
    """Per row: doc_id, held_out, lang_pred, score.

    Null and letterless texts are ``und`` with score 0, and so is everything
    where no document is labelled.  A null doc_id is not held out and teaches
    nothing; repeated rows are rows like others; an empty table gives an empty
    result.  Equal probabilities go to the language that sorts first.
    """
    found = classify(docs, fit(docs, how))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
