"""Line dedup: a suffix array over line-id sequences by prefix doubling.

A document is a sequence of lines; a suffix begins at each.  Suffixes are
ranked by their first line, then by their first 2, 4, 8 ... lines: the rank by
2k lines is the rank of the pair (rank by k at i, rank by k at i + k), and the
pairs are ranked by a distributed sort of the distinct ones.  A pair that
occurs once is ranked for good and drops out, so a round handles what still
repeats.

A repeated run of lines counts from ``min_words`` words on.  From each line the
shortest such run goes ahead, and to each line one comes from behind; every
longer run that counts is the union of such runs.  Suffixes that begin with
the same run of l lines are an interval of the suffix array in which the
longest common prefix is l or more, and with k the power of two up to l the
interval is named by two ranks by k lines: at the run's first line and k lines
before its end.  So a round of the doubling finds the intervals of its lengths,
and the rounds end when no run is longer.  In an interval the occurrence that
comes first in (doc_id, line) order stays; the maximal repeated runs that the
later ones make up are deleted.

No sort, window or join meets a hot line in one task: the sort sees each
distinct pair once with its count, the window is by document, and the joins
are plain equi-joins of stored tables, which Spark can split.  Their smaller
sides grow with the corpus, so they are merge joins.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .runtime import documents, is_empty, materialize, prepare, unpacked

#: Words of a run that counts, at least.
MIN_WORDS = 8

#: A suffix: its document (by id and text, as ids may repeat) and first line.
PLACE = ["doc_id", "version", "line"]
LINES = "doc_id long, version long, line int, x long, y long, runs array<int>"


def shortest_runs(words: np.ndarray, min_words: int) -> np.ndarray:
    """Rows (first line, lines) of the shortest runs ahead of and behind each line, without repeats and in order."""
    before = np.append(0, np.cumsum(words))
    line = np.arange(len(words))
    ahead = np.searchsorted(before, before[:-1] + min_words)
    behind = np.searchsorted(before, before[1:] - min_words, "right") - 1
    there, back = ahead <= len(words), behind >= 0
    runs = np.concatenate([np.stack([line[there], ahead[there] - line[there]], 1), np.stack([behind[back], line[back] + 1 - behind[back]], 1)])
    return np.unique(runs, axis=0)


def suffixes(docs: DataFrame, min_words: int) -> DataFrame:
    """One row a line: its place, 128 bits of hash (x, y), and the lengths of the shortest runs that begin with it."""
    prepare(docs.sparkSession)

    def run(batches):
        for batch in batches:
            size, first, keys, lengths = [], [], [], []
            for text in batch.column(2).to_pylist():
                lines = [x.encode() for x in text.split("\n")]
                keys += [xxhash.xxh3_128_digest(x) for x in lines]
                runs = shortest_runs(np.fromiter((len(x.split()) for x in lines), np.int64, len(lines)), min_words)
                size.append(len(lines))
                first.append(np.bincount(runs[:, 0], minlength=len(lines)))
                lengths.append(runs[:, 1])
            if not keys:
                continue
            at = np.repeat(np.arange(len(size)), size)
            line = np.arange(len(keys)) - np.repeat(np.cumsum(size) - size, size)
            x, y = np.frombuffer(b"".join(keys), np.int64).reshape(-1, 2).T
            offsets = np.append(0, np.cumsum(np.concatenate(first))).astype(np.int32)
            runs = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(lengths).astype(np.int32)))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), batch.column(1).take(pa.array(at)), pa.array(line.astype(np.int32)), pa.array(np.ascontiguousarray(x)), pa.array(np.ascontiguousarray(y)), runs], ["doc_id", "version", "line", "x", "y", "runs"])

    named = documents(docs).where("doc_id is not null and text is not null")
    return named.select("doc_id", F.xxhash64("text").alias("version"), "text").mapInArrow(run, LINES)


def ranked(pairs: DataFrame) -> DataFrame:
    """Suffixes whose pair (x, y) repeats, with the pair's rank in the order of pairs.

    The rank is the position in a range-partitioned sort, so it grows with the
    pair and is the same for equal pairs; it is written down before it is used.
    """
    repeated = pairs.groupBy("x", "y").agg(F.count(F.lit(1)).alias("n"))
    order = repeated.where("n > 1").select("x", "y").repartitionByRange("x", "y").sortWithinPartitions("x", "y")
    ranks = materialize(order.withColumn("rank", F.monotonically_increasing_id()), "ranks")
    return materialize(pairs.join(ranks.hint("merge"), ["x", "y"]).select(*PLACE, "rank", "runs"), "suffixes")


def shifted(by_rank: DataFrame, lines: int) -> DataFrame:
    """Pairs of the rank of a suffix and the rank so many lines further on, where both repeat."""
    ahead = W.partitionBy("doc_id", "version").orderBy("line").rangeBetween(lines, lines)
    pairs = by_rank.select(*PLACE, F.col("rank").alias("x"), F.max("rank").over(ahead).alias("y"), "runs")
    return pairs.where("y is not null")


def doubled(docs: DataFrame, min_words: int = MIN_WORDS) -> list[tuple[int, DataFrame]]:
    """(lines, ranked suffixes) for 1, 2, 4 ... lines, while a run of so many lines counts and repeats."""
    lines, levels = 1, []
    now = ranked(materialize(suffixes(docs, min_words), "lines").dropDuplicates(PLACE))
    while not is_empty(now.where(F.exists("runs", lambda n: n >= lines))):
        levels.append((lines, now))
        now = ranked(shifted(now, lines))
        lines *= 2
    return levels


def occurrences(lines: int, by_rank: DataFrame) -> DataFrame:
    """The runs of ``lines`` up to 2 * lines - 1 lines: place, lines, and the two ranks that name their interval."""
    runs = by_rank.select(*PLACE, "rank", F.explode(F.filter("runs", lambda n: (n >= lines) & (n < 2 * lines))).alias("lines"))
    if lines == 1:
        return runs.withColumn("tail", F.col("rank"))
    tails = by_rank.select("doc_id", "version", F.col("line").alias("at"), F.col("rank").alias("tail"))
    return runs.withColumn("at", F.col("line") + F.col("lines") - lines).join(tails, ["doc_id", "version", "at"]).drop("at")


def intervals(found: DataFrame) -> DataFrame:
    """Intervals of the suffix array with several suffixes: lines of common prefix, the two ranks, size, first place."""
    return found.groupBy("lines", "rank", "tail").agg(F.count(F.lit(1)).alias("size"), F.min(F.struct(*PLACE)).alias("first")).where("size > 1")


def repeated_runs(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame | None:
    """Later copies (place, lines) of the shortest runs that count, from the intervals of every level."""
    later = None
    for lines, by_rank in doubled(docs, min_words):
        found = occurrences(lines, by_rank)
        first = materialize(intervals(found), "intervals").select("lines", "rank", "tail", "first")
        own = found.join(first.hint("merge"), ["lines", "rank", "tail"]).where(F.struct(*PLACE) > F.col("first")).select(*PLACE, "lines")
        later = own if later is None else later.unionByName(own)
    return later


def without_lines(docs: DataFrame) -> DataFrame:
    """``docs`` (doc_id, text, runs, more) without the lines of the runs."""

    def remove(batches):
        for batch in batches:
            texts, n, gone = [], [], []
            for text, runs in zip(batch.column(1).to_pylist(), batch.column(2)):
                lines = [] if text is None else text.split("\n")
                n.append(len(lines))
                if not runs.is_valid:
                    texts.append(text)
                    gone.append(0)
                    continue
                first, size = (np.asarray(x) for x in runs.values.flatten())
                covered = np.zeros(len(lines) + 1, np.int64)
                np.add.at(covered, first, 1)
                np.add.at(covered, first + size, -1)
                drop = np.cumsum(covered[:-1]) > 0
                texts.append("\n".join(x for x, d in zip(lines, drop) if not d))
                gone.append(int(drop.sum()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string()), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), batch.column(3)], ["doc_id", "text", "n_lines", "n_removed", "more"])

    kind = docs.schema["more"].dataType.simpleString()
    return docs.select("doc_id", "text", "runs", "more").mapInArrow(remove, f"doc_id long, text string, n_lines long, n_removed long, more {kind}")


def line_dedup(docs: DataFrame, min_words: int = MIN_WORDS, carry: list[str] | None = None) -> DataFrame:
    """Per row of ``docs``: doc_id, text, n_lines, n_removed and the ``carry`` columns.

    A line goes that lies in a run of whole lines with ``min_words`` words or
    more of which an earlier copy exists, in whatever document.  Words are what
    spaces and the characters 9 to 13 leave between them.  Null text stays null
    and has no lines; empty text is one empty line.  Rows with a null doc_id
    stay as they are.  Repeated rows of equal id and text are one document and
    lose the same lines.  An empty table gives an empty result.
    """
    if min_words < 1:
        raise ValueError("min_words must be positive")
    prepare(docs.sparkSession)
    later = repeated_runs(docs, min_words)
    named = documents(docs, carry=carry or []).withColumn("version", F.when(F.col("doc_id").isNotNull(), F.xxhash64("text")))
    if later is None:
        marked = named.withColumn("runs", F.lit(None).cast("array<struct<line: int, lines: int>>"))
    else:
        runs = later.groupBy("doc_id", "version").agg(F.collect_list(F.struct("line", "lines")).alias("runs"))
        marked = named.join(materialize(runs, "runs").hint("merge"), ["doc_id", "version"], "left")
    return unpacked(without_lines(marked), carry or [])
