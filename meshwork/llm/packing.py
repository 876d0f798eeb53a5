"""Best-fit packing by swap-based local search over a length histogram.

Documents become pieces of at most ``capacity`` tokens.  Which piece goes to
which sequence depends on lengths only, so the search sees the histogram of
lengths (at most ``capacity`` numbers, whatever the corpus holds) and works on
bin patterns with multiplicities: best-fit decreasing opens the bins, then
documents are moved or exchanged one for one, two for one and one for two
between underfull bins.  Each exchange raises the sum of squared fills, and
bins that run empty vanish.  Where no such exchange is left, a few bins at a
time, full ones among them, exchange many for many: they are filled anew, each
as full as can be, if that raises their squared fill.  The search ends at the
lower bound ceil(tokens / capacity), or after ``TRIES`` such exchanges.

Pieces find their places by rank among the pieces of their length.  Ranks are
counted in salted groups with prefix sums over group sizes, so a length that a
third of all pieces share is no task's burden.
"""

from __future__ import annotations

import heapq
import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .bpe import codec, vocabulary_path
from .runtime import documents, materialize, prepare

CAPACITY = 2048
#: Exchanges of many for many that are tried, those in a row without success after which the search ends, and their bins.
TRIES, MISSES, FEW = 20_000, 4000, 8
#: Pieces of one length that one task ranks at most, about.
GROUP_ROWS = 20_000

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
PACKED = f"{PIECES}, sequence_id long, offset long"

Pattern = tuple[tuple[int, int], ...]  # (length, how many of it), by falling length


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document of n tokens; the first takes the remainder."""
    first = n if n <= capacity else n % capacity or capacity
    return [(0, first), *((s, capacity) for s in range(first, n, capacity))]


def pieces_of(docs: DataFrame, path: str, capacity: int) -> DataFrame:
    """One row per piece of each document's ids followed by id 0."""

    def run(batches):
        own, end = codec(path), np.zeros(1, "<u4")
        for batch in batches:
            doc, piece, start, length, crc = [], [], [], [], []
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids = np.concatenate([own.encode(text or ""), end])
                for k, (s, n) in enumerate(cut(len(ids), capacity)):
                    doc.append(i)
                    piece.append(k)
                    start.append(s)
                    length.append(n)
                    crc.append(zlib.crc32(ids[s : s + n].tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array(doc, pa.int64()), pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc))], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return documents(docs).mapInArrow(run, PIECES)


def fill(pattern: Pattern) -> int:
    return sum(n * k for n, k in pattern)


def _plus(pattern: Pattern, gains: Counter) -> Pattern:
    counts = Counter(dict(pattern))
    counts.update(gains)
    return tuple(sorted(((n, k) for n, k in counts.items() if k), reverse=True))


def best_fit_decreasing(lengths: dict[int, int], capacity: int) -> dict[Pattern, int]:
    """Bins of best-fit decreasing, as pattern to multiplicity; lengths: length to count."""
    done: Counter = Counter()
    by_gap: dict[int, Counter] = defaultdict(Counter)
    for n in sorted(lengths, reverse=True):
        left = lengths[n]
        for gap in sorted(g for g in by_gap if g >= n):
            while left and gap >= n and by_gap[gap]:
                pattern, bins = by_gap[gap].popitem()
                each = min(gap // n, left)
                whole = min(bins, left // each)
                if whole < bins:
                    by_gap[gap][pattern] = bins - whole
                by_gap[gap - each * n][_plus(pattern, Counter({n: each}))] += whole
                left -= whole * each
        while left:
            each = min(capacity // n, left)
            bins = left // each
            by_gap[capacity - each * n][((n, each),)] += bins
            left -= bins * each
    for patterns in by_gap.values():
        done.update(patterns)
    return {p: m for p, m in done.items() if m > 0}


def _sums(pattern: Pattern) -> list[tuple[int, int, tuple[int, ...]]]:
    """(tokens, pieces, lengths) of nothing, of each piece and of each two pieces of a bin."""
    own = [n for n, _ in pattern]
    twice = [(x, y) for i, x in enumerate(own) for y in own[i:] if x != y or dict(pattern)[x] > 1]
    return [(0, 0, ()), *((x, 1, (x,)) for x in own), *((x + y, 2, (x, y)) for x, y in twice)]


class _Partners:
    """Underfull bin patterns with the sums of what they can give, to find the best exchange with one of them."""

    def __init__(self):
        self.at: dict[Pattern, int] = {}
        self.names: list[Pattern] = []
        self.fills = np.zeros(0, np.int64)
        self.rows = np.zeros((0, 3), np.int64)  # pattern, tokens, pieces
        self.new: list[tuple[int, int, int]] = []

    def add(self, pattern: Pattern) -> None:
        if pattern not in self.at:
            self.at[pattern] = len(self.names)
            self.names.append(pattern)
            self.new += [(self.at[pattern], tokens, pieces) for tokens, pieces, _ in _sums(pattern)]

    def remove(self, pattern: Pattern) -> None:
        self.at.pop(pattern, None)

    def _table(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        if self.new:
            self.rows = np.concatenate([self.rows, np.array(self.new, np.int64)])
            self.fills = np.append(self.fills, [fill(p) for p in self.names[len(self.fills) :]])
            self.new = []
        alive = np.zeros(len(self.names), bool)
        alive[list(self.at.values())] = True
        if 2 * alive.sum() < len(alive):  # the dead go
            place = np.cumsum(alive) - 1
            self.rows = self.rows[alive[self.rows[:, 0]]]
            self.rows[:, 0] = place[self.rows[:, 0]]
            self.names = [p for p, stays in zip(self.names, alive) if stays]
            self.fills, self.at = self.fills[alive], {p: k for k, p in enumerate(self.names)}
            alive = np.ones(len(self.names), bool)
        return self.rows, self.fills, alive

    def best(self, pattern: Pattern, capacity: int, alone: bool) -> tuple[Pattern, Pattern, Counter, Counter] | None:
        """(giver, receiver, given, taken back) of the exchange with most squared fill, or None; alone: not with itself."""
        rows, fills, alive = self._table()
        if alone:
            alive[self.at[pattern]] = False
        rows = rows[alive[rows[:, 0]]]
        owner, value, pieces = rows.T
        theirs, own, best, found = fills[owner], fill(pattern), 0, None
        for tokens, n, lengths in _sums(pattern):
            together = (n + pieces <= 3) & (n + pieces > 0)
            for gain, fits, ahead in (
                (tokens - value, (n > 0) & ((n < 2) | (pieces > 0)) & (theirs >= own) & (tokens - value <= capacity - theirs), theirs - own),
                (value - tokens, (pieces > 0) & ((pieces < 2) | (n > 0)) & (theirs <= own) & (value - tokens <= capacity - own), own - theirs),
            ):
                raised = np.where(together & fits & (gain > 0), gain * (ahead + gain), 0)
                k = int(raised.argmax()) if len(raised) else 0
                if len(raised) and raised[k] > best:
                    best, gives = raised[k], bool(tokens > value[k])
                    found = (gives, int(owner[k]), lengths, int(value[k]), int(pieces[k]))
        if found is None:
            return None
        gives, k, lengths, tokens, n = found
        other = self.names[k]
        back = next(x for t, m, x in _sums(other) if (t, m) == (tokens, n))
        return (pattern, other, Counter(lengths), Counter(back)) if gives else (other, pattern, Counter(back), Counter(lengths))


def local_search(bins: dict[Pattern, int], capacity: int) -> dict[Pattern, int]:
    """Exchanges that raise the squared fill, until bins are as few as can be or none is left.

    Whether two patterns have an exchange follows from them alone, so a
    pattern is held against all others once, when it appears; when every
    pattern has been, none of them has an exchange with any.  The squared fill
    rises each time, so this ends.
    """
    bins = Counter({p: m for p, m in bins.items() if m > 0})
    least, used = -(-sum(fill(p) * m for p, m in bins.items()) // capacity), sum(bins.values())
    partners = _Partners()
    waiting = [(fill(p), p) for p in bins if fill(p) < capacity]
    heapq.heapify(waiting)
    while waiting and used > least:
        _, p = heapq.heappop(waiting)
        if not bins[p]:
            continue
        partners.add(p)
        found = partners.best(p, capacity, bins[p] < 2)
        if not found:
            continue
        a, b, give, take = found
        pairs = min(bins[a], bins[b]) if a != b else bins[a] // 2
        lost, back = Counter({n: -k for n, k in give.items()}), Counter({n: -k for n, k in take.items()})
        for old, new in ((a, _plus(_plus(a, lost), take)), (b, _plus(_plus(b, back), give))):
            bins[old] -= pairs
            if not new:
                used -= pairs
                continue
            # a second bin of a pattern may have an exchange with the first
            if fill(new) < capacity and bins[new] < 2:
                heapq.heappush(waiting, (fill(new), new))
            bins[new] += pairs
        for old in {a, b}:
            if not bins[old]:
                partners.remove(old)
        if bins[p]:
            heapq.heappush(waiting, (fill(p), p))
    return {p: m for p, m in bins.items() if m > 0}


def fullest(pieces: list[int], capacity: int) -> list[int]:
    """Of pieces in rising order the longest one and those that fill its bin best, longer ones first; they are taken out."""
    out = [pieces.pop()]
    reach = [1]  # by pieces used: a bit for each sum
    for n in pieces:
        reach.append(reach[-1] | reach[-1] << n)
    gap = (reach[-1] & ((1 << (capacity - out[0] + 1)) - 1)).bit_length() - 1
    for k in range(len(pieces) - 1, -1, -1):
        if pieces[k] <= gap and reach[k] >> (gap - pieces[k]) & 1:
            gap -= pieces[k]
            out.append(pieces.pop(k))
    return out


def refilled(bins: dict[Pattern, int], capacity: int) -> dict[Pattern, int]:
    """A few bins at a time filled anew, while that raises their squared fill; the same bins for the same input."""
    bins = Counter({p: m for p, m in bins.items() if m > 0})
    least, used = -(-sum(fill(p) * m for p, m in bins.items()) // capacity), sum(bins.values())
    draws, every, tries, misses = random.Random(0), sorted(bins), 0, 0
    under = [p for p in every if fill(p) < capacity]
    while used > least and tries < TRIES and misses < MISSES:
        tries, misses = tries + 1, misses + 1
        chosen: Counter = Counter()
        for k in range(draws.randint(2, FEW)):
            p = draws.choice(under if k % 2 == 0 else every)
            if chosen[p] < bins[p]:
                chosen[p] += 1
        pieces = sorted(n for p, m in chosen.items() for n, k in p for _ in range(k * m))
        made: Counter = Counter()
        while pieces:
            made[_plus((), Counter(fullest(pieces, capacity)))] += 1
        squares = lambda table: sum(fill(p) ** 2 * m for p, m in table.items())
        if squares(made) <= squares(chosen):
            continue
        misses = 0
        used += sum(made.values()) - sum(chosen.values())
        for p in sorted(made):
            if not bins[p]:
                every.append(p)
                if fill(p) < capacity:
                    under.append(p)
        bins.update(made)
        bins.subtract(chosen)
        if len(every) > 2 * len(bins) or tries % 1000 == 0:  # the dead go
            bins = +bins
            every = sorted(bins)
            under = [p for p in every if fill(p) < capacity]
    return {p: m for p, m in bins.items() if m > 0}


def packed(lengths: dict[int, int], capacity: int) -> dict[Pattern, int]:
    """The fewest bins that the search finds from best-fit decreasing or, a hundredth or more above the bound, from a bin for each piece."""
    least = -(-sum(n * m for n, m in lengths.items()) // capacity)
    best: dict[Pattern, int] = {}
    for start in (best_fit_decreasing, lambda own, _: {((n, 1),): m for n, m in own.items()}):
        if best and 100 * sum(best.values()) < 101 * least:
            break
        found = refilled(local_search(start(lengths, capacity), capacity), capacity)
        best = found if not best or sum(found.values()) < sum(best.values()) else best
    return best


def layout(bins: dict[Pattern, int]) -> np.ndarray:
    """Rows (length, first rank, pieces a bin, first sequence, offset), by length and rank."""
    rows, used, sequence = [], Counter(), 0
    for pattern, m in sorted(bins.items()):
        offset = 0
        for n, each in pattern:
            rows.append((n, used[n], each, sequence, offset))
            used[n] += m * each
            offset += n * each
        sequence += m
    return np.array(sorted(rows), np.int64).reshape(-1, 5)


def best_fit_packing(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """Per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    Null and empty texts have the one token 0 and are packed like others, and
    so are rows with a null or a repeated doc_id.  Pieces of equal length are
    interchangeable; they are ranked by doc_id, piece, start and checksum.  An
    empty table gives an empty result.
    """
    spark = prepare(docs.sparkSession)
    pieces = materialize(pieces_of(docs, path or vocabulary_path(), capacity), "pieces")
    lengths = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}  # capacity rows at most
    table = layout(packed(lengths, capacity))
    salts = max(16, math.ceil(max(lengths.values(), default=0) / GROUP_ROWS))
    salted = pieces.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(salts)))
    before = W.partitionBy("length").orderBy("salt").rowsBetween(W.unboundedPreceding, -1)
    groups = salted.groupBy("length", "salt").count().select("length", "salt", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("before"))
    order = W.partitionBy("length", "salt").orderBy("doc_id", "piece", "start", "ids_crc32")
    ranked = salted.withColumn("rank", F.row_number().over(order)).join(groups, ["length", "salt"])
    ranked = ranked.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("rank") + F.col("before") - 1).cast("long").alias("rank"))
    keys = (table[:, 0] << 48) + table[:, 1]

    def place(batches):
        for batch in batches:
            n, rank = (batch.column(k).to_numpy() for k in (3, 5))
            row = table[np.searchsorted(keys, (n << 48) + rank, "right") - 1]
            within = rank - row[:, 1]
            sequence, offset = row[:, 3] + within // row[:, 2], row[:, 4] + within % row[:, 2] * n
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(5)), pa.array(sequence), pa.array(offset)], ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return ranked.mapInArrow(place, PACKED)
