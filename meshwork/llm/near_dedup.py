"""MinHash near-dedup: one-permutation hashing, banded buckets, star edges.

1.  A document's shingle hashes fall into ``bands * rows`` bins of the hash
    range; the least hash of a bin is its value.  An empty bin takes the value
    of another, found by a hash of (bin, attempt) that all documents share
    (optimal densification).  The values of ``rows`` bins name a bucket.
2.  Documents with equal sets are one node.  In each bucket the node that
    shares most bucket places becomes the centre of a star, and only its edges
    are tested, on the full sets: a bucket of n gives n - 1 edges, not n * n.
3.  Stars alone would lose a link between two documents that both miss the
    centre.  So there are ``stars`` rounds with a new centre each, more of them
    while the rest is large and they make it smaller, and then an exact rest:
    where a bucket still holds several components, the documents outside its
    main component are a query set that is held against all of the bucket, in
    blocks of bounded size, without making a row for a pair.  Every pair that
    shares a bucket is thereby decided on full sets, unless both are in one
    component already.

Documents of similarity s share no bucket with probability
(1 - s ** rows) ** bands.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import connected_components
from .runtime import bitmap, compacted, discard, documents, files_for, has_bit, is_empty, materialize, prepare
from .shingles import mix, shingle_set

#: Shingle hashes in one block of the exact rest, about.
BLOCK_SHINGLES = 500_000
#: Another round of stars comes before the exact rest where the rest would copy more than so many sets a member.
COPIES = 4
#: Edges whose sets one centre's set meets in one task, about; and the share of all edges below which a centre is not dealt out.
CENTRE_EDGES, CENTRE_SHARE = 20_000, 1000
#: Bits of the filter on document ids: 2 MB, broadcast with the function that uses it.
FILTER_BITS = 1 << 24

SIGNATURE = "doc_id long, n_shingles long, set_hash binary, bands array<long>"


@dataclass(frozen=True)
class Near:
    """Link where 100 * intersection >= percent * union of shingle sets."""

    words: int = 5
    percent: int = 80
    bands: int = 36
    rows: int = 5
    stars: int = 1


#: As the query asks: three words, 85 in 100.
QUERY = Near(words=3, percent=85, bands=28, rows=6)


@lru_cache(maxsize=4)
def _bins(near: Near) -> tuple[np.ndarray, np.ndarray]:
    """Lower ends of the bins, and by attempt the donor that each bin tries."""
    k = near.bands * near.rows
    ends = np.array([(i << 64) // k for i in range(k)], np.uint64)
    attempts = np.arange(1, 4 * k + 1, dtype=np.uint64)[:, None] << np.uint64(32)
    return ends, (mix(attempts + np.arange(k, dtype=np.uint64)) % np.uint64(k)).astype(np.int64)


def band_keys(hashes: np.ndarray, near: Near) -> np.ndarray:
    """Bucket of each band, from a non-empty sorted set."""
    ends, donors = _bins(near)
    first = np.searchsorted(hashes, ends)
    filled = np.append(first[1:], len(hashes)) > first
    source = np.where(filled, np.arange(len(ends)), -1)
    for tried in donors:
        empty = source < 0
        if not empty.any():
            break
        source = np.where(empty & filled[tried], tried, source)
    source[source < 0] = np.flatnonzero(filled)[0]
    values = hashes[np.minimum(first, len(hashes) - 1)][source].reshape(near.bands, near.rows)
    keys = np.arange(1, near.bands + 1, dtype=np.uint64)
    for column in values.T:
        keys = mix(keys * np.uint64(0x9E3779B97F4A7C15) + column)
    return keys.view(np.int64)


def signatures(docs: DataFrame, near: Near) -> DataFrame:
    """Per row: doc_id, n_shingles, set_hash and bands; the last two null for an empty set."""
    prepare(docs.sparkSession)

    def run(batches):
        for batch in batches:
            n, digest, bands = [], [], []
            for raw in batch.column(1).to_pylist():
                hashes = shingle_set(raw or b"", near.words)
                n.append(len(hashes))
                digest.append(xxhash.xxh3_128_digest(hashes.tobytes()) if len(hashes) else None)
                bands.append(band_keys(hashes, near) if len(hashes) else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(digest, pa.binary()), pa.array(bands, pa.list_(pa.int64()))], ["doc_id", "n_shingles", "set_hash", "bands"])

    return documents(docs).select("doc_id", F.col("text").cast("binary").alias("raw")).mapInArrow(run, SIGNATURE)


def _slot() -> Column:
    return F.pmod(F.xxhash64("doc_id"), F.lit(FILTER_BITS))


def shingle_sets(docs: DataFrame, wanted: DataFrame, near: Near) -> DataFrame:
    """node and its sorted shingle hashes, of the documents whose ids are wanted.

    A bitmap of fixed size keeps most other texts from being shuffled; what it
    lets through by chance the join takes out.
    """
    there = bitmap(wanted.select(_slot().alias("slot")), FILTER_BITS)

    def run(batches):
        for batch in batches:
            batch = batch.filter(pa.array(has_bit(there, batch.column(2).to_numpy())))
            sets = [shingle_set(raw or b"", near.words).view(np.int64) for raw in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.list_(pa.int64()))], ["node", "hashes"])

    rows = documents(docs).where("doc_id is not null").select("doc_id", F.col("text").cast("binary").alias("raw"), _slot().alias("slot"))
    sets = rows.mapInArrow(run, "node long, hashes array<long>")
    return sets.join(wanted.select(F.col("doc_id").alias("node")), "node", "left_semi")


def _linked(common, n, m, percent: int):
    return 100 * common >= percent * (n + m - common)


def verified(edges: DataFrame, sets: DataFrame, near: Near) -> DataFrame:
    """The stored edges (a, b) whose full sets are similar enough.

    A centre with more than a thousandth of all edges is copied for every
    ``CENTRE_EDGES`` of its own, so no task meets a large star whole; there
    are a thousand such centres at most, and their numbers are broadcast.
    """
    least = max(CENTRE_EDGES, edges.count() // CENTRE_SHARE)
    large = edges.groupBy("a").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > least).select("a", F.ceil(F.col("n") / CENTRE_EDGES).alias("parts"))
    dealt = edges.join(F.broadcast(large), "a", "left").select("a", "b", F.coalesce(F.pmod(F.xxhash64("b"), "parts"), F.lit(0).cast("long")).alias("part"))
    one = sets.select(F.col("node").alias("a"), F.col("hashes").alias("x")).join(F.broadcast(large), "a", "left")
    one = one.select("a", "x", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("parts", F.lit(1).cast("long")) - 1)).alias("part"))
    other = sets.select(F.col("node").alias("b"), F.col("hashes").alias("y"))
    sized = dealt.join(other, "b").join(one, ["a", "part"]).select("a", "b", F.size("x").alias("n"), F.size("y").alias("m"), F.size(F.array_intersect("x", "y")).alias("common"))
    return sized.where(_linked(F.col("common"), F.col("n"), F.col("m"), near.percent)).select("a", "b")


def live_buckets(nodes: DataFrame, files: int) -> DataFrame:
    """(bucket, node, n, places) of buckets with several nodes; places: how many such places the node shares."""
    members = nodes.select("node", "n", F.explode("bands").alias("bucket"))
    sizes = members.groupBy("bucket").agg(F.count(F.lit(1)).alias("members")).where("members > 1")
    shared = members.join(compacted(sizes, "sizes", files).hint("merge"), "bucket")
    places = shared.groupBy("node").agg(F.sum("members").alias("places"))
    return shared.select("bucket", "node", "n").join(places, "node")


def star_edges(live: DataFrame, near: Near, files: int) -> tuple[DataFrame, DataFrame]:
    """(edges, centres): the node of most places in each bucket, joined to those that can be similar to it by size."""
    centres = live.groupBy("bucket").agg(F.max_by(F.struct("node", "n", "component"), F.struct("places", F.xxhash64("bucket", "node"), "node")).alias("c"))
    centres = compacted(centres.select("bucket", F.col("c.node").alias("a"), F.col("c.n").alias("n_a"), F.col("c.component").alias("of_a")), "centres", files)
    rays = live.join(centres, "bucket").where("component <> of_a")
    rays = rays.where(100 * F.least("n", "n_a") >= near.percent * F.greatest("n", "n_a"))
    return compacted(rays.select("a", F.col("node").alias("b")).distinct(), "rays", files), centres.select("bucket", F.col("a").alias("node"))


def mixed_buckets(live: DataFrame, files: int) -> DataFrame:
    """Buckets that still hold several components: bucket, main, members, asking, blocks, turns.

    main: the component of most members; asking: members outside it; blocks
    and turns: of all members and of those that ask, by their shingles.
    """
    by_component = live.groupBy("bucket", "component").agg(F.count(F.lit(1)).alias("k"), F.sum("n").alias("w"))
    most = F.max(F.struct("k", "component", "w"))
    mixed = by_component.groupBy("bucket").agg(most.alias("most"), F.count(F.lit(1)).alias("components"), F.sum("k").alias("members"), F.sum("w").alias("weight")).where("components > 1")
    blocks = lambda weight: F.greatest(F.ceil(weight / BLOCK_SHINGLES), F.lit(1))
    return compacted(mixed.select("bucket", F.col("most.component").alias("main"), "members", (F.col("members") - F.col("most.k")).alias("asking"), blocks(F.col("weight")).alias("blocks"), blocks(F.col("weight") - F.col("most.w")).alias("turns")), "mixed", files)


def copies(mixed: DataFrame) -> tuple[int, int]:
    """(sets that the exact rest would copy, members of its buckets)."""
    row = mixed.agg(F.sum(F.col("members") * F.col("turns") + F.col("asking") * F.col("blocks")).alias("c"), F.sum("members").alias("m")).first()
    return row["c"] or 0, row["m"] or 0


def exact_rest(live: DataFrame, mixed: DataFrame, sets: DataFrame, near: Near, files: int) -> DataFrame:
    """Links (a, b) in buckets that still hold several components."""
    members = live.select("bucket", "node", "component").join(mixed, "bucket")
    dealt = lambda salt, n: F.pmod(F.xxhash64("node", F.lit(salt)), n)
    members = compacted(members.withColumn("block", dealt(1, F.col("blocks"))).withColumn("turn", dealt(2, F.col("turns"))), "members", files)
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    base = members.select("bucket", "node", "component", "block", every("turns").alias("turn"), F.lit(False).alias("asks"))
    asking = members.where("component <> main").select("bucket", "node", "component", every("blocks").alias("block"), "turn", F.lit(True).alias("asks"))
    rows = base.unionByName(asking).join(sets, "node")
    percent = near.percent

    def links(table: pa.Table) -> pa.Table:
        asks = table.column("asks").to_numpy(zero_copy_only=False)
        nodes, components = table.column("node").to_numpy(), table.column("component").to_numpy()
        sets_here = [np.asarray(x.values) for x in table.column("hashes")]
        base_rows = np.flatnonzero(~asks)
        a, b = [], []
        if len(base_rows) and asks.any():
            sizes = np.array([len(sets_here[i]) for i in base_rows])
            values = np.concatenate([sets_here[i] for i in base_rows])
            owner = np.repeat(np.arange(len(base_rows)), sizes)
            order = np.argsort(values, kind="stable")
            values, owner = values[order], owner[order]
            joined: dict[int, int] = {}

            def root(x: int) -> int:
                while joined.get(x, x) != x:
                    x = joined[x]
                return x

            for q in np.flatnonzero(asks):
                own = sets_here[q]
                low, high = np.searchsorted(values, own, "left"), np.searchsorted(values, own, "right")
                spans = high - low
                at = np.repeat(low - np.cumsum(spans) + spans, spans) + np.arange(spans.sum())
                common = np.bincount(owner[at], minlength=len(base_rows))
                for k in np.flatnonzero(_linked(common, len(own), sizes, percent)):
                    x, y = root(int(components[q])), root(int(components[base_rows[k]]))
                    if x != y:
                        joined[x] = y
                        a.append(int(nodes[q]))
                        b.append(int(nodes[base_rows[k]]))
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return rows.groupBy("bucket", "block", "turn").applyInArrow(links, "a long, b long")


def _regrouped(live: DataFrame, links: DataFrame, first: bool, files: int) -> DataFrame:
    """``live`` with components joined by links between its nodes; in the first round nodes are components."""
    if not first:
        known = live.select("node", "component").distinct()
        links = links.join(known.select(F.col("node").alias("a"), F.col("component").alias("x")), "a").join(known.select(F.col("node").alias("b"), F.col("component").alias("y")), "b")
        links = links.select(F.col("x").alias("a"), F.col("y").alias("b"))
    found = connected_components(links, files).select(F.col("node").alias("component"), F.col("component").alias("joined"))
    return live.join(found, "component", "left").withColumn("component", F.coalesce("joined", "component")).drop("joined")


def near_groups(docs: DataFrame, near: Near = Near()) -> DataFrame:
    """Per row of ``docs``: doc_id, n_shingles, component_id, kept.

    Null, empty and blank texts have empty sets and are linked with nothing.
    ``component_id`` is the smallest doc_id that links reach, the document
    itself included, so of equal texts the smallest doc_id is kept; ties
    between centres decide which pairs are tested first, never the result.
    Rows with a null doc_id have a null component_id and are not kept; rows
    that share a doc_id are one document with the links of all their texts.
    An empty table gives an empty result.
    """
    docs = documents(docs)
    signed = materialize(signatures(docs, near), "signatures")
    files = files_for(signed.count())
    usable = signed.where("n_shingles > 0 and doc_id is not null")
    equal = compacted(usable.groupBy("set_hash").agg(F.min("doc_id").alias("node")), "equal", files)
    first = equal.select("set_hash", F.col("node").alias("doc_id"))
    nodes = usable.join(first, ["set_hash", "doc_id"]).select(F.col("doc_id").alias("node"), F.col("n_shingles").alias("n"), "bands")
    live = compacted(live_buckets(nodes, files).withColumn("component", F.col("node")), "buckets", files)
    alike = usable.join(equal, "set_hash").where("doc_id <> node").select(F.col("doc_id").alias("a"), F.col("node").alias("b"))
    links = [alike]
    if not is_empty(live):
        wanted = live.select(F.col("node").alias("doc_id")).distinct()
        sets = materialize(shingle_sets(docs, wanted, near), "sets")
        turn, mixed, before = 0, None, math.inf
        while True:
            if turn >= near.stars:
                mixed = mixed_buckets(live, files)
                now, members = copies(mixed)
                if now <= COPIES * members or now > 0.9 * before:
                    break
                before = now
            edges, centres = star_edges(live, near, files)
            found = materialize(verified(edges, sets, near), "links")
            links.append(found)
            last, live = live, compacted(_regrouped(live, found, turn == 0, files).join(centres, ["bucket", "node"], "left_anti"), "buckets", files)
            discard(last)
            turn += 1
        links.append(exact_rest(live, mixed, sets, near, files))
    every = links[0]
    for more in links[1:]:
        every = every.unionByName(more)
    groups = connected_components(every, files).select(F.col("node").alias("doc_id"), F.col("component").alias("component_id"))
    return signed.select("doc_id", "n_shingles").join(groups, "doc_id", "left").select(
        "doc_id",
        "n_shingles",
        F.coalesce("component_id", "doc_id").alias("component_id"),
        (F.coalesce(F.coalesce("component_id", "doc_id") == F.col("doc_id"), F.lit(False))).alias("kept"),
    )
