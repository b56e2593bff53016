"""SimHash near-duplicates: BK-trees over fingerprint shards, then connected components.

1. 64-bit fingerprints of word shingles, one pass over the text; only
   (doc_id, fingerprint) goes on.
2. Distinct fingerprints are sharded so that any two within ``radius`` bits
   share a shard: the 64 bits are cut into ``radius + 2`` blocks, and two
   fingerprints that differ in ``radius`` bits agree on at least two whole
   blocks, so a shard is the value of one pair of blocks.
3. Each shard builds a BK-tree (children keyed by integer Hamming distance)
   and grows components with it: a query follows only edges within the radius,
   what it reaches leaves the tree, and subtrees without members are skipped.
   A shard so gives a spanning forest, never all pairs.
4. A shard above ``shard_rows`` rows is dealt by hash into runs, and every two
   runs meet in a task of their own, so no task holds more than two runs.
5. Forests become components by alternating large and small stars, with a
   reliable checkpoint per round.

Trees are not broadcast: fingerprints of a whole corpus have no size bound, so
they are routed to the trees of their shards by a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from repolens.llm.shared import picked, raw_texts, slices

#: Shares of a component when its name goes to its fingerprints; fingerprints without links take no part.
SALTS = 16


def fingerprint(raw: bytes, shingle: int, seed: int) -> int:
    """Bits set in over half of the shingles' XXH64 values; 0 for a text without words."""
    import xxhash

    words = raw.lower().split()  # bytes: lower-cases A-Z only, splits at ASCII white space only
    if not words:
        return 0
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(b" ".join(words), seed)
    line, digest = b" ".join(words), xxhash.xxh64_intdigest
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    last = len(words) - shingle + 1
    hashes = np.fromiter([digest(line[a:b], seed) for a, b in zip(starts[:last].tolist(), ends[shingle - 1:].tolist())],
                         np.uint64, last)
    ones = np.zeros(64, np.int64)
    for at in range(0, last, 1 << 15):
        bits = np.unpackbits(hashes[at:at + (1 << 15)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > last, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, shingle: int = 4, seed: int = 42) -> DataFrame:
    """doc_id, tie (a hash of the text) and fp (the fingerprint as a signed long) of every row."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1):
            found = np.array([fingerprint(raw, shingle, seed) for raw in raw_texts(batch.column(1))], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(found.view(np.int64))],
                                             names=["doc_id", "tie", "fp"])

    source = picked(docs, "doc_id", "text").select(
        F.col("doc_id").cast("long"), F.col("text").cast("string"), F.xxhash64("text").alias("tie"))
    return source.mapInArrow(run, "doc_id long, tie long, fp long")


class BKTree:
    """Children keyed by integer distance; members leave the tree, their nodes go on routing."""

    def __init__(self, values: list[int]):
        self.values, self.children, self.parent = values, [{} for _ in values], [-1] * len(values)
        self.alive, self.inside = [1] * len(values), [True] * len(values)
        for i in range(1, len(values)):
            at = 0
            while True:
                self.alive[at] += 1
                d = (values[i] ^ values[at]).bit_count()
                child = self.children[at].get(d)
                if child is None:
                    self.children[at][d] = i
                    self.parent[i] = at
                    break
                at = child

    def leave(self, i: int) -> None:
        self.inside[i] = False
        while i >= 0:
            self.alive[i] -= 1
            i = self.parent[i]

    def take(self, value: int, radius: int) -> list[int]:
        """Members within ``radius`` of ``value``; they leave the tree."""
        found, stack = [], [0]
        while stack:
            at = stack.pop()
            if not self.alive[at]:
                continue
            d = (value ^ self.values[at]).bit_count()
            if d <= radius and self.inside[at]:
                self.leave(at)
                found.append(at)
            stack += [c for key, c in self.children[at].items() if d - radius <= key <= d + radius]
        return found


def forest(values: list[int], radius: int) -> list[tuple[int, int]]:
    """Links (at most len(values) - 1) that connect all values linked, directly or not, within ``radius``."""
    tree, links = BKTree(values), []
    for i in range(len(values)):
        if not tree.inside[i]:
            continue
        tree.leave(i)
        waiting = [i]
        while waiting:
            at = waiting.pop()
            near = tree.take(values[at], radius)
            links += [(values[at], values[j]) for j in near]
            waiting += near
    return links


def near_links(distinct: DataFrame, radius: int = 4, shard_rows: int = 4096) -> DataFrame:
    """a, b: links between the distinct fingerprints in column fp that connect all within ``radius`` bits.

    Several shards may give the same link.
    """
    edges = np.linspace(0, 64, radius + 3).round().astype(int)
    blocks = [sum(1 << b for b in range(x, y)) for x, y in zip(edges[:-1], edges[1:])]
    masks = [np.array([x | y], np.uint64).view(np.int64)[0].item() for x, y in combinations(blocks, 2)]
    keyed = distinct.select("fp", F.explode(F.array(*[
        F.struct(F.lit(t).alias("t"), F.col("fp").bitwiseAND(F.lit(m)).alias("key")) for t, m in enumerate(masks)]))
        .alias("s")).select("fp", "s.t", "s.key")
    large = (keyed.groupBy("t", "key").count().filter(F.col("count") > shard_rows)
             .select("t", "key", F.ceil(F.col("count") / shard_rows).cast("int").alias("runs")))
    keyed = (keyed.join(large, ["t", "key"], "left").withColumn("runs", F.coalesce("runs", F.lit(1)))
             .withColumn("run", F.pmod(F.xxhash64("fp"), F.col("runs")).cast("int"))
             .withColumn("other", F.explode(F.expr("sequence(0, runs - 1)")))
             .select("fp", "t", "key", F.least("run", "other").alias("x"), F.greatest("run", "other").alias("y")))
    shard = ["t", "key", "x", "y"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for batch in batches:
            part = np.stack([batch.column(c).to_numpy().astype(np.int64) for c in (*shard, "fp")], 1)
            part = part if rest is None else np.concatenate([rest, part])
            opens = np.flatnonzero(np.concatenate([[True], (np.diff(part[:, :4], axis=0) != 0).any(1)]))
            rest = part[opens[-1]:]
            yield linked(part[:opens[-1]], opens)
        if rest is not None and len(rest):
            yield linked(rest, np.array([0, len(rest)]))

    def linked(part: np.ndarray, opens: np.ndarray) -> pa.RecordBatch:
        fps = part[:, 4].copy().view(np.uint64)
        sizes = np.diff(opens)
        found = [link for at, n in zip(opens[:-1][sizes > 1].tolist(), sizes[sizes > 1].tolist())
                 for link in forest(fps[at:at + n].tolist(), radius)]
        pairs = np.array(found, np.uint64).reshape(-1, 2).view(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])

    return keyed.repartition(*shard).sortWithinPartitions(*shard, "fp").mapInArrow(run, "a long, b long")


def components(links: DataFrame) -> DataFrame:
    """node, root: the least node connected to each node of ``links`` (a, b), by alternating stars."""
    stars = (links.select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("u"))
             .filter("v <> u").distinct().checkpoint(eager=True))
    state = None
    while True:  # what tells one state from the next is counted while the checkpoint is written
        both = stars.unionByName(stars.select(F.col("u").alias("v"), F.col("v").alias("u")))
        least = both.groupBy("v").agg(F.min("u").alias("m")).select("v", F.least("v", "m").alias("m"))
        large = both.filter("u > v").join(least, "v").select(F.col("u").alias("v"), F.col("m").alias("u"))
        least = large.groupBy("v").agg(F.min("u").alias("m"))
        small = (large.join(least, "v").filter("u <> m").select(F.col("u").alias("v"), F.col("m").alias("u"))
                 .unionByName(least.select("v", F.col("m").alias("u"))).distinct())
        seen = Observation()
        stars = small.observe(seen, F.count("*").alias("n"), F.bit_xor(F.xxhash64("v", "u")).alias("x"),
                              F.sum(F.hash("v", "u").cast("long")).alias("s")).checkpoint(eager=True)
        now = seen.get
        if now == state:
            return stars.select(F.col("v").alias("node"), F.col("u").alias("root"))
        state = now


def near_duplicates(docs: DataFrame, shingle: int = 4, seed: int = 42, radius: int = 4,
                    shard_rows: int = 4096) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id and root of every row of ``docs``.

    Two rows are linked when their fingerprints differ in ``radius`` bits or
    fewer; component_id is the least doc_id reachable, root the least
    fingerprint (signed) of the component. Null, empty and blank texts have
    fingerprint zero and are linked like any other; texts shorter than a
    shingle are one shingle. Null doc_ids link, but never name a component
    (null if no row of it has one). Repeated rows fall into one component. An
    empty table gives no rows. Other columns are left out. Texts are read whole.
    """
    prints = fingerprints(docs, shingle, seed).checkpoint(eager=True)
    distinct = prints.groupBy("fp").agg(F.min("doc_id").alias("first"))
    roots = components(near_links(distinct.select("fp"), radius, shard_rows))
    nodes = roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct())
    rooted = distinct.join(nodes, F.col("fp") == F.col("node"), "left").select("fp", "first", "root")
    salt = F.pmod(F.xxhash64("fp"), F.lit(SALTS)).cast("int")
    linked = rooted.filter("root IS NOT NULL").withColumn("salt", salt)
    named = (linked.groupBy("root").agg(F.min("first").alias("component_id"))
             .withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))))  # a hot component meets in many tasks
    classes = (linked.join(named, ["root", "salt"]).select("fp", "root", "component_id")
               .unionByName(rooted.filter("root IS NULL")
                            .select("fp", F.col("fp").alias("root"), F.col("first").alias("component_id"))))
    return prints.join(classes, "fp").select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id", "root", "tie")


def one_per_group(docs: DataFrame, shingle: int = 4, seed: int = 42, radius: int = 4) -> DataFrame:
    """One row of ``docs`` per component of near_duplicates, all columns as they are.

    The row with the least doc_id stays (rows without a doc_id only where the
    component has no other; among equal doc_ids the least hash of the text).
    """
    first = near_duplicates(docs, shingle, seed, radius).groupBy("root").agg(F.min(F.struct(
        F.col("doc_id").isNull().alias("no_id"), F.coalesce("doc_id", F.lit(0)).alias("id"), F.col("tie"))).alias("k"))
    keys = first.select(F.col("k.no_id").alias("_no_id"), F.col("k.id").alias("_id"), F.col("k.tie").alias("_tie"))
    marked = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("doc_id").isNull().alias("_no_id"),
        F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("_id"),
        F.xxhash64(F.col("text").cast("string")).alias("_tie"))
    return (marked.join(keys, ["_no_id", "_id", "_tie"], "left_semi").dropDuplicates(["_no_id", "_id", "_tie"])
            .select("row.*"))
