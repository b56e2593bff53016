"""Mixing sources to target weights by Sainte-Lague apportionment of equal-token blocks.

1. Word counts per document; sizes per source and per (source, shard). A source
   has a shard for about every ``shard_rows`` rows, dealt by a seeded hash, so
   a hot source is split and no task orders more than a shard at any size.
2. Targets: each source's share of all words by weight; a target stops at
   ``cap`` times its source, the excess is shared out anew (water level).
3. The corpus is ``total / block`` equal blocks. Sources get blocks by the
   highest quotients target / (2 k + 1), each source's blocks go to its shards
   by the same rule on shard sizes: integer quotas per shard. A source smaller
   than a block (or its target), or whose shards hold too few whole blocks for
   its target, gets its target in words.
4. In a shard, documents lie one after the other in a seeded order. A quota is
   whole passes over the shard plus a run of words from a seeded block on;
   what a document gives is plain arithmetic on its position.

Only (doc_id, source, size) rows are shuffled. One row per source goes through
the driver, one row per shard of a source through one group.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from repolens.llm.shared import WORD, picked, raw_texts, slices, text_or_empty

#: Parts of a source's rows that meet the source's number of shards apart.
SALTS = 256


def water_level(sizes: list[int], weights: list[int], cap: int = 3) -> list[float]:
    """Shares of the total by weight, none above ``cap`` times its size, the excess reshared by weight."""
    total, targets, free = float(sum(sizes)), [0.0] * len(sizes), set(range(len(sizes)))
    while free:
        weight = sum(weights[i] for i in free)
        over = [i for i in free if total * weights[i] / weight > cap * sizes[i]]
        for i in over or free:
            targets[i] = float(cap * sizes[i]) if over else total * weights[i] / weight
        total -= sum(targets[i] for i in over)
        free = free - set(over) if over else set()
    return targets


def sainte_lague(shares: np.ndarray, seats: int, most: np.ndarray) -> np.ndarray:
    """Seats by the highest quotients share / (2 k + 1), at most ``most`` each; ties to the smaller index."""
    shares, most = np.asarray(shares, float), np.asarray(most, np.int64)
    seats = int(min(seats, most[shares > 0].sum()))
    if seats <= 0:
        return np.zeros(len(shares), np.int64)

    def at(divisor: float) -> np.ndarray:
        return np.minimum(np.floor(np.minimum(shares / divisor, 2.0 ** 60) + 0.5).astype(np.int64), most)

    low, high = shares[shares > 0].min() / (4.0 * (seats + 1)), 4.0 * shares.sum() + 1
    for _ in range(200):  # quotients at or above the divisor get a seat; the divisor falls until the seats are used
        middle = (low + high) / 2
        low, high = (middle, high) if at(middle).sum() > seats else (low, middle)
    given = at(high)
    queue = [(-s / (2 * int(k) + 1), i) for i, (s, k) in enumerate(zip(shares, given)) if s > 0 and k < most[i]]
    heapq.heapify(queue)
    for _ in range(seats - int(given.sum())):
        _, i = heapq.heappop(queue)
        given[i] += 1
        if given[i] < most[i]:
            heapq.heappush(queue, (-shares[i] / (2 * int(given[i]) + 1), i))
    return given


def mix(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), cap: int = 3, block: int = 16, shard_rows: int = 4096,
        seed: int = 42) -> DataFrame:
    """What the mix takes of every row of ``docs``.

    doc_id, source, size (words), source_size, target (of the source), taken
    (words, repeats counted), passes (whole copies) and two spans of words
    (from1, length1, from2, length2; length 0: none) that are taken once more.

    Sources in code-point order, null last and a source of its own, weigh
    ``weights`` in turn. Null and empty texts have size 0 and give 0 words.
    Null doc_ids are documents like others; repeated rows count each. An empty
    table gives no rows. Other columns of ``docs`` are left out. Reruns agree:
    order and starting block follow from hashes with ``seed``.
    """
    keys = ["src", "no_src", "shard"]
    sized = (picked(docs, "doc_id", "source", "text").select(
        F.col("doc_id").cast("long"), F.col("source").cast("string"),
        F.regexp_count(text_or_empty(), F.lit(WORD)).cast("long").alias("size"),
        F.xxhash64(text_or_empty()).alias("_tie"))
        .withColumn("src", F.coalesce("source", F.lit(""))).withColumn("no_src", F.col("source").isNull())
        ).checkpoint(eager=True)
    shards = sized.groupBy("src", "no_src").agg(F.ceil(F.count("*") / shard_rows).alias("shards"))
    salted = shards.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))  # a hot source meets in many tasks
    placing = F.xxhash64("doc_id", "_tie", F.lit(seed))
    sized = (sized.withColumn("salt", F.pmod(F.xxhash64("doc_id", "_tie"), F.lit(SALTS)).cast("int"))
             .join(salted, ["src", "no_src", "salt"])
             .withColumn("shard", F.pmod(placing, F.col("shards")).cast("int")).drop("shards", "salt"))
    by_shard = sized.groupBy(*keys).agg(F.sum("size").alias("shard_size"))
    sources = (by_shard.groupBy("src", "no_src").agg(
        F.sum("shard_size").alias("size"), F.sum(F.floor(F.col("shard_size") * cap / block)).alias("most"))
        .orderBy("no_src", "src").collect())
    sizes = [r["size"] for r in sources]
    targets = water_level(sizes, [weights[i % len(weights)] for i in range(len(sizes))], cap)
    most = np.array([r["most"] for r in sources], np.int64)
    # no whole block, or shards too small for enough of them: the target in words
    small = np.array([n < block or t < block or (m + 1) * block <= t for n, t, m in zip(sizes, targets, most)], bool)
    words = np.where(small, np.minimum(np.ceil(targets), cap * np.array(sizes, float)), 0).astype(np.int64)
    quota = words + sainte_lague(np.where(small, 0.0, targets), max(0, sum(sizes) - int(words.sum())) // block, most)
    plan = pd.DataFrame({"src": pd.Series([r["src"] for r in sources], dtype=object),
                         "no_src": pd.Series([r["no_src"] for r in sources], dtype=bool),
                         "source_size": pd.Series(sizes, dtype="int64"), "target": pd.Series(targets, dtype=float),
                         "units": pd.Series(quota, dtype="int64"),
                         "unit": pd.Series(np.where(small, 1, block), dtype="int64")})
    plan = docs.sparkSession.createDataFrame(
        plan, "src string, no_src boolean, source_size long, target double, units long, unit long")

    def to_shards(p: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values("shard")
        size = p["shard_size"].to_numpy()
        unit = int(p["unit"].iloc[0])
        p["quota"] = unit * sainte_lague(size, int(p["units"].iloc[0]), size * cap // unit)
        return p

    planned = by_shard.join(plan, ["src", "no_src"]).groupBy("src", "no_src").applyInPandas(
        to_shards, "src string, no_src boolean, shard int, shard_size long, source_size long, target double, "
                   "units long, unit long, quota long")
    before = (Window.partitionBy(*keys).orderBy(F.xxhash64("doc_id", F.lit(seed + 1)), "doc_id", "_tie")
              .rowsBetween(Window.unboundedPreceding, -1))
    placed = sized.withColumn("a", F.coalesce(F.sum("size").over(before), F.lit(0))).join(planned, keys)
    wanted, whole = F.col("quota"), F.greatest(F.col("shard_size"), F.lit(1))
    placed = (placed.withColumn("passes", F.floor(wanted / whole)).withColumn("r", wanted - F.col("passes") * whole)
              .withColumn("o", F.pmod(F.xxhash64(*keys, F.lit(seed)),
                                      F.greatest(F.floor(whole / block), F.lit(1))) * block)
              .withColumn("end", F.col("a") + F.col("size"))
              .withColumn("f1", F.greatest("a", "o"))
              .withColumn("length1", F.greatest(
                  F.least("end", F.col("o") + F.col("r"), "shard_size") - F.col("f1"), F.lit(0)))
              .withColumn("length2", F.greatest(
                  F.least("end", F.col("o") + F.col("r") - F.col("shard_size")) - F.col("a"), F.lit(0))))
    return placed.select(
        "doc_id", "source", "size", "source_size", "target",
        (F.col("passes") * F.col("size") + F.col("length1") + F.col("length2")).cast("long").alias("taken"),
        "passes", F.when(F.col("length1") > 0, F.col("f1") - F.col("a")).otherwise(F.lit(0)).alias("from1"), "length1",
        F.lit(0).cast("long").alias("from2"), "length2", "_tie")


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The mix as rows of ``docs``: one row per whole copy and per span of words, columns as they are.

    ``text`` is cut where a span is a part of the document (white space between
    its words kept), ``n_chars`` follows the text. Documents of which the mix
    takes nothing are left out. Options are those of mix().
    """
    taken = (mix(docs, **options).filter("taken > 0").select(
        F.col("doc_id").isNull().alias("_no_id"), F.coalesce("doc_id", F.lit(0)).alias("_id"), F.col("_tie"),
        F.concat(F.array_repeat(F.struct(F.lit(0).cast("long").alias("at"), F.col("size").alias("n"), F.lit(True).alias("whole")),
                                F.col("passes").cast("int")),
                 F.filter(F.array(*[F.struct(F.col(f"from{i}").cast("long").alias("at"), F.col(f"length{i}").cast("long").alias("n"),
                                             (F.col(f"length{i}") == F.col("size")).alias("whole")) for i in (1, 2)]),
                          lambda s: s["n"] > 0)).alias("parts"))
        .groupBy("_no_id", "_id", "_tie").agg(F.flatten(F.collect_list("parts")).alias("parts")))
    marked = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("doc_id").isNull().alias("_no_id"),
        F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("_id"), F.xxhash64(text_or_empty()).alias("_tie"))
    each = (marked.dropDuplicates(["_no_id", "_id", "_tie"]).join(taken, ["_no_id", "_id", "_tie"])
            .select("row", F.explode("parts").alias("part")).select("row.*", "part.at", "part.n", "part.whole")
            .toDF(*docs.columns, "_at", "_n", "_whole"))
    columns, text_at = docs.columns, docs.columns.index("text")
    word = re.compile(WORD.encode())

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text_at):
            out = []
            for raw, at, n, whole in zip(raw_texts(batch.column(text_at)), *(
                    batch.column(i).to_pylist() for i in range(batch.num_columns - 3, batch.num_columns))):
                if not whole:
                    places = [m.span() for m in word.finditer(raw)]
                    raw = raw[places[at][0]:places[at + n - 1][1]]
                out.append(raw.decode("utf-8", "replace"))
            values = list(batch.columns[:-3])
            values[text_at] = pa.array(out, values[text_at].type)
            yield pa.RecordBatch.from_arrays(values, names=columns)

    made = each.mapInArrow(cut, docs.schema)
    return made.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else made
