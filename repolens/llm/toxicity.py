"""Toxicity by a convolutional text classifier trained in numpy.

A word is the sum of its rows in two hashed embedding tables laid side by
side, so that a chance meeting in one table is told apart by the other.
Filters of several widths slide over the whole text, the largest response of
each filter is pooled, a logistic layer scores the pooled vector. Training
reads all labelled rows that are not held out: words are counted over all of
them, shards descend side by side and the network takes the mean of their
changes; thresholds by language are calibrated on the fifth that did not train.

The model (a few MB of fixed size) travels with the task function; scoring needs
no shuffle.
"""

from __future__ import annotations

import copy
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from repolens.llm.shared import picked, raw_texts, slices, texts

#: Words whose numbers a task remembers; the memory is emptied when it is full.
REMEMBERED = 200_000
WORDS = re.compile(r"\w+")


class Numbers:
    """Two table rows per word."""

    def __init__(self, rows: int):
        self.rows, self.known = rows, {}

    def of(self, text: str) -> np.ndarray:
        """Shape (words, 2), int32."""
        import xxhash

        words = WORDS.findall(text.lower())
        if len(self.known) > REMEMBERED:
            self.known = {}
        known = self.known
        for w in set(words):
            if w in known:
                continue
            h = xxhash.xxh64_intdigest(w.encode("utf-8", "replace"))
            known[w] = (h & 0xFFFFFFFF) % self.rows << 32 | (h >> 32) % self.rows
        both = np.fromiter(map(known.__getitem__, words), np.int64, len(words))
        return np.stack([both >> 32, both & 0xFFFFFFFF], 1).astype(np.int32)


@dataclass
class Network:
    rows: int = 1 << 17
    half: int = 4
    widths: tuple[int, ...] = (1, 2, 3)
    filters: int = 8
    tables: list[np.ndarray] = field(default_factory=list)
    kernels: list[np.ndarray] = field(default_factory=list)
    biases: list[np.ndarray] = field(default_factory=list)
    out: np.ndarray | None = None
    out_bias: float = 0.0
    shift: float = 0.0
    thresholds: dict[str, float] = field(default_factory=dict)

    def begin(self, seed: int) -> None:
        rng = np.random.default_rng(seed)
        size = 2 * self.half
        self.tables = [rng.normal(0, 0.01, (self.rows, self.half)).astype(np.float32) for _ in range(2)]
        self.kernels = [rng.normal(0, 0.1, (w, size, self.filters)).astype(np.float32) for w in self.widths]
        self.biases = [np.zeros(self.filters, np.float32) for _ in self.widths]
        self.out = rng.normal(0, 0.1, len(self.widths) * self.filters).astype(np.float32)

    def vectors(self, ids: np.ndarray) -> np.ndarray:
        return np.concatenate([self.tables[0][ids[:, 0]], self.tables[1][ids[:, 1]]], 1)

    def pooled(self, ids: np.ndarray, places: bool = False, most: int = 1 << 14) -> tuple[np.ndarray, np.ndarray]:
        """Largest rectified response of every filter over the whole text, and where; long texts in overlapping parts."""
        reach, f = max(self.widths) - 1, self.filters
        best = np.zeros(len(self.widths) * f, np.float32)
        where = np.full(len(best), -1)
        stacked = np.concatenate([k.transpose(0, 2, 1).reshape(-1, 2 * self.half) for k in self.kernels])
        for at in range(0, max(len(ids), 1), most):
            each = stacked @ self.vectors(ids[at:at + most + reach]).T
            row = 0
            for j, (w, b) in enumerate(zip(self.widths, self.biases)):
                n = each.shape[1] - w + 1
                if n > 0:
                    r = each[row:row + f, :n]
                    for d in range(1, w):
                        r = r + each[row + d * f:row + (d + 1) * f, d:n + d]
                    s = slice(j * f, (j + 1) * f)
                    v = r.max(1) + b
                    if places:
                        where[s] = np.where(v > best[s], at + r.argmax(1), where[s])
                    best[s] = np.maximum(best[s], v)
                row += w * f
        return best, where

    def margin(self, ids: np.ndarray) -> float:
        return float(self.pooled(ids)[0] @ self.out + self.out_bias - self.shift)

    def start_words(self, clean: np.ndarray, toxic: np.ndarray, p: float, doubt: float = 4.0) -> None:
        """First embedding column: log-odds of the table row among the training texts, held back by ``doubt`` texts.

        ``clean`` and ``toxic``: texts of either class that hold a word of the row, shape (2, rows); p: toxic share.
        """
        for t in range(2):
            odds = np.log((toxic[t] + doubt * p) / (clean[t] + doubt * (1 - p))) - np.log(p / (1 - p))
            self.tables[t][:, 0] = odds / 2
        for k, b in zip(self.kernels, self.biases):
            k[:, 0, :] = 0.5 + np.abs(k[:, 0, :])
            k[:, self.half, :] = 0.5 + np.abs(k[:, self.half, :])
            b -= 0.5
        self.out = np.abs(self.out) + 0.1

    def numbers(self) -> np.ndarray:
        """All parameters, ``half`` to a row: the rows of both tables, then the dense layers, filled up with zeros."""
        dense = np.concatenate([*(p.ravel() for p in [*self.kernels, *self.biases, self.out]), [self.out_bias]])
        dense = np.concatenate([dense, np.zeros(-len(dense) % self.half)])
        return np.concatenate([*self.tables, dense.reshape(-1, self.half)]).astype(np.float64)

    def set_numbers(self, rows: np.ndarray) -> None:
        for t in range(2):
            self.tables[t] = rows[t * self.rows:(t + 1) * self.rows].astype(np.float32)
        dense, at = rows[2 * self.rows:].ravel(), 0
        for p in [*self.kernels, *self.biases, self.out]:
            p[...] = dense[at:at + p.size].reshape(p.shape)
            at += p.size
        self.out_bias = float(dense[at])


class Descent:
    """Stochastic gradient descent on a network (Adam on dense layers, AdaGrad on touched embedding rows)."""

    def __init__(self, net: Network, rate: float = 0.02):
        self.net, self.rate, self.steps = net, rate, 0
        self.dense = [*net.kernels, *net.biases, net.out]
        self.one, self.two = [np.zeros_like(p) for p in self.dense], [np.zeros_like(p) for p in self.dense]
        self.squares = [np.full(net.rows, 1e-2, np.float32) for _ in range(2)]

    def step(self, many: list[tuple[np.ndarray, int, float]]) -> None:
        """One step on a batch of (ids, label, weight)."""
        net, rate = self.net, self.rate
        grads, bias = [np.zeros_like(p) for p in self.dense], 0.0
        touched: list[tuple[np.ndarray, np.ndarray]] = []
        for ids, label, weight in many:
            v, where = net.pooled(ids, places=True)
            g = (1 / (1 + np.exp(-(v @ net.out + net.out_bias))) - label) * weight / len(many)
            grads[-1] += g * v
            bias += g
            for j in np.flatnonzero(where >= 0):
                a, b = divmod(int(j), net.filters)
                w = net.widths[a]
                pair = ids[where[j]:where[j] + w]
                grads[a][:, :, b] += g * net.out[j] * net.vectors(pair)
                grads[len(net.widths) + a][b] += g * net.out[j]
                for row, d in zip(pair, range(w)):
                    touched.append((row, g * net.out[j] * net.kernels[a][d, :, b]))
        self.steps += 1
        for p, g, m, s in zip(self.dense, grads, self.one, self.two):
            m += 0.1 * (g - m)
            s += 0.001 * (g * g - s)
            p -= rate * (m / (1 - 0.9 ** self.steps)) / (np.sqrt(s / (1 - 0.999 ** self.steps)) + 1e-8)
        net.out_bias -= rate * float(bias)
        for row, g in touched:
            for t in range(2):
                part = g[t * net.half:(t + 1) * net.half]
                self.squares[t][row[t]] += float(part @ part)
                net.tables[t][row[t]] -= 0.05 * part / np.sqrt(self.squares[t][row[t]])


def best_cut(margins: np.ndarray, toxic: np.ndarray, rows: np.ndarray) -> float:
    """Cut with the largest F1, in the middle of the gap to the next margin below.

    ``toxic`` of the ``rows`` texts at each (distinct) margin are labelled 1.
    """
    if not 0 < toxic.sum() < rows.sum():
        return 0.0
    order = np.argsort(-margins, kind="stable")
    m, hit = margins[order], np.cumsum(toxic[order])
    i = int(np.argmax(2 * hit / (np.cumsum(rows[order]) + toxic.sum())))
    return float((m[i] + m[i + 1]) / 2) if i + 1 < len(m) else float(m[i]) - 1.0


def held_out(doc_id) -> F.Column:
    """True for rows whose label is never learnt: crc32 of the doc_id as text divides by 5."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def labelled_rows(docs: DataFrame, labels: DataFrame, size: int, shard_rows: int) -> DataFrame:
    """check, toxic, lang, words of every row of ``docs`` with a label that may be learnt, dealt into shards by hash.

    words: the two table rows of each word in five bytes. A shard is a
    partition, in the order of the hash, so it is the same however the input
    is cut into files. Spark deals the join to spark.sql.shuffle.partitions
    where that is more than the shards asked for. Texts travel compressed and
    once; they are cut into words once.
    """
    if size > 1 << 20:
        raise ValueError("five bytes hold no two rows of such tables")

    known = (picked(labels, "doc_id", "toxic").select(F.col("doc_id").cast("long").alias("id"), "toxic")
             .filter("id IS NOT NULL AND toxic IN (0, 1)").filter(~held_out(F.col("id")))
             .groupBy(F.xxhash64("id").alias("hash"), "id").agg(F.min("toxic").cast("int").alias("toxic")))

    def shrink(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 2):
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array([zlib.compress(r, 1) for r in raw_texts(batch.column(2))], pa.binary())],
                names=["id", "lang", "packed"])

    packed = (picked(docs, "doc_id", "lang", "text").select(
        F.col("doc_id").cast("long").alias("id"), F.col("lang").cast("string"), F.col("text").cast("string"))
        .filter("id IS NOT NULL").filter(~held_out(F.col("id"))).mapInArrow(shrink, "id long, lang string, packed binary")
        .withColumn("hash", F.xxhash64("id")))
    shards = max(1, -(-docs.count() // shard_rows))
    joined = packed.repartition(shards, "hash", "id").join(
        known.repartition(shards, "hash", "id").hint("merge"), ["hash", "id"])

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers = Numbers(size)
        for batch in slices(batches, 3, 1 << 20):
            words = [five_bytes(numbers.of(zlib.decompress(x).decode("utf-8", "replace"))) for x in batch.column(3).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(words, pa.binary())],
                                             names=["check", "toxic", "lang", "words"])

    ordered = (joined.sortWithinPartitions("hash", "packed")
               .select((F.pmod("hash", F.lit(5)) == 4).alias("check"), "toxic", "lang", "packed"))
    return ordered.mapInArrow(number, "check boolean, toxic int, lang string, words binary").checkpoint(eager=True)


def five_bytes(ids: np.ndarray) -> bytes:
    both = ids[:, 0].astype("<u8") << np.uint64(20) | ids[:, 1].astype("<u8")
    return both.view(np.uint8).reshape(-1, 8)[:, :5].tobytes()


def table_rows(words: bytes) -> np.ndarray:
    """Shape (words, 2), as Numbers gives them."""
    wide = np.zeros((len(words) // 5, 8), np.uint8)
    wide[:, :5] = np.frombuffer(words, np.uint8).reshape(-1, 5)
    both = wide.view("<u8").ravel()
    return np.stack([both >> np.uint64(20), both & np.uint64((1 << 20) - 1)], 1).astype(np.int32)


def unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, str | None, np.ndarray]]:
    """Label, language and table rows of each labelled row."""
    for batch in batches:
        for toxic, lang, words in zip(*(batch.column(i).to_pylist() for i in (1, 2, 3))):
            yield toxic, lang, table_rows(words)


def word_counts(rows: DataFrame, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Texts of either class that hold a word of each table row, shape (2, size) each, over all ``rows``."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros((2, 2, size), np.int64)
        for toxic, _, ids in unpacked(batches):
            for t in range(2):
                seen[toxic, t][np.unique(ids[:, t])] += 1
        at = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(seen.ravel()[at])], names=["at", "n"])

    found = rows.mapInArrow(count, "at int, n long").groupBy("at").agg(F.sum("n").alias("n")).toPandas()
    seen = np.zeros(4 * size, np.int64)  # as many numbers as the tables have rows, whatever the corpus
    seen[found["at"].to_numpy(np.int64)] = found["n"].to_numpy()
    return tuple(seen.reshape(2, 2, size))


def fit_round(network: Network, rows: DataFrame, weights: tuple[float, float], batch_rows: int = 16) -> None:
    """Every shard learns from all its rows, beginning with ``network``; then it takes the mean of their changes.

    A number's mean is over the shards that changed it, by their rows. Changes
    are added as integers, so the order of the sum does not matter.
    """
    unit, half = 2.0 ** 24, network.half

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = copy.deepcopy(network)
        descent, held, n = Descent(net), [], 0
        for toxic, _, ids in unpacked(batches):
            held.append((ids, toxic, weights[toxic]))
            n += 1
            if len(held) == batch_rows:
                descent.step(held)
                held = []
        if held:
            descent.step(held)
        change = net.numbers() - network.numbers()
        at = np.flatnonzero((change != 0).any(axis=1))
        yield pa.RecordBatch.from_arrays(
            [pa.array(at.astype(np.int32)), pa.array(np.full(len(at), n, np.int64)),
             *(pa.array(np.rint(change[at, i] * n * unit).astype(np.int64)) for i in range(half))],
            names=["at", "n", *(f"d{i}" for i in range(half))])

    names = ["n", *(f"d{i}" for i in range(half))]
    changes = rows.mapInArrow(learn, "at int, " + ", ".join(f"{x} long" for x in names))
    mean = changes.groupBy("at").agg(*(F.sum(x).alias(x) for x in names)).toPandas()  # no more rows than the network
    new = network.numbers()
    new[mean["at"].to_numpy(np.int64)] += (mean[names[1:]].to_numpy(np.float64) / unit) / mean[["n"]].to_numpy(np.float64)
    network.set_numbers(new)


def set_cuts(network: Network, rows: DataFrame, enough: int = 20, step: int = 1024) -> None:
    """The common cut and those of the languages, from the margins of all ``rows`` in steps of 1 / ``step``."""
    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(lang, toxic, round(float(np.clip(network.margin(ids), -64, 64)) * step))
                     for toxic, lang, ids in unpacked([batch])]
            yield pa.RecordBatch.from_arrays(
                [pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.int32()),
                 pa.array([f[2] for f in found], pa.int32())], names=["lang", "toxic", "bin"])

    margins = (rows.mapInArrow(judge, "lang string, toxic int, bin int").groupBy("lang", "bin")
               .agg(F.sum("toxic").alias("toxic"), F.count("*").alias("rows")).checkpoint(eager=True))

    def cut(part: pd.DataFrame) -> float:
        return best_cut(part["bin"].to_numpy() / step, part["toxic"].to_numpy(), part["rows"].to_numpy())

    def cut_of_language(part: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"lang": part["lang"].iloc[:1], "cut": [cut(part)]})

    network.shift = cut(margins.groupBy("bin").agg(F.sum("toxic").alias("toxic"), F.sum("rows").alias("rows"))
                        .orderBy("bin").toPandas())
    # fewer rows say too little: the common cut holds
    told = (margins.filter("lang IS NOT NULL").groupBy("lang")
            .agg(F.sum("toxic").alias("ones"), F.sum("rows").alias("all"))
            .filter((F.col("ones") >= enough) & (F.col("all") - F.col("ones") >= enough)).select("lang"))
    for lang, at in margins.join(told, "lang").groupBy("lang").applyInPandas(cut_of_language, "lang string, cut double").collect():
        network.thresholds[lang] = 1 / (1 + np.exp(network.shift - at))


def train(docs: DataFrame, labels: DataFrame, seed: int = 7, rounds: int = 4, shard_rows: int = 12_000) -> Network:
    """A network from all labelled rows that are not held out: four fifths of them train, the others set the cuts.

    Words are counted over all training texts. In a round, shards of about
    ``shard_rows`` documents (labelled or not) learn side by side, and the
    network takes the mean of what they learnt. Only sums of the network's own
    size reach the driver. Repeated rows of ``docs`` train each; of several
    labels of a doc_id the least holds.
    """
    network = Network()
    network.begin(seed)
    rows = labelled_rows(docs, labels, network.rows, shard_rows)
    n = {(r["check"], r["toxic"]): r["count"] for r in rows.groupBy("check", "toxic").count().collect()}
    if not all(sum(n.get((c, v), 0) for c in (False, True)) for v in (0, 1)):  # nothing to tell apart: one score for all
        network.out[:] = 0
        network.out_bias = 3.0 if any(v == 1 for _, v in n) else -3.0
        return network
    learnt = judged = rows
    if len(n) == 4:
        learnt, judged = rows.filter("NOT check"), rows.filter("check")
    else:
        n = {(False, v): sum(n.get((c, v), 0) for c in (False, True)) for v in (0, 1)}
    p = n[False, 1] / (n[False, 0] + n[False, 1])
    network.start_words(*word_counts(learnt, network.rows), p)
    for _ in range(rounds):
        fit_round(network, learnt, (0.5 / max(1 - p, 1e-3), 0.5 / max(p, 1e-3)))
    set_cuts(network, judged)
    return network


def score_toxicity(docs: DataFrame, labels: DataFrame, seed: int = 7) -> DataFrame:
    """doc_id, held_out, score, predicted (score >= 0.5), lang and flagged of every row of ``docs``.

    flagged holds the score against the threshold calibrated for the row's
    language (0.5 where too few labels tell). The language is no input of the
    score. Null and empty texts get the score of a text without words. A null
    doc_id never trains and is not held out. Repeated rows are scored alike.
    Without labels of both classes all texts share one score. An empty table
    gives no rows. Other columns are left out. Texts are scored whole.
    """
    network = train(docs, labels, seed)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net, numbers = network, Numbers(network.rows)
        for batch in slices(batches, 1):
            margins = np.array([net.margin(numbers.of(t)) for t in texts(batch.column(1))], float)
            score = 1 / (1 + np.exp(-np.clip(margins, -60, 60)))
            limit = np.array([net.thresholds.get(x, 0.5) for x in batch.column(2).to_pylist()], float)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(score), pa.array((score >= 0.5).astype(np.int32)), batch.column(2),
                 pa.array(score >= limit)], names=["doc_id", "score", "predicted", "lang", "flagged"])

    source = picked(docs, "doc_id", "text", "lang").select(
        F.col("doc_id").cast("long"), F.col("text").cast("string"), F.col("lang").cast("string"))
    scored = source.mapInArrow(run, "doc_id long, score double, predicted int, lang string, flagged boolean")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted", "lang", "flagged")


def drop_toxic(docs: DataFrame, labels: DataFrame, seed: int = 7) -> DataFrame:
    """The rows of ``docs``, all columns as they are, without those that score_toxicity flags."""
    network = train(docs, labels, seed)
    at, lang_at = docs.columns.index("text"), docs.columns.index("lang")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net, numbers = network, Numbers(network.rows)
        for batch in slices(batches, at):
            margins = np.array([net.margin(numbers.of(t)) for t in texts(batch.column(at))], float)
            limit = np.array([net.thresholds.get(x, 0.5) for x in batch.column(lang_at).to_pylist()], float)
            yield batch.filter(pa.array(1 / (1 + np.exp(-np.clip(margins, -60, 60))) < limit))

    return docs.mapInArrow(run, docs.schema)
