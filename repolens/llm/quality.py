"""Quality verdicts by gradient-boosted trees over document statistics.

Statistics of whole texts are computed in one pass (bytes are counted by one
histogram, repeated 8-word windows by exact prefix doubling of word numbers).
Trees are grown in numpy on a bounded sample of labelled rows, with monotonic
constraints on chosen statistics, and flattened into node arrays that score a
batch of documents with a few gathers. The model (a few KB) travels with the
task function; scoring needs no shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from repolens.llm.shared import picked, raw_texts, slices

# Characters that count as symbols, words of a window.
SYMBOLS = b"#*$%&|<>"
WINDOW = 8

#: Statistic -> direction in which quality may move with it (0: either).
STATISTICS = {"log_words": 0, "word_length": 0, "symbols_per_char": -1, "bars_per_word": -1, "bangs_per_word": -1,
              "upper_per_char": -1, "digits_per_char": 0, "stops_per_word": 0, "dup_lines": -1, "repeat_words": -1,
              "distinct_words": 0, "same_as_previous": -1, "high_bytes": 0, "words_per_line": 0}
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def repeated_window_words(ids: np.ndarray, window: int = WINDOW) -> int:
    """Words that lie in a window found twice or more in the sequence (the first one included); exact."""
    if len(ids) <= window:
        return 0
    name, width = ids, 1
    while width < window:  # names of twice the width from pairs of names; window is a power of two
        pair = name[:-width].astype(np.int64) * (int(name.max()) + 1) + name[width:]
        _, name = np.unique(pair, return_inverse=True)
        width *= 2
    twice = np.bincount(name)[name] > 1
    if not twice.any():
        return 0
    edge = np.zeros(len(ids) + 1, np.int64)
    at = np.flatnonzero(twice)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + window, -1)
    return int(np.count_nonzero(np.cumsum(edge)))


def statistics(raw: bytes) -> tuple[tuple[int, ...], list[float]]:
    """The contract's counts (see COUNTS) and the model's STATISTICS of one text."""
    words = raw.split()
    n = len(words)
    seen = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    chars = int(seen.sum() - seen[128:192].sum())
    word_chars = chars - int(seen[9:14].sum() + seen[32])
    n_symbols = int(sum(seen[c] for c in SYMBOLS))
    lines = [x for x in raw.split(b"\n") if not x.isspace() and x]
    n_dup = len(lines) - len(set(lines))
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, n)
    n_repeat = repeated_window_words(ids)
    per_word, per_char = 1 / max(n, 1), 1 / max(word_chars, 1)
    same = int(np.count_nonzero(ids[1:] == ids[:-1]))
    return (n, word_chars, n_symbols, n_dup, n_repeat), [
        float(np.log1p(n)), word_chars * per_word, n_symbols * per_char, seen[124] * per_word, seen[33] * per_word,
        seen[65:91].sum() * per_char, seen[48:58].sum() * per_char, seen[46] * per_word, n_dup / max(len(lines), 1),
        n_repeat * per_word, len(number) * per_word, same * per_word, seen[192:].sum() * per_char,
        n / max(len(lines), 1)]


@dataclass
class Trees:
    """All trees in flat node arrays; a leaf points to itself."""

    start: float
    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    depth: int

    def margin(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.start)
        row = np.arange(len(x))
        for root in self.roots:
            node = np.full(len(x), root)
            for _ in range(self.depth):
                below = x[row, self.feature[node]] <= self.threshold[node]
                node = np.where(below, self.left[node], self.right[node])
            out += self.value[node]
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self.margin(x)))


def grow(x: np.ndarray, y: np.ndarray, signs: list[int], trees: int = 60, depth: int = 3, rate: float = 0.2,
         bins: int = 64, leaf: int = 5, ridge: float = 1.0) -> Trees:
    """Boosted trees for logistic loss; a split that breaks a sign is not made, child values stay in parent bounds."""
    n, k = x.shape
    p = np.clip(y.mean() if n else 0.5, 1e-3, 1 - 1e-3)
    start = float(np.log(p / (1 - p)))
    feature, threshold, left, right, value, roots = [], [], [], [], [], []

    def node(v: float) -> int:
        i = len(feature)
        feature.append(0), threshold.append(np.inf), left.append(i), right.append(i), value.append(v)
        return i

    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) if n else np.zeros(1) for j in range(k)]
    code = np.stack([np.searchsorted(edges[j], x[:, j], side="left") for j in range(k)], 1) if n else x.astype(int)
    margin = np.full(n, start)
    varied = n > 0 and 0 < y.sum() < n
    for _ in range(trees if varied else 0):
        q = 1 / (1 + np.exp(-margin))
        g, h = q - y, q * (1 - q)
        root = node(0.0)
        roots.append(root)
        level = [(root, np.arange(n), -np.inf, np.inf)]
        for d in range(depth + 1):
            below = []
            for at, rows, low, high in level:
                sg, sh = g[rows].sum(), h[rows].sum()
                value[at] = float(np.clip(-sg / (sh + ridge), low, high))
                if d == depth or len(rows) < 2 * leaf:
                    continue
                best = (1e-6, None)
                for j in range(k):
                    m = len(edges[j]) + 1
                    cg = np.cumsum(np.bincount(code[rows, j], g[rows], m))[:-1]
                    ch = np.cumsum(np.bincount(code[rows, j], h[rows], m))[:-1]
                    cn = np.cumsum(np.bincount(code[rows, j], minlength=m))[:-1]
                    vl = np.clip(-cg / (ch + ridge), low, high)
                    vr = np.clip(-(sg - cg) / (sh - ch + ridge), low, high)
                    gain = cg ** 2 / (ch + ridge) + (sg - cg) ** 2 / (sh - ch + ridge) - sg ** 2 / (sh + ridge)
                    gain[(cn < leaf) | (len(rows) - cn < leaf) | (signs[j] * (vr - vl) < 0)] = 0
                    i = int(np.argmax(gain)) if len(gain) else 0
                    if len(gain) and gain[i] > best[0]:
                        best = (gain[i], (j, i, vl[i], vr[i]))
                if best[1] is None:
                    continue
                j, i, vl, vr = best[1]
                feature[at], threshold[at] = j, float(edges[j][i])
                goes = code[rows, j] <= i
                left[at], right[at] = node(0.0), node(0.0)
                middle = (vl + vr) / 2
                bound = {0: ((low, high), (low, high)), 1: ((low, middle), (middle, high)),
                         -1: ((middle, high), (low, middle))}[signs[j]]
                below += [(left[at], rows[goes], *bound[0]), (right[at], rows[~goes], *bound[1])]
            level = below
        values = np.array(value[root:]) * rate
        value[root:] = values.tolist()
        one = Trees(0.0, np.array(feature), np.array(threshold), np.array(left), np.array(right), np.array(value),
                    np.array([root]), depth)
        margin = margin + one.margin(x)
    return Trees(start, np.array(feature, int), np.array(threshold), np.array(left, int), np.array(right, int),
                 np.array(value), np.array(roots, int), depth)


def document_statistics(docs: DataFrame) -> DataFrame:
    """doc_id, the counts of COUNTS and the model's statistics as an array, of every row."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1):
            got = [statistics(raw) for raw in raw_texts(batch.column(1))]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *[pa.array([c[i] for c, _ in got], pa.int64()) for i in range(len(COUNTS))],
                 pa.array([s for _, s in got], pa.list_(pa.float64()))], names=["doc_id", *COUNTS, "statistics"])

    source = picked(docs, "doc_id", "text").select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return source.mapInArrow(run, "doc_id long, " + ", ".join(f"{c} long" for c in COUNTS) + ", statistics array<double>")


def train(docs: DataFrame, labels: DataFrame, sample: int = 12_000) -> Trees:
    """Trees from at most ``sample`` labelled rows: those with the least hash of their doc_id."""
    chosen = (picked(labels, "doc_id", "quality").select(F.col("doc_id").cast("long").alias("id"), "quality")
              .filter("id IS NOT NULL AND quality IN (0, 1)")
              .orderBy(F.xxhash64("id"), "id", "quality").limit(sample))
    texts = picked(docs, "doc_id", "text").join(F.broadcast(chosen), F.col("doc_id") == F.col("id"))
    rows = (document_statistics(texts.select("doc_id", "text")).join(
        F.broadcast(chosen), F.col("doc_id") == F.col("id")).select("doc_id", "statistics", "quality").toPandas())
    rows = rows.sort_values(["doc_id", "quality"], kind="stable")
    x = np.array(rows["statistics"].tolist(), float).reshape(len(rows), len(STATISTICS))
    return grow(x, rows["quality"].to_numpy(float), list(STATISTICS.values()))


def judge(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, sample: int = 12_000) -> DataFrame:
    """doc_id, the counts of COUNTS, base_failed, kept and score of every row of ``docs``.

    base_failed: under 20 words, or more than 30 % of the words in repeated
    8-word windows. kept: not base_failed and the trees' score is at least
    ``threshold``. Null and empty texts have no words and fail the base rules.
    Null doc_ids are judged, but never train. Repeated rows are judged alike.
    Labels of one class only, or none, give a constant score. An empty table
    gives no rows. Other columns are left out. Texts are read whole.
    """
    model = train(docs, labels, sample)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.array(batch.column("statistics").to_pylist(), float).reshape(batch.num_rows, len(STATISTICS))
            n, repeat = (batch.column(c).to_numpy() for c in ("n_words", "n_repeat_words"))
            failed, score = (n < 20) | (100 * repeat > 30 * n), model.score(x)
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c) for c in ("doc_id", *COUNTS)], pa.array(failed),
                 pa.array(~failed & (score >= threshold)), pa.array(score)],
                names=["doc_id", *COUNTS, "base_failed", "kept", "score"])

    return document_statistics(docs).mapInArrow(
        run, "doc_id long, " + ", ".join(f"{c} long" for c in COUNTS) + ", base_failed boolean, kept boolean, score double")
