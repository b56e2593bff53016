"""Exact top-k inner products by a vector-approximation file.

Rows are dealt by hash into blocks. A block keeps, beside its exact vectors, a
quantised cell number per component. For a block of queries the scan of the
cells gives an upper and a lower bound of every score; a row whose upper bound
is under the k-th best lower bound is out. The exact vectors of the others are
read in the order of their bounds until the k-th best exact score is no less
than the next bound. Block results of a query meet in a group-limited window.

Queries are a stated share of the rows, so the work is queries x rows; query
blocks are copied to the data blocks, never a row to a row.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from repolens.llm.shared import picked

LONG = 2 ** 63 - 1


def scaled(vectors: list, width: int, scale: int) -> np.ndarray:
    """floor(scale * x) with x as double, padded with zeros; Python integers where doubles would not be exact."""
    out = np.zeros((len(vectors), width))
    for i, v in enumerate(vectors):
        out[i, :len(v)] = np.floor(scale * np.asarray(v, np.float64))
    if out.size and np.abs(out).max() ** 2 * width >= 2.0 ** 52:
        return np.array([[int(x) for x in row] for row in out], object).reshape(len(vectors), width)
    return out


class Cells:
    """Quantised components of a block: cell numbers and the edges of the cells."""

    def __init__(self, vectors: np.ndarray, bits: int):
        self.low = vectors.min(0)
        self.step = (vectors.max(0) - self.low) // (1 << bits) + 1
        numbers = (vectors - self.low) // self.step
        self.numbers = numbers if vectors.dtype == object else numbers.astype(np.uint8)

    def bounds(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Upper and lower bounds of the scores, rows x queries."""
        least = self.low + self.numbers * self.step
        most = least + (self.step - 1)
        up, down = np.maximum(queries, 0).T, np.minimum(queries, 0).T
        return most @ up + least @ down, least @ up + most @ down


def block_search(ids: np.ndarray, vectors: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, k: int,
                 bits: int) -> list[tuple[int, int, int]]:
    """(query_id, vec_id, score) of each query's k best rows of a block, the query's own id left out."""
    out = []
    cells = Cells(vectors, bits)
    for at in range(0, len(queries), 256):
        upper, lower = cells.bounds(queries[at:at + 256])
        for j, (own, query) in enumerate(zip(query_ids[at:at + 256], queries[at:at + 256])):
            others = ids != own
            up, low = upper[others, j], lower[others, j]
            rows = np.flatnonzero(others)
            if not len(rows):
                continue
            n = min(k, len(rows))
            certain = np.sort(low)[len(low) - n]
            alive = np.flatnonzero(up >= certain)
            alive = alive[np.argsort(-up[alive], kind="stable")]
            best: list[tuple[int, int]] = []
            step = 4 * k
            for first in range(0, len(alive), step):
                if len(best) >= n and up[alive[first]] < -best[n - 1][0]:
                    break  # ties of the k-th score stay in reach: the next bound must be smaller
                part = rows[alive[first:first + step]]
                best = sorted(best + [(-int(s), int(ids[r])) for s, r in zip(vectors[part] @ query, part)])[:n]
            out += [(int(own), v, max(-LONG, min(LONG, -s))) for s, v in best]
    return out


def top_k(vectors: DataFrame, every: int = 50, k: int = 5, scale: int = 256, bits: int = 4,
          block_rows: int = 4096, query_rows: int = 4096) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k best rows for every vec_id that ``every`` divides.

    Candidates are all rows but those with the query's own vec_id; fewer
    candidates than k are all reported; ties go to the smaller vec_id. Null
    vectors, vectors that are empty or hold null or non-finite components, and
    rows without a vec_id take no part. Where vec_ids repeat, every such row is
    a candidate of other queries, and the least of their vectors is the query.
    Vectors of different length are compared with zeros behind the shorter
    one. Scores beyond 64 bits are held at the limits. An empty table gives no
    rows. Other columns are left out.
    """
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    usable = (picked(vectors, "vec_id", "embedding")
              .select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>"))
              .filter(F.col("vec_id").isNotNull() & (F.size("embedding") > 0) & finite))
    queries = (usable.filter(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min("embedding").alias("embedding")))
    size = usable.agg(F.count("*").alias("n"), F.max(F.size("embedding")).alias("width"),
                      F.count_if(F.col("vec_id") % every == 0).alias("q")).first()
    blocks, parts, width = -(-size["n"] // block_rows) or 1, -(-size["q"] // query_rows) or 1, size["width"] or 0

    def dealt(df: DataFrame, n: int) -> F.Column:
        return F.pmod(F.xxhash64("vec_id"), F.lit(n)).cast("int")

    def everywhere(n: int) -> F.Column:
        return F.explode(F.sequence(F.lit(0), F.lit(n - 1)))

    rows = usable.withColumn("is_query", F.lit(False)).withColumn("block", dealt(usable, blocks)).withColumn(
        "part", everywhere(parts))
    asked = queries.withColumn("is_query", F.lit(True)).withColumn("block", everywhere(blocks)).withColumn(
        "part", dealt(queries, parts))

    def search(table: pa.Table) -> pa.Table:
        kind = table.column("is_query").to_numpy()
        ids = table.column("vec_id").to_numpy()
        values = scaled(table.column("embedding").to_pylist(), width, scale)
        order = np.lexsort((ids, kind))
        kind, ids, values = kind[order], ids[order], values[order]
        found = (block_search(ids[~kind], values[~kind], ids[kind], values[kind], k, bits)
                 if kind.any() and not kind.all() else [])
        columns = list(zip(*found)) or [[], [], []]
        return pa.table({n: pa.array(c, pa.int64()) for n, c in zip(("query_id", "vec_id", "score"), columns)})

    found = rows.unionByName(asked).groupBy("block", "part").applyInArrow(
        search, "query_id long, vec_id long, score long")
    ranked = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (found.withColumn("rank", F.row_number().over(ranked)).filter(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))


#: DuckDB SQL for the query's rows (every 50th vec_id, 5 best, scale 256).
ORACLE = """
WITH v AS (SELECT vec_id, [floor(256 * CAST(x AS DOUBLE)) FOR x IN embedding] AS e
  FROM embeddings WHERE vec_id IS NOT NULL AND len(embedding) > 0
  AND len([x FOR x IN embedding IF x IS NULL OR isnan(x) OR isinf(x)]) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.e, c.e) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id)
SELECT query_id, CAST(r AS INTEGER) AS rank, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS r FROM s) WHERE r <= 5
"""
