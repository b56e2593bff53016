"""Cross-site boilerplate lines by distinct-site spread, on native expressions only.

Every line with at least ``min_words`` words is a pair of 64-bit hashes. A
HyperLogLog sketch of the sites per line, merged by the aggregation, estimates
on how many sites the line stands. Estimates far from ``min_sites`` decide;
lines whose estimate is within ``margin`` of it get an exact distinct count.
A line on ``min_sites`` sites or more stays where it stands first (least
doc_id, then position) and goes everywhere else.

Lines are shuffled as hashes. The text is shuffled once, to meet the positions
that go. A line that a third of all documents hold is combined before the
shuffle when counted; lines with a ten-thousandth of all places (``HOT_LINES``
of them at most) meet their places by broadcast, so no shuffled line is hot.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from repolens.llm.shared import WORD, text_or_empty

#: Lines that can hold a ten-thousandth of all places each; the most that are ever broadcast (some 400 KB).
HOT_LINES = 10_000


def drop_spread_lines(docs: DataFrame, site: str = "source", min_sites: int = 10, min_words: int = 1,
                      margin: float = 0.5, lg_k: int = 12) -> DataFrame:
    """The rows and columns of ``docs`` with ``text`` cleaned, and n_lines, n_removed.

    A null text stays null (0 lines). An empty text has one empty line, which
    is never removed. A null site counts as no site, but lines of such rows are
    cleaned too. Null doc_ids order first. Rows that share doc_id, line and
    position keep it together, so repeated rows are treated alike. A document
    whose lines all go keeps an empty text. An empty table gives no rows.
    Columns of ``docs`` called n_lines or n_removed are replaced; all others
    pass through whatever their names.
    """
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    rows = rows.select("row", F.col("row.doc_id").alias("doc"), F.col(f"row.`{site}`").cast("string").alias("site"),
                       F.split(F.col("row.text").cast("string"), "\n").alias("lines"))
    hashed = (rows.select("doc", "site", F.posexplode("lines").alias("pos", "line"))
              .filter(F.regexp_count("line", F.lit(WORD)) >= min_words)
              .select("doc", "site", "pos", F.xxhash64("line").alias("h1"),
                      F.xxhash64(F.lit("line"), "line").alias("h2"))).checkpoint(eager=True)
    spread = (hashed.groupBy("h1", "h2").agg(
        F.hll_sketch_agg("site", lg_k).alias("sketch"), F.min(F.struct("doc", "pos")).alias("first"),
        F.count("*").alias("places"))
        .select("h1", "h2", "first", "places", F.hll_sketch_estimate("sketch").alias("sites"))
        .filter(F.col("sites") >= min_sites * (1 - margin))).checkpoint(eager=True)
    far = spread.filter(F.col("sites") > min_sites * (1 + margin)).drop("sites")
    near = spread.filter(F.col("sites") <= min_sites * (1 + margin)).drop("sites")
    # a line with a ten-thousandth of all places is hot; there are HOT_LINES of them at most
    hot = F.col("places") * HOT_LINES >= hashed.count()

    def meet(some: DataFrame) -> DataFrame:
        """Places of the lines in ``some`` with its ``first``; hot lines meet without a shuffle."""
        marked = hashed.join(F.broadcast(some.filter(hot).select("h1", "h2", F.col("first").alias("f"))), ["h1", "h2"], "left")
        cold = marked.filter("f IS NULL").drop("f").join(some.filter(~hot).select("h1", "h2", "first"), ["h1", "h2"])
        return marked.filter("f IS NOT NULL").withColumnRenamed("f", "first").unionByName(cold)

    exact = (meet(near).groupBy("h1", "h2").agg(F.countDistinct("site").alias("n"))
             .filter(F.col("n") >= min_sites).select("h1", "h2"))
    boilerplate = far.unionByName(near.join(exact, ["h1", "h2"], "left_semi")).checkpoint(eager=True)
    hits = (meet(boilerplate).filter(~(F.col("doc").eqNullSafe(F.col("first.doc")) & (F.col("pos") == F.col("first.pos"))))
            .groupBy(F.coalesce("doc", F.lit(0)).alias("d"), F.col("doc").isNull().alias("no_d"))
            .agg(F.collect_set(F.struct("pos", "h1")).alias("gone")))
    joined = (rows.withColumn("d", F.coalesce("doc", F.lit(0))).withColumn("no_d", F.col("doc").isNull())
              .join(hits, ["d", "no_d"], "left"))
    kept = F.filter("lines", lambda line, i: ~F.array_contains(
        "gone", F.struct(i.alias("pos"), F.xxhash64(line).alias("h1"))))
    joined = joined.withColumn("kept", F.when(F.col("gone").isNull(), F.col("lines")).otherwise(kept))
    others = [F.array_join("kept", "\n").alias("text") if c == "text" else F.col(f"row.`{c}`").alias(c)
              for c in docs.columns if c not in ("n_lines", "n_removed")]
    n = F.coalesce(F.size("lines"), F.lit(0))
    return joined.select(
        *others, F.when(F.col("lines").isNull(), 0).otherwise(n).cast("long").alias("n_lines"),
        F.when(F.col("gone").isNull(), 0).otherwise(n - F.size("kept")).cast("long").alias("n_removed"))


#: DuckDB SQL for the query's rows; :min_sites and :min_words are written out.
ORACLE = """
WITH split AS (SELECT doc_id, source, string_split(text, chr(10)) AS l FROM documents),
lines AS (SELECT doc_id, source, unnest(l) AS line, unnest(range(len(l))) AS pos FROM split),
counted AS (SELECT *, len(regexp_extract_all(line, '[^\\x20\\x09-\\x0D]+')) >= 1 AS long_enough FROM lines),
boiler AS (SELECT line, min(struct_pack(d := doc_id, p := pos)) AS first FROM counted WHERE long_enough
  GROUP BY line HAVING count(DISTINCT source) >= 10),
marked AS (SELECT c.*, c.long_enough AND b.line IS NOT NULL AND NOT (c.doc_id = b.first.d AND c.pos = b.first.p) AS gone
  FROM counted c LEFT JOIN boiler b ON c.line = b.line),
cleaned AS (SELECT doc_id, string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone) AS t, count(*) AS n,
  count(*) FILTER (WHERE gone) AS g FROM marked GROUP BY doc_id)
SELECT d.doc_id, CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(c.t, '') END AS text,
  coalesce(c.n, 0) AS n_lines, coalesce(c.g, 0) AS n_removed
FROM documents d LEFT JOIN cleaned c ON d.doc_id = c.doc_id
"""
