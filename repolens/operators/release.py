"""Next release versions (Q36)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from repolens.functions import versions as V


def next_versions(tags: DataFrame, existing: DataFrame) -> DataFrame:
    """Q36: candidate next tags per package that are not tagged yet.

    ``tags``: ``package, tag`` (current tag); ``existing``: ``package, tag``.
    Candidates come from V8, written in canonical form (V10), with the npm
    spelling (V9) alongside.
    """
    cands = tags.select("package", F.posexplode(V.next_candidates("tag")).alias("choice", "candidate"))
    cands = cands.select("package", F.col("choice").cast("bigint").alias("choice"),
                         V.canonical_tag("candidate").alias("tag")).filter(F.col("tag").isNotNull())
    fresh = cands.join(existing.select("package", "tag"), ["package", "tag"], "left_anti")
    return fresh.select("package", "choice", "tag", V.npm_version("tag").alias("npm_version"))
