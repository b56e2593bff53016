"""Download manifest flattening (Q37)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def download_index(manifests: DataFrame, milestone: str | None = None, product: str | None = None,
                   platform: str | None = None) -> DataFrame:
    """Q37: ``milestone, product, platform, url`` from nested manifests, filtered.

    ``manifests.milestones``: map milestone -> struct(downloads: map product ->
    array<struct<platform, url>>).
    """
    m = manifests.select(F.explode("milestones").alias("milestone", "m"))
    if milestone is not None:
        m = m.filter(F.col("milestone") == milestone)
    p = m.select("milestone", F.explode("m.downloads").alias("product", "items"))
    if product is not None:
        p = p.filter(F.col("product") == product)
    out = p.select("milestone", "product", F.explode("items").alias("d")).select(
        "milestone", "product", "d.platform", "d.url")
    if platform is not None:
        out = out.filter(F.col("platform") == platform)
    return out


def nest_manifest(flat: DataFrame) -> DataFrame:
    """The nested manifest shape (one row per milestone) from flat rows."""
    per_product = flat.groupBy("milestone", "product").agg(
        F.sort_array(F.collect_list(F.struct("platform", "url"))).alias("items"))
    per_milestone = per_product.groupBy("milestone").agg(
        F.map_from_entries(F.collect_list(F.struct("product", "items"))).alias("downloads"))
    return per_milestone.select(F.create_map("milestone", F.struct("downloads")).alias("milestones"))
