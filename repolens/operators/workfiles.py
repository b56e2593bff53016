"""Working files (Q28-Q30): archive plan, temporary files, recent files.

Listings: ``path, mtime`` with paths relative to the working root (S10).
Nothing is moved or deleted; the operators return the plans as tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from repolens.functions import text as X
from repolens.functions.fixed_values import CLOSED_STATES, RECENT_FILE_PATTERN, TEMP_PATTERNS


def archive_plan(files: DataFrame, issues: DataFrame) -> DataFrame:
    """Q28: entries directly under ``dev_*`` folders and what happens to them.

    The entry's number is its leading digits; without digits it is reported
    as ``unassociated``. Names containing ``archive`` are skipped. Entries whose
    issue is closed or merged get ``archive`` and a target under
    ``<folder>/archive/``; others ``keep``.
    """
    parts = F.split("path", "/")
    entries = (files.filter(F.size(parts) >= 2)
               .select(F.element_at(parts, 1).alias("folder"), F.element_at(parts, 2).alias("name"))
               .filter(F.col("folder").startswith("dev_") & ~F.col("name").contains("archive"))
               .distinct())
    entries = entries.select("folder", "name", F.replace("folder", F.lit("dev_"), F.lit("")).alias("repo"),
                             X.leading_number("name").alias("number_text"))
    entries = entries.withColumn("number", F.col("number_text").try_cast("bigint"))
    st = issues.select("repo", "number", "state")
    out = entries.join(st, ["repo", "number"], "left")
    action = (F.when(F.col("number").isNull(), "unassociated")
              .when(F.col("state").isin(CLOSED_STATES), "archive").otherwise("keep"))
    return out.select("repo", "folder", "name", "number", "state", action.alias("action"),
                      F.when(action == "archive", F.concat_ws("/", "folder", F.lit("archive"), "name"))
                      .alias("target"))


def stale_files(files: DataFrame, patterns: list[str] | None = None) -> DataFrame:
    """Q29: files matched by a temporary-file glob at any depth (first pattern wins)."""
    patterns = TEMP_PATTERNS if patterns is None else patterns
    return (files.select("path", X.glob_class("path", patterns).alias("pattern"))
            .filter(F.col("pattern").isNotNull()))


def recent_files(files: DataFrame, n: int | None = None) -> DataFrame:
    """Q30: working files named like ``<3-5 digits>...py``, under ``dev_``, not
    archived, newest first (ties by path, descending). All of them, or the top
    ``n`` when given (a top-k, planned as TakeOrdered).

    Like the file finder this stands for, hidden entries (a path part starting
    with ``.``) are not searched.
    """
    name = X.file_basename("path")
    hidden = F.exists(F.split("path", "/"), lambda part: part.startswith("."))
    picked = files.filter(name.rlike(RECENT_FILE_PATTERN) & ~F.col("path").contains("archive")
                          & F.col("path").startswith("dev_") & ~hidden)
    ordered = picked.orderBy(F.desc("mtime"), F.desc("path"))
    return (ordered.limit(n) if n is not None else ordered).select("path", "mtime")
