"""CI runs (Q10-Q13): unfinished runs, run pairs, artifacts to fetch, environment files.

Runs: ``repo, run_number, name (workflow), head_branch, display_title, status,
conclusion, run_started_at, actor`` and optionally ``created_at``, ``url``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from repolens.functions import text as X


def active_runs(runs: DataFrame, as_of) -> DataFrame:
    """Q10: runs whose status is not ``completed``, newest start first, with elapsed minutes.

    ``as_of`` stands for the time of the poll (a timestamp literal or column).
    Many repositories are one scan; empty input gives no rows.
    """
    as_of = X.ntz(as_of)
    active = runs.filter(~F.col("status").eqNullSafe("completed"))
    return active.select(
        F.col("repo"),
        F.col("name").alias("workflow"),
        F.col("head_branch").alias("branch"),
        F.col("display_title").alias("title"),
        F.col("status"),
        F.col("run_started_at").alias("started_at"),
        X.elapsed_minutes("run_started_at", as_of).alias("duration"),
        F.col("actor").alias("user"),
    ).orderBy(F.desc("started_at"))


def run_history(runs: DataFrame, depth: int | None = None, workflow: str = "name") -> DataFrame:
    """Q11 (first half): the runs per (repo, workflow), labelled.

    ``workflow`` names the column that tells workflows apart: ``name``, or
    ``workflow_file`` of the readers (two workflows may share a name). All runs are searched; a caller may ask for the newest ``depth`` only
    (``row_number() <= depth``, planned as a group limit before the shuffle).
    """
    if "created_at" not in runs.columns:
        runs = runs.withColumn("created_at", F.col("run_started_at"))
    if "url" not in runs.columns:
        runs = runs.withColumn("url", F.concat(
            F.lit("https://api.github.com/repos/"), F.col("repo"), F.lit("/actions/runs/"),
            F.col("run_number").cast("string")))
    if depth is None:
        recent = runs
    else:
        w = Window.partitionBy("repo", workflow).orderBy(F.desc("run_number"))
        recent = runs.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= depth).drop("_rn")
    return recent.select(
        "repo", F.col(workflow).alias("workflow"), "run_number",
        X.run_label("run_number", "conclusion", "created_at", "head_branch").alias("label"),
        F.concat(F.col("url"), F.lit("/artifacts")).alias("artifacts_url"))


def run_pairs(runs: DataFrame, pairs: DataFrame, depth: int | None = None, workflow: str = "name") -> DataFrame:
    """Q11: good and bad run of each request ``(repo, workflow, good_run, bad_run)``.

    A pair is found only if both runs exist (among the newest ``depth`` where one is given).
    """
    hist = run_history(runs, depth, workflow)
    good = hist.select("repo", "workflow", F.col("run_number").alias("good_run"),
                       F.col("label").alias("good_label"), F.col("artifacts_url").alias("good_url"))
    bad = hist.select("repo", "workflow", F.col("run_number").alias("bad_run"),
                      F.col("label").alias("bad_label"), F.col("artifacts_url").alias("bad_url"))
    return (pairs.join(good, ["repo", "workflow", "good_run"])
            .join(bad, ["repo", "workflow", "bad_run"])
            .select("repo", "workflow", "good_run", "bad_run", "good_label", "bad_label", "good_url", "bad_url"))


def select_artifacts(artifacts: DataFrame, names: list[str] | None = None,
                     keys: tuple[str, ...] = ("run_number",)) -> DataFrame:
    """Q12: artifacts to fetch per run: those named in ``names``; with no names,
    only the first in list order (a partial aggregate, not a window)."""
    keys = list(keys)
    if names:
        return artifacts.filter(F.col("name").isin(names)).select(*keys, "name", "archive_download_url")
    first = artifacts.groupBy(*keys).agg(
        F.min_by(F.struct("name", "archive_download_url"), F.col("position")).alias("a"))
    return first.select(*keys, "a.name", "a.archive_download_url")


def match_env_files(files: DataFrame, os_name: str, python: str, test: str,
                    keys: tuple[str, ...] = ()) -> DataFrame:
    """Q13: the environment file of a good run, and the same name on the bad side.

    ``files``: ``side ('good'|'bad'), path`` plus ``keys``. A name matches when
    its lower-cased form contains the OS, the Python version and ``_<test>``;
    the least matching name is taken, since listing order is arbitrary.
    """
    keys = list(keys)
    named = files.withColumn("file", X.file_basename("path"))
    low = F.lower("file")
    match = low.contains(os_name) & low.contains(python) & low.contains(f"_{test}")
    good = (named.filter((F.col("side") == "good") & match)
            .groupBy(*keys).agg(F.min_by(F.struct("file", "path"), F.struct("file", "path")).alias("g")))
    good = good.select(*keys, F.col("g.file").alias("file"), F.col("g.path").alias("good_path")).filter("file IS NOT NULL")
    bad = named.filter(F.col("side") == "bad").groupBy(*keys, "file").agg(F.min("path").alias("bad_path"))
    return good.join(bad, [*keys, "file"], "left")
