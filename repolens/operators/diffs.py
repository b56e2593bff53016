"""Differences between a good and a bad run (Q14-Q17).

All inputs carry a ``side`` column (``good`` / ``bad``) and optional key
columns (``keys``), so that many pairs of runs are compared in one job.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from repolens.functions import text as X
from repolens.operators.ordinal import ordinal_within


def line_diff(lines: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """Q14: multiset line difference of two text dumps, direction bad -> good.

    ``lines``: ``side, path, line_no, line`` plus ``keys`` (paths and lines are
    not null). The k-th copy of a line on one side is matched with the k-th copy
    on the other; unmatched copies are ``removed`` (bad only) or ``added`` (good
    only), with their line numbers. Moved lines are not reported.

    Copies are counted first (partial aggregation): most lines cancel there.
    Only the surplus side of the others is numbered, by a skew-safe ordinal, so
    one very common line does not land in one task.
    """
    line = [*keys, "path", "line"]
    counts = lines.groupBy(*line).agg(F.count_if(F.col("side") == "good").alias("_good"),
                                      F.count_if(F.col("side") == "bad").alias("_bad"))
    surplus = counts.filter(F.col("_good") != F.col("_bad")).select(
        *line, F.when(F.col("_good") > F.col("_bad"), "good").otherwise("bad").alias("side"),
        F.least("_good", "_bad").alias("_matched"))
    left = lines.select(*line, "side", "line_no").join(surplus, [*line, "side"])
    numbered = ordinal_within(left, line, ["line_no"], name="copy")
    return numbered.filter(F.col("copy") > F.col("_matched")).select(
        *line, F.when(F.col("side") == "bad", "removed").otherwise("added").alias("status"), "line_no")


def package_diff(locks: DataFrame, env: str | None = None, arch: str | None = None,
                 keys: tuple[str, ...] = ()) -> DataFrame:
    """Q15: packages whose file differs per environment and platform.

    ``locks``: ``side, env, arch, url`` plus ``keys``. Only environments
    starting with ``test`` (so asking for ``docs`` yields nothing); pairs
    missing on the bad side are ignored; identical file names cancel; entry
    ``.`` is dropped; one row per package name with the good and bad file,
    ``-`` where absent (the least file name when several share a name).

    One pass: files carry a flag per side, then packages keep the files of one
    side. Whether a pair stands on both sides is a window over its packages (at
    most the package names of one environment, after both aggregations).
    """
    pair = [*keys, "env", "arch"]
    chosen = locks.filter(F.col("env").startswith("test"))
    if env is not None:
        chosen = chosen.filter(F.col("env") == env)
    if arch is not None:
        chosen = chosen.filter(F.col("arch") == arch)
    files = chosen.select(*pair, "side", X.file_basename("url").alias("file")).groupBy(*pair, "file").agg(
        _on("good"), _on("bad"))
    real = F.col("file") != "."
    packages = files.groupBy(*pair, X.package_name("file").alias("package")).agg(
        F.min(F.when(F.col("_good") & ~F.col("_bad") & real, F.col("file"))).alias("good_file"),
        F.min(F.when(F.col("_bad") & ~F.col("_good") & real, F.col("file"))).alias("bad_file"),
        F.max("_good").alias("_good"), F.max("_bad").alias("_bad"))
    both = Window.partitionBy(*pair)
    out = packages.withColumn("_both", F.max("_good").over(both) & F.max("_bad").over(both)).filter(
        F.col("_both") & F.coalesce("good_file", "bad_file").isNotNull())
    return out.select(*pair, "package", F.coalesce("good_file", F.lit("-")).alias("good_file"),
                      F.coalesce("bad_file", F.lit("-")).alias("bad_file"))


def _on(side: str) -> Column:
    """Does a group hold a row of ``side``?"""
    return F.max(F.col("side") == side).alias(f"_{side}")


def normalized_members(members: DataFrame, npm_prefix: str | None = None,
                       keys: tuple[str, ...] = ()) -> DataFrame:
    """Members with the archive's own version replaced by ``$VERSION``.

    The two patterns are built once per archive (a table with one row per
    archive, joined back; AQE broadcasts it when small and splits a hot archive
    otherwise). Rows are then sorted by archive inside each partition (no
    shuffle): Spark recompiles a pattern column only when its value changes.
    Archives without a three-number version are dropped.
    """
    arch = members.select(*keys, "archive", "format").distinct()
    plain, loose = X.version_patterns(X.archive_version_text("archive", "format", npm_prefix))
    pats = arch.select(*keys, "archive", "format", plain.alias("plain"), loose.alias("loose")) \
        .filter(F.col("plain").isNotNull())
    return _without_version(members.join(pats, [*keys, "archive", "format"]), keys)


def _without_version(members: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    norm = F.regexp_replace(F.regexp_replace("member", F.col("loose"), r"\$VERSION"), F.col("plain"), r"\$VERSION")
    return members.sortWithinPartitions(*keys, "archive").select(
        *keys, "side", "format", "archive", norm.alias("member"))


def file_list_diff(members: DataFrame, npm_prefix: str | None = None,
                   keys: tuple[str, ...] = (), archives: DataFrame | None = None) -> DataFrame:
    """Q16: normalised archive members present in only one build, per format.

    Output ``format, side, member``: ``side`` names the build that has it. Per
    format only the archives that ``pick_archive_pairs`` picks are compared; a
    format without a pair is skipped. ``archives`` (``side, format, archive``
    plus ``keys``) lists the archives, so that they need not be opened for
    their names; without it the names come from ``members``.

    One pass over the members: each normalised name carries a flag per side.
    """
    listed = members if archives is None else archives
    pairs = pick_archive_pairs(listed, npm_prefix, keys)
    chosen = pairs.select(*keys, "format", F.explode(F.array(
        F.struct(F.lit("good").alias("side"), F.col("good_archive").alias("archive")),
        F.struct(F.lit("bad").alias("side"), F.col("bad_archive").alias("archive")))).alias("a")).select(
        *keys, "format", "a.side", "a.archive")
    plain, loose = X.version_patterns(X.archive_version_text("archive", "format", npm_prefix))
    chosen = chosen.select("*", plain.alias("plain"), loose.alias("loose"))
    norm = _without_version(members.join(chosen, [*keys, "side", "format", "archive"]), keys)
    sides = norm.groupBy(*keys, "format", "member").agg(_on("good"), _on("bad"))
    return sides.filter(F.col("_good") != F.col("_bad")).select(
        *keys, F.when(F.col("_good"), "good").otherwise("bad").alias("side"), "format", "member")


def file_list_side_by_side(diff: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """Q16 side by side: the two sorted lists next to each other, ``-`` as filler."""
    keys = list(keys)
    numbered = ordinal_within(diff, [*keys, "format", "side"], ["member"], name="row")
    good = numbered.filter(F.col("side") == "good").select(*keys, "format", "row",
                                                           F.col("member").alias("good_member"))
    bad = numbered.filter(F.col("side") == "bad").select(*keys, "format", "row",
                                                         F.col("member").alias("bad_member"))
    out = good.join(bad, [*keys, "format", "row"], "full_outer")
    return out.select(*keys, "format", "row", F.coalesce("good_member", F.lit("-")).alias("good_member"),
                      F.coalesce("bad_member", F.lit("-")).alias("bad_member"))


def pick_archive_pairs(archives: DataFrame, npm_prefix: str | None = None,
                       keys: tuple[str, ...] = ()) -> DataFrame:
    """Q17: the archive compared per format on each side.

    First by name; for conda formats names containing ``core`` come first. A
    format missing on one side, or whose pick has no three-part version, is
    skipped. A partial aggregate (``min_by``), not a window.
    """
    keys = list(keys)
    is_conda = F.col("format").isin("conda", "conda1")
    rank = F.struct(F.when(is_conda, ~F.col("archive").contains("core")).otherwise(F.lit(False)),
                    F.col("archive"))
    picked = archives.groupBy(*keys, "side", "format").agg(F.min_by("archive", rank).alias("archive"))
    plain, _ = X.version_patterns(X.archive_version_text("archive", "format", npm_prefix))
    picked = picked.withColumn("ok", plain.isNotNull())
    good = picked.filter(F.col("side") == "good").select(*keys, "format", F.col("archive").alias("good_archive"),
                                                         F.col("ok").alias("good_ok"))
    bad = picked.filter(F.col("side") == "bad").select(*keys, "format", F.col("archive").alias("bad_archive"),
                                                       F.col("ok").alias("bad_ok"))
    both = good.join(bad, [*keys, "format"])
    return both.filter(F.col("good_ok") & F.col("bad_ok")).select(*keys, "format", "good_archive", "bad_archive")
