"""Dependencies (Q18-Q20): support window of each package and the dependency report.

Index files: ``package, filename, requires_python, upload_time`` (S7).
Requirements: ``main_package, requirement`` (S8).
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from repolens.functions import text as X
from repolens.functions import versions as V
from repolens.functions.fixed_values import INTERPRETER_RELEASES, PACKAGE_ALIASES, SPEC0_DAYS


def _release_date(python_version: str, released_at) -> dt.datetime | None:
    if released_at is not None:
        return released_at
    return dict(INTERPRETER_RELEASES).get(python_version)


def support_window(files: DataFrame, python_version: str, as_of, released_at=None) -> DataFrame:
    """Q18: ``package, minimum, maximum, current, spec0`` per package.

    * files whose name does not parse, and pre-releases, are dropped;
    * ``minimum``/``maximum``: least and greatest version with a file that
      allows ``python_version`` and was uploaded on or after that Python's
      release (both tests per file);
    * ``current``: greatest version; ``spec0``: least version with third
      number 0 first uploaded within 730 days before ``as_of``;
    * equal versions spelled apart are one group, named by the least spelling;
    * missing values are ``-``. An interpreter version outside the table
      gives no qualifying files.

    Partial aggregations only: per (package, version, specifier), where the
    specifier is tested, then per version and per package. One scan, no join.
    """
    py_date = _release_date(python_version, released_at)
    # unparsable names get a null version and are dropped after the first
    # aggregation (a row filter here would be pushed into the scan with the
    # parse expression copied into it)
    parsed = files.select("package", V.dist_version_text("filename").alias("version"),
                          F.coalesce("requires_python", F.lit("")).alias("spec"), "upload_time")
    # the specifier test is a large expression: evaluate it once per group, not once per file; a group has a
    # qualifying file exactly when its latest upload qualifies
    by_spec = parsed.groupBy("package", "version", "spec").agg(
        F.min("upload_time").alias("first_upload"), F.max("upload_time").alias("last_upload"))
    ok = F.lit(False) if py_date is None else (
        V.specifier_contains("spec", F.lit(python_version)) & (F.col("last_upload") >= X.ntz(py_date)))
    # reduce to one row per spelling before any version parsing
    spelled = by_spec.groupBy("package", "version").agg(
        F.min("first_upload").alias("first_upload"), F.max(ok).alias("any_ok"),
        F.max(V.is_version("version")).alias("_valid")).filter(F.col("_valid")).drop("_valid")
    # the pre-release test is an aggregate here: as a filter on the grouping
    # key, Catalyst would push it (and the whole parse) below the aggregation
    spelled = spelled.withColumn("vp", V.version_parts("version"))
    per_version = (spelled.withColumn("vkey", V.version_key("vp", parts=True))
                   .withColumn("pre", V.is_prerelease("vp", parts=True))
                   .groupBy("package", "vkey")
                   .agg(F.min("version").alias("spelling"), F.min("first_upload").alias("first_upload"),
                        F.max("any_ok").alias("any_ok"), F.max("pre").alias("pre"))
                   .filter(~F.col("pre")))
    drop_date = X.ntz(as_of) - F.expr(f"INTERVAL {SPEC0_DAYS} DAYS")
    micro0 = F.coalesce(F.try_element_at(F.col("vkey.release"), F.lit(3)), F.lit(0)) == 0
    # vkey.release has trailing zeros stripped; the third number is 0 exactly when it is absent or 0
    spec0_key = F.when(micro0 & (F.col("first_upload") >= drop_date), F.col("vkey"))
    ok_key = F.when(F.col("any_ok"), F.col("vkey"))
    per_package = per_version.groupBy("package").agg(
        F.min_by("spelling", ok_key).alias("minimum"),
        F.max_by("spelling", ok_key).alias("maximum"),
        F.max_by("spelling", F.col("vkey")).alias("current"),
        F.min_by("spelling", spec0_key).alias("spec0"))
    cols = ["minimum", "maximum", "current", "spec0"]
    per_package = per_package.select("package", *[V.version_parts(c).alias(c) for c in cols])
    return per_package.select(
        "package", *[F.coalesce(V.normalize_version(c, parts=True), F.lit("-")).alias(c) for c in cols])


def aliases(spark) -> DataFrame:
    return spark.createDataFrame(PACKAGE_ALIASES, "name string, mapped string")


def normal_name(name: str):
    """A package name as the index spells it."""
    return F.regexp_replace(F.lower(F.col(name)), "[-_.]+", "-")


def dependency_names(requirements: DataFrame) -> DataFrame:
    """Q19: distinct dependency names per main package after alias mapping.

    Aliases hold for project declarations; rows whose ``kind`` column says
    otherwise (``index``) keep their names.

    A name mapped to null is dropped. The alias table is a fixed 25-row list.
    """
    spark = requirements.sparkSession
    project = F.col("kind") == "project" if "kind" in requirements.columns else F.lit(True)
    names = requirements.select("main_package", V.requirement_name("requirement").alias("name"), project.alias("_project")) \
        .filter(F.col("name").isNotNull())
    mapped = names.join(F.broadcast(aliases(spark)), "name", "left").select(
        "main_package",
        F.when(F.col("_project") & F.col("name").isin([a for a, _ in PACKAGE_ALIASES]), F.col("mapped"))
        .otherwise(F.col("name")).alias("package"))
    return mapped.filter(F.col("package").isNotNull()).distinct()


def dependency_report(requirements: DataFrame, files: DataFrame, python_version: str, as_of,
                      released_at=None) -> DataFrame:
    """Q20: each dependency of each main package with its support window; unknown -> ``-``.

    Names meet in the index's normal form (lower case, runs of ``-_.`` as one
    ``-``); the declared spelling is printed.
    """
    deps = dependency_names(requirements).withColumn("_name", normal_name("package"))
    wanted = files.withColumn("package", normal_name("package")).join(
        deps.select(F.col("_name").alias("package")).distinct(), "package", "left_semi")
    window = support_window(wanted, python_version, as_of, released_at)
    out = deps.join(window.withColumnRenamed("package", "_name"), "_name", "left")
    return out.select("main_package", "package",
                      *[F.coalesce(c, F.lit("-")).alias(c) for c in ["minimum", "maximum", "current", "spec0"]])


def python_floor(features: DataFrame, key: str = "main_package", col: str = "feature") -> DataFrame:
    """V23 per main package: the lowest interpreter among ``py3NN`` feature keys."""
    return (features.filter(F.col(col).startswith("py3"))
            .groupBy(key).agg(V.python_floor(col).alias("python_floor")))
