"""Version bisection over recorded test results (Q34, Q35).

Inputs: a version catalogue ``package, version`` (S12), results
``package, version, passed`` and ranges ``package, good_version, bad_version``.

The halving search is kept exactly (same probes as a loop, so the same answer
when results are not monotone), but runs for all ranges at once: one equi-join
of the ranges with the numbered catalogue answers ``STEPS`` halvings, so
ceil(log2(longest range) / STEPS) joins do (three for 16 million versions).
Versions are numbered with the skew-safe ordinal, so a package with a huge
catalogue is spread over many tasks.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from repolens.functions import text as X
from repolens.functions import versions as V
from repolens.operators.ordinal import ordinal_within

RANGE = ["package", "good_version", "bad_version"]
#: Halvings that one join answers: at most 255 positions of a range are looked up at once.
STEPS = 8


def _catalogue(versions: DataFrame, results: DataFrame) -> DataFrame:
    cat = versions.select("package", "version").distinct().filter(V.is_dotted("version")).withColumn("k", V.dotted_key("version"))
    passed = results.groupBy("package", "version").agg(F.bool_and("passed").alias("passed"))
    return cat.join(passed, ["package", "version"], "left") \
        .withColumn("passed", F.coalesce("passed", F.lit(False)))


def baseline_check(versions: DataFrame, results: DataFrame, ranges: DataFrame) -> DataFrame:
    """Q35: the good version must exist and pass, the bad one exist and fail.

    Adds ``gk``, ``bk`` (V2 keys) and ``reason`` (null when the range is usable).
    A version without a result counts as failing. Versions whose parts are not
    all numbers have no place in the order: they take no part, and a range that
    names one says so.
    """
    cat = _catalogue(versions, results)
    g = cat.select("package", F.col("version").alias("good_version"), F.col("k").alias("gk"),
                   F.col("passed").alias("good_passed"))
    b = cat.select("package", F.col("version").alias("bad_version"), F.col("k").alias("bk"),
                   F.col("passed").alias("bad_passed"))
    out = ranges.join(g, ["package", "good_version"], "left").join(b, ["package", "bad_version"], "left")
    reason = (F.when(~V.is_dotted("good_version"), "good version is not numeric")
              .when(~V.is_dotted("bad_version"), "bad version is not numeric")
              .when(F.col("gk").isNull(), "good version not found")
              .when(F.col("bk").isNull(), "bad version not found")
              .when(~F.col("good_passed"), "good version failed")
              .when(F.col("bad_passed"), "bad version passed"))
    return out.select(*RANGE, "gk", "bk", reason.alias("reason"),
                      X.env_key("package", "good_version").alias("good_env"),
                      X.env_key("package", "bad_version").alias("bad_env"))


def indexed_catalogue(versions: DataFrame, results: DataFrame) -> DataFrame:
    """``package, idx, version, passed, fails_upto`` over each package's sorted catalogue.

    ``idx`` is the 1-based position by V2 key; ``fails_upto`` counts failing
    versions at positions <= idx. Both come from skew-safe ordinals (over all
    versions, over passing ones, over failing ones): for a failing version it
    is its rank among failing ones, for a passing one ``idx`` minus its rank
    among passing ones. No window, no per-package collection.
    """
    cat = _catalogue(versions, results)
    order = ["k", "version"]
    num = ordinal_within(cat, ["package"], order, name="idx")
    # rank among passing versions and among failing ones, in one numbering
    split = ordinal_within(cat, ["package", "passed"], order, name="rank").select("package", "version", "rank")
    t = num.join(split, ["package", "version"])
    fails = F.when(F.col("passed"), F.col("idx") - F.col("rank")).otherwise(F.col("rank"))
    return t.select("package", "idx", "version", "passed", fails.alias("fails_upto"),
                    F.when(~F.col("passed"), F.col("rank")).alias("fail_rank")).checkpoint(eager=True)


def _mid(x) -> Column:
    return F.floor((x["l"] + x["r"]) / 2).cast("bigint")


def _halvings(state: DataFrame, probe: DataFrame, steps: int) -> DataFrame:
    """``steps`` halvings of every range by one join.

    The positions that these halvings can meet form a binary tree below the
    interval (at most ``2 ** steps - 1`` of them); all are looked up at once,
    and the halvings then walk down the tree inside the row.
    """
    nodes, wanted = F.array(F.struct(F.col("l").alias("l"), F.col("r").alias("r"))), []
    for _ in range(steps):
        open_ = F.filter(nodes, lambda x: x["r"] - x["l"] > 1)
        wanted.append(F.transform(open_, _mid))
        nodes = F.flatten(F.transform(open_, lambda x: F.array(F.struct(x["l"].alias("l"), _mid(x).alias("r")),
                                                               F.struct(_mid(x).alias("l"), x["r"].alias("r")))))
    keys = [*RANGE, "gi", "dir", "l", "r", "probes"]
    asked = state.select(*keys, F.explode_outer(F.flatten(F.array(*wanted))).alias("mid")).withColumn(
        "at", F.col("gi") + (F.col("mid") - 1) * F.col("dir"))
    found = asked.join(probe, ["package", "at"], "left").groupBy(*keys).agg(F.map_from_entries(F.collect_list(
        F.when(F.col("mid").isNotNull(), F.struct("mid", "mid_passed")))).alias("known"))

    def halve(s: Column, _: Column) -> Column:
        mid, going = _mid(s), s["r"] - s["l"] > 1
        passed = F.try_element_at(F.col("known"), mid)
        return F.struct(F.when(going & passed, mid).otherwise(s["l"]).alias("l"), F.when(going & ~passed, mid).otherwise(s["r"]).alias("r"),
                        (s["probes"] + F.when(going, 1).otherwise(0)).alias("probes"))

    walked = F.aggregate(F.sequence(F.lit(1), F.lit(steps)), F.struct("l", "r", "probes"), halve)
    return found.select(*RANGE, "gi", "dir", walked.alias("w")).select(*RANGE, "gi", "dir", "w.l", "w.r", "w.probes")


def version_regressions(versions: DataFrame, results: DataFrame, ranges: DataFrame) -> DataFrame:
    """Q34: first failing and last passing version between a good and a bad version.

    When good > bad the list runs backwards and the pair reads as last failing
    and first passing (``direction = 'reverse'``). Rows that fail the baseline
    carry the reason in ``status`` and no versions. ``probes`` counts the
    halving steps. Second mode for results that are not monotone:
    ``scan_failing_version`` is the first failure met walking from the good
    version, ``monotone`` whether all passes come before all failures.

    Positions are relative to the good version's catalogue position, so every
    probe is an equi-join on ``(package, idx)``; a range is never paired with
    the versions of its package.
    """
    base = baseline_check(versions, results, ranges)
    t = indexed_catalogue(versions, results)
    g = t.select("package", F.col("version").alias("good_version"), F.col("idx").alias("gi"),
                 F.col("fails_upto").alias("gcum"))
    b = t.select("package", F.col("version").alias("bad_version"), F.col("idx").alias("bi"),
                 F.col("fails_upto").alias("bcum"))
    usable = (base.filter(F.col("reason").isNull()).select(*RANGE)
              .join(g, ["package", "good_version"]).join(b, ["package", "bad_version"])
              .withColumn("dir", F.when(F.col("gi") < F.col("bi"), 1).otherwise(-1).cast("bigint"))
              .withColumn("n", F.abs(F.col("bi") - F.col("gi")) + 1))
    longest = usable.agg(F.max("n")).first()[0] or 1
    rounds = max(0, math.ceil(math.log2(max(longest - 1, 1))))

    state = usable.select(*RANGE, "gi", "dir", F.lit(1).cast("bigint").alias("l"),
                          F.col("n").cast("bigint").alias("r"), F.lit(0).alias("probes"))
    probe = t.select("package", F.col("idx").alias("at"), F.col("passed").alias("mid_passed"))
    for start in range(0, rounds, STEPS):
        state = _halvings(state, probe, min(STEPS, rounds - start)).checkpoint(eager=True)
    at = t.select("package", F.col("idx").alias("at"), "version")
    done = (state.withColumn("at", F.col("gi") + (F.col("r") - 1) * F.col("dir"))
            .join(at.withColumnRenamed("version", "failing_version"), ["package", "at"], "left").drop("at")
            .withColumn("at", F.col("gi") + (F.col("r") - 2) * F.col("dir"))
            .join(at.withColumnRenamed("version", "passing_version"), ["package", "at"], "left").drop("at"))
    # scan mode: rank of the first failure met from the good version, by running counts
    by_rank = t.filter(F.col("fail_rank").isNotNull()).select(
        "package", F.col("fail_rank").alias("want"), F.col("idx").alias("fi"), F.col("version").alias("scan_failing_version"))
    scan = (usable.withColumn("want", F.when(F.col("dir") == 1, F.col("gcum") + 1).otherwise(F.col("gcum")))
            .join(by_rank, ["package", "want"], "left")
            .select(*RANGE, "scan_failing_version",
                    F.when(F.col("dir") == 1, (F.col("bcum") - F.col("gcum")) == (F.col("bi") - F.col("fi") + 1))
                    .otherwise((F.col("gcum") - F.col("bcum") + 1) == (F.col("fi") - F.col("bi") + 1)).alias("monotone")))
    done = done.join(scan, RANGE, "left").select(
        *RANGE, F.when(F.col("dir") == 1, "forward").otherwise("reverse").alias("direction"),
        "failing_version", "passing_version", F.col("probes").cast("bigint").alias("probes"),
        "monotone", "scan_failing_version")
    return (base.select(*RANGE, "reason", "good_env").join(done, RANGE, "left")
            .select(*RANGE, F.coalesce("reason", F.lit("ok")).alias("status"), "direction",
                    "failing_version", "passing_version", "probes", "monotone", "scan_failing_version", "good_env"))
