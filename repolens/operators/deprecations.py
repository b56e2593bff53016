"""Deprecation calls past their version (Q21).

Sources: ``package, path, content``; package versions: ``package, version``
(the latest tag of each package). The syntax-tree walk is the one step that
needs Python; it runs in ``mapInPandas`` over Arrow batches, after a native
``contains`` filter drops files without the word.
"""

from __future__ import annotations

import ast
import warnings

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from repolens.functions import versions as V

CALLS_SCHEMA = "package string, path string, line bigint, col bigint, version string, status string"


def _calls(text: str, name: str):
    """(line, col, first argument, status) of every call of the bare name ``name``; one row for a text that is no Python."""
    with warnings.catch_warnings():
        warnings.simplefilter("ignore", SyntaxWarning)
        try:
            tree = ast.parse(text)
        except (SyntaxError, ValueError, RecursionError):
            yield None, None, None, "unparsable"
            return
    for node in ast.walk(tree):
        if isinstance(node, ast.Call) and isinstance(node.func, ast.Name) and node.func.id == name:
            if node.args and isinstance(node.args[0], ast.Constant):
                yield node.lineno, node.col_offset, str(node.args[0].value), "ok"
            else:
                yield node.lineno, node.col_offset, None, "no constant"


def _scan(batches, name: str):
    for pdf in batches:
        rows = [(pkg, path, *call)
                for pkg, path, text in zip(pdf["package"], pdf["path"], pdf["content"], strict=True)
                for call in _calls(text, name)]
        found = pd.DataFrame(rows, columns=["package", "path", "line", "col", "version", "status"])
        yield found.astype({"line": "Int64", "col": "Int64"})


def deprecation_calls(sources: DataFrame, name: str = "deprecated") -> DataFrame:
    """Every call of the bare name ``deprecated`` (not an attribute), nested calls
    included, with line, column and the version given as first argument.

    ``status`` is ``ok``, ``no constant`` (the first argument is none) or
    ``unparsable`` (one row for the file)."""
    # a call of the bare name needs the word not preceded by '.' or a word
    # character: a necessary condition, checked natively before any parsing
    bare = r"(?<![\w.])" + name + r"\b"
    candidates = sources.filter(F.col("content").contains(name) & F.col("content").rlike(bare)) \
        .select("package", "path", "content")
    return candidates.mapInPandas(lambda it: _scan(it, name), CALLS_SCHEMA)


def overdue_deprecations(sources: DataFrame, package_versions: DataFrame) -> DataFrame:
    """Q21: calls with ``overdue`` = base version of the package >= the call's version.

    Nothing is left out: what cannot be judged has a ``status`` other than
    ``ok`` (``not a version`` beside those of deprecation_calls) and is not overdue.
    """
    calls = deprecation_calls(sources).withColumn("status", F.when(
        (F.col("status") == "ok") & ~F.coalesce(V.is_version("version"), F.lit(False)), "not a version").otherwise(F.col("status")))
    judged = F.when(F.col("status") == "ok", F.col("version"))
    calls = calls.withColumn("_given", F.col("version")).withColumn("version", judged)
    pv = package_versions.select("package", V.base_version("version").alias("base_version"))
    out = calls.join(pv, "package", "left")
    overdue = F.coalesce(V.version_key("base_version") >= V.version_key("version"), F.lit(False))
    return out.select("package", "path", "line", "col", F.coalesce(V.normalize_version("version"), "_given").alias("version"),
                      "base_version", overdue.alias("overdue"), "status")


def deprecation_summary(found: DataFrame) -> DataFrame:
    """Overdue count per package (replaces the exit status), and what could not be judged."""
    return found.groupBy("package").agg(F.count_if(F.col("status") == "ok").alias("calls"),
                                        F.count_if("overdue").alias("overdue"),
                                        F.count_if(F.col("status") != "ok").alias("undecided"))
