"""Landed API pages: none is lost without a sign.

``load_pages`` reads pages with an explicit schema and judges each one: it must
parse and hold its payload (an error message served in place of a page parses,
but holds none). ``page_status`` lists what was judged bad, and what should be
there and is not: page numbers that are missing, a last page that announces
another one, and lists shorter than the total count that their pages report.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from repolens.plans.session import ensure_checkpoint_dir
from repolens.sources.files import filesystem

UNPARSED = "_unparsed"


def _judged(spark: SparkSession, path: str, schema: T.DataType, payload: str, multi_line: bool) -> tuple[DataFrame, Column]:
    """Pages with ``source_file``, and whether a page is bad.

    A struct schema is a page (a file, or a line of JSON Lines); ``payload`` is
    the field that it must hold. An array schema is a file with a JSON array,
    kept in order as ``doc``; ``payload`` is the field that each item must hold.
    """
    if isinstance(schema, T.ArrayType):
        text = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("source_file"), "value")
        docs = text.withColumn("doc", F.from_json("value", schema))
        lacks = F.exists("doc", lambda item: item[payload].isNull())
        return docs.withColumnRenamed("value", UNPARSED), F.col("doc").isNull() | lacks
    full = T.StructType([*schema.fields, T.StructField(UNPARSED, T.StringType())])
    pages = (spark.read.schema(full).option("multiLine", multi_line).option("columnNameOfCorruptRecord", UNPARSED)
             .json(path).withColumn("source_file", F.col("_metadata.file_path")))
    return pages, F.col(UNPARSED).isNotNull() | F.col(payload).isNull()


def _empty_files(pages: DataFrame, path: str) -> DataFrame:
    """Files without a byte, which file sources pass over.

    Below a folder whose file system tasks can list by themselves they come
    from that listing, no name on the driver. Elsewhere (patterns, paths of the
    session's default file system): names of Spark's file index that no listing
    with lengths has.
    """
    spark = pages.sparkSession
    if _listed_in_tasks(path):
        from repolens.sources.readers import walk

        below = F.regexp_replace("path", rf"^(file:/*(?=/))?\Q{re.sub('^file:/+', '/', path).rstrip('/')}\E", "")
        # files that Spark reads: names that are not hidden, in the folder itself or in folders of partitions
        read = ~below.rlike(r"/(\.|_(?![^/]*=))") & below.rlike(r"^/[^/]+$|/[^/]+=[^/]*/")
        empty = walk(spark, path).filter("length = 0").filter(read)
        return empty.select(F.regexp_replace("path", "^/", "file:/").alias("source_file"))
    names = [re.sub("^file:/+", "file:/", name) for name in pages.inputFiles()]
    listed = spark.read.format("binaryFile").load(path).select(F.col("path").alias("source_file"))
    return spark.createDataFrame([(n,) for n in names], "source_file string").join(listed, "source_file", "left_anti")


def _listed_in_tasks(path: str) -> bool:
    import pyarrow.fs as pafs

    if not re.match("(file:/|hdfs://)", path) or re.search(r"[*?\[\]{},\\]", path):
        return False
    fs, base = filesystem(path)
    return fs.get_file_info(base).type == pafs.FileType.Directory


def _checked(pages: DataFrame, bad: Column) -> DataFrame:
    """The same rows; a bad one ends the job with the name of its file.

    The random number keeps the check below every later filter: Spark would
    push an ``explode`` of the payload's null test into the scan, where it
    drops bad pages before they are judged.
    """
    whole = F.assert_true(~bad, F.concat(F.lit("not a whole page: "), F.col("source_file"))).isNull()
    row = F.struct(*[F.col(c) for c in pages.columns if c != UNPARSED])
    return pages.select(F.when((F.rand() >= 0) & whole, row).alias("page")).select("page.*")


def load_pages(spark: SparkSession, path: str, schema: T.DataType, payload: str, multi_line: bool = True,
               bad_pages: str = "raise") -> DataFrame:
    """Good pages with ``source_file``; a bad page ends the job by name, or is left out with ``bad_pages="skip"``.

    Files without a byte are looked for at once, when the reader is called.
    """
    if bad_pages not in ("raise", "skip"):
        raise ValueError("bad_pages is raise or skip")
    pages, bad = _judged(spark, path, schema, payload, multi_line)
    if bad_pages == "skip":
        return pages.filter(~bad).drop(UNPARSED)
    if multi_line:  # where lines are pages, a part file may have none
        empty = _empty_files(pages, path).head(1)
        if empty:
            raise ValueError(f"not a whole page: {empty[0].source_file}")
    return _checked(pages, bad)


def page_status(spark: SparkSession, path: str, schema: T.DataType, payload: str, multi_line: bool = True,
                listing: str | None = None, page: str | None = None, first_page: int = 0, page_size: int | None = None,
                more: str | None = None, total: str | None = None) -> DataFrame:
    """``listing, page, status, rows, source_file, text`` of landed pages, and of pages that are not there.

    ``listing`` and ``page`` are patterns (first group) on the file path: the
    list that a page belongs to and its number from ``first_page``. Statuses:

    * ``ok``; ``unparsed`` (with its text) for a page that does not parse;
      ``no payload`` for one that parses but holds none; ``empty file``;
    * ``missing``: a number below the highest of its list without a file;
    * ``unfinished``: the last page says that there are more (``more``, a
      boolean field), or is as long as ``page_size``;
    * ``short``: all good pages of the list hold fewer rows than the highest
      ``total`` field (``rows`` is what is missing; page is null).

    Every page is read once (one row per page is materialised); the rest are
    partial aggregations and an anti-join over page numbers.
    """
    pages, bad = _judged(spark, path, schema, payload, multi_line)
    array = isinstance(schema, T.ArrayType)
    held = F.size("doc") if array else F.size(payload) if _is_array(schema, payload) else F.lit(1)
    parsed = F.col("doc").isNotNull() if array else F.col(UNPARSED).isNull()
    judged = pages.select(
        "source_file", F.when(~bad, "ok").when(parsed, "no payload").otherwise("unparsed").alias("status"),
        F.when(~bad, held).otherwise(0).cast("bigint").alias("rows"), F.when(bad & ~parsed, F.col(UNPARSED)).alias("text"),
        (F.col(more) if more else F.lit(None)).cast("boolean").alias("more"),
        (F.col(total) if total else F.lit(None)).cast("bigint").alias("total"))
    if multi_line:
        judged = judged.filter(~(F.coalesce("text", F.lit("x")) == "")).unionByName(_empty_files(pages, path).select(
            "source_file", F.lit("empty file").alias("status"), F.lit(0).cast("bigint").alias("rows"),
            F.lit(None).cast("string").alias("text"), F.lit(None).cast("boolean").alias("more"),
            F.lit(None).cast("bigint").alias("total")))
    of = F.regexp_extract("source_file", listing, 1) if listing else F.lit("")
    number = F.regexp_extract("source_file", page, 1).try_cast("bigint") if page else F.lit(None).cast("bigint")
    ensure_checkpoint_dir(spark)
    judged = judged.withColumn("listing", of).withColumn("page", number).checkpoint(eager=True)
    out = judged.select("listing", "page", "status", "rows", "source_file", "text")
    if page:
        last = judged.groupBy("listing").agg(
            F.max("page").alias("last"), F.max_by("more", "page").alias("more"), F.max_by("rows", "page").alias("held"),
            F.max_by("status", "page").alias("status"))
        wanted = last.select("listing", F.explode(F.sequence(F.lit(first_page).cast("bigint"), F.col("last"))).alias("page"))
        missing = wanted.join(judged.select("listing", "page"), ["listing", "page"], "left_anti")
        out = out.unionByName(_named(missing, "missing", F.col("page"), F.lit(0)))
        full = F.col("held") >= page_size if page_size else F.lit(False)
        open_end = last.filter((F.col("status") == "ok") & F.coalesce("more", full))
        out = out.unionByName(_named(open_end, "unfinished", F.col("last"), F.col("held")))
    if total:
        sums = judged.groupBy("listing").agg(F.sum("rows").alias("found"), F.max("total").alias("total"))
        short = sums.filter("found < total")
        out = out.unionByName(_named(short, "short", F.lit(None), F.col("total") - F.col("found")))
    return out


def _named(rows: DataFrame, status: str, page: Column, count: Column) -> DataFrame:
    return rows.select("listing", page.cast("bigint").alias("page"), F.lit(status).alias("status"),
                       count.cast("bigint").alias("rows"), F.lit(None).cast("string").alias("source_file"),
                       F.lit(None).cast("string").alias("text"))


def _is_array(schema: T.StructType, field: str) -> bool:
    kind: T.DataType = schema
    for part in field.split("."):
        kind = kind[part].dataType
    return isinstance(kind, T.ArrayType)
