"""Sinks (K1-K4). Writes go to a target folder, never over the inputs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from repolens.operators.pages import insert_if_absent
from repolens.plans.session import ensure_checkpoint_dir
from repolens.sources.readers import _filesystem, read_file_listing, read_texts
from repolens.sources.texttree import write_texts

WINDOW = ["repo", "from_tag", "to_tag"]
STORED_SCHEMA = "repo string, filename string, kind string, content string"


def write_changelogs(docs: DataFrame, path: str) -> None:
    """K1: changelog texts, one folder per repository and window."""
    (docs.select(*WINDOW, F.col("changelog").alias("value"))
     .write.mode("overwrite").partitionBy(*WINDOW).text(path))


def write_changelog_lines(lines: DataFrame, path: str) -> None:
    """K1 for windows of any size: the line rows of ``changelog_lines`` written in document order.

    A range-partitioned sort splits a large window over several tasks; part
    files of one window folder are in order of their names.
    """
    from repolens.operators.changelog import ORDER

    ordered = lines.orderBy(*ORDER)
    (ordered.select(*WINDOW, F.col("line").alias("value"))
     .write.mode("overwrite").partitionBy(*WINDOW).text(path))


def write_changelog_parts(pieces: DataFrame, path: str, part_bytes: int = 8 << 20) -> DataFrame:
    """K1 as files of about ``part_bytes``: the pieces of ``changelog_pieces``, with a manifest of each window.

    A running sum over range partitions gives every piece its byte offset, and
    the offset its part, so a window of any size is cut into parts that are
    each assembled on their own. Files are ``<repo>/<from>..<to>/<part>.md``
    (names url-encoded) and appear when the job commits; the manifest
    (``repo, from_tag, to_tag, part, name, start, bytes``) is written beside
    them and returned.
    """
    from repolens.operators.changelog import ORDER
    from repolens.operators.running import Running, Tagged

    size = F.octet_length("text").cast("bigint")
    placed = Tagged(pieces, WINDOW, [c for c in ORDER if c not in WINDOW]).running(
        Running("sum", size, "start", inclusive=False)).done()
    parts = placed.groupBy(*WINDOW, F.expr(f"start div {part_bytes}").alias("part")).agg(
        F.min("start").alias("start"), F.sum(size).alias("bytes"), F.sort_array(F.collect_list(F.struct("start", "text"))).alias("p"))
    # pieces without text share their offset with the next one; the order among them cannot show
    name = F.concat(F.url_encode("repo"), F.lit("/"), F.url_encode("from_tag"), F.lit(".."), F.url_encode("to_tag"), F.lit("/"),
                    F.lpad(F.col("part").cast("string"), 12, "0"), F.lit(".md"))
    parts = parts.select(*WINDOW, "part", name.alias("name"), "start", "bytes",
                         F.array_join(F.transform("p", lambda x: x["text"]), "").alias("content")).checkpoint(eager=True)
    write_texts(parts, path)
    manifest = parts.drop("content")
    manifest.write.mode("overwrite").parquet(f"{path.rstrip('/')}/_manifest")
    return manifest


def read_changelog_parts(spark: SparkSession, path: str) -> DataFrame:
    """Parts by their manifest: ``repo, from_tag, to_tag, part, start, bytes, content, status``.

    ``status`` is ``ok``, ``missing`` or ``changed`` (another length than written).
    """
    manifest = spark.read.parquet(f"{path.rstrip('/')}/_manifest")
    texts = read_texts(spark, path, "*.md", root=path).select(F.col("path").alias("name"), "content")
    # names come back url-encoded once more in file URIs
    decoded = texts.withColumn("name", F.regexp_replace("name", "%25", "%"))
    status = (F.when(F.col("content").isNull(), "missing").when(F.octet_length("content") != F.col("bytes"), "changed").otherwise("ok"))
    return manifest.join(decoded, "name", "left").select(*WINDOW, "part", "start", "bytes", "content", status.alias("status"))


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """Files that ``write_documents`` stored: ``repo, filename, kind, content``."""
    return spark.read.schema(STORED_SCHEMA).parquet(path)


def write_documents(docs: DataFrame, path: str) -> DataFrame:
    """K2: store notebooks (``ipynb``) and scripts (``py``) that are not stored yet.

    Each kind is tested on its own, as ``(repo, filename, kind)``. Appends to a
    Parquet table partitioned by ``repo``; returns the files written. They are
    materialised (reliable checkpoint) before the append, so the returned table
    does not change when the stored table grows. Only a folder that does not
    exist counts as nothing stored.
    """
    import pyarrow.fs as pafs

    spark = docs.sparkSession
    ensure_checkpoint_dir(spark)
    files = docs.select("repo", "filename", F.explode(F.array(
        F.struct(F.lit("ipynb").alias("kind"), F.col("notebook").alias("content")),
        F.struct(F.lit("py").alias("kind"), F.col("script").alias("content")))).alias("f")).select(
        "repo", "filename", "f.kind", "f.content")
    fs, base = _filesystem(path)
    stored = fs.get_file_info(base).type != pafs.FileType.NotFound
    existing = read_documents(spark, path) if stored else files.limit(0)
    fresh = insert_if_absent(files, existing, ("repo", "filename", "kind")).checkpoint(eager=True)
    fresh.write.mode("append").partitionBy("repo").parquet(path)
    return fresh


def write_document_files(docs: DataFrame, path: str) -> DataFrame:
    """K2 as files: ``<repo>/<filename>.ipynb`` and ``.py`` below ``path``, those that are not there yet.

    What is there comes from a listing (names only). A document has one place,
    and all files of a job appear when it commits, so two writers at once store
    each document once: where both found it absent, the file of the later
    commit stands. Returns the new files (``name, content``), materialised
    before they are written.
    """
    spark = docs.sparkSession
    ensure_checkpoint_dir(spark)
    stem = F.concat("repo", F.lit("/"), "filename")
    files = docs.select(F.explode(F.array(
        F.struct(F.concat(stem, F.lit(".ipynb")).alias("name"), F.col("notebook").alias("content")),
        F.struct(F.concat(stem, F.lit(".py")).alias("name"), F.col("script").alias("content")))).alias("f")).select("f.*")
    stored = read_file_listing(spark, path, root=path, include_hidden=True).select(F.col("path").alias("name"))
    fresh = insert_if_absent(files, stored, ("name",)).checkpoint(eager=True)
    write_texts(fresh, path)
    return fresh


def write_rewrites(texts: DataFrame, changes: DataFrame, path: str, dry_run: bool = False,
                   keys: tuple[str, ...] = ()) -> DataFrame:
    """K3: each rewritten text as a file at its own path below ``path`` (and below its ``keys``, as folders).

    All files appear when the job commits, or none; two texts with one path end
    the job. A dry run only returns the change table.
    """
    if dry_run:
        return changes
    write_texts(texts.select(F.concat_ws("/", *keys, "path").alias("name"), F.col("new_text").alias("content")), path)
    return changes


def write_table(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "overwrite",
                partition_by: list[str] | None = None) -> None:
    """K4: any result table."""
    w = df.write.mode(mode).format(fmt)
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.save(path)
