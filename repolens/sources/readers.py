"""Readers for landed API payloads, archives, lock files, texts and listings.

Every reader takes an explicit schema (no inference pass over the data), and
returns flat rows with the repository / run / package as key columns, so one
scan covers many repositories. Paths may be folders or globs. A landed page
that does not parse or lacks its payload ends the job with its file name;
``bad_pages="skip"`` leaves such pages out, and ``landed.page_status`` lists
them, together with pages that are missing.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from repolens.plans.session import ensure_checkpoint_dir
from repolens.sources.archives import ENDINGS, ArchiveMembers
from repolens.sources.files import filesystem as _filesystem
from repolens.sources.landed import load_pages

S = T.StringType()
L = T.LongType()
B = T.BooleanType()


def utc_ntz(c) -> "F.Column":
    """ISO-8601 text from an API (``...Z`` or ``+00:00``) as UTC wall-clock ``timestamp_ntz``.

    Other offsets are converted through the instant (``to_timestamp``) and
    then to UTC wall-clock time, so the result never depends on the session
    time zone.
    """
    c = F.col(c) if isinstance(c, str) else c
    utc = c.rlike(r"(Z|[+-]00:?00)$")
    plain = F.to_timestamp_ntz(F.regexp_replace(c, r"(Z|[+-]00:?00)$", ""))
    other = F.to_utc_timestamp(F.to_timestamp(c), F.current_timezone()).cast("timestamp_ntz")
    return F.when(c.isNull(), F.lit(None).cast("timestamp_ntz")).when(utc, plain).otherwise(other)


# ---------------------------------------------------------------- S1, S2


PR_SCHEMA = T.StructType([
    T.StructField("repo", S),
    T.StructField("data", T.StructType([T.StructField("search", T.StructType([
        T.StructField("nodes", T.ArrayType(T.StructType([
            T.StructField("number", L), T.StructField("title", S),
            T.StructField("author", T.StructType([T.StructField("login", S)])),
            T.StructField("mergedAt", S)]))),
        T.StructField("pageInfo", T.StructType([T.StructField("hasNextPage", B), T.StructField("endCursor", S)]))]))])),
])


def read_pull_requests(spark: SparkSession, path: str, multi_line: bool = True, repo_pattern: str | None = None,
                       bad_pages: str = "raise") -> DataFrame:
    """Merged changes from landed search pages (all pages are one scan).

    Output ``repo, number, title, author, merged_at``; a missing author reads
    ``unknown``. Served payloads do not name the repository: ``repo_pattern``
    (first group) reads it from the file path where the page has none.
    """
    df = load_pages(spark, path, PR_SCHEMA, "data.search.nodes", multi_line, bad_pages)
    of_path = F.regexp_extract("source_file", repo_pattern, 1) if repo_pattern else F.lit(None).cast("string")
    nodes = df.select(F.coalesce("repo", of_path).alias("repo"), F.explode("data.search.nodes").alias("n"))
    return nodes.select("repo", F.col("n.number").alias("number"), F.col("n.title").alias("title"),
                        F.coalesce("n.author.login", F.lit("unknown")).alias("author"),
                        utc_ntz("n.mergedAt").alias("merged_at"))


RELEASE_ITEM = T.StructType([T.StructField("tag_name", S), T.StructField("prerelease", B),
                             T.StructField("target_commitish", S), T.StructField("created_at", S)])


def read_releases(spark: SparkSession, path: str, repo_pattern: str = r"([^/]+)\.json$",
                  page_pattern: str | None = None, page_size: int = 100, bad_pages: str = "raise") -> DataFrame:
    """Releases per repository, ``api_order`` 0 = newest, ``prerelease`` kept.

    Each landed file is one API page (a JSON array); the repository comes from
    the file path (``repo_pattern``, first group). With ``page_pattern`` the
    page number (from 0) is read from the path too, and ``api_order`` runs on
    across pages of ``page_size``.
    """
    docs = load_pages(spark, path, T.ArrayType(RELEASE_ITEM), "tag_name", bad_pages=bad_pages)
    page = F.regexp_extract("source_file", page_pattern, 1).cast("bigint") if page_pattern else F.lit(0).cast("bigint")
    rows = docs.select(F.regexp_extract("source_file", repo_pattern, 1).alias("repo"), page.alias("page"),
                       F.posexplode("doc").alias("pos", "r"))
    return rows.select("repo", (F.col("page") * page_size + F.col("pos")).cast("bigint").alias("api_order"),
                       F.col("r.tag_name").alias("tag"),
                       F.coalesce("r.prerelease", F.lit(False)).alias("prerelease"),
                       utc_ntz("r.created_at").alias("created_at"))


# ---------------------------------------------------------------- S3, S4

RUN_ITEM = T.StructType([
    T.StructField("id", L), T.StructField("run_number", L), T.StructField("name", S),
    T.StructField("head_branch", S), T.StructField("display_title", S), T.StructField("status", S),
    T.StructField("conclusion", S), T.StructField("created_at", S), T.StructField("run_started_at", S),
    T.StructField("url", S), T.StructField("path", S),
    T.StructField("run_attempt", L), T.StructField("updated_at", S),
    T.StructField("triggering_actor", T.StructType([T.StructField("login", S)])),
    T.StructField("repository", T.StructType([T.StructField("full_name", S), T.StructField("name", S)])),
])
RUNS_SCHEMA = T.StructType([T.StructField("total_count", L),
                            T.StructField("workflow_runs", T.ArrayType(RUN_ITEM))])


def read_runs(spark: SparkSession, path: str, multi_line: bool = True, bad_pages: str = "raise") -> DataFrame:
    """S3: workflow runs of many repositories; repository and workflow file from the payload."""
    df = load_pages(spark, path, RUNS_SCHEMA, "workflow_runs", multi_line, bad_pages)
    r = df.select(F.explode("workflow_runs").alias("r"))
    return r.select(
        F.col("r.repository.name").alias("repo"), F.col("r.run_number").alias("run_number"),
        F.col("r.name").alias("name"), F.col("r.head_branch").alias("head_branch"),
        F.col("r.display_title").alias("display_title"), F.col("r.status").alias("status"),
        F.col("r.conclusion").alias("conclusion"), utc_ntz("r.created_at").alias("created_at"),
        utc_ntz("r.run_started_at").alias("run_started_at"), F.col("r.url").alias("url"),
        F.col("r.triggering_actor.login").alias("actor"),
        F.regexp_extract("r.path", r"([^/@]+)(@.*)?$", 1).alias("workflow_file"))


ARTIFACTS_SCHEMA = T.StructType([
    T.StructField("run_number", L),
    T.StructField("artifacts", T.ArrayType(T.StructType([
        T.StructField("name", S), T.StructField("archive_download_url", S)])))])


def read_artifacts(spark: SparkSession, path: str, multi_line: bool = True, run_pattern: str | None = None,
                   page_pattern: str | None = None, page_size: int = 100, bad_pages: str = "raise") -> DataFrame:
    """Artifact lists of runs, with their position in the list.

    Served payloads name neither run nor page: ``run_pattern`` and
    ``page_pattern`` (first group) read them from the file path, and positions
    run on across pages (from 0) of ``page_size``.
    """
    df = load_pages(spark, path, ARTIFACTS_SCHEMA, "artifacts", multi_line, bad_pages)
    file = F.col("source_file")
    run = F.regexp_extract(file, run_pattern, 1).try_cast("bigint") if run_pattern else F.lit(None).cast("bigint")
    page = F.regexp_extract(file, page_pattern, 1).cast("bigint") if page_pattern else F.lit(0).cast("bigint")
    a = df.select(F.coalesce("run_number", run).alias("run_number"), page.alias("page"),
                  F.posexplode("artifacts").alias("pos", "a"))
    return a.select("run_number", "a.name", "a.archive_download_url",
                    (F.col("page") * page_size + F.col("pos")).cast("bigint").alias("position"))


# ---------------------------------------------------------------- S5

def read_archive_members(spark: SparkSession, path: str, glob: str | None = None, bad_archives: str = "raise",
                         partition_bytes: int = 128 << 20) -> DataFrame:
    """``path, archive, format, member, status`` of wheels, source archives, conda and npm packages, also inside zips.

    An archive that cannot be read ends the job with its name; with
    ``bad_archives="status"`` it is a row without member whose status says why.
    """
    if bad_archives not in ("raise", "status"):
        raise ValueError("bad_archives is raise or status")
    spark.dataSource.register(ArchiveMembers)
    rows = spark.read.format("archive_members").option("path", path).option("glob", glob or "*").option(
        "partitionBytes", partition_bytes).load()
    if bad_archives == "status":
        return rows
    whole = F.assert_true(F.col("status") == "ok", F.concat(F.lit("not a whole archive: "), F.col("path"))).isNull()
    return rows.select(F.when((F.rand() >= 0) & whole, F.struct(*rows.columns)).alias("r")).select("r.*")


def read_archive_names(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    """``path, archive, format`` of the archives in a folder; none is opened."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True)
    if glob:
        files = files.option("pathGlobFilter", glob)
    name = F.element_at(F.split("path", "/"), -1)
    kind = F.lit(None).cast("string")
    for ending, fmt in ENDINGS.items():
        kind = F.coalesce(kind, F.when(name.endswith(ending), fmt))
    return files.load(path).select("path", name.alias("archive"), kind.alias("format")).filter(F.col("format").isNotNull())


# ---------------------------------------------------------------- S6

LOCK_SCHEMA = "source_file string, env string, arch string, url string"


def _locks(batches):
    import yaml

    loader = getattr(yaml, "CSafeLoader", yaml.SafeLoader)
    for pdf in batches:
        rows = []
        for src, head in zip(pdf["source_file"], pdf["head"], strict=True):
            doc = yaml.load(head, Loader=loader) or {}
            for env, spec in (doc.get("environments") or {}).items():
                for arch, items in ((spec or {}).get("packages") or {}).items():
                    for item in items or []:
                        if isinstance(item, dict) and item:
                            rows.append((src, env, arch, str(next(iter(item.values())))))
        yield pd.DataFrame(rows, columns=["source_file", "env", "arch", "url"])


def read_locks(spark: SparkSession, path: str) -> DataFrame:
    """Lock files flattened to ``env, arch, url``.

    Only the text before ``\\npackages:`` is parsed (cut natively, before the
    Python step); the url is the first value of each one-entry map.
    """
    text = spark.read.text(path, wholetext=True).select(
        F.col("_metadata.file_path").alias("source_file"),
        F.substring_index("value", "\npackages:", 1).alias("head"))
    return text.mapInPandas(_locks, LOCK_SCHEMA)


# ---------------------------------------------------------------- S7, S8

INDEX_SCHEMA = T.StructType([
    T.StructField("name", S),
    T.StructField("files", T.ArrayType(T.StructType([
        T.StructField("filename", S), T.StructField("upload-time", S),
        T.StructField("requires-python", S), T.StructField("yanked", S)])))])


def read_index_files(spark: SparkSession, path: str, multi_line: bool = True, bad_pages: str = "raise") -> DataFrame:
    """Package index file lists -> ``package, filename, requires_python, upload_time``."""
    df = load_pages(spark, path, INDEX_SCHEMA, "files", multi_line, bad_pages)
    f = df.select(F.col("name").alias("package"), F.explode("files").alias("f"))
    return f.select("package", F.col("f.filename").alias("filename"),
                    F.col("f.`requires-python`").alias("requires_python"),
                    utc_ntz(F.col("f.`upload-time`")).alias("upload_time"))


META_SCHEMA = T.StructType([T.StructField("info", T.StructType([
    T.StructField("name", S), T.StructField("requires_dist", T.ArrayType(S)),
    T.StructField("requires_python", S)]))])
PROJECT_SCHEMA = T.StructType([
    T.StructField("name", S),
    T.StructField("dependencies", T.MapType(S, S)),
    T.StructField("feature", T.MapType(S, T.StructType([T.StructField("dependencies", T.MapType(S, S))])))])


def read_requirements(spark: SparkSession, path: str, kind: str = "index", multi_line: bool = True, bad_pages: str = "raise") -> DataFrame:
    """Dependency declarations -> ``main_package, requirement``.

    ``index``: package metadata (``info.requires_dist``). ``project``: project
    files landed as JSON: top-level and per-feature dependency keys.
    """
    if kind == "index":
        df = load_pages(spark, path, META_SCHEMA, "info", multi_line, bad_pages)
        return df.select(F.col("info.name").alias("main_package"),
                         F.explode("info.requires_dist").alias("requirement"))
    df = load_pages(spark, path, PROJECT_SCHEMA, "name", multi_line, bad_pages)
    top = df.select(F.col("name").alias("main_package"), F.explode(F.map_keys("dependencies")).alias("requirement"))
    feat = df.select(F.col("name").alias("main_package"), F.explode("feature").alias("feature", "f")) \
        .select("main_package", F.explode(F.map_keys("f.dependencies")).alias("requirement"))
    return top.unionByName(feat).distinct()


def read_project_features(spark: SparkSession, path: str, bad_pages: str = "raise") -> DataFrame:
    """Feature names of project files (``py3NN`` keys feed V23)."""
    df = load_pages(spark, path, PROJECT_SCHEMA, "name", True, bad_pages)
    return df.select(F.col("name").alias("main_package"), F.explode(F.map_keys("feature")).alias("feature"))


# ---------------------------------------------------------------- S9, S10


def _below(path, root: str):
    """A path without the folder ``root`` before it (either may name the local scheme)."""
    plain = re.sub("^file:/+", "/", root).rstrip("/")
    return F.regexp_replace(path, rf"^(file:/*(?=/))?\Q{plain}\E/", "")


def _read_texts(batches):
    for pdf in batches:
        out = []
        for path in pdf["path"]:
            fs, base = _filesystem(path)
            with fs.open_input_stream(base, compression=None) as f:
                out.append((path, f.read().decode("utf-8", errors="replace")))
        yield pd.DataFrame(out, columns=["path", "content"])


def read_texts(spark: SparkSession, path: str, glob: str = "*.py", root: str | None = None,
               include_hidden: bool = False) -> DataFrame:
    """Whole source or workflow texts ``path, content`` (one row per file).

    ``include_hidden`` also finds files below ``_``/``.`` folders (such as
    ``.github/workflows``), listing and reading them inside tasks.
    """
    p = F.col("path")
    if root:
        p = _below(p, root)
    if include_hidden:
        import fnmatch

        rx = fnmatch.translate(glob)  # (?s:...)\Z is valid in Java regex too
        listing = read_file_listing(spark, path, include_hidden=True)
        wanted = listing.filter(F.element_at(F.split("path", "/"), -1).rlike(rx)).select("path")
        # a listing has a task per folder; files are read by all tasks, whatever folder they are in
        wanted = wanted.repartition(spark.sparkContext.defaultParallelism * 4, "path")
        return wanted.mapInPandas(_read_texts, "path string, content string").select(p.alias("path"), "content")
    df = (spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", glob)
          .text(path, wholetext=True))
    return df.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("content")) \
        .select(p.alias("path"), "content")


LISTING_SCHEMA = "path string, mtime timestamp_ntz, length bigint"
#: Entries of a folder that leave a task at a time.
LISTED = 100_000


def _list_folders(batches):
    """Entries of each folder, one level deep; a folder that is gone has none."""
    import pyarrow.fs as pafs

    for pdf in batches:
        for uri in pdf["folder"]:
            fs, base = _filesystem(uri)
            scheme = uri[: len(uri) - len(base)] if "://" in uri else ""
            entries = fs.get_file_info(pafs.FileSelector(base, recursive=False, allow_not_found=True))
            for at in range(0, len(entries), LISTED):  # a folder of any size leaves in bounded batches
                rows = [(scheme + e.path, e.mtime.replace(tzinfo=None) if e.mtime is not None else None, e.size,
                         e.type == pafs.FileType.Directory) for e in entries[at:at + LISTED]]
                yield pd.DataFrame(rows, columns=["path", "mtime", "length", "folder"])


def walk(spark: SparkSession, path: str) -> DataFrame:
    """``path, mtime, length`` of every file below ``path``, hidden ones too, level by level.

    The folders of a level are a DataFrame, dealt over all tasks; a level is
    materialised once and gives the files and the folders of the next. The
    driver sees how many folders a level has, never a name.
    """
    ensure_checkpoint_dir(spark)
    folders = spark.createDataFrame([(path.rstrip("/") or "/",)], "folder string")
    files = spark.createDataFrame([], LISTING_SCHEMA)
    while True:
        level = folders.mapInPandas(_list_folders, LISTING_SCHEMA + ", folder boolean").checkpoint(eager=True)
        files = files.unionByName(level.filter("NOT folder").drop("folder"))
        below = level.filter("folder").select(F.col("path").alias("folder"))
        found = below.count()
        if not found:
            return files
        folders = below.repartition(max(1, min(found, spark.sparkContext.defaultParallelism * 4)))


def read_file_listing(spark: SparkSession, path: str, root: str | None = None,
                      include_hidden: bool = False) -> DataFrame:
    """``path, mtime, length`` of every file below ``path``; contents are never read.

    Spark's file sources skip names starting with ``_`` or ``.``; with
    ``include_hidden`` such entries are listed too (``__pycache__``,
    ``.ipynb_checkpoints``), by ``walk`` (local, HDFS or object stores). Times
    are UTC wall-clock.
    """
    if include_hidden:
        df = walk(spark, path)
    else:
        df = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select(
            "path", F.to_utc_timestamp("modificationTime", F.current_timezone()).cast("timestamp_ntz").alias("mtime"),
            "length")
    p = F.col("path")
    if root:
        p = _below(p, root)
    return df.select(p.alias("path"), "mtime", "length")


# ---------------------------------------------------------------- S11, S12, S13

FORUM_SCHEMA = T.StructType([
    T.StructField("id", L), T.StructField("title", S),
    T.StructField("post_stream", T.StructType([T.StructField("posts", T.ArrayType(T.StructType([
        T.StructField("id", L), T.StructField("cooked", S)])))]))])


def read_pages(spark: SparkSession, path: str, kind: str = "issue", bad_pages: str = "raise") -> DataFrame:
    """Issue pages (``url, html`` as parquet) or forum threads (JSON, one row per post).

    ``post`` orders the posts of a thread over all its pages: the post's id, or
    its place where it has none.
    """
    if kind == "issue":
        return spark.read.parquet(path).select("url", "html")
    df = load_pages(spark, path, FORUM_SCHEMA, "post_stream.posts", True, bad_pages)
    posts = df.select(F.col("id").alias("number"), "title", F.posexplode("post_stream.posts").alias("post", "p"))
    return posts.select(F.concat(F.lit("thread/"), F.col("number").cast("string")).alias("url"),
                        "title", "number", F.coalesce("p.id", F.col("post").cast("bigint")).alias("post"),
                        F.col("p.cooked").alias("html"))


VERSIONS_SCHEMA = T.StructType([T.StructField("result", T.StructType([T.StructField("pkgs", T.ArrayType(
    T.StructType([T.StructField("name", S), T.StructField("version", S)])))]))])


def read_versions(spark: SparkSession, path: str, multi_line: bool = True, bad_pages: str = "raise") -> DataFrame:
    """Distinct ``package, version`` of a package catalogue."""
    df = load_pages(spark, path, VERSIONS_SCHEMA, "result.pkgs", multi_line, bad_pages)
    return df.select(F.explode("result.pkgs").alias("p")).select(
        F.col("p.name").alias("package"), F.col("p.version").alias("version")).distinct()


MANIFEST_SCHEMA = T.StructType([T.StructField("milestones", T.MapType(S, T.StructType([
    T.StructField("downloads", T.MapType(S, T.ArrayType(T.StructType([
        T.StructField("platform", S), T.StructField("url", S)]))))])))])


def read_manifest(spark: SparkSession, path: str, multi_line: bool = True, bad_pages: str = "raise") -> DataFrame:
    """Download manifests (milestone -> product -> platform list), nested as landed."""
    return load_pages(spark, path, MANIFEST_SCHEMA, "milestones", multi_line, bad_pages).select("milestones")


# ---------------------------------------------------------------- inputs of Q1, Q23-Q25 and Q28

REF_SCHEMA = T.StructType([T.StructField("ref", S), T.StructField("url", S),
                           T.StructField("object", T.StructType([T.StructField("sha", S), T.StructField("type", S)]))])
TAG_OBJECT_SCHEMA = T.StructType([T.StructField("sha", S), T.StructField("url", S),
                                  T.StructField("object", T.StructType([T.StructField("sha", S)]))])
NAME_ITEM = T.StructType([T.StructField("name", S), T.StructField("commit", T.StructType([T.StructField("sha", S)]))])
REPO_OF_URL = "/repos/([^/]+/[^/]+)/"


def read_ref_names(spark: SparkSession, path: str, repo_pattern: str, kind_pattern: str,
                   bad_pages: str = "raise") -> DataFrame:
    """Landed pages of tag or branch lists (JSON arrays): ``repo, kind, name, commit_sha``.

    Repository and list (``tags`` or ``branches``) come from the file path
    (first group of each pattern). All pages count.
    """
    docs = load_pages(spark, path, T.ArrayType(NAME_ITEM), "name", bad_pages=bad_pages)
    rows = docs.select("source_file", F.explode("doc").alias("n"))
    kind = F.when(F.regexp_extract("source_file", kind_pattern, 1).startswith("tag"), "tag").otherwise("branch")
    return rows.select(F.regexp_extract("source_file", repo_pattern, 1).alias("repo"), kind.alias("kind"), "n.name",
                       F.col("n.commit.sha").alias("commit_sha"))


def read_ref_objects(spark: SparkSession, path: str, multi_line: bool = True, bad_pages: str = "raise") -> DataFrame:
    """Landed git references: ``repo, kind, name, commit_sha`` (of an annotated tag: the sha of its tag object)."""
    r = load_pages(spark, path, REF_SCHEMA, "object.sha", multi_line, bad_pages).filter(F.col("ref").rlike("^refs/(tags|heads)/"))
    return r.select(F.regexp_extract("url", REPO_OF_URL, 1).alias("repo"),
                    F.when(F.col("ref").startswith("refs/tags/"), "tag").otherwise("branch").alias("kind"),
                    F.regexp_replace("ref", "^refs/(tags|heads)/", "").alias("name"),
                    F.col("object.sha").alias("commit_sha"))


def read_tag_objects(spark: SparkSession, path: str, multi_line: bool = True, bad_pages: str = "raise") -> DataFrame:
    """Landed annotated tags: ``repo, tag_sha, target_sha``."""
    return load_pages(spark, path, TAG_OBJECT_SCHEMA, "object.sha", multi_line, bad_pages).select(
        F.regexp_extract("url", REPO_OF_URL, 1).alias("repo"), F.col("sha").alias("tag_sha"),
        F.col("object.sha").alias("target_sha"))


COMMIT_SCHEMA = T.StructType([T.StructField("data", T.StructType([T.StructField("repository", T.StructType([
    T.StructField("object", T.StructType([
        T.StructField("committedDate", S),
        T.StructField("associatedPullRequests", T.StructType([
            T.StructField("nodes", T.ArrayType(T.StructType([T.StructField("mergedAt", S)])))]))]))]))]))])


def read_commit_dates(spark: SparkSession, path: str, repo_pattern: str, sha_pattern: str,
                      multi_line: bool = True, bad_pages: str = "raise") -> DataFrame:
    """Landed commits: ``repo, sha, committed_at, pr_merged_at`` (of the first change request, else null).

    Payloads name neither repository nor commit; both come from the file path.
    """
    df = load_pages(spark, path, COMMIT_SCHEMA, "data.repository.object", multi_line, bad_pages)
    file, commit = F.col("source_file"), "data.repository.object"
    return df.select(F.regexp_extract(file, repo_pattern, 1).alias("repo"),
                     F.regexp_extract(file, sha_pattern, 1).alias("sha"),
                     utc_ntz(f"{commit}.committedDate").alias("committed_at"),
                     utc_ntz(F.get(F.col(f"{commit}.associatedPullRequests.nodes.mergedAt"), F.lit(0))).alias("pr_merged_at"))


ISSUE_SCHEMA = T.StructType([T.StructField("number", L), T.StructField("state", S), T.StructField("repository_url", S)])


def read_issue_states(spark: SparkSession, path: str, multi_line: bool = True, bad_pages: str = "raise") -> DataFrame:
    """Landed issues: ``repo, number, state``."""
    return load_pages(spark, path, ISSUE_SCHEMA, "state", multi_line, bad_pages).select(
        F.element_at(F.split("repository_url", "/"), -1).alias("repo"), "number", "state")
