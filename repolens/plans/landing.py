"""Land fixture rows as API-shaped JSON pages, so readers run on data Spark derives from the tables.

Pages are bounded: rows are grouped by a key plus a page number taken from a
row id (at most ``size`` rows per page), so no key is collected into one
document. Pages go to a fresh folder under the session's checkpoint folder
(the shared folder on a cluster), written as JSON Lines.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from repolens.plans.session import ensure_checkpoint_dir

ISO = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'"


def landing_folder(spark, name: str) -> str:
    base = ensure_checkpoint_dir(spark).rstrip("/")
    return f"{base}/landed/{name}-{uuid.uuid4().hex}"


def _page(size: int, by: Column | None = None) -> Column:
    """Page number: from a unique number when given, else from the row id within its partition."""
    if by is not None:
        return F.floor(by / size)
    return F.floor(F.monotonically_increasing_id() / size)


def _write(df: DataFrame, name: str) -> str:
    path = landing_folder(df.sparkSession, name)
    df.write.mode("overwrite").json(path)
    return path


def land_pull_requests(prs: DataFrame) -> str:
    """S1 shape: ``{repo, data: {search: {nodes: [...]}}}``, 100 nodes per page."""
    node = F.struct("number", "title", F.struct(F.col("author").alias("login")).alias("author"),
                    F.date_format("merged_at", ISO).alias("mergedAt"))
    pages = prs.withColumn("page", _page(100, F.col("number"))).groupBy("repo", "page").agg(
        F.collect_list(node).alias("nodes"))
    out = pages.select("repo", F.struct(F.struct("nodes").alias("search")).alias("data"))
    return _write(out, "pull_requests")


def land_runs(runs: DataFrame) -> str:
    """S3 shape: ``{total_count, workflow_runs: [...]}``, 30 runs per page."""
    run = F.struct(
        "run_number", "name", "head_branch", "display_title", "status", "conclusion",
        F.date_format("run_started_at", ISO).alias("created_at"),
        F.date_format("run_started_at", ISO).alias("run_started_at"),
        F.concat(F.lit("https://api.github.com/repos/org/"), "repo", F.lit("/actions/runs/"),
                 F.col("run_number").cast("string")).alias("url"),
        F.concat(F.lit(".github/workflows/"), "name", F.lit(".yaml")).alias("path"),
        F.struct(F.col("actor").alias("login")).alias("triggering_actor"),
        F.struct(F.col("repo").alias("name"), F.concat(F.lit("org/"), "repo").alias("full_name")).alias("repository"))
    pages = runs.withColumn("page", _page(30, F.col("run_number"))).groupBy("repo", "page").agg(
        F.count("*").alias("total_count"), F.collect_list(run).alias("workflow_runs"))
    return _write(pages.select("total_count", "workflow_runs"), "workflow_runs")


def land_poll(runs: DataFrame, poll: int, path: str, page_size: int = 30) -> None:
    """S3 pages of one poll (0, 1 or 2) of all runs, a line per page, appended to the folder ``path``.

    A run is queued, then in progress, then has its own status; one whose number
    divides by 5 had finished at poll 0 and is queued again as its second
    attempt at poll 1. Runs whose number divides by 11 are not on the last poll.
    """
    again = F.col("run_number") % 5 == 0
    status = (F.when(again, "completed").otherwise("queued"), F.when(again, "queued").otherwise("in_progress"), F.col("status"))[poll]
    attempt = F.when(again & F.lit(poll > 0), 2).otherwise(1).cast("bigint")
    run = F.struct(
        "run_number", "name", "head_branch", "display_title", status.alias("status"), attempt.alias("run_attempt"),
        F.date_format("run_started_at", ISO).alias("run_started_at"),
        F.date_format(F.expr(f"run_started_at + INTERVAL {poll} MINUTES"), ISO).alias("updated_at"),
        F.struct(F.col("actor").alias("login")).alias("triggering_actor"), F.struct(F.col("repo").alias("name")).alias("repository"))
    seen = runs.filter("run_number % 11 <> 0") if poll == 2 else runs
    pages = seen.groupBy("repo", F.floor(F.col("run_number") / page_size).alias("page")).agg(
        F.count("*").alias("total_count"), F.collect_list(run).alias("workflow_runs"))
    pages.select("total_count", "workflow_runs").write.mode("append").json(path)


def land_damaged_runs(runs: DataFrame, page_size: int = 30) -> str:
    """S3 pages as files ``repo=<repo>/<thousand>/page=<n>.json``, some cut in half and some never written.

    Each page reports the number of runs of its repository. With d = (7 * page +
    length of the repository's name) modulo 5, a page is cut where d is 1 and
    missing where d is 2. A folder holds up to a thousand pages, so writing and
    listing them costs no folder per page; tasks write them.
    """
    from repolens.operators.ordinal import ordinal_within
    from repolens.sources.texttree import write_texts

    ranked = ordinal_within(runs.select("repo", "run_number", "status"), ["repo"], ["run_number", "status"], name="_rank")
    total = ranked.groupBy("repo").agg(F.count("*").alias("total_count"))
    run = F.struct("run_number", "status", F.struct(F.col("repo").alias("name")).alias("repository"))
    pages = ranked.withColumn("page", F.floor((F.col("_rank") - 1) / page_size)).groupBy("repo", "page").agg(
        F.collect_list(run).alias("workflow_runs")).join(total, "repo")
    damage = (F.col("page") * 7 + F.length("repo")) % 5
    text = F.to_json(F.struct("total_count", "workflow_runs"))
    name = F.concat(F.lit("repo="), "repo", F.lit("/"), F.expr("page div 1000"), F.lit("/page="), "page", F.lit(".json"))
    path = landing_folder(runs.sparkSession, "damaged_runs")
    written = pages.select(name.alias("name"), damage.alias("damage"), text.alias("text")).filter("damage <> 2")
    write_texts(written.select("name", F.expr(
        "if(damage = 1, substring(text, 1, length(text) div 2), text)").alias("content")), path)
    return path


def land_artifacts(artifacts: DataFrame) -> str:
    """S4 shape: ``{run_number, artifacts: [...]}`` in list order, 100 artifacts per page."""
    docs = artifacts.withColumn("page", _page(100, F.col("position"))).groupBy("run_number", "page").agg(
        F.sort_array(F.collect_list(F.struct("position", "name", "archive_download_url"))).alias("a"))
    out = docs.select("run_number", F.transform("a", lambda x: F.struct(
        x["name"].alias("name"), x["archive_download_url"].alias("archive_download_url"))).alias("artifacts"))
    return _write(out, "artifacts")


def land_index_files(files: DataFrame) -> str:
    """S7 shape: ``{name, files: [{filename, upload-time, requires-python}]}``, 1000 files per page."""
    f = F.struct("filename", F.date_format("upload_time", ISO).alias("upload-time"),
                 F.col("requires_python").alias("requires-python"))
    pages = files.withColumn("page", _page(1000)).groupBy("package", "page").agg(F.collect_list(f).alias("files"))
    return _write(pages.select(F.col("package").alias("name"), "files"), "index_files")


def land_requirements(requirements: DataFrame) -> str:
    """S8 (index kind) shape: ``{info: {name, requires_dist: [...]}}``, 1000 per page."""
    pages = requirements.withColumn("page", _page(1000)).groupBy("main_package", "page").agg(
        F.collect_list("requirement").alias("requires_dist"))
    out = pages.select(F.struct(F.col("main_package").alias("name"), "requires_dist").alias("info"))
    return _write(out, "requirements")


def land_versions(versions: DataFrame) -> str:
    """S12 shape: ``{result: {pkgs: [{name, version}]}}``, 1000 per page."""
    pages = versions.withColumn("page", _page(1000)).groupBy("page").agg(
        F.collect_list(F.struct(F.col("package").alias("name"), "version")).alias("pkgs"))
    return _write(pages.select(F.struct("pkgs").alias("result")), "versions")


def land_pages(pages: DataFrame) -> str:
    """S11 (issue kind) shape: ``url, html`` as parquet."""
    path = landing_folder(pages.sparkSession, "pages")
    pages.select("url", "html").write.mode("overwrite").parquet(path)
    return path


def land_locks(locks: DataFrame) -> str:
    """S6 shape: one lock-file text per ``(side, env, arch)`` folder.

    Each text holds the ``environments`` section for that environment and
    platform, followed by a ``packages:`` section that the reader must skip.
    One document is one environment's package list, the size of a lock file.
    """
    item = F.concat(F.lit("      - conda: "), F.col("url"))
    docs = locks.groupBy("side", "env", "arch").agg(F.sort_array(F.collect_list(item)).alias("items"))
    text = F.concat(F.lit("version: 6\nenvironments:\n  "), F.col("env"), F.lit(":\n    channels: []\n    packages:\n      "),
                    F.col("arch"), F.lit(":\n"), F.array_join("items", "\n"),
                    F.lit("\npackages:\n- conda: https://x.org/skipped.conda\n  depends: [unparsed\n"))
    path = landing_folder(locks.sparkSession, "locks")
    docs.select("side", "env", "arch", text.alias("value")).write.mode("overwrite") \
        .partitionBy("side", "env", "arch").text(path)
    return path


def land_releases(tags: DataFrame, page_size: int = 100) -> str:
    """S2 shape: per repository, API pages (JSON arrays, newest first) of ``page_size`` releases.

    The page of a release comes from its rank by date (skew-safe ordinal), and
    the page number is kept in the folder name, as a paged download records it.
    """
    from repolens.operators.ordinal import ordinal_within

    dated = tags.withColumn("_at", F.coalesce("pr_merged_at", "committed_at"))
    ranked = ordinal_within(dated, ["repo"], [F.desc("_at"), F.desc("tag")], name="_rank")
    item = F.struct(F.col("tag").alias("tag_name"), "prerelease", F.date_format("_at", ISO).alias("created_at"))
    pages = ranked.withColumn("page", F.floor((F.col("_rank") - 1) / page_size)).groupBy("repo", "page").agg(
        F.sort_array(F.collect_list(F.struct("_rank", item.alias("r")))).alias("items"))
    text = F.to_json(F.transform("items", lambda x: x["r"]))
    path = landing_folder(tags.sparkSession, "releases")
    pages.select("repo", "page", text.alias("value")).write.mode("overwrite").partitionBy("repo", "page").text(path)
    return path


def _archive_bytes(fmt: str, members: list[str]) -> bytes:
    import io
    import tarfile
    import zipfile

    buf = io.BytesIO()
    if fmt in ("wheel", "zip"):
        with zipfile.ZipFile(buf, "w") as z:
            for m in members:
                z.writestr(m, "")
    else:
        mode = {"sdist": "w:gz", "npm": "w:gz", "conda1": "w:bz2"}[fmt]
        with tarfile.open(fileobj=buf, mode=mode) as t:
            for m in members:
                t.addfile(tarfile.TarInfo(m), io.BytesIO(b""))
    return buf.getvalue()


def land_archives(members: DataFrame) -> str:
    """S5 shape: real archive files (wheel zip, sdist tar.gz) under ``side=<side>/``.

    Each archive is built inside a task from its member rows (one group per
    archive: the size of one package file) and written to the shared folder.
    """
    import pandas as pd

    from repolens.sources.readers import _filesystem

    path = landing_folder(members.sparkSession, "archives")

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        side, fmt, archive = pdf["side"].iloc[0], pdf["format"].iloc[0], pdf["archive"].iloc[0]
        fs, base = _filesystem(f"{path}/side={side}")
        fs.create_dir(base, recursive=True)
        with fs.open_output_stream(f"{base}/{archive}", compression=None) as f:
            f.write(_archive_bytes(fmt, sorted(set(pdf["member"]))))
        return pd.DataFrame({"archive": [archive], "members": [len(pdf)]})

    members.groupBy("side", "format", "archive").applyInPandas(build, "archive string, members long") \
        .write.format("noop").mode("overwrite").save()
    return path


def land_nested_archives(members: DataFrame) -> str:
    """Downloaded artifacts: per side and format an outer zip with the archives in it, and an outer zip that was cut short."""
    import pandas as pd

    from repolens.sources.files import filesystem

    path = landing_folder(members.sparkSession, "nested")

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        import io
        import zipfile

        side, fmt = pdf["side"].iloc[0], pdf["format"].iloc[0]
        buf = io.BytesIO()
        with zipfile.ZipFile(buf, "w", zipfile.ZIP_DEFLATED) as z:
            z.writestr("notes.txt", "built")
            for archive, rows in pdf.groupby("archive"):
                z.writestr(f"dist/{archive}", _archive_bytes(fmt, sorted(set(rows["member"]))))
        fs, base = filesystem(f"{path}/side={side}")
        fs.create_dir(base, recursive=True)
        for name, data in ((f"{fmt}.zip", buf.getvalue()), (f"cut-{fmt}.zip", buf.getvalue()[:-30])):
            with fs.open_output_stream(f"{base}/{name}", compression=None) as f:
                f.write(data)
        return pd.DataFrame({"archive": [fmt], "members": [len(pdf)]})

    members.groupBy("side", "format").applyInPandas(build, "archive string, members long") \
        .write.format("noop").mode("overwrite").save()
    return path


def land_manifests(flat: DataFrame) -> str:
    """S13 shape: ``{milestones: {<milestone>: {downloads: {<product>: [{platform, url}]}}}}``, one per milestone."""
    from repolens.operators.manifest import nest_manifest

    return _write(nest_manifest(flat), "manifests")


def land_refs(names: DataFrame) -> tuple[str, str]:
    """Git references and tag objects, one payload per line: every tag is annotated, every branch points at its commit."""
    api = F.concat(F.lit("https://api.github.com/repos/"), "repo")
    is_tag = F.col("kind") == "tag"
    tag_sha = F.sha1(F.concat(F.lit("tag "), "commit_sha"))
    ref = F.concat(F.when(is_tag, "refs/tags/").otherwise("refs/heads/"), "name")
    refs = names.select(ref.alias("ref"), F.concat(api, F.lit("/git/"), ref).alias("url"), F.struct(
        F.when(is_tag, tag_sha).otherwise(F.col("commit_sha")).alias("sha"),
        F.when(is_tag, "tag").otherwise("commit").alias("type")).alias("object"))
    tags = names.filter(is_tag).select(tag_sha.alias("sha"), F.concat(api, F.lit("/git/tags/"), tag_sha).alias("url"),
                                       F.struct(F.col("commit_sha").alias("sha")).alias("object"))
    return _write(refs, "refs"), _write(tags, "tag_objects")


def land_commits(tags: DataFrame) -> str:
    """One commit payload per ``repo=<repo>/sha=<sha>/`` folder."""
    merged = F.when(F.col("pr_merged_at").isNull(), F.array().cast("array<struct<mergedAt:string>>")).otherwise(
        F.array(F.struct(F.date_format("pr_merged_at", ISO).alias("mergedAt"))))
    commit = F.struct(F.date_format("committed_at", ISO).alias("committedDate"),
                      F.struct(merged.alias("nodes")).alias("associatedPullRequests"))
    out = tags.select("repo", "sha", F.struct(F.struct(commit.alias("object")).alias("repository")).alias("data"))
    path = landing_folder(tags.sparkSession, "commits")
    out.write.partitionBy("repo", "sha").json(path)
    return path


def land_issues(issues: DataFrame) -> str:
    """One issue payload per line."""
    return _write(issues.select("number", "state", F.concat(
        F.lit("https://api.github.com/repos/org/"), "repo").alias("repository_url")), "issues")
