"""Readers, sinks and the streaming query, on tiny landed samples made here."""

import io
import json
import tarfile
import zipfile

import zstandard
from pyspark.sql import functions as F

from repolens.operators import changelog as CL
from repolens.sources import readers as R
from repolens.sources import sinks as K
from repolens.streaming.runs import start_active_runs


def _w(path, text):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text)
    return path


def test_pull_requests_and_releases(spark, tmp_path):
    page = {"repo": "r1", "data": {"search": {"pageInfo": {"hasNextPage": False}, "nodes": [
        {"number": 1, "title": "fix: a", "author": {"login": "u"}, "mergedAt": "2024-01-02T03:04:05Z"},
        {"number": 2, "title": "b", "author": None, "mergedAt": "2024-01-03T00:00:00Z"}]}}}
    _w(tmp_path / "prs" / "p1.json", json.dumps(page))
    prs = R.read_pull_requests(spark, str(tmp_path / "prs"))
    rows = sorted(prs.collect())
    assert [(r.repo, r.number, r.author) for r in rows] == [("r1", 1, "u"), ("r1", 2, "unknown")]
    assert str(rows[0].merged_at) == "2024-01-02 03:04:05"
    _w(tmp_path / "rel" / "r1.json", json.dumps([{"tag_name": "v2.0.0rc1", "prerelease": True},
                                                 {"tag_name": "v1.0.0", "prerelease": False}]))
    rel = R.read_releases(spark, str(tmp_path / "rel")).orderBy("api_order").collect()
    assert [(r.repo, r.tag, r.prerelease, r.api_order) for r in rel] == [("r1", "v2.0.0rc1", True, 0),
                                                                         ("r1", "v1.0.0", False, 1)]


def test_runs_artifacts_index_requirements_versions(spark, tmp_path):
    runs = {"total_count": 2, "workflow_runs": [
        {"run_number": 7, "name": "test", "head_branch": "main", "display_title": "t", "status": "in_progress",
         "conclusion": None, "created_at": "2024-01-01T00:00:00Z", "run_started_at": "2024-01-01T00:00:00Z",
         "url": "u", "triggering_actor": {"login": "me"}, "repository": {"name": "r1", "full_name": "o/r1"}}]}
    _w(tmp_path / "runs" / "a.json", json.dumps(runs))
    r = R.read_runs(spark, str(tmp_path / "runs")).first()
    assert (r.repo, r.run_number, r.actor, r.conclusion) == ("r1", 7, "me", None)
    _w(tmp_path / "arts" / "a.json", json.dumps({"run_number": 7, "artifacts": [
        {"name": "pip", "archive_download_url": "x"}, {"name": "conda", "archive_download_url": "y"}]}))
    a = R.read_artifacts(spark, str(tmp_path / "arts")).orderBy("position").collect()
    assert [(x.name, x.position) for x in a] == [("pip", 0), ("conda", 1)]
    _w(tmp_path / "idx" / "p.json", json.dumps({"name": "p", "files": [
        {"filename": "p-1.0.tar.gz", "upload-time": "2024-01-01T00:00:00Z", "requires-python": ">=3.9"}]}))
    f = R.read_index_files(spark, str(tmp_path / "idx")).first()
    assert (f.package, f.filename, f.requires_python) == ("p", "p-1.0.tar.gz", ">=3.9")
    _w(tmp_path / "meta" / "m.json", json.dumps({"info": {"name": "m", "requires_dist": ["a>=1", "b ; extra == 'x'"]}}))
    assert R.read_requirements(spark, str(tmp_path / "meta")).count() == 2
    _w(tmp_path / "proj" / "m.json", json.dumps({"name": "m", "dependencies": {"a": "*"},
                                                 "feature": {"py311": {"dependencies": {"b": "*"}}, "test": {}}}))
    assert sorted(r.requirement for r in R.read_requirements(spark, str(tmp_path / "proj"), "project").collect()) == ["a", "b"]
    assert R.read_project_features(spark, str(tmp_path / "proj")).count() == 2
    _w(tmp_path / "ver" / "v.json", json.dumps({"result": {"pkgs": [{"name": "p", "version": "1.0"},
                                                                     {"name": "p", "version": "1.0"}]}}))
    assert R.read_versions(spark, str(tmp_path / "ver")).count() == 1


def test_archive_members(spark, tmp_path):
    d = tmp_path / "arch"
    d.mkdir()
    with zipfile.ZipFile(d / "lib-1.0.0-py3-none-any.whl", "w") as z:
        z.writestr("lib/", "")
        z.writestr("lib/a.py", "x")
    with tarfile.open(d / "lib-1.0.0.tar.gz", "w:gz") as t:
        data = b"x"
        info = tarfile.TarInfo("lib-1.0.0/a.py")
        info.size = len(data)
        t.addfile(info, io.BytesIO(data))
        dirinfo = tarfile.TarInfo("lib-1.0.0/sub")
        dirinfo.type = tarfile.DIRTYPE
        t.addfile(dirinfo)
    inner = io.BytesIO()
    with tarfile.open(fileobj=inner, mode="w") as t:
        info = tarfile.TarInfo("site-packages/lib/a.py")
        info.size = 1
        t.addfile(info, io.BytesIO(b"x"))
    with zipfile.ZipFile(d / "lib-1.0.0-py_0.conda", "w") as z:
        z.writestr("metadata.json", "{}")
        z.writestr("pkg-lib-1.0.0.tar.zst", zstandard.ZstdCompressor().compress(inner.getvalue()))
    got = {(r.format, r.member) for r in R.read_archive_members(spark, str(d)).collect()}
    assert got == {("wheel", "lib/"), ("wheel", "lib/a.py"), ("sdist", "lib-1.0.0/a.py"),
                   ("conda", "metadata.json"), ("conda", "site-packages/lib/a.py")}


def test_locks_texts_listing_pages_manifest(spark, tmp_path):
    lock = ("version: 6\nenvironments:\n  test-1:\n    channels: []\n    packages:\n      linux-64:\n"
            "      - conda: https://x/linux-64/a-1-0.conda\n      - pypi: https://x/b-2-py3-none-any.whl\n"
            "  docs:\n    packages:\n      linux-64:\n      - conda: https://x/c-1-0.conda\n"
            "packages:\n- conda: ignored: [unparsable\n")
    _w(tmp_path / "locks" / "good" / "pixi.lock", lock)
    rows = sorted((r.env, r.url) for r in R.read_locks(spark, str(tmp_path / "locks" / "good")).collect())
    assert rows == sorted([("docs", "https://x/c-1-0.conda"), ("test-1", "https://x/linux-64/a-1-0.conda"),
                           ("test-1", "https://x/b-2-py3-none-any.whl")])
    _w(tmp_path / "src" / "pkg" / "a.py", "deprecated('1.0')\n")
    _w(tmp_path / "src" / "pkg" / "b.txt", "no")
    texts = R.read_texts(spark, str(tmp_path / "src"), "*.py", root=str(tmp_path / "src")).collect()
    assert [(t.path, t.content) for t in texts] == [("pkg/a.py", "deprecated('1.0')\n")]
    listing = R.read_file_listing(spark, str(tmp_path / "src"), root=str(tmp_path / "src"))
    assert "content" not in listing.columns and listing.count() == 2
    _w(tmp_path / "forum" / "t.json", json.dumps({"id": 5, "title": "Q?", "post_stream": {"posts": [
        {"id": 1, "cooked": "<pre><code class='lang-python'>x = 1</code></pre>"}]}}))
    posts = R.read_pages(spark, str(tmp_path / "forum"), kind="forum").first()
    assert (posts.number, posts.title) == (5, "Q?")
    _w(tmp_path / "man" / "m.json", json.dumps({"milestones": {"141": {"milestone": "141", "downloads": {
        "chrome": [{"platform": "linux64", "url": "u1"}, {"platform": "win64", "url": "u2"}]}}}}))
    from repolens.operators.manifest import download_index
    got = [tuple(r) for r in download_index(R.read_manifest(spark, str(tmp_path / "man")), platform="linux64").collect()]
    assert got == [("141", "chrome", "linux64", "u1")]


def test_forum_code_blocks(spark, tmp_path):
    from repolens.operators.pages import code_blocks

    pages = spark.createDataFrame(
        [("thread/5", "Q? x", 5, 0, "<p>t</p><pre><code class='lang-python'>x = 1</code></pre>"),
         ("thread/5", "Q? x", 5, 1, "<pre><code class='lang-python'>y = (</code></pre><code class='lang-py'>z = 2</code>")],
        "url string, title string, number bigint, post bigint, html string")
    rows = sorted((r.block, r.code, r.repo, r.filename) for r in code_blocks(pages, kind="forum").collect())
    assert rows == [(0, "x = 1", "discourse", "5_Q_x"), (1, "z = 2", "discourse", "5_Q_x")]


def test_sinks(spark, tmp_path):
    docs = spark.createDataFrame([("r", "1_a", "u", "{}", "s", 1)],
                                 "repo string, filename string, url string, notebook string, script string, blocks bigint")
    out = str(tmp_path / "docs")
    again = docs.unionAll(docs.withColumn("url", F.lit("v")))
    assert K.write_documents(again, out).count() == 2
    assert K.write_documents(docs, out).count() == 0
    assert sorted((r.kind, r.content) for r in K.read_documents(spark, out).collect()) == [("ipynb", "{}"), ("py", "s")]
    cl = spark.createDataFrame([("r", "v1", "v2", "## Changelog (v1..v2)")], "repo string, from_tag string, to_tag string, changelog string")
    later = spark.createDataFrame([("r", "v2", "v3", "later")], cl.schema)
    K.write_changelogs(cl.unionAll(later), str(tmp_path / "cl"))
    assert {(r.from_tag, r.value) for r in spark.read.text(str(tmp_path / "cl")).collect()} == {
        ("v1", "## Changelog (v1..v2)"), ("v2", "later")}
    lines = spark.createDataFrame([("r", "v1", "v2", -1, 0, None, None, "## Changelog (v1..v2)"),
                                   ("r", "v1", "v2", 3, 1, None, 5, "- x")],
                                  "repo string, from_tag string, to_tag string, position int, sub int, "
                                  "merged_at timestamp_ntz, number bigint, line string")
    K.write_changelog_lines(lines, str(tmp_path / "cll"))
    assert [r.value for r in spark.read.text(str(tmp_path / "cll")).collect()] == ["## Changelog (v1..v2)", "- x"]
    texts = spark.createDataFrame([("w.yml", "a", "b")], "path string, text string, new_text string")
    ch = spark.createDataFrame([("w.yml", 0, "x", "o", "n")], "path string, pos bigint, action_path string, old string, new string")
    assert K.write_rewrites(texts, ch, str(tmp_path / "rw"), dry_run=True).count() == 1
    K.write_rewrites(texts, ch, str(tmp_path / "rw"))
    assert (tmp_path / "rw" / "w.yml").read_text() == "b"
    K.write_rewrites(texts.withColumn("checkout", F.lit("c")), ch, str(tmp_path / "rw"), keys=("checkout",))
    assert (tmp_path / "rw" / "c" / "w.yml").read_text() == "b"
    K.write_table(cl, str(tmp_path / "t"), partition_by=["repo"])
    assert spark.read.parquet(str(tmp_path / "t")).count() == 1


def test_streaming_active_runs(spark, tmp_path):
    runs = {"workflow_runs": [
        {"run_number": 1, "name": "w", "status": "in_progress", "run_started_at": "2024-01-01T00:00:00Z",
         "repository": {"name": "r"}, "triggering_actor": {"login": "u"}},
        {"run_number": 2, "name": "w", "status": "completed", "run_started_at": "2024-01-01T00:00:00Z",
         "repository": {"name": "r"}}]}
    _w(tmp_path / "landing" / "p1.json", json.dumps(runs))
    q = start_active_runs(spark, str(tmp_path / "landing"), str(tmp_path / "out"), str(tmp_path / "ckpt"))
    q.awaitTermination(120)
    out = spark.read.parquet(str(tmp_path / "out")).collect()
    assert [(r.repo, r.run_number, r.status) for r in out] == [("r", 1, "in_progress")]
    assert out[0].duration.endswith(" min")


def test_changelog_from_landed_pages(spark, tmp_path):
    page = {"repo": "r", "data": {"search": {"nodes": [
        {"number": 1, "title": "feat: x", "author": {"login": "u"}, "mergedAt": "2024-01-02T00:00:00Z"}]}}}
    _w(tmp_path / "prs" / "p.json", json.dumps(page))
    prs = R.read_pull_requests(spark, str(tmp_path / "prs"))
    tags = spark.createDataFrame([("r", "v1", False, "2024-01-01 00:00:00", None), ("r", "v2", False, "2024-01-03 00:00:00", None)],
                                 "repo string, tag string, prerelease boolean, committed_at string, pr_merged_at string") \
        .withColumn("committed_at", F.to_timestamp_ntz("committed_at")).withColumn("pr_merged_at", F.to_timestamp_ntz("pr_merged_at"))
    doc = CL.changelog_document(prs, tags).first().changelog
    assert doc == ("## Changelog (v1..v2)\n\nMany thanks to [@u](https://github.com/u) (first contribution) for their "
                   "contributions.\n\n### Features\n- feat: x ([#1](https://github.com/org/r/pull/1))\n")


def test_working_file_plans_on_a_real_tree(spark, tmp_path):
    from repolens.operators import workfiles as W

    root = tmp_path / "dev"
    for rel in ["dev_repoA/123_fix.py", "dev_repoA/archive/55_old.py", "dev_repoA/notes.txt", "dev_repoA/9999_new.py",
                "dev_repoB/77_x.py", "dev_repoB/__pycache__/a.pyc", "dev_repoB/tmp1.py", "other/1234_y.py",
                "dev_repoB/.ipynb_checkpoints/4567_c.py"]:
        _w(root / rel, "x")
    files = R.read_file_listing(spark, str(root), root=str(root), include_hidden=True)
    visible = R.read_file_listing(spark, str(root), root=str(root))
    assert files.count() == 9 and visible.count() == 7
    issues = spark.createDataFrame([("repoA", 123, "closed"), ("repoA", 9999, "open"), ("repoB", 77, "merged")],
                                   "repo string, number bigint, state string")
    plan = {(r.folder, r.name): (r.action, r.target) for r in W.archive_plan(files, issues).collect()}
    assert plan[("dev_repoA", "123_fix.py")] == ("archive", "dev_repoA/archive/123_fix.py")
    assert plan[("dev_repoA", "9999_new.py")] == ("keep", None)
    assert plan[("dev_repoA", "notes.txt")] == ("unassociated", None)
    assert plan[("dev_repoB", "77_x.py")][0] == "archive"
    assert ("dev_repoA", "archive") not in plan and ("other", "1234_y.py") not in plan
    stale = {r.path: r.pattern for r in W.stale_files(files).collect()}
    assert stale == {"dev_repoB/__pycache__/a.pyc": "__pycache__", "dev_repoB/tmp1.py": "tmp*.py",
                     "dev_repoB/.ipynb_checkpoints/4567_c.py": ".ipynb_checkpoints"}
    recent = [r.path for r in W.recent_files(files, 10).collect()]
    assert sorted(recent) == ["dev_repoA/123_fix.py", "dev_repoA/9999_new.py"]


def test_texts_below_hidden_folders(spark, tmp_path):
    repo = tmp_path / "checkout"
    _w(repo / ".github" / "workflows" / "ci.yml", "steps:\n  - uses: org/act@v1\n")
    _w(repo / "src" / "a.py", "x = 1\n")
    plain = R.read_texts(spark, str(repo), "*.yml", root=str(repo)).collect()
    assert plain == []
    found = [tuple(r) for r in R.read_texts(spark, str(repo), "*.yml", root=str(repo), include_hidden=True).collect()]
    assert found == [(".github/workflows/ci.yml", "steps:\n  - uses: org/act@v1\n")]


def test_release_pages_keep_api_order(spark):
    from repolens.plans import landing as LD
    from repolens.plans.fixtures import load

    tags = load(spark, "/root/testdata/sf0.001", "tags")
    rel = R.read_releases(spark, LD.land_releases(tags, page_size=2), repo_pattern=r"/repo=([^/]+)/",
                          page_pattern=r"/page=([0-9]+)/", page_size=2)
    got = {(r.repo, r.tag): r.api_order for r in rel.collect()}
    want = {}
    for row in tags.collect():
        want.setdefault(row.repo, []).append((row.pr_merged_at or row.committed_at, row.tag))
    expected = {(repo, tag): i for repo, items in want.items()
                for i, (_, tag) in enumerate(sorted(items, reverse=True))}
    assert got == expected


def test_artifact_pages_as_served(spark, tmp_path):
    for page, names in enumerate([["b", "c"], ["a"]]):
        _w(tmp_path / "run-7" / f"page-{page}.json",
           json.dumps({"artifacts": [{"name": n, "archive_download_url": n} for n in names]}))
    got = R.read_artifacts(spark, str(tmp_path / "run-7"), run_pattern=r"run-([0-9]+)/", page_pattern=r"page-([0-9]+)",
                           page_size=2)
    assert sorted((r.run_number, r.position, r.name) for r in got.collect()) == [(7, 0, "b"), (7, 1, "c"), (7, 2, "a")]


def test_archive_names_are_listed_unopened(spark, tmp_path):
    for name in ("a-1.0.0-py3-none-any.whl", "a-1.0.0.tgz", "notes.txt"):
        _w(tmp_path / name, "not an archive")
    got = {(r.archive, r.format) for r in R.read_archive_names(spark, str(tmp_path)).collect()}
    assert got == {("a-1.0.0-py3-none-any.whl", "wheel"), ("a-1.0.0.tgz", "npm")}


def test_name_pages_as_served(spark, tmp_path):
    for n, page in enumerate([[{"name": "v1", "commit": {"sha": "a"}}], [{"name": "v2", "commit": {"sha": "b"}}]]):
        _w(tmp_path / "o" / "r" / "tags" / f"{n}.json", json.dumps(page))
    _w(tmp_path / "o" / "r" / "branches" / "0.json", json.dumps([{"name": "main", "commit": {"sha": "c"}}]))
    got = R.read_ref_names(spark, str(tmp_path / "o" / "r" / "*"), r"([^/]+/[^/]+)/(?:tags|branches)/", r"/(tags|branches)/")
    assert sorted(tuple(r) for r in got.collect()) == [
        ("o/r", "branch", "main", "c"), ("o/r", "tag", "v1", "a"), ("o/r", "tag", "v2", "b")]


def test_walk_lists_every_level_with_times_and_lengths(spark, tmp_path, monkeypatch):
    import datetime as dt
    import os

    monkeypatch.setattr(R, "LISTED", 3)
    want = {}
    for i, name in enumerate(["a.py", ".hidden", "_x/y.txt", "_x/.z/deep/er.txt", "d/e/f/g.txt", *[f"many/{k}.txt" for k in range(8)]]):
        file = _w(tmp_path / name, "x" * i)
        os.utime(file, (1_700_000_000 + i, 1_700_000_000 + i))
        want[name] = (dt.datetime(2023, 11, 14, 22, 13, 20) + dt.timedelta(seconds=i), i)
    (tmp_path / "empty" / "er").mkdir(parents=True)
    listed = R.read_file_listing(spark, str(tmp_path), root=str(tmp_path), include_hidden=True)
    assert {r.path: (r.mtime, r.length) for r in listed.collect()} == want
    uri = R.read_file_listing(spark, f"file://{tmp_path}", root=f"file://{tmp_path}", include_hidden=True)
    assert {r.path for r in uri.collect()} == set(want)
    assert R.read_file_listing(spark, str(tmp_path / "empty"), include_hidden=True).count() == 0
    assert R.read_file_listing(spark, str(tmp_path / "none"), include_hidden=True).count() == 0
