"""Truncated, empty, missing and error pages of every reader: named, listed, never lost."""

import json

import pytest
from pyspark.sql import types as T

from repolens.sources import landed as LP
from repolens.sources import readers as R

RUN = {"run_number": 7, "name": "t", "repository": {"name": "r"}, "path": ".github/workflows/test.yaml@main"}
ANY = r"([^/]+)\.json$"
ARRAY = {"releases": [{"tag_name": "v1"}], "names": [{"name": "v1", "commit": {"sha": "a"}}]}
GOOD = {
    "pull_requests": {"data": {"search": {"nodes": [{"number": 1, "title": "a", "mergedAt": "2024-01-02T03:04:05Z"}]}}},
    "runs": {"total_count": 1, "workflow_runs": [RUN]},
    "artifacts": {"run_number": 7, "artifacts": [{"name": "pip", "archive_download_url": "x"}]},
    "index": {"name": "p", "files": [{"filename": "p-1.0.tar.gz"}]},
    "requirements": {"info": {"name": "m", "requires_dist": ["a>=1"]}},
    "project": {"name": "m", "dependencies": {"a": "*"}},
    "features": {"name": "m", "feature": {"py311": {"dependencies": {"b": "*"}}}},
    "forum": {"id": 5, "title": "Q", "post_stream": {"posts": [{"id": 1, "cooked": "x"}]}},
    "versions": {"result": {"pkgs": [{"name": "p", "version": "1.0"}]}},
    "manifest": {"milestones": {"141": {"downloads": {"chrome": [{"platform": "linux64", "url": "u"}]}}}},
    "refs": {"ref": "refs/tags/v1", "url": "https://x/repos/o/r/git/refs/tags/v1", "object": {"sha": "a", "type": "tag"}},
    "tags": {"sha": "a", "url": "https://x/repos/o/r/git/tags/a", "object": {"sha": "b"}},
    "commits": {"data": {"repository": {"object": {"committedDate": "2024-01-02T03:04:05Z"}}}},
    "issues": {"number": 1, "state": "open", "repository_url": "https://x/repos/o/r"}, **ARRAY}
READ = {
    "pull_requests": lambda s, p, **k: R.read_pull_requests(s, p, repo_pattern=ANY, **k), "releases": R.read_releases, "runs": R.read_runs,
    "artifacts": R.read_artifacts, "index": R.read_index_files, "requirements": R.read_requirements,
    "project": lambda s, p, **k: R.read_requirements(s, p, "project", **k), "features": R.read_project_features,
    "forum": lambda s, p, **k: R.read_pages(s, p, "forum", **k), "versions": R.read_versions, "manifest": R.read_manifest,
    "refs": R.read_ref_objects, "tags": R.read_tag_objects, "commits": lambda s, p, **k: R.read_commit_dates(s, p, ANY, ANY, **k),
    "issues": R.read_issue_states, "names": lambda s, p, **k: R.read_ref_names(s, p, ANY, ANY, **k)}


@pytest.mark.parametrize("kind", sorted(GOOD))
def test_a_bad_page_is_named_or_left_out(spark, tmp_path, kind):
    text = json.dumps(GOOD[kind])
    bad = {"truncated": text[:-4], "message": '{"message": "rate limit"}', "empty": "", "words": "<html>busy</html>"}
    for name, broken in bad.items():
        folder = tmp_path / name
        folder.mkdir()
        (folder / "good.json").write_text(text)
        assert READ[kind](spark, str(folder)).count() == 1
        (folder / f"{name}.json").write_text(broken)
        with pytest.raises(Exception, match=f"not a whole page.*{name}.json"):
            READ[kind](spark, str(folder)).collect()
        assert READ[kind](spark, str(folder), bad_pages="skip").count() == 1
    with pytest.raises(ValueError):
        READ[kind](spark, str(tmp_path / "words"), bad_pages="ignore")


def test_repository_and_workflow_file_from_paths(spark, tmp_path):
    (tmp_path / "prs").mkdir()
    (tmp_path / "prs" / "lib.json").write_text(json.dumps(GOOD["pull_requests"]))
    assert READ["pull_requests"](spark, str(tmp_path / "prs")).first().repo == "lib"
    (tmp_path / "runs").mkdir()
    (tmp_path / "runs" / "a.json").write_text(json.dumps(GOOD["runs"]))
    assert R.read_runs(spark, str(tmp_path / "runs")).first().workflow_file == "test.yaml"


def test_page_status_of_lists(spark, tmp_path):
    def put(repo, page, doc):
        (tmp_path / repo).mkdir(exist_ok=True)
        (tmp_path / repo / f"{page}.json").write_text(doc if isinstance(doc, str) else json.dumps(doc))

    page = {"total_count": 2, "workflow_runs": [RUN]}
    put("whole", 0, page)
    put("whole", 1, page)
    put("gap", 0, {"total_count": 4, "workflow_runs": [RUN]})
    put("gap", 3, {"total_count": 4, "workflow_runs": [RUN]})
    put("cut", 0, json.dumps(page)[:-3])
    put("cut", 1, "")
    put("error", 0, {"message": "rate limit"})
    got = LP.page_status(spark, str(tmp_path / "*"), R.RUNS_SCHEMA, "workflow_runs", listing=r"/([^/]+)/\d+\.json$",
                         page=r"/(\d+)\.json$", total="total_count")
    rows = sorted((r.listing, -1 if r.page is None else r.page, r.status, r.rows) for r in got.collect())
    assert rows == sorted([("whole", 0, "ok", 1), ("whole", 1, "ok", 1), ("gap", 0, "ok", 1), ("gap", 3, "ok", 1),
                           ("gap", 1, "missing", 0), ("gap", 2, "missing", 0), ("gap", -1, "short", 2),
                           ("cut", 0, "unparsed", 0), ("cut", 1, "empty file", 0), ("error", 0, "no payload", 0)])
    assert [r.text for r in got.collect() if r.status == "unparsed"] == [json.dumps(page)[:-3]]


def test_unfinished_lists_by_cursor_and_by_size(spark, tmp_path):
    for repo, more in (("a", True), ("b", False)):
        (tmp_path / "prs" / repo).mkdir(parents=True)
        search = {"nodes": [{"number": 1}], "pageInfo": {"hasNextPage": more, "endCursor": "x"}}
        (tmp_path / "prs" / repo / "0.json").write_text(json.dumps({"data": {"search": search}}))
    got = LP.page_status(spark, str(tmp_path / "prs" / "*"), R.PR_SCHEMA, "data.search.nodes", listing=r"/([^/]+)/\d+\.json$",
                         page=r"/(\d+)\.json$", more="data.search.pageInfo.hasNextPage")
    assert sorted((r.listing, r.status) for r in got.collect()) == [("a", "ok"), ("a", "unfinished"), ("b", "ok")]
    for page, n in ((1, 2), (2, 2)):
        (tmp_path / "rel").mkdir(exist_ok=True)
        (tmp_path / "rel" / f"{page}.json").write_text(json.dumps([{"tag_name": f"v{i}"} for i in range(n)]))
    got = LP.page_status(spark, str(tmp_path / "rel"), T.ArrayType(R.RELEASE_ITEM), "tag_name", page=r"/(\d+)\.json$",
                         first_page=1, page_size=2)
    assert sorted((r.page, r.status) for r in got.collect()) == [(1, "ok"), (2, "ok"), (2, "unfinished")]


def test_empty_files_of_a_folder_are_listed_in_tasks(spark, tmp_path, monkeypatch):
    from pyspark.sql import DataFrame

    for name, text in (("k=a/0.json", json.dumps(GOOD["runs"])), ("k=a/1.json", ""), ("k=b/2.json", ""), ("_c/3.json", ""), ("k=a/.4.json", "")):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text(text)
    plain = tmp_path / "plain"
    (plain / "below").mkdir(parents=True)
    (plain / "0.json").write_text("")
    (plain / "below" / "1.json").write_text("")  # Spark reads no folder below one without partitions
    (plain / "2.json").write_text(json.dumps(GOOD["runs"]))
    monkeypatch.setattr(DataFrame, "inputFiles", lambda self: pytest.fail("names on the driver"))
    status = lambda folder: sorted((r.listing, r.page, r.status) for r in LP.page_status(
        spark, f"file:{folder}", R.RUNS_SCHEMA, "workflow_runs", listing=r"/([^/]+)/[^/]+$", page=r"/(\d+)\.json$").collect())
    assert status(plain) == [("plain", 0, "empty file"), ("plain", 1, "missing"), ("plain", 2, "ok")]
    (tmp_path / "parts").mkdir()
    for k in ("k=a", "k=b", "_c"):
        (tmp_path / k).rename(tmp_path / "parts" / k)
    assert status(tmp_path / "parts") == [("k=a", 0, "ok"), ("k=a", 1, "empty file"), ("k=b", 0, "missing"), ("k=b", 1, "missing"), ("k=b", 2, "empty file")]


def test_damaged_pages_take_no_folder_each(spark):
    from repolens.plans.landing import land_damaged_runs
    from repolens.sources.readers import walk

    runs = spark.range(3000).selectExpr("'r' || id % 3 AS repo", "id AS run_number", "'queued' AS status")
    files = [r.path for r in walk(spark, land_damaged_runs(runs)).collect()]
    assert len(files) > 60 and len({f.rsplit("/", 1)[0] for f in files}) == 3
