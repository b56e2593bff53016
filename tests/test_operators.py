"""Hand-written edge cases per operator."""

import datetime as dt
import random
from collections import Counter

from pyspark.sql import Window
from pyspark.sql import functions as F

from repolens.operators import bisect as BI
from repolens.operators import changelog as CL
from repolens.operators import diffs as DF
from repolens.operators import refs as RF
from repolens.operators import runs as RU
from repolens.operators.ordinal import ordinal_within

T0 = dt.datetime(2024, 1, 1)


def _prs(spark, rows):
    return spark.createDataFrame(rows, "repo string, number bigint, title string, author string, merged_at timestamp_ntz")


def _tags(spark, rows):
    return spark.createDataFrame(
        rows, "repo string, tag string, prerelease boolean, committed_at timestamp_ntz, pr_merged_at timestamp_ntz")


def test_categorize_drops_unknown_prefix_and_keeps_bare_fix(spark):
    prs = _prs(spark, [("r", 1, "oops: x", "a", T0), ("r", 2, "fix:", "a", T0), ("r", 3, "plain", "a", T0),
                       ("r", 4, "feat(ui)!: big", "a", T0)])
    w = spark.createDataFrame([("r", "v1", "v2", T0, T0)],
                              "repo string, from_tag string, to_tag string, from_at timestamp_ntz, to_at timestamp_ntz")
    rows = {r.number: (r.section, r.line) for r in CL.categorize_changes(CL.prs_in_window(prs, w)).collect()}
    assert 1 not in rows
    assert rows[2][0] == "Bug Fixes"
    assert rows[3][0] == "Miscellaneous"
    assert rows[4] == ("Features", "- BREAKING CHANGE: feat(ui)!: big ([#4](https://github.com/org/r/pull/4))")


def test_window_ends_included_and_first_contribution_at_start_is_new(spark):
    t1, t2 = T0, T0 + dt.timedelta(days=3)
    prs = _prs(spark, [("r", 1, "a", "old", t1 - dt.timedelta(days=1)), ("r", 2, "b", "old", t1),
                       ("r", 3, "c", "new", t1), ("r", 4, "d", None, t2), ("r", 5, "e", "dependabot", t2)])
    tags = _tags(spark, [("r", "v1", False, t1, None), ("r", "v2", False, t2, None)])
    w = CL.release_windows(tags)
    inw = CL.prs_in_window(prs, w)
    assert sorted(r.number for r in inw.collect()) == [2, 3, 4, 5]
    flags = {r.login: r.is_new for r in CL.first_contributions(prs, CL.contributors(inw)).collect()}
    assert flags == {"old": False, "new": True, "unknown": True}


def test_contributor_sentence_sizes(spark):
    windows = spark.createDataFrame([("r", f"a{i}", "b") for i in range(4)], "repo string, from_tag string, to_tag string")
    people = [("r", f"a{i}", "b", f"u{j}", j == 0) for i in range(4) for j in range(i)]
    flagged = spark.createDataFrame(people, "repo string, from_tag string, to_tag string, login string, is_new boolean")
    ranked = CL.rank_contributors(flagged, maintainer="u1")
    got = {r.from_tag: r.sentence for r in CL.contributor_sentence(ranked, windows).collect()}
    m = "[@u{0}](https://github.com/u{0})"
    assert got["a0"] == "No contributors found."
    assert got["a1"] == f"Many thanks to {m.format(0)} (first contribution) for their contributions."
    assert got["a2"] == f"Many thanks to {m.format(0)} (first contribution), and {m.format(1)} for their contributions."
    assert got["a3"] == (f"Many thanks to {m.format(0)} (first contribution), {m.format(2)}, and {m.format(1)} "
                         "for their contributions.")


def test_package_diff_rules(spark):
    rows = [("good", "docs", "linux-64", "https://x/linux-64/a-1-0.conda"),
            ("bad", "docs", "linux-64", "https://x/linux-64/a-2-0.conda"),
            ("good", "test-1", "linux-64", "https://x/linux-64/a-1-0.conda"),
            ("bad", "test-1", "linux-64", "https://x/linux-64/a-2-0.conda"),
            ("good", "test-1", "linux-64", "https://x/linux-64/same-1-0.conda"),
            ("bad", "test-1", "linux-64", "https://x/linux-64/same-1-0.conda"),
            ("good", "test-1", "linux-64", "."),
            ("good", "test-1", "osx-64", "https://x/osx-64/b-1-0.conda")]
    locks = spark.createDataFrame(rows, "side string, env string, arch string, url string")
    out = [tuple(r) for r in DF.package_diff(locks).collect()]
    assert out == [("test-1", "linux-64", "a", "a-1-0.conda", "a-2-0.conda")]
    assert DF.package_diff(locks, env="docs").count() == 0


def test_line_diff_applied_to_bad_gives_good(spark):
    rng = random.Random(3)
    good = [rng.choice("abcde") for _ in range(60)]
    bad = [rng.choice("abcdf") for _ in range(50)]
    rows = [("good", "p", i + 1, x) for i, x in enumerate(good)] + [("bad", "p", i + 1, x) for i, x in enumerate(bad)]
    lines = spark.createDataFrame(rows, "side string, path string, line_no bigint, line string")
    d = DF.line_diff(lines).collect()
    ms = Counter(bad)
    for r in d:
        ms[r.line] += 1 if r.status == "added" else -1
    assert +ms == Counter(good)


def test_ordinal_matches_row_number(spark):
    rng = random.Random(5)
    rows = [(rng.choice(["hot"] * 8 + ["a", "b"]), rng.randint(0, 10**6), i) for i in range(3000)]
    df = spark.createDataFrame(rows, "g string, k bigint, id bigint").repartition(7)
    mine = ordinal_within(df, ["g"], ["k", "id"])
    ref = df.withColumn("rn", F.row_number().over(Window.partitionBy("g").orderBy("k", "id")))
    a = {(r.g, r.id): r.ordinal for r in mine.collect()}
    b = {(r.g, r.id): r.rn for r in ref.collect()}
    assert a == b


def test_bisect_by_hand(spark):
    # passes (+) and failures (-) of 1.0 1.1 ... in order; probes worked out on paper
    table = {"a": ("++---", 0, 4, ("1.2", "1.1", 2)), "b": ("+-", 0, 1, ("1.1", "1.0", 0)),
             "c": ("+++++++-", 0, 7, ("1.7", "1.6", 3)), "d": ("+-+-+-", 0, 5, ("1.3", "1.2", 2)),
             "e": ("---++", 4, 0, ("1.2", "1.3", 2))}
    results = [(p, f"1.{i}", c == "+") for p, (marks, *_) in table.items() for i, c in enumerate(marks)]
    ranges = [(p, f"1.{g}", f"1.{b}") for p, (_, g, b, _) in table.items()]
    df = spark.createDataFrame(results, "package string, version string, passed boolean")
    out = BI.version_regressions(df.select("package", "version"), df, spark.createDataFrame(
        ranges, "package string, good_version string, bad_version string"))
    got = {r.package: (r.failing_version, r.passing_version, r.probes) for r in out.collect()}
    assert got == {p: want for p, (_, _, _, want) in table.items()}


def test_bisect_invariants(spark):
    rng = random.Random(11)
    rows, ranges, size = [], [], {}
    for p in range(12):
        n = rng.randint(3, 40)
        good, bad = rng.sample(range(n), 2)
        rows += [(f"p{p}", f"1.{i}.0", i == good or i != bad and rng.random() < 0.5) for i in range(n)]
        ranges.append((f"p{p}", f"1.{good}.0", f"1.{bad}.0"))
        size[f"p{p}"] = abs(good - bad)
    results = spark.createDataFrame(rows, "package string, version string, passed boolean")
    passed = {(p, v): ok for p, v, ok in rows}
    out = BI.version_regressions(results.select("package", "version"), results,
                                 spark.createDataFrame(ranges, "package string, good_version string, bad_version string"))
    for r in out.collect():
        assert passed[r.package, r.passing_version] and not passed[r.package, r.failing_version]
        at = [int(v.split(".")[1]) for v in (r.passing_version, r.failing_version, r.good_version, r.bad_version)]
        assert abs(at[0] - at[1]) == 1 and (at[1] - at[0]) * (at[3] - at[2]) > 0
        assert r.probes <= (size[r.package] - 1).bit_length()


def test_bisect_baseline_reasons(spark):
    results = spark.createDataFrame([("p", "1.0", True), ("p", "1.1", False), ("p", "1.2", False)],
                                    "package string, version string, passed boolean")
    ranges = spark.createDataFrame([("p", "1.1", "1.2"), ("p", "1.0", "9.9"), ("p", "1.0", "1.0")],
                                   "package string, good_version string, bad_version string")
    out = {(r.good_version, r.bad_version): r.status
           for r in BI.version_regressions(results.select("package", "version"), results, ranges).collect()}
    assert out == {("1.1", "1.2"): "good version failed", ("1.0", "9.9"): "bad version not found",
                   ("1.0", "1.0"): "bad version passed"}


def test_latest_refs_rules(spark):
    names = spark.createDataFrame(
        [("o/a", "tag", "v1.2", "c1"), ("o/a", "tag", "v2", "c2"), ("o/a", "tag", "v1.3.0", "c3"),
         ("o/b", "branch", "v5", "c5"), ("o/c", "tag", "release-3", "c6"), ("o/c", "branch", "release-9", "c7")],
        "repo string, kind string, name string, commit_sha string")
    q = spark.createDataFrame([("o/a", "v1"), ("o/a", "v1.2"), ("o/b", "v4"), ("o/c", "release-2"), ("o/a", "main")],
                              "repo string, ref string")
    plain = {(r.repo, r.ref): r.latest for r in RF.latest_refs(q, names).collect()}
    assert plain == {("o/a", "v1"): "v2", ("o/a", "v1.2"): "v2", ("o/b", "v4"): "v5", ("o/c", "release-2"): "release-3"}
    exp = {(r.repo, r.ref): r.latest for r in RF.latest_refs(q, names, expand=True).collect()}
    assert exp[("o/a", "v1")] == "v1.3.0"


def test_rename_drops_comment(spark):
    sha = "ab" * 20
    files = spark.createDataFrame([("w.yml", f"  - uses: old/x@{sha} # v1\n  - uses: keep/y@v1 # c\n")],
                                  "path string, content string")
    plan = spark.createDataFrame([], "repo string, ref string, latest_tag string, latest_sha string")
    renames = spark.createDataFrame([("old/x", "new/x")], "old_path string, new_path string")
    texts, changes = RF.rewrite_refs(files, plan, renames)
    assert texts.first().new_text == f"  - uses: new/x@{sha}\n  - uses: keep/y@v1 # c\n"
    assert [tuple(r) for r in changes.collect()] == [("w.yml", 0, "old/x", sha, f"new/x@{sha}")]


def test_select_artifacts_first_by_position(spark):
    arts = spark.createDataFrame([(1, "b", "u2", 1), (1, "a", "u1", 0), (2, "c", "u3", 0)],
                                 "run_number bigint, name string, archive_download_url string, position bigint")
    assert sorted(tuple(r) for r in RU.select_artifacts(arts).collect()) == [(1, "a", "u1"), (2, "c", "u3")]
    assert RU.select_artifacts(arts, ["b"]).count() == 1


def test_changelog_lines_give_the_document(spark):
    from repolens.plans.fixtures import load

    prs, tags = load(spark, "/root/testdata/sf0.001", "pull_requests"), load(spark, "/root/testdata/sf0.001", "tags")
    docs = {(r.repo, r.from_tag, r.to_tag): r.changelog for r in CL.changelog_document(prs, tags).collect()}
    lines = CL.changelog_lines(prs, tags).orderBy(*CL.ORDER).collect()
    built = {}
    for r in lines:
        built.setdefault((r.repo, r.from_tag, r.to_tag), []).append(r.line)
    assert {k: "\n".join(v) for k, v in built.items()} == docs


def test_bisect_scan_mode(spark):
    rows = [("p", f"1.{i}", ok) for i, ok in enumerate([True, True, False, True, False, False])]
    results = spark.createDataFrame(rows, "package string, version string, passed boolean")
    ranges = spark.createDataFrame([("p", "1.0", "1.5"), ("p", "1.3", "1.2"), ("p", "1.1", "1.2")],
                                   "package string, good_version string, bad_version string")
    out = {(r.good_version, r.bad_version): (r.monotone, r.scan_failing_version, r.direction)
           for r in BI.version_regressions(results.select("package", "version"), results, ranges).collect()}
    assert out == {("1.0", "1.5"): (False, "1.2", "forward"), ("1.3", "1.2"): (True, "1.2", "reverse"),
                   ("1.1", "1.2"): (True, "1.2", "forward")}


def test_tag_dates_from_commits(spark):
    tags = spark.createDataFrame([("r", "v1", False, "a"), ("r", "v2", False, "b")],
                                 "repo string, tag string, prerelease boolean, sha string")
    commits = spark.createDataFrame([("r", "a", T0), ("r", "b", T0 + dt.timedelta(days=1))],
                                    "repo string, sha string, committed_at timestamp_ntz")
    changes = spark.createDataFrame([("r", "a", 5, T0 + dt.timedelta(hours=2)), ("r", "a", 3, T0 + dt.timedelta(hours=1))],
                                    "repo string, sha string, number bigint, merged_at timestamp_ntz")
    got = {r.tag: r.tagged_at for r in CL.tag_dates(tags, commits, changes).collect()}
    assert got == {"v1": T0 + dt.timedelta(hours=1), "v2": T0 + dt.timedelta(days=1)}


def test_unresolved_hash_updates_are_left_alone(spark):
    sha = "ab" * 20
    refs = spark.createDataFrame([("o/a", sha, True, "v1")], "repo string, ref string, is_sha boolean, tag string")
    names = spark.createDataFrame([("o/a", "tag", "v1", sha), ("o/b", "tag", "v2", "x")],
                                  "repo string, kind string, name string, commit_sha string")
    # v2 is a tag of another repository: o/a has no commit for it
    names2 = names.unionByName(spark.createDataFrame([("o/a", "tag", "v2", None)],
                                                     "repo string, kind string, name string, commit_sha string"))
    strict = RF.plan_ref_updates(refs, names2).first()
    loose = RF.plan_ref_updates(refs, names2, loosen_unresolved=True).first()
    assert (strict.latest_tag, strict.latest_sha) == (None, None)
    assert (loose.latest_tag, loose.latest_sha) == ("v2", None)
    assert [tuple(r) for r in RF.unresolved_updates(refs, names2).collect()] == [("o/a", sha, "v1", "v2")]


def test_default_and_chosen_windows(spark):
    tags = spark.createDataFrame(
        [("r", "v3rc", True, 0, T0 + dt.timedelta(days=9)), ("r", "v2", False, 1, T0 + dt.timedelta(days=5)),
         ("r", "v1", False, 2, T0)],
        "repo string, tag string, prerelease boolean, api_order bigint, committed_at timestamp_ntz") \
        .withColumn("pr_merged_at", F.lit(None).cast("timestamp_ntz"))
    head = spark.createDataFrame([("r", "main", T0 + dt.timedelta(days=10))], "repo string, head string, head_at timestamp_ntz")
    w = CL.release_windows(tags, head).first()
    assert (w.from_tag, w.to_tag) == ("v2", "main")
    pairs = spark.createDataFrame([("r", "v1", "v3rc")], "repo string, from_tag string, to_tag string")
    c = CL.chosen_windows(tags, pairs).first()
    assert (c.from_at, c.to_at) == (T0, T0 + dt.timedelta(days=9))


def test_deprecations_that_cannot_be_judged_are_listed(spark):
    from repolens.operators import deprecations as DPC

    sources = spark.createDataFrame(
        [("p", "a.py", "deprecated('1.0')\ndeprecated('soon')\n"), ("p", "b.py", "deprecated(since='1.0')\n"),
         ("p", "c.py", "deprecated('1.0'\n"), ("p", "d.py", "x.deprecated('1.0')\n")],
        "package string, path string, content string")
    found = DPC.overdue_deprecations(sources, spark.createDataFrame([("p", "1.2.0")], "package string, version string"))
    assert sorted((r.path, r.status, r.overdue) for r in found.collect()) == [
        ("a.py", "not a version", False), ("a.py", "ok", True), ("b.py", "no constant", False), ("c.py", "unparsable", False)]
    assert DPC.deprecation_summary(found).first().asDict() == {"package": "p", "calls": 1, "overdue": 1, "undecided": 3}


def test_first_contribution_is_the_first_created_change(spark):
    changes = spark.createDataFrame([("r", 1, "x", "2024-03-05"), ("r", 2, "x", "2024-02-05")],
                                    "repo string, number long, author string, merged_at string")
    people = spark.createDataFrame([("r", "a", "b", "2024-03-01", "x")],
                                   "repo string, from_tag string, to_tag string, from_at string, login string")
    assert CL.first_contributions(changes, people).first().is_new


def test_no_environment_file_gives_no_row(spark):
    files = spark.createDataFrame([("good", "a/macos.txt")], "side string, path string")
    assert RU.match_env_files(files, "linux", "3.11", "unit").count() == 0


def test_dependency_names_meet_in_the_normal_form(spark):
    from repolens.operators import dependencies as DP

    req = spark.createDataFrame([("m", "PyYAML>=5", "project"), ("m", "graphviz", "index")],
                                "main_package string, requirement string, kind string")
    assert {r.package for r in DP.dependency_names(req).collect()} == {"PyYAML", "graphviz"}
    names = spark.createDataFrame([("My_Pkg..x",), ("pyyaml",), ("PyYAML",)], "package string")
    assert [r[0] for r in names.select(DP.normal_name("package")).collect()] == ["my-pkg-x", "pyyaml", "pyyaml"]


def test_equal_paths_of_two_checkouts_stay_apart(spark):
    sha = "ab" * 20
    files = spark.createDataFrame([("a", "ci.yml", f"- uses: o/x@{sha} # v1\n- uses: o/z@v1\n"), ("b", "ci.yml", f"- uses: o/x@{sha}\n")],
                                  "checkout string, path string, content string")
    names = spark.createDataFrame([("o/x", "tag", "v2", "cd" * 20), ("o/z", "tag", "v3", "ef" * 20)],
                                  "repo string, kind string, name string, commit_sha string")
    out = RF.workflow_updates(files, names, keys=("checkout",))
    assert [tuple(r) for r in out["texts"].select("checkout", "path", "new_text").collect()] == [
        ("a", "ci.yml", f"- uses: o/x@{'cd' * 20} # v2\n- uses: o/z@v3\n")]
    assert [tuple(r) for r in out["unpinnable"].collect()] == [("b", "o/x", sha)]


def test_file_lists_compare_the_picked_archives(spark):
    rows = [("good", "wheel", "a-1.0.0-py3-none-any.whl", "a-1.0.0/x"), ("bad", "wheel", "a-1.0.1-py3-none-any.whl", "a-1.0.1/x"),
            ("good", "wheel", "b-1.0.0-py3-none-any.whl", "only in b"), ("good", "npm", "a-1.0.0.tgz", "one side"),
            ("bad", "wheel", "a-1.0.1-py3-none-any.whl", "new")]
    members = spark.createDataFrame(rows, "side string, format string, archive string, member string")
    assert [tuple(r) for r in DF.file_list_diff(members).collect()] == [("bad", "wheel", "new")]
    listed = members.select("side", "format", "archive").distinct()
    assert [tuple(r) for r in DF.file_list_diff(members, archives=listed).collect()] == [("bad", "wheel", "new")]


def test_bisect_probes_equal_a_loop_over_long_catalogues(spark, monkeypatch):
    """Two and more joins of halvings: the same probes as the plain loop, on results that are not monotone."""
    rng = random.Random(9)
    n = 700
    passed = {p: [rng.random() < 0.6 for _ in range(n)] for p in "abc"}
    ranges, want = [], {}
    for p, ok in passed.items():
        ok[0], ok[-1] = True, False
        for _ in range(6):
            g, b = rng.choice([i for i in range(n) if ok[i]]), rng.choice([i for i in range(n) if not ok[i]])
            step = 1 if g < b else -1
            lo, hi, probes = 0, abs(b - g), 0
            while hi - lo > 1:
                mid, probes = (lo + 1 + hi + 1) // 2 - 1, probes + 1
                lo, hi = (mid, hi) if ok[g + step * mid] else (lo, mid)
            ranges.append((p, f"1.{g}", f"1.{b}"))
            want[p, f"1.{g}", f"1.{b}"] = (f"1.{g + step * hi}", f"1.{g + step * lo}", probes)
    results = spark.createDataFrame([(p, f"1.{i}", x) for p, ok in passed.items() for i, x in enumerate(ok)],
                                    "package string, version string, passed boolean")
    ranges = spark.createDataFrame(sorted(set(ranges)), "package string, good_version string, bad_version string")
    for steps in (3, 8):
        monkeypatch.setattr(BI, "STEPS", steps)
        out = BI.version_regressions(results.select("package", "version"), results, ranges).collect()
        assert {(r.package, r.good_version, r.bad_version): (r.failing_version, r.passing_version, r.probes) for r in out} == want
