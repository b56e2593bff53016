"""Column functions against plain Python references."""

import random

from packaging.specifiers import SpecifierSet
from packaging.version import Version

from repolens.functions import text as X
from repolens.functions import versions as V

VERSIONS = ["1.0", "1.0.0", "1.0.0.0", "1.0a1", "1.0b2", "1.0rc1", "1.0.dev0", "1.0a1.dev1", "1.0.post1",
            "1.0-1", "1!0.5", "0.9", "1.1", "2.0rc", "1.0c1", "1.0alpha", "v1.2", "0", "0.0.1",
            "1.0.post1.dev2", "10.2.3", "1.10", "1.9.9"]


def test_version_key_orders_like_packaging(spark):
    rng = random.Random(7)
    extra = [f"{rng.randint(0, 3)}.{rng.randint(0, 12)}" + rng.choice(["", ".0", "rc1", "a2", ".post1", ".dev3", "b1"])
             for _ in range(40)]
    vs = sorted(set(VERSIONS + extra))
    rows = spark.createDataFrame([(v,) for v in vs], "v string").select(
        "v", V.version_key("v").alias("k"), V.normalize_version("v").alias("n"),
        V.base_version("v").alias("b"), V.is_prerelease("v").alias("p")).collect()
    keys = {r.v: tuple(r.k) for r in rows}
    for a in vs:
        for b in vs:
            assert (Version(a) < Version(b)) == (keys[a] < keys[b]), (a, b)
            assert (Version(a) == Version(b)) == (keys[a] == keys[b]), (a, b)
    for r in rows:
        assert r.n == str(Version(r.v))
        assert r.b == Version(r.v).base_version
        assert r.p == Version(r.v).is_prerelease


def test_specifier_contains(spark):
    cases = [(">=3.8", "3.10"), (">=3.9,<4", "3.10"), ("!=3.10.*,>=3.7", "3.10"), ("!=3.10.*,>=3.7", "3.11"),
             ("~=3.8", "3.10"), ("~=3.8.1", "3.9"), ("<3.10", "3.10"), ("==3.10.*", "3.10.0"), (">3.9", "3.10"),
             ("", "3.10"), (">= 3.6, <3.11", "3.10"), ("<=3.9", "3.9.0"), ("==3.10", "3.10.0")]
    rows = spark.createDataFrame(cases, "s string, v string").select(
        "s", "v", V.specifier_contains("s", "v").alias("ok")).collect()
    for r in rows:
        assert r.ok == SpecifierSet(r.s.replace(".*", "")).contains(r.v), (r.s, r.v)
    assert spark.createDataFrame([(None, "3.10")], "s string, v string").select(
        V.specifier_contains("s", "v")).first()[0] is True


def test_bump_candidates_are_greater(spark):
    tags = ["v1.2.3", "v0.1.0a1", "v2.0.0b0", "v1.0.0rc3", "v3.4"]
    rows = spark.createDataFrame([(t,) for t in tags], "t string").select(
        "t", V.next_candidates("t").alias("c"), V.canonical_tag("t").alias("canon")).collect()
    for r in rows:
        cur = Version(r.t)
        assert all(Version(c) > cur or (c == f"v{cur.base_version}" and cur.pre) for c in r.c), r
        assert len(r.c) == (12 if cur.pre is None else {"a": 4, "b": 3, "rc": 2}[cur.pre[0]])
    assert rows[0].c[:4] == ["v1.2.4a0", "v1.2.4b0", "v1.2.4rc0", "v1.2.4"]
    assert rows[3].c == ["v1.0.0rc4", "v1.0.0"]
    npm = spark.createDataFrame([("v1.2.0rc1",)], "t string").select(V.npm_version("t")).first()[0]
    assert npm == "1.2.0-rc.1"


def test_normalize_member_by_hand(spark):
    cases = [("lib-1.2.3rc1/f5.py", "lib-1.2.3rc1-py3-none-any.whl", "wheel", "$VERSION/f5.py"),
             ("pkg-0.10.1a2/x/pkg-0.10.1a2.txt", "pkg-0.10.1a2.tar.gz", "sdist", "$VERSION/x/$VERSION.txt"),
             ("site-packages/pkg-1.0.0.dist-info/RECORD", "pkg-core-1.0.0-py_0.conda", "conda",
              "site-packages/$VERSION.dist-info/RECORD"),
             ("package/x-1.0.0-rc.1.js", "x-1.0.0-rc.1.tgz", "npm", "package/$VERSION.js"),
             ("lib_x-2.0.0b1/a+b (1).py", "lib_x-2.0.0b1-py2.py3-none-any.whl", "wheel", "$VERSION/a+b (1).py")]
    rows = spark.createDataFrame(cases, "m string, a string, f string, want string").select(
        "want", X.normalize_member("m", "a", "f").alias("n")).collect()
    assert [r.n for r in rows] == [r.want for r in rows]


def test_text_functions(spark):
    df = spark.createDataFrame([("  Bug: en & more! ", "- fix: x", "a/__pycache__/tmp1.py", "42_x.py")],
                               "t string, l string, p string, n string")
    r = df.select(X.slug("t").alias("slug"), X.split_change_title("l").alias("c"),
                  X.glob_class("p", ["tmp*.py", "__pycache__"]).alias("g"), X.leading_number("n").alias("num")).first()
    assert r.slug == "Bug_en__more"
    assert r.c.prefix == "fix" and not r.c.breaking
    assert r.g == "tmp*.py"
    assert r.num == "42"
    sha = "ab" * 20
    text = f"steps:\n  - uses: org/act@v1 # note\n  - uses: org/act/sub@{sha}  # v2\n  - uses: ./local\n"
    refs = spark.createDataFrame([(text,)], "t string").select(X.parse_refs("t").alias("r")).first().r
    assert [(x.repo, x.ref, x.tag, x.is_sha) for x in refs] == [("org/act", "v1", None, False),
                                                                 ("org/act", sha, "v2", True)]


def test_version_key_property(spark):
    from hypothesis import given, settings
    from hypothesis import strategies as st

    part = st.integers(min_value=0, max_value=20)
    version = st.builds(
        lambda rel, pre, post, dev: ".".join(map(str, rel)) + pre + post + dev,
        st.lists(part, min_size=1, max_size=4),
        st.sampled_from(["", "a1", "b2", "rc0", "rc3", "alpha", "-beta.2", "c1"]),
        st.sampled_from(["", ".post1", "-3", ".post0", "post2"]),
        st.sampled_from(["", ".dev0", ".dev4", "dev"]))

    @settings(max_examples=100, deadline=None)
    @given(st.lists(version, min_size=2, max_size=25, unique=True))
    def check(vs):
        rows = spark.createDataFrame([(v,) for v in vs], "v string").select(
            "v", V.version_key("v").alias("k"), V.normalize_version("v").alias("n")).collect()
        keys = {r.v: tuple(r.k) for r in rows}
        for r in rows:
            assert r.n == str(Version(r.v))
        for a in vs:
            for b in vs:
                assert (Version(a) < Version(b)) == (keys[a] < keys[b]), (a, b)

    check()
