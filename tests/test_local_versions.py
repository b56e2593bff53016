"""Versions with local labels against packaging: order, normal form, specifiers; versions that are no numbers."""

import random

from packaging.specifiers import SpecifierSet
from packaging.version import Version

from repolens.functions import versions as V
from repolens.operators import bisect as BI

RNG = random.Random(11)


def version():
    pick = RNG.choice
    local = "".join(pick(["1", "2", "10", "010", "abc", "ABC", "a1", "0", "00", "z"]) + pick([".", "-", "_"]) for _ in range(RNG.randrange(4)))[:-1]
    return (pick(["", "", "1!"]) + pick(["1", "1.0", "1.1", "2.0.0"]) + pick(["", "", "a1", "rc2"]) + pick(["", "", ".post1", ".post2"])
            + pick(["", "", ".dev1"]) + (f"+{local}" if local else ""))


def test_order_and_normal_form_equal_packaging(spark):
    many = sorted({version() for _ in range(160)} | {"1.0+1", "1.0+abc.10", "1.0+abc.2", "1.0+abc", "1.0+abc.abc", "1.0", "1.0+99999999999999999999"})
    rows = spark.createDataFrame([(v,) for v in many], "v string").select("v", V.version_key("v").alias("k"), V.normalize_version("v").alias("n"))
    order = [r.v for r in rows.orderBy("k", "v").collect()]
    assert order == sorted(many, key=lambda v: (Version(v), v))
    assert all(r.n == str(Version(r.v)) for r in rows.collect())
    a, b = rows.select("v", "k").toDF("v", "kv"), rows.select("v", "k").toDF("w", "kw")
    for r in a.crossJoin(b).select("v", "w", (a.kv < b.kw).alias("lt"), (a.kv == b.kw).alias("eq")).collect():
        assert (Version(r.v) < Version(r.w), Version(r.v) == Version(r.w)) == (r.lt, r.eq), (r.v, r.w)


def test_specifiers_equal_packaging(spark):
    cases = set()
    while len(cases) < 1200:
        op = RNG.choice(["==", "!=", "<=", ">=", "<", ">", "~="])
        text = version() if op in ("==", "!=") else version().split("+")[0]
        if op == "~=" and "." not in text.split("!")[-1].split("a")[0].split("r")[0]:
            continue
        try:
            SpecifierSet(op + text)
        except ValueError:
            continue
        cases.add((op + text, version()))
    rows = spark.createDataFrame(sorted(cases), "s string, v string").select("s", "v", V.specifier_contains("s", "v").alias("ok")).collect()
    for r in rows:
        spec = SpecifierSet(r.s)
        allowed = bool(spec.prereleases)
        want = spec.contains(r.v, prereleases=True) and (allowed or not Version(r.v).is_prerelease)
        assert r.ok == want, (r.s, r.v)


def test_versions_that_are_no_numbers(spark):
    assert [r[0] for r in spark.createDataFrame([("1.0",), (" 1 . 2 ",), ("1.x",), ("1.0rc1",), ("",), (None,)], "v string").select(
        V.is_dotted("v")).collect()] == [True, True, False, False, False, False]
    versions = spark.createDataFrame([("p", v) for v in ("1.0", "1.1", "1.x", "2.0", "2.0rc1")], "package string, version string")
    results = spark.createDataFrame([("p", "1.0", True), ("p", "1.x", True), ("p", "1.1", True)], "package string, version string, passed boolean")
    ranges = spark.createDataFrame([("p", "1.0", "2.0"), ("p", "1.x", "2.0"), ("p", "1.0", "2.0rc1"), ("p", "1.0", "3.0")],
                                   "package string, good_version string, bad_version string")
    got = {(r.good_version, r.bad_version): (r.status, r.failing_version, r.passing_version)
           for r in BI.version_regressions(versions, results, ranges).collect()}
    assert got == {("1.0", "2.0"): ("ok", "2.0", "1.1"), ("1.x", "2.0"): ("good version is not numeric", None, None),
                   ("1.0", "2.0rc1"): ("bad version is not numeric", None, None), ("1.0", "3.0"): ("bad version not found", None, None)}
