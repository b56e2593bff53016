"""Version column functions (V1-V10, V23), all native Spark expressions.

PEP 440 versions become a comparable struct (``version_key``): Spark orders
structs field by field and arrays element by element, so ``min``/``max``/
``min_by``/``orderBy`` over the key give PEP 440 order without any Python.
"""

from __future__ import annotations

import copy

from pyspark.sql import Column
from pyspark.sql import functions as F

from repolens.functions.fixed_values import PRE_LETTERS

# Public PEP 440 grammar (PEP 440, appendix B), with numbered groups:
# 1 epoch, 2 release, 3 pre letter, 4 pre number, 5 implicit post number,
# 6 post letter, 7 post number, 8 dev letter, 9 dev number, 10 local.
PEP440 = (
    r"(?i)^\s*v?(?:([0-9]+)!)?([0-9]+(?:\.[0-9]+)*)"
    r"(?:[-_.]?(alpha|beta|preview|pre|rc|a|b|c)[-_.]?([0-9]+)?)?"
    r"(?:-([0-9]+)|[-_.]?(post|rev|r)[-_.]?([0-9]+)?)?"
    r"(?:[-_.]?(dev)[-_.]?([0-9]+)?)?"
    r"(?:\+([a-z0-9]+(?:[-_.][a-z0-9]+)*))?\s*$"
)

_MAX = 9223372036854775807


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _num(c: Column) -> Column:
    """Digits to bigint; empty text gives null (ANSI-safe)."""
    return F.when(c != "", c.try_cast("bigint"))


_FIELDS = ["epoch", "release", "pre_l", "pre_n", "post_n1", "post_l", "post_n2", "dev_l", "dev_n", "local"]


def version_parts(c) -> Column:
    """The raw PEP 440 groups of a version as one struct (each regex run once).

    Put it in its own column (``withColumn``) and pass that column to the other
    functions with ``parts=True``: Spark keeps a projection that would repeat
    an expensive expression, so every later use reads the stored groups.
    """
    c = _col(c)
    return F.struct(c.rlike(PEP440).alias("valid"),
                    *[F.regexp_extract(c, PEP440, i + 1).alias(f) for i, f in enumerate(_FIELDS)])


class _Parts:
    """Pieces of a PEP 440 version held as column expressions."""

    def __init__(self, c, parts: bool = False):
        c = _col(c)
        if parts:
            self.valid = c["valid"]

            def g(i):
                return c[_FIELDS[i - 1]]
        else:
            self.valid = c.rlike(PEP440)

            def g(i):
                return F.regexp_extract(c, PEP440, i)

        self.epoch = F.coalesce(_num(g(1)), F.lit(0))
        self.release_text = g(2)
        letter = F.lower(g(3))
        self.has_pre = letter != ""
        self.pre_letter = (F.when(letter.isin("a", "alpha"), "a")
                           .when(letter.isin("b", "beta"), "b")
                           .when(self.has_pre, "rc"))
        self.pre_n = F.when(self.has_pre, F.coalesce(_num(g(4)), F.lit(0)))
        post1, post_l = g(5), g(6)
        self.has_post = (post1 != "") | (post_l != "")
        self.post = (F.when(post1 != "", _num(post1))
                     .when(post_l != "", F.coalesce(_num(g(7)), F.lit(0))))
        self.has_dev = g(8) != ""
        self.dev = F.when(self.has_dev, F.coalesce(_num(g(9)), F.lit(0)))
        # segments of the local label: numbers lose leading zeros, text is lower case
        self.local = F.regexp_replace(F.lower(F.regexp_replace(g(10), r"[-_]", ".")), r"(?<![^.])0+(?=[0-9]+(\.|$))", "")
        self.release = F.transform(F.split(self.release_text, r"\."), lambda x: x.try_cast("bigint"))

    def release_at(self, i: int) -> Column:
        return F.coalesce(F.try_element_at(self.release, F.lit(i)), F.lit(0))

    def first_dev(self) -> "_Parts":
        """The same version as its first development release."""
        other = copy.copy(self)
        other.has_dev, other.dev = F.lit(True), F.lit(0).cast("bigint")
        return other

    def key(self, with_local: bool = True) -> Column:
        stripped = F.transform(
            F.split(F.regexp_replace(self.release_text, r"(\.0+)+$", ""), r"\."),
            lambda x: x.try_cast("bigint"))
        pre_rank = (F.when(self.pre_letter == "a", 0).when(self.pre_letter == "b", 1)
                    .when(self.has_pre, 2)
                    .when(~self.has_post & self.has_dev, -1)
                    .otherwise(3))
        fields = [
            self.epoch.alias("epoch"),
            stripped.alias("release"),
            pre_rank.alias("pre"),
            F.coalesce(self.pre_n, F.lit(0)).alias("pre_n"),
            F.coalesce(self.post, F.lit(-1)).alias("post"),
            F.coalesce(self.dev, F.lit(_MAX)).alias("dev"),
        ]
        if with_local:
            # no label sorts before any, text before numbers, a label before the same label with more segments
            fields.append(F.when(self.local == "", F.array().cast("array<struct<n:decimal(38,0),t:string>>")).otherwise(F.transform(
                F.split(self.local, r"\."), lambda x: F.struct(
                    F.when(x.rlike("^[0-9]+$"), x.try_cast("decimal(38,0)")).otherwise(F.lit(-1).cast("decimal(38,0)")).alias("n"),
                    F.when(x.rlike("^[0-9]+$"), "").otherwise(x).alias("t")))).alias("local"))
        return F.when(self.valid, F.struct(*fields))

    def normal(self) -> Column:
        release = F.array_join(F.transform(self.release, lambda x: x.cast("string")), ".")
        return F.when(self.valid, F.concat(
            F.when(self.epoch != 0, F.concat(self.epoch.cast("string"), F.lit("!"))).otherwise(""),
            release,
            F.when(self.has_pre, F.concat(self.pre_letter, self.pre_n.cast("string"))).otherwise(""),
            F.when(self.has_post, F.concat(F.lit(".post"), self.post.cast("string"))).otherwise(""),
            F.when(self.has_dev, F.concat(F.lit(".dev"), self.dev.cast("string"))).otherwise(""),
            F.when(self.local != "", F.concat(F.lit("+"), self.local)).otherwise(""),
        ))

    def base(self) -> Column:
        release = F.array_join(F.transform(self.release, lambda x: x.cast("string")), ".")
        return F.when(self.valid, F.concat(
            F.when(self.epoch != 0, F.concat(self.epoch.cast("string"), F.lit("!"))).otherwise(""),
            release))


# ---------------------------------------------------------------- V1


def version_key(c, with_local: bool = True, parts: bool = False) -> Column:
    """V1: PEP 440 ordering key; null for text that is not a version."""
    return _Parts(c, parts).key(with_local)


def is_version(c) -> Column:
    return _col(c).rlike(PEP440)


def is_prerelease(c, parts: bool = False) -> Column:
    """True for versions with a pre or dev part (dev releases count as pre-releases)."""
    p = _Parts(c, parts)
    return F.when(p.valid, p.has_pre | p.has_dev)


def normalize_version(c, parts: bool = False) -> Column:
    """The normal form of a version, as ``str(Version(c))`` prints it."""
    return _Parts(c, parts).normal()


def release_part(c, i: int) -> Column:
    """major (1), minor (2), micro (3) of a version; 0 when absent."""
    p = _Parts(c)
    return F.when(p.valid, p.release_at(i))


# ---------------------------------------------------------------- V2


def dotted_key(c) -> Column:
    """V2: integer-tuple key, trailing zeros kept (``1.0 < 1.0.0``); see ``is_dotted`` for text that has none."""
    return F.transform(F.split(F.trim(_col(c)), r"\."), lambda x: F.trim(x).try_cast("bigint"))


def is_dotted(c) -> Column:
    """Are all parts of a version whole numbers, so that ``dotted_key`` orders it?"""
    return F.coalesce(F.forall(dotted_key(c), lambda x: x.isNotNull()), F.lit(False))


# ---------------------------------------------------------------- V3

_SPEC_ITEM = r"^\s*(~=|===|==|!=|<=|>=|<|>)\s*(\S*)\s*$"


def specifier_contains(spec, version) -> Column:
    """V3: does ``version`` satisfy the specifier list ``spec``?

    A null spec allows everything. ``.*`` is removed first, so ``==3.10.*`` acts
    as ``==3.10``. ``~=`` is a lower bound plus a release prefix match. A
    pre-release version is only allowed when some item but ``!=`` names a pre-release.
    ``<`` allows no pre-release of its own version, ``>`` no post-release. A
    local label of ``version`` counts only where ``==`` or ``!=`` names one; no
    other operator may name a label.
    """
    spec, version = _col(spec), _col(version)
    v = _Parts(version)
    kv = v.key(with_local=False)
    items = F.filter(F.transform(F.split(F.replace(spec, F.lit(".*"), F.lit("")), ","),
                                 lambda x: F.trim(x)),
                     lambda x: x != "")

    def one(item: Column) -> Column:
        op = F.regexp_extract(item, _SPEC_ITEM, 1)
        text = F.regexp_extract(item, _SPEC_ITEM, 2)
        s = _Parts(text)
        ks = s.key(with_local=False)
        labelled = s.local != ""
        equal = F.when(labelled, (kv == ks) & (v.local == s.local)).otherwise(kv == ks)
        same_release = (F.regexp_replace(v.release_text, r"(\.0+)+$", "")
                        == F.regexp_replace(s.release_text, r"(\.0+)+$", "")) & (v.epoch == s.epoch)
        prefix_len = F.size(s.release) - 1
        compatible = (kv >= ks) & (prefix_len >= 1) & (v.epoch == s.epoch) & F.forall(
            F.sequence(F.lit(1), F.greatest(prefix_len, F.lit(1))),
            lambda i: F.coalesce(F.try_element_at(v.release, i), F.lit(0))
            == F.try_element_at(s.release, i))
        result = (
            F.when(op == "===", F.lower(version) == F.lower(text))
            .when(~s.valid, F.lit(False))
            .when(op == "==", equal)
            .when(op == "!=", ~equal)
            .when(labelled, F.lit(False))
            .when(op == ">=", kv >= ks)
            .when(op == "<=", kv <= ks)
            .when(op == "<", F.when(s.has_pre | s.has_dev, kv < ks).otherwise(kv < s.first_dev().key(with_local=False)))
            .when(op == ">", (kv > ks) & ~(v.has_post & ~s.has_post & ~s.has_dev & same_release
                                           & v.pre_letter.eqNullSafe(s.pre_letter) & v.pre_n.eqNullSafe(s.pre_n)))
            .when(op == "~=", compatible)
            .otherwise(F.lit(False)))
        return F.coalesce(result, F.lit(False))

    names_pre = F.exists(items, lambda x: (F.regexp_extract(x, _SPEC_ITEM, 1) != "!=")
                         & F.coalesce(is_prerelease(F.regexp_extract(x, _SPEC_ITEM, 2)), F.lit(False)))
    allowed = F.forall(items, one) & (~(v.has_pre | v.has_dev) | names_pre)
    return F.when(spec.isNull(), F.lit(True)).otherwise(F.when(v.valid, allowed).otherwise(F.lit(False)))


# ---------------------------------------------------------------- V4


WHEEL_NAME = r"^([^-]*)-([^-]*)(?:-[^-]*)?-[^-]*-[^-]*-[^-]*\.whl$"
SDIST_NAME = r"^(.*)-([^-]*)(?:\.tar\.gz|\.zip)$"


def parse_dist_filename(c) -> Column:
    """V4: struct(name, version) from a wheel or source archive name; null otherwise.

    Wheels: ``name-version[-build]-py-abi-platform.whl`` (4 or 5 dashes).
    Source archives: ``.tar.gz`` or ``.zip``, version after the last dash.
    The version must parse. Two anchored extracts per row: small enough that
    Catalyst may copy it into a pushed-down filter without cost.
    """
    c = _col(c)
    name = F.when(c.rlike(WHEEL_NAME), F.regexp_extract(c, WHEEL_NAME, 1)) \
        .otherwise(F.when(c.rlike(SDIST_NAME), F.regexp_extract(c, SDIST_NAME, 1)))
    version = F.when(c.rlike(WHEEL_NAME), F.regexp_extract(c, WHEEL_NAME, 2)) \
        .otherwise(F.when(c.rlike(SDIST_NAME), F.regexp_extract(c, SDIST_NAME, 2)))
    ok = (name != "") & is_version(version)
    return F.when(ok, F.struct(name.alias("name"), version.alias("version")))


# version part of a wheel (4 or 5 dashes) or source archive name, one group for both
DIST_VERSION = (r"^(?:[^-]+-(?=[^-]*(?:-[^-]*)?-[^-]*-[^-]*-[^-]*\.whl$)"
                r"|.+-(?=[^-]*(?:\.tar\.gz|\.zip)$))([^-]*?)(?=-|\.tar\.gz$|\.zip$)")


def dist_version_text(c) -> Column:
    """The version part of a wheel or source archive name, unvalidated ('' when the name has no such part)."""
    return F.regexp_extract(_col(c), DIST_VERSION, 1)


def dist_version(c) -> Column:
    """The version text of a wheel or source archive name (V4); null when it does not parse.

    One extract reads the input once, so the column stays small even where
    Catalyst inlines an upstream expression for ``c``.
    """
    v = F.regexp_extract(_col(c), DIST_VERSION, 1)
    return F.when(is_version(v), v)


# ---------------------------------------------------------------- V5, V6


def requirement_name(c) -> Column:
    """V5: distribution name at the start of a requirement string."""
    name = F.regexp_extract(_col(c), r"^\s*([A-Za-z0-9](?:[A-Za-z0-9._-]*[A-Za-z0-9])?)", 1)
    return F.when(name != "", name)


def base_version(c) -> Column:
    """V6: version without pre, post, dev and local parts, normalised."""
    return _Parts(c).base()


# ---------------------------------------------------------------- V7-V10


def _bump_parts(major, minor, micro, letter, n, part):
    if part == "major":
        return major + 1, F.lit(0), F.lit(0), None, None
    if part == "minor":
        return major, minor + 1, F.lit(0), None, None
    if part == "patch":
        return major, minor, micro + 1, None, None
    if part in PRE_LETTERS:
        if letter is None:
            return major, minor, micro, F.lit(part), F.lit(0)
        same = F.coalesce(letter == part, F.lit(False))
        return major, minor, micro, F.lit(part), F.when(same, n + 1).otherwise(F.lit(0))
    if part is None:
        return major, minor, micro, None, None
    raise ValueError(f"invalid part: {part!r}")


def _render(major, minor, micro, letter, n) -> Column:
    text = F.concat(F.lit("v"), major.cast("string"), F.lit("."), minor.cast("string"), F.lit("."),
                    micro.cast("string"))
    if letter is None:
        return text
    return F.concat(text, letter, n.cast("string"))


def bump(c, part: str | None) -> Column:
    """V7: bump ``major``, ``minor``, ``patch``, ``a``, ``b``, ``rc`` or finalise (None).

    The same pre letter counts up, another starts at 0; bumping a number clears
    the pre part. Output ``vX.Y.Z[preN]``, always three numbers.
    """
    p = _Parts(c)
    parts = _bump_parts(p.release_at(1), p.release_at(2), p.release_at(3), p.pre_letter, p.pre_n, part)
    return F.when(p.valid, _render(*parts))


def next_candidates(c) -> Column:
    """V8: proposed next versions.

    From a pre-release: the letters from the current one on, then final.
    From a final: patch/minor/major, each as a, b, rc and final (12).
    """
    p = _Parts(c)
    cur = (p.release_at(1), p.release_at(2), p.release_at(3), p.pre_letter, p.pre_n)
    from_pre = F.array(*[_render(*_bump_parts(*cur, part)) for part in [*PRE_LETTERS, None]])
    start = (F.when(p.pre_letter == "a", 1).when(p.pre_letter == "b", 2).otherwise(3))
    finals = []
    for first in ["patch", "minor", "major"]:
        major, minor, micro, _, _ = _bump_parts(*cur, first)
        for second in [*PRE_LETTERS, None]:
            finals.append(_render(*_bump_parts(major, minor, micro, None, None, second)))
    return F.when(p.valid, F.when(p.has_pre, F.slice(from_pre, start, F.lit(5) - start))
                  .otherwise(F.array(*finals)))


def npm_version(c) -> Column:
    """V9: npm form of a tag: no leading ``v``, ``rc1`` -> ``-rc.1``."""
    return F.regexp_replace(F.regexp_replace(_col(c), r"^v", ""), r"(a|b|rc)", "-$1.")


def canonical_tag(c) -> Column:
    """Tag text: full normal form with a pre part, else three numbers; invalid -> null."""
    p = _Parts(c)
    three = _render(p.release_at(1), p.release_at(2), p.release_at(3), None, None)
    return F.when(p.valid, F.when(p.has_pre, F.concat(F.lit("v"), p.normal())).otherwise(three))


# ---------------------------------------------------------------- V23


def python_floor_text(c) -> Column:
    """V23 (row part): ``>=3.9`` -> ``3.9``; feature key ``py310`` -> ``3.10``."""
    c = _col(c)
    return F.when(c.startswith("py3"), F.replace(c, F.lit("py3"), F.lit("3."))).otherwise(
        F.replace(c, F.lit(">="), F.lit("")))


def python_floor(c) -> Column:
    """V23 (aggregate): least interpreter version, by version order."""
    text = python_floor_text(c)
    return F.min_by(text, F.struct(version_key(text), text))
