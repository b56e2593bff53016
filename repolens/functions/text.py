"""Text column functions (V11-V22), all native Spark expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from repolens.functions.fixed_values import (
    ARCHIVE_VERSION, CHANGE_LINE, COMMENT_TAG, PRE_RELEASE_IN_TEXT, SHA_PATTERN, USES_PATTERN)


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


# ---------------------------------------------------------------- V11

# Characters a Python-style regex escape marks with a backslash.
_ESCAPE_CLASS = r"([()\[\]{}?*+\-|^$\\.&~# \t\n\r\x0B\f])"


def archive_version_text(archive, fmt, npm_prefix: str | None = None) -> Column:
    """Name-and-version text of an archive, with packaging suffixes removed.

    ``fmt`` is one of ``wheel``, ``sdist``, ``conda1`` (``.tar.bz2``),
    ``conda`` (``.conda``), ``npm`` (``.tgz``). ``npm_prefix`` is the scope
    prefix npm archives carry, removed when present.
    """
    archive, fmt = _col(archive), _col(fmt)
    wheel = F.substring_index(F.substring_index(archive, "-py3", 1), "-py2", 1)
    no_core = F.replace(archive, F.lit("-core"), F.lit(""))
    tar = F.substring_index(F.substring_index(F.substring_index(no_core, ".tar", 1), "-py_0", 1),
                            ".tgz", 1)
    if npm_prefix:
        tar = F.when(tar.startswith(npm_prefix), F.substring(tar, len(npm_prefix) + 1, 1 << 30)) \
            .otherwise(tar)
    conda = F.substring_index(F.substring_index(no_core, ".conda", 1), "-py_0", 1)
    return (F.when(fmt == "wheel", wheel)
            .when(fmt.isin("sdist", "conda1", "npm"), tar)
            .when(fmt == "conda", conda))


def version_patterns(version_text) -> tuple[Column, Column]:
    """The two patterns that find an archive's own version inside member names.

    ``plain``: the leading ``word.N.N.N`` text, separators matching any
    character. ``loose``: the whole text escaped, ``-`` matching any character
    and an optional separator allowed around ``rc``/``a``/``b``. ``plain`` is
    null when the text has no three-number version.
    """
    v = _col(version_text)
    plain = F.replace(F.regexp_extract(v, "(?U)" + ARCHIVE_VERSION, 0), F.lit("-"), F.lit("."))
    escaped = F.regexp_replace(v, _ESCAPE_CLASS, r"\\$1")
    loose = F.regexp_replace(escaped, "(?U)" + PRE_RELEASE_IN_TEXT, r"$1\\-?$2\\.?$3")
    loose = F.replace(loose, F.lit("\\-"), F.lit("."))
    return F.when(plain != "", plain), loose


def normalize_member(member, archive, fmt, npm_prefix: str | None = None) -> Column:
    """Replace the archive's own version by ``$VERSION`` in a member name."""
    plain, loose = version_patterns(archive_version_text(archive, fmt, npm_prefix))
    once = F.regexp_replace(_col(member), loose, r"\$VERSION")
    return F.when(plain.isNotNull(), F.regexp_replace(once, plain, r"\$VERSION"))


# ---------------------------------------------------------------- V12


def package_name(url) -> Column:
    """Package name of a file: the base name without its last two ``-`` parts."""
    base = F.element_at(F.split(_col(url), "/"), -1)
    parts = F.split(base, "-")
    return F.array_join(F.slice(parts, 1, F.greatest(F.size(parts) - 2, F.lit(0))), "-")


def file_basename(url) -> Column:
    return F.element_at(F.split(_col(url), "/"), -1)


# ---------------------------------------------------------------- V13


def split_change_title(line) -> Column:
    """struct(prefix, breaking) of a rendered change line; null prefix when no match."""
    line = _col(line)
    matched = line.rlike(CHANGE_LINE)
    prefix = F.when(matched, F.lower(F.regexp_extract(line, CHANGE_LINE, 1)))
    breaking = matched & (F.regexp_extract(line, CHANGE_LINE, 2) == "!")
    return F.struct(prefix.alias("prefix"), breaking.alias("breaking"))


# ---------------------------------------------------------------- V14


def ntz(value) -> Column:
    """A wall-clock timestamp (``timestamp_ntz``) from text, a datetime or a column.

    Literals go through text, so neither the Python nor the session time zone
    shifts them; columns of type ``timestamp`` are kept as they are.
    """
    if isinstance(value, Column):
        return value
    if isinstance(value, str) and not value[:1].isdigit():
        return F.col(value)
    return F.lit(str(value)).cast("timestamp_ntz")


def elapsed_minutes(start, as_of) -> Column:
    """``N min`` since ``start``, whole minutes rounded half to even."""
    micros = F.timestamp_diff("MICROSECOND", ntz(start), ntz(as_of))
    return F.format_string("%.0f min", F.bround(micros / 1e6 / 60.0, 0))


# ---------------------------------------------------------------- V15, V16, V17


def slug(c) -> Column:
    """Trim, keep letters, digits and spaces, spaces to ``_``."""
    trimmed = F.regexp_replace(_col(c), r"(?U)^\s+|\s+$", "")
    kept = F.regexp_replace(trimmed, r"[^\p{L}\p{N} ]", "")
    return F.translate(kept, " ", "_")


def leading_number(c) -> Column:
    """The leading digits of a name as text; null when there are none."""
    digits = F.regexp_extract(_col(c), r"(?U)^\d+", 0)
    return F.when(digits != "", digits)


def env_key(pkg, version, deps=None) -> Column:
    """``tmp_`` + SHA-256 of ``pkg=version`` and constraints joined by spaces."""
    parts = [F.concat(_col(pkg), F.lit("="), _col(version))]
    if deps is not None:
        parts.append(_col(deps))
    return F.concat(F.lit("tmp_"), F.sha2(F.concat_ws(" ", *parts), 256))


# ---------------------------------------------------------------- V18, V19, V20


def change_line(title, number, owner, repo) -> Column:
    """Markdown line of one merged change."""
    number = _col(number).cast("string")
    return F.concat(F.lit("- "), _col(title), F.lit(" ([#"), number, F.lit("](https://github.com/"),
                    _col(owner), F.lit("/"), _col(repo), F.lit("/pull/"), number, F.lit("))"))


def mention(login, is_new) -> Column:
    """Contributor mention, with a first-contribution note."""
    login = _col(login)
    base = F.concat(F.lit("[@"), login, F.lit("](https://github.com/"), login, F.lit(")"))
    return F.when(_col(is_new), F.concat(base, F.lit(" (first contribution)"))).otherwise(base)


def _pad(c: Column, width: int) -> Column:
    # rpad cuts longer text; pad only when shorter
    return F.when(F.length(c) < width, F.rpad(c, width, " ")).otherwise(c)


def run_label(number, conclusion, created_at, head_branch) -> Column:
    """``NNNNN conclusion     YYYY-MM-DD HH:MM    branch: name ``."""
    return F.concat(
        _pad(_col(number).cast("string"), 5), F.lit(" "),
        _pad(F.coalesce(_col(conclusion), F.lit("running")), 13), F.lit(" "),
        F.date_format(_col(created_at), "yyyy-MM-dd HH:mm"), F.lit("    branch: "),
        F.coalesce(_col(head_branch), F.lit("None")), F.lit(" "))


# ---------------------------------------------------------------- V21


def parse_ref_match(m) -> Column:
    """Fields of one ``uses:`` match: action path, repo, ref, comment, is_sha, tag."""
    m = _col(m)
    action_path = F.regexp_extract(m, USES_PATTERN, 2)
    ref = F.regexp_extract(m, USES_PATTERN, 3)
    comment = F.regexp_extract(m, USES_PATTERN, 4)
    is_sha = ref.rlike(SHA_PATTERN)
    tag = F.regexp_extract(comment, COMMENT_TAG, 1)
    return F.struct(
        m.alias("whole"),
        F.regexp_extract(m, USES_PATTERN, 1).alias("lead"),
        action_path.alias("action_path"),
        F.array_join(F.slice(F.split(action_path, "/"), 1, 2), "/").alias("repo"),
        ref.alias("ref"),
        comment.alias("comment"),
        is_sha.alias("is_sha"),
        F.when(is_sha & (tag != ""), tag).alias("tag"),
    )


def parse_refs(text) -> Column:
    """Array of reference structs found in a workflow text, in text order."""
    return F.transform(F.regexp_extract_all(_col(text), F.lit(USES_PATTERN), 0), parse_ref_match)


# ---------------------------------------------------------------- V22


def glob_to_regex(pattern: str, part: bool = True) -> str:
    """One path-part glob (``*``, ``?``, ``[...]``) as a Java regex.

    ``part=True``: anchored to a whole part. ``part=False``: the body only,
    with ``*``/``?`` unable to cross ``/``, for matching inside a full path.
    """
    star, one = (".*", ".") if part else ("[^/]*", "[^/]")
    out, i = [], 0
    while i < len(pattern):
        ch = pattern[i]
        if ch == "*":
            out.append(star)
        elif ch == "?":
            out.append(one)
        elif ch == "[":
            j = pattern.find("]", i + 2)
            if j == -1:
                out.append(r"\[")
            else:
                body = pattern[i + 1:j]
                if body.startswith("!"):
                    body = "^" + body[1:] + ("" if part else "/")
                out.append("[" + body.replace("\\", "\\\\") + "]")
                i = j
        else:
            out.append(re.escape(ch) if not ch.isalnum() else ch)
        i += 1
    body = "".join(out)
    return "^" + body + "$" if part else body


def glob_class(path, patterns: list[str]) -> Column:
    """The first pattern (in list order) that matches some part of ``path``.

    Each pattern is one anchored regex over the whole path (a part is bounded
    by ``/`` or the ends), so the test stays in generated code.
    """
    path = _col(path)
    hits = [F.when(path.rlike("(^|/)" + glob_to_regex(g, part=False) + "(/|$)"), F.lit(g)) for g in patterns]
    return F.coalesce(*hits)
