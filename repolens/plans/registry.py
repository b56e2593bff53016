"""Registered queries: each operator run over fixtures derived from the driver
tables, paired with an independent DuckDB SQL statement of the same result.

Every query reads its whole base tables. Outputs are flat columns; timestamps
are printed as text with microseconds so that both engines hash them alike.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from repolens.plans.fixtures import load, oracle_with


@dataclass
class Registered:
    name: str
    run: Callable[[SparkSession, str], DataFrame]
    oracle: str | None
    ids: str


REGISTRY: dict[str, Registered] = {}


def register(name: str, ids: str, oracle: str | None = None):
    def deco(fn):
        REGISTRY[name] = Registered(name, fn, oracle, ids)
        return fn
    return deco


def ts_text(c) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS")


def sql_ts(c: str) -> str:
    return f"strftime({c}, '%Y-%m-%d %H:%M:%S.%f')"


def fx(spark: SparkSession, sf_dir: str, *names: str) -> list[DataFrame]:
    return [load(spark, sf_dir, n) for n in names]


# ====================================================================== changelog

from repolens.operators import changelog as CL  # noqa: E402

_WINDOWS_SQL = """
dated AS (SELECT repo, tag, COALESCE(pr_merged_at, committed_at) AS tagged_at FROM tags WHERE NOT prerelease),
windows AS (SELECT * FROM (SELECT repo, tag AS from_tag, tagged_at AS from_at,
    LEAD(tag) OVER (PARTITION BY repo ORDER BY tagged_at, tag) AS to_tag,
    LEAD(tagged_at) OVER (PARTITION BY repo ORDER BY tagged_at, tag) AS to_at FROM dated) w WHERE to_tag IS NOT NULL),
in_window AS (SELECT w.repo, w.from_tag, w.to_tag, w.from_at, w.to_at, p.number, p.title,
    COALESCE(p.author, 'unknown') AS author, p.merged_at
  FROM pull_requests p JOIN windows w ON p.repo = w.repo AND p.merged_at BETWEEN w.from_at AND w.to_at),
sections(prefix, section, position) AS (VALUES ('feat','Features',0),('enh','Enhancements',1),('fix','Bug Fixes',2),
  ('perf','Performance',3),('compat','Compatibility',4),('docs','Documentation',5),('type','Type Annotations',6),
  ('refactor','Refactoring',7),('build','Build System',8),('ci','CI/CD',9),('test','Tests',10),('chore','Maintenance',11),
  ('misc','Miscellaneous',12)),
lines AS (SELECT repo, from_tag, to_tag, number, merged_at,
    '- ' || title || ' ([#' || CAST(number AS VARCHAR) || '](https://github.com/org/' || repo || '/pull/' || CAST(number AS VARCHAR) || '))' AS line
  FROM in_window),
parsed AS (SELECT *, CASE WHEN regexp_matches(line, '^- ([a-zA-Z]+)(?:\\([^)]*\\))?(!?):\\s*(.+)$')
      THEN lower(regexp_extract(line, '^- ([a-zA-Z]+)(?:\\([^)]*\\))?(!?):\\s*(.+)$', 1)) ELSE 'misc' END AS prefix,
    regexp_matches(line, '^- ([a-zA-Z]+)(?:\\([^)]*\\))?(!?):\\s*(.+)$')
      AND regexp_extract(line, '^- ([a-zA-Z]+)(?:\\([^)]*\\))?(!?):\\s*(.+)$', 2) = '!' AS breaking FROM lines),
categorized AS (SELECT p.repo, p.from_tag, p.to_tag, p.number, p.merged_at, s.section, s.position,
    CASE WHEN breaking THEN '- BREAKING CHANGE: ' || substring(line, 3) ELSE line END AS line
  FROM parsed p JOIN sections s ON p.prefix = s.prefix),
people AS (SELECT DISTINCT repo, from_tag, to_tag, from_at, author AS login FROM in_window
  WHERE author NOT IN ('renovate', 'dependabot', 'pre-commit-ci')),
firsts AS (SELECT repo, author AS login, arg_min(merged_at, struct_pack(n := number, m := merged_at)) AS first_at FROM pull_requests WHERE author IS NOT NULL GROUP BY 1, 2),
flagged AS (SELECT p.repo, p.from_tag, p.to_tag, p.login,
    CASE WHEN p.login = 'unknown' THEN TRUE ELSE COALESCE(f.first_at >= p.from_at, TRUE) END AS is_new
  FROM people p LEFT JOIN firsts f ON p.repo = f.repo AND p.login = f.login),
ranked AS (SELECT *, CAST(ROW_NUMBER() OVER (PARTITION BY repo, from_tag, to_tag ORDER BY NOT is_new, lower(login), login) AS BIGINT) AS rank,
    '[@' || login || '](https://github.com/' || login || ')' || CASE WHEN is_new THEN ' (first contribution)' ELSE '' END AS mention
  FROM flagged),
sentences AS (SELECT w.repo, w.from_tag, w.to_tag, CASE
    WHEN COUNT(r.login) = 0 THEN 'No contributors found.'
    WHEN COUNT(r.login) = 1 THEN 'Many thanks to ' || MAX(r.mention) || ' for their contributions.'
    ELSE 'Many thanks to ' || string_agg(r.mention, ', ' ORDER BY r.rank) FILTER (WHERE r.rank < cnt)
      || ', and ' || MAX(r.mention) FILTER (WHERE r.rank = cnt) || ' for their contributions.' END AS sentence
  FROM windows w LEFT JOIN (SELECT *, COUNT(*) OVER (PARTITION BY repo, from_tag, to_tag) AS cnt FROM ranked) r
    ON w.repo = r.repo AND w.from_tag = r.from_tag AND w.to_tag = r.to_tag
  GROUP BY w.repo, w.from_tag, w.to_tag)
"""


def _changelog_sql(body: str) -> str:
    return oracle_with(["pull_requests", "tags"], "").rstrip() + ",\n" + _WINDOWS_SQL.strip() + "\n" + body


def _changelog_inputs(spark, sf_dir):
    prs, tags = fx(spark, sf_dir, "pull_requests", "tags")
    windows = CL.release_windows(tags)
    return prs, tags, windows, CL.prs_in_window(prs, windows)


@register("changelog_windows", "Q1 Q9", _changelog_sql(
    f"SELECT repo, from_tag, to_tag, {sql_ts('from_at')} AS from_at, {sql_ts('to_at')} AS to_at FROM windows"))
def q_changelog_windows(spark, sf_dir):
    _, tags = fx(spark, sf_dir, "pull_requests", "tags")
    w = CL.release_windows(tags)
    return w.select("repo", "from_tag", "to_tag", ts_text("from_at").alias("from_at"), ts_text("to_at").alias("to_at"))


@register("changelog_changes", "Q2 Q3 V13 V18", _changelog_sql(
    "SELECT repo, from_tag, to_tag, number, section, CAST(position AS BIGINT) AS position, line FROM categorized"))
def q_changelog_changes(spark, sf_dir):
    *_, in_window = _changelog_inputs(spark, sf_dir)
    cat = CL.categorize_changes(in_window)
    return cat.select("repo", "from_tag", "to_tag", "number", "section",
                      F.col("position").cast("bigint").alias("position"), "line")


@register("changelog_section_counts", "Q3", _changelog_sql(
    "SELECT repo, from_tag, to_tag, section, CAST(position AS BIGINT) AS position, COUNT(*) AS changes "
    "FROM categorized GROUP BY 1, 2, 3, 4, 5"))
def q_changelog_section_counts(spark, sf_dir):
    *_, in_window = _changelog_inputs(spark, sf_dir)
    counts = CL.section_counts(CL.categorize_changes(in_window))
    return counts.select("repo", "from_tag", "to_tag", "section",
                         F.col("position").cast("bigint").alias("position"), "changes")


@register("changelog_contributors", "Q4 Q5 Q6 V19", _changelog_sql(
    "SELECT repo, from_tag, to_tag, login, is_new, rank, mention FROM ranked"))
def q_changelog_contributors(spark, sf_dir):
    prs, _, _, in_window = _changelog_inputs(spark, sf_dir)
    ranked = CL.rank_contributors(CL.first_contributions(prs, CL.contributors(in_window)))
    return ranked.select("repo", "from_tag", "to_tag", "login", "is_new", "rank", "mention")


@register("changelog_sentence", "Q7", _changelog_sql("SELECT repo, from_tag, to_tag, sentence FROM sentences"))
def q_changelog_sentence(spark, sf_dir):
    prs, _, windows, in_window = _changelog_inputs(spark, sf_dir)
    ranked = CL.rank_contributors(CL.first_contributions(prs, CL.contributors(in_window)))
    return CL.contributor_sentence(ranked, windows)


@register("changelog_document", "Q8", _changelog_sql("""
, blocks AS (SELECT repo, from_tag, to_tag, position,
    CHR(10) || '### ' || section || CHR(10) || string_agg(line, CHR(10) ORDER BY merged_at, number) || CHR(10) AS block
  FROM categorized GROUP BY repo, from_tag, to_tag, section, position),
body AS (SELECT repo, from_tag, to_tag, string_agg(block, '' ORDER BY position) AS body FROM blocks GROUP BY 1, 2, 3)
SELECT s.repo, s.from_tag, s.to_tag,
  '## Changelog (' || s.from_tag || '..' || s.to_tag || ')' || CHR(10) || CHR(10) || s.sentence || CHR(10) || COALESCE(b.body, '') AS changelog
FROM sentences s LEFT JOIN body b ON s.repo = b.repo AND s.from_tag = b.from_tag AND s.to_tag = b.to_tag
"""))
def q_changelog_document(spark, sf_dir):
    prs, tags = fx(spark, sf_dir, "pull_requests", "tags")
    return CL.changelog_document(prs, tags)


# ====================================================================== runs

from repolens.operators import runs as RU  # noqa: E402

AS_OF = "2024-02-01 00:00:00"


@register("active_runs", "Q10 V14", oracle_with(["workflow_runs"], f"""
SELECT repo, name AS workflow, head_branch AS branch, display_title AS title, status,
  {sql_ts('run_started_at')} AS started_at,
  CAST(CAST(round_even((epoch_us(TIMESTAMP '{AS_OF}') - epoch_us(run_started_at)) / 1e6 / 60.0, 0) AS BIGINT) AS VARCHAR) || ' min' AS duration,
  actor AS "user"
FROM workflow_runs WHERE status IS DISTINCT FROM 'completed'"""))
def q_active_runs(spark, sf_dir):
    (runs,) = fx(spark, sf_dir, "workflow_runs")
    out = RU.active_runs(runs, AS_OF)
    return out.withColumn("started_at", ts_text("started_at"))


def _label_sql(alias: str) -> str:
    n = f"CAST({alias}.run_number AS VARCHAR)"
    c = f"COALESCE({alias}.conclusion, 'running')"
    return (f"CASE WHEN length({n}) < 5 THEN rpad({n}, 5, ' ') ELSE {n} END || ' ' || "
            f"CASE WHEN length({c}) < 13 THEN rpad({c}, 13, ' ') ELSE {c} END || ' ' || "
            f"strftime({alias}.run_started_at, '%Y-%m-%d %H:%M') || '    branch: ' || COALESCE({alias}.head_branch, 'None') || ' '")


@register("run_pairs", "Q11 V20", oracle_with(["workflow_runs", "run_requests"], f"""
, hist AS (SELECT * FROM workflow_runs)
SELECT q.repo, q.workflow, q.good_run, q.bad_run, {_label_sql('g')} AS good_label, {_label_sql('b')} AS bad_label,
  'https://api.github.com/repos/' || g.repo || '/actions/runs/' || CAST(g.run_number AS VARCHAR) || '/artifacts' AS good_url,
  'https://api.github.com/repos/' || b.repo || '/actions/runs/' || CAST(b.run_number AS VARCHAR) || '/artifacts' AS bad_url
FROM run_requests q JOIN hist g ON q.repo = g.repo AND q.workflow = g.name AND q.good_run = g.run_number
JOIN hist b ON q.repo = b.repo AND q.workflow = b.name AND q.bad_run = b.run_number""".replace("\n, hist", ", hist", 1)))
def q_run_pairs(spark, sf_dir):
    runs, req = fx(spark, sf_dir, "workflow_runs", "run_requests")
    return RU.run_pairs(runs, req)


@register("artifacts_named", "Q12", oracle_with(["artifacts"], """
SELECT run_number, name, archive_download_url FROM artifacts WHERE name IN ('pip', 'conda', 'npm')"""))
def q_artifacts_named(spark, sf_dir):
    (arts,) = fx(spark, sf_dir, "artifacts")
    return RU.select_artifacts(arts, ["pip", "conda", "npm"])


@register("artifacts_first", "Q12", oracle_with(["artifacts"], """
SELECT run_number, arg_min(name, position) AS name, arg_min(archive_download_url, position) AS archive_download_url
FROM artifacts GROUP BY run_number"""))
def q_artifacts_first(spark, sf_dir):
    (arts,) = fx(spark, sf_dir, "artifacts")
    return RU.select_artifacts(arts)


@register("env_files", "Q13", oracle_with(["text_files"], """
, g AS (SELECT MIN(path) AS file FROM (SELECT DISTINCT path FROM text_files WHERE side = 'good'
    AND lower(path) LIKE '%linux%' AND lower(path) LIKE '%3.11%' AND lower(path) LIKE '%\\_unit%' ESCAPE '\\') t)
SELECT g.file, g.file AS good_path, b.bad_path FROM g
LEFT JOIN (SELECT path AS file, MIN(path) AS bad_path FROM text_files WHERE side = 'bad' GROUP BY path) b ON g.file = b.file
WHERE g.file IS NOT NULL""".replace("\n, g AS", ", g AS", 1)))
def q_env_files(spark, sf_dir):
    (lines,) = fx(spark, sf_dir, "text_files")
    files = lines.select("side", "path").distinct()
    return RU.match_env_files(files, "linux", "3.11", "unit")


@register("env_files_by_run", "Q13", oracle_with(["run_env_files"], """
, named AS (SELECT run, side, path, split_part(path, '/', 2) AS file FROM run_env_files),
g AS (SELECT run, MIN(file) AS file FROM named WHERE side = 'good' AND lower(file) LIKE '%linux%' AND lower(file) LIKE '%3.11%'
  AND contains(lower(file), '_unit') GROUP BY run)
SELECT g.run, g.file, 'good/' || g.file AS good_path, b.path AS bad_path
FROM g LEFT JOIN named b ON b.run = g.run AND b.file = g.file AND b.side = 'bad'""".replace("\n, named", ", named", 1)))
def q_env_files_by_run(spark, sf_dir):
    (files,) = fx(spark, sf_dir, "run_env_files")
    return RU.match_env_files(files, "linux", "3.11", "unit", keys=("run",))


# ====================================================================== differences

from repolens.operators import diffs as DF  # noqa: E402


@register("line_diff", "Q14", oracle_with(["text_files"], """
, numbered AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY side, path, line ORDER BY line_no) AS copy FROM text_files),
b AS (SELECT path, line, copy, line_no FROM numbered WHERE side = 'bad'),
g AS (SELECT path, line, copy, line_no FROM numbered WHERE side = 'good')
SELECT COALESCE(b.path, g.path) AS path, COALESCE(b.line, g.line) AS line,
  CASE WHEN g.line_no IS NULL THEN 'removed' ELSE 'added' END AS status, COALESCE(b.line_no, g.line_no) AS line_no
FROM b FULL OUTER JOIN g ON b.path = g.path AND b.line = g.line AND b.copy = g.copy
WHERE b.line_no IS NULL OR g.line_no IS NULL""".replace("\n, numbered", ", numbered", 1)))
def q_line_diff(spark, sf_dir):
    (lines,) = fx(spark, sf_dir, "text_files")
    return DF.line_diff(lines)


from repolens.operators import edits as ED  # noqa: E402
from repolens.operators.ordinal import ordinal_within  # noqa: E402
from repolens.operators.running import staged  # noqa: E402


@register("line_edits", "Q14", oracle_with(["run_dumps"], """
, numbered AS (SELECT side, path, ROW_NUMBER() OVER (PARTITION BY side, path ORDER BY line_no) AS position, line_no, line FROM run_dumps)
SELECT side, path, position, line_no, line FROM numbered""".replace("\n, numbered", ", numbered", 1)))
def q_line_edits(spark, sf_dir):
    """Both files read back from the edit script, in its order."""
    (lines,) = fx(spark, sf_dir, "run_dumps")
    script = staged(ED.edit_script(lines))
    sides = [script.filter(F.col("status") != other).select(F.lit(side).alias("side"), "path", "seq", F.col(f"{side}_no").alias("line_no"), "line")
             for side, other in (("good", "removed"), ("bad", "added"))]
    both = ordinal_within(sides[0].unionByName(sides[1]), ["side", "path"], ["seq"], "position", blocks=True)
    return both.select("side", "path", "position", "line_no", "line")


@register("line_anchors", "Q14", oracle_with(["run_dumps"], """
, once AS (SELECT path, line, MAX(CASE WHEN side = 'good' THEN line_no END) AS g, MAX(CASE WHEN side = 'bad' THEN line_no END) AS b
  FROM run_dumps GROUP BY path, line HAVING COUNT(*) = 2 AND COUNT(DISTINCT side) = 2),
walked AS (SELECT path, SUM(CASE WHEN b = g THEN 1 ELSE 0 END) OVER w AS stayed, SUM(CASE WHEN b > g THEN 1 ELSE 0 END) OVER w AS moved,
    SUM(CASE WHEN b > g THEN 1 ELSE 0 END) OVER (PARTITION BY path) AS all_moved FROM once WINDOW w AS (PARTITION BY path ORDER BY g))
SELECT path, COUNT(*) AS anchors, CAST(MAX(GREATEST(stayed + all_moved - moved, all_moved)) AS BIGINT) AS kept,
  CAST(MAX(all_moved) AS BIGINT) AS moved_blocks
FROM walked GROUP BY path""".replace("\n, once", ", once", 1)))
def q_line_anchors(spark, sf_dir):
    """Lines that stand once on each side, and how many of them the script keeps (blocks of the bad side were moved to its end)."""
    (lines,) = fx(spark, sf_dir, "run_dumps")
    script = ED.edit_script(lines)  # read once
    per_line = script.groupBy("path", "line").agg(
        F.count("good_no").alias("g"), F.count("bad_no").alias("b"), F.count_if(F.col("status") == "kept").alias("kept"),
        (F.max("bad_no") > F.max("good_no")).alias("later"))
    return per_line.filter("g = 1 AND b = 1").groupBy("path").agg(
        F.count("*").alias("anchors"), F.sum("kept").alias("kept"), F.count_if("later").alias("moved_blocks"))


@register("package_diff", "Q15 V12", oracle_with(["lock_packages"], """
, files AS (SELECT DISTINCT side, env, arch, regexp_extract(url, '[^/]*$') AS file FROM lock_packages),
g0 AS (SELECT * FROM files WHERE side = 'good' AND env LIKE 'test%'),
b0 AS (SELECT * FROM files WHERE side = 'bad'),
g AS (SELECT * FROM g0 WHERE (env, arch) IN (SELECT env, arch FROM b0)),
b AS (SELECT * FROM b0 WHERE (env, arch) IN (SELECT env, arch FROM g)),
d AS (SELECT * FROM g WHERE (env, arch, file) NOT IN (SELECT env, arch, file FROM b)
      UNION ALL SELECT * FROM b WHERE (env, arch, file) NOT IN (SELECT env, arch, file FROM g)),
n AS (SELECT *, array_to_string(string_split(file, '-')[1:greatest(len(string_split(file, '-')) - 2, 0)], '-') AS package
      FROM d WHERE file <> '.')
SELECT env, arch, package, COALESCE(MIN(CASE WHEN side = 'good' THEN file END), '-') AS good_file,
  COALESCE(MIN(CASE WHEN side = 'bad' THEN file END), '-') AS bad_file
FROM n GROUP BY env, arch, package""".replace("\n, files", ", files", 1)))
def q_package_diff(spark, sf_dir):
    (locks,) = fx(spark, sf_dir, "lock_packages")
    return DF.package_diff(locks)


_NORM_SQL = r"""
, listed AS (SELECT DISTINCT side, format, archive FROM archive_members),
first_archive AS (SELECT * FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY side, format ORDER BY
    CASE WHEN format IN ('conda', 'conda1') AND archive NOT LIKE '%core%' THEN 1 ELSE 0 END, archive) AS rn FROM listed) t WHERE rn = 1),
compared AS (SELECT m.* FROM archive_members m JOIN first_archive f ON m.side = f.side AND m.format = f.format
    AND m.archive = f.archive WHERE m.format IN (SELECT format FROM first_archive GROUP BY format HAVING COUNT(*) = 2)),
vt AS (SELECT *, CASE WHEN format = 'wheel' THEN split_part(split_part(archive, '-py3', 1), '-py2', 1)
      WHEN format IN ('sdist', 'conda1', 'npm') THEN split_part(split_part(split_part(replace(archive, '-core', ''), '.tar', 1), '-py_0', 1), '.tgz', 1)
      ELSE split_part(split_part(replace(archive, '-core', ''), '.conda', 1), '-py_0', 1) END AS vtext FROM compared),
pat AS (SELECT *, replace(regexp_extract(vtext, '^\w+.\d+.\d+.\d+'), '-', '.') AS plain,
    replace(regexp_replace(regexp_replace(vtext, '([()\[\]{}?*+\-|^$\\.&~# ])', '\\\1', 'g'),
      '(\d)(rc|a|b)(\d)', '\1\\-?\2\\.?\3', 'g'), '\-', '.') AS loose FROM vt),
norm AS (SELECT DISTINCT side, format, regexp_replace(regexp_replace(member, loose, '$VERSION', 'g'), plain, '$VERSION', 'g') AS member
  FROM pat WHERE plain <> ''),
diff AS (SELECT g.side, g.format, g.member FROM norm g WHERE g.side = 'good'
    AND NOT EXISTS (SELECT 1 FROM norm b WHERE b.side = 'bad' AND b.format = g.format AND b.member = g.member)
  UNION ALL SELECT b.side, b.format, b.member FROM norm b WHERE b.side = 'bad'
    AND NOT EXISTS (SELECT 1 FROM norm g WHERE g.side = 'good' AND g.format = b.format AND g.member = b.member))
"""


@register("file_list_diff", "Q16 V11", oracle_with(["archive_members"], _NORM_SQL.replace("\n, listed", ", listed", 1)
                                                    + "SELECT format, side, member FROM diff"))
def q_file_list_diff(spark, sf_dir):
    (members,) = fx(spark, sf_dir, "archive_members")
    return DF.file_list_diff(members)


@register("file_list_side_by_side", "Q16", oracle_with(["archive_members"], _NORM_SQL.replace("\n, listed", ", listed", 1) + """
, numbered AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY format, side ORDER BY member) AS row FROM diff)
SELECT COALESCE(g.format, b.format) AS format, COALESCE(g.row, b.row) AS row,
  COALESCE(g.member, '-') AS good_member, COALESCE(b.member, '-') AS bad_member
FROM (SELECT * FROM numbered WHERE side = 'good') g FULL OUTER JOIN (SELECT * FROM numbered WHERE side = 'bad') b
  ON g.format = b.format AND g.row = b.row"""))
def q_file_list_side_by_side(spark, sf_dir):
    (members,) = fx(spark, sf_dir, "archive_members")
    return DF.file_list_side_by_side(DF.file_list_diff(members))


@register("archive_pairs", "Q17", oracle_with(["archive_files"], r"""
, picked AS (SELECT * FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY side, format ORDER BY
    CASE WHEN format IN ('conda', 'conda1') AND archive NOT LIKE '%core%' THEN 1 ELSE 0 END, archive) AS rn FROM archive_files) t WHERE rn = 1),
vt AS (SELECT *, CASE WHEN format = 'wheel' THEN split_part(split_part(archive, '-py3', 1), '-py2', 1)
      WHEN format IN ('sdist', 'conda1', 'npm') THEN split_part(split_part(split_part(replace(archive, '-core', ''), '.tar', 1), '-py_0', 1), '.tgz', 1)
      ELSE split_part(split_part(replace(archive, '-core', ''), '.conda', 1), '-py_0', 1) END AS vtext FROM picked),
ok AS (SELECT *, regexp_matches(vtext, '^\w+.\d+.\d+.\d+') AS ok FROM vt)
SELECT g.format, g.archive AS good_archive, b.archive AS bad_archive
FROM ok g JOIN ok b ON g.format = b.format AND g.side = 'good' AND b.side = 'bad' WHERE g.ok AND b.ok""".replace("\n, picked", ", picked", 1)))
def q_archive_pairs(spark, sf_dir):
    (arch,) = fx(spark, sf_dir, "archive_files")
    return DF.pick_archive_pairs(arch)


# ====================================================================== dependencies

from repolens.operators import dependencies as DP  # noqa: E402

PY_VERSION, PY_RELEASED, DEP_AS_OF = "3.10", "1997-01-01 00:00:00", "2001-12-01 00:00:00"

_SUPPORT_SQL = f"""
, parsed AS (SELECT package, upload_time, requires_python,
    CASE WHEN filename LIKE '%.whl' AND len(string_split(filename, '-')) IN (5, 6) THEN string_split(filename, '-')[2]
         WHEN filename LIKE '%.tar.gz' AND filename LIKE '%-%' THEN regexp_extract(filename, '-([^-]*)\\.tar\\.gz$', 1) END AS version
  FROM index_files),
final AS (SELECT *, CAST(string_split(version, '.') AS BIGINT[]) AS k FROM parsed
  WHERE version IS NOT NULL AND regexp_matches(version, '^[0-9]+(\\.[0-9]+)*$')),
checked AS (SELECT *, upload_time >= TIMESTAMP '{PY_RELEASED}' AND (requires_python IS NULL OR list_bool_and(list_transform(
    string_split(replace(requires_python, '.*', ''), ','), lambda x: CASE
      WHEN trim(x) LIKE '>=%' THEN [3, 10] >= CAST(string_split(trim(substr(trim(x), 3)), '.') AS BIGINT[])
      WHEN trim(x) LIKE '<=%' THEN [3, 10] <= CAST(string_split(trim(substr(trim(x), 3)), '.') AS BIGINT[])
      WHEN trim(x) LIKE '!=%' THEN [3, 10] <> CAST(string_split(trim(substr(trim(x), 3)), '.') AS BIGINT[])
      WHEN trim(x) LIKE '==%' THEN [3, 10] = CAST(string_split(trim(substr(trim(x), 3)), '.') AS BIGINT[])
      WHEN trim(x) LIKE '>%' THEN [3, 10] > CAST(string_split(trim(substr(trim(x), 2)), '.') AS BIGINT[])
      WHEN trim(x) LIKE '<%' THEN [3, 10] < CAST(string_split(trim(substr(trim(x), 2)), '.') AS BIGINT[]) END))) AS ok
  FROM final),
per_version AS (SELECT package, k, MIN(version) AS spelling, MIN(upload_time) AS first_upload, bool_or(ok) AS any_ok
  FROM checked GROUP BY package, k),
windows AS (SELECT package,
    COALESCE(arg_min(spelling, k) FILTER (WHERE any_ok), '-') AS minimum,
    COALESCE(arg_max(spelling, k) FILTER (WHERE any_ok), '-') AS maximum,
    COALESCE(arg_max(spelling, k), '-') AS current,
    COALESCE(arg_min(spelling, k) FILTER (WHERE COALESCE(k[3], 0) = 0
      AND first_upload >= TIMESTAMP '{DEP_AS_OF}' - INTERVAL 730 DAY), '-') AS spec0
  FROM per_version GROUP BY package)
"""

_ALIAS_VALUES = ", ".join(f"('{a}', {repr(b) if b else 'NULL'})" for a, b in DP.PACKAGE_ALIASES)
_NAMES_SQL = f"""
, aliases(name, mapped) AS (VALUES {_ALIAS_VALUES}),
names AS (SELECT main_package, kind, regexp_extract(requirement, '^\\s*([A-Za-z0-9](?:[A-Za-z0-9._-]*[A-Za-z0-9])?)', 1) AS name
  FROM requirements),
deps AS (SELECT DISTINCT n.main_package, CASE WHEN a.name IS NOT NULL AND n.kind = 'project' THEN a.mapped ELSE n.name END AS package
  FROM names n LEFT JOIN aliases a ON n.name = a.name WHERE n.name <> '')
"""


@register("support_window", "Q18 V1 V3 V4", oracle_with(["index_files"], _SUPPORT_SQL.replace("\n, parsed", ", parsed", 1)
                                                         + "SELECT * FROM windows"))
def q_support_window(spark, sf_dir):
    (files,) = fx(spark, sf_dir, "index_files")
    return DP.support_window(files, PY_VERSION, DEP_AS_OF, released_at=PY_RELEASED)


@register("dependency_names", "Q19 V5", oracle_with(["requirements"], _NAMES_SQL.replace("\n, aliases", ", aliases", 1)
                                                    + "SELECT main_package, package FROM deps WHERE package IS NOT NULL"))
def q_dependency_names(spark, sf_dir):
    (req,) = fx(spark, sf_dir, "requirements")
    return DP.dependency_names(req)


@register("dependency_report", "Q20", oracle_with(["index_files", "requirements"],
                                                  _SUPPORT_SQL.replace("\n, parsed", ", parsed", 1) + _NAMES_SQL + """
SELECT d.main_package, d.package, COALESCE(w.minimum, '-') AS minimum, COALESCE(w.maximum, '-') AS maximum,
  COALESCE(w.current, '-') AS current, COALESCE(w.spec0, '-') AS spec0
FROM deps d LEFT JOIN windows w ON regexp_replace(lower(d.package), '[-_.]+', '-', 'g') = w.package WHERE d.package IS NOT NULL"""))
def q_dependency_report(spark, sf_dir):
    files, req = fx(spark, sf_dir, "index_files", "requirements")
    return DP.dependency_report(req, files, PY_VERSION, DEP_AS_OF, released_at=PY_RELEASED)


# ====================================================================== bisection and release

from repolens.operators import bisect as BI  # noqa: E402
from repolens.operators import release as RL  # noqa: E402

_BISECT_SQL = """
, cat AS (SELECT package, version, CAST(string_split(version, '.') AS BIGINT[]) AS k, bool_and(passed) AS passed
  FROM version_results GROUP BY package, version),
base AS (SELECT r.*, g.k AS gk, b.k AS bk, CASE WHEN g.k IS NULL THEN 'good version not found'
    WHEN b.k IS NULL THEN 'bad version not found' WHEN NOT g.passed THEN 'good version failed'
    WHEN b.passed THEN 'bad version passed' END AS reason
  FROM bisect_ranges r LEFT JOIN cat g ON g.package = r.package AND g.version = r.good_version
  LEFT JOIN cat b ON b.package = r.package AND b.version = r.bad_version),
inr AS (SELECT u.package, u.good_version, u.bad_version, u.gk < u.bk AS forward, c.version, c.passed,
    ROW_NUMBER() OVER (PARTITION BY u.package, u.good_version, u.bad_version ORDER BY c.k, c.version) AS a,
    COUNT(*) OVER (PARTITION BY u.package, u.good_version, u.bad_version) AS n
  FROM base u JOIN cat c ON c.package = u.package AND c.k >= least(u.gk, u.bk) AND c.k <= greatest(u.gk, u.bk)
  WHERE u.reason IS NULL),
pos AS (SELECT *, CASE WHEN forward THEN a ELSE n + 1 - a END AS pos FROM inr),
RECURSIVE_PLACEHOLDER
"""

_BISECT_BODY = """
, final AS (SELECT * FROM state WHERE r - l <= 1),
scan AS (SELECT package, good_version, bad_version, MAX(CASE WHEN passed THEN pos END) AS last_pass,
    MIN(CASE WHEN NOT passed THEN pos END) AS first_fail FROM pos GROUP BY 1, 2, 3)
SELECT b.package, b.good_version, b.bad_version, COALESCE(b.reason, 'ok') AS status,
  CASE WHEN f.forward THEN 'forward' WHEN f.forward IS NOT NULL THEN 'reverse' END AS direction,
  pf.version AS failing_version, pp.version AS passing_version, CAST(f.probes AS BIGINT) AS probes,
  sc.last_pass < sc.first_fail AS monotone, ps.version AS scan_failing_version,
  'tmp_' || sha256(b.package || '=' || b.good_version) AS good_env
FROM base b LEFT JOIN final f ON b.package = f.package AND b.good_version = f.good_version AND b.bad_version = f.bad_version
LEFT JOIN scan sc ON sc.package = b.package AND sc.good_version = b.good_version AND sc.bad_version = b.bad_version
LEFT JOIN pos ps ON ps.package = sc.package AND ps.good_version = sc.good_version AND ps.bad_version = sc.bad_version
  AND ps.pos = sc.first_fail
LEFT JOIN pos pf ON pf.package = f.package AND pf.good_version = f.good_version AND pf.bad_version = f.bad_version AND pf.pos = f.r
LEFT JOIN pos pp ON pp.package = f.package AND pp.good_version = f.good_version AND pp.bad_version = f.bad_version AND pp.pos = f.r - 1
"""


def _bisect_sql() -> str:
    head = oracle_with(["version_results", "bisect_ranges"], "")
    head = head.replace("WITH ", "WITH RECURSIVE ", 1)
    state = """state(package, good_version, bad_version, forward, l, r, probes) AS (
  SELECT DISTINCT package, good_version, bad_version, forward, CAST(1 AS BIGINT), n, 0 FROM pos
  UNION ALL
  SELECT s.package, s.good_version, s.bad_version, s.forward,
    CASE WHEN p.passed THEN p.pos ELSE s.l END, CASE WHEN p.passed THEN s.r ELSE p.pos END, s.probes + 1
  FROM state s JOIN pos p ON p.package = s.package AND p.good_version = s.good_version
    AND p.bad_version = s.bad_version AND p.pos = (s.l + s.r) // 2
  WHERE s.r - s.l > 1)"""
    return head.rstrip() + _BISECT_SQL.replace("RECURSIVE_PLACEHOLDER", state).rstrip().rstrip(",") + _BISECT_BODY


@register("version_regressions", "Q34 Q35 V2 V17", _bisect_sql())
def q_version_regressions(spark, sf_dir):
    results, ranges = fx(spark, sf_dir, "version_results", "bisect_ranges")
    return BI.version_regressions(results.select("package", "version"), results, ranges)


_BUMP_SQL = r"""
, parsed AS (SELECT package, tag, CAST(regexp_extract(tag, '^v(\d+)\.(\d+)\.(\d+)', 1) AS BIGINT) AS ma,
    CAST(regexp_extract(tag, '^v(\d+)\.(\d+)\.(\d+)', 2) AS BIGINT) AS mi, CAST(regexp_extract(tag, '^v(\d+)\.(\d+)\.(\d+)', 3) AS BIGINT) AS mc,
    regexp_extract(tag, '(a|b|rc)(\d+)$', 1) AS l, regexp_extract(tag, '(a|b|rc)(\d+)$', 2) AS ln FROM package_tags),
pre_c AS (SELECT package, x.o - CASE l WHEN 'a' THEN 1 WHEN 'b' THEN 2 ELSE 3 END AS choice,
    'v' || ma || '.' || mi || '.' || mc || CASE WHEN x.p IS NULL THEN ''
      ELSE x.p || CAST(CASE WHEN x.p = l THEN CAST(ln AS BIGINT) + 1 ELSE 0 END AS VARCHAR) END AS tag
  FROM parsed JOIN (VALUES ('a', 1), ('b', 2), ('rc', 3), (NULL, 4)) x(p, o) ON x.o >= CASE l WHEN 'a' THEN 1 WHEN 'b' THEN 2 ELSE 3 END
  WHERE l <> ''),
fin_c AS (SELECT package, a.o * 4 + b.o AS choice,
    'v' || CASE a.p1 WHEN 'major' THEN ma + 1 ELSE ma END || '.' || CASE a.p1 WHEN 'minor' THEN mi + 1 WHEN 'major' THEN 0 ELSE mi END
    || '.' || CASE a.p1 WHEN 'patch' THEN mc + 1 ELSE 0 END || COALESCE(b.p2 || '0', '') AS tag
  FROM parsed CROSS JOIN (VALUES ('patch', 0), ('minor', 1), ('major', 2)) a(p1, o) CROSS JOIN (VALUES ('a', 0), ('b', 1), ('rc', 2), (NULL, 3)) b(p2, o)
  WHERE l = ''),
cands AS (SELECT * FROM pre_c UNION ALL SELECT * FROM fin_c)
SELECT c.package, CAST(c.choice AS BIGINT) AS choice, c.tag,
  regexp_replace(regexp_replace(c.tag, '^v', ''), '(a|b|rc)', '-\1.', 'g') AS npm_version
FROM cands c WHERE NOT EXISTS (SELECT 1 FROM existing_tags e WHERE e.package = c.package AND e.tag = c.tag)
"""


@register("next_versions", "Q36 V7 V8 V9 V10", oracle_with(["package_tags", "existing_tags"],
                                                           _BUMP_SQL.replace("\n, parsed", ", parsed", 1)))
def q_next_versions(spark, sf_dir):
    tags, existing = fx(spark, sf_dir, "package_tags", "existing_tags")
    return RL.next_versions(tags, existing)


# ====================================================================== workflow references

from repolens.functions.fixed_values import USES_PATTERN  # noqa: E402
from repolens.operators import refs as RF  # noqa: E402

_OCC_SQL = f"""
, occ AS (SELECT w.checkout, w.path, CAST(i - 1 AS BIGINT) AS pos, w.ms[i] AS whole
  FROM (SELECT checkout, path, regexp_extract_all(content, '{USES_PATTERN}') AS ms FROM workflows) w,
  range(1, len(w.ms) + 1) r(i)),
parsed AS (SELECT checkout, path, pos, whole, regexp_extract(whole, '{USES_PATTERN}', 1) AS lead,
    regexp_extract(whole, '{USES_PATTERN}', 2) AS action_path, regexp_extract(whole, '{USES_PATTERN}', 3) AS ref,
    regexp_extract(whole, '{USES_PATTERN}', 4) AS comment FROM occ),
refs0 AS (SELECT *, array_to_string(string_split(action_path, '/')[1:2], '/') AS repo,
    regexp_matches(ref, '^[0-9a-fA-F]{{40}}$') AS is_sha FROM parsed),
occurrences AS (SELECT *, CASE WHEN is_sha AND regexp_extract(comment, '#\\s*(\\S+)', 1) <> ''
    THEN regexp_extract(comment, '#\\s*(\\S+)', 1) END AS tag FROM refs0),
refs AS (SELECT checkout, repo, ref, first(is_sha) AS is_sha, first(tag ORDER BY path, pos) AS tag FROM occurrences
  GROUP BY checkout, repo, ref)
"""

_LATEST_SQL = """
, q_{n} AS (SELECT DISTINCT repo, {col} AS query, regexp_extract({col}, '^([^0-9]*)(\\d+(?:\\.\\d+)*)$', 1) AS prefix,
    CAST(string_split(regexp_extract({col}, '^([^0-9]*)(\\d+(?:\\.\\d+)*)$', 2), '.') AS BIGINT[]) AS cur,
    regexp_extract({col}, '^([^0-9]*)(\\d+(?:\\.\\d+)*)$', 2) LIKE '%.%' AS has_dot
  FROM {src} WHERE {col} NOT IN ('main', 'master', 'dev', 'develop', 'latest', 'HEAD')
    AND regexp_matches({col}, '^([^0-9]*)(\\d+(?:\\.\\d+)*)$')),
c_{n} AS (SELECT q.repo, q.query, q.cur, nm.name, nm.kind = 'tag' AS is_tag,
    CAST(string_split(regexp_extract(nm.name, '^([^0-9]*)(\\d+(?:\\.\\d+)*)$', 2), '.') AS BIGINT[]) AS v
  FROM q_{n} q JOIN ref_names nm ON nm.repo = q.repo AND regexp_matches(nm.name, '^([^0-9]*)(\\d+(?:\\.\\d+)*)$')
    AND regexp_extract(nm.name, '^([^0-9]*)(\\d+(?:\\.\\d+)*)$', 1) = q.prefix
  WHERE CASE WHEN q.has_dot THEN TRUE
    WHEN {expand} THEN len(string_split(regexp_extract(nm.name, '^([^0-9]*)(\\d+(?:\\.\\d+)*)$', 2), '.')) > len(q.cur)
      AND CAST(string_split(regexp_extract(nm.name, '^([^0-9]*)(\\d+(?:\\.\\d+)*)$', 2), '.') AS BIGINT[])[1:len(q.cur)] = q.cur
    ELSE regexp_extract(nm.name, '^([^0-9]*)(\\d+(?:\\.\\d+)*)$', 2) NOT LIKE '%.%' END),
b_{n} AS (SELECT repo, query, cur, name, v, ROW_NUMBER() OVER (PARTITION BY repo, query ORDER BY is_tag DESC, v DESC, name DESC) AS rk
  FROM c_{n}),
latest_{n} AS (SELECT repo, query, CASE WHEN v > cur THEN name END AS latest FROM b_{n} WHERE rk = 1)
"""


def _latest_sql(n: str, src: str, col: str, expand: bool) -> str:
    return _LATEST_SQL.format(n=n, src=src, col=col, expand="TRUE" if expand else "FALSE")


_RESOLVE_SQL = """
, resolved AS (SELECT repo, name, arg_min(commit_sha, (kind <> 'tag', commit_sha)) AS commit_sha FROM ref_names GROUP BY repo, name)
"""


def _plan_sql(pin: bool, expand: bool, mutable: bool) -> str:
    target_s = "COALESCE(l.latest, CASE WHEN r.tag NOT LIKE '%.%' THEN r.tag END)" if mutable else "l.latest"
    target_n = "COALESCE(l.latest, r.ref)" if pin else "l.latest"
    return (_latest_sql("s", "(SELECT * FROM refs WHERE is_sha AND tag IS NOT NULL)", "tag", expand)
            + _latest_sql("n", "(SELECT * FROM refs WHERE NOT is_sha)", "ref", expand) + _RESOLVE_SQL + f"""
, s AS (SELECT r.checkout, r.repo, r.ref, CASE WHEN r.tag IS NOT NULL THEN {target_s} END AS target
  FROM refs r LEFT JOIN latest_s l ON l.repo = r.repo AND l.query = r.tag WHERE r.is_sha),
s2 AS (SELECT s.checkout, s.repo, s.ref, s.target, c.commit_sha FROM s LEFT JOIN resolved c ON c.repo = s.repo AND c.name = s.target),
n AS (SELECT r.checkout, r.repo, r.ref, {target_n} AS target FROM refs r LEFT JOIN latest_n l ON l.repo = r.repo AND l.query = r.ref
  WHERE NOT r.is_sha),
plan AS (SELECT checkout, repo, ref,
    CASE WHEN target IS NOT NULL AND commit_sha IS NOT NULL AND commit_sha <> ref THEN target END AS latest_tag,
    CASE WHEN target IS NOT NULL AND commit_sha IS NOT NULL AND commit_sha <> ref THEN commit_sha END AS latest_sha FROM s2
  UNION ALL
  SELECT n.checkout, n.repo, n.ref, n.target AS latest_tag, {'c.commit_sha' if pin else 'CAST(NULL AS VARCHAR)'} AS latest_sha
  FROM n LEFT JOIN resolved c ON c.repo = n.repo AND c.name = n.target)
""")


def _refs_sql(body: str) -> str:
    return oracle_with(["workflows", "ref_names"], _OCC_SQL.replace("\n, occ", ", occ", 1)) + body


CHECKOUT = ("checkout",)


def _refs_inputs(spark, sf_dir):
    files, names = fx(spark, sf_dir, "workflows", "ref_names")
    return files, names, RF.collect_refs(files, keys=CHECKOUT)


@register("collect_refs", "Q22 V21", _refs_sql("SELECT checkout, repo, ref, is_sha, tag FROM refs"))
def q_collect_refs(spark, sf_dir):
    _, _, refs = _refs_inputs(spark, sf_dir)
    return refs


@register("unpinnable_refs", "Q26", _refs_sql("SELECT checkout, repo, ref FROM refs WHERE is_sha AND tag IS NULL"))
def q_unpinnable_refs(spark, sf_dir):
    _, _, refs = _refs_inputs(spark, sf_dir)
    return RF.unpinnable_refs(refs, CHECKOUT)


@register("latest_refs", "Q23", _refs_sql(_latest_sql("a", "(SELECT * FROM refs WHERE NOT is_sha)", "ref", False)
                                          + "SELECT repo, query AS ref, latest FROM latest_a"))
def q_latest_refs(spark, sf_dir):
    _, names, refs = _refs_inputs(spark, sf_dir)
    return RF.latest_refs(refs.filter(~F.col("is_sha")), names)


@register("latest_refs_expand", "Q23", _refs_sql(_latest_sql("a", "(SELECT * FROM refs WHERE NOT is_sha)", "ref", True)
                                                 + "SELECT repo, query AS ref, latest FROM latest_a"))
def q_latest_refs_expand(spark, sf_dir):
    _, names, refs = _refs_inputs(spark, sf_dir)
    return RF.latest_refs(refs.filter(~F.col("is_sha")), names, expand=True)


@register("resolve_commits", "Q24", oracle_with(["ref_names"], "") .rstrip() + _RESOLVE_SQL.replace("\n, resolved", ", resolved", 1)
          + "SELECT repo, name, commit_sha FROM resolved")
def q_resolve_commits(spark, sf_dir):
    (names,) = fx(spark, sf_dir, "ref_names")
    return RF.resolve_commits(names, names)


@register("ref_update_plan", "Q25", _refs_sql(_plan_sql(False, False, False) + "SELECT * FROM plan"))
def q_ref_update_plan(spark, sf_dir):
    _, names, refs = _refs_inputs(spark, sf_dir)
    return RF.plan_ref_updates(refs, names, keys=CHECKOUT)


@register("ref_update_plan_pinned", "Q25", _refs_sql(_plan_sql(True, True, True) + "SELECT * FROM plan"))
def q_ref_update_plan_pinned(spark, sf_dir):
    _, names, refs = _refs_inputs(spark, sf_dir)
    return RF.plan_ref_updates(refs, names, pin=True, expand=True, mutable=True, keys=CHECKOUT)


RENAMES = [("tools/tasks/old_setup", "tools/tasks/old-setup")]

_REWRITE_SQL = """
, renames(old_path, new_path) AS (VALUES ('tools/tasks/old_setup', 'tools/tasks/old-setup')),
upd AS (SELECT * FROM plan WHERE latest_tag IS NOT NULL),
rep AS (SELECT o.checkout, o.path, o.pos, o.action_path, o.ref, u.latest_tag, u.latest_sha, COALESCE(rn.new_path, o.action_path) AS np,
    rn.new_path IS NOT NULL AND rn.new_path <> o.action_path AS renamed, o.lead, o.whole
  FROM occurrences o LEFT JOIN upd u ON u.checkout = o.checkout AND u.repo = o.repo AND u.ref = o.ref LEFT JOIN renames rn ON rn.old_path = o.action_path),
rep2 AS (SELECT *, CASE WHEN latest_tag IS NOT NULL AND latest_sha IS NOT NULL THEN lead || np || '@' || latest_sha || ' # ' || latest_tag
    WHEN latest_tag IS NOT NULL THEN lead || np || '@' || latest_tag WHEN renamed THEN lead || np || '@' || ref ELSE whole END AS repl
  FROM rep),
gaps AS (SELECT w.checkout, w.path, w.content, CAST(i - 1 AS BIGINT) AS pos, w.g[i] AS gap
  FROM (SELECT checkout, path, content, regexp_split_to_array(content, '{pat}') AS g FROM workflows) w, range(1, len(w.g) + 1) r(i)),
texts AS (SELECT g.checkout, g.path, g.content AS text, string_agg(g.gap || COALESCE(r.repl, ''), '' ORDER BY g.pos) AS new_text
  FROM gaps g LEFT JOIN rep2 r ON r.checkout = g.checkout AND r.path = g.path AND r.pos = g.pos
  GROUP BY g.checkout, g.path, g.content),
changed AS (SELECT * FROM texts WHERE new_text <> text)
""".replace("{pat}", USES_PATTERN)


def _rewrite_inputs(spark, sf_dir):
    files, names = fx(spark, sf_dir, "workflows", "ref_names")
    renames = spark.createDataFrame(RENAMES, "old_path string, new_path string")
    out = RF.workflow_updates(files, names, pin=True, renames=renames, keys=CHECKOUT)
    return out["texts"], out["changes"]


@register("rewrite_texts", "Q27", _refs_sql(_plan_sql(True, False, False) + _REWRITE_SQL
                                               + "SELECT checkout, path, text, new_text FROM changed"))
def q_rewrite_texts(spark, sf_dir):
    texts, _ = _rewrite_inputs(spark, sf_dir)
    return texts


@register("ref_changes", "Q27", _refs_sql(_plan_sql(True, False, False) + _REWRITE_SQL + """
SELECT r.checkout, r.path, r.pos, CASE WHEN r.latest_tag IS NULL THEN r.action_path ELSE r.np END AS action_path,
  CASE WHEN r.latest_tag IS NOT NULL AND r.latest_sha IS NOT NULL THEN substr(r.ref, 1, 12) ELSE r.ref END AS old,
  CASE WHEN r.latest_tag IS NOT NULL AND r.latest_sha IS NOT NULL THEN substr(r.latest_sha, 1, 12) || ' (' || r.latest_tag || ')'
    WHEN r.latest_tag IS NOT NULL THEN r.latest_tag ELSE r.np || '@' || r.ref END AS new
FROM rep2 r WHERE (r.latest_tag IS NOT NULL OR r.renamed) AND (r.checkout, r.path) IN (SELECT checkout, path FROM changed)"""))
def q_ref_changes(spark, sf_dir):
    _, changes = _rewrite_inputs(spark, sf_dir)
    return changes


# ====================================================================== sources, working files, pages

from repolens.functions.fixed_values import TEMP_PATTERNS  # noqa: E402
from repolens.operators import deprecations as DPC  # noqa: E402
from repolens.operators import manifest as MF  # noqa: E402
from repolens.operators import pages as PG  # noqa: E402
from repolens.operators import workfiles as WF  # noqa: E402


@register("overdue_deprecations", "Q21 V6", oracle_with(["sources", "package_versions"], r"""
, calls AS (SELECT package, path, CAST(3 AS BIGINT) AS line, CAST(4 AS BIGINT) AS col,
    regexp_extract(content, '\n    deprecated\("([^"]*)"', 1) AS version FROM sources
  WHERE regexp_matches(content, '\n    deprecated\("'))
SELECT c.package, c.path, c.line, c.col, c.version, regexp_extract(v.version, '^([0-9.]+)', 1) AS base_version,
  COALESCE(CAST(string_split(regexp_extract(v.version, '^([0-9.]+)', 1), '.') AS BIGINT[])
    >= CAST(string_split(c.version, '.') AS BIGINT[]), FALSE) AS overdue, 'ok' AS status
FROM calls c LEFT JOIN package_versions v ON c.package = v.package""".replace("\n, calls", ", calls", 1)))
def q_overdue_deprecations(spark, sf_dir):
    src, pv = fx(spark, sf_dir, "sources", "package_versions")
    return DPC.overdue_deprecations(src, pv)


@register("deprecation_summary", "Q21", oracle_with(["sources", "package_versions"], r"""
, calls AS (SELECT package, regexp_extract(content, '\n    deprecated\("([^"]*)"', 1) AS version FROM sources
  WHERE regexp_matches(content, '\n    deprecated\("'))
SELECT c.package, COUNT(*) AS calls, COUNT(*) FILTER (WHERE CAST(string_split(regexp_extract(v.version, '^([0-9.]+)', 1), '.') AS BIGINT[])
    >= CAST(string_split(c.version, '.') AS BIGINT[])) AS overdue, CAST(0 AS BIGINT) AS undecided
FROM calls c LEFT JOIN package_versions v ON c.package = v.package GROUP BY c.package""".replace("\n, calls", ", calls", 1)))
def q_deprecation_summary(spark, sf_dir):
    src, pv = fx(spark, sf_dir, "sources", "package_versions")
    return DPC.deprecation_summary(DPC.overdue_deprecations(src, pv))


@register("archive_plan", "Q28 V16", oracle_with(["dev_files", "issue_states"], r"""
, entries AS (SELECT DISTINCT string_split(path, '/')[1] AS folder, string_split(path, '/')[2] AS name FROM dev_files
  WHERE len(string_split(path, '/')) >= 2),
e2 AS (SELECT folder, name, replace(folder, 'dev_', '') AS repo,
    TRY_CAST(NULLIF(regexp_extract(name, '^\d+'), '') AS BIGINT) AS number FROM entries
  WHERE folder LIKE 'dev\_%' ESCAPE '\' AND name NOT LIKE '%archive%')
SELECT e.repo, e.folder, e.name, e.number, s.state,
  CASE WHEN e.number IS NULL THEN 'unassociated' WHEN s.state IN ('closed', 'merged') THEN 'archive' ELSE 'keep' END AS action,
  CASE WHEN e.number IS NOT NULL AND s.state IN ('closed', 'merged') THEN e.folder || '/archive/' || e.name END AS target
FROM e2 e LEFT JOIN issue_states s ON s.repo = e.repo AND s.number = e.number""".replace("\n, entries", ", entries", 1)))
def q_archive_plan(spark, sf_dir):
    files, issues = fx(spark, sf_dir, "dev_files", "issue_states")
    return WF.archive_plan(files, issues)


_GLOB_CASE = " ".join(
    f"WHEN list_bool_or(list_transform(string_split(path, '/'), lambda p: p GLOB '{g}')) THEN '{g}'" for g in TEMP_PATTERNS)


@register("stale_files", "Q29 V22", oracle_with(["dev_files"], f"""
SELECT path, pattern FROM (SELECT path, CASE {_GLOB_CASE} END AS pattern FROM dev_files) t WHERE pattern IS NOT NULL"""))
def q_stale_files(spark, sf_dir):
    (files,) = fx(spark, sf_dir, "dev_files")
    return WF.stale_files(files)


@register("recent_files", "Q30", oracle_with(["dev_files"], f"""
SELECT path, {sql_ts('mtime')} AS mtime FROM dev_files
WHERE regexp_matches(regexp_extract(path, '[^/]*$'), '\\d{{3,5}}.+?\\.py$') AND path NOT LIKE '%archive%' AND path LIKE 'dev\\_%' ESCAPE '\\'
ORDER BY mtime DESC, path DESC"""))
def q_recent_files(spark, sf_dir):
    (files,) = fx(spark, sf_dir, "dev_files")
    return WF.recent_files(files).withColumn("mtime", ts_text("mtime"))


_BLOCKS_SQL = r"""
, blocks AS (SELECT 'https://example.org/' || CAST(doc_id AS VARCHAR) AS url, CAST(0 AS BIGINT) AS block,
    'x = ' || CAST(n_chars AS VARCHAR) AS code,
    replace(regexp_replace('Bug: ' || lang || ' & more!', '[^\p{L}\p{N} ]', '', 'g'), ' ', '_') AS title,
    CAST(doc_id AS VARCHAR) AS number, 'dev_' || source AS repo FROM documents)
"""


@register("code_blocks", "Q31 V15", "WITH " + _BLOCKS_SQL.replace("\n, blocks", "blocks", 1)
          + "SELECT url, block, code, title, number, repo, number || '_' || title AS filename FROM blocks")
def q_code_blocks(spark, sf_dir):
    (pages,) = fx(spark, sf_dir, "issue_pages")
    return PG.code_blocks(pages)


_DOC_SQL = r"""
SELECT repo, number || '_' || title AS filename, url,
  '{"cells":[{"cell_type":"markdown","metadata":{},"source":["Downloaded from ' || url || ' at 2024-02-01."],"id":"'
    || substr(sha256(url), 1, 32) || '"},{"cell_type":"code","metadata":{},"outputs":[],"source":["' || code
    || '\n"],"execution_count":null,"id":"' || substr(sha256(url || '#0'), 1, 32)
    || '"}],"metadata":{"language_info":{"name":"python","pygments_lexer":"ipython3"}},"nbformat":4,"nbformat_minor":5}'
    AS notebook,
  '# Downloaded from ' || url || ' at 2024-02-01.' || CHR(10) || CHR(10) || '# %% Codeblock 1' || CHR(10)
    || 'import pandas as pd' || CHR(10) || code || CHR(10) || CHR(10) AS script,
  CAST(1 AS BIGINT) AS blocks
FROM blocks"""


@register("documents", "Q32", "WITH " + _BLOCKS_SQL.replace("\n, blocks", "blocks", 1) + _DOC_SQL)
def q_documents(spark, sf_dir):
    (pages,) = fx(spark, sf_dir, "issue_pages")
    return PG.assemble_documents(PG.code_blocks(pages), "2024-02-01", prelude="import pandas as pd")


@register("new_documents", "Q33", oracle_with(["stored_documents"], _BLOCKS_SQL + """
SELECT b.repo, b.number || '_' || b.title AS filename, b.url, CAST(1 AS BIGINT) AS blocks FROM blocks b
WHERE NOT EXISTS (SELECT 1 FROM stored_documents s WHERE s.repo = b.repo AND s.filename = b.number || '_' || b.title)"""))
def q_new_documents(spark, sf_dir):
    pages, stored = fx(spark, sf_dir, "issue_pages", "stored_documents")
    docs = PG.assemble_documents(PG.code_blocks(pages), "2024-02-01", prelude="import pandas as pd")
    return PG.insert_if_absent(docs, stored).select("repo", "filename", "url", "blocks")


@register("download_index", "Q37 S13", oracle_with(["downloads"], """
SELECT milestone, product, platform, url FROM downloads WHERE platform = 'linux64'"""))
def q_download_index(spark, sf_dir):
    (flat,) = fx(spark, sf_dir, "downloads")
    return MF.download_index(MF.nest_manifest(flat), platform="linux64")


@register("python_floor", "V23", oracle_with(["project_features"], """
SELECT main_package, arg_min(replace(feature, 'py3', '3.'), CAST(string_split(replace(feature, 'py3', '3.'), '.') AS BIGINT[]))
  AS python_floor
FROM project_features WHERE feature LIKE 'py3%' GROUP BY main_package"""))
def q_python_floor(spark, sf_dir):
    (features,) = fx(spark, sf_dir, "project_features")
    return DP.python_floor(features)


@register("changelog_lines", "Q8", _changelog_sql(f"""
, titled AS (SELECT DISTINCT repo, from_tag, to_tag, section, position FROM categorized),
all_lines AS (
  SELECT repo, from_tag, to_tag, -1 AS position, 0 AS sub, NULL AS merged_at, NULL AS number,
    '## Changelog (' || from_tag || '..' || to_tag || ')' AS line FROM sentences
  UNION ALL SELECT repo, from_tag, to_tag, -1, 1, NULL, NULL, '' FROM sentences
  UNION ALL SELECT repo, from_tag, to_tag, -1, 2, NULL, NULL, sentence FROM sentences
  UNION ALL SELECT repo, from_tag, to_tag, -1, 3, NULL, NULL, '' FROM sentences
  UNION ALL SELECT repo, from_tag, to_tag, position, 0, NULL, NULL, '### ' || section FROM titled
  UNION ALL SELECT repo, from_tag, to_tag, position, 1, merged_at, number, line FROM categorized
  UNION ALL SELECT repo, from_tag, to_tag, position, 2, NULL, NULL, '' FROM titled)
SELECT repo, from_tag, to_tag, CAST(position AS INTEGER) AS position, CAST(sub AS INTEGER) AS sub,
  {sql_ts('merged_at')} AS merged_at, CAST(number AS BIGINT) AS number, line FROM all_lines"""))
def q_changelog_lines(spark, sf_dir):
    prs, tags = fx(spark, sf_dir, "pull_requests", "tags")
    return CL.changelog_lines(prs, tags).withColumn("merged_at", ts_text("merged_at"))


@register("changelog_head_window", "Q9 Q1", oracle_with(["tags", "branch_heads"], f"""
, newest AS (SELECT repo, arg_max(tag, (COALESCE(pr_merged_at, committed_at), tag)) AS from_tag,
    MAX(COALESCE(pr_merged_at, committed_at)) AS from_at FROM tags WHERE NOT prerelease GROUP BY repo)
SELECT n.repo, n.from_tag, h.head AS to_tag, {sql_ts('n.from_at')} AS from_at, {sql_ts('h.head_at')} AS to_at
FROM newest n JOIN branch_heads h ON n.repo = h.repo""".replace("\n, newest", ", newest", 1)))
def q_changelog_head_window(spark, sf_dir):
    tags, heads = fx(spark, sf_dir, "tags", "branch_heads")
    w = CL.release_windows(tags, head=heads)
    return w.select("repo", "from_tag", "to_tag", ts_text("from_at").alias("from_at"), ts_text("to_at").alias("to_at"))


@register("changelog_chosen_windows", "Q9 Q1", oracle_with(["tags"], f"""
, asked AS (SELECT repo, MIN(tag) AS from_tag, MAX(tag) AS to_tag FROM tags GROUP BY repo, prerelease
  UNION ALL SELECT repo, MAX(tag), 'not a tag' FROM tags GROUP BY repo),
dated AS (SELECT repo, tag, COALESCE(pr_merged_at, committed_at) AS tagged_at FROM tags)
SELECT w.repo, w.from_tag, w.to_tag, {sql_ts('a.tagged_at')} AS from_at, {sql_ts('b.tagged_at')} AS to_at
FROM asked w JOIN dated a ON a.repo = w.repo AND a.tag = w.from_tag
JOIN dated b ON b.repo = w.repo AND b.tag = w.to_tag""".replace("\n, asked", ", asked", 1)))
def q_changelog_chosen_windows(spark, sf_dir):
    """Windows that a user names; one that names an unknown tag has no dates and is left out."""
    (tags,) = fx(spark, sf_dir, "tags")
    asked = tags.groupBy("repo", "prerelease").agg(F.min("tag").alias("from_tag"), F.max("tag").alias("to_tag")).drop("prerelease")
    unknown = tags.groupBy("repo").agg(F.max("tag").alias("from_tag")).withColumn("to_tag", F.lit("not a tag"))
    w = CL.chosen_windows(tags, asked.unionByName(unknown))
    return w.select("repo", "from_tag", "to_tag", ts_text("from_at").alias("from_at"), ts_text("to_at").alias("to_at"))


@register("unresolved_updates", "Q25", _refs_sql(_plan_sql(True, True, True)
                                                 + "SELECT s2.checkout, s2.repo, s2.ref, r.tag, s2.target FROM s2 JOIN refs r "
                                                   "ON r.checkout = s2.checkout AND r.repo = s2.repo AND r.ref = s2.ref "
                                                   "WHERE s2.target IS NOT NULL AND s2.commit_sha IS NULL"))
def q_unresolved_updates(spark, sf_dir):
    _, names, refs = _refs_inputs(spark, sf_dir)
    return RF.unresolved_updates(refs, names, expand=True, mutable=True, keys=CHECKOUT)


@register("run_history", "Q11 V20", oracle_with(["workflow_runs"], f"""
, hist AS (SELECT * FROM workflow_runs)
SELECT h.repo, h.name AS workflow, h.run_number, {_label_sql('h')} AS label,
  'https://api.github.com/repos/' || h.repo || '/actions/runs/' || CAST(h.run_number AS VARCHAR) || '/artifacts' AS artifacts_url
FROM hist h""".replace("\n, hist", ", hist", 1)))
def q_run_history(spark, sf_dir):
    (runs,) = fx(spark, sf_dir, "workflow_runs")
    return RU.run_history(runs)


# ====================================================================== readers over landed pages

from repolens.plans import landing as LD  # noqa: E402
from repolens.sources import landed as LP  # noqa: E402
from repolens.sources import readers as RD  # noqa: E402
from repolens.streaming import polls as SP  # noqa: E402


@register("landed_pull_requests", "S1", oracle_with(["pull_requests"], f"""
SELECT repo, number, title, COALESCE(author, 'unknown') AS author, {sql_ts('merged_at')} AS merged_at FROM pull_requests"""))
def q_landed_pull_requests(spark, sf_dir):
    (prs,) = fx(spark, sf_dir, "pull_requests")
    out = RD.read_pull_requests(spark, LD.land_pull_requests(prs), multi_line=False)
    return out.withColumn("merged_at", ts_text("merged_at"))


@register("landed_runs", "S3", oracle_with(["workflow_runs"], f"""
SELECT repo, run_number, name, head_branch, display_title, status, conclusion,
  {sql_ts('run_started_at')} AS run_started_at, actor FROM workflow_runs"""))
def q_landed_runs(spark, sf_dir):
    (runs,) = fx(spark, sf_dir, "workflow_runs")
    out = RD.read_runs(spark, LD.land_runs(runs), multi_line=False)
    return out.select("repo", "run_number", "name", "head_branch", "display_title", "status", "conclusion",
                      ts_text("run_started_at").alias("run_started_at"), "actor")


_DAMAGED_SQL = """
ranked AS (SELECT repo, run_number, ROW_NUMBER() OVER (PARTITION BY repo ORDER BY run_number, status) - 1 AS r FROM workflow_runs),
paged AS (SELECT repo, run_number, CAST(FLOOR(r / 30) AS BIGINT) AS page FROM ranked),
pages AS (SELECT repo, page, COUNT(*) AS n, CASE (page * 7 + length(repo)) % 5 WHEN 1 THEN 'unparsed' WHEN 2 THEN 'missing' ELSE 'ok' END AS status
  FROM paged GROUP BY repo, page)"""


@register("landed_page_status", "S3", oracle_with(["workflow_runs"], "," + _DAMAGED_SQL + """,
present AS (SELECT repo, MAX(page) AS last FROM pages WHERE status <> 'missing' GROUP BY repo)
SELECT p.repo, p.page, p.status, CASE WHEN p.status = 'ok' THEN p.n ELSE 0 END AS rows
FROM pages p JOIN present l ON p.repo = l.repo AND p.page <= l.last
UNION ALL
SELECT repo, NULL AS page, 'short' AS status, CAST(SUM(n) - SUM(CASE WHEN status = 'ok' THEN n ELSE 0 END) AS BIGINT) AS rows
FROM pages GROUP BY repo HAVING SUM(CASE WHEN status = 'ok' THEN 1 ELSE 0 END) > 0 AND SUM(CASE WHEN status = 'ok' THEN 0 ELSE 1 END) > 0"""))
def q_landed_page_status(spark, sf_dir):
    """Cut, missing and whole pages of run lists, and the lists whose pages hold fewer runs than they report."""
    (runs,) = fx(spark, sf_dir, "workflow_runs")
    status = LP.page_status(spark, LD.land_damaged_runs(runs), RD.RUNS_SCHEMA, "workflow_runs", listing="/repo=([^/]+)/",
                            page=r"/page=(\d+)\.json$", total="total_count")
    return status.select(F.col("listing").alias("repo"), "page", "status", "rows")


@register("landed_whole_pages", "S3", oracle_with(["workflow_runs"], "," + _DAMAGED_SQL + """
SELECT r.repo, r.run_number FROM paged r JOIN pages p ON r.repo = p.repo AND r.page = p.page WHERE p.status = 'ok'"""))
def q_landed_whole_pages(spark, sf_dir):
    """The runs of all whole pages."""
    (runs,) = fx(spark, sf_dir, "workflow_runs")
    return RD.read_runs(spark, LD.land_damaged_runs(runs), bad_pages="skip").select("repo", "run_number")


@register("landed_run_pairs", "S3 Q11 V20", "SELECT repo, workflow || '.yaml' AS workflow, good_run, bad_run, good_label, bad_label, "
          "replace(good_url, '/repos/', '/repos/org/') AS good_url, replace(bad_url, '/repos/', '/repos/org/') AS bad_url FROM ("
          + REGISTRY["run_pairs"].oracle + ") p")
def q_landed_run_pairs(spark, sf_dir):
    """Run pairs by workflow file, from landed pages."""
    runs, req = fx(spark, sf_dir, "workflow_runs", "run_requests")
    landed = RD.read_runs(spark, LD.land_runs(runs), multi_line=False)
    asked = req.withColumn("workflow", F.concat("workflow", F.lit(".yaml")))
    return RU.run_pairs(landed, asked, workflow="workflow_file")


@register("polled_open_runs", "Q10 S3", oracle_with(["workflow_runs"], f""",
polled AS (SELECT * REPLACE (CASE WHEN run_number % 11 <> 0 THEN status WHEN run_number % 5 = 0 THEN 'queued' ELSE 'in_progress' END AS status)
  FROM workflow_runs)
SELECT repo, name AS workflow, head_branch AS branch, display_title AS title, status,
  {sql_ts('run_started_at')} AS started_at,
  CAST(CAST(round_even((epoch_us(TIMESTAMP '{AS_OF}') - epoch_us(run_started_at)) / 1e6 / 60.0, 0) AS BIGINT) AS VARCHAR) || ' min' AS duration,
  actor AS "user"
FROM polled WHERE status IS DISTINCT FROM 'completed'"""))
def q_polled_open_runs(spark, sf_dir):
    """Three polls of all runs through the stateful stream; the middle one lands last, after a restart."""
    (runs,) = fx(spark, sf_dir, "workflow_runs")
    landing, log, checkpoint = (LD.landing_folder(spark, n) for n in ("polls", "run_changes", "run_changes_state"))
    for polls in ((0, 2), (1,)):
        for poll in polls:
            LD.land_poll(runs, poll, landing)
        SP.start_run_changes(spark, landing, log, checkpoint, multi_line=False).awaitTermination()
    return SP.open_runs(SP.read_changes(spark, log), AS_OF).withColumn("started_at", ts_text("started_at"))


@register("landed_artifacts", "S4", oracle_with(["artifacts"], """
SELECT run_number, name, archive_download_url,
  CAST(ROW_NUMBER() OVER (PARTITION BY run_number ORDER BY position, name, archive_download_url) - 1 AS BIGINT) AS position
FROM artifacts"""))
def q_landed_artifacts(spark, sf_dir):
    (arts,) = fx(spark, sf_dir, "artifacts")
    return RD.read_artifacts(spark, LD.land_artifacts(arts), multi_line=False)


@register("landed_index_files", "S7", oracle_with(["index_files"], f"""
SELECT package, filename, requires_python, {sql_ts('upload_time')} AS upload_time FROM index_files"""))
def q_landed_index_files(spark, sf_dir):
    (files,) = fx(spark, sf_dir, "index_files")
    out = RD.read_index_files(spark, LD.land_index_files(files), multi_line=False)
    return out.withColumn("upload_time", ts_text("upload_time"))


@register("landed_requirements", "S8", oracle_with(["requirements"], """
SELECT main_package, requirement FROM requirements"""))
def q_landed_requirements(spark, sf_dir):
    (req,) = fx(spark, sf_dir, "requirements")
    return RD.read_requirements(spark, LD.land_requirements(req), multi_line=False)


@register("landed_versions", "S12", oracle_with(["version_results"], """
SELECT DISTINCT package, version FROM version_results"""))
def q_landed_versions(spark, sf_dir):
    (results,) = fx(spark, sf_dir, "version_results")
    return RD.read_versions(spark, LD.land_versions(results.select("package", "version")), multi_line=False)


@register("landed_code_blocks", "S11 Q31", "WITH " + _BLOCKS_SQL.replace("\n, blocks", "blocks", 1)
          + "SELECT url, block, code, title, number, repo, number || '_' || title AS filename FROM blocks")
def q_landed_code_blocks(spark, sf_dir):
    (pages,) = fx(spark, sf_dir, "issue_pages")
    return PG.code_blocks(RD.read_pages(spark, LD.land_pages(pages)))


@register("landed_package_diff", "S6 Q15", REGISTRY["package_diff"].oracle)
def q_landed_package_diff(spark, sf_dir):
    (locks,) = fx(spark, sf_dir, "lock_packages")
    read = RD.read_locks(spark, LD.land_locks(locks))
    read = read.withColumn("side", F.regexp_extract("source_file", r"/side=([^/]+)/", 1))
    return DF.package_diff(read)


@register("landed_head_window", "S2 Q9", REGISTRY["changelog_head_window"].oracle)
def q_landed_head_window(spark, sf_dir):
    tags, heads = fx(spark, sf_dir, "tags", "branch_heads")
    rel = RD.read_releases(spark, LD.land_releases(tags), repo_pattern=r"/repo=([^/]+)/",
                           page_pattern=r"/page=([0-9]+)/")
    dated = rel.join(tags.select("repo", "tag", "committed_at", "pr_merged_at"), ["repo", "tag"])
    w = CL.release_windows(dated, head=heads)
    return w.select("repo", "from_tag", "to_tag", ts_text("from_at").alias("from_at"), ts_text("to_at").alias("to_at"))


@register("landed_file_list_diff", "S5 Q16", REGISTRY["file_list_diff"].oracle)
def q_landed_file_list_diff(spark, sf_dir):
    (members,) = fx(spark, sf_dir, "archive_members")
    landed = LD.land_archives(members)
    side = F.regexp_extract("path", r"/side=([^/]+)/", 1).alias("side")
    return DF.file_list_diff(RD.read_archive_members(spark, landed).select("*", side),
                             archives=RD.read_archive_names(spark, landed).select("*", side))


@register("landed_nested_file_list_diff", "S5 Q16", REGISTRY["file_list_diff"].oracle)
def q_landed_nested_file_list_diff(spark, sf_dir):
    """Archives inside downloaded zips, some of which were cut short."""
    (members,) = fx(spark, sf_dir, "archive_members")
    read = RD.read_archive_members(spark, LD.land_nested_archives(members), bad_archives="status")
    inner = read.filter("status = 'ok' AND format <> 'zip'").withColumn("side", F.regexp_extract("path", r"/side=([^/]+)/", 1))
    return DF.file_list_diff(inner)


@register("landed_archive_status", "S5", oracle_with(["archive_members"], """
, outer_zip AS (SELECT side, format, COUNT(DISTINCT archive) + 1 AS members FROM archive_members GROUP BY side, format)
SELECT side, format || '.zip' AS archive, 'zip' AS format, TRUE AS whole, members FROM outer_zip
UNION ALL SELECT side, 'cut-' || format || '.zip', 'zip', FALSE, 0 FROM outer_zip
UNION ALL SELECT side, archive, format, TRUE, COUNT(DISTINCT member) FROM archive_members GROUP BY side, archive, format""".replace("\n, outer_zip", ", outer_zip", 1)))
def q_landed_archive_status(spark, sf_dir):
    """Members per archive, inside downloaded zips too, and the zips that cannot be read."""
    (members,) = fx(spark, sf_dir, "archive_members")
    read = RD.read_archive_members(spark, LD.land_nested_archives(members), bad_archives="status", partition_bytes=20_000)
    side = F.regexp_extract("path", r"/side=([^/]+)/", 1)
    return read.groupBy(side.alias("side"), "archive", "format", (F.col("status") == "ok").alias("whole")).agg(
        F.count("member").alias("members"))


@register("landed_download_index", "S13 Q37", REGISTRY["download_index"].oracle)
def q_landed_download_index(spark, sf_dir):
    (flat,) = fx(spark, sf_dir, "downloads")
    return MF.download_index(RD.read_manifest(spark, LD.land_manifests(flat), multi_line=False), platform="linux64")


@register("landed_ref_plan", "Q24 Q25", REGISTRY["ref_update_plan_pinned"].oracle)
def q_landed_ref_plan(spark, sf_dir):
    _, names, refs = _refs_inputs(spark, sf_dir)
    at, tags_at = LD.land_refs(names)
    return RF.plan_ref_updates(refs, RD.read_ref_objects(spark, at, multi_line=False), pin=True, expand=True,
                               mutable=True, tag_objects=RD.read_tag_objects(spark, tags_at, multi_line=False),
                               keys=CHECKOUT)


@register("landed_windows", "Q1 Q9", REGISTRY["changelog_windows"].oracle)
def q_landed_windows(spark, sf_dir):
    (tags,) = fx(spark, sf_dir, "tags")
    tags = tags.withColumn("sha", F.sha1(F.concat("repo", "tag")))
    commits = RD.read_commit_dates(spark, LD.land_commits(tags), r"/repo=([^/]+)/", r"/sha=([^/]+)/", multi_line=False)
    w = CL.release_windows(CL.tag_dates(tags.select("repo", "tag", "prerelease", "sha"), commits))
    return w.select("repo", "from_tag", "to_tag", ts_text("from_at").alias("from_at"), ts_text("to_at").alias("to_at"))


@register("landed_archive_plan", "Q28", REGISTRY["archive_plan"].oracle)
def q_landed_archive_plan(spark, sf_dir):
    files, issues = fx(spark, sf_dir, "dev_files", "issue_states")
    return WF.archive_plan(files, RD.read_issue_states(spark, LD.land_issues(issues), multi_line=False))


# ====================================================================== sinks, written and read back

from repolens.sources import sinks as K  # noqa: E402


def _stored_changelogs(spark, sf_dir) -> str:
    prs, tags = fx(spark, sf_dir, "pull_requests", "tags")
    folder = LD.landing_folder(spark, "changelogs")
    K.write_changelogs(CL.changelog_document(prs, tags), folder)
    return folder


def _window_of(path: str) -> list[Column]:
    return [F.regexp_extract(path, f"/{c}=([^/]+)/", 1).alias(c) for c in K.WINDOW]


@register("stored_changelogs", "K1 S9", REGISTRY["changelog_document"].oracle)
def q_stored_changelogs(spark, sf_dir):
    texts = RD.read_texts(spark, _stored_changelogs(spark, sf_dir), "*.txt")
    whole = F.expr("substring(content, 1, length(content) - 1)")  # the text sink ends each value with a newline
    return texts.select(*_window_of("path"), whole.alias("changelog"))


@register("stored_listing", "K1 S10", "SELECT repo, from_tag, to_tag, CAST(strlen(changelog) + 1 AS BIGINT) AS length, TRUE AS just_written FROM ("
          + REGISTRY["changelog_document"].oracle + ") d")
def q_stored_listing(spark, sf_dir):
    """Lengths of the written files (a text and its line end), and whether their times lie inside this run."""
    before = F.lit(dt.datetime.now(dt.UTC).replace(tzinfo=None) - dt.timedelta(seconds=2)).cast("timestamp_ntz")
    listed = RD.read_file_listing(spark, _stored_changelogs(spark, sf_dir), include_hidden=True)
    texts = listed.filter(F.col("path").rlike(r"/part-[^/]*\.txt$"))
    now = F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()).cast("timestamp_ntz")
    return texts.select(*_window_of("path"), "length", F.col("mtime").between(before, now).alias("just_written"))


@register("stored_documents", "K2 K4 Q33", oracle_with(["stored_documents"], _BLOCKS_SQL + f"""
, docs AS ({_DOC_SQL})
SELECT DISTINCT repo, filename, 'ipynb' AS kind, '' AS content FROM stored_documents
UNION ALL SELECT repo, filename, 'ipynb', notebook FROM docs d
  WHERE NOT EXISTS (SELECT 1 FROM stored_documents s WHERE s.repo = d.repo AND s.filename = d.filename)
UNION ALL SELECT repo, filename, 'py', script FROM docs"""))
def q_stored_documents(spark, sf_dir):
    pages, stored = fx(spark, sf_dir, "issue_pages", "stored_documents")
    folder = LD.landing_folder(spark, "documents")
    notebooks = stored.select("repo", "filename", F.lit("ipynb").alias("kind"), F.lit("").alias("content")).distinct()
    K.write_table(notebooks, folder, partition_by=["repo"])
    # equal pages give one document
    docs = PG.assemble_documents(PG.code_blocks(pages), "2024-02-01", prelude="import pandas as pd")
    K.write_documents(docs.unionAll(docs), folder)
    return K.read_documents(spark, folder)


@register("stored_rewrites", "K3 S9 Q27", _refs_sql(_plan_sql(True, False, False) + _REWRITE_SQL
                                                    + "SELECT checkout || '/' || path AS path, new_text AS content FROM changed"))
def q_stored_rewrites(spark, sf_dir):
    """Rewritten workflow files, written twice (the second job replaces equal files) and read back."""
    texts, changes = _rewrite_inputs(spark, sf_dir)
    texts = texts.checkpoint(eager=True)
    target = LD.landing_folder(spark, "rewrites")
    for _ in range(2):
        K.write_rewrites(texts, changes, target, keys=CHECKOUT)
    return RD.read_texts(spark, target, "*.y*ml", root=target, include_hidden=True)


@register("stored_changelog_parts", "K1 Q7 Q8 S9", REGISTRY["changelog_document"].oracle)
def q_stored_changelog_parts(spark, sf_dir):
    """Changelogs written in parts of 4,000 bytes, read back by their manifests and joined for the comparison."""
    prs, tags = fx(spark, sf_dir, "pull_requests", "tags")
    folder = LD.landing_folder(spark, "changelog_parts")
    K.write_changelog_parts(CL.changelog_pieces(prs, tags), folder, part_bytes=4000)
    parts = K.read_changelog_parts(spark, folder).filter("status = 'ok'")
    whole = parts.groupBy(*K.WINDOW).agg(F.sort_array(F.collect_list(F.struct("start", "content"))).alias("p"))
    return whole.select(*K.WINDOW, F.array_join(F.transform("p", lambda x: x["content"]), "").alias("changelog"))


@register("stored_document_files", "K2 Q33 S9", oracle_with(["issue_pages"], _BLOCKS_SQL + f"""
, docs AS ({_DOC_SQL})
SELECT repo || '/' || filename || '.ipynb' AS name, notebook AS content FROM docs
UNION ALL SELECT repo || '/' || filename || '.py', script FROM docs"""))
def q_stored_document_files(spark, sf_dir):
    """Documents as files at their own names, stored twice; the second time nothing is new."""
    (pages,) = fx(spark, sf_dir, "issue_pages")
    docs = PG.assemble_documents(PG.code_blocks(pages), "2024-02-01", prelude="import pandas as pd").checkpoint(eager=True)
    folder = LD.landing_folder(spark, "document_files")
    first = K.write_document_files(docs, folder)
    again = K.write_document_files(docs.withColumn("script", F.lit("other")).withColumn("notebook", F.lit("other")), folder)
    texts = RD.read_texts(spark, folder, "*", root=folder, include_hidden=True)
    stored = texts.withColumnRenamed("path", "name").join(first.select("name"), "name", "left_semi")
    return stored.join(again.select("name"), "name", "left_anti")
