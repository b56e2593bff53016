"""Operator inputs derived from the driver tables.

Each derivation is SQL in the subset Spark and DuckDB share, so the Spark
query and the DuckDB oracle start from identical rows. Table names appear as
``{name}``; ``load`` binds them to parquet scans in Spark, ``oracle_cte``
binds them to the DuckDB views. Every derivation reads its whole base table.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

FIXTURE_SQL: dict[str, str] = {
    "pull_requests": """
SELECT 'repo' || CAST(event_id % 7 AS STRING) AS repo, event_id AS number,
  CASE event_id % 11 WHEN 0 THEN 'feat: ' WHEN 1 THEN 'enh(ui): ' WHEN 2 THEN 'fix!: ' WHEN 3 THEN 'Docs: '
    WHEN 4 THEN 'oops: ' WHEN 5 THEN 'Merge branch: ' WHEN 6 THEN 'perf(core)!: ' WHEN 7 THEN 'ci:' WHEN 8 THEN 'fix: ' ELSE '' END
    || CASE WHEN event_id % 77 = 7 THEN '' ELSE event_type || ' ' || CAST(user_id AS STRING) END AS title,
  CASE WHEN event_id % 97 = 0 THEN NULL WHEN user_id % 29 = 0 THEN 'dependabot' ELSE 'User' || CAST(user_id AS STRING) END AS author,
  ts AS merged_at
FROM {events}""",
    "tags": """
SELECT repo, 'v1.' || CAST(minor AS STRING) || '.0' || CASE WHEN minor = 1 THEN 'rc1' ELSE '' END AS tag,
  minor = 1 AS prerelease, MIN(ts) AS committed_at,
  CASE WHEN minor = 2 THEN NULL ELSE MIN(ts) + INTERVAL 1 HOUR END AS pr_merged_at
FROM (SELECT 'repo' || CAST(event_id % 7 AS STRING) AS repo,
        CAST(FLOOR((EXTRACT(DAY FROM ts) - 1) / 8) AS INT) AS minor, ts FROM {events}) e
GROUP BY repo, minor""",
    "branch_heads": """
SELECT 'repo' || CAST(event_id % 7 AS STRING) AS repo, 'main' AS head, MAX(ts) AS head_at
FROM {events} GROUP BY 1""",
    "workflow_runs": """
SELECT 'repo' || CAST(event_id % 7 AS STRING) AS repo, event_id AS run_number, event_type AS name,
  CASE WHEN event_id % 3 = 0 THEN 'main' ELSE 'br' || CAST(user_id AS STRING) END AS head_branch,
  'run ' || CAST(event_id AS STRING) AS display_title,
  CASE event_type WHEN 'error' THEN 'in_progress' WHEN 'signup' THEN 'queued' ELSE 'completed' END AS status,
  CASE event_type WHEN 'click' THEN 'success' WHEN 'view' THEN 'failure' WHEN 'purchase' THEN 'cancelled' END AS conclusion,
  ts AS run_started_at, 'User' || CAST(user_id AS STRING) AS actor
FROM {events}""",
    "run_requests": """
SELECT 'repo' || CAST(event_id % 7 AS STRING) AS repo, event_type AS workflow,
  MAX(CASE WHEN event_id % 5 = 1 THEN event_id END) AS good_run, MAX(CASE WHEN event_id % 5 = 2 THEN event_id END) AS bad_run
FROM {events} GROUP BY 1, 2""",
    "artifacts": """
SELECT l_orderkey AS run_number,
  CASE l_linenumber WHEN 1 THEN 'pip' WHEN 2 THEN 'conda' WHEN 3 THEN 'npm' WHEN 4 THEN 'pixi-lock'
    ELSE 'log' || CAST(l_linenumber AS STRING) END AS name,
  CAST(MIN(l_linenumber) AS BIGINT) AS position,
  'https://x.org/a/' || CAST(l_orderkey AS STRING) || '/' || CAST(l_linenumber AS STRING) AS archive_download_url
FROM {lineitem} GROUP BY l_orderkey, l_linenumber""",
    "text_files": """
SELECT CASE WHEN l_linestatus = 'O' THEN 'good' ELSE 'bad' END AS side,
  'env_' || CAST(l_suppkey % 10 AS STRING) || '_linux_3.11_unit.txt' AS path,
  l_orderkey * 8 + l_linenumber AS line_no,
  'lib-' || CAST(l_partkey % 300 AS STRING) || '==' || CAST(CAST(l_quantity AS INT) % 4 AS STRING) AS line
FROM {lineitem}""",
    "run_env_files": """
SELECT DISTINCT l_orderkey AS run, CASE WHEN l_linenumber % 2 = 0 THEN 'good' ELSE 'bad' END AS side,
  CASE WHEN l_linenumber % 2 = 0 THEN 'good' ELSE 'bad' END || '/Env_' || CAST(l_suppkey % 2 AS STRING)
    || CASE WHEN l_partkey % 4 = 0 THEN '_osx' WHEN l_partkey % 4 = 1 THEN '_Linux' ELSE '_linux' END
    || CASE WHEN l_quantity < 10 THEN '_3.12' ELSE '_3.11' END || CASE WHEN l_orderkey % 7 = 0 THEN '_ui' ELSE '_unit' END || '.txt' AS path
FROM {lineitem}""",
    "run_dumps": """
SELECT 'good' AS side, path, no AS line_no, line FROM (SELECT DISTINCT 'env_' || CAST(l_suppkey % 10 AS STRING) || '_linux_3.12_unit.txt' AS path,
    l_orderkey * 8 + l_linenumber AS no,
    CASE WHEN l_linenumber = 7 THEN '' ELSE 'lib-' || CAST(l_orderkey AS STRING) || '-' || CAST(l_linenumber AS STRING) END AS line
  FROM {lineitem}) g
UNION ALL
SELECT 'bad' AS side, path, CASE WHEN CAST(FLOOR(o / 64) AS BIGINT) % 11 = 0 THEN no + 1000000000000 ELSE no END AS line_no,
  CASE WHEN o % 13 = 0 THEN line || '+1' ELSE line END AS line
FROM (SELECT DISTINCT 'env_' || CAST(l_suppkey % 10 AS STRING) || '_linux_3.12_unit.txt' AS path, l_orderkey * 8 + l_linenumber AS no, l_orderkey AS o,
    CASE WHEN l_linenumber = 7 THEN '' ELSE 'lib-' || CAST(l_orderkey AS STRING) || '-' || CAST(l_linenumber AS STRING) END AS line
  FROM {lineitem}) b
WHERE o % 17 <> 0""",
    "lock_packages": """
SELECT side, env, arch, 'https://x.org/' || arch || '/' || pkg || '-' || CAST(ver AS STRING) || '.0-py_0.conda' AS url
FROM (SELECT CASE WHEN l_linestatus = 'O' THEN 'good' ELSE 'bad' END AS side,
    CASE l_linenumber % 4 WHEN 0 THEN 'docs' WHEN 1 THEN 'test-311' WHEN 2 THEN 'test-312' ELSE 'test-ui' END AS env,
    CASE WHEN l_suppkey % 2 = 0 THEN 'linux-64' WHEN l_linestatus = 'O' THEN 'osx-arm64' ELSE 'win-64' END AS arch,
    'lib-' || CAST(l_partkey % 40 AS STRING) AS pkg, MAX(CAST(l_quantity AS INT)) AS ver
  FROM {lineitem} GROUP BY 1, 2, 3, 4) t""",
    "archive_members": """
SELECT DISTINCT side, format, archive, member FROM (
  SELECT CASE WHEN l_linestatus = 'O' THEN 'good' ELSE 'bad' END AS side, 'wheel' AS format,
    CASE WHEN l_linestatus = 'O' THEN 'lib-1.2.3rc1-py3-none-any.whl' ELSE 'lib-1.2.4-py3-none-any.whl' END AS archive,
    CASE WHEN l_linestatus = 'O' THEN 'lib-1.2.3rc1' ELSE 'lib-1.2.4' END || '/f'
      || CAST(CASE WHEN l_linestatus = 'O' THEN l_partkey % 500 ELSE l_partkey % 480 + 10 END AS STRING) || '.py' AS member
  FROM {lineitem}
  UNION ALL
  SELECT CASE WHEN l_linestatus = 'O' THEN 'good' ELSE 'bad' END AS side, 'sdist' AS format,
    CASE WHEN l_linestatus = 'O' THEN 'lib-1.2.3rc1.tar.gz' ELSE 'lib-1.2.4.tar.gz' END AS archive,
    CASE WHEN l_linestatus = 'O' THEN 'lib-1.2.3rc1' ELSE 'lib-1.2.4' END || '/src/m'
      || CAST(CASE WHEN l_linestatus = 'O' THEN l_suppkey % 60 ELSE l_suppkey % 55 + 3 END AS STRING) || '.py' AS member
  FROM {lineitem}
  UNION ALL
  SELECT CASE WHEN l_linestatus = 'O' THEN 'good' ELSE 'bad' END AS side, 'conda1' AS format,
    CASE WHEN l_suppkey % 2 = 0 THEN 'lib-core' ELSE 'lib' END || '-1.2.3-py_0.tar.bz2' AS archive,
    'site-packages/c' || CAST(CASE WHEN l_linestatus = 'O' THEN l_partkey % 70 ELSE l_partkey % 64 + 2 END AS STRING) AS member
  FROM {lineitem}
  UNION ALL
  SELECT 'good' AS side, 'npm' AS format, 'lib-1.2.3.tgz' AS archive,
    'package/n' || CAST(l_suppkey % 30 AS STRING) || '.js' AS member
  FROM {lineitem}) t""",
    "archive_files": """
SELECT DISTINCT CASE WHEN l_linestatus = 'O' THEN 'good' ELSE 'bad' END AS side,
  CASE l_linenumber % 4 WHEN 0 THEN 'wheel' WHEN 1 THEN 'sdist' WHEN 2 THEN 'conda' ELSE 'conda1' END AS format,
  'lib' || CASE WHEN l_suppkey % 3 = 0 THEN '-core' ELSE '' END || '-1.' || CAST(l_suppkey % 4 AS STRING)
    || CASE WHEN l_suppkey % 5 = 0 THEN '' ELSE '.0' END
    || CASE l_linenumber % 4 WHEN 0 THEN '-py3-none-any.whl' WHEN 1 THEN '.tar.gz' WHEN 2 THEN '-py_0.conda' ELSE '-py_0.tar.bz2' END AS archive
FROM {lineitem}""",
    "index_files": """
SELECT 'pkg' || CAST(l_partkey % 200 AS STRING) AS package,
  CASE WHEN l_orderkey % 53 = 0 THEN 'notadist.exe' ELSE 'pkg' || CAST(l_partkey % 200 AS STRING) || '-' || CAST(l_linenumber % 3 AS STRING) || '.' ||
    CAST(CAST(l_quantity AS INT) % 12 AS STRING) || '.' || CAST(l_suppkey % 3 AS STRING) || CASE WHEN l_orderkey % 9 = 0 THEN 'rc1' ELSE '' END ||
    CASE WHEN l_returnflag = 'R' THEN '.tar.gz' ELSE '-py3-none-any.whl' END END AS filename,
  CASE l_orderkey % 4 WHEN 0 THEN NULL WHEN 1 THEN '>=3.8' WHEN 2 THEN '>=3.9,<4' ELSE '!=3.10.*,>=3.7' END AS requires_python,
  l_shipdate AS upload_time
FROM {lineitem}""",
    "requirements": """
SELECT 'main' || CAST(p_partkey % 20 AS STRING) AS main_package,
  CASE p_partkey % 7 WHEN 0 THEN 'cudf' WHEN 1 THEN 'dask-core' WHEN 2 THEN 'python-duckdb' WHEN 3 THEN 'graphviz'
    ELSE CASE WHEN p_partkey % 3 = 0 THEN 'PKG' ELSE 'pkg' END || CAST(p_partkey % 200 AS STRING) END
  || CASE p_partkey % 4 WHEN 0 THEN '' WHEN 1 THEN '>=1.0' WHEN 2 THEN '[all]>=2,<3' ELSE ' ; extra == "test"' END AS requirement,
  CASE WHEN p_partkey % 5 < 2 THEN 'index' ELSE 'project' END AS kind
FROM {part}""",
    "project_features": """
SELECT DISTINCT 'main' || CAST(p_partkey % 20 AS STRING) AS main_package,
  CASE WHEN p_size % 3 = 0 THEN 'test-' || p_brand ELSE 'py3' || CAST(9 + p_size % 5 AS STRING) END AS feature
FROM {part}""",
    "sources": """
SELECT 'pkg' || CAST(o_custkey % 5 AS STRING) AS package, 'pkg/f' || CAST(o_orderkey AS STRING) || '.py' AS path,
  'import x' || CHR(10) || 'if x:' || CHR(10) || '    ' ||
  CASE o_orderkey % 4 WHEN 0 THEN 'warn' WHEN 1 THEN 'm.deprecated' ELSE 'deprecated' END
  || '("1.' || CAST(o_orderkey % 15 AS STRING) || '", "old")' || CHR(10) AS content
FROM {orders}""",
    "package_versions": """
SELECT 'pkg' || CAST(n_nationkey % 5 AS STRING) AS package,
  MAX('1.' || CAST(n_nationkey % 5 + 5 AS STRING) || '.0rc1') AS version
FROM {nation} GROUP BY 1""",
    "workflows": """
SELECT 'checkout' || CAST(c_custkey % 2 AS STRING) AS checkout,
  '.github/workflows/w' || CAST(c_custkey - c_custkey % 2 AS STRING) || '.yaml' AS path,
  'steps:' || CHR(10) || '  - uses: org' || CAST(c_nationkey AS STRING) || '/act@v' || CAST(c_custkey % 4 AS STRING)
  || CASE WHEN c_custkey % 3 = 0 THEN '.1.0' ELSE '' END || ' # note' || CHR(10)
  || '  - uses: org' || CAST(c_nationkey AS STRING) || '/act/sub@' || MD5(CAST(c_custkey % 9 AS STRING)) || 'abcdef01'
  || CASE WHEN c_custkey % 2 = 0 THEN ' # v1' ELSE '' END || CHR(10)
  || '  - uses: ./local' || CHR(10)
  || CASE WHEN c_custkey % 5 = 0 THEN '  - uses: tools/tasks/old_setup@v1' || CHR(10) ELSE '' END AS content
FROM {customer}""",
    "ref_names": """
SELECT 'org' || CAST(s_nationkey AS STRING) || '/act' AS repo, CASE WHEN s_suppkey % 5 = 0 THEN 'branch' ELSE 'tag' END AS kind,
  'v' || CAST(s_suppkey % 6 AS STRING) || CASE WHEN s_suppkey % 2 = 0 THEN '.' || CAST(s_suppkey % 11 AS STRING) || '.0' ELSE '' END AS name,
  MD5('c' || CAST(s_suppkey AS STRING)) || '00000000' AS commit_sha
FROM {supplier}""",
    "dev_files": """
SELECT 'dev_repo' || CAST(o_custkey % 7 AS STRING) || '/' || CASE WHEN o_orderkey % 13 = 0 THEN 'archive/' ELSE '' END ||
  CASE WHEN o_orderkey % 11 = 0 THEN 'tmp' ELSE CAST(o_orderkey AS STRING) || '_' END || 'note.py' AS path,
  o_orderdate AS mtime
FROM {orders}""",
    "issue_states": """
SELECT 'repo' || CAST(o_custkey % 7 AS STRING) AS repo, o_orderkey AS number,
  CASE o_orderstatus WHEN 'F' THEN 'closed' WHEN 'O' THEN 'open' ELSE 'merged' END AS state
FROM {orders}""",
    "issue_pages": """
SELECT 'https://example.org/' || CAST(doc_id AS STRING) AS url,
  '<html><head><title>Bug: ' || lang || ' &amp; more! · Issue #' || CAST(doc_id AS STRING) || ' · org/' || source
  || '</title></head><body><div class="highlight x"><pre>x = ' || CAST(n_chars AS STRING)
  || '</pre></div><div class="notranslate"><pre>not python (</pre></div></body></html>' AS html
FROM {documents}""",
    "version_results": """
SELECT 'pkg' || CAST(l_partkey % 50 AS STRING) AS package, '1.' || CAST(CAST(l_quantity AS INT) AS STRING) || '.0' AS version,
  CAST(l_quantity AS INT) < 10 + (l_partkey % 50) % 30 AS passed
FROM {lineitem} GROUP BY 1, 2, 3""",
    "bisect_ranges": """
SELECT 'pkg' || CAST(p_partkey % 50 AS STRING) AS package, MIN('1.' || CAST(p_size % 5 + 1 AS STRING) || '.0') AS good_version,
  MAX('1.' || CAST(40 + p_size % 10 AS STRING) || '.0') AS bad_version
FROM {part} GROUP BY 1""",
    "package_tags": """
SELECT 'repo' || CAST(s_suppkey AS STRING) AS package, 'v' || CAST(s_nationkey % 3 AS STRING) || '.' || CAST(s_suppkey % 10 AS STRING) || '.' || CAST(s_suppkey % 4 AS STRING)
  || CASE s_suppkey % 5 WHEN 0 THEN 'a1' WHEN 1 THEN 'b0' WHEN 2 THEN 'rc3' ELSE '' END AS tag
FROM {supplier}""",
    "existing_tags": """
SELECT 'repo' || CAST(s_suppkey AS STRING) AS package,
  'v' || CAST(s_nationkey % 3 AS STRING) || '.' || CAST(s_suppkey % 10 AS STRING) || '.' || CAST(s_suppkey % 4 + 1 AS STRING) AS tag
FROM {supplier}""",
    "stored_documents": """
SELECT 'dev_' || source AS repo,
  CAST(doc_id AS STRING) || CASE WHEN doc_id % 4 = 0 THEN '_Bug_' || lang || '__more' ELSE '_Draft_' || lang END AS filename
FROM {documents}""",
    "downloads": """
SELECT DISTINCT CAST(100 + o_orderkey % 40 AS STRING) AS milestone,
  CASE o_orderpriority WHEN '1-URGENT' THEN 'chrome' WHEN '2-HIGH' THEN 'chromedriver' ELSE 'chrome-headless-shell' END AS product,
  CASE o_orderstatus WHEN 'F' THEN 'linux64' WHEN 'O' THEN 'mac-arm64' ELSE 'win64' END AS platform,
  'https://dl.example.org/' || CAST(100 + o_orderkey % 40 AS STRING) || '/' || o_orderstatus || '/' || o_orderpriority || '.zip' AS url
FROM {orders}""",
}

_PLACEHOLDER = re.compile(r"\{(\w+)\}")


def base_tables(name: str) -> list[str]:
    return sorted(set(_PLACEHOLDER.findall(FIXTURE_SQL[name])))


def read_table(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The fixture ``name`` as a DataFrame over the parquet tables in ``sf_dir``."""
    tables = {t: read_table(spark, sf_dir, t) for t in base_tables(name)}
    return spark.sql(FIXTURE_SQL[name], **tables)


def oracle_sql_of(name: str) -> str:
    """The fixture's SQL over the DuckDB views."""
    return _PLACEHOLDER.sub(lambda m: m.group(1), FIXTURE_SQL[name])


def oracle_with(names: list[str], body: str) -> str:
    """``WITH`` clause binding fixtures by name, followed by ``body``."""
    ctes = ",\n".join(f"{n} AS ({oracle_sql_of(n)}\n)" for n in names)
    return f"WITH {ctes}\n{body}"
