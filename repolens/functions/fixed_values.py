"""Fixed values that results depend on.

FIXED VALUES: these must stay exactly as written for results to match the
behaviour being reproduced. They are small lookup tables and patterns.
"""

from __future__ import annotations

from datetime import datetime

# --- FIXED VALUES: changelog sections, in output order (prefix, title) ---
SECTIONS = [
    ("feat", "Features"),
    ("enh", "Enhancements"),
    ("fix", "Bug Fixes"),
    ("perf", "Performance"),
    ("compat", "Compatibility"),
    ("docs", "Documentation"),
    ("type", "Type Annotations"),
    ("refactor", "Refactoring"),
    ("build", "Build System"),
    ("ci", "CI/CD"),
    ("test", "Tests"),
    ("chore", "Maintenance"),
    ("misc", "Miscellaneous"),
]

# --- FIXED VALUES: automation accounts left out of the contributor list ---
IGNORED_CONTRIBUTORS = ["renovate", "dependabot", "pre-commit-ci"]

# --- FIXED VALUES: interpreter feature releases (version, release date) ---
INTERPRETER_RELEASES = [
    ("3.10", datetime(2021, 10, 4)),
    ("3.11", datetime(2022, 10, 24)),
    ("3.12", datetime(2023, 10, 2)),
    ("3.13", datetime(2024, 10, 7)),
    ("3.14", datetime(2025, 10, 7)),
]

# --- FIXED VALUES: conda package name -> index name; None drops the name ---
PACKAGE_ALIASES = [
    ("conda-build", None),
    ("conda-libmamba-solver", None),
    ("cuda-version", None),
    ("cudf", None),
    ("cuspatial", None),
    ("dask-core", "dask"),
    ("dask-cudf", None),
    ("ffmpeg", None),
    ("geopandas-core", "geopandas"),
    ("geoviews-core", "geoviews"),
    ("graphviz", None),
    ("ibis-sqlite", "ibis-framework"),
    ("librmm", None),
    ("matplotlib-base", "matplotlib"),
    ("nbconvert-core", "nbconvert"),
    ("nodejs", None),
    ("nomkl", None),
    ("python", None),
    ("python-build", "build"),
    ("python-duckdb", "duckdb"),
    ("python-freethreading", None),
    ("python-gil", None),
    ("python-graphviz", None),
    ("python-kaleido", "kaleido"),
    ("rmm", None),
]

# --- FIXED VALUES: support-window length for the "spec 0" column, in days ---
SPEC0_DAYS = 365 * 2

# --- FIXED VALUES: reference names that are never treated as versions ---
SKIP_REFS = ["main", "master", "dev", "develop", "latest", "HEAD"]

# --- FIXED VALUES: temporary-file glob patterns, in the order they are applied ---
TEMP_PATTERNS = [
    ".ipynb_checkpoints",
    "Untitled*.ipynb",
    "tmp*.py",
    "temp*.py",
    "untitled*.txt",
    ".benchmarks",
    ".hypothesis",
    ".*_cache",
    "__pycache__",
    "log*.txt",
    "cache",
]

# --- FIXED VALUES: issue states that count as finished ---
CLOSED_STATES = ["closed", "merged"]

# --- FIXED VALUES: order of pre-release letters when proposing versions ---
PRE_LETTERS = ["a", "b", "rc"]

# --- FIXED VALUES: workflow-text patterns ---
USES_PATTERN = r"(uses:\s*)([A-Za-z0-9_.-]+/[A-Za-z0-9_./:-]+)@([^\s#]+)([ \t]*#[^\n]*)?"
SHA_PATTERN = r"(?i)^[0-9a-f]{40}$"

# --- FIXED VALUES: file names of recent working files ---
RECENT_FILE_PATTERN = r"\d{3,5}.+?\.py$"

# --- FIXED VALUES: patterns of change titles, version texts, comment tags and versioned names ---
CHANGE_LINE = r"^- ([a-zA-Z]+)(?:\([^)]*\))?(!?):\s*(.+)$"
ARCHIVE_VERSION = r"^\w+.\d+.\d+.\d+"
PRE_RELEASE_IN_TEXT = r"(\d)\-?(rc|a|b)\.?(\d)"
COMMENT_TAG = r"#\s*(\S+)"
REF_FORM = r"^([^0-9]*)(\d+(?:\.\d+)*)$"
