"""Members of archives as a Spark data source (S5): no archive is ever a row.

The partitions of the source are lists of archive paths, balanced by bytes.
Inside a task a zip is read by seeks (its central directory), a tar is
streamed, and archives inside an outer zip are opened in turn without being
unpacked. Rows leave in Arrow batches, so what a task holds is one batch and
one archive's directory. An archive that cannot be read gives a row that says
why; its neighbours are read all the same.
"""

from __future__ import annotations

import fnmatch
import heapq
import os
import tarfile
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from repolens.sources.files import filesystem

MEMBERS_SCHEMA = "path string, archive string, format string, member string, status string"
ARROW = pa.schema([(c, pa.string()) for c in ("path", "archive", "format", "member", "status")])
BATCH = 8192
#: File name endings and formats, the longest ending first.
ENDINGS = {".tar.bz2": "conda1", ".tar.gz": "sdist", ".conda": "conda", ".whl": "wheel", ".tgz": "npm", ".zip": "zip"}


def archive_format(name: str) -> str | None:
    return next((fmt for ending, fmt in ENDINGS.items() if name.endswith(ending)), None)


def members(path: str, name: str, file) -> Iterator[tuple[str, str, str, str | None, str]]:
    """``path, archive, format, member, status`` of a readable file object.

    Zips list folders too, tars only files. The members of an archive inside a
    zip have the path ``<outer>!/<inner>``; an archive inside that cannot be
    read gives its own status row.
    """
    fmt = archive_format(name)
    try:
        if fmt in ("wheel", "zip", "conda"):
            with zipfile.ZipFile(file) as z:
                for inner in z.namelist():
                    if fmt == "conda" and inner.endswith(".tar.zst"):
                        yield from _tar(path, name, fmt, _unzstd(z.open(inner)))
                        continue
                    yield path, name, fmt, inner, "ok"
                    if fmt == "zip" and archive_format(inner):
                        with z.open(inner) as nested:
                            yield from members(f"{path}!/{inner}", os.path.basename(inner), nested)
        else:
            yield from _tar(path, name, fmt, file)
    except (zipfile.BadZipFile, tarfile.TarError, OSError, EOFError, ValueError, NotImplementedError, RuntimeError) as e:
        yield path, name, fmt, None, f"{type(e).__name__}: {e}"
    except Exception as e:  # zlib, lzma and zstandard raise errors of their own
        if type(e).__module__ not in ("zlib", "_lzma", "lzma", "zstandard", "zstd", "zstandard.backend_c"):
            raise
        yield path, name, fmt, None, f"{type(e).__name__}: {e}"


def _tar(path: str, name: str, fmt: str, file) -> Iterator[tuple[str, str, str, str, str]]:
    mode = "r|" if fmt == "conda" else "r|*"
    with tarfile.open(fileobj=file, mode=mode) as tar:
        for m in tar:
            if m.isfile():
                yield path, name, fmt, m.name, "ok"


def _unzstd(file):
    import zstandard

    return zstandard.ZstdDecompressor().stream_reader(file)


class Paths(InputPartition):
    def __init__(self, paths: list[str]):
        self.paths = paths


class ArchiveMembers(DataSource):
    """``format("archive_members")`` with options ``path``, ``glob`` (on file names) and ``partitionBytes``."""

    @classmethod
    def name(cls) -> str:
        return "archive_members"

    def schema(self) -> str:
        return MEMBERS_SCHEMA

    def reader(self, schema) -> "ArchiveReader":
        return ArchiveReader(self.options)


class ArchiveReader(DataSourceReader):
    def __init__(self, options):
        self.root, self.glob = options["path"], options.get("glob", "*")
        self.bytes = int(options.get("partitionBytes", 128 << 20))

    def partitions(self) -> list[Paths]:
        import pyarrow.fs as pafs

        fs, base = filesystem(self.root)
        prefix = self.root[: len(self.root) - len(base)] if "://" in self.root else ""
        found = [(f.size or 0, prefix + f.path) for f in fs.get_file_info(pafs.FileSelector(base, recursive=True))
                 if f.type == pafs.FileType.File and archive_format(f.base_name) and fnmatch.fnmatch(f.base_name, self.glob)]
        return [Paths(p) for p in balanced(found, self.bytes)]

    def read(self, partition: Paths) -> Iterator[pa.RecordBatch]:
        rows = []
        for path in partition.paths:
            fs, base = filesystem(path)
            try:
                with fs.open_input_file(base) as f:
                    for row in members(path, os.path.basename(path), f):
                        rows.append(row)
                        if len(rows) == BATCH:
                            yield _batch(rows)
                            rows = []
            except OSError as e:
                name = os.path.basename(path)
                rows.append((path, name, archive_format(name), None, f"{type(e).__name__}: {e}"))
        if rows:
            yield _batch(rows)


def balanced(files: list[tuple[int, str]], size: int) -> list[list[str]]:
    """Paths in lists of about ``size`` bytes: the largest first, each to the lightest list."""
    n = max(1, min(len(files), -(-sum(s for s, _ in files) // max(size, 1))))
    heap = [(0, i) for i in range(n)]
    out: list[list[str]] = [[] for _ in range(n)]
    for s, path in sorted(files, reverse=True):
        load, i = heapq.heappop(heap)
        out[i].append(path)
        heapq.heappush(heap, (load + s, i))
    return out


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*rows)], schema=ARROW)
