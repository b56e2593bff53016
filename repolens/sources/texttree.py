"""Texts as files at their own paths, all at once at the end of the job (K3).

Tasks write into a folder of their own attempt below ``_staging-<job>``; what
the successful attempts staged is a checkpointed table of names. Once every
text is staged and no two have the same path, tasks move the files to their
paths. A job that fails before that leaves nothing behind, a task that runs
twice leaves one file, and a job that runs again writes the same files. Neither
names nor texts pass through the driver.
"""

from __future__ import annotations

import posixpath
import time
import uuid
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from repolens.plans.session import ensure_checkpoint_dir
from repolens.sources.files import filesystem

STAGED = pa.schema([("staged", pa.string()), ("name", pa.string())])


def write_texts(texts: DataFrame, path: str) -> None:
    """Write rows ``name`` (relative path) and ``content`` as files below ``path``; two texts with one path end the job."""
    ensure_checkpoint_dir(texts.sparkSession)
    root = path.rstrip("/")
    staging = f"{root}/_staging-{uuid.uuid4().hex}"
    # tasks add folders to this one but never make it: a task that outlives its job finds no place to write
    fs, base = filesystem(staging)
    fs.create_dir(base, recursive=True)

    def stage(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        fs, base = filesystem(f"{staging}/{context.partitionId()}-{context.taskAttemptId()}")
        count = 0
        for batch in batches:
            staged, names = [], []
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                parts = (name or "").strip("/").split("/")
                if not parts[0] or ".." in parts or parts[0].startswith("_staging-"):
                    raise ValueError(f"not a path inside the target folder: {name}")
                if not count:
                    fs.create_dir(base, recursive=False)
                staged.append(f"{base}/{count}")
                with fs.open_output_stream(staged[-1], compression=None) as out:
                    out.write((content or "").encode())
                names.append("/".join(p for p in parts if p not in ("", ".")))
                count += 1
            yield pa.RecordBatch.from_arrays([pa.array(staged, pa.string()), pa.array(names, pa.string())], schema=STAGED)

    def publish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = filesystem(root)

        def move(staged: str, to: str) -> None:
            try:
                fs.move(staged, to)
            except OSError:  # another attempt of this task may have moved it
                if not _exists(fs, to) or _exists(fs, staged):
                    raise

        with ThreadPoolExecutor(8) as pool:
            for batch in batches:
                moves = [(staged, f"{base}/{name}") for staged, name in zip(*(c.to_pylist() for c in batch.columns))]
                for folder in {posixpath.dirname(to) for _, to in moves}:
                    fs.create_dir(folder, recursive=True)
                list(pool.map(lambda m: move(*m), moves))
                yield batch.slice(0, 0)

    try:
        rows = texts.select("name", "content").mapInArrow(stage, "staged string, name string").checkpoint(eager=True)
        if rows.groupBy("name").agg(F.count("*").alias("n")).filter("n > 1").head(1):
            raise ValueError("several texts have the same path")
        rows.mapInArrow(publish, "staged string, name string").write.format("noop").mode("overwrite").save()
    finally:
        _remove(staging)


def _exists(fs, path: str) -> bool:
    import pyarrow.fs as pafs

    return fs.get_file_info(path).type != pafs.FileType.NotFound


def _remove(folder: str) -> None:
    fs, base = filesystem(folder)
    for last in (False, False, True):  # a task that is being stopped may add a file meanwhile
        try:
            if _exists(fs, base):
                fs.delete_dir(base)
            return
        except OSError:
            if last:
                raise
            time.sleep(0.2)
