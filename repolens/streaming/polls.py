"""Runs over repeated polls, with state: one row per run, finished runs leave the table.

``active_runs_stream`` lists a run once per poll that saw it unfinished. Here
every run keeps its newest known state across micro-batches, and only what
changes it is written: an append-only log of changes, a row per status that a
run reached. ``current_runs`` reduces the log to the runs that are still open.

The newest state is the greatest ``(attempt, updated_at, finished, status)``,
a total order, so neither the order in which pages arrive nor a page that is
read again changes the outcome: a late page with an older state says nothing.
State is keyed by repository and block of ``BLOCK`` run numbers, so a busy
repository is spread over all tasks, no state holds more runs than its block has
numbers, and the Python step is called once per block, not once per run. The
checkpoint of the stream holds files read, state and log together; a restart
or a lost executor goes on where the last committed batch ended.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from repolens.operators.runs import active_runs
from repolens.sources.readers import RUNS_SCHEMA, utc_ntz

RUN = ["repo", "run_number"]
ORDER = ["attempt", "updated_at", "finished", "status"]
CHANGE = ("repo string, run_number bigint, attempt bigint, updated_at bigint, finished boolean, status string, "
          "conclusion string, name string, head_branch string, display_title string, run_started_at bigint, actor string")
EPOCH = "timestamp_ntz '1970-01-01'"
#: Run numbers whose runs share a state.
BLOCK = 512
#: A JSON list with a list per run: number, the values of ``ORDER``, and the time when a finished run leaves.
STATE = "runs string"
FIELDS = [f.split()[0] for f in CHANGE.split(", ")]


def polled_runs(pages: DataFrame, *others: str) -> DataFrame:
    """The runs of landed pages in the columns of the log, and ``others`` of the page; times are microseconds since 1970 (UTC).

    A missing attempt is the first. A missing time of change is the start, or the
    oldest where that is missing too. A missing status is unfinished and empty.
    """
    r = pages.select(*others, F.explode("workflow_runs").alias("r"))
    micros = lambda name: F.timestamp_diff("MICROSECOND", F.expr(EPOCH), utc_ntz(name))
    started = micros("r.run_started_at")
    status = F.coalesce("r.status", F.lit(""))
    return r.select(
        F.col("r.repository.name").alias("repo"), F.col("r.run_number").alias("run_number"),
        F.coalesce("r.run_attempt", F.lit(1)).cast("bigint").alias("attempt"),
        F.coalesce(micros("r.updated_at"), started, F.lit(0)).cast("bigint").alias("updated_at"),
        (status == "completed").alias("finished"), status.alias("status"), F.col("r.conclusion").alias("conclusion"),
        F.col("r.name").alias("name"), F.col("r.head_branch").alias("head_branch"),
        F.col("r.display_title").alias("display_title"), started.alias("run_started_at"),
        F.col("r.triggering_actor.login").alias("actor"), *others)


def newest_rows(frames: Iterator[pd.DataFrame]) -> dict:
    """By run number: the newest state in ``frames``, its row of ``FIELDS``, and the time of the run's last page."""
    best = {}
    for frame in frames:
        for *row, landed in zip(*(frame[c].tolist() for c in (*FIELDS, "landed"))):
            row = [None if v != v else v for v in row]  # pandas turns missing numbers into NaN
            number = row[1] = None if row[1] is None else int(row[1])
            rank = (int(row[2]), int(row[3]), bool(row[4]), row[5])
            known = best.get(number)
            if known is None:
                best[number] = rank, row, int(landed)
            else:
                newer = (rank, row) if rank > known[0] else known[:2]
                best[number] = *newer, max(known[2], int(landed))
    return best


def _changes(rows: list) -> pd.DataFrame:
    out = pd.DataFrame(rows, columns=FIELDS)
    for name in ("run_number", "run_started_at"):
        out[name] = out[name].astype("Int64")
    return out


def newest_of(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """The change that a batch makes to one run, if any; a finished run is forgotten once the watermark passes its last page."""
    if state.hasTimedOut:
        state.remove()
        return
    known = tuple(state.get) if state.exists else None
    for rank, row, landed in newest_rows(frames).values():
        changed = known is None or rank > known
        if changed:
            known = rank
            state.update(known)
        if known[2]:
            state.setTimeoutTimestamp(max(landed, state.getCurrentWatermarkMs()) + 1)
        if changed:
            yield _changes([row])


def newest_in_block(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """``newest_of`` for all runs of a block; each finished run is forgotten at its own time."""
    known = {number: (tuple(rank), leaves) for number, *rank, leaves in json.loads(state.get[0])} if state.exists else {}
    now = state.getCurrentWatermarkMs()
    batch = {} if state.hasTimedOut else newest_rows(frames)
    out = []
    for number, (rank, row, landed) in batch.items():
        if number not in known or rank > known[number][0]:
            out.append(row)
        else:
            rank = known[number][0]
        known[number] = rank, max(landed, now) + 1 if rank[2] else None
    known = {n: (rank, leaves) for n, (rank, leaves) in known.items() if n in batch or leaves is None or leaves > now}
    if not known:
        state.remove()
        return
    state.update((json.dumps([[n, *rank, leaves] for n, (rank, leaves) in known.items()]),))
    times = [leaves for _, leaves in known.values() if leaves is not None]
    if times:
        state.setTimeoutTimestamp(min(times))
    if out:
        yield _changes(out)


def run_changes_stream(spark: SparkSession, landing: str, max_files: int = 100, multi_line: bool = True,
                       keep: str = "30 days") -> DataFrame:
    """Streaming DataFrame of changes: the newest state of every run that a batch brings forward.

    A page that does not parse ends the stream. State per run is four values, its
    number and the time when it leaves.
    The file time of the pages is event time with a watermark of ``keep``: a
    finished run leaves the state once pages ``keep`` newer than its last one
    have landed, so state grows with the runs of that span, and a file that is
    older than the newest by more than ``keep`` when it is found is left out
    (files are read oldest first). Runs without a number count as one run of
    their repository.
    """
    pages = (spark.readStream.schema(RUNS_SCHEMA).option("multiLine", multi_line).option("mode", "FAILFAST")
             .option("maxFilesPerTrigger", max_files).option("recursiveFileLookup", True).json(landing))
    timed = pages.select("workflow_runs", F.col("_metadata.file_modification_time").alias("time")).withWatermark("time", keep)
    runs = polled_runs(timed, "time").withColumn("landed", F.unix_millis("time")).withColumn("block", F.expr(f"run_number div {BLOCK}"))
    return runs.groupBy("repo", "block").applyInPandasWithState(
        newest_in_block, CHANGE, STATE, "append", GroupStateTimeout.EventTimeTimeout)


def start_run_changes(spark: SparkSession, landing: str, log: str, checkpoint: str, available_now: bool = True,
                      **options) -> StreamingQuery:
    """Write the changes to the Parquet log; ``available_now`` reads what has landed and stops."""
    writer = (run_changes_stream(spark, landing, **options).writeStream.format("parquet")
              .option("path", log).option("checkpointLocation", checkpoint).outputMode("append"))
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="1 minute")
    return writer.start()


def read_changes(spark: SparkSession, log: str) -> DataFrame:
    """The rows of the log that committed batches wrote."""
    return spark.read.schema(CHANGE).parquet(log)


def current_runs(log: DataFrame) -> DataFrame:
    """The newest state of each run in the log, finished ones included, in the columns that ``operators.runs`` reads."""
    newest = log.groupBy(*RUN).agg(F.max_by(
        F.struct(*[c for c in FIELDS if c not in RUN]), F.struct(*ORDER)).alias("n")).select(*RUN, "n.*")
    times = [F.expr(f"timestampadd(MICROSECOND, {c}, {EPOCH})").alias(c) for c in ("updated_at", "run_started_at")]
    return newest.select(*[c for c in FIELDS if c not in ("updated_at", "run_started_at")], *times)


def open_runs(log: DataFrame, as_of) -> DataFrame:
    """Q10 over the log: runs whose newest state is unfinished, with elapsed minutes at ``as_of``."""
    return active_runs(current_runs(log), as_of)
