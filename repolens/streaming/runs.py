"""Active runs over a landing folder of run pages, as a Structured Streaming query.

The one-shot poll of unfinished runs becomes a stateless stream: every new
landed page is flattened, filtered to unfinished runs and given its elapsed
minutes at processing time. Each micro-batch is idempotent (a page is read
once, tracked by the checkpoint), so a lost executor only replays its batch.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from repolens.functions import text as X
from repolens.sources.readers import RUNS_SCHEMA, utc_ntz


def active_runs_stream(spark: SparkSession, landing: str, max_files: int = 100) -> DataFrame:
    """Streaming DataFrame of unfinished runs from JSON pages arriving in ``landing``."""
    pages = (spark.readStream.schema(RUNS_SCHEMA).option("multiLine", True)
             .option("maxFilesPerTrigger", max_files).json(landing))
    runs = pages.select(F.explode("workflow_runs").alias("r"))
    active = runs.filter(~F.col("r.status").eqNullSafe("completed"))
    started = utc_ntz("r.run_started_at")
    return active.select(
        F.col("r.repository.name").alias("repo"), F.col("r.run_number").alias("run_number"),
        F.col("r.name").alias("workflow"), F.col("r.head_branch").alias("branch"),
        F.col("r.display_title").alias("title"), F.col("r.status").alias("status"),
        started.alias("started_at"),
        X.elapsed_minutes(started, F.to_utc_timestamp(F.current_timestamp(), F.current_timezone())
                          .cast("timestamp_ntz")).alias("duration"),
        F.col("r.triggering_actor.login").alias("user"))


def start_active_runs(spark: SparkSession, landing: str, sink_path: str, checkpoint: str,
                      available_now: bool = True) -> StreamingQuery:
    """Run the stream into a parquet folder; ``available_now`` processes what is there and stops."""
    writer = (active_runs_stream(spark, landing).writeStream.format("parquet")
              .option("path", sink_path).option("checkpointLocation", checkpoint).outputMode("append"))
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="1 minute")
    return writer.start()
