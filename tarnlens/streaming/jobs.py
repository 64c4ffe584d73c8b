"""Job states from a log of updates: one fold for batches, and the same as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tarnlens.operators import state

KEPT = ["phase", "message", "percent", "files_analyzed", "files_total", "findings_total"]
OVERWRITTEN = ["status", "analysis_id", "error"]
SCHEMA = "job_id string, owner_user_id bigint, seq bigint, status string, phase string, message string, percent int, files_analyzed int, files_total int, findings_total int, analysis_id string, error string"


def fold_jobs(events: DataFrame) -> DataFrame:
    """The latest state of each job: a null leaves phase, message and progress, but resets analysis_id and error."""
    return state.fold(events, ["job_id", "owner_user_id"], ["seq"], KEPT, OVERWRITTEN)


def owned(jobs: DataFrame, job_id: str, user_id: int) -> DataFrame:
    return jobs.filter((F.col("job_id") == job_id) & (F.col("owner_user_id") == user_id))


def stream_jobs(events: DataFrame, name: str, checkpoint: str) -> StreamingQuery:
    """The same fold over a stream of updates, as a running aggregate: state is one row for each job."""
    return fold_jobs(events).writeStream.outputMode("complete").format("memory").queryName(name).option("checkpointLocation", checkpoint).start()
