"""Structured Streaming forms of the item, session and task streams.

Offsets, restarts and exactly-once sinks come from the checkpoint location; the
query counterparts on static tables give the same rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def folder(spark: SparkSession, path: str, schema: str, per_trigger: int | None = None) -> DataFrame:
    """Files of a folder as a stream, a bounded number per trigger if given."""
    reader = spark.readStream.schema(schema)
    return (reader.option("maxFilesPerTrigger", per_trigger) if per_trigger else reader).parquet(path)


def session_windows(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour", user: str = "user_id", at: str = "ts") -> DataFrame:
    """Sessions of each user that end after ``gap`` without an event, with their event counts."""
    timed = events.withColumn(at, F.col(at).cast("timestamp"))
    if timed.isStreaming:
        timed = timed.withWatermark(at, late)
    found = timed.groupBy(user, F.session_window(at, gap).alias("w")).agg(F.count(F.lit(1)).alias("n_events"))
    return found.select(user, F.col("w.start").alias("started"), F.col("w.end").alias("ended"), "n_events")


def paired_tasks(starts: DataFrame, ends: DataFrame, within: str = "2 hours", late: str = "2 hours") -> DataFrame:
    """Starts with their ends (task_id, started_at, ended_at); ends without a start are dropped."""
    if starts.isStreaming:
        starts, ends = starts.withWatermark("started_at", late), ends.withWatermark("ended_at", late)
    ends = ends.withColumnRenamed("task_id", "end_task")
    close = F.expr(f"task_id = end_task AND ended_at >= started_at AND ended_at <= started_at + INTERVAL {within}")
    return starts.join(ends, close, "inner").drop("end_task")


def run_available(stream: DataFrame, path: str, checkpoint: str, transform: Callable[[DataFrame], DataFrame] | None = None) -> StreamingQuery:
    """Process what is there into Parquet and stop; a rerun goes on after it."""
    out = stream.transform(transform) if transform else stream
    return out.writeStream.format("parquet").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(path)


def batches(stream: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Micro-batches to a function of (rows, batch number)."""
    return stream.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def task_states(events: DataFrame, key: str = "task_id", at: str = "ts") -> DataFrame:
    """Present state of each task, kept by the stream (update or complete mode) as by the batch."""
    last = events.groupBy(key).agg(F.max_by(F.struct("status", "progress"), at).alias("s"), F.max(at).alias("updated_at"))
    return last.select(key, "s.status", "s.progress", "updated_at")
