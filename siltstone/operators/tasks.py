"""Bookkeeping of ingestion tasks, their files, and lessons: filters, paging, updates, cascades."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def listed(
    df: DataFrame, limit: int = 100, offset: int = 0, order: str = "created_at", key: str = "task_id", **equal
) -> DataFrame:
    """Newest first, with optional equality filters; ``None`` filters nothing."""
    for name, value in equal.items():
        if value is not None:
            df = df.where(F.col(name) == value)
    return df.orderBy(F.desc(order), key).offset(offset).limit(limit)


def with_files(tasks: DataFrame, files: DataFrame, key: str = "task_id", order: str = "id") -> DataFrame:
    """Each task with its files in order; a task without files has an empty list."""
    lists = files.groupBy(key).agg(F.sort_array(F.collect_list(F.struct(order, *[c for c in files.columns if c not in (key, order)]))).alias("files"))
    return tasks.join(lists, key, "left").withColumn("n_files", F.coalesce(F.size("files"), F.lit(0)))


def status_counts(tasks: DataFrame, now: Column, created: str = "created_at") -> DataFrame:
    """Tasks by status, with how many are less than a day old."""
    recent = F.col(created) >= now - F.expr("INTERVAL 24 HOURS")
    return tasks.groupBy("status").agg(F.count(F.lit(1)).alias("n_tasks"), F.count_if(recent).alias("last_24h"))


def upserted(df: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """Partial update by key: a null in ``changes`` keeps the old value, a new key adds a row."""
    columns = [c for c in df.columns if c != key]
    new = changes.select(key, *[F.col(c).alias(f"new_{c}") for c in columns if c in changes.columns])
    both = df.join(new, key, "full")
    return both.select(key, *[F.coalesce(f"new_{c}", c).alias(c) if c in changes.columns else F.col(c) for c in columns])


def without(df: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    return df.join(gone.select(key).distinct(), key, "left_anti")


def cascade_delete(tasks: DataFrame, files: DataFrame, gone: DataFrame, key: str = "task_id") -> tuple[DataFrame, DataFrame]:
    """Tasks and files without those of ``gone``."""
    return without(tasks, gone, key), without(files, gone, key)


def stale(tasks: DataFrame, now: Column, days: int, updated: str = "updated_at") -> DataFrame:
    """Finished tasks older than ``days``."""
    return tasks.where(F.col("status").isin("completed", "failed") & (F.col(updated) < now - F.make_interval(days=F.lit(days))))


def toggled(df: DataFrame, key: str, value, flag: str = "is_favorite") -> DataFrame:
    return df.withColumn(flag, F.when(F.col(key) == value, ~F.col(flag)).otherwise(F.col(flag)))


def latest_status(events: DataFrame, key: str = "task_id", at: str = "ts") -> DataFrame:
    """The state machine's present state: the status of each task's last event."""
    return events.groupBy(key).agg(F.max_by("status", at).alias("status"), F.max(at).alias("updated_at"))


def checkpoint_expired(updated: Column, now: Column, days: int) -> Column:
    """Older than the retention; a time that does not parse never expires."""
    return F.coalesce(F.try_to_timestamp(updated) < now - F.make_interval(days=F.lit(days)), F.lit(False))


def new_files(files: DataFrame, seen: DataFrame) -> DataFrame:
    """Files whose path was not yet processed with the same fingerprint."""
    return files.join(seen.select("path", "fingerprint"), ["path", "fingerprint"], "left_anti")


def fingerprint(content: Column) -> Column:
    return F.sha2(content.cast("binary"), 256)
