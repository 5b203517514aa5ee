"""Task states and sessions with a time to live, as state that a stream's aggregates keep.

Both give the same rows however events are ordered, repeated or cut into batches, as long as they are not later than the
watermark allows, and the same on tables as on streams.  A session's state is its events until the watermark closes it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TERMINAL = ("completed", "failed")


def task_states(events: DataFrame, key: str = "task_id", at: str = "ts") -> DataFrame:
    """State of each task (status, progress, time of its event): queued or processing, then completed or failed.

    The first end counts and nothing after it, else the last event; of events at one time the greater status and progress.
    ``at`` is numeric.
    """
    end = F.col("status").isin(*TERMINAL)
    weight = F.struct(end.alias("end"), F.when(end, -F.col(at)).otherwise(F.col(at)).alias("when"), "status", "progress", at)
    best = events.groupBy(key).agg(F.max(weight).alias("s"))
    return best.select(key, "s.status", "s.progress", f"s.{at}")


def _lives(events: Column) -> Column:
    """Events in order, cut behind each deletion; a deletion of nothing is left out."""
    last = F.size(events) - 1
    ends = F.filter(F.sequence(F.lit(0), last), lambda i: (F.get(events, i)["kind"] == "deleted") | (i == last))
    cut = lambda at: F.transform(at, lambda e, k: F.slice(events, F.coalesce(F.get(at, k - 1), F.lit(-1)) + 2, e - F.coalesce(F.get(at, k - 1), F.lit(-1))))
    pieces = F.transform(F.array(ends), cut)[0]
    return F.filter(pieces, lambda p: (F.size(p) > 1) | (F.get(p, F.lit(0))["kind"] != "deleted"))


def sessions(events: DataFrame, ttl: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """Closed sessions of events (session_id, event_id, at timestamp, kind): (session_id, started, last_access, n_events, ended).

    A session ends ``ttl`` after its last access (``expired``) or when it is deleted; a repeated event is one.  A stream gives a session
    once the watermark says that nothing can join it any more, a table gives all.
    """
    timed = events.withWatermark("at", late) if events.isStreaming else events
    row = F.struct("at", F.col("event_id").cast("string").alias("event_id"), F.coalesce("kind", F.lit("")).alias("kind"))
    each = timed.groupBy("session_id", F.session_window("at", ttl)).agg(F.array_sort(F.collect_set(row)).alias("events"))
    lives = each.select("session_id", F.explode(_lives(F.col("events"))).alias("e"))
    last = F.element_at("e", -1)
    return lives.select(
        "session_id", F.get("e", F.lit(0))["at"].alias("started"), last["at"].alias("last_access"), F.size("e").cast("long").alias("n_events"),
        F.when(last["kind"] == "deleted", "deleted").otherwise("expired").alias("ended"),
    )
