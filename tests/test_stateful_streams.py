import random
import time

import pytest
from pyspark.sql import functions as F

from siltstone.streaming import stateful, streams
from siltstone.streaming.page_batches import PageBatches


TASKS = "task_id string, status string, progress double, ts long"


def in_files(spark, path, rows, schema, files):
    """Rows in several files, whose times say their order."""
    for n in range(files):
        spark.createDataFrame(rows[n::files] if files > 1 else rows, schema).coalesce(1).write.mode("append").parquet(path)
        time.sleep(0.05)


def run(stream, mark, mode, sink):
    seen = []
    query = stream.writeStream.outputMode(mode).foreachBatch(lambda d, n: seen.extend(d.collect())).option("checkpointLocation", mark).trigger(availableNow=True).start()
    assert query.awaitTermination(60)
    sink.extend(seen)


def test_task_states_in_any_order(spark, tmp_path):
    rng = random.Random(8)
    rows = []
    for t in range(6):
        rows += [(f"t{t}", s, p, ts) for s, p, ts in (("queued", 0.0, 1), ("processing", 0.3, 2), ("processing", 0.7, 3))][: rng.randint(1, 3)]
    rows += [("t0", "failed", None, 9), ("t0", "completed", 1.0, 8), ("t0", "processing", 0.9, 20), ("t1", "completed", 1.0, 5)]
    rows += rows[:5]
    want = {}
    for t in {r[0] for r in rows}:
        own = [r for r in rows if r[0] == t]
        ends = [r for r in own if r[1] in stateful.TERMINAL]
        want[t] = min(ends, key=lambda r: r[3]) if ends else max(own, key=lambda r: r[3])
    rng.shuffle(rows)
    path = f"file://{tmp_path}/in"
    in_files(spark, path, rows, TASKS, 3)
    found = []
    run(stateful.task_states(streams.folder(spark, path, TASKS, 1)), f"file://{tmp_path}/mark", "update", found)
    last = {}
    for r in found:
        last[r.task_id] = tuple(r)
    assert last == want
    assert {r.task_id: tuple(r) for r in stateful.task_states(spark.createDataFrame(rows, TASKS)).collect()} == want


def sessions_by_hand(events, ttl):
    out = []
    for s in {e[0] for e in events}:
        held = None
        for at, _, kind in sorted({(e[2], e[1], e[3]) for e in events if e[0] == s}):
            if held and at >= held[1] + ttl:
                out.append((s, *held, "expired"))
                held = None
            if kind == "deleted":
                if held:
                    out.append((s, held[0], at, held[2] + 1, "deleted"))
                held = None
            else:
                held = (held[0], at, held[2] + 1) if held else (at, at, 1)
        if held:
            out.append((s, *held, "expired"))
    return sorted(out)


def test_sessions_expire_by_event_time(spark, tmp_path):
    rng = random.Random(4)
    minute, ttl = 60_000, 30 * 60_000
    events = [(f"s{rng.randint(0, 3)}", f"e{n}", rng.randint(0, 600) * minute, rng.choice(["read", "read", "read", "deleted"])) for n in range(80)]
    events.sort(key=lambda e: e[2] + rng.randint(-20, 20) * minute)  # late by less than the watermark allows
    events += events[-3:]  # repeated
    schema = "session_id string, event_id string, ms long, kind string"
    path = f"file://{tmp_path}/in"
    size = -(-len(events) // 4)
    for n in range(4):
        in_files(spark, path, events[n * size : (n + 1) * size], schema, 1)
    # a last event far ahead lets all sessions expire
    in_files(spark, path, [("end", "end", 10_000 * minute, "read")], schema, 1)
    stream = streams.folder(spark, path, schema, 1).select("session_id", "event_id", F.timestamp_millis("ms").alias("at"), "kind")
    found = []
    run(stateful.sessions(stream, "30 minutes", "60 minutes"), f"file://{tmp_path}/mark", "append", found)
    plain = lambda rows: sorted((r.session_id, int(r.started.timestamp() * 1000), int(r.last_access.timestamp() * 1000), r.n_events, r.ended) for r in rows if r.session_id != "end")
    assert plain(found) == sessions_by_hand(events, ttl)
    table = spark.createDataFrame(events, schema).select("session_id", "event_id", F.timestamp_millis("ms").alias("at"), "kind")
    assert plain(stateful.sessions(table).collect()) == sessions_by_hand(events, ttl)


def test_a_run_killed_between_rows_and_progress(spark, tmp_path):
    rows = [(f"d{d}", n, f"page {n} of {d}" if n % 4 else " ") for d in range(3) for n in range(1, 11)]
    source = f"file://{tmp_path}/in"
    for n in range(5):
        in_files(spark, source, rows[n * 6 : (n + 1) * 6], "path string, page_number int, content string", 1)
    pages = lambda: streams.folder(spark, source, "path string, page_number int, content string", 1)
    work = PageBatches(spark, f"file://{tmp_path}/out")
    upper = lambda d: d.withColumn("content", F.upper("content"))

    def die(at):
        def written(number):
            if number == at:
                raise RuntimeError("killed")

        return written

    totals = spark.createDataFrame([(f"d{d}", 10) for d in range(4)], "path string, total_pages int")
    for at in (0, 2, 4):  # killed after the rows of a batch were written, three times
        with pytest.raises(Exception, match="killed"):
            work.run(pages(), upper, die(at)).awaitTermination()
        assert work.committed() == list(range(at)) and work.pages().count() == 6 * at
    some = {r.path: (r.processed_pages, r.last_page, r.progress) for r in work.progress(totals).collect()}
    assert some["d0"] == (10, 10, "10/10") and some["d3"] == (0, 0, "0/10") and some["d2"][1] < 10
    work.run(pages(), upper).awaitTermination()
    work.run(pages(), upper).awaitTermination()
    got = {r.path: r.content for r in work.documents().collect()}
    assert got == {f"d{d}": "\n\n".join(f"PAGE {n} OF {d}" for n in range(1, 11) if n % 4) for d in range(3)}
    assert work.pages().count() == 30
