import pytest
from pyspark.sql import functions as F

from siltstone.engine import Engine, validated
from siltstone.operators import metrics
from siltstone.sources.checkpoints import CheckpointLog
from siltstone.streaming import streams


def test_ingest_search_and_context(spark, tmp_path):
    engine = Engine(spark, f"file://{tmp_path}/store")
    engine.create("c")
    rows = [("Grade3_Math.md", "Fractions are parts of a whole.", {"source": "m.md"}), ("b.md", "The history of rivers and boats.", {"source": "b.md"})]
    engine.ingest("c", spark.createDataFrame(rows, "path string, content string, metadata map<string,string>"))
    hits = engine.search("c", "parts of a whole fractions", 2).collect()
    assert hits[0].id == "Grade3_Math.md_chunk_0" and hits[0].metadata["edu_grade"] == "3" and hits[0].metadata["edu_subject"] == "Mathematics"
    assert hits[0].score >= hits[1].score >= 0
    assert [h.id for h in engine.search("c", "rivers", 5, {"edu_subject": {"$eq": "Social Studies"}}).collect()] == ["b.md_chunk_0"]
    text = engine.chat_context("c", "history of rivers").first().context
    assert text.startswith("**Text Sources:**\n\n[1] **Source**: b.md | **Relevance**: ") and "[2] **Source**: m.md" in text
    with pytest.raises(ValueError):
        engine.search("c", "x", 101)
    with pytest.raises(ValueError):
        validated({"citation_style": "odd"})


def test_checkpoints(spark, tmp_path):
    log = CheckpointLog(spark, f"file://{tmp_path}/log")
    schema = "collection string, file_hash string, total_pages int, processed_pages int, last_page_completed int, updated_at string"
    assert log.list().count() == 0
    log.save(spark.createDataFrame([("a", "h", 9, 1, 0, "2024-01-01"), ("a", "g", 2, 2, 1, "junk")], schema))
    log.save(spark.createDataFrame([("a", "h", 9, 4, 3, "2024-01-02")], schema))
    r = log.resume().collect()
    assert [(x.file_hash, x.next_page, x.progress) for x in r] == [("h", 4, "4/9")] and log.load("a", "g").count() == 1
    now = F.lit("2024-03-01").cast("timestamp")
    assert log.cleanup(now, 30) == 1 and log.cleanup(now, 30) == 0 and [x.file_hash for x in log.list().collect()] == ["g"]


def test_adaptive_sizes(spark):
    rates = [1.0, 1, 1, 1, 1, 1, 1, 2, 2, 2, 2, 2, 1, 1, 1]
    size, want = 32, []
    for n in range(1, len(rates) + 1):
        if n % 5 == 0 and n >= 6:
            now, before = sum(rates[n - 3 : n]) / 3, sum(rates[n - 6 : n - 3]) / 3
            size = min(int(size * 1.25), 1024) if now / before > 1.1 else max(int(size * 0.75), 1) if now / before < 0.9 else size
        want.append(size)
    got = spark.range(1).select(metrics.adaptive_sizes(F.array(*map(F.lit, rates))).alias("s")).first().s
    assert got == want and want[9] == 40 and want[-1] == 30


def test_stream_states_and_pairs(spark, tmp_path):
    rows = [("t1", "queued", 0.0, 1), ("t1", "processing", 0.5, 3), ("t2", "queued", 0.0, 2), ("t1", "completed", 1.0, 9)]
    df = spark.createDataFrame(rows, "task_id string, status string, progress double, ts long")
    df.repartition(2).write.parquet(f"file://{tmp_path}/e")
    stream = streams.task_states(streams.folder(spark, f"file://{tmp_path}/e", df._jdf.schema().toDDL(), 1))
    query = stream.writeStream.outputMode("complete").format("memory").queryName("states").trigger(availableNow=True).start()
    query.awaitTermination()
    assert sorted(map(tuple, spark.table("states").collect())) == [("t1", "completed", 1.0, 9), ("t2", "queued", 0.0, 2)]
    starts = spark.createDataFrame([("a", "2024-01-01 00:00:00"), ("b", "2024-01-01 00:00:00")], "task_id string, s string").select("task_id", F.col("s").cast("timestamp").alias("started_at"))
    ends = spark.createDataFrame([("a", "2024-01-01 01:00:00"), ("z", "2024-01-01 01:00:00")], "task_id string, s string").select("task_id", F.col("s").cast("timestamp").alias("ended_at"))
    assert [r.task_id for r in streams.paired_tasks(starts, ends).collect()] == ["a"]
