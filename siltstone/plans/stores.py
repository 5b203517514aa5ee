"""Queries on stored collections, with their DuckDB twins; registered with the catalogue's."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.plans.catalogue import query, table
from siltstone.sources.collections import CollectionStore
from siltstone.sources.scratch import fresh_path
from siltstone.streaming import stateful, streams
from siltstone.streaming.page_batches import PageBatches


def _store(spark, sf_dir) -> CollectionStore:
    """The embeddings as a collection, from two appends."""
    e = table(spark, sf_dir, "embeddings")
    store = CollectionStore(spark, fresh_path(spark, "collections"))
    dimension = e.select(F.size("embedding").alias("n")).first().n
    store.create("vectors", dimension, config={"chunk_size": "512"})
    rows = e.select(
        F.col("vec_id").cast("string").alias("id"), "embedding", F.concat(F.lit("text "), F.col("label")).alias("document"),
        F.create_map(F.lit("label"), F.col("label").cast("string")).alias("metadata"), "vec_id",
    )
    store.add("vectors", rows.where("vec_id % 2 = 0"))
    store.add("vectors", rows.where("vec_id % 2 = 1"))
    return store


def _changed(spark, sf_dir) -> CollectionStore:
    store = _store(spark, sf_dir)
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("string").alias("id"), "vec_id", "label", "embedding")
    # new texts keep their vectors; new vectors keep texts; unknown ids change nothing
    texts = e.where("label = 0").select("id", F.lit("changed").alias("document"))
    store.update("vectors", texts.unionByName(spark.range(3).select(F.concat(F.lit("none "), "id").alias("id"), F.lit("x").alias("document"))))
    store.update("vectors", e.where("vec_id % 5 = 0").select("id", F.reverse("embedding").alias("embedding")))
    store.delete("vectors", e.where("label = 4 OR vec_id % 11 = 3").select("id"))
    return store


def _rows(df: DataFrame) -> DataFrame:
    digest = F.md5(F.array_join(F.transform("embedding", lambda x: F.round(x.cast("double") * 1e6).cast("long")).cast("array<string>"), ","))
    return df.select("id", digest.alias("vector"), "document", F.col("metadata")["label"].alias("label"))


def _rows_sql(where: str, changed: bool = True) -> str:
    vector = "CASE WHEN vec_id % 5 = 0 THEN list_reverse(embedding) ELSE embedding END" if changed else "embedding"
    text = "CASE WHEN label = 0 THEN 'changed' ELSE 'text ' || label END" if changed else "'text ' || label"
    return f"""SELECT vec_id::VARCHAR AS id, md5(array_to_string(list_transform({vector}, lambda x: round(x::DOUBLE * 1e6)::BIGINT), ',')) AS vector,
        {text} AS document, label::VARCHAR AS label FROM embeddings WHERE {where}"""


_KEPT = "label <> 4 AND vec_id % 11 <> 3"


@query(_rows_sql(_KEPT))
def collection_changed(spark, sf_dir):
    """Read after appends, two partial updates and a delete: bitmaps are merged on reading."""
    return _rows(_changed(spark, sf_dir).read("vectors"))


@query(_rows_sql(_KEPT))
def collection_compacted(spark, sf_dir):
    store = _changed(spark, sf_dir)
    store.compact("vectors")
    return _rows(store.read("vectors"))


@query(_rows_sql("true", changed=False))
def collection_as_of(spark, sf_dir):
    """The version before all changes, read after a compaction."""
    store = _changed(spark, sf_dir)
    store.compact("vectors")
    return _rows(store.read("vectors", version=2))


@query(f"""SELECT 'vectors' AS collection, 'cosine' AS metric, (SELECT count(*) FROM embeddings WHERE {_KEPT}) AS n, 6::BIGINT AS version,
    (SELECT len(embedding) FROM embeddings LIMIT 1)::INT AS dimension""")
def collection_versions(spark, sf_dir):
    """Collections and their rows, from the logs alone."""
    store = _changed(spark, sf_dir)
    store.configure("vectors", chunk_size=1024)
    return store.list().select("collection", "metric", F.col("rows").alias("n"), "version", "dimension")


@query("""
    WITH e AS (SELECT *, coalesce(ts >= lag(ts) OVER w + INTERVAL 30 MINUTES, true) OR lag(event_type) OVER w = 'error' AS opens FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id::VARCHAR)),
    n AS (SELECT *, sum(opens::INT) OVER (PARTITION BY user_id ORDER BY ts, event_id::VARCHAR ROWS UNBOUNDED PRECEDING) AS k FROM e)
    SELECT user_id AS session_id, epoch_us(min(ts)) AS started, epoch_us(max(ts)) AS last_access, count(*) AS n_events,
        CASE WHEN bool_or(event_type = 'error') THEN 'deleted' ELSE 'expired' END AS ended FROM n GROUP BY user_id, k HAVING count(*) > 1 OR NOT bool_or(event_type = 'error')""")
def session_lives(spark, sf_dir):
    """Users' sessions, which an error deletes."""
    kind = F.when(F.col("event_type") == "error", "deleted").otherwise("read")
    events = table(spark, sf_dir, "events").select(F.col("user_id").alias("session_id"), "event_id", F.col("ts").cast("timestamp").alias("at"), kind.alias("kind"))
    return stateful.sessions(events).withColumn("started", F.unix_micros("started")).withColumn("last_access", F.unix_micros("last_access"))


@query("""
    WITH e AS (SELECT user_id AS task_id, event_id AS ts, CASE event_type WHEN 'purchase' THEN 'completed' WHEN 'error' THEN 'failed' WHEN 'click' THEN 'processing' ELSE 'queued' END AS status, value AS progress FROM events),
    t AS (SELECT *, status IN ('completed', 'failed') AS done FROM e),
    r AS (SELECT *, row_number() OVER (PARTITION BY task_id ORDER BY done DESC, CASE WHEN done THEN -ts ELSE ts END DESC) AS o FROM t)
    SELECT task_id, status, round(progress, 6) AS progress, ts FROM r WHERE o = 1""")
def task_machine(spark, sf_dir):
    status = F.when(F.col("event_type") == "purchase", "completed").when(F.col("event_type") == "error", "failed").when(F.col("event_type") == "click", "processing").otherwise("queued")
    events = table(spark, sf_dir, "events").select(F.col("user_id").alias("task_id"), status.alias("status"), F.col("value").alias("progress"), F.col("event_id").alias("ts"))
    return stateful.task_states(events).withColumn("progress", F.round("progress", 6))


@query("""SELECT doc_id::VARCHAR AS path, md5(array_to_string(list_filter(list_transform(generate_series(0, (length(text) - 1) // 2000), lambda n: substr(text, n * 2000 + 1, 2000)),
    lambda p: regexp_matches(p, '[^ \t\n\x0b\f\r]')), chr(10) || chr(10))) AS content, ((length(text) - 1) // 2000 + 1)::BIGINT AS n_pages FROM documents WHERE length(text) > 0""")
def resumed_pages(spark, sf_dir):
    """Pages of documents in batches of a stream that stops once between a batch's rows and its progress, and is run again."""
    docs = table(spark, sf_dir, "documents").where(F.length("text") > 0)
    starts = F.sequence(F.lit(0), F.floor((F.length("text") - 1) / 2000).cast("int"))
    pages = docs.select(F.col("doc_id").cast("string").alias("path"), "text", F.explode(starts).alias("n"))
    pages = pages.select("path", (F.col("n") + 1).alias("page_number"), F.substring(F.col("text"), F.col("n") * 2000 + 1, F.lit(2000)).alias("content"))
    source = fresh_path(spark, "page_rows")
    # three batches of as many files as keep one at some 16 million characters
    share = math.ceil((docs.agg(F.sum(F.length("text"))).first()[0] or 0) / (3 * 16 << 20)) or 1
    pages.repartition(3 * share, "path").write.parquet(source)
    work = PageBatches(spark, fresh_path(spark, "page_batches"))
    stream = lambda: streams.folder(spark, source, "path string, page_number int, content string", share)

    def stop(number: int) -> None:
        if number == 1:
            raise InterruptedError("stopped")

    try:
        work.run(stream(), lambda d: d, stop).awaitTermination()
    except Exception as e:
        if "stopped" not in str(e):
            raise
    work.run(stream(), lambda d: d).awaitTermination()
    return work.documents().withColumn("content", F.md5("content"))
