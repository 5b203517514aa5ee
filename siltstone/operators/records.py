"""Records around a retrieval engine: task and file rows, sessions, region codecs, materials, run reports.

Stores are DataFrames; each function returns the rows after the operation.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.functions import vectors
from siltstone.operators import search

# ---- tasks and files


def created_tasks(requests: DataFrame, now: Column) -> tuple[DataFrame, DataFrame]:
    """Task and file rows of requests (task_id, collection_name, files array<struct<name, status, size>>).

    A task starts queued with its number of files; a file without a status is pending, one without a size has 0.
    """
    files = F.coalesce("files", F.array().cast(requests.schema["files"].dataType))
    task_rows = requests.select(
        "task_id", "collection_name", F.lit("queued").alias("status"), F.size(files).alias("total_files"), now.alias("created_at")
    )
    each = requests.select("task_id", F.posexplode(files).alias("id", "f"))
    file_rows = each.select(
        "task_id", "id", F.col("f.name").alias("filename"), F.coalesce("f.status", F.lit("pending")).alias("status"), F.coalesce("f.size", F.lit(0)).alias("size")
    )
    return task_rows, file_rows


def last_of_each(rows: DataFrame, keys: Sequence[str], at: str | None = None) -> DataFrame:
    """One row for each key: the one that is last by ``at``, and of those with one time (or without any) the greatest."""
    rest = [c for c in rows.columns if c not in keys and c != at]
    order = F.struct(*([at] if at else []), *rest)
    kept = rows.groupBy(*keys).agg(F.max_by(F.struct(*[c for c in rows.columns if c not in keys]), order).alias("__last"))
    return kept.select(*keys, "__last.*")


def updated_files(files: DataFrame, changes: DataFrame, now: Column, keys: Sequence[str] = ("task_id", "filename"), at: str | None = None) -> DataFrame:
    """Files with the status and error of the last change (by ``at``) of their task and name; others stay as they are."""
    last = last_of_each(changes.select(*keys, "status", "error", *([at] if at else [])), keys, at)
    new = last.select(*keys, F.col("status").alias("__status"), F.col("error").alias("__error"), F.lit(True).alias("__changed"))
    both = files.join(new, list(keys), "left")
    changed = F.coalesce("__changed", F.lit(False))
    return both.select(
        *[c for c in files.columns if c not in ("status", "error", "updated_at")],
        F.when(changed, F.col("__status")).otherwise(F.col("status")).alias("status"),
        F.when(changed, F.col("__error")).otherwise(F.col("error")).alias("error"),
        F.when(changed, now).otherwise(F.col("updated_at")).alias("updated_at"),
    )


def store_statistics(tasks: DataFrame, files: DataFrame, now: Column, updated: str = "updated_at") -> DataFrame:
    """One row per status with its tasks, beside the totals of tasks, files and tasks updated in the last day."""
    total = tasks.agg(F.count(F.lit(1)).alias("total_tasks"), F.count_if(F.col(updated) > now - F.expr("INTERVAL 24 HOURS")).alias("active_last_24h"))
    n_files = files.agg(F.count(F.lit(1)).alias("total_files"))
    # both are one row of counts
    by_status = tasks.groupBy("status").agg(F.count(F.lit(1)).alias("n_tasks"))
    return by_status.join(F.broadcast(total)).join(F.broadcast(n_files))


def restored(tasks: DataFrame, files: DataFrame, done: Sequence[str] = ("completed", "failed"), key: str = "task_id") -> DataFrame:
    """Unfinished tasks with their files in order, as a restart needs them; only their files are gathered."""
    open_ = tasks.where(~F.col("status").isin(*done))
    own = files.join(open_.select(key), key, "left_semi")
    lists = own.groupBy(key).agg(F.sort_array(F.collect_list(F.struct(*[c for c in files.columns if c != key]))).alias("files"))
    return open_.join(lists, key, "left")


def lesson_list(
    lessons: DataFrame, limit: int = 20, offset: int = 0, grade: str | None = None, subject: str | None = None, favorites_only: bool = False
) -> DataFrame:
    """Lessons that are not archived, newest first; an empty filter filters nothing."""
    kept = lessons.where(~F.col("is_archived"))
    for name, value in (("grade", grade), ("subject", subject)):
        kept = kept.where(F.col(name) == value) if value else kept
    kept = kept.where("is_favorite") if favorites_only else kept
    return kept.orderBy(F.desc("created_at"), "lesson_id").offset(offset).limit(limit)


# ---- sessions


def sessions_after(sessions: DataFrame, created: DataFrame, read: DataFrame, deleted: DataFrame, now: Column, at: str | None = None) -> DataFrame:
    """Sessions (session_id, collection_name, created_at, last_accessed) after creations, reads and deletions.

    A created id replaces an old session, and of several creations of one id the last (by ``at``) counts; a read refreshes the
    last access, a deleted one goes.
    """
    created = last_of_each(created.select("session_id", "collection_name", *([at] if at else [])), ["session_id"], at)
    fresh = created.select("session_id", "collection_name", now.alias("created_at"), now.alias("last_accessed"))
    kept = sessions.join(created.select("session_id"), "session_id", "left_anti").unionByName(fresh)
    kept = kept.join(deleted.select("session_id"), "session_id", "left_anti")
    touched = kept.join(read.select("session_id").distinct().withColumn("__read", F.lit(True)), "session_id", "left")
    return touched.withColumn("last_accessed", F.when(F.col("__read"), now).otherwise(F.col("last_accessed"))).drop("__read")


def image_references(results: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """The last metadata of each referenced image; results without id or metadata are no reference."""
    some = results.where(F.col(key).isNotNull() & (F.col(key).cast("string") != "") & F.col(value).isNotNull())
    return some.groupBy(key).agg(F.max_by(value, order).alias(value))


# ---- regions


def region_json(region: Column) -> Column:
    """A region as JSON: fields without a value are left out, 0 and "" stay."""
    return F.to_json(region)


def region_of(text: Column, schema: str) -> Column:
    """The region a JSON text describes; contents stay texts even if they look like paths."""
    return F.from_json(text, schema)


def offline_regions(pages: DataFrame, doc: str = "doc_id", page: str = "page_number", content: str = "content") -> DataFrame:
    """One text region for each page."""
    name = F.concat_ws("_", F.coalesce(F.col(doc).cast("string"), F.lit("doc")), F.col(page).cast("string"), F.lit("0"))
    return pages.select(
        name.alias("region_id"), F.lit("text").alias("region_type"), F.lit(0).alias("region_sequence"), F.col(page).alias("page_number"),
        F.coalesce(F.col(content), F.lit("")).alias("content"), F.lit(None).cast("string").alias("bbox"),
    )


def batch_pages(files: DataFrame, order: str, page: str) -> DataFrame:
    """Files of a batch with their page number; without one it is the place in the batch, from 1."""
    return files.withColumn("page_number", F.coalesce(F.col(page), F.col(order) + 1))


# ---- results


def modality_filter(hits: DataFrame, wanted: str | None, column: str = "modality") -> DataFrame:
    """Hits of one modality; anything but ``image`` and ``text`` filters nothing."""
    return hits.where(F.col(column) == wanted) if wanted in ("image", "text") else hits


def result_view(hits: DataFrame, view: str = "all", column: str = "result_type") -> DataFrame:
    """What a result list shows: all, images, or everything else as text."""
    if view == "all":
        return hits
    return hits.where((F.col(column) == "image") if view == "image" else ~F.col(column).eqNullSafe("image"))


def split_counts(hits: DataFrame, *keys: str, column: str = "result_type") -> DataFrame:
    image = F.col(column).eqNullSafe("image")
    return hits.groupBy(*keys).agg(F.count_if(~image).alias("text_results"), F.count_if(image).alias("image_results"))


def as_material(hits: DataFrame, source_type: str, id_col: str = "id", metadata: str = "metadata") -> DataFrame:
    """Hits as lesson materials with their defaults: an unknown source, empty content."""
    m = F.col(metadata)
    return hits.select(
        F.coalesce("document", F.lit("")).alias("content"), F.coalesce(m["source_file"], F.lit("Unknown Source")).alias("document_name"),
        F.col(id_col).alias("chunk_id"), F.col("score").alias("relevance_score"), F.lit(source_type).alias("source_type"),
        m["page_number"].alias("page_number"), m["slide_number"].alias("slide_number"),
    )


def source_lines(name: Column, page: Column, slide: Column, content: Column, rank: Column, image: Column) -> Column:
    """A numbered source of a prompt; page and slide 0 count as absent, an image shows its whole description."""
    page_word = F.when(image, ", page ").otherwise(", pages ")
    place = F.when(F.coalesce(page, F.lit(0)) != 0, F.concat(page_word, page.cast("string")))
    place = F.coalesce(place, F.when(F.coalesce(slide, F.lit(0)) != 0, F.concat(F.lit(", slide "), slide.cast("string"))), F.lit(""))
    head = F.concat(F.when(image, "[IMG-").otherwise("["), rank.cast("string"), F.lit("] "), name, place)
    body = F.when(image, F.concat(F.lit("    Description: "), content)).otherwise(F.concat(F.lit("    Content: "), F.substring(content, 1, 200), F.lit("...")))
    return F.concat(head, F.lit("\n"), body, F.lit("\n"))


def batch_two_stage(
    docs: DataFrame, queries: DataFrame, first_k: int = 100, k: int = 10, id_col: str = "id", tokens_col: str = "tokens", query_tokens: str = "query_tokens"
) -> DataFrame:
    """(query_id, id, distance, max_sim, rank): the mean-vector top ``first_k`` of every query, reranked by late interaction."""
    pooled = docs.withColumn("mean_vector", vectors.mean_vector(F.col(tokens_col)))
    means = queries.select("query_id", vectors.mean_vector(F.col(query_tokens)).alias("query_vector"))
    first = search.batch_top_k(pooled, means, first_k, id_col=id_col, vector_col="mean_vector").drop("rank")
    both = first.join(docs.select(id_col, tokens_col), id_col).join(queries.select("query_id", query_tokens), "query_id")
    scored = both.withColumn("max_sim", vectors.max_sim(F.col(query_tokens), F.col(tokens_col))).drop(tokens_col, query_tokens)
    return search.numbered(scored, "query_id", F.desc(F.round("max_sim", 12)), "distance", id_col).where(F.col("rank") <= k)


def in_input_order(results: DataFrame, position: str = "pos") -> DataFrame:
    """Results of parallel work in the order of their inputs."""
    return results.orderBy(position)


# ---- reports


def retrieval_metrics(runs: DataFrame, *keys: str) -> DataFrame:
    """Timings of retrievals to two decimals, and their counts."""
    times = ("vector_search_time_ms", "reranking_time_ms", "total_time_ms")
    return runs.select(*keys, *[F.round(t, 2).alias(t) for t in times], *[c for c in runs.columns if c not in (*keys, *times)])


def batch_statistics(batches: DataFrame, *keys: str, size: str = "size", seconds: str = "seconds") -> DataFrame:
    """Batches, items, time, mean batch size and throughput (0 without any time)."""
    items, time = F.sum(size), F.sum(seconds)
    return batches.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("total_batches"), items.alias("total_items"), F.round(time, 4).alias("total_time"),
        F.round(items / F.count(F.lit(1)), 4).alias("average_batch_size"),
        F.round(F.when(time > 0, items / time).otherwise(0.0), 4).alias("average_throughput"),
    )


def throughput_by_batch_size(runs: DataFrame, batch: str = "batch_size", items: str = "items", seconds: str = "seconds") -> DataFrame:
    """Items a second at each batch size; 0 if no time was measured."""
    return runs.groupBy(batch).agg(F.round(F.when(F.sum(seconds) > 0, F.sum(items) / F.sum(seconds)).otherwise(0.0), 4).alias("throughput"))


def memory_hungry(runs: DataFrame, n: int = 5, key: str = "name") -> DataFrame:
    """The ``n`` runs whose peak is furthest above their start."""
    return runs.withColumn("memory_used", F.col("peak_mb") - F.col("start_mb")).orderBy(F.desc("memory_used"), key).limit(n)


def profile_totals(runs: DataFrame) -> DataFrame:
    """Number, sums and means of duration and memory of profiled runs."""
    memory = F.col("peak_mb") - F.col("start_mb")
    return runs.agg(
        F.count(F.lit(1)).alias("operations"), F.round(F.sum("seconds"), 2).alias("total_duration"), F.round(F.sum(memory), 1).alias("total_memory"),
        F.round(F.avg("seconds"), 2).alias("average_duration"), F.round(F.avg(memory), 1).alias("average_memory"),
    )


def compared(runs: DataFrame, by: str = "name") -> DataFrame:
    """Mean duration and memory of each approach over its iterations."""
    return runs.groupBy(by).agg(
        F.round(F.avg("seconds"), 4).alias("avg_duration"), F.round(F.avg(F.col("peak_mb") - F.col("start_mb")), 4).alias("avg_memory_mb"),
        F.count(F.lit(1)).alias("iterations"),
    )


def administration(tasks: DataFrame, files: DataFrame, checkpoints: DataFrame, now: Column) -> DataFrame:
    """State of a store as (section, name, value): tasks by status and in all, files, checkpoints and their size in megabytes."""
    row = lambda section, name, value: F.struct(F.lit(section).alias("section"), name.alias("name"), value.cast("double").alias("value"))
    by_status = tasks.groupBy("status").agg(F.count(F.lit(1)).alias("n")).select(row("tasks by status", F.col("status"), F.col("n")).alias("r"))
    recent = F.count_if(F.col("updated_at") > now - F.expr("INTERVAL 24 HOURS"))
    whole = tasks.agg(F.array(row("tasks", F.lit("total"), F.count(F.lit(1))), row("tasks", F.lit("active_last_24h"), recent)).alias("r"))
    n_files = files.agg(row("tasks", F.lit("files"), F.count(F.lit(1))).alias("r"))
    size = F.coalesce(F.sum("length"), F.lit(0)) / 1048576
    held = checkpoints.agg(F.array(row("checkpoints", F.lit("active_count"), F.count(F.lit(1))), row("checkpoints", F.lit("disk_usage_mb"), size)).alias("r"))
    each = by_status.unionByName(n_files).unionByName(whole.select(F.explode("r").alias("r"))).unionByName(held.select(F.explode("r").alias("r")))
    return each.select("r.*")
