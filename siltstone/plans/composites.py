"""Queries that compose ingestion, retrieval views and reports, with their DuckDB twins."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from siltstone.functions import text as T
from siltstone.operators import chunking, ingest, lessons, records, search
from siltstone.plans.catalogue import _COS, _GRADE_TEXT, _Q0, _TYPE, _case_sql, _graded, _regions, query, table, vector
from siltstone.plans.records import _NOW, _now

_ATOMIC = "('table', 'equation', 'image')"
_JOINS = f"r.open AND o.t NOT IN {_ATOMIC} AND o.t <> 'title' AND r.size + o.n <= 1000"
#: Regions of orders, numbered into chunks.
_CHUNKS = f"""o AS (SELECT l_orderkey AS doc_id, l_linenumber AS line, l_returnflag AS tag, {_TYPE} AS t, length(repeat(l_linestatus || ' ', trunc(l_quantity * 9)::INT)) AS n,
        row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS k FROM lineitem),
    r AS (SELECT doc_id, k, line, tag, t, n, 0 AS chunk_index, t NOT IN {_ATOMIC} AS open, CASE WHEN t IN {_ATOMIC} THEN 0 ELSE n END AS size FROM o WHERE k = 1
      UNION ALL SELECT o.doc_id, o.k, o.line, o.tag, o.t, o.n, r.chunk_index + CASE WHEN {_JOINS} THEN 0 ELSE 1 END, o.t NOT IN {_ATOMIC},
        CASE WHEN o.t IN {_ATOMIC} THEN 0 WHEN {_JOINS} THEN r.size + o.n ELSE o.n END FROM r JOIN o ON o.doc_id = r.doc_id AND o.k = r.k + 1)"""


def _sections(spark, sf_dir):
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")
    lines = table(spark, sf_dir, "lineitem").withColumn("sequence", F.row_number().over(order))
    return _regions(lines, "sequence").withColumn("table_html", F.lit("<table></table>")).withColumn("equation_type", F.lit(""))


@query(f"""WITH RECURSIVE {_CHUNKS}, c AS (SELECT doc_id, chunk_index, bool_and(t IN {_ATOMIC}) AS alone, any_value(t) AS t, string_agg(t, ',' ORDER BY k) AS ts, min(k) AS k,
        string_agg(doc_id || '_' || line, ',' ORDER BY k) AS ids, list_sort(list_distinct(list(trunc(line / 3)::INT))) AS pages, (sum(n) + 2 * (count(*) - 1))::BIGINT AS size, count(*) AS m,
        array_to_string(list_sort(list_distinct(list(tag))), ',') AS tags FROM r GROUP BY doc_id, chunk_index)
    SELECT doc_id, chunk_index::INT AS chunk_index, CASE WHEN alone THEN 'true' END AS atomic, CASE WHEN alone THEN t END AS region_type, CASE WHEN alone THEN ids END AS region_id,
        CASE WHEN alone THEN k::VARCHAR END AS region_sequence, CASE WHEN t = 'table' AND alone THEN '<table></table>' END AS table_html, NULL::VARCHAR AS equation_type,
        CASE WHEN NOT alone THEN m::VARCHAR END AS merged_regions, CASE WHEN NOT alone THEN ts END AS region_types, CASE WHEN NOT alone THEN ids END AS region_ids, pages[1]::VARCHAR AS page_number,
        CASE WHEN NOT alone AND len(pages) > 1 THEN array_to_string(pages, ',') END AS page_numbers, tags AS semantic_tags, size::VARCHAR AS end_index FROM c""")
def semantic_chunks(spark, sf_dir):
    found = chunking.semantic_chunks(_sections(spark, sf_dir), content=False)
    keys = "atomic region_type region_id region_sequence table_html equation_type merged_regions region_types region_ids page_number page_numbers semantic_tags end_index".split()
    return found.select("doc_id", "chunk_index", *[F.col("metadata")[k].alias(k) for k in keys])


@query(f"""WITH RECURSIVE {_CHUNKS}, c AS (SELECT doc_id, max(chunk_index) + 1 AS n FROM r GROUP BY doc_id)
    SELECT o_orderkey AS source, 'docs' AS collection_name, coalesce(n, 0)::BIGINT AS total_chunks, coalesce(n, 0)::BIGINT AS saved_chunks,
        CASE WHEN n > 0 THEN array_to_string(list_transform(generate_series(0, least(n, 3) - 1), lambda i: o_orderkey || '_chunk_' || i), ',') ELSE '' END AS embedding_ids,
        CASE WHEN n > 0 THEN 'success' ELSE 'failed - no chunks' END AS status FROM orders LEFT JOIN c ON o_orderkey = doc_id""")
def saved_documents(spark, sf_dir):
    """Semantic chunks of documents with ids and metadata, and the report of what was saved; a document without regions fails."""
    chunks = chunking.semantic_chunks(_sections(spark, sf_dir), content=False).withColumn("own", F.col("metadata")).drop("metadata")
    rows = ingest.chunk_metadata(chunks, F.create_map(F.lit("source"), F.col("doc_id").cast("string")), F.col("own"))
    sources = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("source"))
    made = ingest.saved_report(sources, rows.select(F.col("doc_id").alias("source"), "chunk_index", "id"), "docs", first=3)
    return made.withColumn("embedding_ids", F.array_join("embedding_ids", ","))


@query(f"""
    WITH d AS (SELECT e.vec_id, 'part ' || (e.vec_id % 7) || ' of ' || e.label AS document, round(1 - {_COS}, 12) AS distance, CASE WHEN label % 2 = 0 THEN 'image' ELSE 'text' END AS side FROM embeddings e, {_Q0}),
    h AS (SELECT *, list_distinct(string_split(document, ' ')) AS w FROM (SELECT * FROM d ORDER BY distance, vec_id LIMIT 20)),
    s AS (SELECT *, CASE WHEN side = 'text' THEN len(list_filter(['part', '3', 'of', '1'], lambda q: list_contains(w, q))) / 4.0 END AS score FROM h),
    r AS (SELECT *, row_number() OVER (PARTITION BY side ORDER BY score DESC NULLS LAST, distance, vec_id) AS rank FROM s)
    SELECT side, vec_id, rank::INT AS rank, score::DOUBLE AS score FROM r WHERE rank <= CASE WHEN side = 'image' THEN 3 ELSE 5 END""")
def chat_reranked(spark, sf_dir):
    """Chat retrieval with its rerank step."""
    e = table(spark, sf_dir, "embeddings").withColumn("modality", F.when(F.col("label") % 2 == 0, "image").otherwise("table"))
    e = e.withColumn("document", F.concat(F.lit("part "), (F.col("vec_id") % 7).cast("string"), F.lit(" of "), F.col("label").cast("string")))
    hits = search.top_k(e, vector(spark, sf_dir, 0), 20, id_col="vec_id")
    found = search.chat_sides(hits, search.overlap_scorer, "part 3 of 1", id_col="vec_id")
    return found.select("side", "vec_id", "rank", F.col("rerank_score").alias("score"))


@query(f"""WITH d AS (SELECT e.vec_id, e.label, round(1 - {_COS}, 12) AS distance FROM embeddings e, {_Q0} ORDER BY distance, vec_id LIMIT 30)
    SELECT vec_id, CASE WHEN label % 3 = 0 THEN 'image' ELSE 'text' END AS result_type, CASE WHEN label % 3 = 0 AND vec_id % 4 > 0 THEN label * 10 END::INT AS width,
        CASE WHEN label % 3 = 0 AND vec_id % 4 > 0 THEN 0 END::INT AS height, CASE WHEN label % 3 = 0 AND vec_id % 4 > 0 THEN 'unknown' END AS format,
        CASE WHEN label % 3 = 0 AND vec_id % 4 > 0 THEN '/api/images/thumbnail/c/d' || vec_id END AS thumbnail_url, CASE WHEN label % 3 = 0 AND vec_id % 4 > 0 THEN '0.5,0.0,0.0' END AS mean_rgb FROM d""")
def search_results(spark, sf_dir):
    label = F.col("label")
    values = {
        "modality": F.when(label % 3 == 0, "image"), "width": (label * 10).cast("string"), "mean_r": F.lit("0.5"), "mean_g": F.lit("odd"),
        "document_id": F.when(F.col("vec_id") % 4 > 0, F.concat(F.lit("d"), F.col("vec_id").cast("string"))),
    }
    metadata = F.map_filter(F.create_map(*[x for k, v in values.items() for x in (F.lit(k), v)]), lambda _, v: v.isNotNull())
    hits = search.top_k(table(spark, sf_dir, "embeddings").withColumn("metadata", metadata), vector(spark, sf_dir, 0), 30, id_col="vec_id")
    image = F.col("image_metadata")
    shown = [image[c].alias(c) for c in ("width", "height", "format", "thumbnail_url")]
    return search.result_rows(hits, "c").select("vec_id", "result_type", *shown, F.when(image.isNotNull(), F.array_join(image["mean_rgb"].cast("array<string>"), ",")).alias("mean_rgb"))


@query(f"""WITH d AS (SELECT e.vec_id, e.label, round(1 - {_COS}, 12) AS distance FROM embeddings e, {_Q0})
    (SELECT 'found' AS kind, vec_id FROM d WHERE label = 3 ORDER BY distance, vec_id LIMIT 3) UNION ALL (SELECT 'fallback' AS kind, vec_id FROM d ORDER BY distance, vec_id LIMIT 3)""")
def image_materials(spark, sf_dir):
    """Images for a lesson under a filter that some pass, and under one that none passes."""
    e, q = table(spark, sf_dir, "embeddings"), vector(spark, sf_dir, 0)
    near = lambda label, kind: search.filtered_or_all(e, q, 3, {"label": label}, id_col="vec_id").select(F.lit(kind).alias("kind"), "vec_id")
    return near(3, "found").unionByName(near(-1, "fallback"))


@query(f"""WITH t AS (SELECT p_partkey, lower(CASE WHEN p_size % 3 = 0 THEN 'algebra.pdf ' ELSE '' END || {_GRADE_TEXT}) AS x FROM part),
    h AS (SELECT p_partkey, {_case_sql('x', T.GRADES)} AS grade, {_case_sql('x', T.SUBJECTS)} AS subject FROM t)
    SELECT p_partkey, grade, subject, CASE WHEN grade IS NOT NULL OR subject IS NOT NULL THEN 'educational' END AS content_type FROM h""")
def metadata_hints(spark, sf_dir):
    name = F.when(F.col("p_size") % 3 == 0, "algebra.pdf").when(F.col("p_size") % 3 == 1, "")
    return _graded(spark, sf_dir).select("p_partkey", lessons.hints(F.col("label"), name).alias("h")).select("p_partkey", "h.*")


@query("""SELECT p_partkey, CASE WHEN p_size % 4 = 0 THEN '' ELSE '<div class="lesson-metadata">' || chr(10) || '<h1 class="lesson-title">' || p_name || '</h1>' || chr(10) || '<div class="metadata-grid">' || chr(10) ||
    '<div class="metadata-item"><span class="metadata-label">Duration:</span> <span class="metadata-value">' || p_size || ' minutes</span></div>' || chr(10) ||
    '<div class="metadata-item"><span class="metadata-label">Teaching Style:</span> <span class="metadata-value">Inquiry Based</span></div>' || chr(10) ||
    '<div class="metadata-item"><span class="metadata-label">Generated:</span> <span class="metadata-value">March 05, 2024 at 02:07 PM</span></div>' || chr(10) || '</div>' || chr(10) || '</div>' END AS box FROM part""")
def metadata_boxes(spark, sf_dir):
    block = F.concat(F.lit("---\ntitle: \""), "p_name", F.lit("\"\nduration: "), F.col("p_size").cast("string"), F.lit("\nteaching_style: inquiry_based\ngenerated: 2024-03-05T14:07:09Z\n---\n"))
    text = F.concat(F.lit("---\nlayout: x\n---\n\n"), F.when(F.col("p_size") % 4 > 0, block).otherwise(""), F.lit("# Body\n"))
    return table(spark, sf_dir, "part").select("p_partkey", lessons.metadata_box(text).alias("box"))


@query("""SELECT event_type AS name, round(avg(value), 4) AS avg_duration, round(avg(event_id % 100 - user_id % 50), 4) AS avg_memory_mb, count(*) AS iterations FROM events GROUP BY event_type""")
def approach_comparison(spark, sf_dir):
    runs = table(spark, sf_dir, "events").select(F.col("event_type").alias("name"), F.col("value").alias("seconds"), (F.col("event_id") % 100).alias("peak_mb"), (F.col("user_id") % 50).alias("start_mb"))
    return records.compared(runs)


@query(f"""SELECT 'tasks by status' AS section, o_orderstatus AS name, count(*)::DOUBLE AS value FROM orders GROUP BY o_orderstatus UNION ALL SELECT 'tasks', 'total', count(*) FROM orders
    UNION ALL SELECT 'tasks', 'active_last_24h', count(*) FROM orders WHERE o_orderdate > {_NOW} - INTERVAL 24 HOURS UNION ALL SELECT 'tasks', 'files', count(*) FROM lineitem
    UNION ALL SELECT 'checkpoints', 'active_count', count(*) FROM documents UNION ALL SELECT 'checkpoints', 'disk_usage_mb', round(sum(length(text)) / 1048576, 6) FROM documents""")
def administration(spark, sf_dir):
    tasks = table(spark, sf_dir, "orders").select(F.col("o_orderstatus").alias("status"), F.col("o_orderdate").cast("timestamp").alias("updated_at"))
    checkpoints = table(spark, sf_dir, "documents").select(F.length("text").alias("length"))
    return records.administration(tasks, table(spark, sf_dir, "lineitem"), checkpoints, _now()).withColumn("value", F.round("value", 6))


@query("""SELECT p_partkey, ['application/pdf', 'text/plain', 'application/octet-stream', 'text/csv'][p_partkey % 4 + 1] AS type FROM part""")
def fetched_types(spark, sf_dir):
    suffix = F.element_at(F.array(*map(F.lit, (".PDF", ".txt", "", ".csv"))), (F.col("p_partkey") % 4 + 1).cast("int"))
    return table(spark, sf_dir, "part").select("p_partkey", T.content_type(F.concat(F.lit("a.b/"), F.col("p_brand"), suffix)).alias("type"))
