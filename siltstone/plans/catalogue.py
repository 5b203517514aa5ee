"""Every query of the engine with its DuckDB twin (none where SQL cannot express it).

A query takes (spark, sf_dir) and runs over whole tables.  The tables stand in
for the entities of a retrieval system: embeddings for vector rows, documents
for documents, orders and lineitem for tasks and files, events for processing
events, conversations for sessions.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siltstone.functions import text as T
from siltstone.functions import vectors as V
from siltstone.operators import chunking, context, ingest, lessons, metrics, regions, search, tasks
from siltstone.streaming import streams

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vector(spark: SparkSession, sf_dir: str, key: int) -> list[float]:
    """One stated query vector."""
    row = table(spark, sf_dir, "embeddings").where(F.col("vec_id") == key).select("embedding").first()
    return [float(x) for x in row[0]]


_COS = "list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[])"
_Q0 = "(SELECT embedding FROM embeddings WHERE vec_id = 0) q"


def _hits(df: DataFrame) -> DataFrame:
    return df.select("vec_id", "label", F.round("distance", 6).alias("distance"), F.round("score", 6).alias("score"))


# ---- vector search


@query(f"""
    WITH d AS (SELECT e.vec_id, e.label, 1 - {_COS} AS distance FROM embeddings e, {_Q0} WHERE e.label IN (1, 2, 3) AND e.label >= 2)
    SELECT vec_id, label, round(distance, 6) AS distance, round(greatest(0, 1 - distance), 6) AS score
    FROM d ORDER BY d.distance, vec_id LIMIT 10""")
def knn_filtered(spark, sf_dir):
    where = {"$and": [{"label": {"$in": [1, 2, 3]}}, {"label": {"$gte": 2}}]}
    return _hits(search.top_k(table(spark, sf_dir, "embeddings"), vector(spark, sf_dir, 0), 10, where=where, id_col="vec_id"))


def _knn_sql(distance: str) -> str:
    return f"""WITH d AS (SELECT e.vec_id, e.label, {distance} AS distance FROM embeddings e, {_Q0})
    SELECT vec_id, label, round(distance, 6) AS distance, round(greatest(0, 1 - distance), 6) AS score
    FROM d ORDER BY round(d.distance, 12), vec_id LIMIT 10"""


@query(_knn_sql(f"1 - {_COS}"))
def knn_cosine(spark, sf_dir):
    return _hits(search.top_k(table(spark, sf_dir, "embeddings"), vector(spark, sf_dir, 0), 10, "cosine", id_col="vec_id"))


@query(_knn_sql("list_distance(e.embedding::DOUBLE[], q.embedding::DOUBLE[]) ** 2"))
def knn_l2(spark, sf_dir):
    return _hits(search.top_k(table(spark, sf_dir, "embeddings"), vector(spark, sf_dir, 0), 10, "l2", id_col="vec_id"))


@query(_knn_sql("1 - list_inner_product(e.embedding::DOUBLE[], q.embedding::DOUBLE[])"))
def knn_ip(spark, sf_dir):
    return _hits(search.top_k(table(spark, sf_dir, "embeddings"), vector(spark, sf_dir, 0), 10, "ip", id_col="vec_id"))


_BATCH = f"""
    WITH d AS (SELECT q.vec_id AS query_id, e.vec_id, round(1 - {_COS}, 12) AS distance, e.label
               FROM embeddings e, embeddings q WHERE q.vec_id % 100 = 0),
    r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id) AS rank FROM d)"""


def _batch(spark, sf_dir, k=10, where=None):
    e = table(spark, sf_dir, "embeddings")
    queries = e.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vector"))
    return search.batch_top_k(search.filtered(e, where), queries, k, id_col="vec_id")


@query(f"{_BATCH} SELECT query_id, vec_id, round(distance, 6) AS distance, rank::INT AS rank FROM r WHERE rank <= 10")
def knn_batch(spark, sf_dir):
    return _batch(spark, sf_dir).select("query_id", "vec_id", F.round("distance", 6).alias("distance"), "rank")


@query(f"""{_BATCH} SELECT query_id, vec_id, rank::INT AS rank FROM r WHERE rank <= 10 AND NOT (rank = 1 AND distance < 0.01)""")
def knn_exclude_self(spark, sf_dir):
    return search.without_self(_batch(spark, sf_dir)).select("query_id", "vec_id", "rank")


@query(f"""
    WITH d AS (SELECT q.vec_id AS query_id, e.vec_id, round(1 - {_COS}, 12) AS distance, e.label FROM embeddings e, embeddings q WHERE q.vec_id % 100 = 0),
    l AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id) AS rank FROM d WHERE label = 3),
    f AS (SELECT * FROM l WHERE rank <= 5 AND distance < 0.7),
    u AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id) AS rank FROM d)
    SELECT query_id, vec_id, rank::INT AS rank FROM f
    UNION ALL SELECT query_id, vec_id, rank::INT AS rank FROM u WHERE rank <= 5 AND query_id NOT IN (SELECT query_id FROM f)""")
def knn_fallback(spark, sf_dir):
    near = _batch(spark, sf_dir, 5, {"label": 3}).where("distance < 0.7")
    return search.with_fallback(near, _batch(spark, sf_dir, 5)).select("query_id", "vec_id", "rank")


@query("SELECT vec_id, label, 1.0::DOUBLE AS score FROM embeddings WHERE vec_id = 42")
def point_lookup(spark, sf_dir):
    return search.point_lookup(table(spark, sf_dir, "embeddings"), 42, "vec_id").select("vec_id", "label", "score")


@query("""
    WITH t AS (SELECT vec_id // 4 AS doc, vec_id, embedding::DOUBLE[] AS v FROM embeddings),
    q AS (SELECT vec_id, v FROM t WHERE vec_id < 3),
    s AS (SELECT q.vec_id AS qv, t.doc, max(list_inner_product(q.v, t.v)) AS best, avg(list_inner_product(q.v, t.v)) AS mean FROM q, t GROUP BY ALL)
    SELECT doc, round(avg(best), 6) AS max_sim, round(avg(mean), 6) AS avg_sim FROM s GROUP BY doc""")
def late_interaction(spark, sf_dir):
    tokens = F.array(*[V.literal(vector(spark, sf_dir, n)) for n in range(3)])
    docs = _multivectors(spark, sf_dir)
    return docs.select("doc", F.round(V.max_sim(tokens, F.col("tokens")), 6).alias("max_sim"), F.round(V.avg_sim(tokens, F.col("tokens")), 6).alias("avg_sim"))


def _multivectors(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    rows = F.sort_array(F.collect_list(F.struct("vec_id", "embedding")))
    return e.groupBy(F.floor(F.col("vec_id") / 4).cast("long").alias("doc")).agg(F.transform(rows, lambda r: r["embedding"]).alias("tokens"))


@query("""
    WITH t AS (SELECT vec_id // 4 AS doc, vec_id, embedding::DOUBLE[] AS v FROM embeddings),
    m AS (SELECT doc, list(x ORDER BY i) AS v FROM (SELECT doc, i, avg(x) AS x FROM (SELECT doc, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM t) GROUP BY ALL) GROUP BY doc),
    qm AS (SELECT list(x ORDER BY i) AS v FROM (SELECT i, avg(x) AS x FROM (SELECT unnest(v) AS x, generate_subscripts(v, 1) AS i FROM t WHERE vec_id < 3) GROUP BY i)),
    f AS (SELECT doc, 1 - list_cosine_similarity(m.v, qm.v) AS distance FROM m, qm ORDER BY distance, doc LIMIT 50),
    s AS (SELECT q.vec_id AS qv, t.doc, max(list_inner_product(q.v, t.v)) AS best FROM t q, t JOIN f USING (doc) WHERE q.vec_id < 3 GROUP BY ALL)
    SELECT doc, round(avg(best), 6) AS max_sim FROM s GROUP BY doc ORDER BY avg(best) DESC LIMIT 10""")
def two_stage_search(spark, sf_dir):
    tokens = [vector(spark, sf_dir, n) for n in range(3)]
    return search.two_stage(_multivectors(spark, sf_dir), tokens, 50, 10, "doc").select("doc", F.round("max_sim", 6).alias("max_sim"))


@query("""
    SELECT vec_id, array_to_string(list_transform(embedding, lambda x: trunc(x::DOUBLE * 127)::INT), ',') AS int8,
        array_to_string(list_transform(embedding, lambda x: trunc((x::DOUBLE + 1) / 2 * 255)::INT), ',') AS uint8,
        len(list_slice(embedding, 1, 32))::INT AS dimension FROM embeddings""")
def quantized_vectors(spark, sf_dir):
    short = F.col("embedding")
    return table(spark, sf_dir, "embeddings").select(
        "vec_id", F.array_join(V.to_int8(short).cast("array<string>"), ",").alias("int8"),
        F.array_join(V.to_uint8(short).cast("array<string>"), ",").alias("uint8"),
        F.size(V.truncated(F.col("embedding"), 32)).alias("dimension"),
    )


@query("""
    SELECT label, i::INT AS i, round(avg(x), 6) AS mean FROM
    (SELECT label, unnest(embedding::DOUBLE[]) AS x, generate_subscripts(embedding, 1) - 1 AS i FROM embeddings) GROUP BY label, i""")
def mean_vectors(spark, sf_dir):
    each = table(spark, sf_dir, "embeddings").select("label", F.posexplode("embedding").alias("i", "x"))
    return each.groupBy("label", "i").agg(F.round(F.avg(F.col("x").cast("double")), 6).alias("mean"))


@query(f"""
    WITH d AS (SELECT e.vec_id, round(1 - {_COS}, 12) AS distance, CASE WHEN label % 2 = 0 THEN 'image' ELSE 'text' END AS side FROM embeddings e, {_Q0}),
    h AS (SELECT * FROM d ORDER BY distance, vec_id LIMIT 20),
    r AS (SELECT side, vec_id, row_number() OVER (PARTITION BY side ORDER BY distance, vec_id) AS rank FROM h)
    SELECT side, vec_id, rank::INT AS rank FROM r WHERE rank <= CASE WHEN side = 'image' THEN 3 ELSE 5 END""")
def chat_retrieval(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").withColumn("modality", F.when(F.col("label") % 2 == 0, "image").otherwise("table"))
    hits = search.top_k(e, vector(spark, sf_dir, 0), 20, id_col="vec_id")
    return search.split_by_modality(hits, id_col="vec_id").select("side", "vec_id", "rank")


@query(f"""
    WITH d AS (SELECT e.vec_id, e.label, round(1 - {_COS}, 12) AS distance FROM embeddings e, {_Q0})
    (SELECT vec_id, 'text' AS source_type FROM d WHERE label % 2 = 1 ORDER BY distance, vec_id LIMIT 5)
    UNION ALL (SELECT vec_id, 'image' AS source_type FROM d WHERE label % 2 = 0 ORDER BY distance, vec_id LIMIT 3)""")
def lesson_materials(spark, sf_dir):
    e, q = table(spark, sf_dir, "embeddings"), vector(spark, sf_dir, 0)
    near = lambda odd, k: search.top_k(e.where(F.col("label") % 2 == odd), q, k, id_col="vec_id")
    return search.materials(near(1, 5), near(0, 3)).select("vec_id", "source_type")


@query("""
    WITH w AS (SELECT doc_id, list_distinct(regexp_split_to_array(lower(text), '\\W+')) AS w FROM documents),
    q AS (SELECT list_distinct(regexp_split_to_array(lower('The shining of the and for'), '\\W+')) AS w)
    SELECT doc_id, round(len(list_intersect(q.w, w.w)) / len(q.w), 6) AS score FROM w, q ORDER BY len(list_intersect(q.w, w.w)) DESC, doc_id LIMIT 25""")
def reranked(spark, sf_dir):
    hits = table(spark, sf_dir, "documents").select("doc_id", "text", F.lit(0.5).alias("score"))
    found = search.rerank(hits, search.overlap_scorer, "The shining of the and for", 25, "text", id_col="doc_id")
    return found.select("doc_id", F.round("score", 6).alias("score"))


@query("SELECT 'label' || label AS collection, count(*) AS n FROM embeddings GROUP BY label")
def collection_stats(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").withColumn("collection", F.concat(F.lit("label"), F.col("label").cast("string")))
    return e.groupBy("collection").agg(F.count(F.lit(1)).alias("n"))


@query("""
    SELECT vec_id, CASE WHEN label = 0 THEN label + 100 ELSE label END AS label FROM embeddings
    UNION ALL SELECT 1000000 + vec_id, label + 100 FROM embeddings WHERE label = 0""")
def upsert_embeddings(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select("vec_id", "label")
    changed = e.where("label = 0").withColumn("label", F.col("label") + 100)
    return tasks.upserted(e, changed.unionByName(changed.withColumn("vec_id", F.col("vec_id") + 1000000)), "vec_id")


@query("SELECT vec_id, label FROM embeddings WHERE label <> 4")
def delete_embeddings(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select("vec_id", "label")
    return tasks.without(e, e.where("label = 4"), "vec_id")


# ---- chunks


def _chunk_sql(count: str, step: int, size: int) -> str:
    return f"""
    WITH s AS (SELECT doc_id, text, unnest(generate_series(0, {count} - 1)) AS slot FROM documents WHERE length(text) > 0),
    c AS (SELECT doc_id, (slot * {step})::INT AS start_index, least(slot * {step} + {size}, length(text))::INT AS end_index,
          substr(text, slot * {step} + 1, {size}) AS content FROM s),
    k AS (SELECT *, (row_number() OVER (PARTITION BY doc_id ORDER BY start_index) - 1)::INT AS chunk_index FROM c WHERE regexp_matches(content, '\\S'))"""


_FIXED = _chunk_sql("greatest(1, ceil((length(text) - 64) / 448.0))::BIGINT", 448, 512)
_SLIDING = _chunk_sql("(CASE WHEN length(text) <= 512 THEN 1 ELSE ceil((length(text) - 512) / 256.0) + 1 END)::BIGINT", 256, 512)


@query(f"{_FIXED} SELECT doc_id, chunk_index, start_index, end_index, md5(content) AS content FROM k")
def chunk_fixed(spark, sf_dir):
    return chunking.fixed_chunks(table(spark, sf_dir, "documents"), 512, 64).withColumn("content", F.md5("content"))


@query(f"{_SLIDING} SELECT doc_id, chunk_index, start_index, end_index, md5(content) AS content FROM k")
def chunk_sliding(spark, sf_dir):
    return chunking.sliding_chunks(table(spark, sf_dir, "documents")).withColumn("content", F.md5("content"))


_SENTENCES = """list_filter(list_transform(string_split(regexp_replace(text, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)),
    lambda s: regexp_replace(s, '^\\s+|\\s+$', '', 'g')), lambda s: s <> '')"""


@query(f"SELECT doc_id, len({_SENTENCES})::INT AS n, md5(array_to_string({_SENTENCES}, '|')) AS digest FROM documents")
def sentence_split(spark, sf_dir):
    found = table(spark, sf_dir, "documents").withColumn("s", T.sentences(F.col("text")))
    return found.select("doc_id", F.size("s").alias("n"), F.md5(F.array_join("s", "|")).alias("digest"))


_FULL = "r.size + length(u.x) > 512"


@query(f"""
    WITH RECURSIVE l AS (SELECT doc_id, {_SENTENCES} AS parts FROM documents),
    u AS (SELECT doc_id, len(parts) AS n, unnest(parts) AS x, generate_subscripts(parts, 1) AS k FROM l),
    r AS (SELECT doc_id, n, k, [x] AS cur, length(x) AS size, length(x) + 1 AS pos, 0 AS chunk_index, NULL::VARCHAR AS content, 0::BIGINT AS start_index, 0::BIGINT AS end_index, 0::BIGINT AS sentence_count
        FROM u WHERE k = 1
      UNION ALL SELECT u.doc_id, u.n, u.k, CASE WHEN {_FULL} THEN [r.cur[-1], u.x] ELSE list_append(r.cur, u.x) END,
        CASE WHEN {_FULL} THEN length(r.cur[-1]) ELSE r.size END + length(u.x) + 1, r.pos + length(u.x) + 1, r.chunk_index + CASE WHEN {_FULL} THEN 1 ELSE 0 END,
        CASE WHEN {_FULL} THEN array_to_string(r.cur, ' ') END, r.pos - r.size, r.pos, len(r.cur) FROM r JOIN u ON u.doc_id = r.doc_id AND u.k = r.k + 1),
    c AS (SELECT doc_id, chunk_index - 1 AS chunk_index, content, start_index, end_index, sentence_count FROM r WHERE content IS NOT NULL
      UNION ALL SELECT doc_id, chunk_index, array_to_string(cur, ' '), pos - size, pos, len(cur) FROM r WHERE k = n)
    SELECT doc_id, chunk_index::INT AS chunk_index, content, start_index::INT AS start_index, end_index::INT AS end_index, sentence_count::INT AS sentence_count FROM c""")
def chunk_sentence(spark, sf_dir):
    return chunking.sentence_chunks(table(spark, sf_dir, "documents"))


# pages of uneven lengths: every third one runs on into the next, every seventh is empty, every eleventh leaves a gap
_PAGES = """p AS (SELECT doc_id, n AS page_number, n * 700 - (n * n * 37) % 400 AS page_start, CASE WHEN n % 7 = 3 THEN n * 700 - (n * n * 37) % 400
      ELSE least((n + 1) * 700 - ((n + 1) * (n + 1) * 37) % 400 + CASE WHEN n % 3 = 0 THEN 150 WHEN n % 11 = 5 THEN -200 ELSE 0 END, length(text)) END AS page_end
    FROM (SELECT doc_id, text, unnest(generate_series(0, length(text) // 700)) AS n FROM documents WHERE length(text) > 0)),
    j AS (SELECT k.doc_id, chunk_index, page_number, least(end_index, page_end) - greatest(start_index, page_start) AS shared
          FROM k JOIN p ON k.doc_id = p.doc_id AND greatest(start_index, page_start) < least(end_index, page_end)),
    r AS (SELECT *, row_number() OVER (PARTITION BY doc_id, chunk_index ORDER BY shared DESC, page_number) AS o FROM j),
    a AS (SELECT doc_id, chunk_index, max(CASE WHEN o = 1 THEN page_number END)::INT AS page_number, count(*)::INT AS pages_spanned,
        string_agg(page_number::VARCHAR, ',' ORDER BY page_number) AS page_numbers FROM r GROUP BY doc_id, chunk_index)"""


def _page_of(n):
    """Start and end of the ``n``-th page before it is cut at the end of the text."""
    start = lambda n: n * 700 - (n * n * 37) % 400
    end = start(n + 1) + F.when(n % 3 == 0, 150).when(n % 11 == 5, -200).otherwise(0)
    return F.struct(n.alias("page_number"), start(n).alias("page_start"), F.when(n % 7 == 3, start(n)).otherwise(F.least(end, F.length("text"))).alias("page_end"))


def _pages(text="text"):
    return F.transform(F.sequence(F.lit(0), F.floor(F.length(text) / 700).cast("int")), _page_of)


def _attributed(found):
    return found.select("doc_id", "chunk_index", "page_number", "pages_spanned", F.array_join(F.col("page_numbers").cast("array<string>"), ",").alias("page_numbers"))


@query(f"{_FIXED}, {_PAGES} SELECT k.doc_id, k.chunk_index, page_number, pages_spanned, page_numbers FROM k LEFT JOIN a USING (doc_id, chunk_index)")
def page_attribution(spark, sf_dir):
    """Boundaries in the row: binary search, nothing is shuffled."""
    docs = table(spark, sf_dir, "documents")
    return _attributed(chunking.fixed_chunks(docs, 512, 64, pages=_pages()))


@query(f"{_FIXED}, {_PAGES} SELECT doc_id, chunk_index, page_number, pages_spanned, page_numbers FROM a")
def page_ranges_joined(spark, sf_dir):
    """Boundaries as a table: range join."""
    docs = table(spark, sf_dir, "documents")
    pages = docs.where(F.length("text") > 0).select("doc_id", F.inline(_pages()))
    return _attributed(chunking.attribute_pages(chunking.fixed_chunks(docs, 512, 64), pages))


@query(f"""{_FIXED} SELECT lang, count(*) AS n_chunks, count(DISTINCT doc_id) AS n_docs, round(avg(length(content)), 4) AS avg_chars
    FROM k JOIN documents USING (doc_id) GROUP BY lang""")
def chunk_stats(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    chunks = chunking.fixed_chunks(docs, 512, 64, keep=["lang"])
    return chunks.groupBy("lang").agg(
        F.count(F.lit(1)).alias("n_chunks"), F.countDistinct("doc_id").alias("n_docs"), F.round(F.avg(F.length("content")), 4).alias("avg_chars")
    )


def _regions(lines, sequence="l_linenumber"):
    kind = F.element_at(F.array(*map(F.lit, ("text", "text", "list", "title", "table", "image", "equation"))), (F.col("l_linenumber") % 7 + 1).cast("int"))
    return lines.select(
        F.col("l_orderkey").alias("doc_id"), F.col(sequence).alias("region_sequence"), kind.alias("region_type"),
        F.repeat(F.concat(F.col("l_linestatus"), F.lit(" ")), (F.col("l_quantity") * 9).cast("int")).alias("content"),
        (F.col("l_linenumber") / 3).cast("int").alias("page_number"),
        F.concat_ws("_", "l_orderkey", "l_linenumber").alias("region_id"), F.array("l_returnflag").alias("semantic_tags"),
    )


_TYPE = "CASE l_linenumber % 7 WHEN 0 THEN 'text' WHEN 1 THEN 'text' WHEN 2 THEN 'list' WHEN 3 THEN 'title' WHEN 4 THEN 'table' WHEN 5 THEN 'image' ELSE 'equation' END"
_ATOMIC = "('table', 'equation', 'image')"
_JOINS = f"r.open AND o.t NOT IN {_ATOMIC} AND o.t <> 'title' AND r.size + o.n <= 1000"


@query(f"""
    WITH RECURSIVE o AS (SELECT l_orderkey AS doc_id, {_TYPE} AS t, length(repeat(l_linestatus || ' ', trunc(l_quantity * 9)::INT)) AS n,
        row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS k FROM lineitem),
    r AS (SELECT doc_id, k, t, n, 0 AS chunk_index, t NOT IN {_ATOMIC} AS open, CASE WHEN t IN {_ATOMIC} THEN 0 ELSE n END AS size FROM o WHERE k = 1
      UNION ALL SELECT o.doc_id, o.k, o.t, o.n, r.chunk_index + CASE WHEN {_JOINS} THEN 0 ELSE 1 END, o.t NOT IN {_ATOMIC},
        CASE WHEN o.t IN {_ATOMIC} THEN 0 WHEN {_JOINS} THEN r.size + o.n ELSE o.n END FROM r JOIN o ON o.doc_id = r.doc_id AND o.k = r.k + 1)
    SELECT doc_id, chunk_index::INT AS chunk_index, (sum(n) + 2 * (count(*) - 1))::INT AS n_chars, string_agg(t, ',' ORDER BY k) AS region_types,
        count(*)::INT AS n_regions, bool_and(t IN {_ATOMIC}) AS atomic FROM r GROUP BY doc_id, chunk_index""")
def region_chunks(spark, sf_dir):
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")
    lines = table(spark, sf_dir, "lineitem").withColumn("sequence", F.row_number().over(order))
    found = chunking.region_chunks(_regions(lines, "sequence"))
    return found.select("doc_id", "chunk_index", F.length("content").alias("n_chars"), F.array_join("region_types", ",").alias("region_types"), "n_regions", "atomic")


@query("SELECT l_orderkey AS doc_id, " + ", ".join(f"count(*) FILTER ({_TYPE} = '{t}') AS \"{t}\"" for t in regions.TYPES) + " FROM lineitem GROUP BY l_orderkey")
def region_pivot(spark, sf_dir):
    return regions.type_counts(_regions(table(spark, sf_dir, "lineitem")), "doc_id")


@query(f"""SELECT l_orderkey AS doc_id, string_agg({_TYPE}, ',' ORDER BY l_linenumber) AS region_types,
    string_agg(l_orderkey || '_' || l_linenumber, ',' ORDER BY l_linenumber) AS region_ids,
    array_to_string(list_sort(list_distinct(list(trunc(l_linenumber / 3)::INT))), ',') AS page_numbers,
    array_to_string(list_sort(list_distinct(list(l_returnflag))), ',') AS semantic_tags,
    sum(length(repeat(l_linestatus || ' ', trunc(l_quantity * 9)::INT)) + 2)::BIGINT - 2 AS n_chars FROM lineitem GROUP BY l_orderkey""")
def merged_regions(spark, sf_dir):
    found = regions.merged(_regions(table(spark, sf_dir, "lineitem")), "doc_id")
    glue = lambda c: F.array_join(F.col(c).cast("array<string>"), ",").alias(c)
    return found.select("doc_id", *map(glue, ("region_types", "region_ids", "page_numbers", "semantic_tags")), F.length("content").cast("long").alias("n_chars"))


@query("""
    WITH RECURSIVE t AS (SELECT source, doc_id, floor(len(list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> '')) * 1.3::DOUBLE)::INT AS tokens,
        row_number() OVER (PARTITION BY source ORDER BY doc_id) AS i FROM documents),
    r AS (SELECT source, doc_id, tokens, i, 0 AS batch_number, tokens AS total, 1 AS items FROM t WHERE i = 1
      UNION ALL SELECT t.source, t.doc_id, t.tokens, t.i, r.batch_number + CASE WHEN r.total + t.tokens > 8192 OR r.items >= 32 THEN 1 ELSE 0 END,
        CASE WHEN r.total + t.tokens > 8192 OR r.items >= 32 THEN t.tokens ELSE r.total + t.tokens END,
        CASE WHEN r.total + t.tokens > 8192 OR r.items >= 32 THEN 1 ELSE r.items + 1 END
      FROM r JOIN t ON t.source = r.source AND t.i = r.i + 1)
    SELECT source, doc_id, tokens, batch_number FROM r""")
def token_batches(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return chunking.token_batches(docs, key_col="source", order_col="doc_id")


@query("""
    WITH f AS (SELECT doc_id, lang || '/' || (doc_id % 50) AS path, sha256(text) AS fingerprint FROM documents),
    seen AS (SELECT DISTINCT path, fingerprint FROM f WHERE path LIKE 'en/%')
    SELECT doc_id, path, fingerprint FROM f WHERE NOT EXISTS (SELECT 1 FROM seen s WHERE s.path = f.path AND s.fingerprint = f.fingerprint)""")
def incremental_skip(spark, sf_dir):
    path = F.concat(F.col("lang"), F.lit("/"), (F.col("doc_id") % 50).cast("string"))
    files = table(spark, sf_dir, "documents").select("doc_id", path.alias("path"), tasks.fingerprint(F.col("text")).alias("fingerprint"))
    return tasks.new_files(files, files.where("path LIKE 'en/%'").dropDuplicates(["path", "fingerprint"])).select("doc_id", "path", "fingerprint")


@query("SELECT sha256(text) AS fingerprint, count(*) AS n, min(doc_id) AS first_doc FROM documents GROUP BY sha256(text)")
def fingerprint_groups(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", tasks.fingerprint(F.col("text")).alias("fingerprint"))
    return docs.groupBy("fingerprint").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first_doc"))


# ---- text

_TOPICS = ("math notes", "World History reading", "earth science", "trade design", "music", "coding it", "p_name only", "German sports", "Health and algebra")
_GRADE_TEXT = "'Grade ' || (p_size % 14) || ' ' || " + f"[{', '.join(repr(t) for t in _TOPICS)}]" + "[p_partkey % 9 + 1] || ' ' || p_name"


def _graded(spark, sf_dir):
    topic = F.element_at(F.array(*map(F.lit, _TOPICS)), (F.col("p_partkey") % 9 + 1).cast("int"))
    label = F.concat(F.lit("Grade "), (F.col("p_size") % 14).cast("string"), F.lit(" "), topic, F.lit(" "), F.col("p_name"))
    return table(spark, sf_dir, "part").withColumn("label", label)


def _case_sql(text: str, cases: dict[str, list[str]], default: str = "NULL") -> str:
    whens = " ".join(f"WHEN regexp_matches({text}, '{'|'.join(p)}') THEN '{name}'" for name, p in cases.items())
    return f"CASE {whens} ELSE {default} END"


@query(f"""WITH t AS (SELECT p_partkey, lower({_GRADE_TEXT}) AS x FROM part)
    SELECT p_partkey, {_case_sql('x', T.GRADES)} AS grade, {_case_sql('x', T.SUBJECTS)} AS subject,
    array_to_string(list_filter([{', '.join(_case_sql('x', {n: p}) for n, p in T.SUBJECTS.items())}], lambda s: s IS NOT NULL), ',') AS subjects FROM t""")
def grade_and_subject(spark, sf_dir):
    x = F.col("label")
    return _graded(spark, sf_dir).select("p_partkey", T.grade_of(x).alias("grade"), T.subject_of(x).alias("subject"), F.array_join(T.all_subjects(x), ",").alias("subjects"))


_GRADES = ("K", "PreK", "1", "4", "12", "K-2", "3-5", "9-12", "College", "odd", "a-b")


@query(f"""
    WITH g AS (SELECT p_partkey, [{', '.join(repr(g) for g in _GRADES)}][p_partkey % 11 + 1] AS a, [{', '.join(repr(g) for g in _GRADES)}][p_size % 11 + 1] AS b FROM part),
    p AS (SELECT p_partkey, a, b, string_split(a, '-') AS pa, string_split(b, '-') AS pb FROM g),
    n AS (SELECT p_partkey, a, b,
      CASE pa[1] WHEN 'K' THEN 0 WHEN 'PreK' THEN -1 WHEN 'College' THEN 13 ELSE try_cast(pa[1] AS INT) END AS a1,
      CASE pa[-1] WHEN 'K' THEN 0 WHEN 'PreK' THEN -1 WHEN 'College' THEN 13 ELSE try_cast(pa[-1] AS INT) END AS a2,
      CASE pb[1] WHEN 'K' THEN 0 WHEN 'PreK' THEN -1 WHEN 'College' THEN 13 ELSE try_cast(pb[1] AS INT) END AS b1,
      CASE pb[-1] WHEN 'K' THEN 0 WHEN 'PreK' THEN -1 WHEN 'College' THEN 13 ELSE try_cast(pb[-1] AS INT) END AS b2 FROM p)
    SELECT p_partkey, coalesce(a1 <= b2 AND b1 <= a2, true) AS matches FROM n""")
def grade_match(spark, sf_dir):
    pick = lambda n: F.element_at(F.array(*map(F.lit, _GRADES)), (F.col(n) % 11 + 1).cast("int"))
    return table(spark, sf_dir, "part").select("p_partkey", T.grade_match(pick("p_partkey"), pick("p_size")).alias("matches"))


_PICTURES = ("company logo of", "UI of the", "a Flowchart with", "bar graph of", "photo of", "nothing of", "trend  in   revenue", "Building guide")


@query(f"""WITH t AS (SELECT p_partkey, [{', '.join(repr(t) for t in _PICTURES)}][p_partkey % 8 + 1] || '  ' || p_type AS x FROM part)
    SELECT p_partkey, {_case_sql('lower(x)', T.IMAGE_TYPES, "'unknown'")} AS image_type, trim(regexp_replace(x, '\\s+', ' ', 'g')) AS cleaned,
    len(string_split(trim(regexp_replace(x, '\\s+', ' ', 'g')), ' '))::INT AS word_count,
    regexp_matches(lower(x), '{'|'.join(T.TECHNICAL)}') AS technical FROM t""")
def image_descriptions(spark, sf_dir):
    x = F.concat(F.element_at(F.array(*map(F.lit, _PICTURES)), (F.col("p_partkey") % 8 + 1).cast("int")), F.lit("  "), F.col("p_type"))
    made = table(spark, sf_dir, "part").withColumn("x", x).withColumn("s", T.description_stats(F.col("x")))
    return made.select("p_partkey", T.image_type(F.col("x")).alias("image_type"), "s.cleaned", "s.word_count", F.col("s.has_technical_terms").alias("technical"))


_CITED = "'See [' || (o_orderkey % 7) || '] and [' || (o_custkey % 12) || '], [2] [' || (o_orderkey % 7) || '] not [x]'"


def _cited(spark, sf_dir):
    s = lambda c, n: (F.col(c) % n).cast("string")
    text = F.concat(F.lit("See ["), s("o_orderkey", 7), F.lit("] and ["), s("o_custkey", 12), F.lit("], [2] ["), s("o_orderkey", 7), F.lit("] not [x]"))
    return table(spark, sf_dir, "orders").withColumn("text", text)


_NUMBERS = f"list_sort(list_distinct(list_transform(regexp_extract_all({_CITED}, '\\[(\\d+)\\]', 1), lambda x: x::INT)))"


@query(f"""SELECT o_orderkey, array_to_string({_NUMBERS}, ',') AS cited,
    array_to_string(list_filter(generate_series(1, o_orderkey % 6), lambda n: NOT list_contains({_NUMBERS}, n::INT)), ',') AS missing FROM orders""")
def citations(spark, sf_dir):
    return _cited(spark, sf_dir).select(
        "o_orderkey", F.array_join(T.citations(F.col("text")), ",").alias("cited"),
        F.array_join(T.missing_citations(F.col("text"), (F.col("o_orderkey") % 6).cast("int")).cast("array<string>"), ",").alias("missing"),
    )


def _lesson(spark, sf_dir):
    key, status = F.col("o_orderkey").cast("string"), F.col("o_orderstatus")
    head = lessons.frontmatter_block(
        title=F.concat(F.lit('"Lesson '), key, F.lit('"')), grade=(F.col("o_orderkey") % 12).cast("string"),
        duration=(F.col("o_custkey") % 90).cast("string"), favorite=F.when(status == "F", "true").otherwise("false"),
    )
    body = F.concat(F.lit("before\n# Goals\nknow [1] it\n\nmore\n## "), F.col("o_orderpriority"), F.lit("\nx\n#### deep\n### Last\n"))
    return table(spark, sf_dir, "orders").withColumn("text", F.concat(head, body))


@query("""SELECT o_orderkey, 'Lesson ' || o_orderkey AS title, (o_orderkey % 12)::VARCHAR AS grade, (o_custkey % 90)::INT AS duration,
    o_orderstatus = 'F' AS favorite FROM orders""")
def frontmatter(spark, sf_dir):
    made = _lesson(spark, sf_dir).withColumn("f", lessons.frontmatter(F.col("text")))
    f = F.col("f")
    return made.select("o_orderkey", f["title"].alias("title"), f["grade"].alias("grade"), lessons.number_field(f, "duration").alias("duration"), lessons.flag_field(f, "favorite").alias("favorite"))


@query("""SELECT o_orderkey, unnest([1, 2, 3])::INT AS level, unnest(['Goals', o_orderpriority, 'Last']) AS title,
    unnest(['know [1] it' || chr(10) || 'more', 'x' || chr(10) || '#### deep', '']) AS content FROM orders""")
def section_parse(spark, sf_dir):
    return _lesson(spark, sf_dir).select("o_orderkey", F.explode(lessons.sections(F.col("text"))).alias("s")).select("o_orderkey", "s.*")


_HTML = "'<table><tr><th>' || p_brand || '</th><th>b</th></tr>' || repeat('<tr><td>1</td><td>2</td><td>' || p_size || '</td></tr>', p_size % 4) || '</table>'"


def _tables(spark, sf_dir):
    rows = F.repeat(F.concat(F.lit("<tr><td>1</td><td>2</td><td>"), F.col("p_size").cast("string"), F.lit("</td></tr>")), F.col("p_size") % 4)
    return table(spark, sf_dir, "part").withColumn("html", F.concat(F.lit("<table><tr><th>"), F.col("p_brand"), F.lit("</th><th>b</th></tr>"), rows, F.lit("</table>")))


@query(f"""SELECT p_partkey, (p_size % 4 + 1)::INT AS rows, 2::INT AS cols, contains(lower({_HTML}), '<th>') AS has_header,
    CASE WHEN p_size % 4 > 0 THEN 3 ELSE 2 END::INT AS full_cols,
    '| ' || p_brand || ' | b |' || CASE WHEN p_size % 4 > 0 THEN '  |' ELSE '' END AS first_line FROM part""")
def table_structure(spark, sf_dir):
    made = _tables(spark, sf_dir).withColumn("m", regions.table_metadata(F.col("html"))).withColumn("s", regions.table_structure(F.col("html")))
    line = F.substring_index(F.col("s.markdown"), "\n", 1)
    return made.select("p_partkey", "m.rows", "m.cols", "m.has_header", F.col("s.cols").alias("full_cols"), line.alias("first_line"))


@query(f"""SELECT p_partkey, unnest(generate_series(0, 5))::INT AS sequence, unnest(['table', 'image', 'equation', 'title', 'list', 'text']) AS region_type,
    unnest([{_HTML}, 'bar chart', 'x^2', p_name, '- one' || chr(10) || '- two', 'A paragraph of ' || p_type]) AS content,
    unnest([0, 0, 0, 1, 0, 0])::INT AS level FROM part""")
def markdown_regions(spark, sf_dir):
    text = F.concat(F.col("html"), F.lit("\n# "), F.col("p_name"), F.lit("\n- one\n- two\n\n<img>bar chart</img>\n$$x^2$$\n\nA paragraph of "), F.col("p_type"), F.lit("\n\n"))
    made = _tables(spark, sf_dir).select("p_partkey", F.posexplode(regions.markdown_regions(text)).alias("sequence", "r"))
    return made.select("p_partkey", "sequence", "r.*").na.fill(0, ["level"])


@query("""SELECT o_orderkey, CASE WHEN s > 50 THEN 'high' WHEN s > 10 THEN 'default' ELSE 'low' END AS queue,
    CASE WHEN s > 50 THEN 7200 ELSE 3600 END::INT AS timeout, s > 10 AND o_orderstatus = 'F' AS distributed
    FROM (SELECT *, o_totalprice / 5000 AS s FROM orders)""")
def job_routing(spark, sf_dir):
    size = F.col("o_totalprice") / 5000
    kind = F.when(F.col("o_orderstatus") == "F", ".PDF").otherwise(".txt")
    return table(spark, sf_dir, "orders").select(
        "o_orderkey", T.queue_of(size).alias("queue"), T.job_timeout(size).alias("timeout"), T.is_distributed(kind, size).alias("distributed")
    )


@query("""SELECT event_id, CASE WHEN v IS NULL THEN 0.5::DOUBLE ELSE greatest(0, least(1, v)) END AS relevance
    FROM (SELECT event_id, try_cast(split_part(x, ' ', 1) AS DOUBLE) AS v FROM (SELECT event_id, CASE event_id % 4 WHEN 0 THEN '0.25 good' WHEN 1 THEN '7' WHEN 2 THEN 'none' ELSE '-1 bad' END AS x FROM events))""")
def reply_relevance(spark, sf_dir):
    reply = F.element_at(F.array(*map(F.lit, ("0.25 good", "7", "none", "-1 bad"))), (F.col("event_id") % 4 + 1).cast("int"))
    return table(spark, sf_dir, "events").select("event_id", T.relevance(reply).alias("relevance"))


@query("""SELECT p_partkey, regexp_replace(trim(' a/../' || p_brand || '\\x '), '/|\\\\|\\.\\.', '_', 'g') AS collection,
    p_brand || '.pdf' AS file FROM part""")
def safe_names(spark, sf_dir):
    name = F.concat(F.lit(" a/../"), F.col("p_brand"), F.lit("\\x "))
    path = F.concat(F.lit("..\\up/"), F.col("p_brand"), F.lit("..\x01.pdf"))
    return table(spark, sf_dir, "part").select("p_partkey", T.safe_collection(name).alias("collection"), T.safe_file_name(path).alias("file"))


@query("""SELECT doc_id, (list_position(list_transform(list_zip(string_split(text, ''), string_split(reverse(text), '')), lambda z: z[1] <> z[2]), true) - 1)::INT AS first_difference
    FROM documents""")
def first_difference(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.first_difference(F.col("text"), F.reverse("text")).alias("first_difference"))


# ---- tasks, files, lessons


@query("""SELECT o_orderstatus AS status, count(*) AS n_tasks, count(*) FILTER (o_orderdate >= m - INTERVAL 24 HOURS) AS last_24h
    FROM orders, (SELECT max(o_orderdate) AS m FROM orders) GROUP BY o_orderstatus""")
def tasks_by_status(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderstatus").alias("status"), F.col("o_orderdate").alias("created_at"))
    latest = orders.agg(F.max("created_at")).first()[0]
    return tasks.status_counts(orders, F.lit(latest))


@query("""SELECT o_orderkey AS task_id, count(l_linenumber)::INT AS n_files, coalesce(string_agg(l_linenumber::VARCHAR, ',' ORDER BY l_linenumber), '') AS files
    FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_orderkey""")
def files_per_task(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("task_id"))
    files = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("task_id"), F.col("l_linenumber").alias("id"), "l_partkey")
    found = tasks.with_files(orders, files)
    names = F.transform(F.coalesce("files", F.array()), lambda f: f["id"].cast("string"))
    return found.select("task_id", F.size(names).alias("n_files"), F.array_join(names, ",").alias("files"))


@query("""SELECT o_orderkey AS task_id, o_orderstatus AS status FROM orders WHERE o_orderstatus = 'F' ORDER BY o_orderdate DESC, o_orderkey OFFSET 40 LIMIT 20""")
def tasks_page(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("task_id"), F.col("o_orderstatus").alias("status"), F.col("o_orderdate").alias("created_at"))
    return tasks.listed(orders, 20, 40, status="F").select("task_id", "status")


@query("""SELECT l_orderkey AS task_id, l_linenumber AS id FROM lineitem l WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_orderkey = l_orderkey AND o_orderstatus = 'F')""")
def cascade_delete(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("task_id"), "o_orderstatus")
    files = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("task_id"), F.col("l_linenumber").alias("id"))
    return tasks.cascade_delete(orders, files, orders.where("o_orderstatus = 'F'"))[1]


@query("""SELECT user_id AS task_id, arg_max(event_type, (ts, event_id)) AS status FROM events GROUP BY user_id""")
def task_states(spark, sf_dir):
    events = table(spark, sf_dir, "events").select(F.col("user_id").alias("task_id"), F.col("event_type").alias("status"), F.struct("ts", "event_id").alias("ts"))
    return tasks.latest_status(events).select("task_id", "status")


# ---- metrics


def _processing(spark, sf_dir):
    return table(spark, sf_dir, "events").withColumn("success", F.col("event_type") != "error").withColumnRenamed("value", "duration")


@query("""SELECT event_type, count(*) AS n, round(avg(value), 2) AS avg_duration, round(min(value), 2) AS min_duration, round(max(value), 2) AS max_duration
    FROM events WHERE event_type <> 'error' GROUP BY event_type""")
def perf_by_method(spark, sf_dir):
    return metrics.performance(_processing(spark, sf_dir), "event_type")


@query("""SELECT count(*) AS total, count(*) FILTER (event_type <> 'error') AS succeeded, count(*) FILTER (event_type = 'error') AS failed,
    round(count(*) FILTER (event_type <> 'error') * 100.0::DOUBLE / count(*), 2) AS success_rate,
    round(avg(value) FILTER (event_type <> 'error' AND value <> 0), 2) AS avg_duration FROM events""")
def perf_summary(spark, sf_dir):
    return metrics.summary(_processing(spark, sf_dir))


@query("""SELECT coalesce(kind, 'all') AS event_type, coalesce(day, 0) AS weekday, count(*) AS n, round(avg(value), 2) AS avg_duration
    FROM (SELECT value, event_type AS kind, dayofweek(ts) + 1 AS day FROM events) GROUP BY GROUPING SETS ((kind), (day))""")
def perf_grouping_sets(spark, sf_dir):
    events = _processing(spark, sf_dir).withColumn("weekday", F.dayofweek("ts").cast("long"))
    return metrics.performance_sets(events, "event_type", "weekday").na.fill({"event_type": "all", "weekday": 0})


@query("""SELECT count(*) FILTER (event_type <> 'error') AS processed, count(*) FILTER (event_type = 'error') AS failed,
    sum(trunc(value * 1048576)::BIGINT)::BIGINT AS bytes FROM events""")
def perf_counters(spark, sf_dir):
    return metrics.counters(_processing(spark, sf_dir), "duration")


@query("SELECT event_id, event_type FROM events ORDER BY ts DESC, event_id DESC LIMIT 20")
def recent_events(spark, sf_dir):
    return metrics.recent(table(spark, sf_dir, "events"), 20).select("event_id", "event_type")


@query("""SELECT event_type, event_id FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) AS back FROM events) WHERE back <= 50""")
def bounded_history(spark, sf_dir):
    return metrics.bounded_history(table(spark, sf_dir, "events"), 50, "event_type").select("event_type", "event_id")


@query("""
    WITH w AS (SELECT event_id, avg(value) OVER a AS recent_mean, avg(value) OVER b AS previous_mean, row_number() OVER c AS n FROM events
      WINDOW a AS (PARTITION BY event_type ORDER BY event_id ROWS BETWEEN 2 PRECEDING AND CURRENT ROW),
      b AS (PARTITION BY event_type ORDER BY event_id ROWS BETWEEN 5 PRECEDING AND 3 PRECEDING), c AS (PARTITION BY event_type ORDER BY event_id))
    SELECT event_id, round(recent_mean, 4) AS recent_mean, CASE WHEN n >= 6 AND recent_mean / nullif(previous_mean, 0) > 1.1 THEN 'up'
      WHEN n >= 6 AND recent_mean / nullif(previous_mean, 0) < 0.9 THEN 'down' ELSE 'same' END AS trend,
      CASE WHEN n >= 6 AND recent_mean / nullif(previous_mean, 0) > 1.1 THEN 40 WHEN n >= 6 AND recent_mean / nullif(previous_mean, 0) < 0.9 THEN 24 ELSE 32 END::INT AS next_size FROM w""")
def throughput_trend(spark, sf_dir):
    found = metrics.trend(table(spark, sf_dir, "events"), "event_type", "value", "event_id")
    return found.select("event_id", F.round("recent_mean", 4).alias("recent_mean"), "trend", metrics.next_batch_size(F.lit(32), F.col("trend")).alias("next_size"))


@query("""
    WITH s AS (SELECT event_id, user_id, epoch(ts) AS sec FROM events),
    g AS (SELECT *, CASE WHEN sec - lag(sec) OVER (PARTITION BY user_id ORDER BY sec, event_id) > 86400 THEN 1 ELSE 0 END AS starts FROM s)
    SELECT event_id, sum(starts) OVER (PARTITION BY user_id ORDER BY sec, event_id ROWS UNBOUNDED PRECEDING)::BIGINT AS gap_group FROM g""")
def gap_groups(spark, sf_dir):
    events = table(spark, sf_dir, "events").withColumn("at", F.unix_micros(F.col("ts").cast("timestamp")) / 1e6)
    return metrics.gap_groups(events, "user_id", "at", 86400, "event_id").select("event_id", "gap_group")


@query("""SELECT event_id, ((row_number() OVER (PARTITION BY event_type ORDER BY event_id) - 1) // 32)::INT AS batch_number FROM events""")
def fixed_batches(spark, sf_dir):
    return metrics.fixed_batches(table(spark, sf_dir, "events"), "event_type", "event_id", 32).select("event_id", "batch_number")


@query("""WITH a AS (SELECT event_type AS name, avg(value) AS seconds, count(*)::DOUBLE AS size FROM events GROUP BY event_type)
    SELECT arg_min(name, seconds) AS fastest, arg_max(name, size) AS most_content, arg_max(name, size / seconds) AS most_efficient FROM a""")
def mode_extremes(spark, sf_dir):
    modes = table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("name")).agg(F.avg("value").alias("seconds"), F.count(F.lit(1)).cast("double").alias("size"))
    return metrics.extremes(modes, "name", "seconds", "size")


@query("""WITH a AS (SELECT event_type AS name, avg(value) AS seconds FROM events GROUP BY event_type)
    SELECT name, round(seconds / (SELECT seconds FROM a WHERE name = 'view'), 6) AS ratio FROM a""")
def mode_ratios(spark, sf_dir):
    modes = table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("name")).agg(F.avg("value").alias("seconds"))
    return metrics.against_baseline(modes, "name", "view", "seconds").select("name", F.round("ratio", 6).alias("ratio"))


@query("""
    WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTES THEN 0 ELSE 1 END AS s FROM events),
    n AS (SELECT *, sum(s) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
    SELECT user_id, epoch_us(min(ts)) AS started, epoch_us(max(ts)) + 1800000000 AS ended, count(*) AS n_events FROM n GROUP BY user_id, k""")
def session_windows(spark, sf_dir):
    found = streams.session_windows(table(spark, sf_dir, "events"))
    return found.select("user_id", F.unix_micros("started").alias("started"), F.unix_micros("ended").alias("ended"), "n_events")


@query("""SELECT count(*) AS n, round(avg(value), 4) AS avg_seconds, round(avg(user_id), 4) AS avg_pages, round(avg(event_id % 7), 4) AS avg_regions,
    round(avg(event_id % 3), 4) AS avg_grounded, round(count(*) * 60 / sum(value), 4) AS docs_per_minute, round(sum(user_id) / sum(value), 4) AS pages_per_second FROM events""")
def benchmark_summary(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return metrics.benchmark_summary(e.select(F.col("value").alias("seconds"), F.col("user_id").alias("pages"), (F.col("event_id") % 7).alias("regions"), (F.col("event_id") % 3).alias("grounded")))


@query("""SELECT o_orderpriority AS queue, count(*) FILTER (o_orderstatus = 'O') AS queued, count(*) FILTER (o_orderstatus = 'P') AS started,
    count(*) FILTER (o_orderstatus = 'F') AS finished, 0::BIGINT AS failed FROM orders GROUP BY o_orderpriority""")
def queue_stats(spark, sf_dir):
    state = F.when(F.col("o_orderstatus") == "O", "queued").when(F.col("o_orderstatus") == "P", "started").otherwise("finished")
    return metrics.queue_stats(table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("queue"), state.alias("state")))


@query("""WITH w AS (SELECT user_id, event_id, count(*) OVER a AS done, count(*) OVER (PARTITION BY user_id) AS total, avg(value) OVER a AS pace FROM events
      WINDOW a AS (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING))
    SELECT event_id, done, round(done / total, 6) AS share, round(pace * (total - done), 8) AS eta FROM w""")
def task_progress(spark, sf_dir):
    found = metrics.progress(table(spark, sf_dir, "events"), "user_id", "event_id", "value")
    return found.select("event_id", "done", F.round("share", 6).alias("share"), F.round("eta", 8).alias("eta"))


@query("SELECT event_id, event_type FROM events ORDER BY value DESC, event_id LIMIT 5")
def slowest_events(spark, sf_dir):
    return metrics.slowest(table(spark, sf_dir, "events"), "value", 5, "event_id").select("event_id", "event_type")


# ---- ingestion


@query(f"""{_FIXED}, n AS (SELECT *, count(*) OVER (PARTITION BY doc_id) AS total_chunks FROM k)
    SELECT doc_id || '_chunk_' || chunk_index AS id, total_chunks, source, CASE WHEN chunk_index = 0 THEN 'title' ELSE 'text' END AS region_type, '0' AS page
    FROM n JOIN documents USING (doc_id)""")
def ingested_chunks(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    chunks = chunking.fixed_chunks(docs, 512, 64, keep=["source"])
    own = F.when(F.col("chunk_index") == 0, F.create_map(F.lit("region_type"), F.lit("title"))).otherwise(F.create_map().cast("map<string,string>"))
    found = ingest.chunk_metadata(chunks, F.create_map(F.lit("source"), "source", F.lit("region_type"), F.lit("text")), own)
    m = F.col("metadata")
    return found.select("id", "total_chunks", m["source"].alias("source"), m["region_type"].alias("region_type"), m["page"].alias("page"))


@query("""SELECT doc_id, doc_id || '_text' AS row_id, 'text' AS content_type FROM documents
    UNION ALL SELECT doc_id, doc_id || '_image', 'image' FROM documents WHERE lang = 'en'""")
def multimodal_index(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").withColumn("image_path", F.when(F.col("lang") == "en", F.col("source")))
    return ingest.multimodal_rows(docs, "doc_id").drop("content")


@query()
def encoded_documents(spark, sf_dir):
    return ingest.encoded(table(spark, sf_dir, "documents").select("doc_id", "text"), ingest.hash_encoder, "text").drop("text")


# ---- context


@query("""SELECT conv_id, turn FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS back FROM conversations) WHERE back <= 4""")
def last_turns(spark, sf_dir):
    return context.last_turns(table(spark, sf_dir, "conversations"), 2).select("conv_id", "turn")


@query("""SELECT conv_id, string_agg('<|im_start|>' || role || chr(10) || text || '<|im_end|>', chr(10) ORDER BY turn) || chr(10) || '<|im_start|>assistant' || chr(10) AS prompt
    FROM conversations WHERE role IN ('system', 'user', 'assistant') GROUP BY conv_id""")
def chat_prompts(spark, sf_dir):
    return context.chat_template(table(spark, sf_dir, "conversations"))


@query("""SELECT conv_id, count(*) AS message_count, count(*) FILTER (role = 'user') AS user_messages,
    sum(floor(len(list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> '')) * 1.3::DOUBLE))::BIGINT AS tokens FROM conversations GROUP BY conv_id""")
def session_counts(spark, sf_dir):
    return context.session_counts(table(spark, sf_dir, "conversations"))


@query(f"""{_BATCH},
    c AS (SELECT query_id, rank, '[' || rank || '] **Source**: ' || source || ' | **Relevance**: ' || printf('%.2f', greatest(0, 1 - round(distance, 6))) || chr(10) || text || chr(10) AS entry,
      '[' || rank || '] ' || source || ': ' || substr(text, 1, 200) || '...' AS line
      FROM r JOIN documents ON doc_id = r.vec_id WHERE rank <= 3)
    SELECT query_id, string_agg(entry, chr(10) ORDER BY rank) AS context, string_agg(line, chr(10) ORDER BY rank) AS sources FROM c GROUP BY query_id""")
def cited_context(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("vec_id"), "text", "source")
    hits = _batch(spark, sf_dir, 3).join(docs, "vec_id").withColumn("score", V.score(F.round("distance", 6)))
    entry = context.text_entry(F.col("rank"), F.col("source"), F.col("score"), F.col("text"))
    full = context.context(hits.withColumn("entry", entry))
    return full.join(context.numbered_sources(hits, text="text"), "query_id")


_BOX = "(l_discount / 2) AS x_min, (l_tax / 2) AS y_min, (0.5 + l_discount) AS x_max, (0.5 + l_tax) AS y_max"


@query(f"""
    WITH b AS (SELECT l_orderkey AS doc_id, l_linenumber AS n, {_BOX} FROM lineitem),
    p AS (SELECT a.doc_id, a.n AS first, b.n AS second, greatest(0, least(a.x_max, b.x_max) - greatest(a.x_min, b.x_min)) * greatest(0, least(a.y_max, b.y_max) - greatest(a.y_min, b.y_min)) AS inter,
      (a.x_max - a.x_min) * (a.y_max - a.y_min) + (b.x_max - b.x_min) * (b.y_max - b.y_min) AS total,
      a.x_min <= b.x_min AND a.y_min <= b.y_min AND a.x_max >= b.x_max AND a.y_max >= b.y_max AS contains
      FROM b a JOIN b ON a.doc_id = b.doc_id AND a.n < b.n)
    SELECT doc_id, first, second, round(inter / (total - inter), 6) AS iou, contains, inter > 0 AS overlaps FROM p""")
def box_pairs(spark, sf_dir):
    boxed = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("n"),
        V.box(F.col("l_discount") / 2, F.col("l_tax") / 2, 0.5 + F.col("l_discount"), 0.5 + F.col("l_tax")).alias("box"),
    )
    other = boxed.select("doc_id", F.col("n").alias("second"), F.col("box").alias("other"))
    pairs = boxed.where(V.box_valid(F.col("box"))).join(other, "doc_id").where("n < second")
    a, b = F.col("box"), F.col("other")
    return pairs.select("doc_id", F.col("n").alias("first"), "second", F.round(V.box_iou(a, b), 6).alias("iou"), V.box_contains(a, b).alias("contains"), V.box_overlaps(a, b).alias("overlaps"))


import siltstone.plans.records  # noqa: E402,F401  registers its queries with these
import siltstone.plans.stores  # noqa: E402,F401
import siltstone.plans.sources  # noqa: E402,F401
import siltstone.plans.composites  # noqa: E402,F401
