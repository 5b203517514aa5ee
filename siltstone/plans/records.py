"""Queries on records, formats and reports, with their DuckDB twins; registered with the catalogue's."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from siltstone.functions import text as T
from siltstone.functions import vectors as V
from siltstone.operators import context, ingest, lessons, metrics, records, regions, search, tasks
from siltstone.plans.catalogue import _BATCH, _BOX, _batch, _lesson, _multivectors, query, table

_NOW = "TIMESTAMP '1995-06-01 00:00:00'"


def _now():
    return F.expr(_NOW)


# ---- tasks, files, lessons, sessions


def _requests(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").where("l_linenumber > 1")
    files = lines.groupBy(F.col("l_orderkey").alias("task_id")).agg(F.sort_array(F.collect_list(F.struct(
        F.concat(F.lit("f"), F.col("l_linenumber").cast("string")).alias("name"), F.when(F.col("l_returnflag") == "R", "failed").alias("status"),
        F.when(F.col("l_linenumber") > 3, F.col("l_partkey")).alias("size"), F.col("l_suppkey").alias("s"), F.col("l_extendedprice").alias("p"),
    ))).alias("files"))
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("task_id"), F.col("o_orderpriority").alias("collection_name")).join(files, "task_id", "left")


@query("""SELECT o_orderkey AS task_id, o_orderpriority AS collection_name, 'queued' AS status,
    (SELECT count(*) FROM lineitem WHERE l_orderkey = o_orderkey AND l_linenumber > 1)::INT AS total_files FROM orders""")
def created_tasks(spark, sf_dir):
    return records.created_tasks(_requests(spark, sf_dir), _now())[0].drop("created_at")


@query("""SELECT task_id, filename, status, count(*) AS n, sum(size)::BIGINT AS bytes FROM (SELECT l_orderkey AS task_id, 'f' || l_linenumber AS filename,
    CASE WHEN l_returnflag = 'R' THEN 'failed' ELSE 'pending' END AS status, CASE WHEN l_linenumber > 3 THEN l_partkey ELSE 0 END AS size
    FROM lineitem WHERE l_linenumber > 1) GROUP BY ALL""")
def created_files(spark, sf_dir):
    made = records.created_tasks(_requests(spark, sf_dir), _now())[1]
    return made.groupBy("task_id", "filename", "status").agg(F.count(F.lit(1)).alias("n"), F.sum("size").cast("long").alias("bytes"))


@query("""SELECT l_orderkey AS task_id, 'f' || l_linenumber AS filename, CASE WHEN l_linenumber = 2 AND l_orderkey % 3 = 0 THEN CASE WHEN l_orderkey % 2 = 0 THEN 'completed' ELSE 'failed' END ELSE 'pending' END AS status,
    CASE WHEN l_linenumber = 2 AND l_orderkey % 3 = 0 AND l_orderkey % 2 = 1 THEN 'broken' END AS error, l_linenumber = 2 AND l_orderkey % 3 = 0 AS touched FROM lineitem""")
def file_status_update(spark, sf_dir):
    """Every changed file has two changes; the later one counts."""
    files = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("task_id"), F.concat(F.lit("f"), F.col("l_linenumber").cast("string")).alias("filename"), F.lit("pending").alias("status"),
        F.lit(None).cast("string").alias("error"), F.lit(None).cast("timestamp").alias("updated_at"),
    )
    hit = table(spark, sf_dir, "orders").where("o_orderkey % 3 = 0").select(F.col("o_orderkey").alias("task_id"), F.lit("f2").alias("filename"))
    failed = hit.select("*", F.lit("failed").alias("status"), F.lit("broken").alias("error"), (F.col("task_id") % 2).alias("at"))
    done = hit.select("*", F.lit("completed").alias("status"), F.lit(None).cast("string").alias("error"), (1 - F.col("task_id") % 2).alias("at"))
    made = records.updated_files(files, failed.unionByName(done), _now(), at="at")
    return made.select("task_id", "filename", "status", "error", F.col("updated_at").isNotNull().alias("touched"))


@query(f"""SELECT o_orderstatus AS status, count(*) AS n_tasks, any_value(t.n) AS total_tasks, any_value(t.a) AS active_last_24h, any_value(f.n) AS total_files
    FROM orders, (SELECT count(*) AS n, count(*) FILTER (o_orderdate > {_NOW} - INTERVAL 24 HOURS) AS a FROM orders) t, (SELECT count(*) AS n FROM lineitem) f GROUP BY o_orderstatus""")
def store_statistics(spark, sf_dir):
    made = table(spark, sf_dir, "orders").select(F.col("o_orderstatus").alias("status"), F.col("o_orderdate").cast("timestamp").alias("updated_at"))
    return records.store_statistics(made, table(spark, sf_dir, "lineitem"), _now())


@query("""SELECT o_orderkey AS task_id, coalesce((SELECT string_agg(l_linenumber::VARCHAR, ',' ORDER BY l_linenumber) FROM lineitem WHERE l_orderkey = o_orderkey), '') AS files
    FROM orders WHERE o_orderstatus <> 'F'""")
def restored_tasks(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("task_id"), F.col("o_orderstatus").alias("status"))
    files = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("task_id"), F.col("l_linenumber").alias("id"))
    made = records.restored(orders, files, ("F",))
    return made.select("task_id", F.coalesce(F.array_join(F.transform("files", lambda f: f["id"].cast("string")), ","), F.lit("")).alias("files"))


_LESSONS = "o_orderkey AS lesson_id, o_orderdate AS created_at, (o_custkey % 5)::VARCHAR AS grade, o_orderpriority AS subject, o_orderstatus = 'P' AS is_archived, o_custkey % 2 = 0 AS is_favorite"


@query(f"SELECT lesson_id FROM (SELECT {_LESSONS} FROM orders) WHERE NOT is_archived AND grade = '2' AND is_favorite ORDER BY created_at DESC, lesson_id OFFSET 5 LIMIT 20")
def lesson_list(spark, sf_dir):
    made = table(spark, sf_dir, "orders").selectExpr(*[x.strip().replace("::VARCHAR", "") for x in _LESSONS.split(", ")]).withColumn("grade", F.col("grade").cast("string"))
    return records.lesson_list(made, 20, 5, grade="2", favorites_only=True).select("lesson_id")


@query("SELECT o_orderkey AS lesson_id, CASE WHEN o_orderkey = 7 THEN o_custkey % 2 <> 0 ELSE o_custkey % 2 = 0 END AS is_favorite FROM orders")
def toggled_lesson(spark, sf_dir):
    made = table(spark, sf_dir, "orders").selectExpr("o_orderkey AS lesson_id", "o_custkey % 2 = 0 AS is_favorite")
    return tasks.toggled(made, "lesson_id", 7)


@query(f"SELECT o_orderkey AS task_id FROM orders WHERE o_orderstatus = 'F' AND o_orderdate < {_NOW} - INTERVAL 30 DAYS")
def stale_tasks(spark, sf_dir):
    made = table(spark, sf_dir, "orders").selectExpr("o_orderkey AS task_id", "CASE o_orderstatus WHEN 'F' THEN 'completed' ELSE 'queued' END AS status", "CAST(o_orderdate AS TIMESTAMP) AS updated_at")
    return tasks.stale(made, _now(), 30).select("task_id")


@query(f"""SELECT conv_id AS session_id, CASE WHEN conv_id % 5 = 0 THEN 'new' ELSE 'old' END AS collection_name, conv_id % 5 = 0 AS fresh, conv_id % 5 = 0 OR conv_id % 3 = 0 AS touched
    FROM (SELECT DISTINCT conv_id FROM conversations) WHERE conv_id % 7 <> 0""")
def sessions_after(spark, sf_dir):
    """Created ids come once for each turn of a conversation, the last turn's collection counts."""
    turns = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("session_id"), "turn")
    ids = turns.select("session_id").distinct()
    last = F.max("turn").over(Window.partitionBy("session_id")) == F.col("turn")
    created = turns.where("session_id % 5 = 0").select("session_id", "turn", F.when(last, "new").otherwise("stale").alias("collection_name"))
    before = F.expr(f"{_NOW} - INTERVAL 1 HOUR")
    old = ids.where("session_id % 2 = 0 OR session_id % 5 <> 0").select("session_id", F.lit("old").alias("collection_name"), before.alias("created_at"), before.alias("last_accessed"))
    made = records.sessions_after(old, created, ids.where("session_id % 3 = 0"), ids.where("session_id % 7 = 0"), _now(), at="turn")
    return made.select("session_id", "collection_name", (F.col("created_at") == _now()).alias("fresh"), (F.col("last_accessed") == _now()).alias("touched"))


@query(f"SELECT o_orderkey, date_diff('second', o_orderdate::TIMESTAMP, {_NOW}) > 1800 AS expired, coalesce(o_orderdate < {_NOW} - INTERVAL 7 DAYS, false) AND o_custkey % 2 = 0 AS checkpoint_expired FROM orders")
def expiries(spark, sf_dir):
    at = F.col("o_orderdate").cast("timestamp")
    text = F.when(F.col("o_custkey") % 2 == 0, F.date_format(at, "yyyy-MM-dd HH:mm:ss")).otherwise("no time")
    return table(spark, sf_dir, "orders").select("o_orderkey", context.expired(at, _now()).alias("expired"), tasks.checkpoint_expired(text, _now(), 7).alias("checkpoint_expired"))


@query("SELECT user_id, arg_max(event_type, event_id) AS event_type FROM events WHERE event_type <> 'error' AND user_id IS NOT NULL GROUP BY user_id")
def image_references(spark, sf_dir):
    return records.image_references(table(spark, sf_dir, "events").withColumn("event_type", F.when(F.col("event_type") != "error", F.col("event_type"))), "user_id", "event_id", "event_type")


# ---- regions


_KIND = "CASE l_linenumber % 5 WHEN 0 THEN 'text' WHEN 1 THEN 'image' WHEN 2 THEN 'table' WHEN 3 THEN 'equation' ELSE 'list' END"


def _lines(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("region_sequence"), F.expr(_KIND).alias("region_type"),
        F.when(F.col("l_linenumber") != 6, F.col("l_linestatus")).alias("content"), (F.col("l_linenumber") / 3).cast("int").alias("page_number"),
        F.when(F.col("l_returnflag") == "R", "pic.png").alias("image_path"), F.lit(None).cast("string").alias("image_type"),
        F.when(F.col("l_returnflag") == "A", "<table></table>").alias("table_html"), F.when(F.col("l_returnflag") == "N", "inline").alias("equation_type"),
    )


@query(f"""WITH r AS (SELECT l_orderkey AS doc_id, l_linenumber AS n, {_KIND} AS t, CASE WHEN l_linenumber <> 6 THEN l_linestatus END AS c, l_returnflag AS f FROM lineitem),
    u AS (SELECT doc_id, n, 'text' AS modality, c AS document FROM r WHERE t IN ('text', 'list')
    UNION ALL SELECT doc_id, n, 'image_description', '[Image: image] ' || c FROM r WHERE t = 'image'
    UNION ALL SELECT doc_id, n, 'image', 'pic.png' FROM r WHERE t = 'image' AND f = 'R'
    UNION ALL SELECT doc_id, n, 'table', CASE WHEN f = 'A' THEN '<table></table>' ELSE c END FROM r WHERE t = 'table'
    UNION ALL SELECT doc_id, n, 'equation', '[Equation: ' || CASE WHEN f = 'N' THEN 'inline' ELSE 'display' END || '] ' || c FROM r WHERE t = 'equation')
    SELECT doc_id, n AS region_sequence, modality, document, count(*) AS n FROM u GROUP BY ALL""")
def region_fan_out(spark, sf_dir):
    found = regions.fan_out(_lines(spark, sf_dir).withColumn("image_type", F.lit("image")))
    return found.groupBy("doc_id", "region_sequence", "modality", "document").agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT l_orderkey AS doc_id, trunc(l_linenumber / 3)::INT AS page_number,
    coalesce(string_agg(l_linestatus, chr(10) || chr(10) ORDER BY l_linenumber, l_linestatus) FILTER (l_linenumber <> 6), '') AS content FROM lineitem GROUP BY ALL""")
def page_text(spark, sf_dir):
    return regions.page_text(_lines(spark, sf_dir), "doc_id", "page_number")


@query("""SELECT p_partkey, unnest([1, 2])::INT AS i, unnest([0.1, 0.0])::DOUBLE AS x_min, unnest([(p_size % 5) / 10 + 0.2, 1.0])::DOUBLE AS x_max, unnest([0.9, 1.0])::DOUBLE AS y_max FROM part""")
def bbox_parse(spark, sf_dir):
    text = F.concat(
        F.lit("a <bbox>0.1, 0.2,"), ((F.col("p_size") % 5) / 10 + 0.2).cast("string"), F.lit(",0.9</bbox> <bbox>0.5,0.2,0.4,0.9</bbox><bbox>1,2</bbox><bbox>x,0,1,1</bbox>\n<bbox>0,0,1,1</bbox> <bbox>0,0,1.2,1</bbox>")
    )
    found = table(spark, sf_dir, "part").select("p_partkey", F.posexplode(regions.boxes(text)).alias("i", "b"))
    return found.select("p_partkey", (F.col("i") + 1).alias("i"), "b.x_min", "b.x_max", "b.y_max")


@query("""SELECT p_partkey, unnest(['d' || p_partkey || '_3_0', 'd' || p_partkey || '_3_1']) AS region_id, unnest([0, 1])::INT AS region_sequence, unnest(['title', 'text']) AS region_type,
    unnest([p_brand, p_name]) AS content, unnest([0.1::DOUBLE, NULL]) AS x_min FROM part""")
def assembled_regions(spark, sf_dir):
    text = F.concat(F.lit("<bbox>0.1,0.2,0.5,0.9</bbox><bbox>0.9,0.2,0.5,0.9</bbox>\n# "), F.col("p_brand"), F.lit("\n\n"), F.col("p_name"))
    found = table(spark, sf_dir, "part").select("p_partkey", F.explode(regions.assembled(F.concat(F.lit("d"), F.col("p_partkey")), F.lit(3), text)).alias("r"))
    return found.select("p_partkey", "r.region_id", "r.region_sequence", "r.region_type", "r.content", "r.bbox.x_min")


@query(f"""WITH b AS (SELECT l_orderkey AS doc_id, l_linenumber, {_KIND} AS t, {_BOX} FROM lineitem), c AS (SELECT *, (y_min + y_max) / 2 AS y FROM b)
    SELECT doc_id, count(*) FILTER (t = 'image') AS images, count(*) FILTER (y < 0.33) AS top, count(*) FILTER (y >= 0.33 AND y < 0.67) AS middle, count(*) FILTER (y >= 0.67) AS bottom,
    count(*) FILTER (l_linenumber % 2 = 0) AS grounded FROM (SELECT * REPLACE (CASE WHEN l_linenumber % 2 = 0 THEN y END AS y) FROM c) GROUP BY doc_id""")
def layout_summary(spark, sf_dir):
    box = V.box(F.col("l_discount") / 2, F.col("l_tax") / 2, 0.5 + F.col("l_discount"), 0.5 + F.col("l_tax"))
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.expr(_KIND).alias("region_type"), F.when(F.col("l_linenumber") % 2 == 0, box).alias("bbox"))
    return regions.layout_summary(rows, "doc_id").select("doc_id", F.col("image").alias("images"), "top", "middle", "bottom", "grounded")


@query("""SELECT doc_id, 'doc_1_0' AS region_id, 'text' AS region_type, md5(coalesce(text, '')) AS content, doc_id AS page_number, 0 AS region_sequence, doc_id % 2 = 0 AS has_empty,
    false AS has_box FROM documents""")
def region_codec(spark, sf_dir):
    region = F.struct(
        F.lit("doc_1_0").alias("region_id"), F.lit("text").alias("region_type"), F.lit(0).alias("region_sequence"), F.coalesce("text", F.lit("")).alias("content"),
        F.col("doc_id").alias("page_number"), F.lit(None).cast("string").alias("bbox"), F.when(F.col("doc_id") % 2 == 0, "").alias("caption"),
    )
    coded = table(spark, sf_dir, "documents").select("doc_id", records.region_json(region).alias("json"))
    back = records.region_of(F.col("json"), "region_id string, region_type string, region_sequence int, content string, page_number long, caption string")
    return coded.withColumn("b", back).select(
        "doc_id", "b.region_id", "b.region_type", F.md5("b.content").alias("content"), "b.page_number", "b.region_sequence",
        F.col("json").contains('"caption":""').alias("has_empty"), F.col("json").contains('"bbox":').alias("has_box"),
    )


@query("SELECT page_id AS doc_id, page_id || '_' || (page_id % 9) || '_0' AS region_id, 'text' AS region_type, 0 AS region_sequence, (page_id % 9)::INT AS page_number, md5(coalesce(url, '')) AS content FROM pages")
def offline_regions(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").selectExpr("page_id AS doc_id", "CAST(page_id % 9 AS INT) AS page_number", "url AS content")
    made = records.offline_regions(pages)
    return made.select(F.split("region_id", "_")[0].cast("long").alias("doc_id"), "region_id", "region_type", "region_sequence", "page_number", F.md5("content").alias("content"))


# ---- lessons and prompts


@query("""SELECT o_orderkey, 'Lesson ' || o_orderkey AS title, 'Goals' AS first_title, 2::INT AS second_level, '1' AS cited, true AS has_raw FROM orders""")
def lesson_json(spark, sf_dir):
    j = F.col("j")
    return _lesson(spark, sf_dir).select("o_orderkey", lessons.as_json(F.col("text")).alias("j")).select(
        "o_orderkey", F.get_json_object(j, "$.metadata.title").alias("title"), F.get_json_object(j, "$.sections[0].title").alias("first_title"),
        F.get_json_object(j, "$.sections[1].level").cast("int").alias("second_level"), F.get_json_object(j, "$.citations[0]").alias("cited"),
        F.get_json_object(j, "$.raw_markdown").startswith("---").alias("has_raw"),
    )


@query("""SELECT o_orderkey, '---' || chr(10) || 'grade: ' || (o_orderkey % 12) || chr(10) || 'title: T' || o_orderkey || chr(10) || '---' || chr(10) || chr(10) || '# Goals' || chr(10) || chr(10) || 'x' ||
    chr(10) || chr(10) || '## ' || o_orderpriority || chr(10) || chr(10) || 'y' AS markdown FROM orders""")
def lesson_markdown(spark, sf_dir):
    meta = F.create_map(F.lit("title"), F.concat(F.lit("T"), F.col("o_orderkey")), F.lit("grade"), (F.col("o_orderkey") % 12).cast("string"))
    parts = F.array(*[F.struct(F.lit(n).alias("level"), t.alias("title"), F.lit(c).alias("content")) for n, t, c in ((1, F.lit("Goals"), "x"), (2, F.col("o_orderpriority"), "y"))])
    return table(spark, sf_dir, "orders").select("o_orderkey", lessons.as_markdown(meta, parts).alias("markdown"))


@query("""SELECT o_orderkey, 'Lesson ' || o_orderkey AS title, 'HEAD' || chr(10) || 'before' || chr(10) || '# Goals' || chr(10) || 'know [1] it' || chr(10) || chr(10) || 'more' || chr(10) || '## ' || o_orderpriority ||
    chr(10) || 'x' || chr(10) || '#### deep' || chr(10) || '### Last' AS markdown FROM orders""")
def assembled_lessons(spark, sf_dir):
    made = _lesson(spark, sf_dir).select("o_orderkey", lessons.assembled_lesson(F.col("text"), F.lit("topic"), F.lit("HEAD")).alias("l"))
    return made.select("o_orderkey", "l.title", "l.markdown")


@query("""SELECT p_partkey, unnest(['Image', p_brand])  AS alt_text, unnest(['a b.png', 'x/' || p_partkey || '.png']) AS path, unnest([NULL, 'Figure 3']) AS figure, unnest([1, p_size % 5])::INT AS source FROM part""")
def lesson_images(spark, sf_dir):
    text = F.concat(F.lit("t ![](a b.png)\n![no](\n!["), F.col("p_brand"), F.lit("](x/"), F.col("p_partkey"), F.lit(".png) *Figure 3: see [IMG-"), (F.col("p_size") % 5).cast("string"), F.lit("]*"))
    return table(spark, sf_dir, "part").select("p_partkey", F.explode(lessons.images(text)).alias("i")).select("p_partkey", "i.*")


@query("""SELECT o_orderkey, 'Topic: t' || chr(10) || 'Grade: ' || (o_orderkey % 12) || chr(10) || 'Subject: ' || o_orderpriority || chr(10) || 'Duration: 45 minutes' || chr(10) || chr(10) || 'Sources:' || chr(10) ||
    '[1] short' || chr(10) || '[2] ' || repeat('x', 500) || '...' AS prompt FROM orders""")
def lesson_prompts(spark, sf_dir):
    made = lessons.lesson_prompt(F.lit("t"), (F.col("o_orderkey") % 12).cast("string"), F.col("o_orderpriority"), F.lit(45), F.array(F.lit("short"), F.repeat(F.lit("x"), F.lit(501))))
    return table(spark, sf_dir, "orders").select("o_orderkey", made.alias("prompt"))


@query("""SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN '3' END AS edu_grade, CASE WHEN p_size % 3 = 0 THEN 'Science' END AS edu_subject,
    CASE WHEN p_size % 2 = 0 OR p_size % 3 = 0 THEN 'educational' ELSE 'old' END AS edu_content_type, 'kept' AS other FROM part""")
def enriched_metadata(spark, sf_dir):
    meta = F.create_map(F.lit("other"), F.lit("kept"), F.lit("edu_content_type"), F.lit("old"))
    made = lessons.enriched(meta, F.when(F.col("p_size") % 2 == 0, "3"), F.when(F.col("p_size") % 3 == 0, "Science"))
    return table(spark, sf_dir, "part").select("p_partkey", made.alias("m")).select("p_partkey", *[F.try_element_at("m", F.lit(k)).alias(k) for k in ("edu_grade", "edu_subject", "edu_content_type", "other")])


@query(f"""{_BATCH} SELECT query_id, '[' || rank || ']' AS mark, source, round(greatest(0, 1 - distance), 6) AS score FROM r JOIN documents ON doc_id = vec_id WHERE rank <= 3""")
def citation_sources(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("vec_id"), "source")
    hits = _batch(spark, sf_dir, 3).join(docs, "vec_id").withColumn("score", F.round(V.score(F.col("distance")), 6))
    return context.citation_map(hits).select("query_id", F.explode("citations").alias("mark", "v")).select("query_id", "mark", "v.source", "v.score")


@query("""SELECT p_partkey, '[' || (p_size % 9) || '] ' || p_name || CASE WHEN p_size % 3 = 1 THEN ', pages 4-5' WHEN p_size % 4 <> 0 THEN ', slide ' || (p_size % 4) ELSE '' END AS label FROM part""")
def citation_labels(spark, sf_dir):
    pages = F.when(F.col("p_size") % 3 == 0, "0").when(F.col("p_size") % 3 == 1, "4-5")
    return table(spark, sf_dir, "part").select("p_partkey", T.citation_label(F.col("p_size") % 9, F.col("p_name"), pages, (F.col("p_size") % 4).cast("int")).alias("label"))


@query("""SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN '[IMG-' ELSE '[' END || '2] ' || p_name || CASE WHEN p_size % 3 > 0 THEN CASE WHEN p_size % 2 = 0 THEN ', page ' ELSE ', pages ' END || (p_size % 3)
    WHEN p_size % 4 > 0 THEN ', slide ' || (p_size % 4) ELSE '' END || chr(10) || CASE WHEN p_size % 2 = 0 THEN '    Description: ' || p_type ELSE '    Content: ' || substr(p_type, 1, 200) || '...' END || chr(10) AS line FROM part""")
def numbered_materials(spark, sf_dir):
    made = records.source_lines(F.col("p_name"), (F.col("p_size") % 3).cast("int"), (F.col("p_size") % 4).cast("int"), F.col("p_type"), F.lit(2), F.col("p_size") % 2 == 0)
    return table(spark, sf_dir, "part").select("p_partkey", made.alias("line"))


@query("""SELECT p_partkey, '[IMG-1] **File**: ' || p_name || ' | **Description**: ' || CASE WHEN p_size % 2 = 0 THEN p_type ELSE 'Image from ' || p_name END || ' | **Relevance**: 0.50' || chr(10) ||
    '*Dimensions*: ' || p_size || 'x0 | *Format*: unknown' || chr(10) AS entry,
    CASE WHEN p_size % 3 = 0 THEN 'No relevant context found.' WHEN p_size % 3 = 1 THEN '**Text Sources:**' || chr(10) || chr(10) || p_name
    ELSE '**Text Sources:**' || chr(10) || chr(10) || p_name || chr(10) || '---' || chr(10) || chr(10) || '**Image Sources:**' || chr(10) || chr(10) || p_type END AS context FROM part""")
def image_context(spark, sf_dir):
    size = F.col("p_size").cast("int")
    entry = context.image_entry(F.lit(1), F.col("p_name"), F.when(size % 2 == 0, F.col("p_type")), size, F.lit(None).cast("int"), F.lit(None).cast("string"), F.lit(0.5))
    both = context.multimodal(F.when(size % 3 > 0, F.col("p_name")), F.when(size % 3 == 2, F.col("p_type")).otherwise(""))
    return table(spark, sf_dir, "part").select("p_partkey", entry.alias("entry"), both.alias("context"))


@query("""SELECT p_partkey, 'base' || CASE WHEN p_size % 2 = 0 THEN chr(10) || chr(10) || 'Additional Instructions:' || chr(10) || p_name ELSE '' END ||
    CASE WHEN p_size % 3 = 0 THEN chr(10) || chr(10) || 'Context:' || chr(10) || p_type ELSE '' END AS prompt,
    '![' || p_brand || '](' || p_name || ')' || CASE WHEN p_size % 2 = 0 THEN chr(10) || '*cap*' ELSE '' END AS image FROM part""")
def system_prompts(spark, sf_dir):
    size = F.col("p_size")
    prompt = context.system_prompt(F.lit("base"), F.when(size % 2 == 0, F.col("p_name")), F.when(size % 3 == 0, F.col("p_type")).otherwise(""))
    image = T.image_markdown(F.col("p_brand"), F.col("p_name"), F.when(size % 2 == 0, "cap"))
    return table(spark, sf_dir, "part").select("p_partkey", prompt.alias("prompt"), image.alias("image"))


# ---- scalar functions


@query("""SELECT p_partkey, lower(p_brand) = lower(p_type) OR p_size % 2 = 0 AS same_subject, trim(p_type) AS description, p_type <> '' AS has_description, (p_size % 7) || '/' || p_size AS progress,
    CASE WHEN p_size * 2 > 95 THEN 'critical' WHEN p_size * 2 > 90 THEN 'high' ELSE 'normal' END AS pressure FROM part""")
def scalar_texts(spark, sf_dir):
    size = F.col("p_size")
    subject = T.subject_match(F.when(size % 2 == 0, F.upper("p_type")).otherwise(F.col("p_brand")), F.col("p_type"))
    tag = T.image_tag(F.concat(F.lit("a <IMG> "), F.col("p_type"), F.lit(" </img> <img>b</img>")))
    return table(spark, sf_dir, "part").select(
        "p_partkey", subject.alias("same_subject"), tag["description"].alias("description"), tag["has_description"].alias("has_description"),
        T.progress(size % 7, size).alias("progress"), T.memory_pressure(size * 2).alias("pressure"),
    )


@query("""SELECT p_partkey, (CASE WHEN p_size * 100.0 * p_partkey > 40000 THEN floor(p_size * 100 * sqrt(40000 / (p_size * 100.0 * p_partkey))) ELSE p_size * 100 END)::INT AS width,
    (CASE WHEN p_size * 100.0 * p_partkey > 40000 THEN floor(p_partkey * sqrt(40000 / (p_size * 100.0 * p_partkey))) ELSE p_partkey END)::INT AS height,
    least(p_size * 100, p_partkey) >= 10 AND p_size * 100 * p_partkey <= 160000 AS valid FROM part""")
def image_sizes(spark, sf_dir):
    w, h = (F.col("p_size") * 100).cast("int"), F.col("p_partkey").cast("int")
    made = T.resized(w, h, 40000)
    return table(spark, sf_dir, "part").select("p_partkey", made["width"].alias("width"), made["height"].alias("height"), T.image_valid(w, h, 40000).alias("valid"))


@query("""SELECT p_partkey, 'http://h/' || replace(p_brand, '#', '%23') || '/' || replace(p_name, ' ', '%20') || '/a%2Bb' AS url, substr(sha256(p_name), 1, 16) AS name,
    CASE WHEN p_size % 2 = 0 THEN 'a,b' ELSE '' END AS tags FROM part""")
def safe_urls(spark, sf_dir):
    url = T.image_url(F.lit("http://h"), F.col("p_brand"), F.concat(F.col("p_name"), F.lit("/a+b")))
    tags = T.json_or_empty(F.when(F.col("p_size") % 2 == 0, '["a","b"]').otherwise("{no"), "string")
    return table(spark, sf_dir, "part").select("p_partkey", url.alias("url"), T.content_name(F.col("p_name").cast("binary")).alias("name"), F.array_join(tags, ",").alias("tags"))


@query("SELECT doc_id, md5(coalesce(text, '') || octet_length(encode(coalesce(text, '')))) AS digest FROM documents")
def partial_hashes(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.partial_hash(F.coalesce("text", F.lit("")).cast("binary")).alias("digest"))


# ---- vectors


@query("""SELECT vec_id, 344::INT AS length, round(list_sum(embedding::DOUBLE[]), 4) AS total, round(list_sum(embedding::FLOAT[]::DOUBLE[]), 4) AS cast_total FROM embeddings""")
def vector_codecs(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").withColumn("b", V.to_base64("embedding"))
    total = lambda c: F.round(F.aggregate(c, F.lit(0.0), lambda a, x: a + x), 4)
    return e.withColumn("back", V.from_base64("b")).select("vec_id", F.length("b").alias("length"), total(F.col("back")).alias("total"), total(V.to_float32(F.col("embedding"))).alias("cast_total"))


@query("""WITH t AS (SELECT vec_id // 4 AS doc, vec_id, embedding::DOUBLE[] AS v FROM embeddings)
    SELECT doc, count(*)::INT AS n, 128::INT AS dimension, round(sum(v[1]) FILTER (vec_id % 2 = 0) / count(*) FILTER (vec_id % 2 = 0), 6) AS masked_first FROM t GROUP BY doc HAVING count(*) FILTER (vec_id % 2 = 0) > 0""")
def multivectors(spark, sf_dir):
    docs = _multivectors(spark, sf_dir).where(F.size("tokens") > 0)
    mask = F.transform("tokens", lambda _, i: F.when(i % 2 == 0, 1.0).otherwise(0.0))
    both = V.concat_tokens(F.col("tokens"), F.col("tokens"))
    return docs.select("doc", F.size(both).alias("n"), F.size(both[0]).alias("dimension"), F.round(V.masked_mean(F.col("tokens"), mask)[0], 6).alias("masked_first"))


@query(f"""WITH b AS (SELECT l_orderkey, l_linenumber, {_BOX} FROM lineitem)
    SELECT l_orderkey, l_linenumber, round(x_max - x_min, 6) AS width, round(y_max - y_min, 6) AS height, round((x_max - x_min) * (y_max - y_min), 6) AS area, round((x_min + x_max) / 2, 6) AS center_x,
    round((y_min + y_max) / 2, 6) AS center_y FROM b""")
def box_measures(spark, sf_dir):
    box = V.box(F.col("l_discount") / 2, F.col("l_tax") / 2, 0.5 + F.col("l_discount"), 0.5 + F.col("l_tax"))
    b = F.col("b")
    r = lambda c, n: F.round(c, 6).alias(n)
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", box.alias("b")).select(
        "l_orderkey", "l_linenumber", r(V.box_width(b), "width"), r(V.box_height(b), "height"), r(V.box_area(b), "area"), r(V.box_center(b)["x"], "center_x"), r(V.box_center(b)["y"], "center_y")
    )


@query(f"""WITH t AS (SELECT vec_id // 4 AS doc, vec_id, embedding::DOUBLE[] AS v FROM embeddings),
    m AS (SELECT doc, list(x ORDER BY i) AS v FROM (SELECT doc, i, avg(x) AS x FROM (SELECT doc, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM t) GROUP BY ALL) GROUP BY doc),
    f AS (SELECT q.doc AS query_id, m.doc, round(1 - list_cosine_similarity(m.v, q.v), 12) AS distance, row_number() OVER (PARTITION BY q.doc ORDER BY round(1 - list_cosine_similarity(m.v, q.v), 12), m.doc) AS o
      FROM m, m q WHERE q.doc % 25 = 0),
    s AS (SELECT f.query_id, f.doc, f.distance, q.vec_id, max(list_inner_product(q.v, t.v)) AS best FROM f JOIN t USING (doc) JOIN t q ON q.doc = f.query_id WHERE o <= 20 GROUP BY ALL),
    g AS (SELECT query_id, doc, distance, avg(best) AS max_sim FROM s GROUP BY ALL),
    r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(max_sim, 12) DESC, distance, doc) AS rank FROM g)
    SELECT query_id, doc, round(max_sim, 6) AS max_sim, rank::INT AS rank FROM r WHERE rank <= 5""")
def batch_two_stage(spark, sf_dir):
    docs = _multivectors(spark, sf_dir)
    queries = docs.where("doc % 25 = 0").select(F.col("doc").alias("query_id"), F.col("tokens").alias("query_tokens"))
    return records.batch_two_stage(docs, queries, 20, 5, "doc").select("query_id", "doc", F.round("max_sim", 6).alias("max_sim"), "rank")


# ---- results


@query("SELECT doc_id, round(abs(length(text) - 3) / (length(text) + 3.0), 6) AS score FROM documents WHERE text IS NOT NULL")
def pair_scores(spark, sf_dir):
    def load():
        return lambda pairs: [abs(len(b) - len(a)) / (len(b) + len(a)) for a, b in pairs]

    docs = table(spark, sf_dir, "documents").where("text IS NOT NULL").select("doc_id", "text")
    return ingest.scored(docs, load, F.lit("abc"), "text").select("doc_id", F.round("rerank_score", 6).alias("score"))


@query("SELECT vec_id, label FROM embeddings ORDER BY CASE WHEN label % 3 = 0 THEN 1.0 ELSE label / 4.0 END, vec_id LIMIT 30")
def cross_modal_rerank(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").withColumn("cross_modal_score", F.when(F.col("label") % 3 != 0, F.col("label") / 4))
    return search.rerank_by_distance(e, id_col="vec_id").limit(30).select("vec_id", "label")


@query("""SELECT coalesce(d.vec_id, s.vec_id) AS vec_id, round(0.3 * coalesce(d.score, 0) + 0.7 * coalesce(s.score, 0), 6) AS score FROM (SELECT vec_id, label / 10.0 AS score FROM embeddings WHERE vec_id % 2 = 0) d
    FULL JOIN (SELECT vec_id, vec_id / 1000.0 AS score FROM embeddings WHERE vec_id % 3 = 0) s ON d.vec_id = s.vec_id""")
def hybrid_scores(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    dense, sparse = e.where("vec_id % 2 = 0").selectExpr("vec_id", "label / 10 AS score"), e.where("vec_id % 3 = 0").selectExpr("vec_id", "vec_id / 1000 AS score")
    return search.hybrid(dense, sparse, 0.3, "vec_id").select("vec_id", F.round("score", 6).alias("score"))


@query("""SELECT label, vec_id FROM (SELECT label, vec_id, row_number() OVER (PARTITION BY label ORDER BY vec_id % 97 DESC, vec_id) AS o FROM embeddings WHERE vec_id % 97 >= 30) WHERE o <= 4""")
def compressed_chunks(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").withColumn("score", (F.col("vec_id") % 97).cast("double"))
    return search.compressed(e, 30.0, 4, "label", "vec_id").select("label", "vec_id")


_SIDE = "CASE label % 3 WHEN 0 THEN 'image' WHEN 1 THEN 'text' END"


@query(f"SELECT vec_id, {_SIDE} AS modality FROM embeddings WHERE {_SIDE} = 'image' UNION ALL SELECT vec_id, {_SIDE} FROM embeddings")
def modality_filter(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.expr(_SIDE).alias("modality"))
    return records.modality_filter(e, "image").unionByName(records.modality_filter(e, "sound"))


@query(f"SELECT label, count(*) FILTER (coalesce({_SIDE}, '') <> 'image') AS text_results, count(*) FILTER ({_SIDE} = 'image') AS image_results, count(*) FILTER (coalesce({_SIDE}, '') <> 'image') AS shown FROM embeddings GROUP BY label")
def result_views(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select("label", F.expr(_SIDE).alias("result_type"))
    shown = records.result_view(e, "text").groupBy("label").agg(F.count(F.lit(1)).alias("shown"))
    return records.split_counts(records.result_view(e), "label").join(shown, "label", "left").withColumn("shown", F.coalesce("shown", F.lit(0).cast("long")))


@query("""SELECT doc_id AS chunk_id, md5(coalesce(text, '')) AS content, CASE WHEN doc_id % 2 = 0 THEN source ELSE 'Unknown Source' END AS document_name, 0.5::DOUBLE AS relevance_score, 'text' AS source_type,
    CASE WHEN doc_id % 3 = 0 THEN '7' END AS page_number, NULL::VARCHAR AS slide_number FROM documents""")
def lesson_material_rows(spark, sf_dir):
    meta = F.map_filter(F.create_map(F.lit("source_file"), F.when(F.col("doc_id") % 2 == 0, F.col("source")), F.lit("page_number"), F.when(F.col("doc_id") % 3 == 0, "7")), lambda _, v: v.isNotNull())
    hits = table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("document"), F.lit(0.5).alias("score"), meta.alias("metadata"))
    return records.as_material(hits, "text", "doc_id").withColumn("content", F.md5("content"))


# ---- reports


@query("SELECT event_type, count(*) AS total_batches, sum(event_id % 10 + 1)::BIGINT AS total_items, round(sum(value), 4) AS total_time, round(sum(event_id % 10 + 1) / count(*), 4) AS average_batch_size, round(sum(event_id % 10 + 1) / sum(value), 4) AS average_throughput FROM events GROUP BY event_type")
def batch_statistics(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("size", F.col("event_id") % 10 + 1)
    return records.batch_statistics(e, "event_type", seconds="value").withColumn("total_items", F.col("total_items").cast("long"))


@query("SELECT (event_id % 4)::INT AS batch_size, round(count(*) / sum(value), 4) AS throughput FROM events GROUP BY event_id % 4")
def batch_size_benchmark(spark, sf_dir):
    e = table(spark, sf_dir, "events").select((F.col("event_id") % 4).cast("int").alias("batch_size"), F.lit(1).alias("items"), F.col("value").alias("seconds"))
    return records.throughput_by_batch_size(e)


_RUNS = "event_id AS name, value AS seconds, (user_id % 50)::DOUBLE AS start_mb, (user_id % 50 + event_id % 1000)::DOUBLE AS peak_mb FROM events"


def _runs(spark, sf_dir):
    return table(spark, sf_dir, "events").selectExpr("event_id AS name", "value AS seconds", "CAST(user_id % 50 AS DOUBLE) AS start_mb", "CAST(user_id % 50 + event_id % 1000 AS DOUBLE) AS peak_mb")


@query(f"SELECT name, peak_mb - start_mb AS memory_used FROM (SELECT {_RUNS}) ORDER BY memory_used DESC, name LIMIT 5")
def memory_hungry(spark, sf_dir):
    return records.memory_hungry(_runs(spark, sf_dir)).select("name", "memory_used")


@query(f"""SELECT count(*) AS operations, round(sum(seconds), 2) AS total_duration, round(sum(peak_mb - start_mb), 1) AS total_memory, round(avg(seconds), 2) AS average_duration,
    round(avg(peak_mb - start_mb), 1) AS average_memory FROM (SELECT {_RUNS})""")
def profile_totals(spark, sf_dir):
    return records.profile_totals(_runs(spark, sf_dir))


@query("SELECT event_id, round(value, 2) AS vector_search_time_ms, round(value / 3, 2) AS reranking_time_ms, round(value * 2, 2) AS total_time_ms, (user_id % 20)::INT AS documents_retrieved FROM events")
def retrieval_metrics(spark, sf_dir):
    runs = table(spark, sf_dir, "events").selectExpr("event_id", "value AS vector_search_time_ms", "value / 3 AS reranking_time_ms", "value * 2 AS total_time_ms", "CAST(user_id % 20 AS INT) AS documents_retrieved")
    return records.retrieval_metrics(runs, "event_id")


@query("SELECT user_id, event_id FROM events ORDER BY event_id LIMIT 500")
def input_order(spark, sf_dir):
    return records.in_input_order(table(spark, sf_dir, "events").repartition(8, "user_id"), "event_id").limit(500).select("user_id", "event_id")


@query("SELECT event_id, user_id FROM events WHERE event_type = 'error' ORDER BY event_id DESC LIMIT 10")
def last_snapshots(spark, sf_dir):
    return metrics.slowest(table(spark, sf_dir, "events").where("event_type = 'error'"), "event_id", 10, "user_id").select("event_id", "user_id")
