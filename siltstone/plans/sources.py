"""Queries on document sources, over files that Spark writes from the tables, with their DuckDB twins."""

from __future__ import annotations

import uuid
import zipfile
from collections.abc import Iterable, Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import functions as F

from siltstone.plans.catalogue import query, table
from siltstone.sources import documents, images, loaders, slides
from siltstone.sources.scratch import fresh_path


@query("""SELECT md5(text) AS content, count(*) AS n, 'text' AS format FROM documents WHERE trim(text, chr(10) || chr(9) || ' ') <> '' AND text NOT LIKE '%' || chr(12) || '%' GROUP BY md5(text)""")
def document_pages(spark, sf_dir):
    """Documents as the pages of text files, parted by form feeds, read back by the data source."""
    path = fresh_path(spark, "pages")
    docs = table(spark, sf_dir, "documents").where(F.col("text").rlike(r"[^\n\t ]") & ~F.col("text").contains("\f"))
    docs.select("text").write.option("lineSep", "\f").text(path)
    documents.register(spark)
    pages = spark.read.format("documents").option("suffixes", ".txt").load(path)
    # a task without rows leaves an empty file, which is one empty page
    return pages.where("error IS NULL AND content <> ''").groupBy(F.md5("content").alias("content"), "format").agg(F.count(F.lit(1)).alias("n"))


#: Tasks over which presentations are dealt (fixed value).
_DECK_TASKS = 64
_XML = 'xmlns:a="a" xmlns:p="p" xmlns:r="r"'


def _at(tag: str, x: int, y: int, w: int, h: int, more: str = "") -> str:
    return f'<{tag}><a:off x="{x}" y="{y}"/><a:ext cx="{w}" cy="{h}"/>{more}</{tag}>'


def _text(name: str, body: str, at: str) -> str:
    return f'<p:sp><p:nvSpPr><p:cNvPr id="1" name="{name}"/></p:nvSpPr><p:spPr>{at}</p:spPr><p:txBody><a:p><a:r><a:t>{body}</a:t></a:r></a:p></p:txBody></p:sp>'


def _deck(file, rows: Iterable[tuple]) -> None:
    """A presentation of 1000 x 1000 units with a slide for each part: a title, and in a group of half size a text and a table."""
    with zipfile.ZipFile(file, "w", zipfile.ZIP_DEFLATED, compresslevel=1) as z:
        z.writestr("ppt/presentation.xml", f'<p:presentation {_XML}><p:sldSz cx="1000" cy="1000"/></p:presentation>')
        for n, (key, name, kind, size) in enumerate(rows, 1):
            cells = "".join(f"<a:tc><a:txBody><a:p><a:r><a:t>{c}</a:t></a:r></a:p></a:txBody></a:tc>" for c in (key, size))
            frame = f"<p:graphicFrame>{_at('p:xfrm', 0, 800, 1000, 200)}<a:tbl><a:tr>{cells}</a:tr></a:tbl></p:graphicFrame>"
            group = _at("a:xfrm", 100, 400, 500, 500, '<a:chOff x="0" y="0"/><a:chExt cx="1000" cy="1000"/>')
            shapes = f"<p:grpSp><p:grpSpPr>{group}</p:grpSpPr>{frame}{_text('Body', name, _at('a:xfrm', 0, 200, 600, 400))}</p:grpSp>"
            shapes += _text("Title 1", kind, _at("a:xfrm", 0, 0, 1000, 100)) + _text("Empty", " ", "")
            z.writestr(f"ppt/slides/slide{n}.xml", f"<p:sld {_XML}><p:cSld><p:spTree>{shapes}</p:spTree></p:cSld></p:sld>")


def _decks(spark, sf_dir):
    """A presentation for each brand (path) as a file in the shared folder, which is written and read a slide at a time."""
    folder = fresh_path(spark, "decks")
    columns = ["p_brand", "p_partkey", "p_name", "p_type", "p_size"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, place = documents._located(folder)
        system.create_dir(place, recursive=True)
        rows = (row for batch in batches for at in range(0, len(batch), 1024) for row in zip(*batch.slice(at, 1024).to_pydict().values(), strict=True))
        for brand, parts in groupby(rows, key=lambda row: row[0]):
            name = f"{uuid.uuid4().hex}.pptx"
            with system.open_output_stream(f"{place}/{name}", buffer_size=1 << 20) as file:
                _deck(file, (row[1:] for row in parts))
            yield pa.RecordBatch.from_pydict({"path": [f"{brand}.pptx"], "file": [f"{folder}/{name}"]})

    parts = table(spark, sf_dir, "part").select(columns)
    # a stated number of tasks: by their bytes, large decks would be put into one
    dealt = parts.repartition(_DECK_TASKS, "p_brand").sortWithinPartitions("p_brand", F.asc_nulls_last("p_partkey"))
    return dealt.mapInArrow(run, "path string, file string")


@query("""WITH p AS (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey)::INT AS page_number FROM part),
    r AS (SELECT *, unnest(['table', 'text', 'title']) AS region_type, unnest([0, 1, 2])::INT AS region_sequence, unnest([2, 1, 0])::INT AS reading_order,
        unnest([p_partkey || ' | ' || p_size, p_name, p_type]) AS content, unnest([0.1, 0.1, 0])::DOUBLE AS x_min, unnest([0.8, 0.5, 0])::DOUBLE AS y_min,
        unnest([0.6, 0.4, 1])::DOUBLE AS x_max, unnest([0.9, 0.7, 0.1])::DOUBLE AS y_max FROM p)
    SELECT p_brand || '.pptx' AS path, page_number, p_brand || '_slide' || page_number || '_shape' || region_sequence AS region_id, region_type, region_sequence, reading_order, content,
        x_min, y_min, x_max, y_max, CASE WHEN region_type = 'table' THEN p_size::VARCHAR END AS cell FROM r""")
def slide_regions(spark, sf_dir):
    found = slides.slide_regions(_decks(spark, sf_dir))
    box = [F.round(F.col(f"bbox.{c}"), 6).alias(c) for c in ("x_min", "y_min", "x_max", "y_max")]
    return found.select("path", "page_number", "region_id", "region_type", "region_sequence", "reading_order", "content", *box, F.get(F.get("cells", F.lit(0)), F.lit(1)).alias("cell"))


@query("""WITH p AS (SELECT p_brand, '--- Slide ' || n || ' (' AS head, n, p_partkey || ' | ' || p_size AS a, p_name AS b, p_type AS c FROM
        (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS n FROM part))
    SELECT p_brand || '.pptx' AS path, count(*)::INT AS slide_count, count(*) AS title, count(*) AS "table", count(*) AS text, md5(string_agg(head || 'table) ---' || chr(10) || a || chr(10) || chr(10) ||
        head || 'text) ---' || chr(10) || b || chr(10) || chr(10) || head || 'title) ---' || chr(10) || c, chr(10) || chr(10) ORDER BY n)) AS content FROM p GROUP BY p_brand""")
def deck_texts(spark, sf_dir):
    return slides.deck_texts(_decks(spark, sf_dir)).select("path", "slide_count", "title", "table", "text", F.md5("content").alias("content"))


@query("""SELECT path, CASE WHEN error IS NULL THEN 'pending' ELSE 'failed' END AS status, error FROM (SELECT p_partkey || ['.txt', '.pdf', '.png', '.exe'][p_partkey % 4 + 1] AS path,
    CASE p_partkey % 4 WHEN 1 THEN CASE WHEN p_partkey % 3 > 0 THEN 'content is not .pdf' END WHEN 2 THEN CASE WHEN p_size > 40 THEN 'image too large' ELSE 'content is not .png' END
        WHEN 3 THEN 'unsupported format: .exe' END AS error FROM part)""")
def admitted_files(spark, sf_dir):
    key = F.col("p_partkey")
    suffix = F.element_at(F.array(*map(F.lit, (".txt", ".pdf", ".png", ".exe"))), (key % 4 + 1).cast("int"))
    body = F.when((key % 4 == 1) & (key % 3 == 0), F.concat(F.lit("%PDF-1.7 "), "p_name")).otherwise(F.col("p_name")).cast("binary")
    size = F.when(F.col("p_size") > 40, F.lit(loaders.MAX_IMAGE + 1)).otherwise(F.col("p_size"))
    return loaders.admitted(table(spark, sf_dir, "part").select(F.concat(key.cast("string"), suffix).alias("path"), body.alias("content"), size.alias("length")))


#: The vectors as grey pictures of 8 x 8 pixels.
_PIXELS = "list_transform(embedding, lambda x: greatest(0, least(255, floor((x::DOUBLE + 1) * 127.5)))::INT)"


def _pictures(spark, sf_dir):
    value = lambda x: F.greatest(F.lit(0), F.least(F.lit(255), F.floor((x.cast("double") + 1) * 127.5))).cast("int")
    data = F.unhex(F.array_join(F.transform("embedding", lambda x: F.lpad(F.hex(value(x)), 2, "0")), ""))
    rows = table(spark, sf_dir, "embeddings").where(F.size("embedding") == 64)
    return rows.select(F.col("vec_id").cast("string").alias("path"), F.lit(8).alias("width"), F.lit(8).alias("height"), F.lit(1).alias("channels"), data.alias("data"))


def _reds(data, n: int):
    return F.array_join(F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda k: F.conv(F.substring(F.hex(data), k * 6 + 1, F.lit(2)), 16, 10)), ",")


_SMALL = """list_transform(generate_series(0, 15), lambda k: floor((px[(k // 4) * 16 + (k % 4) * 2 + 1] + px[(k // 4) * 16 + (k % 4) * 2 + 2] +
    px[(k // 4) * 16 + (k % 4) * 2 + 9] + px[(k // 4) * 16 + (k % 4) * 2 + 10]) / 4.0 + 0.5)::INT)"""


@query(f"""WITH p AS (SELECT vec_id, {_PIXELS} AS px FROM embeddings WHERE len(embedding) = 64)
    SELECT vec_id::VARCHAR AS path, 4 AS width, 4 AS height, array_to_string({_SMALL}, ',') AS pixels FROM p""")
def thumbnails(spark, sf_dir):
    return images.thumbnails(_pictures(spark, sf_dir), (4, 6)).select("path", "width", "height", _reds(F.col("data"), 16).alias("pixels"))


@query(f"""WITH p AS (SELECT vec_id, {_PIXELS} AS px FROM embeddings WHERE len(embedding) = 64), s AS (SELECT vec_id, {_SMALL} AS t FROM p)
    SELECT vec_id::VARCHAR AS path, 4 AS width, 6 AS height, '255,255,255,255,' || array_to_string(t, ',') || ',255,255,255,255' AS pixels FROM s""")
def padded_thumbnails(spark, sf_dir):
    return images.thumbnails(_pictures(spark, sf_dir), (4, 6), padded=True).select("path", "width", "height", _reds(F.col("data"), 24).alias("pixels"))


@query(f"""WITH p AS (SELECT vec_id, list_sum({_PIXELS}) / 64.0 AS m FROM embeddings WHERE len(embedding) = 64)
    SELECT vec_id::VARCHAR AS path, round(m, 6) AS mean, true AS has_text FROM p""")
def image_features(spark, sf_dir):
    """Feature texts of pictures through the encoder's seam."""
    from siltstone.operators import ingest

    found = images.encoded_images(_pictures(spark, sf_dir), ingest.hash_encoder)
    text = images.feature_text([F.col("mean_r"), F.col("mean_g"), F.col("mean_b")])
    return found.select("path", F.round("mean_r", 6).alias("mean"), ((F.col("feature_text") == text) & (F.size("embedding") == 64)).alias("has_text"))
