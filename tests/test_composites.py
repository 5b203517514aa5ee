from pyspark.sql import functions as F

from siltstone.engine import Engine
from siltstone.functions import text as T
from siltstone.operators import chunking, lessons, search

REGIONS = "source string, region_sequence int, region_type string, content string, page_number int, table_rows int, table_html string, semantic_tags array<string>"
ROWS = [
    ("a", 0, "title", "Rivers", 1, None, None, ["t"]), ("a", 1, "text", "Boats go on rivers.", 2, None, None, ["x", "t"]),
    ("a", 2, "table", "k | v", 2, 2, "", None), ("a", 3, "image", None, 3, None, "<odd>", None), ("b", 0, "text", "Fractions.", None, None, None, None),
]


def test_metadata_of_semantic_chunks(spark):
    got = {(r.source, r.chunk_index): r for r in chunking.semantic_chunks(spark.createDataFrame(ROWS, REGIONS), id_col="source").collect()}
    merged, table, image, other = (got[k].metadata for k in (("a", 0), ("a", 1), ("a", 2), ("b", 0)))
    assert got["a", 0].content == "Rivers\n\nBoats go on rivers." and merged["page_numbers"] == "1,2" and merged["pages_spanned"] == "2" and merged["semantic_tags"] == "t,x"
    assert merged["region_types"] == "title,text" and "atomic" not in merged and "region_type" not in merged and merged["page_number"] == "1"
    assert table["atomic"] == "true" and table["table_rows"] == "2" and "table_html" not in table and table["region_sequence"] == "2"
    assert image["region_type"] == "image" and "table_html" not in image and got["a", 2].content == "" and image["end_index"] == "0"
    assert "page_number" not in other and "page_numbers" not in other and other["merged_regions"] == "1"


def test_ingest_regions_and_report(spark, tmp_path):
    engine = Engine(spark, f"file://{tmp_path}/store")
    rows = [*ROWS, ("c", 0, "text", "", 1, None, None, None)]
    report = {r.source: r for r in engine.ingest_regions("c", spark.createDataFrame(rows, REGIONS)).collect()}
    assert report["a"].embedding_ids == ["a_chunk_0", "a_chunk_1", "a_chunk_2"] and report["a"].total_chunks == 3 and report["a"].status == "success"
    assert engine.store.snapshot("c").rows() == 5 and engine.search("c", "boats rivers", 1).first().id == "a_chunk_0"
    again = engine.ingest_regions("c", spark.createDataFrame(ROWS[4:], REGIONS)).collect()
    assert [r.collection_name for r in again] == ["c"] and engine.store.snapshot("c").rows() == 6


def test_filter_falls_back(spark):
    df = spark.createDataFrame([(str(n), [1.0, n / 10], n % 2) for n in range(6)], "id string, embedding array<float>, label int")
    ids = lambda where: [r.id for r in search.filtered_or_all(df, [1.0, 0.0], 2, where).orderBy("distance").collect()]
    assert ids({"label": 1}) == ["1", "3"] and ids({"label": 7}) == ["0", "1"] and ids(None) == ["0", "1"]


def test_vectors_of_zeros_are_far_from_all(spark):
    df = spark.createDataFrame([("a", [1.0, 0.0]), ("z", [0.0, 0.0]), ("b", [-1.0, 0.0])], "id string, embedding array<float>")
    assert [(r.id, r.distance) for r in search.top_k(df, [1.0, 0.0], 3).collect()] == [("a", 0.0), ("z", 1.0), ("b", 2.0)]
    queries = spark.createDataFrame([("q", [1.0, 0.0]), ("0", [0.0, 0.0])], "query_id string, query_vector array<float>")
    got = {(r.query_id, r.id): r.distance for r in search.batch_top_k(df, queries, 3).collect()}
    assert got["q", "z"] == got["0", "a"] == got["0", "z"] == 1.0 and got["q", "b"] == 2.0


def test_hints_boxes_and_types(spark):
    rows = [("Grade 3 algebra", None), ("nothing", "Grade 5.pdf"), ("nothing", ""), (None, None)]
    df = spark.createDataFrame(rows, "t string, f string")
    got = [tuple(r.h) for r in df.select(lessons.hints(F.col("t"), F.col("f")).alias("h")).collect()]
    assert got[0][0] is not None and got[0][2] == "educational" and got[1][0] is not None and got[2] == (None, None, None) and got[3][2] is None
    text = "---\na: b\n---\n---\ntitle: 'T: x'\ngrade: 3\ngenerated: soon\n---\nbody"
    box = spark.createDataFrame([(text,), ("---\na: b\n---\n",), ("",)], "t string").select(lessons.metadata_box(F.col("t"), "bw").alias("b")).collect()
    assert box[0].b.startswith('<div class="lesson-metadata-bw">\n<h1 class="lesson-title-bw">T: x</h1>') and 'Grade Level:</span> <span class="metadata-value">3<' in box[0].b
    assert 'value">soon<' in box[0].b and box[1].b == box[2].b == ""
    kinds = spark.createDataFrame([("a/b.PY",), ("x",), ("y.tar.gz",)], "p string").select(T.content_type(F.col("p")).alias("k")).collect()
    assert [r.k for r in kinds] == ["text/x-python", "application/octet-stream", "application/octet-stream"]


def test_metadata_box_reads_its_block_once(spark):
    from pyspark.sql import functions as F

    from siltstone.operators import lessons

    df = spark.createDataFrame([("---\na: b\n---\n\n---\ntitle: T\ntitle: U\nduration: 5\n---\n",), ("x",), (None,)], "t string").select(lessons.metadata_box(F.col("t")).alias("b"))
    assert df._jdf.queryExecution().optimizedPlan().toString().count("regexp_extract_all") == 1
    got = [r.b for r in df.collect()]
    assert '<h1 class="lesson-title">U</h1>' in got[0] and "5 minutes" in got[0] and "".join(filter(None, got[1:])) == ""


def test_chunks_without_texts(spark):
    df = spark.createDataFrame(ROWS, REGIONS)
    whole, bare = chunking.semantic_chunks(df, id_col="source"), chunking.semantic_chunks(df, id_col="source", content=False)
    assert "content" not in bare.columns
    assert sorted(map(str, whole.drop("content").collect())) == sorted(map(str, bare.collect()))
    assert all(r.metadata["end_index"] == str(len(r.content)) for r in whole.collect())
