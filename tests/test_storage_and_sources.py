import json
import zipfile

import pytest
from pyspark.sql import functions as F

from siltstone.operators import predicates
from siltstone.sources import loaders
from siltstone.sources.collections import CollectionStore
from siltstone.streaming import streams


def test_collections(spark, tmp_path):
    store = CollectionStore(spark, f"file://{tmp_path}/store")
    store.create("a", 2)
    with pytest.raises(ValueError):
        store.create("a", 2)
    rows = spark.createDataFrame([("1", [1.0, 0.0], "x"), ("2", [0.0, 1.0], "y"), (None, [1.0, 1.0], "z")], "id string, embedding array<float>, document string")
    assert store.read("a").count() == 0
    store.add("a", rows)
    assert store.read("a").where("id IS NOT NULL").count() == 3
    store.update("a", spark.createDataFrame([("1", "new"), ("9", "none")], "id string, document string"))
    one = store.read("a").where("id = '1'").first()
    assert one.document == "new" and one.embedding == [1.0, 0.0] and store.read("a").count() == 3
    store.delete("a", spark.createDataFrame([("2",)], "id string"))
    assert {r.collection: r.n for r in store.stats().collect()} == {"a": 2}
    store.drop("a")
    assert store.list().count() == 0
    with pytest.raises(KeyError):
        store.read("a")


def test_filters(spark):
    df = spark.createDataFrame([(1, "x"), (2, "y"), (3, "x")], "n int, s string")
    keys = lambda w: sorted(r.n for r in predicates.filtered(df, w).collect())
    assert keys(None) == keys({}) == [1, 2, 3]
    assert keys({"s": "x"}) == keys({"s": {"$eq": "x"}}) == keys({"s": {"$in": ["x"]}}) == [1, 3]
    assert keys({"$and": [{"s": "x"}, {"n": {"$gt": 1}}]}) == [3] and keys({"$or": [{"n": 1}, {"n": {"$gte": 3}}]}) == [1, 3]
    assert keys({"s": {"$nin": ["x"]}}) == keys({"s": {"$ne": "x"}}) == [2]
    with pytest.raises(ValueError):
        keys({"n": {"$near": 1}})
    assert predicates.education_filter("3", "Science") == {"$and": [{"edu_grade": {"$eq": "3"}}, {"edu_subject": {"$eq": "Science"}}]}
    assert predicates.education_filter() is None and predicates.education_filter("3") == {"edu_grade": {"$eq": "3"}}


def office(path, files):
    with zipfile.ZipFile(path, "w") as z:
        for name, body in files.items():
            z.writestr(name, f'<r xmlns:w="w" xmlns:a="a" xmlns:p="p">{body}</r>')


def test_loaders(spark, tmp_path):
    (tmp_path / "a.txt").write_text("plain é")
    (tmp_path / "b.MD").write_text("# md")
    (tmp_path / "c.bin").write_bytes(b"x")
    (tmp_path / "e.txt").write_text("  ")
    (tmp_path / "bad.docx").write_bytes(b"nozip")
    office(tmp_path / "d.docx", {"word/document.xml": "<w:p><w:t>One</w:t><w:t> two</w:t></w:p><w:p><w:t> </w:t></w:p><w:p><w:t>Three</w:t></w:p>"})
    office(tmp_path / "s.pptx", {"ppt/slides/slide1.xml": "<p:sp><a:p><a:t>Hi</a:t></a:p></p:sp><a:tr><a:tc><a:t>1</a:t></a:tc><a:tc><a:t>2</a:t></a:tc></a:tr>"})
    found = loaders.checked(loaders.files(spark, f"file://{tmp_path}"))
    assert {r.path.rsplit("/")[-1] for r in found.where("error IS NOT NULL").collect()} == {"c.bin", "bad.docx"}
    got = {r.path.rsplit("/")[-1]: r for r in loaders.loaded(found.drop("error")).collect()}
    assert got["a.txt"].content == "plain é" and got["b.MD"].format == "markdown"
    assert got["d.docx"].content == "One two\n\nThree" and got["d.docx"].metadata["paragraph_count"] == "2"
    assert got["s.pptx"].content == "--- Slide 1 ---\nHi\n1 | 2"
    assert "no content" in got["e.txt"].error and got["bad.docx"].content is None and got["bad.docx"].error
    pages = loaders.page_rows(loaders.loaded(found.where("path LIKE '%d.docx'"))).orderBy("page_number").collect()
    assert [(p.page_number, p.start_index, p.end_index) for p in pages] == [(1, 0, 14)]


def test_pages_and_properties(spark, tmp_path):
    core = "<title>My deck</title><creator>A. N.</creator><created>2024-01-02T03:04:05Z</created><modified> </modified>"
    slide = "<p:sp><a:p><a:t>First</a:t></a:p><a:p><a:t> line</a:t></a:p></p:sp><p:pic/>"
    office(tmp_path / "s.pptx", {"ppt/slides/slide2.xml": "<p:sp><a:p><a:t>Two</a:t></a:p></p:sp>", "ppt/slides/slide1.xml": slide, "docProps/core.xml": core})
    office(tmp_path / "d.docx", {"word/document.xml": "<w:p><w:t>One</w:t></w:p>", "docProps/core.xml": core})
    got = {r.path.rsplit("/")[-1]: r for r in loaders.loaded(loaders.files(spark, f"file://{tmp_path}")).collect()}
    m = got["s.pptx"].metadata
    assert m["title"] == "My deck" and m["author"] == "A. N." and m["created"].startswith("2024") and "modified" not in m
    assert m["slide_count"] == "2" and m["total_shapes"] == "3" and json.loads(m["slides"])[0] == {"slide_number": 1, "shape_count": 2, "text_length": 11}
    assert got["d.docx"].metadata["author"] == "A. N." and got["d.docx"].pages is None
    pages = loaders.page_rows(loaders.loaded(loaders.files(spark, f"file://{tmp_path}", "*.pptx"))).orderBy("page_number").collect()
    assert [p.content for p in pages] == ["--- Slide 1 ---\nFirst\n line", "--- Slide 2 ---\nTwo"]
    assert all(got["s.pptx"].content[p.start_index : p.end_index] == p.content for p in pages)
    # a page may hold blank lines of its own
    content, where = loaders.joined_pages(["a\n\nb", "", "c"])
    assert [content[w["start_index"] : w["end_index"]] for w in where] == ["a\n\nb", "", "c"]
    df = spark.createDataFrame([("x", content, where)], "path string, content string, pages array<struct<page_number:int,start_index:int,end_index:int>>")
    assert [p.content for p in loaders.page_rows(df).orderBy("page_number").collect()] == ["a\n\nb", "", "c"]


def test_query_set(spark, tmp_path):
    (tmp_path / "q.json").write_text('{"categories": {"a": {"description": "d", "queries": ["1", "2"]}, "b": {"queries": ["3"]}}}')
    assert sorted(r.query for r in loaders.query_set(spark, f"file://{tmp_path}/q.json").collect()) == ["1", "2", "3"]
    assert [r.query for r in loaders.query_set(spark, f"file://{tmp_path}/q.json", "b").collect()] == ["3"]


def test_stream_sessions_equal_the_batch(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet").select("user_id", F.col("ts").cast("timestamp").alias("ts"))
    source, sink, mark = (f"file://{tmp_path}/{n}" for n in ("in", "out", "mark"))
    events.repartition(3).write.parquet(source)
    stream = streams.session_windows(streams.folder(spark, source, "user_id long, ts timestamp", 1), late="60 days")
    query = stream.writeStream.outputMode("complete").format("memory").queryName("sessions").trigger(availableNow=True).start()
    query.awaitTermination()
    key = lambda d: sorted(map(tuple, d.collect()))
    assert key(spark.table("sessions")) == key(streams.session_windows(events))
    streams.run_available(streams.folder(spark, source, "user_id long, ts timestamp"), sink, mark).awaitTermination()
    streams.run_available(streams.folder(spark, source, "user_id long, ts timestamp"), sink, mark).awaitTermination()
    assert spark.read.parquet(sink).count() == events.count()
    seen = []
    streams.batches(streams.folder(spark, source, "user_id long, ts timestamp", 1), lambda d, n: seen.append(d.count()), mark + "2").awaitTermination()
    assert sum(seen) == events.count() and len(seen) >= 3
