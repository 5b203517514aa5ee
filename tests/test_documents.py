import io
import random
import tracemalloc
import zipfile

import pytest
from pyspark.sql import functions as F

from siltstone.sources import documents, loaders, slides

XML = 'xmlns:a="a" xmlns:p="p" xmlns:r="r"'


def slide(body):
    return f"<p:sld {XML}><p:cSld><p:spTree>{body}</p:spTree></p:cSld></p:sld>"


def box(tag, x, y, w, h, more=""):
    return f'<{tag}><a:off x="{x}" y="{y}"/><a:ext cx="{w}" cy="{h}"/>{more}</{tag}>'


def shape(text, at="", name="Box", holder=""):
    return f'<p:sp><p:nvSpPr><p:cNvPr id="1" name="{name}"/><p:nvPr>{holder}</p:nvPr></p:nvSpPr><p:spPr>{at}</p:spPr><p:txBody><a:p><a:r><a:t>{text}</a:t></a:r></a:p></p:txBody></p:sp>'


def group(body, x, y, w, h, cx, cy, cw, ch):
    return f'<p:grpSp><p:grpSpPr>{box("a:xfrm", x, y, w, h, f"""<a:chOff x="{cx}" y="{cy}"/><a:chExt cx="{cw}" cy="{ch}"/>""")}</p:grpSpPr>{body}</p:grpSp>'


def deck(bodies, more=()):
    held = io.BytesIO()
    with zipfile.ZipFile(held, "w") as z:
        z.writestr("ppt/presentation.xml", f'<p:presentation {XML}><p:sldSz cx="1000" cy="500"/></p:presentation>')
        for n, b in enumerate(bodies, 1):
            z.writestr(f"ppt/slides/slide{n}.xml", slide(b))
        for name, data in more:
            z.writestr(name, data)
    return held.getvalue()


TABLE = "<p:graphicFrame>{}<a:tbl><a:tr><a:tc><a:p><a:t>a</a:t></a:p></a:tc><a:tc><a:p><a:t>b</a:t></a:p></a:tc></a:tr><a:tr><a:tc><a:p/></a:tc><a:tc><a:p><a:t>d</a:t></a:p></a:tc></a:tr></a:tbl></p:graphicFrame>"


def test_nested_groups_tables_and_order(spark):
    inner = group(shape("deep", box("a:xfrm", 10, 10, 20, 20)), 100, 100, 100, 100, 0, 0, 50, 50)  # twice as large
    nested = group(inner + TABLE.format(box("p:xfrm", 0, 0, 200, 100)), 500, 250, 250, 125, 0, 0, 500, 250)  # half as large
    picture = '<p:pic><p:nvPicPr><p:cNvPr id="2" name="p" descr="A cat"/></p:nvPicPr><p:blipFill><a:blip r:embed="rId1"/></p:blipFill></p:pic>'
    left, right = shape("left", box("a:xfrm", 0, 300, 300, 100)), shape("right", box("a:xfrm", 400, 320, 300, 100))
    title = shape("Head", box("a:xfrm", 0, 0, 1000, 50), holder='<p:ph type="ctrTitle"/>')
    rels = "<Relationships><Relationship Id='rId1' Target='../media/image1.png'/></Relationships>"
    data = deck([right + left + nested + shape("loose") + picture + title, shape(" ")], [("ppt/slides/_rels/slide1.xml.rels", rels)])
    rows = [("/x/my deck.pptx", data), ("/x/empty.pptx", deck([shape("")])), ("/x/bad.pptx", b"no zip")]
    found = slides.slide_regions(spark.createDataFrame(rows, "path string, content binary"))
    got = {r.content: r for r in found.where("error IS NULL").collect()}
    unit = lambda r: [round(v, 6) for v in r.bbox]
    # 10..30 of the inner group is 120..160 of the outer one, that is 560..580 of 1000 and 310..330 of 500
    assert unit(got["deep"]) == [0.56, 0.62, 0.58, 0.66] and unit(got["a | b\n | d"]) == [0.5, 0.5, 0.6, 0.6]
    assert got["a | b\n | d"].cells == [["a", "b"], ["", "d"]] and got["Head"].region_type == "title" and got["A cat"].image_path == "ppt/media/image1.png"
    assert got["loose"].bbox is None and got["left"].region_id == "my deck_slide1_shape1"
    order = sorted(got.values(), key=lambda r: r.reading_order)
    # tables and the deep box stand on their own lines, by their middles
    assert [r.content for r in order] == ["Head", "a | b\n | d", "loose", "A cat", "deep", "left", "right"]
    assert [r.reading_order for r in order] == list(range(7))
    errors = {r.path: r.error for r in found.where("error IS NOT NULL").collect()}
    assert errors["/x/empty.pptx"] == "ValueError: no content" and "BadZipFile" in errors["/x/bad.pptx"]


def test_slides_do_not_list_the_archive():
    class Counting(zipfile.ZipFile):
        listed = 0

        def namelist(self):
            Counting.listed += 1
            return super().namelist()

    with Counting(io.BytesIO(deck([shape(f"t{i}") for i in range(20)]))) as archive:
        assert [slides.text_of(slides.shapes_of(archive, n)) for n in slides.slide_names(archive)] == [f"t{i}" for i in range(20)]
        assert Counting.listed == 1  # once for the slides' names


def test_decks_in_files_give_what_their_bytes_give(spark, tmp_path):
    # texts of 2,500,000 characters are twelve blocks, whose rows do not fit the memory in which they wait
    long = deck([shape(f"{n} " + "x" * 2_500_000, name="Title" if n % 2 else "Box") for n in range(1, 13)])
    broken = deck([shape("y" * 5_000_000)] * 2, [("ppt/slides/slide3.xml", "<no end")])
    rows = [("long.pptx", long), ("broken.pptx", broken), ("empty.pptx", deck([shape("")])), ("bad.pptx", b"no zip"), ("two.pptx", deck([shape("a") + TABLE.format(""), shape(" "), shape("b"), shape(" ")]))]
    for name, data in rows:
        (tmp_path / name).write_bytes(data)
    files = spark.createDataFrame([(name, str(tmp_path / name)) for name, _ in rows] + [("none.pptx", str(tmp_path / "none.pptx"))], "path string, file string")
    got = {r.path: r for r in slides.deck_texts(files).collect()}
    text = "\n\n".join(f"--- Slide {n} ({'title' if n % 2 else 'text'}) ---\n{n} " + "x" * 2_500_000 for n in range(1, 13))
    assert got["long.pptx"].content == text and (got["long.pptx"].slide_count, got["long.pptx"].title, got["long.pptx"].text) == (12, 6, 6)
    assert got["two.pptx"].content == "--- Slide 1 (text) ---\na\n\n--- Slide 1 (table) ---\na | b\n | d\n\n--- Slide 3 (text) ---\nb" and got["two.pptx"].slide_count == 3
    # a deck whose last slide is broken is its error only
    assert (got["broken.pptx"].content, got["broken.pptx"].slide_count, got["broken.pptx"].text) == ("", None, 0) and "ParseError" in got["broken.pptx"].error
    assert got["empty.pptx"].error == "ValueError: no content" and "BadZipFile" in got["bad.pptx"].error and "FileNotFoundError" in got["none.pptx"].error
    held = spark.createDataFrame(rows, "path string, content binary")
    assert sorted(slides.deck_texts(held).collect()) == sorted(r for p, r in got.items() if p != "none.pptx")
    assert [(r.path, r.n) for r in slides.slide_regions(files).groupBy("path").agg(F.count("content").alias("n")).sort("path").collect()] == [
        ("bad.pptx", 0), ("broken.pptx", 0), ("empty.pptx", 0), ("long.pptx", 12), ("none.pptx", 0), ("two.pptx", 3)]


def test_a_deck_is_written_and_read_a_slide_at_a_time(spark, tmp_path):
    from siltstone.plans import sources

    # presentations are files, not cells
    assert sources._decks(spark, "/root/testdata/sf0.001").columns == ["path", "file"]
    rng = random.Random(5)
    parts = ((n, rng.randbytes(20_000).hex(), "kind", 1) for n in range(1000))
    tracemalloc.start()
    with open(tmp_path / "d.pptx", "wb") as file:
        sources._deck(file, parts)
    with slides._opened(str(tmp_path / "d.pptx")) as archive:
        assert sum(len(s) for _, s in slides._slides(archive)) == 3000
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert (tmp_path / "d.pptx").stat().st_size > 20 << 20 and peak < 10 << 20


def test_reading_order_by_hand():
    assert slides.reading_order([(0.5, 0, 1, 0.2), (0, 0.05, 0.4, 0.2), None, (0, 0.5, 1, 1)]) == [2, 0, 1, 3]
    assert slides.reading_order([(0.5, 0, 1, 0.2), (0, 0, 0.4, 0.2), (0, 0.5, 1, 1)]) == [1, 0, 2]
    assert slides.reading_order([None, (0, 0, 1, 1), None]) == [0, 1, 2] and slides.reading_order([]) == []


def markdown_reader():
    def read(images):
        if any(b"bad" in x for x in images):
            raise ValueError("unreadable")
        return ["" if b"blank" in x else f"# {x.decode()}\n\nBody<bbox>0.1,0.1,0.5,0.5</bbox>" for x in images]

    return read


def test_dispatch_with_an_analyzer(spark):
    picture = '<p:pic><p:nvPicPr><p:cNvPr id="2" name="p"/></p:nvPicPr><p:blipFill><a:blip r:embed="rId1"/></p:blipFill></p:pic>'
    rels = "<Relationships><Relationship Id='rId1' Target='../media/image1.png'/></Relationships>"
    data = deck([shape("text") + picture], [("ppt/slides/_rels/slide1.xml.rels", rels), ("ppt/media/image1.png", b"inner")])
    rows = [("/a/d.pptx", data), ("/a/p.png", b"whole"), ("/a/q.JPG", b"bad"), ("/a/r.png", b"blank"), ("/a/s.xyz", b"?")]
    found = slides.analyzed(spark.createDataFrame(rows, "path string, content binary"), markdown_reader).collect()
    of = lambda path: sorted((r.region_type, r.content) for r in found if r.path == path and r.error is None and r.region_id)
    assert of("/a/p.png") == [("text", "Body"), ("title", "whole")]
    assert {("text", "text"), ("title", "inner"), ("text", "Body")} <= set(of("/a/d.pptx"))
    errors = {r.path: r.error for r in found if r.error}
    assert errors == {"/a/q.JPG": "ValueError: unreadable", "/a/r.png": "ValueError: no content", "/a/s.xyz": "ValueError: no analysis for this format"}


@pytest.fixture
def folder(tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "long.pptx").write_bytes(deck([shape(f"slide {n} " + "x" * 200) for n in range(1, 501)]))
    (tmp_path / "a.txt").write_text("one\ftwo\f\fé\f")
    (tmp_path / "sub/b.md").write_text("# m")
    (tmp_path / "blank.txt").write_text(" \f ")
    (tmp_path / "bad.docx").write_bytes(b"no zip")
    (tmp_path / "c.rows").write_text("r1\nr2")
    (tmp_path / "_hidden.txt").write_text("no")
    return tmp_path


def test_source_reads_page_ranges_in_many_tasks(spark, folder):
    documents.register(spark)
    size = (folder / "long.pptx").stat().st_size
    found = spark.read.format("documents").option("bytesPerTask", str(size // 20)).load(f"file://{folder}")
    deck_ = found.where("format = 'pptx'").withColumn("task", F.spark_partition_id()).collect()
    assert sorted(r.page_number for r in deck_) == list(range(1, 501)) and {r.n_pages for r in deck_} == {500}
    assert len({r.task for r in deck_}) >= 20 and all(r.content.startswith(f"slide {r.page_number} ") for r in deck_)
    rest = {(r.path.rsplit("/")[-1], r.page_number): r for r in found.where("format IS NULL OR format <> 'pptx'").collect()}
    assert [rest["a.txt", n].content for n in (1, 2, 3, 4)] == ["one", "two", "", "é"] and rest["b.md", 1].format == "markdown"
    assert rest["blank.txt", None].error == "ValueError: no content" and "BadZipFile" in rest["bad.docx", None].error
    assert rest["c.rows", None].error == "ValueError: no format for this suffix" and not any(k[0] == "_hidden.txt" for k in rest)
    assert found.where("path LIKE '%a.txt'").first().path == f"file://{folder}/a.txt"


def test_user_formats_come_last_and_filters_are_pushed(spark, folder):
    mine = documents.Format("rows", (".rows", ".txt"), lambda file: file.read().decode().split("\n"))
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        documents.register(spark, mine, name="my_documents")
        read = lambda: spark.read.format("my_documents").load(str(folder))
        assert [r.content for r in read().where("format = 'rows'").orderBy("page_number").collect()] == ["r1", "r2"]
        assert {r.format for r in read().where("path LIKE '%a.txt'").collect()} == {"text"}  # the given format wins
        some = read().where("format = 'pptx' AND page_number >= 10 AND page_number < 13")
        assert sorted(r.page_number for r in some.collect()) == [10, 11, 12]
        assert read().where(F.col("path") == f"{folder}/sub/b.md").first().content == "# m"
    finally:
        spark.conf.unset("spark.sql.python.filterPushdown.enabled")


def test_admission(spark):
    rows = [("a.png", b"\x89PNG\r\n\x1a\nrest", 9), ("b.png", b"GIF89a", 9), ("c.txt", "é".encode() * 600, 9), ("d.txt", b"a\x00b", 9), ("e.docx", b"PK\x03\x04", 9)]
    rows += [("f.pdf", b"%PDF-1", 9), ("g.webp", b"RIFF1234WEBPVP8 ", 9), ("h.exe", b"MZ", 9), ("i.md", b"", 0), ("j.jpg", b"\xff\xd8\xff", 200 << 20), ("k", b"x", 1)]
    found = {r.path: (r.status, r.error) for r in loaders.admitted(spark.createDataFrame(rows, "path string, content binary, length long")).collect()}
    bad = {k: v[1] for k, v in found.items() if v[0] == "failed"}
    assert bad == {"b.png": "content is not .png", "d.txt": "content is not .txt", "h.exe": "unsupported format: .exe", "j.jpg": "image too large", "k": "unsupported format: "}
    got = loaders.loaded(loaders.checked(spark.createDataFrame(rows[2:4], "path string, content binary, length long"))).collect()
    assert {r.path: r.error for r in got} == {"c.txt": None, "d.txt": "content is not .txt"}


def test_text_pages_are_read_one_at_a_time():
    data = "\f".join(["é" * 700_000, "", "b\n", "c"]).encode()

    class Reading(io.BytesIO):
        most = 0

        def read(self, n=-1):
            got = super().read(n)
            Reading.most = max(Reading.most, len(got))
            return got

    for tail, want in ((b"", 4), (b"\f", 4), (b"\f\f", 5)):
        pages = documents._text(Reading(data + tail))
        assert len(pages) == want and pages[3] == "c" and pages[0] == "é" * 700_000 and pages[1] == ""
        assert [pages[i] for i in range(want)] == (data + tail).decode().split("\f")[:want]
    assert Reading.most < 1_500_000 and [len(documents._text(io.BytesIO(x))) for x in (b"", b"\f", b"a")] == [1, 1, 1]
    with pytest.raises(UnicodeDecodeError):
        documents._text(io.BytesIO(b"ok\fbad \xff"))
