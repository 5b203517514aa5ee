import numpy as np
from pyspark.sql import functions as F

from siltstone.operators import ingest
from siltstone.sources import exports, images


def test_encoder_and_scorer(spark):
    df = spark.createDataFrame([(1, "a b"), (2, "b a"), (3, ""), (4, None)], "id int, content string")
    got = {r.id: np.array(r.embedding) for r in ingest.encoded(df, lambda: ingest.hash_encoder(16), batch=2).collect()}
    assert np.allclose(got[1], got[2]) and abs(np.linalg.norm(got[1]) - 1) < 1e-6 and not got[3].any() and not got[4].any()
    pairs = ingest.scored(df.withColumnRenamed("content", "document"), lambda: lambda p: [float(len(b)) for _, b in p], F.lit("q")).collect()
    assert [r.rerank_score for r in pairs] == [3.0, 3.0, 0.0, 0.0]


def test_isolated(spark):
    df = spark.createDataFrame([(1, "4"), (2, "x")], "k int, v string")
    got = {r.k: (r.result, bool(r.error)) for r in ingest.isolated(df, lambda v: str(int(v) * 2), "v", "k").collect()}
    assert got == {1: ("8", False), 2: (None, True)}


def test_multivectors(spark):
    df = spark.createDataFrame([(1, [[1.0, 2.0], [3.0, 4.0]]), (2, [])], "id int, tokens array<array<double>>")
    got = ingest.multivector_rows(df).collect()
    assert [(r.id, r.embedding, r.num_vectors) for r in got] == [(1, [2.0, 3.0], 2)]


def bitmap(width, height, colour):
    row = bytes(colour[::-1]) * width + bytes(-3 * width % 4)
    data = row * height
    head = b"BM" + (54 + len(data)).to_bytes(4, "little") + bytes(4) + (54).to_bytes(4, "little")
    info = (40).to_bytes(4, "little") + width.to_bytes(4, "little") + height.to_bytes(4, "little") + b"\1\0\x18\0" + bytes(4) + len(data).to_bytes(4, "little") + bytes(16)
    return head + info + data


def test_images(spark, tmp_path):
    (tmp_path / "a.bmp").write_bytes(bitmap(30, 20, (200, 100, 50)))
    (tmp_path / "bad.bmp").write_bytes(b"nope")
    found = images.images(spark, f"file://{tmp_path}")
    r = images.statistics(found).first()
    assert (r.width, r.height, r.aspect_ratio, r.mean_r, r.mean_g, r.mean_b, r.std_r) == (30, 20, 1.5, 200, 100, 50, 0)
    assert images.grid_regions(found).count() == 0
    at = spark.range(1).select(images.patches(F.lit(250), F.lit(130), 100).alias("p")).first().p
    assert [(p.x, p.y) for p in at] == [(0, 0), (100, 0), (150, 0), (0, 30), (150, 30)]
    assert spark.range(1).select(images.patches(F.lit(50), F.lit(130), 100).alias("p")).first().p == []


def test_exports(spark, tmp_path):
    path = str(tmp_path / "s.json")
    assert exports.load_settings(path, {"a": 1}) == {"a": 1}
    exports.save_settings(path, {"a": 2})
    assert exports.load_settings(path, {"a": 1, "b": 3}) == {"a": 2, "b": 3}
    rows = [("x", True, 1.0, 3), ("x", False, 3.0, 0), ("y", True, 2.0, 1)]
    df = spark.createDataFrame(rows, "category string, success boolean, seconds double, n_results int")
    got = {r.category: (r.n_queries, r.succeeded, r.avg_seconds, r.n_results) for r in exports.query_report(df).collect()}
    assert got == {None: (3, 2, 2.0, 4), "x": (2, 1, 2.0, 3), "y": (1, 1, 2.0, 1)}
    exports.profile_export(df, f"file://{tmp_path}/out", "csv")
    assert spark.read.option("header", True).csv(f"file://{tmp_path}/out").count() == 3
    tables = spark.createDataFrame([(1, "r", "table", "c", "m", "h", 1, 2), (1, "q", "table", "c", "m", "h", 0, 2)], "doc_id int, region_id string, region_type string, content string, markdown string, table_html string, table_rows int, table_cols int")
    exports.table_files(tables, f"file://{tmp_path}/tables")
    assert spark.read.json(f"file://{tmp_path}/tables").count() == 1
