import os
from concurrent.futures import ThreadPoolExecutor

import pytest
from pyspark.sql import functions as F

from siltstone.sources import scratch
from siltstone.sources.collections import CollectionStore


def rows(spark, ids, document="d"):
    return spark.createDataFrame([(str(i), [float(i), 1.0], f"{document}{i}") for i in ids], "id string, embedding array<float>, document string")


def ids(spark, values):
    return spark.createDataFrame([(str(v),) for v in values], "id string")


def files(root):
    return sorted(os.path.join(d, f) for d, _, names in os.walk(root) for f in names if f.endswith(".parquet"))


@pytest.fixture
def store(spark, tmp_path):
    made = CollectionStore(spark, f"file://{tmp_path}")
    made.create("c", 2)
    return made


def test_a_delete_writes_bitmaps_only(spark, store, tmp_path):
    store.add("c", rows(spark, range(100)).coalesce(1))
    before = files(tmp_path / "c/data")
    assert store.delete("c", ids(spark, [7])) == 2
    assert files(tmp_path / "c/data") == before
    (bitmap,) = spark.read.parquet(f"file://{tmp_path}/c/vectors/*").collect()
    assert len(bitmap.bits) == 4096 and bitmap.file == os.path.basename(before[0])
    assert store.snapshot("c").vectors and {int(r.id) for r in store.read("c").collect()} == set(range(100)) - {7}
    # what is not there changes nothing, not even the version
    assert store.delete("c", ids(spark, [7, 1000])) == 2 and store.update("c", rows(spark, [7])) == 2


def test_bitmaps_of_large_files(spark, store):
    n = 100_000
    many = spark.range(n).select(F.col("id").cast("string"), F.array(F.lit(0.0), F.lit(1.0)).alias("embedding"), F.lit("x").alias("document"))
    store.add("c", many.coalesce(1))
    gone = [0, 1, 7, 8, 32767, 32768, 32769, 65535, 65536, n - 1]
    store.delete("c", ids(spark, gone[:5]))
    store.delete("c", ids(spark, gone[5:]))
    assert store.snapshot("c").rows() == n - len(gone) == store.read("c").count()
    left = store.read("c").select("id").join(ids(spark, gone), "id", "left_semi")
    assert left.count() == 0
    small = CollectionStore(spark, store.root, broadcast_bytes=0)  # joined by shuffling
    assert small.read("c").count() == n - len(gone)


def test_updates_and_versions(spark, store):
    store.add("c", rows(spark, range(10)))
    store.update("c", spark.createDataFrame([("3", "new"), ("4", None)], "id string, document string"))
    store.update("c", spark.createDataFrame([("3", [9.0, 9.0])], "id string, embedding array<float>"))
    got = {r.id: r for r in store.read("c").collect()}
    assert len(got) == 10 and got["3"].document == "new" and got["3"].embedding == [9, 9] and got["4"].document == "d4"
    assert {r.id: r.document for r in store.read("c", 1).collect()}["3"] == "d3" and store.read("c", 0).count() == 0
    with pytest.raises(ValueError):
        store.update("c", spark.createDataFrame([("3", "a"), ("3", "b")], "id string, document string"))
    with pytest.raises(Exception, match="need 2 dimensions"):
        store.add("c", spark.createDataFrame([("x", [1.0])], "id string, embedding array<float>"))
    assert store.read("c").count() == 10


def test_compaction_and_vacuum(spark, store, tmp_path):
    store.add("c", rows(spark, range(20)))
    store.delete("c", ids(spark, range(5)))
    store.configure("c", a="1", b="2")
    store.configure("c", b=None)
    version = store.compact("c")
    state = store.snapshot("c")
    assert (state.version, len(state.data), state.vectors, state.rows(), state.config) == (version, 1, {}, 15, {"a": "1"})
    store.add("c", rows(spark, [100]))
    assert store.read("c").count() == 16 and store.read("c", 1).count() == 20
    assert store.validate().count() == 0
    assert store.vacuum("c") == 0 and store.vacuum("c", hours=0) == 2 and store.read("c").count() == 16
    folder = next(iter(store.snapshot("c").data))
    os.rename(tmp_path / "c/data" / folder, tmp_path / "elsewhere")
    assert [(r.part, r.problem) for r in store.validate("c").collect()] == [(f"data/{folder}", "missing")]


def test_append_during_compaction(spark, store):
    store.add("c", rows(spark, range(10)))
    store.delete("c", ids(spark, [1]))
    other, write = CollectionStore(spark, store.root), store._write_rows
    once = []

    def slow(name, df):
        made = write(name, df)
        if not once:
            once.append(other.add("c", rows(spark, [50])))
        return made

    store._write_rows = slow
    store.compact("c")
    assert {int(r.id) for r in store.read("c").collect()} == {0, *range(2, 10), 50}
    # a delete meanwhile makes it start again
    once.clear()
    other.add = lambda *_: other.delete("c", ids(spark, [50]))
    store.compact("c")
    assert {int(r.id) for r in store.read("c").collect()} == {0, *range(2, 10)} and not store.snapshot("c").vectors


def test_concurrent_writers_lose_nothing(spark, store):
    store.add("c", rows(spark, range(40)))

    def work(n):
        own = CollectionStore(spark, store.root)
        own.add("c", rows(spark, [100 + n]))
        own.delete("c", ids(spark, [n]))
        own.update("c", spark.createDataFrame([(str(20 + n), f"by {n}")], "id string, document string"))

    with ThreadPoolExecutor(4) as pool:
        list(pool.map(work, range(4)))
    got = {int(r.id): r.document for r in store.read("c").collect()}
    assert set(got) == {*range(4, 40), *range(100, 104)} and all(got[20 + n] == f"by {n}" for n in range(4))
    assert store.snapshot("c").version == 13 and store.snapshot("c").rows() == len(got)


def test_create_once_and_again(spark, store):
    with pytest.raises(ValueError):
        store.create("c", 2)
    with pytest.raises(ValueError):
        store.create("d", 2, "odd")
    store.add("c", rows(spark, [1]))
    store.drop("c")
    with pytest.raises(KeyError):
        store.read("c")
    assert store.list().count() == 0
    store.create("c", 3, "l2")
    assert store.read("c").count() == 0 and store.list().first().dimension == 3
    with ThreadPoolExecutor(4) as pool:
        made = list(pool.map(lambda i: scratch.put_if_absent(spark, f"{store.root}/once.json", str(i)), range(8)))
    assert sum(made) == 1
    with open(store.root.removeprefix("file://") + "/once.json") as f:
        assert f.read() == str(made.index(True))


def test_put_if_absent_beyond_local_files(spark, tmp_path):
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    conf.set("fs.viewfs.mounttable.far.link./x", f"file://{tmp_path}")
    assert scratch.put_if_absent(spark, "viewfs://far/x/a/1.json", "one")
    assert not scratch.put_if_absent(spark, "viewfs://far/x/a/1.json", "two")
    assert (tmp_path / "a/1.json").read_text() == "one"
