import glob
import math
import random
import re
from collections import Counter

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from siltstone.llm import lexical, words
from siltstone.llm.queries import op13_lexical_search

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(text):
    return [t.translate(FOLD) for t in TERM.findall(text or "")]


def brute(docs, items, k):
    """Rows (item, rank, doc, score) from the definition."""
    docs = [(i, Counter(t)) for i, x in docs if (t := terms(x))]
    n, total = len(docs), sum(c.total() for _, c in docs)
    df = Counter(t for _, c in docs for t in c)
    of = {}
    for i, x in items:
        of.setdefault(i, set()).update(terms(x))
    out = []
    for item, ts in of.items():
        scored = []
        for doc, c in docs:
            m = 50 + (50 * c.total() * n) // total
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 20 * m)) for t in ts if c[t])
            if score > 0:
                scored.append((-score, doc is not None, doc or 0, doc))
        out += [(item, r, x[3], -x[0]) for r, x in enumerate(sorted(scored)[:k], 1)]
    return sorted(out, key=repr)


def rows(df):
    return sorted((tuple(r) for r in df.select("item_id", "rank", "doc_id", "score").collect()), key=repr)


@pytest.mark.parametrize("block_bytes, window", [(1 << 20, 2048), (60, 7)])
def test_equals_brute_force(spark, block_bytes, window):
    rng = random.Random(3)
    vocabulary = [f"w{i}" for i in range(60)] + ["Été", "ÉTÉ", "naïve", "x_y", "a-b", "ſ", "K"]
    text = lambda n: " ".join(rng.choices(vocabulary, [1 / (i + 1) for i in range(len(vocabulary))], k=n))
    docs = [(i, text(rng.choice([0, 1, 5, 40, 200]))) for i in range(300)]
    docs += [(None, text(30)), (None, None), (4, docs[4][1]), (4, "other w1"), (900, None), (901, ""), (902, "., !"), (903, text(3000))]
    docs += [(1000 + i, "w3 w3 w50") for i in range(80)]
    items = [(i, text(rng.randint(1, 12))) for i in range(20)] + [(None, "w5 w6"), (3, "w59"), (50, None), (51, "--"), (52, "nowhere"), (53, "w3 w50")]
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumn("item_id", F.lit("clash")).withColumn("score", F.lit(1)).repartition(5)
    b = spark.createDataFrame(items, "item_id long, text string").withColumn("doc_id", F.lit("clash"))
    path = lexical.write_index(d, window=window)
    got = rows(lexical.ranked(spark, path, b, block_bytes=block_bytes))
    assert got == brute(docs, items, 50)
    assert rows(lexical.ranked(spark, path, b, k=3, salts=2)) == brute(docs, items, 3)


def test_windows(spark):
    docs = spark.createDataFrame([(i, f"a b{i % 3} " + "c " * i) for i in range(100)], "doc_id long, text string").coalesce(1)
    index = spark.read.parquet(lexical.write_index(docs, window=16))
    assert sorted(index.select(F.size("ids")).toPandas().iloc[:, 0]) == [4] + [16] * 6
    small = spark.read.parquet(lexical.write_index(docs, window_chars=50))
    assert small.count() > 40 and small.select(F.sum(F.size("ids"))).first()[0] == 100


def test_readers_decode_one_window_at_a_time(spark):
    docs = spark.createDataFrame([(i, f"a b{i % 3} " + "c " * i) for i in range(100)], "doc_id long, text string").coalesce(1)
    path = lexical.write_index(docs, window=16)
    groups = [pq.ParquetFile(f).metadata for f in glob.glob(f"{path.removeprefix('file://')}/*.parquet")]
    assert [m.row_group(i).num_rows for m in groups for i in range(m.num_row_groups)] == [1] * 7


def test_empty_tables(spark):
    docs, items = (spark.createDataFrame([], f"{c} long, text string") for c in ("doc_id", "item_id"))
    one = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    for d, b in ((docs, items), (docs, one), (one.withColumnRenamed("item_id", "doc_id"), items)):
        found = lexical.search(d, b)
        assert found.columns == ["item_id", "rank", "doc_id", "score"] and found.count() == 0


def test_string_ids_and_words_in_blocks(spark):
    docs = spark.createDataFrame([("b", "k k z"), ("a", "k k z"), (None, "k k z"), ("c", "q")], "doc_id string, text string")
    items = spark.createDataFrame([("i", "K")], "item_id string, text string")
    assert [r.doc_id for r in lexical.search(docs, items).orderBy("rank").collect()] == [None, "a", "b"]
    text = "Ab, é" * 1000 + "x" * 500
    assert [w for b in words.word_blocks(text, 64) for w in b] == [t.encode() for t in terms(text)]


def test_query_covers_every_item(spark):
    found = op13_lexical_search(spark, "/root/testdata/sf0.001")
    want = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet").count()
    assert found.select("item_id").distinct().count() == want
