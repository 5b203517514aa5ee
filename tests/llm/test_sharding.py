import math
import zlib

import xxhash

from siltstone.llm import sharding


def test_shards_and_slots(spark):
    rows = [(n, f"text {n} é") for n in range(500)] + [(7, "same")] * 200 + [(None, None), (None, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS shard", "2 AS n", "3 AS key")
    got = sharding.assign_shards(df, buckets=16).collect()
    assert len(got) == len(rows)
    by_shard, by_id = {}, {}
    for r in got:
        by_shard.setdefault(r.shard, []).append(r.slot)
        by_id.setdefault(r.doc_id, set()).add((r.shard, r.grown_shard))
        assert r.grown_shard in (r.shard, 8) and r.law == "key"
    assert all(sorted(s) == list(range(len(s))) for s in by_shard.values()) and len(by_shard) == 8
    assert all(len(s) == 1 for s in by_id.values())
    want = sorted((d if d is not None else -1, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for d, t in rows)
    assert sorted((r.doc_id if r.doc_id is not None else -1, r["size"], r.text_crc32) for r in got) == want
    moved = sum(r.grown_shard == 8 for r in got if r.doc_id != 7)
    assert 20 < moved < 110
    assert sharding.assign_shards(df.limit(0)).count() == 0


def test_weights(spark):
    df = spark.range(4000).selectExpr("id AS doc_id", "'' AS text")
    got = {r["shard"]: r["count"] for r in sharding.assign_shards(df, (1.0, 3.0)).groupBy("shard").count().collect()}
    assert 800 < got[0] < 1200 and got[0] + got[1] == 4000


def winner(key, weights):
    """The shard of smallest cost, from the hash's definition."""
    word = b"null" if key is None else b"k" + str(key).encode()
    first = xxhash.xxh64_intdigest(word, 42)
    draws = [xxhash.xxh64_intdigest(n.to_bytes(4, "little"), first) >> 11 for n in range(len(weights))]
    return min((-math.log((u + 0.5) * 2.0**-53) / w, n) for n, (u, w) in enumerate(zip(draws, weights, strict=True)))[1]


def test_winning_shard_matches_brute_force(spark):
    ids = [*range(-300, 300), None, 1 << 62]
    df = spark.createDataFrame([(i, "x") for i in ids], "doc_id long, text string")
    for weights in ((1.0,) * 8, (1.0, 2.5, 0.5)):
        for r in sharding.assign_shards(df, weights, 2.0).collect():
            assert r.shard == winner(r.doc_id, weights) and r.grown_shard == winner(r.doc_id, (*weights, 2.0))


def test_hot_keys_spread(spark):
    """A third of ids null with differing texts, a third one and the same row: no task holds over twice the mean."""
    df = spark.range(30_000).selectExpr("CASE WHEN id % 3 = 0 THEN NULL WHEN id % 3 = 1 THEN 5 ELSE id END AS doc_id", "CASE WHEN id % 3 = 1 THEN 'same' ELSE concat('t', id) END AS text")
    out = sharding.assign_shards(df, piece=64)
    assert out.groupBy("shard", "slot").count().where("count > 1").isEmpty()
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        sizes = [r["count"] for r in sharding.assign_shards(df, piece=64).selectExpr("spark_partition_id() AS p").groupBy("p").count().collect()]
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert sum(sizes) == 30_000 and max(sizes) < 2 * 30_000 / 4


def test_very_long_text(spark):
    long = "é" * 3_000_000
    row = sharding.assign_shards(spark.createDataFrame([(1, long)], "doc_id long, text string")).first()
    assert row["size"] == 6_000_001 and row.text_crc32 == zlib.crc32(long.encode()) and row.slot == 0
