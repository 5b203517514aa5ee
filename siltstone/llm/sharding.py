"""Rendezvous hashing of record keys over weighted shards, native Spark expressions only.

Each (key, shard) pair gets a uniform number u; the record goes to the shard
with the smallest ``-ln(u) / weight``.  Another shard only adds a competitor, so
records move into it and nowhere else.

Slots number the records of a shard without gaps.  No task ever sorts a whole
shard: records fall into ``buckets`` buckets per shard by a hash of key, size and CRC, so that a key
with many texts spreads; a small table of bucket counts gives offsets.  Equal records are counted
before the shuffle and numbered as one row; they are expanded in pieces of at most ``piece`` slots, which
are dealt anew, so a record repeated in a third of all rows fills no task of its own.

Defined results: a null key hashes as a value of its own; a null or empty text has size
1 and CRC 0; very long texts are measured whole; equal costs go to the smaller shard number;
repeated rows land in one shard at different slots; an empty table gives an empty result; other columns
are never read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def rendezvous(key: Column, weights: Sequence[float]) -> Column:
    """Shard number (int) of a string key among ``len(weights)`` weighted shards."""
    if not weights or min(weights) <= 0:
        raise ValueError("weights must be positive")
    costs = []
    for shard, weight in enumerate(weights):
        draw = F.shiftrightunsigned(F.xxhash64(key, F.lit(shard)), 11)
        uniform = (draw.cast("double") + F.lit(0.5)) * F.lit(2.0**-53)
        costs.append(F.struct((-F.ln(uniform) / F.lit(float(weight))).alias("cost"), F.lit(shard).alias("shard")))
    best = costs[0] if len(costs) == 1 else F.least(*costs)
    return best["shard"]


def assign_shards(
    df: DataFrame,
    weights: Sequence[float] = (1.0,) * 8,
    grown_weight: float = 1.0,
    id_col: str = "doc_id",
    text_col: str = "text",
    buckets: int = 1024,
    piece: int = 4096,
) -> DataFrame:
    """One row per record: id, size, text_crc32, law, shard, slot, grown_shard."""
    key = F.coalesce(F.concat(F.lit("k"), F.col("id").cast("string")), F.lit("null"))
    base = df.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    measured = base.select(
        "id", key.alias("key"),
        (F.octet_length("text").cast("long") + 1).alias("size"),
        F.crc32(F.col("text").cast("binary")).alias("text_crc32"),
    )
    record = ["key", "size", "text_crc32"]
    placed = measured.withColumn("shard", rendezvous(F.col("key"), weights))
    placed = placed.withColumn("bucket", F.pmod(F.xxhash64(*record), F.lit(buckets)).cast("int"))
    # at most len(weights) * buckets rows: its size does not follow the input
    counts = placed.groupBy("shard", "bucket").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("shard", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    equal = placed.groupBy("shard", "bucket", "id", *record).agg(F.count(F.lit(1)).alias("n"))
    inside = Window.partitionBy("shard", "bucket").orderBy(*record).rowsBetween(Window.unboundedPreceding, -1)
    ranked = equal.withColumn("first", F.coalesce(F.sum("n").over(inside), F.lit(0)))
    numbered = ranked.join(F.broadcast(offsets), ["shard", "bucket"])
    numbered = numbered.withColumn("piece", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / piece))))
    dealt = numbered.repartition("shard", "bucket", "piece")
    low = F.col("piece") * piece
    high = F.least(low + piece, "n") - 1
    return dealt.select(
        F.col("id").alias(id_col), "size", "text_crc32",
        F.lit("key").alias("law"), "shard",
        F.explode(F.sequence(F.col("offset") + F.col("first") + low, F.col("offset") + F.col("first") + high)).alias("slot"),
        rendezvous(F.col("key"), [*weights, grown_weight]).alias("grown_shard"),
    )
