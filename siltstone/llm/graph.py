"""Connected components of an edge list, by alternating large and small stars.

Each round hangs the larger neighbours of a node on its smallest one, then the
smaller ones, until the edge list is a set of stars.  Labels only ever get smaller, so it ends; rounds grow
with the logarithm of a component's size.  Each is written to the shared folder, and the one before it removed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.llm.common import discard, stored


def _digest(edges: DataFrame) -> tuple[int, int]:
    row = edges.agg(
        F.count(F.lit(1)), F.coalesce(F.bit_xor(F.xxhash64("src", "dst")), F.lit(0))
    ).first()
    return int(row[0]), int(row[1])


def component_stars(edges: DataFrame) -> DataFrame:
    """(src, dst) with dst the smallest node of src's component; roots have no row.

    ``edges`` are undirected pairs (src, dst) of longs; loops and repeats are fine.
    """
    now = edges.select(F.greatest("src", "dst").alias("src"), F.least("src", "dst").alias("dst"))
    now = stored(now.where("src <> dst").distinct(), "edges")
    before = _digest(now)
    while before[0]:
        both = now.unionByName(now.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
        low = both.groupBy("src").agg(F.min("dst").alias("low"))
        low = low.select("src", F.least("src", "low").alias("low"))
        large = both.join(low, "src").where("dst > src").select(F.col("dst").alias("src"), F.col("low").alias("dst"))
        large = stored(large.where("src <> dst").distinct(), "large")
        low = large.groupBy("src").agg(F.min("dst").alias("low"))
        hung = large.join(low, "src").select(F.col("dst").alias("src"), F.col("low").alias("dst")).where("src <> dst")
        old, now = now, stored(hung.unionByName(low.withColumnRenamed("low", "dst")).distinct(), "small")
        discard(old)
        discard(large)
        after = _digest(now)
        if after == before:
            break
        before = after
    return now
