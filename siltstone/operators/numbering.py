"""Dense row numbers within groups of any size.

A window over a group sorts it in one task.  Here each group is cut at
approximate quantiles of its order column; exact counts of the pieces give
offsets, and rows are numbered within their piece.  Where the cuts fall does not change a number.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def dense_numbers(df: DataFrame, by: str, order: str, tie: str, name: str = "n", pieces: int = 128) -> DataFrame:
    """``df`` with the rank (from 0) of each row in its group by (``order``, ``tie``); ``order`` is numeric."""
    cuts = F.percentile_approx(order, F.array(*[F.lit(i / pieces) for i in range(1, pieces)]), F.lit(10_000))
    bounds = df.groupBy(by).agg(cuts.alias("__cuts")).withColumnRenamed(by, "__group")
    cut = df.join(bounds, F.col(by).eqNullSafe(F.col("__group"))).withColumn(
        "__piece", F.size(F.filter(F.coalesce("__cuts", F.array().cast("array<double>")), lambda c: c < F.col(order)))
    )
    # at most ``pieces`` rows a group
    counts = cut.groupBy(F.col("__group"), "__piece").agg(F.count(F.lit(1)).alias("__rows"))
    before = Window.partitionBy("__group").orderBy("__piece").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(
        F.col("__group").alias("__g"), F.col("__piece").alias("__p"), F.coalesce(F.sum("__rows").over(before), F.lit(0)).alias("__offset")
    )
    inside = F.row_number().over(Window.partitionBy("__group", "__piece").orderBy(order, tie)) - 1
    ranked = cut.withColumn("__inside", inside)
    same = F.col("__group").eqNullSafe(F.col("__g")) & (F.col("__piece") == F.col("__p"))
    return ranked.join(offsets, same).select(*[F.col(c) for c in df.columns], (F.col("__offset") + F.col("__inside")).alias(name))


def with_lookback(df: DataFrame, number: str, rows: int, chunk: int = 100_000) -> DataFrame:
    """Numbered rows with their chunk, and copies (``halo``) of a chunk's last ``rows`` rows in the next one.

    A window over (group, chunk) then sees up to ``rows`` rows before each of its own.
    """
    own = F.floor(F.col(number) / chunk)
    late = F.col(number) % chunk >= chunk - rows
    places = F.when(late, F.array(F.struct(own.alias("chunk"), F.lit(False).alias("halo")), F.struct((own + 1).alias("chunk"), F.lit(True).alias("halo"))))
    places = places.otherwise(F.array(F.struct(own.alias("chunk"), F.lit(False).alias("halo"))))
    return df.withColumn("__place", F.explode(places)).select("*", "__place.chunk", "__place.halo").drop("__place")
