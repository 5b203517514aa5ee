"""Running values within groups of any size.

A window over a group sorts and holds it in one task.  Here the rows are dealt by ranges of (group, order), so
a large group lies in many partitions, and every partition is cut into pieces of a fixed number of rows.  Windows run
inside (group, piece); what comes before a piece is one row of carried state for each (group, piece), found from
the pieces' totals.  Rows are shuffled twice, by range and by (group, piece), and the state joins them where they lie.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from siltstone.sources.scratch import written

PIECE, SEQ, GROUP = "__piece", "__seq", "__group"
KEYS = [GROUP, PIECE]


def in_pieces(df: DataFrame, by: str, order: Sequence[str], rows: int = 65_536) -> DataFrame:
    """``df`` with its place in the order of (``by``, ``order``) and the piece of ``rows`` rows (a power of two) at most that holds it.

    Written once, so that places stay.  The group is a struct, so that null is a group like any other and rows are dealt
    the same way for windows and joins.
    """
    keys = [by, *order]
    dealt = df.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn(SEQ, F.monotonically_increasing_id())
    # a partition's numbers start at a multiple of 2**33, so no piece spans two partitions
    placed = written(dealt.withColumn(PIECE, F.shiftright(SEQ, rows.bit_length() - 1)), "pieces")
    return placed.withColumn(GROUP, F.struct(by))


def totals(placed: DataFrame, **aggregates: Column) -> DataFrame:
    """One row of aggregates for each (group, piece)."""
    return placed.groupBy(*KEYS).agg(*[c.alias(n) for n, c in aggregates.items()])


def earlier() -> WindowSpec:
    """Over totals: all pieces of the group before the present one."""
    return Window.partitionBy(GROUP).orderBy(PIECE).rowsBetween(Window.unboundedPreceding, -1)


def within() -> tuple[WindowSpec, WindowSpec]:
    """Windows over the rows of a (group, piece): all up to the present one, and the order alone."""
    w = Window.partitionBy(*KEYS).orderBy(SEQ)
    return w.rowsBetween(Window.unboundedPreceding, 0), w


def numbered(df: DataFrame, by: str, order: Sequence[str], name: str = "n", rows: int = 65_536) -> DataFrame:
    """``df`` with the number (from 0) of each row in its group; ``order`` may be of any sortable types."""
    placed = in_pieces(df, by, order, rows)
    state = totals(placed, __rows=F.count(F.lit(1))).select(*KEYS, F.coalesce(F.sum("__rows").over(earlier()), F.lit(0)).alias("__first"))
    inside = F.row_number().over(within()[1]) - 1
    return placed.withColumn("__inside", inside).join(state, KEYS).select(*df.columns, (F.col("__first") + F.col("__inside")).alias(name))
