"""Processing metrics: summaries, groups, histories, trends, benchmark comparisons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltstone.operators import scans
from siltstone.operators.numbering import dense_numbers, with_lookback


def summary(events: DataFrame, duration: str = "duration", success: str = "success") -> DataFrame:
    """Totals, success rate in percent, and the mean of successful durations that are not null and not 0."""
    good = F.col(success) & (F.col(duration) != 0)
    return events.agg(
        F.count(F.lit(1)).alias("total"), F.count_if(F.col(success)).alias("succeeded"), F.count_if(~F.col(success)).alias("failed"),
        F.round(F.count_if(F.col(success)) * 100.0 / F.nullif(F.count(F.lit(1)), F.lit(0)), 2).alias("success_rate"),
        F.round(F.avg(F.when(good, F.col(duration))), 2).alias("avg_duration"),
    )


def performance(events: DataFrame, by: str, duration: str = "duration", success: str = "success") -> DataFrame:
    """Count, mean, least and largest duration of successes by a column."""
    return events.where(F.col(success)).groupBy(by).agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg(duration), 2).alias("avg_duration"),
        F.round(F.min(duration), 2).alias("min_duration"), F.round(F.max(duration), 2).alias("max_duration"),
    )


def performance_sets(events: DataFrame, first: str, second: str, duration: str = "duration") -> DataFrame:
    """The groups of two columns in one pass over the events."""
    return events.groupingSets([[first], [second]], first, second).agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg(duration), 2).alias("avg_duration")
    )


def counters(events: DataFrame, megabytes: str, success: str = "success") -> DataFrame:
    return events.agg(
        F.count_if(F.col(success)).alias("processed"), F.count_if(~F.col(success)).alias("failed"),
        F.sum((F.col(megabytes) * 1048576).cast("bigint")).alias("bytes"),
    )


def recent(events: DataFrame, n: int, at: str = "ts", key: str = "event_id") -> DataFrame:
    """The last ``n`` events; order them by time for display."""
    return events.orderBy(F.desc(at), F.desc(key)).limit(min(n, 100))


def bounded_history(events: DataFrame, n: int, by: str, at: str = "ts", key: str = "event_id") -> DataFrame:
    """The last ``n`` events of each group."""
    back = F.row_number().over(Window.partitionBy(by).orderBy(F.desc(at), F.desc(key)))
    return events.withColumn("back", back).where(F.col("back") <= n)


def trend(events: DataFrame, by: str, value: str, order: str, chunk: int = 100_000) -> DataFrame:
    """Mean of the last three against the three before: up over 1.1, down under 0.9.

    Groups are cut into chunks that see five rows back, so no task sorts a whole group.
    """
    placed = with_lookback(dense_numbers(events, by, order, order, "__n"), "__n", 5, chunk)
    w = Window.partitionBy(by, "chunk").orderBy("__n")
    now, before = F.avg(value).over(w.rowsBetween(-2, 0)), F.avg(value).over(w.rowsBetween(-5, -3))
    ratio = F.when(F.col("__n") >= 5, F.col("recent_mean") / F.nullif(F.col("previous_mean"), F.lit(0)))
    change = F.when(ratio > 1.1, "up").when(ratio < 0.9, "down").otherwise("same")
    meant = placed.withColumn("recent_mean", now).withColumn("previous_mean", before).where(~F.col("halo"))
    return meant.withColumn("trend", change).drop("__n", "chunk", "halo")


def next_batch_size(size: Column, change: Column) -> Column:
    """A quarter more when throughput rises, a quarter less when it falls, within 1 and 1024."""
    grown, cut = F.least(F.floor(size * 1.25), F.lit(1024)), F.greatest(F.floor(size * 0.75), F.lit(1))
    return F.when(change == "up", grown).when(change == "down", cut).otherwise(size).cast("int")


def adaptive_sizes(throughputs: Column, first: int = 32, every: int = 5) -> Column:
    """Batch sizes in use after each batch: re-evaluated every ``every`` batches from the last six throughputs."""
    mean = lambda a, start: F.aggregate(F.slice(a, start, F.lit(3)), F.lit(0.0), lambda acc, x: acc + x) / 3

    def step(acc: Column, i: Column) -> Column:
        seen = F.slice(throughputs, F.greatest(i - 5, F.lit(1)), F.least(i, F.lit(6)))
        ratio = F.when((i % every == 0) & (F.size(seen) == 6), mean(seen, F.lit(4)) / F.nullif(mean(seen, F.lit(1)), F.lit(0.0)))
        change = F.when(ratio > 1.1, "up").when(ratio < 0.9, "down").otherwise("same")
        return F.concat(acc, F.array(next_batch_size(F.element_at(acc, -1), change)))

    return F.aggregate(F.sequence(F.lit(1), F.size(throughputs)), F.array(F.lit(first)), step, lambda acc: F.slice(acc, F.lit(2), F.size(acc)))


def gap_groups(df: DataFrame, by: str, position: str, gap: float, tie: str, rows: int = 65_536) -> DataFrame:
    """Number of the run each row belongs to; a step over ``gap`` starts a new one.

    A piece of a group carries on with the run and the position that the pieces before it end with.
    """
    over = lambda before: F.coalesce((F.col(position) - before > gap).cast("int"), F.lit(0))
    sofar, inside = scans.within()
    placed = scans.in_pieces(df, by, [position, tie], rows)
    runs = placed.withColumn("__starts", over(F.lag(position).over(inside))).withColumn("__run", F.sum("__starts").over(sofar))
    each = scans.totals(runs, __runs=F.sum("__starts"), __head=F.min_by(position, scans.SEQ), __last=F.max_by(position, scans.SEQ))
    # whether the first row of a piece starts a run is decided by the row before the piece
    order = Window.partitionBy(scans.GROUP).orderBy(scans.PIECE)
    joint = F.coalesce((F.col("__head") - F.lag("__last").over(order) > gap).cast("int"), F.lit(0))
    state = each.withColumn("__joint", joint).select(
        *scans.KEYS,
        (F.coalesce(F.sum("__runs").over(scans.earlier()), F.lit(0)) + F.sum("__joint").over(order.rowsBetween(Window.unboundedPreceding, 0))).alias("__before"),
    )
    return runs.join(state, scans.KEYS).select(*df.columns, (F.col("__before") + F.col("__run")).alias("gap_group"))


def fixed_batches(df: DataFrame, by: str, order: str, size: int) -> DataFrame:
    """Batches of ``size`` rows in order within each group."""
    numbered = dense_numbers(df, by, order, order, "__n")
    return numbered.withColumn("batch_number", F.floor(F.col("__n") / size).cast("int")).drop("__n")


def slowest(df: DataFrame, value: str, n: int = 5, key: str = "name") -> DataFrame:
    return df.orderBy(F.desc(value), key).limit(n)


def extremes(df: DataFrame, by: str, duration: str, size: str) -> DataFrame:
    """Fastest name, name with most content, and name with most content per second."""
    return df.agg(
        F.min_by(by, duration).alias("fastest"), F.max_by(by, size).alias("most_content"),
        F.max_by(by, F.col(size) / F.col(duration)).alias("most_efficient"),
    )


def against_baseline(df: DataFrame, by: str, baseline: str, value: str) -> DataFrame:
    """Every row with its ratio to the baseline's value; the baseline is one aggregated row."""
    base = df.agg(F.max(F.when(F.col(by) == baseline, F.col(value))).alias("baseline"))
    return df.join(F.broadcast(base)).withColumn("ratio", F.col(value) / F.col("baseline"))


def paired(starts: DataFrame, ends: DataFrame, key: str = "task_id") -> DataFrame:
    """Starts with their ends; an end without a start is dropped, a start without an end stays open."""
    return starts.join(ends, key, "left")


def benchmark_summary(runs: DataFrame) -> DataFrame:
    """Means of duration, pages, regions and grounded regions, with documents a minute and pages a second."""
    seconds, pages = F.sum("seconds"), F.sum("pages")
    return runs.agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg("seconds"), 4).alias("avg_seconds"), F.round(F.avg("pages"), 4).alias("avg_pages"),
        F.round(F.avg("regions"), 4).alias("avg_regions"), F.round(F.avg("grounded"), 4).alias("avg_grounded"),
        F.round(F.count(F.lit(1)) * 60 / seconds, 4).alias("docs_per_minute"), F.round(pages / seconds, 4).alias("pages_per_second"),
    )


def queue_stats(jobs: DataFrame, states: tuple[str, ...] = ("queued", "started", "finished", "failed")) -> DataFrame:
    """Jobs of each queue by state, zeros included."""
    return jobs.groupBy("queue").agg(*[F.count_if(F.col("state") == s).alias(s) for s in states])


def progress(df: DataFrame, by: str, order: str, seconds: str, rows: int = 65_536) -> DataFrame:
    """Running share done and remaining seconds at the mean pace so far; rows without seconds count as done."""
    sofar = scans.within()[0]
    sums = {"rows": F.count(F.lit(1)), "timed": F.count(seconds), "seconds": F.sum(seconds)}
    placed = scans.in_pieces(df, by, [order], rows)
    each = scans.totals(placed, **sums)
    before = [F.sum(n).over(scans.earlier()).alias(f"__{n}_before") for n in sums]
    state = each.select(*scans.KEYS, *before, F.sum("rows").over(Window.partitionBy(scans.GROUP)).alias("__total"))
    met = placed.select("*", *[c.over(sofar).alias(f"__{n}") for n, c in sums.items()]).join(state, scans.KEYS)
    rows_, timed, spent = (F.coalesce(f"__{n}_before", F.lit(0)) + F.coalesce(f"__{n}", F.lit(0)) for n in sums)
    pace = spent / F.nullif(timed, F.lit(0))
    return met.select(*df.columns, rows_.alias("done"), (rows_ / F.col("__total")).alias("share"), (pace * (F.col("__total") - rows_)).alias("eta"))
