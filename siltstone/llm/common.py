"""Shared plumbing: durable intermediate tables and Arrow batch helpers."""

from __future__ import annotations

import ctypes
import gc
import os
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructField, StructType, _parse_datatype_string


#: What a Python worker remembers between tasks, by operator: how to forget it.
_HELD: dict[str, Callable[[], None]] = {}


def hold(operator: str, forget: Callable[[], None]) -> None:
    """Keep one operator's memory in a worker; what others left from earlier stages goes, back to the system."""
    others = [x for x in _HELD if x != operator]
    for other in others:
        _HELD.pop(other)()
    _HELD[operator] = forget
    if others:
        gc.collect()
        pa.default_memory_pool().release_unused()
        # what the C library keeps for later; only glibc has this
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
        if trim is not None:
            trim(0)


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir`` of the session.

    Only a single-machine session without that setting gets a folder of its own.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    own = "file://" + tempfile.mkdtemp(prefix="siltstone-")
    spark.conf.set("spark.checkpoint.dir", own)
    return own


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder, removed when the JVM closes."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(target)
    return path


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and reread it.

    The copy cuts the lineage and outlives any executor.
    """
    spark = df.sparkSession
    path = shared_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Remove the files of a ``stored`` table that nothing reads any more."""
    spark = df.sparkSession
    for name in {os.path.dirname(f) for f in df.inputFiles()}:
        target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def spread_join(rows: DataFrame, decided: DataFrame, keys: list[str], n: str = "n", share: int = 1024, how: str = "inner") -> DataFrame:
    """``rows`` joined to the one row per key of ``decided``, whose column ``n`` says how many of the rows have the key.

    Keys with over a ``share``-th of all rows, fewer than ``share``, are dealt in pieces of about that many rows.
    ``decided`` is read three times and should be a stored table.
    """
    total = decided.agg(F.coalesce(F.sum(n), F.lit(0))).first()[0]
    pieces = F.ceil(F.col(n) * share / F.lit(max(total, 1))).cast("long")
    hot = decided.where(F.col(n) * share > total).select(*keys, pieces.alias("__pieces"))
    # without hot keys the stored table is joined as it is, and broadcast if its size is small
    if hot.isEmpty():
        return rows.join(decided.drop(n), keys, how)
    many = F.coalesce("__pieces", F.lit(1).cast("long"))
    dealt = rows.join(F.broadcast(hot), keys, "left").withColumn("__piece", F.pmod(F.monotonically_increasing_id(), many)).drop("__pieces")
    copies = decided.drop(n).join(F.broadcast(hot), keys, "left").withColumn("__piece", F.explode(F.sequence(F.lit(0).cast("long"), many - 1)))
    return dealt.join(stored(copies.drop("__pieces"), "copies"), [*keys, "__piece"], how).drop("__piece")


def slices(batch: pa.RecordBatch, text_col: str, budget: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Cut an Arrow batch into runs of at most ``budget`` text bytes (one row at least)."""
    sizes = batch.column(text_col)
    lengths = pa.compute.fill_null(pa.compute.binary_length(sizes), 0).to_pylist()
    start = total = 0
    for i, n in enumerate(lengths):
        if i > start and total + n > budget:
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += n
    if start < batch.num_rows:
        yield batch.slice(start)


def pieces(batches: Iterator[pa.RecordBatch], text_col: str, budget: int) -> Iterator[pa.RecordBatch]:
    """Arrow batches cut, and joined if the budget is larger than they are, to about ``budget`` text bytes."""
    if budget <= 4 << 20:
        for batch in batches:
            yield from slices(batch, text_col, budget)
        return
    held, total = [], 0
    for batch in batches:
        for part in slices(batch, text_col):
            held.append(part)
            total += part.column(text_col).nbytes
            if total >= budget:
                yield pa.concat_batches(held)
                held, total = [], 0
    if held:
        yield pa.concat_batches(held)


def per_document(
    df: DataFrame,
    id_col: str,
    text_col: str,
    schema: str,
    run: Callable[[list[str]], dict[str, list]],
    budget: int = 4 << 20,
) -> DataFrame:
    """Apply ``run`` to the texts of bounded slices; its lists become columns beside the id.

    ``schema`` names the produced columns in order, as DDL; the id keeps its type.
    """
    kept = df.select(df[id_col].alias("id"), df[text_col].cast("string").alias("text"))
    out = StructType([StructField(id_col, df.schema[id_col].dataType), *_parse_datatype_string(schema).fields])
    arrow = to_arrow_schema(out)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in pieces(batches, "text", budget):
            texts = [x or "" for x in part.column("text").to_pylist()]
            made = run(texts)
            columns = [part.column("id").cast(arrow.field(0).type)]
            columns += [pa.array(made[f.name], f.type) for f in list(arrow)[1:]]
            yield pa.RecordBatch.from_arrays(columns, schema=arrow)

    return kept.mapInArrow(apply, out)


def keep_rows(df: DataFrame, text_col: str, decide: Callable[[list[str]], list[bool]], budget: int = 4 << 20) -> DataFrame:
    """Rows of ``df`` whose text ``decide`` keeps; all columns stay as they are."""
    place = df.columns.index(text_col)
    names = [f"c{i}" for i in range(len(df.columns))]

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in pieces(batches, names[place], budget):
            mask = decide([x or "" for x in part.column(place).to_pylist()])
            yield part.filter(pa.array(mask, pa.bool_()))

    schema = StructType([StructField(n, f.dataType) for n, f in zip(names, df.schema.fields, strict=True)])
    return df.toDF(*names).mapInArrow(apply, schema).toDF(*df.columns)
