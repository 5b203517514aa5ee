"""Progress of long documents: an append-only log, read as its last row per document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.operators.tasks import checkpoint_expired

SCHEMA = (
    "collection string, file_hash string, file_path string, total_pages int, processed_pages int, "
    "last_page_completed int, page_results array<string>, updated_at string, live boolean, sequence bigint"
)


class CheckpointLog:
    """Checkpoints keyed by (collection, file hash); saving appends, deleting appends a mark."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")

    def _log(self) -> DataFrame:
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path)
        there = path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(path)
        return self.spark.read.schema(SCHEMA).parquet(self.path) if there else self.spark.createDataFrame([], SCHEMA)

    def list(self) -> DataFrame:
        """The present checkpoint of every document."""
        keys = ["collection", "file_hash"]
        rest = F.struct(*[c for c in self._log().columns if c not in keys])
        last = self._log().groupBy(*keys).agg(F.max_by(rest, "sequence").alias("c"))
        return last.where("c.live").select(*keys, "c.*").drop("live")

    def load(self, collection: str, file_hash: str) -> DataFrame:
        return self.list().where((F.col("collection") == collection) & (F.col("file_hash") == file_hash))

    def _append(self, rows: DataFrame, live: bool) -> None:
        order = (self._log().agg(F.max("sequence")).first()[0] or 0) + 1
        rows = rows.withColumn("live", F.lit(live)).withColumn("sequence", F.lit(order).cast("bigint"))
        typed = [f.split(" ") for f in SCHEMA.split(", ")]
        rows.select(*[(F.col(n) if n in rows.columns else F.lit(None)).cast(t).alias(n) for n, t in typed]).write.mode("append").parquet(self.path)

    def save(self, rows: DataFrame) -> None:
        self._append(rows, True)

    def delete(self, rows: DataFrame) -> None:
        self._append(rows.select("collection", "file_hash"), False)

    def cleanup(self, now: Column, days: int) -> int:
        """Delete checkpoints past the retention; returns their number."""
        old = self.list().where(checkpoint_expired(F.col("updated_at"), now, days))
        n = old.count()
        if n:
            self.delete(old)
        return n

    def resume(self) -> DataFrame:
        """Documents that are not finished, with the next page to process (from 0)."""
        rows = self.list().where("processed_pages < total_pages")
        progress = F.concat_ws("/", F.col("processed_pages").cast("string"), F.col("total_pages").cast("string"))
        return rows.withColumn("next_page", F.col("last_page_completed") + 1).withColumn("progress", progress)
