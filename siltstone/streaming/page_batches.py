"""Long documents page by page, in batches that survive a crash.

Page rows arrive as a stream.  Every micro-batch is transformed and written to a folder of its own number, replacing what a run before may have
left there, and counts once its progress file is created.  A killed run leaves a folder without progress, which nothing reads;
the stream replays that batch under its number.  So each page's result is there once, whenever the run was stopped.
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from siltstone.sources.scratch import names, put_if_absent

SCHEMA = "path string, page_number int, content string"


class PageBatches:
    """Results (path, page_number, content) of page batches below one root path."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")

    def committed(self) -> list[int]:
        return [int(n[:-5]) for n in names(self.spark, f"{self.root}/progress") if n.endswith(".json")]

    def run(self, pages: DataFrame, transform: Callable[[DataFrame], DataFrame], written: Callable[[int], None] | None = None) -> StreamingQuery:
        """Process the pages that are there and stop; a rerun goes on behind the last finished batch.  ``written`` is called between a batch's rows and its progress."""

        def sink(rows: DataFrame, number: int) -> None:
            if number in self.committed():
                return
            path = f"{self.root}/pages/{number}"
            transform(rows).select("path", "page_number", "content").write.mode("overwrite").parquet(path)
            if written:
                written(number)
            done = self.spark.read.parquet(path).agg(F.count(F.lit(1)).alias("pages"), F.count_distinct("path").alias("documents")).first()
            put_if_absent(self.spark, f"{self.root}/progress/{number:012d}.json", json.dumps({"batch": number, "pages": done.pages, "documents": done.documents, "at": time.time()}))

        return pages.writeStream.foreachBatch(sink).option("checkpointLocation", f"{self.root}/checkpoint").trigger(availableNow=True).start()

    def pages(self) -> DataFrame:
        """Pages of finished batches."""
        folders = [f"{self.root}/pages/{n}" for n in self.committed()]
        return self.spark.read.schema(SCHEMA).parquet(*folders) if folders else self.spark.createDataFrame([], SCHEMA)

    def documents(self) -> DataFrame:
        """Contents of documents so far: pages in order, blank ones left out, joined by a blank line."""
        solid = F.when(F.col("content").rlike(r"\S"), F.struct("page_number", "content"))
        parts = F.array_compact(F.sort_array(F.collect_list(solid)))
        found = self.pages().groupBy("path").agg(parts.alias("parts"), F.count(F.lit(1)).alias("n_pages"))
        return found.select("path", F.array_join(F.transform("parts", lambda p: p["content"]), "\n\n").alias("content"), "n_pages")

    def progress(self, totals: DataFrame) -> DataFrame:
        """Per document of ``totals`` (path, total_pages): pages done, the last page up to which all are done, and ``done/total``."""
        order = Window.partitionBy("path").orderBy("page_number")
        done = self.pages().select("path", "page_number").distinct().withColumn("gapless", F.row_number().over(order) == F.col("page_number"))
        each = done.groupBy("path").agg(F.count(F.lit(1)).alias("done"), F.count_if("gapless").alias("last"))
        both = totals.join(each, "path", "left")
        n, last = F.coalesce("done", F.lit(0)), F.coalesce("last", F.lit(0))
        return both.select("path", "total_pages", n.alias("processed_pages"), last.alias("last_page"), F.concat_ws("/", n.cast("string"), F.col("total_pages").cast("string")).alias("progress"))
