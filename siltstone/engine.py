"""One object over a collection root: ingest, search, chat retrieval, cited context."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.functions import text as T
from siltstone.functions.vectors import score
from siltstone.operators import chunking, context, ingest, search
from siltstone.operators.predicates import compiled
from siltstone.sources.collections import CollectionStore
from siltstone.sources.scratch import written

#: Ranges of retrieval settings and citation styles (fixed values).
RANGES = {
    "initial_retrieval_k": (1, 50), "final_top_n": (1, 20), "rerank_top_n": (1, 20), "hybrid_alpha": (0, 1),
    "compression_threshold": (0.5, 0.95), "compression_chunk_size": (200, 1000), "top_k": (1, 100),
}
CITATION_STYLES = ("numbered", "inline", "footnote")


def validated(settings: dict) -> dict:
    """The settings, if every known one is within its range."""
    for name, value in settings.items():
        if name in RANGES and not RANGES[name][0] <= value <= RANGES[name][1]:
            raise ValueError(f"{name} must be between {RANGES[name][0]} and {RANGES[name][1]}, got {value}")
    if settings.get("citation_style", "numbered") not in CITATION_STYLES:
        raise ValueError(f"citation_style must be one of {CITATION_STYLES}")
    return settings


class Engine:
    """Collections with an encoder; every method returns a DataFrame or writes a collection."""

    def __init__(self, spark: SparkSession, root: str, load: Callable[[], ingest.Encoder] = ingest.hash_encoder, dimension: int = 64) -> None:
        self.spark, self.load, self.dimension = spark, load, dimension
        self.store = CollectionStore(spark, root)

    def create(self, name: str, metric: str = "cosine") -> None:
        self.store.create(name, self.dimension, metric)

    def ingest(self, name: str, docs: DataFrame, size: int = 512, overlap: int = 50, id_col: str = "path", text_col: str = "content") -> None:
        """Chunk, enrich with grade and subject, encode and append documents (id, text, metadata)."""
        base = chunking.fixed_chunks(docs, size, overlap, id_col, text_col, keep=["metadata"]).withColumnRenamed("content", "document")
        hint = F.concat_ws(" ", F.col(id_col).cast("string"), "document")
        own = F.map_filter(
            F.create_map(F.lit("edu_grade"), T.grade_of(hint), F.lit("edu_subject"), T.subject_of(hint), F.lit("chunk_index"), F.col("chunk_index").cast("string")),
            lambda _, v: v.isNotNull(),
        )
        rows = ingest.chunk_metadata(base.withColumnRenamed("metadata", "doc_metadata"), F.coalesce("doc_metadata", F.create_map().cast("map<string,string>")), own, id_col)
        self.store.add(name, ingest.encoded(rows, self.load, "document").select("id", "embedding", "document", "metadata"))

    def ingest_regions(self, name: str, regions: DataFrame, max_size: int = 1000, id_col: str = "source") -> DataFrame:
        """Chunk documents by their regions (source, region_sequence, region_type, content, page_number, ...), encode and append them.

        The collection is created if it is not there.  Gives a row per source: chunks, first ids, status.
        """
        if not self.store.snapshot(name).live:
            self.create(name)
        chunks = chunking.semantic_chunks(regions, max_size, id_col).withColumnRenamed("content", "document").withColumnRenamed("metadata", "own")
        rows = ingest.chunk_metadata(chunks, F.create_map(F.lit("source"), F.col(id_col).cast("string")), F.col("own"), id_col)
        rows = written(ingest.encoded(rows, self.load, "document"), "semantic_chunks")
        self.store.add(name, rows.select("id", "embedding", "document", "metadata"))
        return ingest.saved_report(regions.select(id_col), rows, name, id_col)

    def search(self, name: str, query: str, k: int = 5, where: dict | None = None) -> DataFrame:
        """The ``k`` nearest rows of a collection under its declared metric; filters address metadata keys."""
        validated({"top_k": k})
        condition = compiled(where, lambda key: F.col("metadata")[key])
        rows = self.store.read(name) if condition is None else self.store.read(name).where(condition)
        metric = self.store.snapshot(name).metric
        return search.top_k(rows, self.load()([query])[0], k, metric)

    def chat_context(self, name: str, query: str, first_k: int = 20, text_k: int = 5, image_k: int = 3) -> DataFrame:
        """One row with the cited context of a question: nearest rows, split by modality, reranked, formatted."""
        validated({"initial_retrieval_k": first_k})
        hits = self.search(name, query, first_k).withColumn("modality", F.col("metadata")["modality"])
        hits = hits.withColumn("source", F.coalesce(F.col("metadata")["source_file"], F.col("metadata")["source"], F.lit("Unknown Source")))
        sides = search.split_by_modality(hits, text_k, image_k)
        ranked = search.rerank(sides.where("side = 'text'"), search.overlap_scorer, query, text_k)
        order = search.numbered(ranked.withColumn("one", F.lit(1)), "one", F.desc("rerank_score"), "id")
        entry = context.text_entry(F.col("rank"), F.col("source"), score(F.col("distance")), F.col("document"))
        full = context.context(order.withColumn("entry", entry), "one")
        return full.select(context.multimodal(F.col("context"), F.lit(None).cast("string")).alias("context"))
