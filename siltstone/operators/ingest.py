"""Ingestion: encoder and scorer seams, chunk metadata, indexes, isolated maps.

Models are plugged in as functions from a list of texts to a list of vectors
(or scores); they run in Arrow batches and load once per worker.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, FloatType

from siltstone.functions import vectors

Encoder = Callable[[list[str]], list[list[float]]]


def hash_encoder(dimension: int = 64) -> Encoder:
    """Deterministic stand-in for an embedding model: signed word hashes, unit length."""
    def encode(texts: list[str]) -> list[list[float]]:
        out = np.zeros((len(texts), dimension))
        for i, text in enumerate(texts):
            for word in text.lower().split():
                h = int.from_bytes(hashlib.blake2b(word.encode(), digest_size=8).digest(), "little")
                out[i, h % dimension] += 1.0 if h >> 63 else -1.0
        norms = np.linalg.norm(out, axis=1, keepdims=True)
        return (out / np.where(norms == 0, 1, norms)).tolist()

    return encode


def encoded(df: DataFrame, load: Callable[[], Encoder], text_col: str = "content", name: str = "embedding", batch: int = 32) -> DataFrame:
    """``df`` with the vectors of its texts; ``load`` runs once per task, ``batch`` texts meet the model at a time."""
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = load()
        for series in batches:
            texts = series.fillna("").tolist()
            yield pd.Series([v for i in range(0, len(texts), batch) for v in model(texts[i : i + batch])])

    run.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return df.withColumn(name, F.pandas_udf(run, ArrayType(FloatType()))(F.col(text_col)))


def scored(df: DataFrame, load: Callable[[], Callable[[list[tuple[str, str]]], list[float]]], query: Column, text_col: str = "document", batch: int = 8) -> DataFrame:
    """``df`` with a model's score of (query, text) pairs, ``batch`` pairs at a time."""
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        model = load()
        for a, b in batches:
            pairs = list(zip(a.fillna(""), b.fillna(""), strict=True))
            yield pd.Series([s for i in range(0, len(pairs), batch) for s in model(pairs[i : i + batch])], dtype="float64")

    run.__annotations__ = {"batches": Iterator[tuple[pd.Series, pd.Series]], "return": Iterator[pd.Series]}
    return df.withColumn("rerank_score", F.pandas_udf(run, DoubleType())(query, F.col(text_col)))


def formatted(vector: Column, dimension: int, output: str = "float") -> Column:
    """First ``dimension`` values (all for 2048) as float, int8 or uint8."""
    cut = vector if dimension == 2048 else vectors.truncated(vector, dimension)
    return {"float": vectors.to_float32, "int8": vectors.to_int8, "uint8": vectors.to_uint8, "ubinary": vectors.to_uint8}[output](cut)


def chunk_metadata(chunks: DataFrame, base: Column, own: Column, id_col: str = "doc_id") -> DataFrame:
    """Chunks with id, total and merged metadata; a chunk's own keys win over the document's."""
    total = F.count(F.lit(1)).over(Window.partitionBy(id_col))
    kept = F.map_filter(base, lambda k, _: ~F.map_contains_key(own, k))
    defaults = F.create_map(F.lit("region_type"), F.lit("text"), F.lit("page"), F.lit("0"), F.lit("modality"), F.lit("text"))
    merged = F.map_concat(kept, own)
    rest = F.map_filter(defaults, lambda k, _: ~F.map_contains_key(merged, k))
    # the chunkers know a document's total; others are counted
    counted = chunks.withColumn("total_chunks", F.col("total_chunks").cast("long") if "total_chunks" in chunks.columns else total)
    return counted.select(
        F.concat_ws("_", F.col(id_col).cast("string"), F.lit("chunk"), F.col("chunk_index").cast("string")).alias("id"),
        "*", F.map_concat(merged, rest).alias("metadata"),
    )


def multimodal_rows(docs: DataFrame, id_col: str = "id") -> DataFrame:
    """``{id}_text`` and ``{id}_image`` rows of documents that have either side."""
    row = lambda kind, c: F.when(F.col(c).isNotNull(), F.struct(F.concat(F.col(id_col).cast("string"), F.lit(f"_{kind}")).alias("row_id"), F.lit(kind).alias("content_type"), F.col(c).alias("content")))
    rows = F.array_compact(F.array(row("text", "text"), row("image", "image_path")))
    return docs.select(id_col, F.explode(rows).alias("r")).select(id_col, "r.*")


def multivector_rows(docs: DataFrame, tokens_col: str = "tokens") -> DataFrame:
    """Documents of token vectors with their mean for the first search stage; empty ones are dropped."""
    some = docs.where(F.size(tokens_col) > 0)
    return some.select(
        "*", vectors.mean_vector(F.col(tokens_col)).alias("embedding"), F.lit(True).alias("has_multivector"), F.size(tokens_col).alias("num_vectors")
    )


def isolated(df: DataFrame, work: Callable[[str], str], in_col: str, key_col: str) -> DataFrame:
    """(key, result, error): ``work`` on every row, a failure kept as that row's error."""
    kind = df.schema[key_col].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for key, value in zip(pdf[key_col], pdf[in_col], strict=True):
                try:
                    rows.append((key, work(value), None))
                except Exception as e:  # noqa: BLE001  the row carries the error
                    rows.append((key, None, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(rows, columns=[key_col, "result", "error"])

    return df.select(key_col, in_col).mapInPandas(run, f"{key_col} {kind}, result string, error string")


def saved_report(sources: DataFrame, rows: DataFrame, collection: str, source: str = "source", first: int = 10) -> DataFrame:
    """What was saved of each source: total and saved chunks, the first ids in order of the chunks, and the status.

    ``rows`` are the saved chunks (source, chunk_index, id); a source without any has failed.
    """
    # only the first ids of a source are gathered
    sums = rows.groupBy(source).agg(
        F.count(F.lit(1)).alias("n"), F.array_compact(F.sort_array(F.collect_list(F.when(F.col("chunk_index") < first, F.struct("chunk_index", "id"))))).alias("ids")
    )
    n = F.coalesce("n", F.lit(0))
    return sources.select(source).distinct().join(sums, source, "left").select(
        F.lit(collection).alias("collection_name"), source, n.alias("total_chunks"), n.alias("saved_chunks"),
        F.coalesce(F.transform("ids", lambda r: r["id"]), F.array().cast("array<string>")).alias("embedding_ids"),
        F.when(n > 0, "success").otherwise("failed - no chunks").alias("status"),
    )
