"""Vector search: exact top-k, batches of queries, late interaction, reranking.

A single query is an expression over the scan, so filters and columns are
pushed into it and the top rows come from partial heaps.  A batch of queries is
a stated set: its size is checked, and it meets the corpus in blocks, each block a
broadcast of bounded size; every task keeps its own top rows per query before anything is shuffled.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltstone.functions import vectors
from siltstone.operators.predicates import filtered

QUERY_BLOCK = 4096
#: Distances that a task holds at once.
PIECE = 1 << 20


def top_k(
    df: DataFrame,
    query: Sequence[float],
    k: int = 10,
    metric: str = "cosine",
    where: dict | None = None,
    id_col: str = "id",
    vector_col: str = "embedding",
) -> DataFrame:
    """The ``k`` nearest rows by (distance, id), with ``distance`` and ``score``; filters come first."""
    dist = vectors.distance(F.col(vector_col), vectors.literal(list(query)), metric)
    near = filtered(df, where).withColumn("distance", dist)
    return near.orderBy("distance", id_col).limit(k).withColumn("score", vectors.score(F.col("distance")))


def point_lookup(df: DataFrame, key, id_col: str = "id") -> DataFrame:
    return df.where(F.col(id_col) == key).withColumn("score", F.lit(1.0))


def numbered(df: DataFrame, by: str, *order: Column | str, name: str = "rank") -> DataFrame:
    return df.withColumn(name, F.row_number().over(Window.partitionBy(by).orderBy(*order)))


def batch_top_k(
    df: DataFrame,
    queries: DataFrame,
    k: int = 10,
    metric: str = "cosine",
    id_col: str = "id",
    vector_col: str = "embedding",
    query_id: str = "query_id",
    query_vector: str = "query_vector",
    block: int = QUERY_BLOCK,
) -> DataFrame:
    """(query_id, id, distance, rank) of the ``k`` nearest rows of every query.

    Queries are read in blocks of ``block`` vectors; each Arrow batch of the corpus meets a
    block as one matrix product, and only a task's best ``k`` per query leave it.
    """
    spark, found = df.sparkSession, None
    id_type = df.schema[id_col].dataType.simpleString()
    query_type = queries.schema[query_id].dataType.simpleString()
    total = queries.count()
    blocks = max(1, -(-total // block))
    keyed = queries.select(F.col(query_id).alias("q"), F.col(query_vector).cast("array<double>").alias("v"))
    corpus = df.select(F.col(id_col).alias("id"), F.col(vector_col).alias("v"))
    for n in range(blocks):
        part = keyed if blocks == 1 else keyed.where(F.pmod(F.xxhash64("q"), F.lit(blocks)) == n)
        rows = part.orderBy("q").collect()  # a bounded share of the stated queries
        if not rows:
            continue
        sent = spark.sparkContext.broadcast(([r.q for r in rows], np.array([r.v for r in rows], np.float64)))
        near = corpus.mapInPandas(_nearest(sent, k, metric), f"q {query_type}, id {id_type}, distance double")
        found = near if found is None else found.unionByName(near)
    if found is None:
        found = spark.createDataFrame([], f"q {query_type}, id {id_type}, distance double")
    best = numbered(found, "q", "distance", "id").where(F.col("rank") <= k)
    return best.select(F.col("q").alias(query_id), F.col("id").alias(id_col), "distance", "rank")


def _nearest(sent, k: int, metric: str) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    def distances(q: np.ndarray, x: np.ndarray) -> np.ndarray:
        products = q @ x.T
        if metric == "l2":
            return np.maximum((q * q).sum(1)[:, None] + (x * x).sum(1)[None, :] - 2 * products, 0)
        if metric == "ip":
            return 1 - products
        norms = np.linalg.norm(q, axis=1)[:, None] * np.linalg.norm(x, axis=1)[None, :]
        return 1 - np.divide(products, norms, out=np.zeros_like(products), where=norms > 0)

    def best(q: np.ndarray, d: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The first ``k`` of each query by (distance, id)."""
        order = np.lexsort((np.unique(ids, return_inverse=True)[1], d, q))
        q, d, ids = q[order], d[order], ids[order]
        keep = np.arange(len(q)) - np.searchsorted(q, q, "left") < k
        return q[keep], d[keep], ids[keep]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names, vectors_ = sent.value
        held = np.empty(0, np.int64), np.empty(0), np.empty(0, object)
        border = np.full(len(vectors_), np.inf)
        rows = max(64, PIECE // len(vectors_))
        for pdf in batches:
            pdf = pdf.dropna()
            for at in range(0, len(pdf), rows):
                piece = pdf.iloc[at : at + rows]
                # rounded, so that equal vectors tie whatever the order of the sums
                d = distances(vectors_, np.stack(piece["v"].to_numpy()).astype(np.float64)).round(12) + 0.0
                # a row behind a query's k-th of this piece is none of its k first; peers of that one stay
                top = np.minimum(border, np.partition(d, k - 1, axis=1)[:, k - 1]) if d.shape[1] > k else border
                row, column = np.nonzero(d <= top[:, None])
                if not len(row):
                    continue
                new = row, d[row, column], piece["id"].to_numpy(object)[column]
                held = best(*[np.concatenate(x) for x in zip(held, new, strict=True)])
                full = np.bincount(held[0], minlength=len(names)) >= k
                last = np.searchsorted(held[0], np.arange(len(names)), "right") - 1
                border[full] = held[1][last[full]]
        for at in range(0, len(held[0]), 1 << 16):
            q, d, ids = (x[at : at + (1 << 16)] for x in held)
            yield pd.DataFrame({"q": [names[i] for i in q], "id": ids.tolist(), "distance": d})

    return run


def without_self(hits: DataFrame, threshold: float = 0.01) -> DataFrame:
    """Image-to-image results without a first hit that is the query itself."""
    return hits.where(~((F.col("rank") == 1) & (F.col("distance") < threshold)))


def with_fallback(hits: DataFrame, unfiltered: DataFrame, query_id: str = "query_id") -> DataFrame:
    """Filtered results; a query without any gets its unfiltered ones."""
    empty = unfiltered.join(hits.select(query_id).distinct(), query_id, "left_anti")
    return hits.unionByName(empty)


def two_stage(
    docs: DataFrame, query: list[list[float]], first_k: int = 100, k: int = 10, id_col: str = "id", tokens_col: str = "tokens"
) -> DataFrame:
    """Mean-vector top ``first_k``, reranked by late interaction to the best ``k``."""
    tokens = F.array(*[vectors.literal(v) for v in query])
    mean = [sum(x) / len(query) for x in zip(*query, strict=True)]
    pooled = docs.withColumn("mean_vector", vectors.mean_vector(F.col(tokens_col)))
    first = top_k(pooled, mean, first_k, id_col=id_col, vector_col="mean_vector").drop("score")
    ranked = first.withColumn("max_sim", vectors.max_sim(tokens, F.col(tokens_col)))
    return ranked.orderBy(F.desc("max_sim"), "distance", id_col).limit(k)


def rerank(
    hits: DataFrame, scorer: Callable[[Column, Column], Column], query_text: str, k: int = 5,
    text_col: str = "document", score_col: str = "score", id_col: str = "id",
) -> DataFrame:
    """Rerank by ``scorer(query, text)``; rows the scorer cannot score keep their first score, after the others."""
    scored = hits.withColumn("original_score", F.col(score_col)).withColumn("rerank_score", scorer(F.lit(query_text), F.col(text_col)))
    scored = scored.withColumn(score_col, F.coalesce("rerank_score", "original_score"))
    return scored.orderBy(F.desc_nulls_last("rerank_score"), F.desc("original_score"), id_col).limit(k)


def overlap_scorer(query: Column, text: Column) -> Column:
    """Deterministic stand-in for a cross-encoder: share of query words in the text."""
    words = lambda c: F.array_distinct(F.split(F.lower(c), r"\W+"))
    return F.size(F.array_intersect(words(query), words(text))) / F.size(words(query))


def rerank_by_distance(hits: DataFrame, score_col: str = "cross_modal_score", id_col: str = "id") -> DataFrame:
    """Ascending cross-modal distance; a missing one counts as 1."""
    return hits.orderBy(F.coalesce(F.col(score_col), F.lit(1.0)), id_col)


def split_by_modality(hits: DataFrame, text_k: int = 5, image_k: int = 3, modality: str = "modality", id_col: str = "id") -> DataFrame:
    """First hits of each side of a chat retrieval; anything but an image is text."""
    side = F.when(F.col(modality) == "image", "image").otherwise("text")
    ranked = numbered(hits.withColumn("side", side), "side", "distance", id_col)
    return ranked.where(F.col("rank") <= F.when(F.col("side") == "image", image_k).otherwise(text_k))


def materials(text_hits: DataFrame, image_hits: DataFrame) -> DataFrame:
    """Text and image results as one list with their source type."""
    tag = lambda d, kind: d.withColumn("source_type", F.lit(kind))
    return tag(text_hits, "text").unionByName(tag(image_hits, "image"), allowMissingColumns=True)


def chat_sides(
    hits: DataFrame, scorer: Callable[[Column, Column], Column], query_text: str, text_k: int = 5, image_k: int = 3,
    modality: str = "modality", id_col: str = "id", text_col: str = "document",
) -> DataFrame:
    """Both sides of a chat retrieval with their ranks: texts reranked by ``scorer``, images by distance; anything but an image is a text.

    ``hits`` are the first stage's few nearest rows.
    """
    side = F.when(F.col(modality) == "image", "image").otherwise("text")
    scored = hits.withColumn("side", side).withColumn("rerank_score", F.when(F.col("side") == "text", scorer(F.lit(query_text), F.col(text_col))))
    ranked = numbered(scored, "side", F.desc_nulls_last("rerank_score"), "distance", id_col)
    return ranked.where(F.col("rank") <= F.when(F.col("side") == "image", image_k).otherwise(text_k))


def result_rows(hits: DataFrame, collection: str, metadata: str = "metadata") -> DataFrame:
    """Hits with their type and, for images of a document, a struct of size, format, mean colours and addresses; missing numbers are 0."""
    m = F.col(metadata)
    number = lambda key, kind: F.coalesce(m[key].try_cast(kind), F.lit(0).cast(kind)).alias(key)
    address = lambda kind: F.concat(F.lit(f"/api/images/{kind}/{collection}/"), m["document_id"])
    kind = F.coalesce(m["modality"], F.lit("text"))
    image = F.struct(
        number("width", "int"), number("height", "int"), F.coalesce(m["format"], F.lit("unknown")).alias("format"), number("file_size", "bigint"),
        address("thumbnail").alias("thumbnail_url"), address("full").alias("full_image_url"),
        F.array(*[number(f"mean_{c}", "double") for c in "rgb"]).alias("mean_rgb"),
    )
    named = F.coalesce(m["document_id"], F.lit("")) != ""
    return hits.withColumn("result_type", kind).withColumn("image_metadata", F.when((kind == "image") & named, image))


def filtered_or_all(df: DataFrame, query: list[float], k: int, where: dict | None, **options) -> DataFrame:
    """The ``k`` nearest rows that pass a filter; all rows' nearest if none passes."""
    near = top_k(df, query, k, where=where, **options)
    if not where:
        return near
    # at most k rows
    met = near.agg(F.count(F.lit(1)).alias("__met"))
    either = near.withColumn("__own", F.lit(True)).unionByName(top_k(df, query, k, **options).withColumn("__own", F.lit(False)))
    return either.join(F.broadcast(met)).where(F.col("__own") == (F.col("__met") > 0)).drop("__own", "__met")


def hybrid(dense: DataFrame, sparse: DataFrame, alpha: float = 0.5, id_col: str = "id") -> DataFrame:
    """Extension: ``alpha`` x dense + (1 - alpha) x sparse score; a missing side counts 0."""
    both = dense.select(id_col, F.col("score").alias("dense")).join(sparse.select(id_col, F.col("score").alias("sparse")), id_col, "full")
    mixed = F.lit(alpha) * F.coalesce("dense", F.lit(0.0)) + F.lit(1 - alpha) * F.coalesce("sparse", F.lit(0.0))
    return both.withColumn("score", mixed)


def compressed(hits: DataFrame, threshold: float, per_doc: int, doc_col: str = "doc_id", id_col: str = "id") -> DataFrame:
    """Extension: chunks above a similarity, the best few of each document."""
    ranked = numbered(hits.where(F.col("score") >= threshold), doc_col, F.desc("score"), id_col)
    return ranked.where(F.col("rank") <= per_doc)
