"""Vector and box arithmetic as Column expressions; sums run in double precision."""

from __future__ import annotations

import base64

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType, StringType

METRICS = ("cosine", "l2", "ip")


def _doubles(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(_doubles(a), _doubles(b), lambda x, y: x * y)
    return F.aggregate(products, F.lit(0.0), lambda acc, x: acc + x)


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(_doubles(v), F.lit(0.0), lambda acc, x: acc + x * x))


def distance(a: Column, b: Column, metric: str = "cosine") -> Column:
    """1 - cosine, squared Euclidean, or 1 - inner product; an unknown metric counts as cosine.

    A vector of zeros has the cosine distance 1 to every vector.
    """
    if metric == "l2":
        squares = F.zip_with(_doubles(a), _doubles(b), lambda x, y: (x - y) * (x - y))
        return F.aggregate(squares, F.lit(0.0), lambda acc, x: acc + x)
    if metric == "ip":
        return 1.0 - dot(a, b)
    norms = norm(a) * norm(b)
    return F.when(norms == 0, 1.0).otherwise(1.0 - dot(a, b) / F.nullif(norms, F.lit(0.0)))


def score(dist: Column) -> Column:
    return F.greatest(F.lit(0.0), 1.0 - dist)


def literal(vector: list[float]) -> Column:
    return F.array(*[F.lit(float(x)) for x in vector])


def truncated(v: Column, dimension: int) -> Column:
    """The first ``dimension`` values, not normalised again."""
    return F.slice(v, 1, dimension)


def to_int8(v: Column) -> Column:
    return F.transform(_doubles(v), lambda x: (x * 127.0).cast("tinyint"))


def to_uint8(v: Column) -> Column:
    return F.transform(_doubles(v), lambda x: ((x + 1.0) / 2.0 * 255.0).cast("smallint"))


def to_float32(v: Column) -> Column:
    return v.cast("array<float>")


def concat_tokens(a: Column, b: Column) -> Column:
    """Two multi-vectors side by side, token by token."""
    return F.zip_with(a, b, lambda x, y: F.concat(x, y))


def mean_vector(tokens: Column) -> Column:
    """Mean over the tokens of a multi-vector."""
    sums = F.aggregate(
        tokens,
        F.transform(tokens[0], lambda x: x.cast("double") * 0.0),
        lambda acc, v: F.zip_with(acc, _doubles(v), lambda x, y: x + y),
    )
    return F.transform(sums, lambda x: x / F.size(tokens))


def masked_mean(tokens: Column, mask: Column) -> Column:
    """Mean over the tokens whose mask is not 0."""
    weighted = F.zip_with(tokens, mask, lambda v, m: F.transform(_doubles(v), lambda x: x * m))
    total = F.aggregate(mask, F.lit(0.0), lambda acc, m: acc + m)
    return F.transform(mean_vector(weighted), lambda x: x * F.size(tokens) / total)


def max_sim(query: Column, doc: Column) -> Column:
    """Mean over query tokens of the best dot product with any document token."""
    best = F.transform(query, lambda q: F.array_max(F.transform(doc, lambda d: dot(q, d))))
    return F.aggregate(best, F.lit(0.0), lambda acc, x: acc + x) / F.size(query)


def avg_sim(query: Column, doc: Column) -> Column:
    """Mean of all dot products."""
    every = F.flatten(F.transform(query, lambda q: F.transform(doc, lambda d: dot(q, d))))
    return F.aggregate(every, F.lit(0.0), lambda acc, x: acc + x) / F.size(every)


@F.pandas_udf(StringType())
def to_base64(v: pd.Series) -> pd.Series:
    """Little-endian float32 bytes of a vector in base64."""
    return v.map(lambda x: None if x is None else base64.b64encode(np.asarray(x, "<f4").tobytes()).decode())


@F.pandas_udf(ArrayType(FloatType()))
def from_base64(v: pd.Series) -> pd.Series:
    return v.map(lambda x: None if x is None else np.frombuffer(base64.b64decode(x), "<f4"))


def box(x_min: Column, y_min: Column, x_max: Column, y_max: Column) -> Column:
    return F.struct(x_min.alias("x_min"), y_min.alias("y_min"), x_max.alias("x_max"), y_max.alias("y_max"))


def box_valid(b: Column) -> Column:
    """Normalised to [0, 1] with positive width and height."""
    inside = [b[k].between(0.0, 1.0) for k in ("x_min", "y_min", "x_max", "y_max")]
    return inside[0] & inside[1] & inside[2] & inside[3] & (b["x_min"] < b["x_max"]) & (b["y_min"] < b["y_max"])


def box_width(b: Column) -> Column:
    return b["x_max"] - b["x_min"]


def box_height(b: Column) -> Column:
    return b["y_max"] - b["y_min"]


def box_area(b: Column) -> Column:
    return box_width(b) * box_height(b)


def box_center(b: Column) -> Column:
    return F.struct(((b["x_min"] + b["x_max"]) / 2).alias("x"), ((b["y_min"] + b["y_max"]) / 2).alias("y"))


def box_iou(a: Column, b: Column) -> Column:
    """Intersection over union; 0 for boxes that are apart or touch."""
    w = F.least(a["x_max"], b["x_max"]) - F.greatest(a["x_min"], b["x_min"])
    h = F.least(a["y_max"], b["y_max"]) - F.greatest(a["y_min"], b["y_min"])
    inter = F.when((w > 0) & (h > 0), w * h).otherwise(0.0)
    union = box_area(a) + box_area(b) - inter
    return F.when(union > 0, inter / union).otherwise(0.0)


def box_contains(a: Column, b: Column) -> Column:
    """``a`` contains ``b``; shared edges count."""
    return (a["x_min"] <= b["x_min"]) & (a["y_min"] <= b["y_min"]) & (a["x_max"] >= b["x_max"]) & (a["y_max"] >= b["y_max"])


def box_overlaps(a: Column, b: Column) -> Column:
    return (a["x_min"] < b["x_max"]) & (b["x_min"] < a["x_max"]) & (a["y_min"] < b["y_max"]) & (b["y_min"] < a["y_max"])
