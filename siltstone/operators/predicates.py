"""Metadata filters: nested dictionaries compiled to boolean columns."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_COMPARE: dict[str, Callable[[Column, Any], Column]] = {
    "$eq": lambda c, v: c == v,
    "$ne": lambda c, v: c != v,
    "$gt": lambda c, v: c > v,
    "$gte": lambda c, v: c >= v,
    "$lt": lambda c, v: c < v,
    "$lte": lambda c, v: c <= v,
    "$in": lambda c, v: c.isin(list(v)),
    "$nin": lambda c, v: ~c.isin(list(v)),
}


def compiled(where: dict | None, column: Callable[[str], Column] = F.col) -> Column | None:
    """Boolean column of a filter; None or {} is no filter.

    ``{"a": 1}`` and ``{"a": {"$eq": 1}}`` agree; ``$and`` and ``$or`` take lists of filters.
    """
    if not where:
        return None
    terms = []
    for key, value in where.items():
        if key in ("$and", "$or"):
            parts = [p for p in (compiled(v, column) for v in value) if p is not None]
            if parts:
                terms.append(reduce((lambda a, b: a & b) if key == "$and" else (lambda a, b: a | b), parts))
        elif key.startswith("$"):
            raise ValueError(f"unknown operator {key}")
        elif isinstance(value, dict):
            for op, operand in value.items():
                if op not in _COMPARE:
                    raise ValueError(f"unknown operator {op}")
                terms.append(_COMPARE[op](column(key), operand))
        else:
            terms.append(column(key) == value)
    return reduce(lambda a, b: a & b, terms) if terms else None


def filtered(df: DataFrame, where: dict | None, column: Callable[[str], Column] = F.col) -> DataFrame:
    condition = compiled(where, column)
    return df if condition is None else df.where(condition)


def education_filter(grade: str | None = None, subject: str | None = None) -> dict | None:
    """Filter on the enriched grade and subject; both are joined by ``$and``."""
    terms = [{k: {"$eq": v}} for k, v in (("edu_grade", grade), ("edu_subject", subject)) if v]
    return None if not terms else terms[0] if len(terms) == 1 else {"$and": terms}
