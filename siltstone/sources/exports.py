"""Sinks besides collections: table side files, metric exports, reports, JSON settings."""

from __future__ import annotations

import json
import os
import tempfile

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def table_files(regions: DataFrame, path: str, id_col: str = "doc_id") -> None:
    """Tables that have rows and columns, as JSON in a folder per document."""
    solid = regions.where((F.col("region_type") == "table") & (F.col("table_rows") > 0) & (F.col("table_cols") > 0))
    solid.select(id_col, "region_id", "content", "markdown", "table_html", "table_rows", "table_cols").write.partitionBy(id_col).mode("append").json(path)


def profile_export(results: DataFrame, path: str, form: str = "json") -> None:
    if form not in ("json", "csv"):
        raise ValueError("json or csv")
    writer = results.write.mode("overwrite")
    writer.json(path) if form == "json" else writer.option("header", True).csv(path)


def query_report(results: DataFrame) -> DataFrame:
    """Totals and means of a batch of test queries, overall and by category."""
    return results.groupingSets([[], ["category"]], "category").agg(
        F.count(F.lit(1)).alias("n_queries"), F.count_if("success").alias("succeeded"),
        F.round(F.avg("seconds"), 4).alias("avg_seconds"), F.sum("n_results").alias("n_results"),
    )


def load_settings(path: str, default: dict) -> dict:
    """Settings of a driver-side JSON file over the defaults; unreadable files give the defaults."""
    try:
        with open(path, encoding="utf-8") as file:
            return default | json.load(file)
    except (OSError, ValueError):
        return dict(default)


def save_settings(path: str, settings: dict) -> None:
    """Write beside the file and rename, so a reader never sees half of it."""
    folder = os.path.dirname(path) or "."
    with tempfile.NamedTemporaryFile("w", dir=folder, delete=False, encoding="utf-8") as file:
        json.dump(settings, file, indent=2, sort_keys=True)
    os.replace(file.name, path)
