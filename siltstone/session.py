"""Session defaults and named presets."""

from __future__ import annotations

from pyspark.sql import SparkSession

CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.mapKeyDedupPolicy": "LAST_WIN",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}

#: Embedding and memory presets (fixed values).
EMBEDDING_PRESETS = {
    "documents": {"dimension": 2048, "output": "float"},
    "query": {"dimension": 2048, "output": "float"},
    "storage": {"dimension": 256, "output": "ubinary"},
    "fast": {"dimension": 512, "output": "float"},
    "constrained": {"dimension": 256, "output": "float"},
}
DIMENSIONS = (128, 256, 512, 1024, 2048)


def session(name: str = "siltstone", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the engine's defaults; keyword settings override them."""
    builder = SparkSession.builder.appName(name)
    if master:
        builder = builder.master(master)
    return builder.config(map=CONF | conf).getOrCreate()


def optimal_batch_size(available_mb: float, item_mb: float, largest: int = 1024) -> int:
    """How many items fit into memory with half as much again for each: 1 to ``largest``."""
    return max(1, min(largest, int(available_mb / (item_mb * 1.5)))) if item_mb > 0 else largest
