"""Vector collections: Parquet files that are never changed, deletion bitmaps, and a log of versions.

A collection is a folder with ``data`` (folders of Parquet files), ``vectors`` (which rows of which files are deleted) and
``log`` (one small JSON file a version).  A change writes its files first and then creates the next version's log
file, which fails if another writer was faster; it is then made again on top of that writer's version, so no change is lost.  Appends
need not be made again, they only take the next number.

Deleted rows are found by their place: a bitmap covers 32,768 rows of one file.  Deleting writes bitmaps, updating
writes bitmaps for the old rows and a file with the new ones; nothing else is rewritten.  A read joins the bitmaps to the
rows by file and bucket; they are broadcast if the log says that they are small.  ``compact`` writes the live rows anew.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.sources.scratch import hadoop_path, names, put_if_absent, replace

SCHEMA = "id string, embedding array<float>, document string, metadata map<string,string>"
_LOG = (
    "version bigint, op string, at double, data string, rows bigint, vectors string, bitmaps bigint, deleted bigint, "
    "kept array<struct<data:string,rows:bigint>>, dimension int, metric string, config map<string,string>"
)
_BITMAP_BYTES = 4096
#: The distances a collection may declare (fixed values).
METRICS = ("cosine", "l2", "ip")


@dataclass
class Snapshot:
    """A collection as of one version."""

    version: int = -1
    live: bool = False
    dimension: int = 0
    metric: str = "cosine"
    config: dict[str, str] = field(default_factory=dict)
    #: Data folders with their rows, and vector folders with their bitmaps and deleted rows.
    data: dict[str, int] = field(default_factory=dict)
    vectors: dict[str, tuple[int, int]] = field(default_factory=dict)

    def apply(self, e: dict) -> None:
        self.version = e["version"]
        if e["op"] in ("create", "drop"):
            self.live, self.data, self.vectors, self.config = e["op"] == "create", {}, {}, {}
        if e["op"] == "compact":
            self.live, self.data, self.vectors = True, {k["data"]: k["rows"] for k in e["kept"]}, {}
        if e["dimension"] is not None:
            self.dimension, self.metric = e["dimension"], e["metric"]
        if e["config"] is not None:
            self.config = dict(e["config"])
        if e["data"] is not None:
            self.data[e["data"]] = e["rows"]
        if e["vectors"] is not None:
            self.vectors[e["vectors"]] = (e["bitmaps"], e["deleted"])

    def rows(self) -> int:
        return sum(self.data.values()) - sum(n for _, n in self.vectors.values())


class Conflict(Exception):
    """Other writers were always faster."""


def _bit(bits: Column, row: Column) -> Column:
    """Whether a row of a bucket is in its bitmap."""
    place = F.bitmap_bit_position(row + 1)
    byte = F.conv(F.hex(F.substring(bits, (F.floor(place / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    return F.getbit(byte, (place % 8).cast("int")) == 1


class CollectionStore:
    """Named collections of (id, embedding, document, metadata) below one root path."""

    def __init__(self, spark: SparkSession, root: str, broadcast_bytes: int = 64 << 20, attempts: int = 100) -> None:
        self.spark, self.root, self.broadcast_bytes, self.attempts = spark, root.rstrip("/"), broadcast_bytes, attempts

    # ---- the log

    def _entries(self, name: str, since: int = 0) -> list[dict]:
        found = [n for n in names(self.spark, f"{self.root}/{name}/log") if n.endswith(".json") and int(n[:-5]) >= since]
        if not found:
            return []
        rows = self.spark.read.schema(_LOG).json([f"{self.root}/{name}/log/{n}" for n in found]).collect()
        return sorted((r.asDict(recursive=True) for r in rows), key=lambda e: e["version"])

    def snapshot(self, name: str, version: int | None = None) -> Snapshot:
        """The present state, or that of an earlier version; a version that compacts is a place to start from."""
        marks = [int(n[5:]) for n in names(self.spark, f"{self.root}/{name}") if n.startswith("base-")]
        start = max((m for m in marks if version is None or m <= version), default=0)
        state = Snapshot()
        for e in self._entries(name, start):
            if version is None or e["version"] <= version:
                state.apply(e)
        return state

    def _live(self, name: str) -> Snapshot:
        state = self.snapshot(name)
        if not state.live:
            raise KeyError(f"no collection {name}")
        return state

    def _put(self, name: str, version: int, **entry) -> bool:
        text = json.dumps({"version": version, "at": time.time()} | entry)
        return put_if_absent(self.spark, f"{self.root}/{name}/log/{version:020d}.json", text)

    def _change(self, name: str, make: Callable[[Snapshot], dict | None]) -> int:
        """Commit what ``make`` does on top of the present version; it is made again if another writer was faster."""
        for _ in range(self.attempts):
            state = self._live(name)
            entry = make(state)
            if entry is None:
                return state.version
            if self._put(name, state.version + 1, **entry):
                return state.version + 1
        raise Conflict(f"{name}: {self.attempts} attempts")

    # ---- collections

    def list(self) -> DataFrame:
        """Live collections: name, version, dimension, metric, rows; the logs alone are read."""
        states = [(n, self.snapshot(n)) for n in names(self.spark, self.root)]
        rows = [(n, s.version, s.dimension, s.metric, s.rows()) for n, s in states if s.live]
        return self.spark.createDataFrame(rows, "collection string, version bigint, dimension int, metric string, rows bigint")

    def stats(self) -> DataFrame:
        """Number of rows of each live collection."""
        return self.list().select("collection", F.col("rows").alias("n"))

    def create(self, name: str, dimension: int, metric: str = "cosine", config: dict[str, str] | None = None) -> None:
        if metric not in METRICS:
            raise ValueError(f"metric must be one of {METRICS}")
        state = self.snapshot(name)
        entry = {"op": "create", "dimension": dimension, "metric": metric, "config": config or {}}
        if state.live or not self._put(name, state.version + 1, **entry):
            raise ValueError(f"collection {name} exists")

    def drop(self, name: str) -> None:
        self._change(name, lambda _: {"op": "drop"})

    def config(self, name: str) -> dict[str, str]:
        return self._live(name).config

    def configure(self, name: str, **settings: str | None) -> None:
        """Merge settings into the collection's; ``None`` removes one."""

        def make(state: Snapshot) -> dict:
            merged = state.config | settings
            return {"op": "config", "config": {k: str(v) for k, v in merged.items() if v is not None}}

        self._change(name, make)

    # ---- rows

    def _placed(self, name: str, state: Snapshot) -> DataFrame:
        """Live rows with the file and the row they are read from."""
        folders = [f"{self.root}/{name}/data/{f}" for f in state.data]
        if not folders:
            return self.spark.createDataFrame([], f"{SCHEMA}, file string, row bigint")
        columns = ["id", "embedding", "document", "metadata"]
        rows = self.spark.read.schema(SCHEMA).parquet(*folders).select(*columns, F.col("_metadata.file_name").alias("file"), F.col("_metadata.row_index").alias("row"))
        if not state.vectors:
            return rows
        parts = self.spark.read.parquet(*[f"{self.root}/{name}/vectors/{v}" for v in state.vectors])
        gone = parts.groupBy("file", "bucket").agg(F.bitmap_or_agg("bits").alias("bits"))
        if sum(n for n, _ in state.vectors.values()) * _BITMAP_BYTES <= self.broadcast_bytes:
            gone = F.broadcast(gone)
        both = rows.withColumn("bucket", F.bitmap_bucket_number(F.col("row") + 1)).join(gone, ["file", "bucket"], "left")
        return both.where(F.col("bits").isNull() | ~_bit(F.col("bits"), F.col("row"))).select(*rows.columns)

    def read(self, name: str, version: int | None = None) -> DataFrame:
        """The rows of the present version, or of an earlier one."""
        state = self._live(name) if version is None else self.snapshot(name, version)
        return self._placed(name, state).drop("file", "row")

    def _write_rows(self, name: str, rows: DataFrame) -> dict:
        folder = uuid.uuid4().hex
        path = f"{self.root}/{name}/data/{folder}"
        rows.write.option("parquet.bloom.filter.enabled#id", "true").parquet(path)
        return {"data": folder, "rows": self.spark.read.parquet(path).count()}

    def _write_vectors(self, name: str, places: DataFrame) -> dict:
        """Bitmaps of deleted rows (file, row)."""
        folder = uuid.uuid4().hex
        row = F.col("row") + 1
        bits = places.groupBy("file", F.bitmap_bucket_number(row).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(row)).alias("bits"))
        path = f"{self.root}/{name}/vectors/{folder}"
        bits.write.option("compression", "zstd").parquet(path)
        n, deleted = self.spark.read.parquet(path).agg(F.count(F.lit(1)), F.coalesce(F.sum(F.bitmap_count("bits")), F.lit(0))).first()
        return {"vectors": folder, "bitmaps": n, "deleted": deleted}

    def _typed(self, rows: DataFrame, dimension: int) -> DataFrame:
        embedding = F.col("embedding").cast("array<float>")
        wrong = F.raise_error(F.concat(F.lit(f"need {dimension} dimensions, got "), F.size(embedding).cast("string"))).cast("array<float>")
        return rows.select(
            F.coalesce(F.col("id").cast("string"), F.uuid()).alias("id"),
            F.when(embedding.isNull() | (F.size(embedding) == dimension), embedding).otherwise(wrong).alias("embedding"),
            *[(F.col(c) if c in rows.columns else F.lit(None)).cast(t).alias(c) for c, t in (("document", "string"), ("metadata", "map<string,string>"))],
        )

    def add(self, name: str, rows: DataFrame) -> int:
        """Append; a null id gets a fresh one.  The rows are written once, however often the version number is taken."""
        entry = {"op": "add"} | self._write_rows(name, self._typed(rows, self._live(name).dimension))
        return self._change(name, lambda _: entry)

    def update(self, name: str, changes: DataFrame) -> int:
        """Partial update by id: columns that are absent or null keep their value, unknown ids change nothing.

        An id that occurs twice in ``changes`` is an error, as no order says which one counts.
        """
        if not changes.groupBy("id").count().where("count > 1 AND id IS NOT NULL").isEmpty():
            raise ValueError("an id occurs twice")
        columns = [c for c in ("embedding", "document", "metadata") if c in changes.columns]
        new = changes.select(F.col("id").cast("string").alias("id"), *[F.col(c).alias(f"new_{c}") for c in columns])

        def make(state: Snapshot) -> dict | None:
            placed = self._placed(name, state)
            vectors = self._write_vectors(name, placed.select("id", "file", "row").join(new.select("id"), "id", "left_semi"))
            if not vectors["deleted"]:
                return None
            met = placed.join(new, "id")
            rows = met.select("id", *[F.coalesce(F.col(f"new_{c}"), c).alias(c) if c in columns else F.col(c) for c in ("embedding", "document", "metadata")])
            return {"op": "update"} | vectors | self._write_rows(name, self._typed(rows, state.dimension))

        return self._change(name, make)

    def delete(self, name: str, ids: DataFrame) -> int:
        """Delete by id; only bitmaps are written, and nothing if no id is there."""

        def make(state: Snapshot) -> dict | None:
            met = self._placed(name, state).select("id", "file", "row").join(ids.select(F.col("id").cast("string").alias("id")), "id", "left_semi")
            vectors = self._write_vectors(name, met)
            return {"op": "delete"} | vectors if vectors["deleted"] else None

        return self._change(name, make)

    def compact(self, name: str) -> int:
        """Write the live rows anew, without bitmaps; what is appended meanwhile stays as it is."""
        for _ in range(self.attempts):
            state = self._live(name)
            made = self._write_rows(name, self._placed(name, state).drop("file", "row"))
            while True:
                later = self._entries(name, state.version + 1)
                if any(e["op"] not in ("add", "config") for e in later):
                    break
                kept = [made] + [{"data": e["data"], "rows": e["rows"]} for e in later if e["data"]]
                version = state.version + 1 + len(later)
                config = ([e["config"] for e in later if e["op"] == "config"] or [state.config])[-1]
                entry = {"op": "compact", "kept": kept, "dimension": state.dimension, "metric": state.metric, "config": config}
                if self._put(name, version, **entry):
                    replace(self.spark, f"{self.root}/{name}/base-{version}", "")
                    return version
        raise Conflict(f"{name}: {self.attempts} attempts")

    def vacuum(self, name: str, hours: float = 168.0) -> int:
        """Remove folders that the present version does not name and that are older than ``hours``; how many."""
        state, removed = self._live(name), 0
        fs = hadoop_path(self.spark, self.root)[0]
        for kind, used in (("data", state.data), ("vectors", state.vectors)):
            for folder in names(self.spark, f"{self.root}/{name}/{kind}"):
                path = hadoop_path(self.spark, f"{self.root}/{name}/{kind}/{folder}")[1]
                if folder not in used and fs.getFileStatus(path).getModificationTime() <= (time.time() - hours * 3600) * 1000:
                    removed += fs.delete(path, True)
        return removed

    def validate(self, name: str | None = None) -> DataFrame:
        """Problems of one or of all live collections: (collection, part, problem); folders that are missing, and row counts that differ from the log."""
        found = []
        for n in [name] if name else [r.collection for r in self.list().select("collection").collect()]:
            state = self._live(n)
            for kind, used in (("data", state.data), ("vectors", state.vectors)):
                there = set(names(self.spark, f"{self.root}/{n}/{kind}"))
                found += [(n, f"{kind}/{f}", "missing") for f in used if f not in there]
                for f in used:
                    if f in there:
                        rows = self.spark.read.parquet(f"{self.root}/{n}/{kind}/{f}").count()
                        want = used[f] if kind == "data" else used[f][0]
                        found += [(n, f"{kind}/{f}", f"{rows} rows, not {want}")] if rows != want else []
        return self.spark.createDataFrame(found, "collection string, part string, problem string")
