"""Ranked lexical search by windowed bucket scoring.

``write_index`` cuts the documents into windows of at most ``window`` documents, in order of their ids
inside a window, and stores each window's postings by term (slot in the window, occurrences).  It knows nothing of any query.
``ranked`` takes the items in blocks of bounded size.  Per block the terms' document counts are summed over
the windows and weights follow from them; then each task traverses its windows: for an item, the postings
of its terms are scatter-added into one small array of scores, a bitset says which slots were met, and
those that beat the item's ``k``-th best so far are harvested into its heap.  What leaves a task is ``k`` rows an item at most;
these are cut to ``k`` once more in salted groups before an item's rows meet.

All arithmetic but the weight's logarithm is 64-bit integer; a document's length norm is computed with
Python integers and so never overflows.

Defined results: a null or empty text has no terms, is no document and is never returned; very long texts are
read whole, in blocks of a megabyte; a window closes early when its texts are large, and a larger single text is its own window;
every row is a document of its own, so repeated rows are ranked apart, and a null id stands before all others among
equal scores; rows of one item id are one item with all their terms, a null id being an item too; an item
without terms, or whose terms no document holds, has no rows; a term in nearly all documents weighs 0 and
ranks nothing; empty tables give an empty result; other columns are not read, whatever their names.
"""

from __future__ import annotations

import heapq
import math
from array import array
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, LongType, StructField, StructType, _parse_datatype_string

from siltstone.llm.common import shared_path, slices, stored
from siltstone.llm.words import word_blocks

#: A window is a row group of its own, as readers decode one whole; sizes alone are looked at after a hundred rows only.
_GROUPS = {"compression": "zstd", "parquet.block.row.count.limit": "1"}


class _Postings:
    """The postings of one window while it is read."""

    def __init__(self) -> None:
        self.ids: list = []
        self.lengths: list[int] = []
        self.numbers: dict[bytes, int] = {}
        self.term, self.slot, self.tf = array("i"), array("i"), array("i")
        self.bytes = 0

    def add(self, id_, text: str | None) -> None:
        counts: Counter = Counter()
        for words in word_blocks(text):
            counts.update(words)
        if not counts:
            return
        number = self.numbers
        self.term.extend([number.setdefault(w, len(number)) for w in counts])
        self.tf.extend(counts.values())
        self.slot.extend([len(self.ids)] * len(counts))
        self.ids.append(id_)
        self.lengths.append(counts.total())
        self.bytes += len(text)

    def row(self) -> list:
        """Ids, lengths, terms, documents a term, and the postings: by term, then by slot in order of the ids."""
        order = sorted(range(len(self.ids)), key=lambda i: (self.ids[i] is not None, self.ids[i]))
        place = np.empty(len(order), np.int32)
        place[order] = np.arange(len(order), dtype=np.int32)
        term, slot, tf = (np.frombuffer(a, np.int32) for a in (self.term, self.slot, self.tf))
        slot = place[slot]
        by = np.lexsort((slot, term))
        counts = np.bincount(term, minlength=len(self.numbers)).astype(np.int32)
        terms = [w.decode("utf-8", "surrogatepass") for w in self.numbers]
        return [[self.ids[i] for i in order], [self.lengths[i] for i in order], terms, counts, slot[by].tobytes(), tf[by].tobytes()]


def write_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 2048, window_chars: int = 16 << 20) -> str:
    """Write the windows of ``docs`` to the shared folder; the path, for ``ranked``."""
    out = StructType([StructField("ids", ArrayType(docs.schema[id_col].dataType))])
    out = StructType(out.fields + _parse_datatype_string("lengths array<bigint>, terms array<string>, counts array<int>, slots binary, tfs binary").fields)
    schema = to_arrow_schema(out)

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = _Postings()
        done = lambda: pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(held.row(), schema, strict=True)], schema=schema)
        for batch in batches:
            for part in slices(batch, "text"):
                for id_, text in zip(part.column("id").to_pylist(), part.column("text").to_pylist(), strict=True):
                    if held.ids and (len(held.ids) >= window or held.bytes + len(text or "") > window_chars):
                        yield done()
                        held = _Postings()
                    held.add(id_, text)
        if held.ids:
            yield done()

    path = shared_path(docs.sparkSession, "postings")
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    rows.mapInArrow(build, out).write.options(**_GROUPS).parquet(path)
    return path


def _blocks(items: DataFrame, limit: int) -> Iterator[list]:
    """The items in lists of at most ``limit`` bytes of text each (a larger item is one of its own); rows of one id stay together."""
    total = items.agg(F.sum("bytes")).first()[0] or 0
    bucket = F.pmod(F.xxhash64("item"), F.lit(max(1, math.ceil(total / limit))))
    # peers have the same running sum
    sofar = F.sum("bytes").over(Window.partitionBy("bucket").orderBy("item").rangeBetween(Window.unboundedPreceding, 0))
    dealt = items.withColumn("bucket", bucket).withColumn("piece", F.floor((sofar - 1) / limit))
    dealt = stored(dealt, "items")
    for key in dealt.select("bucket", "piece").distinct().sort("bucket", "piece").toLocalIterator():
        yield dealt.where((F.col("bucket") == key.bucket) & (F.col("piece") == key.piece)).collect()


class _Block:
    """Items of a block: their terms by number, and the terms' weights."""

    def __init__(self, rows: list) -> None:
        self.number: dict[str, int] = {}
        of: dict = {}
        for r in rows:
            terms = of.setdefault(r.item, {})
            for words in word_blocks(r.text):
                for w in words:
                    terms[self.number.setdefault(w.decode("utf-8", "surrogatepass"), len(self.number))] = None
        self.items = list(of)
        self.terms = [list(t) for t in of.values()]
        self.weights = np.zeros(len(self.number), np.int64)


class _Best:
    """The ``k`` best documents of an item so far: the root of the heap is the worst of them."""

    def __init__(self, k: int) -> None:
        self.k, self.heap, self.least = k, [], 1

    def harvest(self, scores: np.ndarray, slots: np.ndarray, ids: list) -> None:
        """Add the documents met in a window; ``slots`` are in order of the ids."""
        good = scores >= self.least
        scores, slots = scores[good], slots[good]
        if len(scores) > self.k:
            first = np.argsort(-scores, kind="stable")[: self.k]
            scores, slots = scores[first], slots[first]
        for score, slot in zip(scores.tolist(), slots.tolist(), strict=True):
            entry = _Hit((score, ids[slot]))
            if len(self.heap) < self.k:
                heapq.heappush(self.heap, entry)
            elif self.heap[0] < entry:
                heapq.heapreplace(self.heap, entry)
        if len(self.heap) == self.k:
            self.least = self.heap[0][0]


class _Hit(tuple):
    """(score, id): less is worse, that is a lower score or a later id; a null id is the first one."""

    def __lt__(self, other: tuple) -> bool:
        if self[0] != other[0]:
            return self[0] < other[0]
        a, b = self[1], other[1]
        return a is not None and (b is None or a > b)


def _traverse(block: _Block, best: list[_Best], row: dict, documents: int, words: int) -> None:
    """Score one window for all items of a block."""
    number, ids = block.number, row["ids"]
    known = np.array([number.get(t, -1) for t in row["terms"]], np.int64)
    counts = np.array(row["counts"], np.int64)
    stop = np.cumsum(counts)
    slot, tf = np.frombuffer(row["slots"], np.int32), np.frombuffer(row["tfs"], np.int32).astype(np.int64)
    norm = np.array([50 + 50 * n * documents // words for n in row["lengths"]], np.int64)
    first, last = np.zeros(len(number), np.int64), np.zeros(len(number), np.int64)
    here = known >= 0
    first[known[here]], last[known[here]] = (stop - counts)[here], stop[here]
    # what a posting adds does not depend on the item; a term without weight adds nothing
    last[block.weights == 0] = first[block.weights == 0]
    adds = np.zeros(len(slot), np.int64)
    for t in np.flatnonzero(last > first).tolist():
        a, b = first[t], last[t]
        adds[a:b] = block.weights[t] * (1_000_000_000 * tf[a:b] // (1000 * tf[a:b] + 20 * norm[slot[a:b]]))
    byte, bit = slot >> 3, (1 << (slot & 7)).astype(np.uint8)
    bucket, met = np.zeros(len(ids), np.int64), np.zeros(len(ids) // 8 + 1, np.uint8)
    first, last = first.tolist(), last.tolist()
    for terms, top in zip(block.terms, best, strict=True):
        for t in terms:
            a, b = first[t], last[t]
            if a < b:
                bucket[slot[a:b]] += adds[a:b]  # a slot occurs once in a term's postings
                np.bitwise_or.at(met, byte[a:b], bit[a:b])
        hit = np.flatnonzero(np.unpackbits(met, bitorder="little"))
        if len(hit):
            top.harvest(bucket[hit], hit, ids)
            bucket[hit] = 0
            met[:] = 0


def ranked(
    spark: SparkSession, path: str, items: DataFrame, k: int = 50, item_col: str = "item_id", text_col: str = "text",
    id_name: str = "doc_id", block_bytes: int = 1 << 20, salts: int = 32,
) -> DataFrame:
    """(item, rank from 1, document, score): the ``k`` best documents of each item in the index at ``path``."""
    index = spark.read.parquet(path)
    item_type, id_type = items.schema[item_col].dataType, index.schema["ids"].dataType.elementType
    sums = index.select(F.size("lengths").alias("n"), F.aggregate("lengths", F.lit(0).cast("long"), lambda a, x: a + x).alias("words"))
    documents, words = sums.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("words"), F.lit(0))).first()
    out = StructType().add("item", item_type).add("document", id_type).add("score", LongType())
    schema = to_arrow_schema(out)
    found = shared_path(spark, "harvest")
    spark.createDataFrame([], out).write.parquet(found)
    texts = items.select(F.col(item_col).alias("item"), F.col(text_col).cast("string").alias("text"))
    texts = texts.where("text IS NOT NULL").withColumn("bytes", F.octet_length("text").cast("long"))
    for rows in _blocks(texts, block_bytes):
        block = _Block(rows)
        if not block.number or not documents:
            continue
        terms = spark.createDataFrame(pa.table({"term": pa.array(list(block.number), pa.string())}))
        each = index.select(F.explode(F.arrays_zip("terms", "counts")).alias("t")).select(F.col("t.terms").alias("term"), "t.counts")
        held = each.join(F.broadcast(terms), "term").groupBy("term").agg(F.sum("counts").alias("df"))
        for r in held.collect():  # one row a term of the block at most
            block.weights[block.number[r.term]] = math.floor(1000 * math.log((2 * documents + 2) / (2 * r.df + 1)))
        sent = spark.sparkContext.broadcast(block)

        def traverse(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            block = sent.value
            best = [_Best(k) for _ in block.items]
            for batch in batches:
                for i in range(batch.num_rows):
                    _traverse(block, best, batch.slice(i, 1).to_pylist()[0], documents, words)
            for item, top in zip(block.items, best, strict=True):
                if top.heap:
                    columns = [[item] * len(top.heap), [h[1] for h in top.heap], [h[0] for h in top.heap]]
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

        index.mapInArrow(traverse, out).write.mode("append").option("compression", "zstd").parquet(found)
        sent.destroy()
    hits = spark.read.schema(out).parquet(found)
    order = [F.desc("score"), F.asc_nulls_first("document")]
    salt = F.pmod(F.xxhash64("document", "score"), F.lit(salts))
    near = hits.withColumn("salt", salt).withColumn("rank", F.row_number().over(Window.partitionBy("item", "salt").orderBy(*order)))
    last = near.where(F.col("rank") <= k).withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(*order)))
    kept = last.where(F.col("rank") <= k)
    return kept.select(F.col("item").alias(item_col), "rank", F.col("document").alias(id_name), "score")


def search(docs: DataFrame, items: DataFrame, k: int = 50, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """Index ``docs`` and rank them for ``items``."""
    path = write_index(docs, id_col, text_col)
    return ranked(docs.sparkSession, path, items, k, item_col, item_text_col, id_col)
