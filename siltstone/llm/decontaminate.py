"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

Test strings are the windows of ``size`` words of each benchmark item (a shorter
item is one window).  Per window length, a shift table over blocks of two words
says how far a scan may skip; where the shift is zero, the hash of the last
words picks the candidate windows, and whole windows are compared directly.
Many scan positions advance in step, so the skips are numpy operations.

The benchmark is the stated query set: it is sent to the executors in blocks of
at most ``block_bytes`` of text, whose sizes are counted before (a single larger item is a block of
its own), and every block meets all records.  Tables are flat arrays of word numbers, about ten bytes
for a byte of text while they are built; a Python worker holds one block's at a time.  With more than one
block it keeps ``held_bytes`` of records and takes them through one block after the other.

Defined results: a null or empty text has no words; very long texts are scanned whole, in one piece;
an item without words or with null text matches nothing; repeated items count once per distinct id; an item
with null id is skipped; items with equal windows all count; repeated rows of the corpus give equal rows;
empty tables give zero hits; other columns are not read, whatever their names.
"""

from __future__ import annotations

import hashlib
import math
import uuid
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.llm.common import hold, keep_rows, per_document

_WORD = b"0123456789abcdefghijklmnopqrstuvwxyz" + bytes(range(128, 256))
#: Lower-cases A-Z and turns every byte outside words into a blank.
_FOLD = bytes(c if c in _WORD else (c + 32 if 65 <= c <= 90 else 32) for c in range(256))


def words_of(text: str | None) -> list[bytes]:
    """Words of a text: runs of digits, letters a-z and all beyond ASCII, as UTF-8."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_FOLD).split()


def _mix(columns: Iterable[np.ndarray]) -> np.ndarray:
    """A 64-bit hash of aligned word numbers."""
    h = None
    for c in columns:
        c = c.astype(np.uint64)
        h = c * np.uint64(0x9E3779B97F4A7C15) if h is None else (h ^ (h >> np.uint64(29)) ^ c) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


class WindowTable:
    """Shift table and suffix buckets of all windows of one length; a window is a place in ``flat``."""

    BLOCK, SUFFIX, MOST_BITS = 2, 4, 24

    def __init__(self, size: int, flat: np.ndarray, places: np.ndarray, owners: np.ndarray) -> None:
        self.size, self.flat = size, flat
        self.block, self.suffix = min(self.BLOCK, size), min(self.SUFFIX, size)
        places, number = self.distinct(places)
        # which items hold each distinct window
        pairs = np.unique(number.astype(np.int64) * (int(owners.max()) + 1) + owners)
        self.owner = (pairs % (int(owners.max()) + 1)).astype(np.int32)
        self.first_owner = np.searchsorted(pairs // (int(owners.max()) + 1), np.arange(len(places) + 1))
        bits = max(12, min(self.MOST_BITS, math.ceil(math.log2(8 * len(places) * size))), math.ceil(math.log2(2 * len(places))))
        self.mask = np.uint64((1 << bits) - 1)
        self.shift = np.full(1 << bits, size - self.block + 1, np.int8 if size < 1 << 7 else np.int32)
        for end in range(self.block, size + 1):
            slots = self.slot([flat[places + k] for k in range(end - self.block, end)])
            np.minimum.at(self.shift, slots, self.shift.dtype.type(size - end))
        key = _mix(flat[places + k] for k in range(size - self.suffix, size))
        self.order = np.argsort(key, kind="stable").astype(np.int32)
        self.keys, self.places = key[self.order], places[self.order]

    def distinct(self, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of distinct windows, and the number of each window's; equal hashes are compared word by word."""
        kept: list[np.ndarray] = []
        number, left = np.full(len(places), -1, np.int32), np.arange(len(places))
        while len(left):
            _, index, inverse = np.unique(_mix(self.flat[places[left] + k] for k in range(self.size)), return_index=True, return_inverse=True)
            chosen = places[left][index]
            same = np.ones(len(left), bool)
            for k in range(self.size):
                same &= self.flat[places[left] + k] == self.flat[chosen[inverse] + k]
            number[left[same]] = inverse[same] + sum(map(len, kept))
            kept.append(chosen)
            left = left[~same]
        return np.concatenate(kept), number

    def slot(self, words: list[np.ndarray]) -> np.ndarray:
        return (_mix(words) & self.mask).astype(np.int64)

    def occurrences(self, ids: np.ndarray, stride: int = 256) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(position of the last word, window number) of every occurrence in ``ids``."""
        at = np.arange(self.size - 1, len(ids), stride)
        stop = np.minimum(at + stride, len(ids))
        found = []
        while len(at):
            step = self.shift[self.slot([ids[at - k] for k in range(self.block - 1, -1, -1)])]
            if len(hit := at[step == 0]):
                found.append(hit)
            at = at + np.maximum(step, 1)
            going = at < stop
            at, stop = at[going], stop[going]
        if not found:
            return
        ends = np.concatenate(found)
        for low in range(0, len(ends), 1 << 16):
            end = ends[low : low + (1 << 16)]
            key = _mix([ids[end - k] for k in range(self.suffix - 1, -1, -1)])
            first, last = np.searchsorted(self.keys, key, "left"), np.searchsorted(self.keys, key, "right")
            while len(end):
                going = first < last
                end, first, last = end[going], first[going], last[going]
                same = np.ones(len(end), bool)
                for k in range(self.size):
                    same &= ids[end - (self.size - 1 - k)] == self.flat[self.places[first] + k]
                if same.any():
                    yield end[same], self.order[first[same]]
                first = first + 1

    def items_of(self, window: int) -> list[int]:
        return self.owner[self.first_owner[window] : self.first_owner[window + 1]].tolist()


class Matcher:
    """All windows of a block of benchmark items."""

    def __init__(self, items: list[tuple[str, str]], size: int = 10) -> None:
        self.numbers: dict[bytes, int] = {}
        self.item_ids = [i for i, _ in items]
        flat, lengths = array("i"), []
        for _, text in items:
            words = words_of(text)
            lengths.append(len(words))
            flat.extend([self.numbers.setdefault(w, len(self.numbers) + 1) for w in words])
        ids, length = np.array(flat, np.int32), np.array(lengths, np.int64)
        start, width = np.cumsum(length) - length, np.minimum(size, length)
        self.tables = []
        for n in np.unique(width[width > 0]).tolist():
            some = np.flatnonzero(width == n)
            many = length[some] - n + 1
            inside = np.arange(int(many.sum())) - np.repeat(np.cumsum(many) - many, many)
            places = (np.repeat(start[some], many) + inside).astype(np.int32)
            self.tables.append(WindowTable(n, ids, places, np.repeat(some, many)))

    def scan(self, texts: list[list[bytes]]) -> tuple[list[np.ndarray], list[set[str]]]:
        """Per text: which words are hit, and the ids of the items that occur."""
        known = self.numbers.get
        # a number of no word ends each text, so no window spans two
        ids = np.array([n for words in texts for n in (*[known(w, 0) for w in words], 0)], np.int32)
        starts = np.concatenate([[0], np.cumsum([len(w) + 1 for w in texts])])
        edge, items = np.zeros(len(ids) + 1, np.int64), [set() for _ in texts]
        for table in self.tables:
            for end, window in table.occurrences(ids):
                np.add.at(edge, end - table.size + 1, 1)
                np.add.at(edge, end + 1, -1)
                for text, w in set(zip((np.searchsorted(starts, end, "right") - 1).tolist(), window.tolist(), strict=True)):
                    items[text].update(self.item_ids[o] for o in table.items_of(w))
        hit = np.cumsum(edge[:-1]) > 0
        return [hit[a : b - 1] for a, b in zip(starts, starts[1:], strict=False)], items


#: The one matcher a worker keeps, under its block's key.
_MATCHER: dict[str, Matcher] = {}


class Blocks:
    """The benchmark as broadcast blocks of bounded size."""

    def __init__(self, benchmark: DataFrame, size: int, block_bytes: int, item_col: str, item_text_col: str) -> None:
        items = benchmark.select(F.col(item_col).cast("string").alias("id"), F.col(item_text_col).alias("text"))
        items = items.where("id IS NOT NULL AND text IS NOT NULL").distinct()
        bytes_ = F.coalesce(F.sum(F.octet_length("text")), F.lit(0))
        blocks = max(1, math.ceil(items.agg(bytes_).first()[0] / block_bytes))
        while True:
            place = F.pmod(F.xxhash64("id", "text"), F.lit(blocks))
            large = items.groupBy(place.alias("block")).agg(bytes_.alias("bytes"), F.count(F.lit(1)).alias("n"))
            if blocks > 1 << 16 or large.where((F.col("bytes") > block_bytes) & (F.col("n") > 1)).isEmpty():
                break
            blocks *= 2
        context, self.size, self.key = benchmark.sparkSession.sparkContext, size, uuid.uuid4().hex
        self.sent = []
        for n in range(blocks):
            rows = items.where(place == n).orderBy("id", "text").collect()
            if rows or not n:
                self.sent.append(context.broadcast([(r.id, r.text) for r in rows]))

    def matcher(self, n: int) -> Matcher:
        """The tables of block ``n``; the worker drops what it held before."""
        hold("decontaminate", _MATCHER.clear)
        key = f"{self.key}-{n}"
        if key not in _MATCHER:
            _MATCHER.clear()
            _MATCHER[key] = Matcher(self.sent[n].value, self.size)
            if len(self.sent) > 1:
                vars(self.sent[n]).pop("_value", None)  # read again from the worker's file when its turn comes
        return _MATCHER[key]

    def scan(self, texts: list[list[bytes]]) -> tuple[list[np.ndarray], list[set[str]]]:
        hits, found = self.matcher(0).scan(texts)
        for n in range(1, len(self.sent)):
            more, names = self.matcher(n).scan(texts)
            hits = [a | b for a, b in zip(hits, more, strict=True)]
            found = [a | b for a, b in zip(found, names, strict=True)]
        return hits, found

    def budget(self, held_bytes: int) -> int:
        return held_bytes if len(self.sent) > 1 else 4 << 20


def drop_contaminated(
    docs: DataFrame,
    benchmark: DataFrame,
    size: int = 10,
    block_bytes: int = 4 << 20,
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    held_bytes: int = 32 << 20,
) -> DataFrame:
    """The records in which no window of the benchmark occurs, with all their columns."""
    blocks = Blocks(benchmark, size, block_bytes, item_col, item_text_col)

    def clean(texts: list[str]) -> list[bool]:
        return [not f for f in blocks.scan([words_of(t) for t in texts])[1]]

    return keep_rows(docs, text_col, clean, blocks.budget(held_bytes))


def find_contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    size: int = 10,
    block_bytes: int = 4 << 20,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    held_bytes: int = 32 << 20,
) -> DataFrame:
    """One row per record: id, n_words, n_hit, n_items, items (sorted ids), items_sha256, contaminated."""
    blocks = Blocks(benchmark, size, block_bytes, item_col, item_text_col)

    def run(texts: list[str]) -> dict[str, list]:
        words = [words_of(t) for t in texts]
        hits, found = blocks.scan(words)
        ids = [sorted(f) for f in found]
        n_hit = [int(h.sum()) for h in hits]
        return {
            "n_words": [len(w) for w in words], "n_hit": n_hit, "n_items": [len(x) for x in ids], "items": ids,
            "items_sha256": [hashlib.sha256(",".join(x).encode()).hexdigest() for x in ids], "contaminated": [n > 0 for n in n_hit],
        }

    schema = "n_words long, n_hit long, n_items long, items array<string>, items_sha256 string, contaminated boolean"
    return per_document(docs, id_col, text_col, schema, run, blocks.budget(held_bytes))
