"""SimHash near-duplicates by bit-sliced comparison.

A fingerprint is the bitwise majority over the XXH64 of a text's 3-word
shingles.  Equal fingerprints are one node.  Two fingerprints within ``radius``
= 3 bits agree on at least one of four bit ranges, so each node goes to four
buckets.  A bucket above ``limit`` nodes is dealt again by a quarter of its
remaining bits (again one of four must agree), up to four times; what is still
larger is cut into tiles that meet pairwise.  No pair is lost and no task
holds more than two tiles, however skewed the fingerprints are.

Inside a bucket, blocks of 64 fingerprints are stored as vertical bit planes;
carry-save counters add up the differing bits of one fingerprint against a whole block
with word operations, and a block is abandoned once all its members exceed the
radius.  Links leave a bucket as one star per local component, and the stars of all buckets
are joined into components.

Defined results: a null, empty or blank text has fingerprint 0, which links
like any other; repeated rows share a component; a component's id is its
smallest non-null document id, null if it has none; very long texts are hashed whole; a tie of set and unset
hashes leaves a bit 0; an empty table gives an empty result; other columns are not read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.llm.common import per_document, spread_join, stored
from siltstone.llm.graph import component_stars

WIDTH = 64


def fingerprint(text: str, n: int = 3, seed: int = 42) -> int:
    """SimHash of a text, as an unsigned 64-bit integer."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined, n = b" ".join(words), min(n, len(words))
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    digest, total = xxhash.xxh64_digest, np.zeros(64, np.int64)
    first, last = starts[: len(words) - n + 1].tolist(), ends[n - 1 :].tolist()
    for at in range(0, len(first), 1 << 15):
        hashes = b"".join(
            [digest(joined[a:b], seed) for a, b in zip(first[at : at + (1 << 15)], last[at : at + (1 << 15)], strict=True)]
        )
        bits = np.unpackbits(np.frombuffer(hashes, np.uint8)).reshape(-1, 64)
        total += bits.sum(axis=0, dtype=np.int32)
    return int.from_bytes(np.packbits(2 * total > len(first)).tobytes(), "big")


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp): the fingerprint as a signed long."""

    def run(texts: list[str]) -> dict[str, list]:
        found = np.array([fingerprint(t) for t in texts], np.uint64)
        return {"fp": found.view(np.int64).tolist()}

    return per_document(df, id_col, text_col, "fp long", run)


def agreeing_masks(levels: int, parts: int = 4) -> list[list[int]]:
    """Masks of each level: a child adds one of ``parts`` shares of its parent's free bits."""
    out, masks = [], [0]
    for _ in range(levels):
        children = []
        for mask in masks:
            free = [b for b in range(WIDTH) if not mask >> b & 1]
            cuts = [len(free) * i // parts for i in range(parts + 1)]
            children += [mask | sum(1 << b for b in free[a:z]) for a, z in zip(cuts, cuts[1:], strict=False)]
        out.append(children)
        masks = children
    return out


class BitSlices:
    """Blocks of up to 64 fingerprints of one bucket as vertical bit planes."""

    def __init__(self, fps: np.ndarray, bucket: np.ndarray) -> None:
        """``fps`` uint64, rows of a bucket next to each other; ``bucket`` its number, rising."""
        self.fps = fps
        first = np.searchsorted(bucket, bucket, "left")
        self.place = np.arange(len(fps)) - first
        starts = np.flatnonzero(self.place % 64 == 0)
        self.block_start = starts
        self.block_of = np.cumsum(self.place % 64 == 0) - 1
        last_row = np.searchsorted(bucket, bucket, "right") - 1
        self.last_block = self.block_of[last_row]
        lane = np.left_shift(np.uint64(1), (self.place % 64).astype(np.uint64))
        self.valid = np.bitwise_or.reduceat(lane, starts)
        self.later = ~(lane | (lane - np.uint64(1)))
        self.planes = np.stack(
            [np.bitwise_or.reduceat(np.where(fps >> np.uint64(k) & np.uint64(1), lane, np.uint64(0)), starts) for k in range(WIDTH)]
        )

    def comparisons(self, size: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(row, block) with the block at or after the row's own, a bounded number at a time."""
        counts = self.last_block - self.block_of + 1
        upto = np.cumsum(counts)
        for low in range(0, int(upto[-1]), size):
            n = np.arange(low, min(low + size, int(upto[-1])))
            row = np.searchsorted(upto, n, "right")
            yield row, self.block_of[row] + (n - (upto[row] - counts[row]))

    def within(self, row: np.ndarray, block: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Rows, blocks and words of lanes within ``radius``; a lane counts once per pair."""
        alive = np.where(block == self.block_of[row], self.later[row], ~np.uint64(0)) & self.valid[block]
        bits = max(1, (radius + 1 - 1).bit_length())
        start = (1 << bits) - 1 - radius
        full = ~np.uint64(0)
        # the counters start so that they overflow at radius + 1
        counter = [np.full(len(row), full if start >> i & 1 else 0, np.uint64) for i in range(bits)]
        query = self.fps[row]
        for k in range(WIDTH):
            carry = self.planes[k][block] ^ (np.uint64(0) - (query >> np.uint64(k) & np.uint64(1)))
            for i in range(bits):
                both = counter[i] & carry
                counter[i] ^= carry
                carry = both
            alive &= ~carry
            if k % 4 == 3:
                keep = np.flatnonzero(alive)
                if len(keep) < 0.8 * len(alive):
                    row, block, alive, query = row[keep], block[keep], alive[keep], query[keep]
                    counter = [c[keep] for c in counter]
                    if not len(keep):
                        break
        keep = np.flatnonzero(alive)
        return row[keep], block[keep], alive[keep]

    def pairs(self, radius: int, size: int = 1 << 17) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Row pairs within ``radius``, a bounded number at a time."""
        for row, block in self.comparisons(size):
            row, block, lanes = self.within(row, block, radius)
            for at in range(0, len(row), 1 << 13):
                part = slice(at, at + (1 << 13))
                grid = np.unpackbits(lanes[part].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
                i, lane = np.nonzero(grid)
                yield row[part][i], self.block_start[block[part][i]] + lane


def join_labels(labels: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Merge the classes of the pairs; labels stay flat (a label is its own label)."""
    a, b = labels[a], labels[b]
    while (open_ := a != b).any():
        a, b = a[open_], b[open_]
        np.minimum.at(labels, np.maximum(a, b), np.minimum(a, b))
        while not np.array_equal(up := labels[labels], labels):
            labels[:] = up
        a, b = labels[a], labels[b]


def bucket_stars(fps: np.ndarray, bucket: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """(member, representative) of each local component of linked fingerprints."""
    shared = np.concatenate([[False], bucket[1:] == bucket[:-1]])
    keep = shared | np.concatenate([shared[1:], [False]])
    fps, bucket = fps[keep], bucket[keep]
    if not len(fps):
        return fps, fps
    labels = np.arange(len(fps))
    for a, b in BitSlices(fps, bucket).pairs(radius):
        join_labels(labels, a, b)
    moved = np.flatnonzero(labels != np.arange(len(fps)))
    return fps[moved], fps[labels[moved]]


def _stars(rows: DataFrame, radius: int) -> DataFrame:
    """Bucket rows (mask, value, tile, fp) to star edges (src, dst)."""
    keys = ["mask", "value", "tile"]
    dealt = rows.repartition(*keys).sortWithinPartitions(*keys, "fp")
    schema = pa.schema([("src", pa.int64()), ("dst", pa.int64())])

    def edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def made(part: list[np.ndarray]) -> pa.RecordBatch:
            change = np.any([x[1:] != x[:-1] for x in part[:3]], axis=0)
            bucket = np.concatenate([[0], np.cumsum(change)])
            src, dst = bucket_stars(part[3].view(np.uint64), bucket, radius)
            return pa.RecordBatch.from_arrays([pa.array(src.view(np.int64)), pa.array(dst.view(np.int64))], schema=schema)

        held: list[np.ndarray] | None = None
        for batch in batches:
            part = [np.array(c, np.int64) for c in batch.columns]
            if held is not None:
                part = [np.concatenate(x) for x in zip(held, part, strict=True)]
            # the last bucket may go on in the next batch
            last = np.flatnonzero(np.any([x != x[-1] for x in part[:3]], axis=0))
            cut = int(last[-1]) + 1 if len(last) else 0
            held = [x[cut:] for x in part]
            if cut:
                yield made([x[:cut] for x in part])
        if held is not None and len(held[0]):
            yield made(held)

    return dealt.select("mask", "value", "tile", "fp").mapInArrow(edges, "src long, dst long")


def link_stars(nodes: DataFrame, radius: int = 3, limit: int = 4096, levels: int = 4) -> DataFrame:
    """Star edges that connect all distinct fingerprints ``fp`` within ``radius`` bits."""
    if radius > 3:
        raise ValueError("four agreeing ranges find up to three differing bits")
    signed = [[m - (1 << 64) if m >> 63 else m for m in level] for level in agreeing_masks(levels)]
    found = None
    rows = nodes.select("fp", F.lit(0).cast("long").alias("mask"))
    for depth, masks in enumerate(signed):
        child = F.array(*[F.lit(x).cast("long") for x in masks])
        rows = rows.select("fp", F.explode(F.sequence(F.col("mask") * 4, F.col("mask") * 4 + 3)).alias("mask"))
        rows = rows.select(
            "mask", F.col("fp").bitwiseAND(F.element_at(child, (F.col("mask") + 1).cast("int"))).alias("value"), "fp"
        )
        big = rows.groupBy("mask", "value").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > limit)
        big = stored(big, f"big{depth}")
        if big.isEmpty():
            small, rows = rows, None
        else:
            marked = rows.join(big, ["mask", "value"], "left")
            small = marked.where("n is null").drop("n")
            rows = marked.where("n is not null").drop("n") if depth + 1 < levels else marked.where("n is not null")
        small = small.select("mask", "value", F.lit(0).cast("long").alias("tile"), "fp")
        part = _stars(small, radius)
        found = part if found is None else found.unionByName(part)
        if rows is None:
            return found
        if depth + 1 < levels:
            rows = rows.select("fp", "mask")
    # tiles: every two of a bucket's pieces meet once
    pieces = F.ceil(F.col("n") / F.lit(limit)).cast("long")
    rows = rows.withColumn("pieces", pieces).withColumn("own", F.pmod(F.xxhash64("fp"), F.col("pieces")))
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("pieces") - 1))
    rows = rows.select("mask", "value", "fp", "own", "pieces", other.alias("other"))
    tile = F.least("own", "other") * F.col("pieces") + F.greatest("own", "other") + 1
    return found.unionByName(_stars(rows.select("mask", "value", tile.alias("tile"), "fp"), radius))


def classes(marked: DataFrame, radius: int, limit: int) -> DataFrame:
    """(fp, n, low) of all fingerprints in ``marked`` (id, fp): their rows and the smallest id of each linked class."""
    nodes = stored(marked.groupBy("fp").agg(F.min("id").alias("low"), F.count(F.lit(1)).alias("n")), "nodes")
    stars = component_stars(link_stars(nodes.select("fp"), radius, limit))
    roots = nodes.join(stars.select(F.col("src").alias("fp"), F.col("dst").alias("root")), "fp", "left")
    roots = stored(roots.select("fp", F.coalesce("root", "fp").alias("root"), "low", "n"), "roots")
    lows = roots.groupBy("root").agg(F.min("low").alias("low"), F.count(F.lit(1)).alias("members"))
    return spread_join(roots.select("fp", "root", "n"), stored(lows, "lows"), ["root"], "members").drop("root")


def near_duplicates(
    df: DataFrame, radius: int = 3, limit: int = 4096, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row per record: id, fingerprint (hex) and component_id."""
    marked = stored(fingerprints(df, id_col, text_col).withColumnRenamed(id_col, "id"), "fingerprints")
    # one fingerprint may have a third of all rows
    return spread_join(marked, stored(classes(marked, radius, limit), "classes"), ["fp"]).select(
        F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("low").alias("component_id")
    )
