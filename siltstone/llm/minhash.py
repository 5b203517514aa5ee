"""Near-copies by SimHash fingerprints and min-hashes, with an exact check.

Two texts are linked when their sets of distinct 5-word shingles (of XXH64
hashes; fewer words make one shingle) have a Jaccard similarity of at least
0.8.  Texts of equal sets are one node.  Candidates are found in two ways: fingerprints that differ in at most three bits, by the
bit-sliced comparison of ``simhash``, and, for the near copies further apart than that, min-hashes.  128 min-hashes of a set make 32 keys of
four; nodes that share a key are hung on the smallest one, and the components
of these stars and of the fingerprints' links are the candidate groups.  A pair at similarity 0.8 shares no key
with probability (1 - 0.8**4)**32 = 5e-8, a closer one with less.

Inside a candidate group the similarity is exact: shingles are ranked by rarity,
a pair must share one of the rarest fifth of its shingles, and shared ones are
counted.  A group of more than ``weight`` shingles is cut into pieces that meet
pairwise, so no task holds more than two pieces and no pair is lost.  Pairs that
are already joined are not compared again.

Records are named by 128-bit hashes of id and text, and sets by 128-bit hashes of their shingle hashes; two different ones
of 10**11 meet with a probability of 1e-17, and a set's 64-bit number in the graph is given out, not hashed.  A shingle is a
64-bit hash: two different shingles of one pair of texts that meet would change its similarity by one shingle.

Defined results: a null, empty or blank text has an empty set, all of which are
one node; very long texts are compared whole; repeated rows (equal id and text) are one record; of a class
the record of smallest id stays, a null id first; an empty table gives an empty result; other
columns stay as they are, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.llm.common import hold, per_document, spread_join, stored
from siltstone.llm.graph import component_stars
from siltstone.llm.simhash import fingerprint, link_stars

WORDS, KEYS, ROWS = 5, 32, 4
#: Multipliers (odd) and shifts of the min-hashes (fixed values).
_MIX = np.random.default_rng(42).integers(0, 1 << 64, (2, KEYS * ROWS, 1), np.uint64) | np.array([1, 0], np.uint64)[:, None, None]


def grams(text: str, n: int = WORDS) -> np.ndarray:
    """Distinct shingle hashes of a text, ascending."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    joined, n = b" ".join(words), min(n, len(words))
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    first, last = starts[: len(words) - n + 1].tolist(), ends[n - 1 :].tolist()
    digest = xxhash.xxh64_digest
    return np.unique(np.frombuffer(b"".join([digest(joined[a:b]) for a, b in zip(first, last, strict=True)]), np.uint64))


def keys(found: np.ndarray) -> list[int]:
    """The band keys of a set of shingle hashes, none for the empty set."""
    if not len(found):
        return []
    low = np.full(KEYS * ROWS, ~np.uint64(0))
    for at in range(0, len(found), 512):
        np.minimum(low, (found[at : at + 512] * _MIX[0] + _MIX[1]).min(axis=1), out=low)
    digest = xxhash.xxh64_digest
    made = b"".join([digest(x.tobytes(), i) for i, x in enumerate(low.reshape(KEYS, ROWS))])
    return np.frombuffer(made, np.int64).tolist()


def links(sets: list[np.ndarray], own: np.ndarray) -> list[tuple[int, int]]:
    """Pairs that join all sets of similarity >= 0.8; of two pieces (``own``) only pairs across are compared."""
    sizes = np.array([len(s) for s in sets])
    ends = np.cumsum(sizes)
    starts = ends - sizes
    _, number, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    rank = np.empty(len(counts), np.int64)
    rank[np.argsort(counts, kind="stable")] = np.arange(len(counts))
    ranks = rank[number]
    across = len(np.unique(own)) > 1
    labels, marked = np.arange(len(sets)), np.zeros(len(counts), bool)
    holders: dict[int, list[int]] = {}
    made: list[tuple[int, int]] = []
    for i in np.argsort(sizes, kind="stable").tolist():
        mine = np.sort(ranks[starts[i] : ends[i]])
        met: set[int] = set()
        # a partner shares at least four fifths of this set
        for t in mine[: len(mine) + (-4 * len(mine) // 5) + 1].tolist():
            if t in holders:
                met.update(holders[t])
                holders[t].append(i)
            else:
                holders[t] = [i]
        some = np.fromiter(met, np.int64, len(met))
        some = some[(5 * sizes[some] >= 4 * sizes[i]) & (labels[some] != labels[i])]
        if across:
            some = some[own[some] != own[i]]
        marked[mine] = True
        for at in range(0, len(some), 256):
            part = some[at : at + 256]
            part = part[labels[part] != labels[i]]
            if not len(part):
                continue
            shared = np.add.reduceat(
                np.concatenate([marked[ranks[starts[j] : ends[j]]] for j in part]).astype(np.int64),
                np.concatenate([[0], np.cumsum(sizes[part])[:-1]]),
            )
            for j in part[9 * shared >= 4 * (sizes[part] + sizes[i])].tolist():
                if labels[i] != labels[j]:
                    made.append((i, j))
                    labels[labels == labels[j]] = labels[i]
        marked[mine] = False
    return made


def _exact(rows: DataFrame) -> DataFrame:
    """Candidate rows (root, tile, own, node, text) to edges (src, dst)."""
    dealt = rows.repartition("root", "tile").sortWithinPartitions("root", "tile")
    schema = pa.schema([("src", pa.int64()), ("dst", pa.int64())])

    def edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, held = None, []

        def made() -> pa.RecordBatch:
            own, nodes, sets = zip(*held, strict=True)
            pairs = links(list(sets), np.array(own))
            return pa.RecordBatch.from_arrays([pa.array([nodes[p[k]] for p in pairs], pa.int64()) for k in (0, 1)], schema=schema)

        for batch in batches:
            root, tile, own, node, text = batch.columns
            for i in range(batch.num_rows):
                at = root[i].as_py(), tile[i].as_py()
                if at != group:
                    if len(held) > 1:
                        yield made()
                    group, held = at, []
                held.append((own[i].as_py(), node[i].as_py(), grams(text[i].as_py())))
        if len(held) > 1:
            yield made()

    return dealt.select("root", "tile", "own", "node", "text").mapInArrow(edges, "src long, dst long")


def _fingerprint_links(held: DataFrame, radius: int) -> DataFrame:
    """Edges (src, dst) that join the nodes of equal and of linked fingerprints; ``held`` has a row (node, fp) for each fingerprint of a node."""
    lows = stored(held.groupBy("fp").agg(F.min("node").alias("dst"), F.count(F.lit(1)).alias("n")), "fingerprints")
    equal = spread_join(held, lows, ["fp"]).select(F.col("node").alias("src"), "dst")
    stars = link_stars(lows.select("fp"), radius)
    ends = lows.select(F.col("fp").alias("src"), F.col("dst").alias("a")), lows.select(F.col("fp").alias("dst"), F.col("dst").alias("b"))
    return equal.unionByName(stars.join(ends[0], "src").join(ends[1], "dst").select(F.col("a").alias("src"), F.col("b").alias("dst"))).where("src <> dst")


def keep_one_of_each(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", weight: int = 1 << 19, radius: int = 3) -> DataFrame:
    """One record of each class of near-copies, the one of smallest id, with all its columns.

    A record is named by a hash of its id and text, so a repeated id is no clash; the id's length and whether it is null go with it.
    """
    names = [f"c{i}" for i in range(len(df.columns))]
    own_id, own_text = (names[df.columns.index(c)] for c in (id_col, text_col))
    rows = df.toDF(*names)
    name = F.col(own_id).cast("string")
    named = F.concat(F.coalesce(F.length(name).cast("string"), F.lit("null")), F.lit(":"), F.coalesce(name, F.lit("")), F.coalesce(F.col(own_text).cast("string"), F.lit("")))
    rows = rows.withColumn("mark", F.unhex(F.md5(named.cast("binary"))))

    def run(texts: list[str]) -> dict[str, list]:
        hold("minhash", lambda: None)
        sets = [grams(t) for t in texts]
        fps = np.array([fingerprint(t) for t in texts], np.uint64).view(np.int64)
        return {"fp": fps.tolist(), "set": [xxhash.xxh3_128_digest(s.tobytes()) for s in sets], "size": [len(s) for s in sets], "bands": [keys(s) for s in sets]}

    named = rows.select(F.struct(F.col(own_id).alias("id"), "mark").alias("id"), F.col(own_text).alias("text"))
    marked = per_document(named, "id", "text", "fp long, set binary, size long, bands array<long>", run)
    # texts of equal sets may differ in how often they repeat a shingle, hence in their fingerprints
    each = marked.groupBy("set", "fp").agg(F.min("id").alias("low"), F.first("size").alias("size"), F.first("bands").alias("bands"))
    each = stored(each, "sets")
    sets = each.groupBy("set").agg(F.min("low").alias("low"), F.first("size").alias("size"), F.first("bands").alias("bands"))
    nodes = stored(sets.select(F.monotonically_increasing_id().alias("node"), "set", "low", "size", "bands"), "nodes")
    near = _fingerprint_links(stored(each.select("set", "fp").join(nodes.select("set", "node"), "set").select("node", "fp"), "held"), radius)
    nodes = nodes.drop("set")
    banded = nodes.select("node", F.explode("bands").alias("band"))
    shared = banded.groupBy("band").agg(F.min("node").alias("dst"), F.count(F.lit(1)).alias("n")).where("n > 1")
    hung = spread_join(banded, stored(shared, "bands"), ["band"]).select(F.col("node").alias("src"), "dst")
    groups = component_stars(hung.where("src <> dst").unionByName(near))
    groups = groups.unionByName(groups.select(F.col("dst").alias("src"), "dst").distinct())
    members = groups.select(F.col("src").alias("node"), F.col("dst").alias("root")).join(nodes.drop("bands"), "node")
    members = stored(members.select("node", "root", F.col("low.mark").alias("mark"), "size"), "members")
    # a candidate weighs its shingles and a fixed amount for itself
    pieces = F.ceil(F.sum(F.col("size") + 256) / F.lit(weight)).cast("long").alias("pieces")
    weighed = stored(members.groupBy("root").agg(pieces, F.count(F.lit(1)).alias("n")), "weighed")
    # as a stored table its size is known, so a small one is broadcast and no text shuffled
    members = stored(spread_join(members.drop("size"), weighed, ["root"]), "candidates")
    repeated = not rows.groupBy("mark").agg(F.count(F.lit(1)).alias("n")).where("n > 1").isEmpty()
    once = rows.dropDuplicates(["mark"]) if repeated else rows
    text = once.select("mark", F.col(own_text).alias("text")).join(members, "mark")
    text = text.withColumn("own", F.pmod(F.xxhash64("node"), F.col("pieces")))
    text = text.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("pieces") - 1)))
    tile = F.least("own", "other") * F.col("pieces") + F.greatest("own", "other")
    joined = component_stars(_exact(text.select("root", tile.alias("tile"), "own", "node", "text")))
    kept = nodes.join(joined.select(F.col("src").alias("node"), F.col("dst").alias("class")), "node", "left")
    kept = kept.groupBy(F.coalesce("class", "node")).agg(F.min("low").alias("low")).select(F.col("low.mark").alias("mark"))
    return once.join(stored(kept, "kept"), "mark", "left_semi").drop("mark").toDF(*df.columns)
