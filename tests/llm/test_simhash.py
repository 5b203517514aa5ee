import random

import numpy as np
import xxhash

from siltstone.llm import simhash


def brute_fingerprint(text):
    words, word = [], ""
    for ch in text:
        ch = ch.lower() if "A" <= ch <= "Z" else ch
        if ch in " \t\n\x0b\x0c\r":
            words, word = (words + [word] if word else words), ""
        else:
            word += ch
    words += [word] if word else []
    if not words:
        return 0
    n = min(3, len(words))
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + n]).encode(), 42) for i in range(len(words) - n + 1)]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(fps, radius=3):
    """Smallest index reachable, for a list of fingerprints."""
    label = list(range(len(fps)))
    changed = True
    while changed:
        changed = False
        for i in range(len(fps)):
            for j in range(i):
                if (fps[i] ^ fps[j]).bit_count() <= radius and label[i] != label[j]:
                    label[i] = label[j] = min(label[i], label[j])
                    changed = True
    return label


def planted(seed, centres, each, flips):
    rng = random.Random(seed)
    out = []
    for _ in range(centres):
        centre = rng.getrandbits(64)
        for _ in range(each):
            x = centre
            for _ in range(rng.randint(0, flips)):
                x ^= 1 << rng.randrange(64)
            out.append(x)
    return list(dict.fromkeys(out))


def test_fingerprint_matches_definition():
    texts = ["", " \t\n", "One", "A b", "the THE the the", "É x\x0by z\x1cw", "word " * 300, "a b c d e"]
    assert [simhash.fingerprint(t) for t in texts] == [brute_fingerprint(t) for t in texts]


def test_bit_slices_find_exactly_the_close_pairs():
    fps = np.array(planted(1, 6, 60, 5), np.uint64)
    bucket = np.sort(np.arange(len(fps)) % 3)
    got = {tuple(sorted(p)) for a, b in simhash.BitSlices(fps, bucket).pairs(3, 100) for p in zip(a.tolist(), b.tolist())}
    want = {
        (i, j)
        for j in range(len(fps))
        for i in range(j)
        if bucket[i] == bucket[j] and int(fps[i] ^ fps[j]).bit_count() <= 3
    }
    assert got == want


def test_components_match_brute_force_with_hot_buckets(spark):
    fps = planted(2, 8, 25, 4) + planted(3, 150, 1, 0)
    rows = [(i, x - (1 << 64) if x >> 63 else x) for i, x in enumerate(fps)]
    nodes = spark.createDataFrame(rows, "i long, fp long")
    for limit in (4, 10_000):
        stars = simhash.component_stars(simhash.link_stars(nodes.select("fp"), 3, limit, 2))
        root = {r.src: r.dst for r in stars.collect()}
        groups = {}
        for i, x in rows:
            groups.setdefault(root.get(x, x), []).append(i)
        got = [0] * len(fps)
        for members in groups.values():
            for i in members:
                got[i] = min(members)
        assert got == brute_components(fps)


def test_edge_cases(spark):
    text = "one two three four five six seven " * 9
    rows = [(3, None), (1, ""), (2, "  "), (7, text), (7, text), (None, text), (9, "other words entirely here now")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS fp", "2 AS component_id")
    got = sorted((r.doc_id or -1, r.fingerprint, r.component_id) for r in simhash.near_duplicates(df).collect())
    mark = f"{brute_fingerprint(text):016x}"
    assert got[:4] == [(-1, mark, 7), (1, "0" * 16, 1), (2, "0" * 16, 1), (3, "0" * 16, 1)]
    assert got[4:6] == [(7, mark, 7)] * 2
    assert simhash.near_duplicates(df.limit(0)).count() == 0


def test_long_text_and_hot_fingerprints(spark):
    long = "one two three four " * 8_000
    rows = [(n, "" if n % 3 else f"words of document number {n} differ") for n in range(6000)] + [(9000, long)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS fingerprint", "2 AS n", "3 AS root")
    got = {r.doc_id: r for r in simhash.near_duplicates(df).collect()}
    assert len(got) == 6001 and got[9000].fingerprint == f"{brute_fingerprint(long):016x}"
    assert {got[n].component_id for n in range(6000) if n % 3} == {1}
