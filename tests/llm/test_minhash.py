import random

import numpy as np

import corpus_pipeline
from siltstone.llm import minhash, simhash


def shingles(text):
    words = text.lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def brute_kept(docs):
    """Smallest id of each class linked by an exact Jaccard similarity of at least 0.8."""
    sets, label = [shingles(t or "") for _, t in docs], list(range(len(docs)))
    pairs = []
    for i in range(len(docs)):
        for j in range(i):
            a, b = sets[i], sets[j]
            if 5 * len(a & b) >= 4 * len(a | b):
                pairs.append((i, j))
                old, new = label[i], label[j]
                label = [new if x == old else x for x in label]
    return sorted(min(docs[i][0] for i in range(len(docs)) if label[i] == x) for x in set(label)), pairs


def planted(seed):
    rng = random.Random(seed)
    vocab = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(3, 7))) for _ in range(900)]
    texts = []
    for n in range(40):
        base = [rng.choice(vocab) for _ in range(rng.randint(60, 240))]
        texts.append(base)
        for _ in range(rng.randint(1, 5)):
            copy = list(base)
            for at in rng.sample(range(len(copy)), rng.randint(1, max(1, len(copy) // 30))):
                copy[at] = rng.choice(vocab)
            texts.append(copy[rng.randrange(8) :])
    rows = [(n, " ".join(t)) for n, t in enumerate(texts)]
    rows += [(500, None), (501, ""), (502, " \n"), (503, "two words"), (504, "Two  words"), (505, rows[0][1].upper())]
    rng.shuffle(rows)
    return rows


def test_stage_keeps_one_of_all_pairs_of_similarity_08(spark):
    rows = planted(4)
    want, pairs = brute_kept(rows)
    near = sum(shingles(rows[i][1] or "") != shingles(rows[j][1] or "") for i, j in pairs)
    assert near > 40
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS mark", "2 AS node")
    assert sorted(r.doc_id for r in corpus_pipeline.keep_unique(spark, df, "").collect()) == want
    # groups cut into pieces, down to one text a piece
    got = minhash.keep_one_of_each(df, weight=600)
    assert got.columns == df.columns and sorted(r.doc_id for r in got.collect()) == want


def test_fingerprints_give_candidates(spark):
    tail = lambda c: " ".join(f"{c}{i}" for i in range(12))
    often = "one two three four five six seven " * 60
    rows = [(5, often + tail("a")), (2, often + tail("b")), (3, tail("c")), (4, tail("d")), (7, None), (8, often + tail("a"))]
    fps = [np.uint64(simhash.fingerprint(t or "")).astype(np.int64).item() for _, t in rows]
    held = spark.createDataFrame([(n, fp) for (n, _), fp in zip(rows, fps, strict=True)], "node long, fp long")
    found = {(r.src, r.dst) for r in simhash.component_stars(minhash._fingerprint_links(held, 3)).collect()}
    assert found == {(5, 2), (8, 2)}
    # the exact check follows: 5 and 2 share a fingerprint, not their shingles
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(r.doc_id for r in corpus_pipeline.keep_unique(spark, df, "").collect()) == brute_kept(rows)[0] == [2, 3, 4, 5, 7]


def test_links_are_exact():
    rows = planted(5)
    sets = [s for _, t in rows if len(s := minhash.grams(t or ""))]
    label = list(range(len(sets)))
    for a, b in minhash.links(sets, np.zeros(len(sets), int)):
        assert 9 * len(np.intersect1d(sets[a], sets[b])) >= 4 * (len(sets[a]) + len(sets[b]))
        label = [label[b] if x == label[a] else x for x in label]
    for i in range(len(sets)):
        for j in range(i):
            if 9 * len(np.intersect1d(sets[i], sets[j])) >= 4 * (len(sets[i]) + len(sets[j])):
                assert label[i] == label[j]
