import hashlib
import random
import re
import tracemalloc

import numpy as np

from siltstone.llm import decontaminate

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, size=10):
    out = {}
    for d, text in docs:
        w, hit, found = words(text), set(), set()
        for i, item in items:
            q = words(item)
            n = min(size, len(q))
            for k in range(len(q) - n + 1 if q else 0):
                for at in range(len(w) - n + 1):
                    if w[at : at + n] == q[k : k + n]:
                        hit.update(range(at, at + n))
                        found.add(str(i))
        digest = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
        out[d] = (len(w), len(hit), len(found), digest, bool(hit))
    return out


def fixture():
    rng = random.Random(4)
    vocab = ["a", "b", "cé", "d1", "E", "ü", "the"]
    text = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    items = [(n, text(rng.choice([0, 1, 2, 4, 9, 10, 11, 25]))) for n in range(30)]
    items = [(n, t) for n, t in items if len(words(t)) != 1] + [(100, None), (101, "..."), (102, "zebra"), (7, "a b")]
    docs = [(n, text(rng.randint(0, 60))) for n in range(40)]
    docs += [(50, None), (51, ""), (52, "x" * 5000), (53, "ZEBRA-zebra!"), (54, items[3][1] * 3)]
    docs += [(60 + n, f"{text(30)}, {t} {text(300)}") for n, (_, t) in enumerate(items[:8])]
    return docs, items


def rows(df):
    return {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in df.collect()}


def test_matches_brute_force_in_one_and_many_blocks(spark):
    docs, items = fixture()
    d = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 AS n_words", "2 AS items")
    b = spark.createDataFrame(items, "item_id long, text string")
    want = brute(docs, items)
    assert rows(decontaminate.find_contamination(d, b)) == want
    assert rows(decontaminate.find_contamination(d, b, block_bytes=200)) == want


def test_empty_tables(spark):
    d = spark.createDataFrame([(1, "some words here"), (1, "some words here")], "doc_id long, text string")
    b = spark.createDataFrame([], "item_id long, text string")
    assert [(r.n_words, r.n_hit, r.contaminated) for r in decontaminate.find_contamination(d, b).collect()] == [(3, 0, False)] * 2
    assert decontaminate.find_contamination(d.limit(0), b).count() == 0


def many_items(n_bytes, seed=1):
    rng = np.random.default_rng(seed)
    lengths, out = rng.integers(20, 400, n_bytes // 1400 + 1), []
    for i, n in enumerate(lengths):
        out.append((i, " ".join(f"w{x:06d}" for x in rng.integers(0, 200_000, n))))
    return out


def test_memory_of_a_block_is_bounded():
    items = [(str(i), t) for i, t in many_items(4 << 20)]
    assert 3 << 20 < sum(len(t) for _, t in items)
    tracemalloc.start()
    matcher = decontaminate.Matcher(items)
    kept, peak = tracemalloc.get_traced_memory()
    tracemalloc.stop()
    assert kept < 64 << 20 and peak < 160 << 20, (kept, peak)
    text = f"zero {items[5][1]} end"
    hits, found = matcher.scan([decontaminate.words_of(text)])
    assert found == [{"5"}] and int(hits[0].sum()) == len(items[5][1].split())


def test_twenty_megabytes_of_items(spark):
    items = many_items(20 << 20)
    b = spark.createDataFrame(items, "item_id long, text string").repartition(8)
    docs = [(n, f"begin {items[n * 100][1]} x {items[n * 100 + 1][1]}") for n in range(20)] + [(99, "w000001 " * 50)]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    assert len(decontaminate.Blocks(b, 10, 4 << 20, "item_id", "text").sent) >= 5
    got = {r.doc_id: r["items"] for r in decontaminate.find_contamination(d, b).collect()}
    assert got == {n: sorted((str(n * 100), str(n * 100 + 1))) for n in range(20)} | {99: []}
    assert [r.doc_id for r in decontaminate.drop_contaminated(d, b).collect()] == [99]


def test_long_text_and_items_with_equal_windows(spark):
    passage = " ".join(f"p{n}" for n in range(12))
    items = [(n, f"{passage} tail{n}") for n in range(40)] + [(n, f"{passage} tail{n}") for n in range(40)]
    long = "é plain words 12 " * 300_000 + passage + " and more" * 100_000
    d = spark.createDataFrame([(1, long), (2, passage)], "doc_id long, text string")
    b = spark.createDataFrame(items, "item_id long, text string")
    got = {r.doc_id: r for r in decontaminate.find_contamination(d, b).collect()}
    assert got[1].n_items == got[2].n_items == 40 and got[1].n_hit == got[2].n_hit == 12 and got[1].n_words == 1_400_012
