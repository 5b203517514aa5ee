import random
import re

import pytest
from pyspark.sql import functions as F

from siltstone.llm import licences as L
from siltstone.llm.queries import op11_licence_automaton

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return WORD.findall((text or "").translate(FOLD))


def base(text):
    """(n_words, n_base, first, last, labels) from the definition."""
    w, hits = words(text), []
    for phrase, label in L.BASE:
        p = phrase.split()
        hits += [(i, label) for i in range(len(w) - len(p) + 1) if w[i : i + len(p)] == p]
    at = [i for i, _ in hits]
    return len(w), len(at), min(at, default=None), max(at, default=None), ",".join(sorted({label for _, label in hits}))


def longest(text, templates):
    """For every word, the longest run of words ending there that some template holds."""
    w, out = words(text), []
    padded = [f" {' '.join(words(t))} " for t in templates]
    n = 0
    for i in range(len(w)):
        n += 1
        while n and not any(f" {' '.join(w[i - n + 1 : i + 1])} " in p for p in padded):
            n -= 1
        out.append(n)
    return out


def test_matching_statistics_equal_brute_force():
    rng = random.Random(2)
    for _ in range(60):
        text = lambda n, letters="abcd": " ".join(rng.choices(letters, k=n))
        phrases = [(text(rng.randint(1, 4)), f"p{i}") for i in range(4)]
        templates = [(text(rng.randint(5, 25)), f"t{i}") for i in range(3)]
        machine = L.Automaton(phrases, templates, 2)
        doc = text(60, "abcdx")
        n, whole, runs = machine.stream(doc, 3)
        want = longest(doc, [t for t, _ in phrases + templates])
        ends = [i + 1 for i, m in enumerate(want) if m >= 3 and (i + 1 == len(want) or want[i + 1] != m + 1)]
        assert n == 60 and [(e, want[e - 1]) for e in ends] == [(e, m) for e, _, m in runs]
        w = doc.split()
        hits = sorted((e, k) for k, (p, _) in enumerate(phrases) for e in range(1, 61) if w[max(0, e - len(p.split())) : e] == p.split())
        assert sorted(whole) == hits
        for _, state, m in runs:  # all places of a run in the long templates
            run = w[: [r[0] for r in runs if r[1] == state and r[2] == m][0]][-m:]
            places = {(len(phrases) + k, e) for k, (t, _) in enumerate(templates) for e in range(m, len(t.split()) + 1) if t.split()[e - m : e] == run}
            assert set(machine.places[state]) == places


def test_chains():
    machine = L.Automaton([], [("a b c d e f g h i j k l", "t")], 0)
    span = lambda doc, **k: machine.spans(*machine.stream(doc, 3)[1:], **({"share": 0.5, "gap": 5} | k))
    assert span("x a b c d e f g h i j k l x") == [L.Span("t", 1, 13, 12, 1.0)]
    assert span("a b c d x y f g h i z j k l") == [L.Span("t", 0, 14, 11, 11 / 12)]
    assert span("a b c d " + "x " * 9 + "f g h i") == []  # too far apart, and each too small
    assert span("g h i j k l q a b c d e f") == [L.Span("t", 0, 6, 6, 0.5), L.Span("t", 7, 13, 6, 0.5)]  # order counts
    twice = "a b c d e f g h i j k l " * 2
    assert [(s.start, s.end) for s in span(twice)] == [(0, 12), (12, 24)]
    assert span("a b c d e f g h", share=0.7) == []


def one(text):
    machine = L._automaton(L.NAMES, L.TEXTS)
    _, whole, runs = machine.stream(text, 4)
    return [(s.label, round(s.share, 2)) for s in machine.spans(whole, runs, 0.5, 40)]


def test_licences():
    for label, texts in L.TEXTS.items():
        for text in texts:
            assert one(f"Intro words here. {text} And the rest of it.") == [(label, 1.0)], label
    for label, names in L.NAMES.items():
        for name in names:
            assert one(f"This is covered by the {name}.") == [(label, 1.0)], name
    assert one("Licensed under CC BY-NC 4.0.") == [("cc-by-nc-4.0", 1.0)]
    assert one("see https://creativecommons.org/licenses/by-sa/4.0/") == [("cc-by-sa-4.0", 1.0)]
    assert one("GNU General Public License, version 4") == [] and one("the software and the copyright holder, of course") == []
    changed = L.TEXTS["mit"][0].replace("free of charge", "at no cost").replace("Software", "Program", 2).replace("publish,", "print,")
    (found,) = one(f"Copyright 2020 A. N. Other {changed}")
    assert found[0] == "mit" and 0.85 < found[1] < 1
    half = " ".join(L.TEXTS["bsd-3-clause"][0].split()[:150])
    assert [x for x, _ in one(half)] == ["bsd-3-clause"]


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(4)
    parts = [*(p for p, _ in L.BASE), "MIT", "License", "general public", "public license", "x", "é", "mit-license", "ſ", "\n", *L.TEXTS["mit"], *L.TEXTS["gpl-3.0"]]
    rows = [(i, " ".join(rng.choices(parts, k=rng.randint(0, 12)))) for i in range(150)]
    rows += [(None, "MIT license"), (200, None), (201, ""), (202, " ,"), (3, rows[3][1]), (203, "the mit " * 400_000 + "license")]
    return rows


def test_query_columns_equal_brute_force(spark, docs):
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("labels", F.lit("clash")).repartition(4)
    got = sorted(((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in L.scan_licences(df).collect()), key=repr)
    assert got == sorted(((i, *base(t)) for i, t in docs), key=repr)
    for r in L.scan_licences(df).collect():
        assert set(filter(None, r.base_labels.split(","))) <= set(filter(None, r.labels.split(","))) and 0 <= r.score <= 1
        assert (r.score > 0) == bool(r.n_base or r.n_spans) and r.n_spans == len(r.spans)


def test_empty_table_and_query(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert L.scan_licences(empty).count() == 0
    path = "/root/testdata/sf0.001"
    found = op11_licence_automaton(spark, path)
    assert found.columns[:8] == ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{path}/documents.parquet").collect()}
    assert all((r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == base(texts[r.doc_id]) for r in found.collect())
