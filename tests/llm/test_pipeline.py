import hashlib
import random

import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from siltstone.llm import quality
from tests.llm.test_decontaminate import words
from tests.llm.test_minhash import brute_kept, shingles
from tests.llm.test_pii import brute as brute_spans


def write(spark, folder, name, rows, schema):
    spark.createDataFrame(rows, schema).repartition(2).write.parquet(f"{folder}/{name}.parquet")


def test_pipeline_matches_brute_force(spark, tmp_path):
    rng = random.Random(8)
    vocab = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7))) for _ in range(400)]
    text = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    passage = text(14)
    docs = []
    for n in range(120):
        body = text(rng.randint(40, 90))
        if n % 10 == 3:
            body = " ".join(w.upper() + "!!" for w in body.split())
        if n % 10 == 5:
            body += f" mail u{n}@mail.example.com or +1 (706) 555-{n:04d} from 10.1.2.{n}"
        if n % 10 == 7:
            body = f"{text(30)} {passage} {text(20)}"
        docs.append((n, body, "en", f"src{n % 3}", len(body)))
    docs += [(200 + n, docs[n][1] + ("" if n % 2 else "\n"), "en", "copy", 1) for n in range(0, 40, 5)]
    for n in range(1, 40, 6):  # near copies: one word in the middle, or the first few
        w = docs[n][1].split()
        docs.append((250 + n, " ".join([*w[:20], "other", *w[21:]] if n % 2 else w[4:]), "en", "near", 1))
    docs += [(300, None, None, None, None), (301, "", "en", "x", 0), (1, docs[1][1], "en", "again", 5)]
    write(spark, tmp_path, "documents", docs, "doc_id long, text string, lang string, source string, n_chars long")
    write(spark, tmp_path, "labels", [(n, int(n % 10 != 3), 0) for n in range(100)], "doc_id long, quality int, toxic int")
    write(spark, tmp_path, "benchmark", [(1, passage), (2, text(20)), (3, None)], "item_id long, text string")
    sf = f"file://{tmp_path}"
    got = sorted(corpus_pipeline.run(spark, sf).collect())

    frame = spark.read.parquet(f"{sf}/documents.parquet")
    labels = spark.read.parquet(f"{sf}/labels.parquet").where(~quality.held_out())
    predicted = {(r.doc_id): r.predicted for r in quality.score_quality(frame, labels).collect()}
    assert all(p == int(d % 10 != 3) for d, p in predicted.items() if d < 120)
    rest = sorted({(d, t or "") for d, t, *_ in docs if predicted[d]})
    kept, pairs = brute_kept(rest)
    assert sum(shingles(rest[i][1]) != shingles(rest[j][1]) for i, j in pairs) >= 5
    texts, rest = dict(rest), []
    rest = [(d, texts[d]) for d in kept]
    items = [words(passage), words("")]
    held = [tuple(items[0][k : k + 10]) for k in range(len(items[0]) - 9)]
    rest = [(d, t) for d, t in rest if not any(tuple(words(t)[k : k + 10]) in held for k in range(len(words(t))))]
    library, want = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), []
    for d, t in rest:
        at, out = 0, ""
        for kind, a, b in sorted(brute_spans(t), key=lambda s: s[1:]):
            if a >= at:
                out, at = out + t[at:a] + f"<{kind.upper()}>", b
        t = out + t[at:]
        ids = library.encode(t, add_special_tokens=False).ids
        raw = b"".join(i.to_bytes(4, "little") for i in ids)
        want.append((d, len(ids), hashlib.sha256(raw).hexdigest(), hashlib.sha256(t.encode()).hexdigest()))
    assert [tuple(r) for r in got] == sorted(want) and 40 < len(got) < 110


def test_stages_keep_columns(spark, tmp_path):
    rows = [(1, "some plain words of text here", "en", "s", 29)]
    write(spark, tmp_path, "documents", rows, "doc_id long, text string, lang string, source string, n_chars long")
    write(spark, tmp_path, "labels", [(1, 1, 0)], "doc_id long, quality int, toxic int")
    write(spark, tmp_path, "benchmark", [(1, "other words")], "item_id long, text string")
    docs = spark.read.parquet(f"file://{tmp_path}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, f"file://{tmp_path}")
        assert out.columns == docs.columns and [tuple(r) for r in out.collect()] == rows
        assert stage(spark, docs.limit(0), f"file://{tmp_path}").count() == 0
