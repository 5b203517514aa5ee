import random
import zlib

from siltstone.llm import quality


def test_learns_and_generalises(spark):
    rng = random.Random(2)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7))) for _ in range(300)]
    good = lambda: " ".join(rng.choice(words) for _ in range(60)).capitalize() + "."
    bad = lambda: " ".join(rng.choice(words).upper() + "!!" for _ in range(60))
    docs = [(n, good() if n % 4 else bad()) for n in range(400)] + [(900, None), (901, ""), (5, "x y"), (None, "no id")]
    df = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 AS score", "'a' AS label", "1 AS id")
    labels = spark.createDataFrame([(n, int(n % 4 > 0), 0) for n in range(400)] + [(None, 1, 0), (3, None, 0)], "doc_id long, quality int, toxic int")
    got = quality.score_quality(df, labels.where(~quality.held_out()), sample=200).withColumn("held_out", quality.held_out()).collect()
    assert len(got) == len(docs)
    held = [r for r in got if r.doc_id is not None and r.doc_id < 400 and r.held_out]
    assert {r.doc_id for r in held} >= {n for n in range(400) if zlib.crc32(str(n).encode()) % 3 == 1}
    assert sum(r.predicted == int(r.doc_id % 4 > 0) for r in held) / len(held) > 0.98
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)
    assert quality.score_quality(df.limit(0), labels).count() == 0
    assert {r.score for r in quality.score_quality(df, labels.limit(0)).collect()} == {0.5}


def test_shapes():
    assert [quality.shape(w) for w in ("THE!!", "Thnd,", "of", "a1", "Éx", "%%%")] == ["AA!!", "Aa,", "a", "a0", "Aa", "%%%"]
    words = ["Été,", "ß", "İx.", "ªb", "ǅa", "a,,", ".", ",", "x:", "日本", "O'Neil", "ÉÉ", "Aé;", "mixedCase", "ｈ"]
    assert [quality.shape(w) for w in words] == [quality.long_shape(w) for w in words]


def test_no_prefix_of_words_or_texts_decides():
    assert quality.shape("aB1.c-D,e;F:g/h=i+J") != quality.shape("aB1.c-D,e;F:g/h=i+K2")
    long = "word " * 400_000
    a, b = quality.INDICATORS(long + "Tail%%"), quality.INDICATORS(long + "tail")
    assert set(a.tolist()) ^ set(b.tolist()) and len(quality.INDICATORS("x" * 3_000_000)) == 2
    assert max(map(len, quality.INDICATORS.known)) <= 64
    # repetition has numbers of its own
    assert quality.DIM - 1 in quality.INDICATORS("no no no no no") and quality.INDICATORS("a b").max() < quality.DIM - quality.LAGS
