from pyspark.sql import functions as F

from siltstone import session
from siltstone.functions import text as T
from siltstone.functions import vectors as V
from siltstone.operators import context, lessons, search, tasks


def one(spark, *columns):
    return tuple(spark.range(1).select(*columns).first())


def L(*rows):
    return F.array(*[V.literal(list(r)) if isinstance(r, (list, tuple)) else F.lit(r) for r in rows])


def test_late_interaction_on_basis_vectors(spark):
    q, d = L((1, 0, 0), (0, 1, 0), (0, 0, 1)), L((1, 0, 0), (0.5, 0.5, 0), (0, 0, 1))
    best, mean = one(spark, V.max_sim(q, d), V.avg_sim(q, d))
    assert round(best, 12) == round(2.5 / 3, 12) and round(mean, 12) == round(3 / 9, 12)
    assert one(spark, V.mean_vector(L((1, 2), (3, 4))), V.masked_mean(L((1, 2), (3, 4)), F.array(F.lit(1.0), F.lit(0.0)))) == ([2.0, 3.0], [1.0, 2.0])


def test_vector_formats(spark):
    v = V.literal([1.0, -1.0, 0.5])
    assert one(spark, V.to_int8(v), V.to_uint8(v), V.truncated(v, 2)) == ([127, -127, 63], [255, 0, 191], [1.0, -1.0])
    assert one(spark, V.from_base64(V.to_base64(V.to_float32(v))))[0] == [1.0, -1.0, 0.5]
    assert one(spark, V.distance(v, v), V.distance(v, v, "l2"), V.distance(v, v, "ip"), V.distance(v, v, "odd")) == (0.0, 0.0, -1.25, 0.0)


def test_grades(spark):
    text = F.lit("Grade 10 history and DESIGN")
    assert one(spark, T.grade_of(text), T.subject_of(text), T.all_subjects(text)) == ("1", "Social Studies", ["Social Studies", "Arts & Design"])
    m = lambda a, b: T.grade_match(F.lit(a), F.lit(b))
    assert one(spark, m("K-2", "2"), m("3-5", "6-8"), m("odd", "3"), m("K", "PreK"), m("College", "9-12")) == (True, False, True, False, False)


def test_formatting(spark):
    c = lambda p, s: T.citation_label(F.lit(3), F.lit("doc"), F.lit(p), F.lit(s))
    assert one(spark, c("4-5", 0), c("0", 2), c(None, 0)) == ("[3] doc, pages 4-5", "[3] doc, slide 2", "[3] doc")
    assert one(spark, T.quoted_url(F.lit("a b/é")), T.progress(F.lit(3), F.lit(9))) == ("a%20b/%C3%A9", "3/9")
    assert one(spark, T.safe_file_name(F.lit("..\\x/../a..b\x02")), T.safe_collection(F.lit("  ")))[0] == "ab"
    assert one(spark, T.json_or_empty(F.lit("bad"), "int"), T.json_or_empty(F.lit("[1,2]"), "int")) == ([], [1, 2])
    assert one(spark, T.first_difference(F.lit("abc"), F.lit("abd")), T.first_difference(F.lit("ab"), F.lit("abd")), T.first_difference(F.lit("x"), F.lit("x"))) == (2, 2, None)
    assert one(spark, T.sequence_ratio(F.lit("abcd"), F.lit("bcde")))[0] == 0.75
    assert one(spark, T.resized(F.lit(400), F.lit(300), 30000), T.memory_pressure(F.lit(96)))[0].width == 200


def test_context(spark):
    entry = context.text_entry(F.lit(1), F.lit("s.pdf"), F.lit(0.5), F.lit("body"))
    assert one(spark, entry)[0] == "[1] **Source**: s.pdf | **Relevance**: 0.50\nbody\n"
    image = context.image_entry(F.lit(2), F.lit("i.png"), F.lit(None).cast("string"), F.lit(4), F.lit(5), F.lit("PNG"), F.lit(1.0))
    assert one(spark, image)[0] == "[IMG-2] **File**: i.png | **Description**: Image from i.png | **Relevance**: 1.00\n*Dimensions*: 4x5 | *Format*: PNG\n"
    none = F.lit(None).cast("string")
    assert one(spark, context.multimodal(none, none), context.multimodal(F.lit("t"), F.lit("i"))) == (
        context.NO_CONTEXT, "**Text Sources:**\n\nt\n---\n\n**Image Sources:**\n\ni",
    )


LESSON = '---\ntitle: "A: B"\nduration: 45\nfav: true\ntitle: C\n---\nlost\n# One\na [2]\n\nb [1]\n## Two\n![pic](p.png)\n*Figure 3: cap [Source: [IMG-2]]*\n![](q.png)'


def test_relevance_is_rounded_from_the_binary_value(spark):
    scores = [0.145, 0.155, 0.125, 0.375, 0.995, 1.0, 0.0, 1234.5]
    for kind in (lambda s: context.text_entry(F.lit(1), F.lit("s"), s, F.lit("b")), lambda s: context.image_entry(F.lit(1), F.lit("i"), F.lit("d"), F.lit(1), F.lit(1), F.lit("f"), s)):
        rows = spark.createDataFrame([(x,) for x in scores], "x double").select("x", kind(F.col("x")).alias("e")).collect()
        assert all(f"**Relevance**: {r.x:.2f}\n" in r.e for r in rows)


def test_lessons(spark):
    text = F.lit(LESSON)
    f, s, i = one(spark, lessons.frontmatter(text), lessons.sections(text), lessons.images(text))
    assert f == {"title": "C", "duration": "45", "fav": "true"}
    assert [(x.level, x.title) for x in s] == [(1, "One"), (2, "Two")] and s[0].content == "a [2]\nb [1]"
    assert [(x.alt_text, x.path, x.figure, x.source) for x in i] == [("pic", "p.png", "Figure 3", 2), ("Image", "q.png", None, 2)]
    assert one(spark, lessons.without_frontmatter(text))[0].startswith("lost\n# One")
    back = one(spark, lessons.as_markdown(lessons.frontmatter(text), lessons.sections(text)))[0]
    assert one(spark, lessons.sections(F.lit(back)))[0] == s


def test_enrichment_and_tasks(spark):
    meta = F.create_map(F.lit("edu_grade"), F.lit("9"), F.lit("k"), F.lit("v"))
    assert one(spark, lessons.enriched(meta, F.lit("3"), F.lit(None).cast("string")))[0] == {"k": "v", "edu_grade": "3", "edu_content_type": "educational"}
    df = spark.createDataFrame([("a", True), ("b", False)], "id string, is_favorite boolean")
    assert {r.id: r.is_favorite for r in tasks.toggled(df, "id", "a").collect()} == {"a": False, "b": False}
    now = F.lit("2024-02-01").cast("timestamp")
    old = lambda x: tasks.checkpoint_expired(F.lit(x), now, 7)
    assert one(spark, old("2024-01-01"), old("2024-01-31"), old("junk")) == (True, False, False)


def test_rerank_and_batches(spark):
    hits = spark.createDataFrame([("1", "red fox", 0.2), ("2", "blue sky", 0.9), ("3", None, 0.5)], "id string, document string, score double")
    got = search.rerank(hits, search.overlap_scorer, "red fox").collect()
    assert [r.id for r in got] == ["1", "2", "3"] and got[2].score == 0.5
    rows = [(n, [float(n % 7), 1.0, float(n % 3)]) for n in range(50)]
    df = spark.createDataFrame(rows, "id long, embedding array<double>")
    queries = df.where("id < 9").selectExpr("id AS query_id", "embedding AS query_vector")
    whole = sorted(map(tuple, search.batch_top_k(df, queries, 4).collect()))
    assert whole == sorted(map(tuple, search.batch_top_k(df, queries, 4, block=3).collect())) and len(whole) == 36
    assert search.batch_top_k(df, queries.limit(0), 4).count() == 0 and search.batch_top_k(df.limit(0), queries, 4).count() == 0
    assert session.optimal_batch_size(100, 10) == 6 and session.optimal_batch_size(1, 100) == 1


def test_wrapping_and_prompts(spark):
    assert one(spark, T.wrapped(F.lit("aa bb cccc d eeeeeeee"), 5), T.wrapped(F.lit(" "), 5)) == (["aa bb", "cccc", "d", "eeeeeeee"], [])
    text = lessons.lesson_prompt(F.lit("T"), F.lit("3"), F.lit("S"), F.lit(45), F.array(F.lit("x" * 600), F.lit("y")))
    assert one(spark, text)[0].endswith("Sources:\n[1] " + "x" * 500 + "...\n[2] y")
    out = one(spark, lessons.assembled_lesson(F.lit(LESSON), F.lit("topic"), F.lit("---\nnew: 1\n---\n")))[0]
    assert out.title == "C" and out.markdown.startswith("---\nnew: 1\n---\n\nlost\n# One")


def test_memory_of_a_search_does_not_grow_with_its_queries():
    import tracemalloc
    from types import SimpleNamespace

    import numpy as np
    import pandas as pd

    rng = np.random.default_rng(3)
    q, x = rng.normal(size=(4096, 8)), rng.normal(size=(2048, 8))
    x[1024:] = x[:1024]  # ties
    run = search._nearest(SimpleNamespace(value=(list(range(4096)), q)), 3, "l2")
    tracemalloc.start()
    got = pd.concat(run(iter([pd.DataFrame({"id": range(2048), "v": list(x)})])))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 150 << 20
    want = ((q[:50, None] - x[None]) ** 2).sum(-1).round(12)
    for i in range(50):
        order = np.lexsort((np.arange(2048), want[i]))[:3]
        assert sorted(got[got.q == i].id) == sorted(order.tolist())
