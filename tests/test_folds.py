"""Order-dependent operators against direct loops."""

import random
import re

from pyspark.sql import functions as F

from siltstone.operators import chunking, metrics, numbering, regions, scans


def test_sentence_chunks_by_hand(spark):
    """Worked by hand: sentences of 4, 6 and 3 characters; without overlap a new chunk's size starts at -1."""
    df = spark.createDataFrame([(1, "aaa. bbbbb. cc."), (2, ""), (3, "one")], "doc_id long, text string")

    def got(most, overlap):
        rows = chunking.sentence_chunks(df, most, overlap).orderBy("doc_id", "chunk_index").collect()
        return [(r.doc_id, r.chunk_index, r.content, r.start_index, r.end_index, r.sentence_count) for r in rows]

    assert got(100, 1) == [(1, 0, "aaa. bbbbb. cc.", 1, 16, 3), (3, 0, "one", 1, 4, 1)]
    assert got(11, 0) == [(1, 0, "aaa. bbbbb.", 1, 12, 2), (1, 1, "cc.", 14, 16, 1), (3, 0, "one", 1, 4, 1)]
    assert got(11, 1) == [(1, 0, "aaa. bbbbb.", 1, 12, 2), (1, 1, "bbbbb. cc.", 6, 16, 2), (3, 0, "one", 1, 4, 1)]


def test_sentence_chunks_keep_their_promises(spark):
    rng = random.Random(1)
    texts = [" ".join("x" * rng.randint(1, 40) + rng.choice(".!?") for _ in range(rng.randint(0, 30))) for _ in range(30)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for most, overlap in ((60, 1), (60, 0), (10, 2), (200, 3)):
        chunks = {}
        for r in chunking.sentence_chunks(df, most, overlap).orderBy("doc_id", "chunk_index").collect():
            chunks.setdefault(r.doc_id, []).append(r)
        for n, text in enumerate(texts):
            whole, seen = [s.strip() for s in re.split(r"(?<=[.!?])\s+", text) if s.strip()], []
            for i, r in enumerate(chunks.get(n, [])):
                parts = r.content.split(" ")
                assert r.chunk_index == i and r.sentence_count == len(parts)
                repeated = min(overlap, len(chunks[n][i - 1].content.split(" "))) if i else 0
                assert not i or parts[:repeated] == chunks[n][i - 1].content.split(" ")[-repeated or len(parts) + 999 :]
                seen += parts[repeated:]
                # the check leaves out the last separator, and the first one after a cut without overlap; only a repeated tail or a long sentence goes further
                assert len(r.content) <= most + 1 + (overlap == 0) or len(parts) <= overlap + 1
                # positions advance by each new sentence and one separator
                assert r.end_index == sum(len(x) + 1 for x in seen)
            assert seen == whole


def pages_by_hand(spans, pages):
    """(page, pages, number) of each span: every page that shares characters, the largest share first, then the smallest number."""
    out = []
    for start, end in spans:
        shared = sorted((-(min(end, b) - max(start, a)), n) for n, a, b in pages if max(start, a) < min(end, b))
        numbers = sorted(n for _, n in shared)
        out.append((shared[0][1] if shared else None, numbers or None, len(numbers) or None))
    return out


def test_pages_with_any_boundaries(spark):
    """Irregular, overlapping, nested, empty, repeated and missing pages, in any order."""
    rng = random.Random(6)
    rows = []
    for n in range(40):
        length = rng.randint(1, 900)
        pages = [(k, a := rng.randint(0, length), a + rng.choice([0, 1, 30, 200, 900])) for k in range(rng.choice([0, 1, 3, 40]))]
        rng.shuffle(pages)
        rows.append((n, "y" * length, pages))
    rows += [(40, "z" * 100, None), (41, "z" * 100, [(1, 0, 60), (2, 40, 100), (3, 100, 100), (4, 500, 900)]), (42, "z" * 100, [(2, 0, 50), (1, 50, 100)])]
    df = spark.createDataFrame(rows, "doc_id long, text string, pages array<struct<page_number:int,page_start:int,page_end:int>>")
    table = df.select("doc_id", F.inline("pages"))
    key = ["doc_id", "chunk_index", "page_number", "page_numbers", "pages_spanned"]
    for size, overlap, width in ((100, 10, None), (30, 0, 64), (64, 60, 7)):
        inside = chunking.fixed_chunks(df, size, overlap, pages=F.col("pages"))
        want = {}
        for r in inside.collect():
            want.setdefault(r.doc_id, []).append((r.start_index, r.end_index, r.chunk_index))
        want = {(d, c[2], *p) for d, cs in want.items() for c, p in zip(cs, map(lambda x: (x[0], tuple(x[1]) if x[1] else None, x[2]), pages_by_hand([c[:2] for c in cs], rows[d][2] or [])), strict=True)}
        plain = lambda d: {(*r[:3], tuple(r[3]) if r[3] else None, r[4]) for r in d.select(key).collect()}
        assert plain(inside) == want
        joined = chunking.attribute_pages(chunking.fixed_chunks(df, size, overlap), table, width=width)
        assert plain(joined) == {w for w in want if w[2] is not None}
    assert (41, 0, 1, (1, 2), 2) in {(*r[:3], tuple(r[3]), r[4]) for r in chunking.fixed_chunks(df.where("doc_id = 41"), 100, 0, pages=F.col("pages")).select(key).collect()}


def test_pages_of_a_long_document(spark):
    """5,000 pages and 20,000 chunks of one document: the search looks at few pages for each."""
    df = spark.range(1).select(F.col("id").alias("doc_id"), F.repeat(F.lit("abcd "), 500_000).alias("text"))
    pages = F.transform(F.sequence(F.lit(1), F.lit(5000)), lambda n: F.struct(n.alias("page_number"), ((n - 1) * 500).alias("page_start"), (n * 500).alias("page_end")))
    found = chunking.fixed_chunks(df, 125, 0, pages=pages)
    wrong = found.where("page_number <> start_index DIV 500 + 1 OR pages_spanned <> 1")
    assert found.count() == 20_000 and wrong.count() == 0


def test_chunks_of_repeated_ids_are_numbered_apart(spark):
    rows = [(1, "a" * 900, "x"), (1, "b" * 900, "y"), (2, " " * 448 + "é" * 100, "z"), (3, "", "w"), (4, None, "v")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = sorted((r.lang, r.chunk_index, r.start_index, r.end_index, r.content[0], len(r.content), r.total_chunks) for r in chunking.fixed_chunks(df, 512, 64, keep=["lang"]).collect())
    assert got == [("x", 0, 0, 512, "a", 512, 2), ("x", 1, 448, 900, "a", 452, 2), ("y", 0, 0, 512, "b", 512, 2), ("y", 1, 448, 900, "b", 452, 2),
                   ("z", 0, 0, 512, " ", 512, 2), ("z", 1, 448, 548, "é", 100, 2)]
    plan = chunking.fixed_chunks(df, 512, 64)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan


def regions_of(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, region_sequence int, region_type string, content string, page_number int").repartition(3)


def test_region_chunks_by_hand(spark):
    kinds = [
        ("text", "aaaa", 1), ("text", "bbbb", 1), ("list", "cc", 2),  # 4 + 4 fit into 9, 2 more do not
        ("table", "a very long table", 2),  # alone, however long
        ("text", "d", 2), ("title", "T", 3), ("text", "eeeeeeeee", None), ("heading", "H", 3),  # titles open a chunk; 1 + 9 is too much
        ("text", "x" * 30, 4), ("text", None, 4), ("image", "i", 5), ("image", "j", 5), (None, "z", 6),
    ]
    rows = [(1, n, k, t, p) for n, (k, t, p) in enumerate(kinds)] + [(2, 0, "equation", "e", None)]
    got = chunking.region_chunks(regions_of(spark, rows), 9).orderBy("doc_id", "chunk_index").collect()
    assert [(r.content, r.n_regions, r.atomic) for r in got] == [
        ("aaaa\n\nbbbb", 2, False), ("cc", 1, False), ("a very long table", 1, True), ("d", 1, False), ("T", 1, False), ("eeeeeeeee", 1, False), ("H", 1, False),
        ("x" * 30, 1, False), ("", 1, False), ("i", 1, True), ("j", 1, True), ("z", 1, False), ("e", 1, True),
    ]
    assert [r.chunk_index for r in got] == [*range(12), 0]
    assert got[0].region_types == ["text", "text"] and got[0].page_numbers == [1] and got[5].page_numbers == []


def test_region_chunks_keep_their_promises(spark):
    rng = random.Random(2)
    docs = {d: [(rng.choice(["text", "text", "list", "title", "table", "image"]), "y" * rng.randint(0, 50)) for _ in range(rng.randint(1, 40))] for d in range(20)}
    rows = [(d, i, k, t, i // 3) for d, rs in docs.items() for i, (k, t) in enumerate(rs)]
    chunks = {}
    for r in chunking.region_chunks(regions_of(spark, rows), 80).orderBy("doc_id", "chunk_index").collect():
        chunks.setdefault(r.doc_id, []).append(r)
    for d, regions_ in docs.items():
        assert [k for c in chunks[d] for k in c.region_types] == [k for k, _ in regions_]  # all of them, in order
        assert [x for c in chunks[d] for x in c.content.split("\n\n")] == [t for _, t in regions_]
        for c, after in zip(chunks[d], [*chunks[d][1:], None], strict=True):
            size = sum(map(len, c.content.split("\n\n")))
            assert c.n_regions == 1 or size <= 80 and not {"table", "image"} & set(c.region_types) and "title" not in c.region_types[1:]
            if after and not c.atomic and after.region_types[0] in ("text", "list"):  # it would not have fitted
                assert size + len(after.content.split("\n\n")[0]) > 80


def greedy(tokens, most, items):
    """Numbers of the batches, by closing one as soon as the next row does not fit."""
    out, number, total, held = [], 0, 0, 0
    for t in tokens:
        if held and (total + t > most or held == items):
            number, total, held = number + 1, 0, 0
        total, held = total + t, held + 1
        out.append(number)
    return out


def test_token_batches(spark):
    rng = random.Random(3)
    rows = [(rng.choice(["hot", "hot", "hot", "b", None]), n, "w " * rng.choice([0, 0, 3, 40, 400, 9000])) for n in range(700)]
    rows += [("one", 5000, "x"), ("last", 5001, None)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "key string, id long, text string").repartition(5).withColumn("batch_number", F.lit("clash"))
    for most, items, piece in ((8192, 32, 65_536), (8192, 32, 32), (300, 8, 16), (1, 3, 4), (10**9, 5, 8)):
        got = {}
        for r in chunking.token_batches(df, most, items, rows=piece).collect():
            got.setdefault(r.key, []).append((r.id, r.tokens, r.batch_number))
        assert sum(map(len, got.values())) == len(rows)
        for key, found in got.items():
            own = sorted((i, int(len((t or "").split()) * 1.3)) for k, i, t in rows if k == key)
            assert sorted(found) == [(i, t, b) for (i, t), b in zip(own, greedy([t for _, t in own], most, items), strict=True)]


def test_runs_and_progress_over_pieces(spark):
    rng = random.Random(9)
    rows = [(rng.choice(["hot"] * 6 + ["b", None]), rng.randint(0, 3000) * 1.5, n, rng.choice([None, 1.0, 2.5, 4.0])) for n in range(900)] + [("none", 1.0, 5000, None)]
    df = spark.createDataFrame(rows, "g string, at double, id long, seconds double").repartition(6)
    groups = {g: sorted((a, i, s) for h, a, i, s in rows if h == g) for g in {r[0] for r in rows}}
    for piece in (65_536, 32, 1):
        runs = {r.id: r.gap_group for r in metrics.gap_groups(df, "g", "at", 6, "id", piece).collect()}
        share = {r.id: (r.done, r.share, r.eta) for r in metrics.progress(df, "g", "id", "seconds", piece).collect()}
        numbers = {r.id: r.n for r in scans.numbered(df, "g", ["at", "id"], rows=piece).collect()}
        assert len(runs) == len(share) == len(numbers) == len(rows)
        for own in groups.values():
            run = 0
            for k, (a, i, _) in enumerate(own):
                run += bool(k and a - own[k - 1][0] > 6)
                assert (runs[i], numbers[i]) == (run, k)
            times = []
            for k, (i, s) in enumerate(sorted((i, s) for _, i, s in own), 1):
                times += [s] * (s is not None)
                done, part, eta = share[i]
                assert (done, part) == (k, k / len(own))
                assert eta is None if not times else abs(eta - sum(times) / len(times) * (len(own) - k)) < 1e-9


def test_a_large_group_lies_in_many_pieces(spark):
    df = spark.range(30_000).select(F.when(F.col("id") % 3 == 0, -1).otherwise(F.col("id")).alias("g"), "id")
    placed = scans.in_pieces(df.repartition(8), "g", ["id"], 1024)
    pieces = placed.groupBy("g", scans.PIECE).count()
    assert pieces.agg(F.max("count")).first()[0] <= 1024 and pieces.where("g = -1").count() >= 10
    assert placed.select(scans.SEQ).distinct().count() == 30_000


def test_fixed_and_sliding_boundaries(spark):
    df = spark.createDataFrame([(1, "a" * 250), (2, ""), (3, "   "), (4, "b" * 100)], "doc_id long, text string")
    spans = lambda d: sorted((r.doc_id, r.start_index, r.end_index) for r in d.collect())
    assert spans(chunking.fixed_chunks(df, 100, 50)) == [(1, 0, 100), (1, 50, 150), (1, 100, 200), (1, 150, 250), (4, 0, 100)]
    assert spans(chunking.sliding_chunks(df, 100, 60)) == [(1, 0, 100), (1, 60, 160), (1, 120, 220), (1, 180, 250), (4, 0, 100)]


MARKDOWN = """# Title
Intro paragraph here.

<table><tr><th>a</th></tr><tr><td>1</td></tr></table>

- one
- two

## Sub
$$e=mc^2$$

<img>bar chart of sales</img>

Another paragraph."""


def test_markdown_regions(spark):
    df = spark.createDataFrame([(MARKDOWN,)], "t string").select(F.explode(regions.markdown_regions(F.col("t"))).alias("r")).select("r.*")
    got = [(r.region_type, r.content, r.level) for r in df.collect()]
    assert [g[0] for g in got] == ["table", "image", "equation", "title", "title", "list", "text", "text"]
    assert got[3:5] == [("title", "Title", 1), ("title", "Sub", 2)] and got[5][1] == "- one\n- two"
    assert [g[1] for g in got[6:]] == ["Intro paragraph here.", "Another paragraph."]


def test_list_gap(spark):
    text = "- a\n" + "z" * 120 + "\n- b\n- c"
    got = spark.createDataFrame([(text,)], "t string").select(regions.list_groups(F.col("t")).alias("g")).first().g
    assert got == ["- a", "- b\n- c"]


def test_boxes_and_assembly(spark):
    text = "# A\n<bbox>0.1,0.1,0.5,0.5</bbox>\n\nBody text<bbox>0.9,0.1,0.5,0.5</bbox><bbox>0.2, 0.2,0.3,0.4</bbox>"
    df = spark.createDataFrame([(7, 2, text)], "doc long, page int, t string")
    got = df.select(F.explode(regions.assembled(F.col("doc"), F.col("page"), F.col("t"))).alias("r")).select("r.*").collect()
    assert [(r.region_id, r.region_type, r.content) for r in got] == [("7_2_0", "title", "A"), ("7_2_1", "text", "Body text")]
    assert [r.bbox.x_max for r in got] == [0.5, 0.3]


def test_fan_out(spark):
    rows = [("image", "a logo", "/x.png", None, None, None), ("table", "t", None, "<table/>", None, None), ("equation", "x", None, None, None, None), ("list", "l", None, None, None, None)]
    df = spark.createDataFrame(rows, "region_type string, content string, image_path string, table_html string, equation_type string, image_type string")
    got = [(r.modality, r.document) for r in regions.fan_out(df).collect()]
    assert got == [("image_description", "[Image: logo] a logo"), ("image", "/x.png"), ("table", "<table/>"), ("equation", "[Equation: display] x"), ("text", "l")]


def test_dense_numbers_and_lookback(spark):
    rng = random.Random(6)
    rows = [(rng.choice(["hot", "hot", "hot", "a", None]), rng.randint(0, 60), i, rng.random()) for i in range(600)]
    df = spark.createDataFrame(rows, "g string, o long, t long, v double")
    got = {r.t: r.n for r in numbering.dense_numbers(df, "g", "o", "t", pieces=7).collect()}
    for g in ("hot", "a", None):
        order = sorted((o, t) for h, o, t, _ in rows if h == g)
        assert [got[t] for _, t in order] == list(range(len(order)))
    found = {r.t: (r.recent_mean, r.trend) for r in metrics.trend(df, "g", "v", "t", chunk=7).collect()}
    assert len(found) == 600
    for g in ("hot", "a", None):
        vs = [(t, v) for h, _, t, v in rows if h == g]
        for i, (t, _) in enumerate(vs):
            last = [v for _, v in vs[max(0, i - 2) : i + 1]]
            before = [v for _, v in vs[max(0, i - 5) : i - 2]] if i >= 3 else []
            ratio = sum(last) / len(last) / (sum(before) / 3) if i >= 5 else 1
            assert abs(found[t][0] - sum(last) / len(last)) < 1e-12 and found[t][1] == ("up" if ratio > 1.1 else "down" if ratio < 0.9 else "same")
