import os
import random
import time
from urllib.parse import urlparse

from siltstone.llm import html

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body>
<nav><ul><li><a href="/a">Menu</a></li></ul></nav><!-- <p>no</p> --><div class="ad">Buy</div>
<article><h1>Head &amp; <i>tail</i></h1><p><b>One
 two<br>three<p>Four&nbsp;five &#233;</p><aside>side</aside><form><p>mail</p></form><section class="comments"><article>hi</article></section>
<ul><li>x<li>y</ul><div id="cookie-notice">ok?</div></article><footer>&copy; me</footer></body>"""


def lcs_length(a, b):
    table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
    return table[-1][-1]


def test_common_lines_is_a_longest_common_subsequence():
    rng = random.Random(5)
    for n in range(300):
        a, b = ([rng.randrange(4) for _ in range(rng.randrange(25))] for _ in range(2))
        got = html.common_lines(a, b, 1 << 26 if n % 2 else 40)
        rest = iter(b)
        assert got == sorted(set(got)) and all(a[i] in rest for i in got)
        assert len(got) == lcs_length(a, b)


def text_of(page):
    """The page's candidate lines, which are its text when nothing is shared."""
    return "\n\n".join(t for t, own in html.candidates(page)[0] if own)


def test_structure():
    assert text_of(PAGE) == "Head & tail\n\nOne two three\n\nFour five é\n\nx\n\ny"
    assert html.page_lines("") == [] and html.page_lines("a < b <3 </ p> &lt;") == [("a < b <3 </ p> <", 0)]
    assert html.page_lines("<p title='a>b'>x</p><p title=\"unclosed>y</p>") == [("x", 0), ("y", 0)]
    assert html.page_lines("<nav><a>m</a><article><p>x</article>") == [("m", -1), ("x", 2)]
    assert html.page_lines("<!-- " * 5000 + "<p>x") == [] and html.page_lines("<b>" * 5000 + "x") == [("x", 0)]


def test_landmarks():
    assert text_of("<p>out</p><div role='main'><p>in</p></div>") == "in"
    assert text_of("<main><h1>Site</h1><article><p>a</p></article><aside><article>teaser</article></aside></main>") == "Site\n\na"
    assert text_of("<main class='no-sidebar'><p>m</p></main><p>n") == "m" and text_of("<div class='has-sidebar'><p>x</div>") == "x"
    # all that stands below any landmark stays
    assert text_of("<main><h1>T</h1><p>Long article text.</p><section><article><h3>Teaser</h3></article></section></main>") == "T\n\nLong article text.\n\nTeaser"
    assert text_of("<main><p>m</p></main><article><p>a</p></article><p>out</p>") == "m\n\na"


def test_class_words_keep_the_articles_own_text():
    assert text_of("<p>out</p><article class='post share-enabled'><p>in</p></article>") == "in"
    page = "<article><h2 id='related-work'>Related</h2><h2 id='comments'>Remarks</h2><p class='share-price'>Up <math><mi>x</mi></math></p>"
    assert text_of(page + "<div class='share'>no</div><article class='related'>no</article></article>") == "Related\n\nRemarks\n\nUp x"
    inside = "<section class='related-work'>a</section><div class='share-price'>b</div><div class='menu-recipe'>c</div>"
    barred = "<div class='share-buttons'>no</div><div class='related-posts'>no</div><div id='comments-section'>no</div><div class='cookie-notice'>no</div>"
    assert text_of(f"<article>{inside}{barred}</article>") == "a\n\nb\n\nc"


def test_class_words_never_empty_a_page(spark):
    for name in ("class='post sidebar-left'", "id=page-footer-less", "class=comments-policy", "class='skip-intro'"):
        assert text_of(f"<body><div {name}><p>x</p><p>y</p></div></body>") == "x\n\ny"
    assert text_of("<div class='sidebar'>no</div><p>yes</p>") == "yes" and text_of("<nav>no</nav>") == ""
    df = spark.createDataFrame([(1, "http://h.org/1", "<div class='post sidebar-left'><p>x</div>")], "page_id long, url string, html string")
    assert html.extract_main_text(df).first().text == "x"


def test_what_goes_from_a_line_leaves_it_whole():
    assert text_of("<p>One <button>b</button> two</p>") == "One two" == text_of("<p>One <span class='advert'>x</span> two</p>")
    assert text_of("<p>a <svg><text>t</text></svg>b <select><option>o</select>c</p><p>d") == "a b c\n\nd"
    assert ("b", -1) in html.page_lines("<p>One <button>b</button> two</p>")
    assert text_of("<p>a<nav>no</nav>b</p>") == "a\n\nb"  # a block parts lines


def test_copies_of_a_page_that_shares_nothing_are_dealt(spark):
    rows = [(n, "http://h.org/same" if n % 3 == 0 else f"http://h.org/{n}", "<p>copy</p>" if n % 3 == 0 else f"<p>own {n}</p><p>text {n}") for n in range(3000)]
    rows += [(5000 + n, None, "<p>nowhere</p>") for n in range(300)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(4)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    try:
        found = html.extract_main_text(df).selectExpr("page_id", "text", "spark_partition_id() AS part").collect()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
        spark.conf.set("spark.sql.adaptive.enabled", "true")
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert len(found) == 3300 and {r.text for r in found if r.page_id % 3 == 0 and r.page_id < 3000} == {"copy"}
    copies = [r.part for r in found if r.text == "copy"]
    assert max(map(copies.count, set(copies))) < 2.5 * len(copies) / 16


def brute_texts(rows, reach=4, near=4):
    """Texts by the definition: the distinct pages of a host in path order, the nearest ones, their shared lines, landmarks."""
    parsed, hosts = [], {}
    for _, url, page in rows:
        lines, best = html.candidates(page or "")
        host, path = (urlparse(url).hostname, urlparse(url).path) if (url or "").startswith("http") else ("", "")
        parsed.append((host, tuple(lines), best))
        at = hosts.setdefault(host, {})
        at[parsed[-1][1]] = min(at.get(parsed[-1][1], path), path)
    out = []
    for host, lines, best in parsed:
        texts = [t for t, own in lines if own]
        order = sorted(hosts[host], key=lambda x: hosts[host][x])
        if not best and host:
            i, path = order.index(lines), hosts[host][lines]
            others = [k for k in range(len(order)) if 0 < abs(k - i) <= reach]
            others.sort(key=lambda k: (-len(os.path.commonprefix([path, hosts[host][order[k]]])), abs(k - i), k))
            shared = [set(html.common_lines([t for t, _ in lines], [t for t, _ in order[k]])) for k in others[:near]]
            gone = set.intersection(*shared) if len(shared) > 1 else set()
            texts = [t for k, (t, own) in enumerate(lines) if own and k not in gone] or texts
        out.append("\n\n".join(texts))
    return out


def test_near_pages_by_url_whatever_the_partitions(spark):
    page = lambda n: f"<nav>Menu {n}</nav><div>Top line</div><p>Text {n}</p><p>More {n}</p><div>Bottom</div>"
    rows = [(n, f"http://h.org/en/{n:02d}", page(n)) for n in range(14)] + [(90, "http://other.org/x", page(9))]
    rows += [(92, f"http://h.org/en/03b{n}", page(3)) for n in range(9)] + [(93, "http://h.org/en/05x", page(5).replace("More 5", "Less"))]
    rows += [(95, "http://a.org/1", PAGE), (96, None, None), (97, "::bad", ""), (98, None, page(1))]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 AS text", "2 AS lines", "3 AS host")
    want = [(r[0], r[1], t) for r, t in zip(rows, brute_texts(rows), strict=True)]
    key = lambda r: (r[0], r[1] or "", r[2])
    try:
        for parts, run in ((1, 1024), (4, 3), (12, 1024), (60, 5)):
            spark.conf.set("spark.sql.shuffle.partitions", str(parts))
            got = html.extract_main_text(df, run=run).collect()
            assert sorted([(r.page_id, r.url, r.text) for r in got], key=key) == sorted(want, key=key)
            assert all(r.n_chars == len(r.text) for r in got)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    texts = {r[0]: r[2] for r in want}
    assert texts[0] == "Text 0\n\nMore 0" and texts[92] == "Text 3\n\nMore 3" and texts[5] == "Text 5\n\nMore 5"
    assert texts[90] == texts[98].replace("1", "9") == "Top line\n\nText 9\n\nMore 9\n\nBottom" and texts[96] == texts[97] == ""
    assert html.extract_main_text(df.limit(0)).count() == 0


def test_landmarks_restore_shared_paragraphs(spark):
    page = lambda n: f"<p>Top</p><article><p>Text {n}</p><p>Same words</p></article>"
    df = spark.createDataFrame([(n, f"http://h.org/{n}", page(n)) for n in range(5)], "page_id long, url string, html string")
    for r in html.extract_main_text(df).collect():
        assert r.text == f"Text {r.page_id}\n\nSame words" and r.n_shared == 2 and r.n_restored == 1


def test_parsing_is_linear_and_unbounded_in_depth():
    began = time.perf_counter()
    deep = 60_000
    assert html.page_lines("<div>" * deep + "</p>" * deep + "x") == [("x", 0)]
    assert html.page_lines("<b><i>" * deep + "</b>" * deep + "<main>y") == [("y", 1)]
    # an advert opened below many inline elements still ends with its own tag
    assert html.page_lines("<b>" * 2000 + "<span class='ad'>no</span>yes") == [("no", -1), ("yes", 0)]
    assert len(html.page_lines("<p>word " * deep)) == deep
    assert time.perf_counter() - began < 20
