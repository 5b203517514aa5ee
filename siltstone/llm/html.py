"""Main text of web pages by nearest-URL page differencing.

The distinct pages of a host are ranked by URL path.  Each is paired with the ``near`` pages
whose paths share the longest prefix with its own, out of ``reach`` on either side; all its text lines are
aligned with each of them by longest common subsequence, and a line that all of them share is template.
A single pair of pages cannot tell a copied paragraph from a menu, so a page needs two near pages at least.

Structure corrects this in two ways.  Elements that hold no article (menus, headers,
footers, sidebars, forms, notices, adverts, comments, scripts, styles) give no text even where no
near page has the same line.  Lines under an ``article`` (or else ``main``) landmark are the
article by the page's own word, so a paragraph that pages share there is restored, and
nothing outside it counts.  A page whose candidate lines are all shared is kept whole.

Ranks are counted exactly across range partitions and edges of runs are copied to the next
run, so the text does not depend on the number of partitions.  Equal pages of a host are one page when
pairs are made; a task holds ``2 * reach + 1`` pages' line hashes and one slice of pages at a time.
Parsing is linear in the page's length.

Defined results: a null or empty page has the text ""; a page with a null or malformed URL has
no host and so no near page; repeated rows give equal texts; of pages that share equal prefixes the
closer one in rank, then the earlier one, is nearer; pages of one path rank by a digest of their lines; very long pages are parsed whole; an empty table gives an empty result;
extra columns are not read, whatever their names.
"""

from __future__ import annotations

import html
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructField, StructType, _parse_datatype_string

from siltstone.llm.common import slices, spread_join, stored

#: Element and attribute vocabularies (fixed values).
_RAW = {"script", "style", "textarea", "title", "xmp", "iframe", "noembed", "noframes"}
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
_OUTSIDE = {"head", "nav", "header", "footer", "aside", "form", "noscript", "template", "svg", "button", "select", "menu", "dialog", "canvas", "object", "audio", "video"}
#: Of these, what stands within a line and leaves it whole when it goes.
_WITHIN_LINE = {"button", "select", "svg", "canvas", "object", "audio", "video", "noscript", "template"}
_BLOCK = {
    "address", "article", "blockquote", "body", "center", "dd", "details", "div", "dl", "dt", "fieldset", "figcaption",
    "figure", "h1", "h2", "h3", "h4", "h5", "h6", "hgroup", "hr", "html", "li", "main", "ol", "p", "pre", "section",
    "summary", "table", "tbody", "tfoot", "thead", "tr", "ul", "caption",
} | (_OUTSIDE - _WITHIN_LINE)
_CLOSES_P = _BLOCK - {"html", "body"}
_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "alert", "alertdialog", "dialog", "menu", "menubar", "form", "toolbar"}
_WORDS = {
    "ad", "ads", "adv", "advert", "adverts", "advertisement", "advertising", "adsense", "sponsor", "sponsored", "promo", "banner",
    "nav", "navbar", "navigation", "menu", "breadcrumb", "breadcrumbs", "sidebar", "footer", "masthead", "cookie", "cookies",
    "consent", "gdpr", "notice", "notices", "notification", "alert", "popup", "modal", "overlay", "newsletter", "subscribe",
    "subscription", "signup", "login", "comment", "comments", "disqus", "respond", "replies", "share", "sharing", "social",
    "related", "recommended", "widget", "pagination", "pager", "toolbar", "skip", "copyright",
}
#: Class and id words never bar these; paragraphs and quotes only outside a landmark.
_NAMED = {"body", "html", "main", "h1", "h2", "h3", "h4", "h5", "h6"}
_PROSE = {"p", "blockquote", "pre", "table", "li"}
_REMARKS = {"comment", "comments", "disqus", "respond", "replies"}
#: Inside a landmark a name bars only if all its parts are such words or these ("share-buttons", not "share-price").
_FRAMES = {
    "area", "bar", "block", "body", "box", "button", "buttons", "container", "content", "form", "group", "icon", "icons", "inner", "item", "items", "left", "link", "links",
    "list", "main", "outer", "page", "panel", "post", "posts", "right", "section", "site", "thread", "top", "user", "reader", "wrap", "wrapper",
}
_NAME = re.compile(r"</?([a-zA-Z][^\s/>]*)")
_ATTRIBUTE = re.compile(r"""(?i)\s(class|id|role|hidden|aria-hidden)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_ROLE_MAIN = re.compile(r"""(?i)\srole\s*=\s*["']?main\b""")
_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


def tag_end(page: str, start: int, spent: set[str]) -> int:
    """Index after the tag that begins at ``start``; '>' inside quoted values does not end it."""
    end = page.find(">", start)
    at = start
    while end >= 0:
        quotes = [q for q in ('"', "'") if q not in spent]
        opened = [(i, q) for q in quotes if (i := page.find(q, at, end)) >= 0]
        if not opened:
            return end + 1
        i, q = min(opened)
        close = page.find(q, i + 1)
        if close < 0:
            spent.add(q)
            continue
        at = close + 1
        if at > end:
            end = page.find(">", at)
    return len(page)


def _standing(name: str, tag: str, inside: bool, words: bool = True) -> str:
    """What an element is: "remark" and "outside" give no lines, "" decides nothing; ``inside`` a landmark or not, ``words`` of classes and ids count or not."""
    free = not words or name in _NAMED or inside and name in _PROSE
    standing = "outside" if name in _OUTSIDE else ""
    for key, *values in _ATTRIBUTE.findall(tag):
        key, value = key.lower(), next((v for v in values if v), "")
        if key == "hidden" or key == "aria-hidden" and value == "true" or key == "role" and value.lower() in _ROLES:
            standing = standing or "outside"
        elif key in ("class", "id") and not free:
            tokens = [{w.lower() for w in _PARTS.findall(t)} for t in value.split()]
            if inside:
                tokens = [t for t in tokens if t <= _WORDS | _FRAMES]
            found = set().union(*tokens)
            if found & _REMARKS:
                return "remark"
            if found & _WORDS and not found & {"has", "with", "no"} and (name != "article" or inside):
                standing = standing or "outside"
    return standing


class _Open:
    """The open elements of a page, with the places of what the parser asks for; closing one costs its own size."""

    def __init__(self) -> None:
        self.items: list[tuple[str, str, int]] = []  # name ("" once closed), standing, landmark
        self.places: dict[str, list[int]] = {}
        self.blocks: list[int] = []
        self.barred: list[int] = []
        self.remarks = 0
        self.landmarks = [0, 0, 0]

    def landmark(self) -> int:
        return 2 if self.landmarks[2] else 1 if self.landmarks[1] else 0

    def push(self, name: str, standing: str, mark: int) -> None:
        at = len(self.items)
        self.items.append((name, standing, mark))
        self.places.setdefault(name, []).append(at)
        if name in _BLOCK:
            self.blocks.append(at)
        if standing:
            self.barred.append(at)
            self.remarks += standing == "remark"
        self.landmarks[mark] += mark > 0

    def cut(self, n: int) -> None:
        """Close everything from place ``n`` on."""
        while len(self.items) > n:
            name, standing, mark = self.items.pop()
            at = len(self.items)
            if name:
                self.places[name].pop()
            for places in (self.blocks, self.barred):
                if places and places[-1] == at:
                    places.pop()
            self.remarks -= standing == "remark"
            self.landmarks[mark] -= mark > 0

    def close_inline(self, n: int) -> None:
        """Close the inline element at ``n`` alone; what it holds stays open."""
        name, _, mark = self.items[n]
        self.places[name].pop()
        self.landmarks[mark] -= mark > 0
        self.items[n] = ("", "", 0)
        while self.items and not self.items[-1][0]:
            self.items.pop()


def page_lines(page: str, words: bool = True) -> list[tuple[str, int]]:
    """All text lines in page order with the landmark that holds them: 2 article, 1 main, 0 none, -1 outside the text.

    Without ``words``, names of classes and ids bar nothing.
    """
    found: list[tuple[str, int]] = []
    stack = _Open()
    text: list[str] = []
    aside: list[str] = []
    spent: set[str] = set()
    met = False

    def flush(both: bool = True) -> None:
        nonlocal met
        for part, mark in ((text, stack.landmark()), (aside, -1)) if both else ((aside, -1),):
            if part:
                if line := " ".join(html.unescape("".join(part)).split()):
                    found.append((line, mark))
                    met |= mark == 2
                part.clear()

    def pop(n: int, both: bool = True) -> None:
        flush(both)
        stack.cut(n)

    at, size = 0, len(page)
    while at < size:
        lt = page.find("<", at)
        if lt < 0:
            lt = size
        if lt > at:
            (aside if stack.barred else text).append(page[at:lt])
        if lt == size:
            break
        if page.startswith("<!--", lt):
            end = page.find("-->", lt + 4)
            at = size if end < 0 else end + 3
            continue
        if page.startswith(("<!", "<?"), lt):
            end = page.find(">", lt)
            at = size if end < 0 else end + 1
            continue
        match = _NAME.match(page, lt)
        if not match:
            (aside if stack.barred else text).append("<")
            at = lt + 1
            continue
        name, closing = match[1].lower(), page[lt + 1] == "/"
        at = tag_end(page, lt, spent)
        if closing:
            if name == "br":
                text.append(" ")
            elif places := stack.places.get(name):
                n = places[-1]
                if name in _BLOCK or stack.barred and stack.barred[-1] >= n:
                    # the line goes on behind what is taken out of it
                    pop(n, name in _BLOCK)
                else:
                    stack.close_inline(n)
            continue
        if name in _RAW:
            end = re.compile(f"</{name}(?=[\\s/>]|$)", re.I).search(page, at)
            at = size if end is None else tag_end(page, end.start(), spent)
            continue
        if name in _BLOCK:
            flush()
        elif name in ("br", "td", "th", "option", "img"):
            text.append(" ")
        if name in _VOID or page[at - 2 : at] == "/>" and name not in _BLOCK:
            continue
        standing = _standing(name, page[lt:at], stack.landmark() > 0, words)
        if name in ("article", "main"):
            # an unclosed menu or advert ends where the first article begins; remarks stay remarks
            if stack.barred and not met and not stack.remarks:
                pop(stack.barred[0])
        elif name == "header" and stack.landmark() and not standing == "remark":
            standing = ""  # an article's own heading
        if name in _CLOSES_P and stack.blocks and ((last := stack.items[stack.blocks[-1]][0]) == "p" or name == last == "li"):
            pop(stack.blocks[-1])
        role = _ROLE_MAIN.search(page, lt, at) is not None
        mark = 0 if stack.barred or standing else 2 if name == "article" else 1 if name == "main" or role else 0
        stack.push(name, standing, mark)
    flush()
    return found


def candidates(page: str) -> tuple[list[tuple[str, bool]], int]:
    """All lines in page order and whether each may be article, and the highest landmark.

    With a landmark these are the lines below any, else all that nothing bars.  If names of classes and ids bar everything, they count for nothing.
    """
    lines = page_lines(page)
    if lines and all(mark < 0 for _, mark in lines):
        lines = page_lines(page, words=False)
    best = max((mark for _, mark in lines), default=0)
    return [(t, mark > 0 if best > 0 else mark == 0) for t, mark in lines], max(best, 0)


def _rows(a: list[int], b: list[int]) -> Iterator[int]:
    """Bit vectors of the longest-common-subsequence table, a row per element of ``a``."""
    where: dict[int, int] = {}
    for j, x in enumerate(b):
        where[x] = where.get(x, 0) | 1 << j
    full = (1 << len(b)) - 1
    row = full
    for x in a:
        same = row & where.get(x, 0)
        row = (row + same | row - same) & full
        yield row


def _lengths(a: list[int], b: list[int]) -> np.ndarray:
    """Length of the longest common subsequence of ``a`` with every prefix of ``b``."""
    last = (1 << len(b)) - 1
    for row in _rows(a, b):
        last = row
    bits = np.unpackbits(np.frombuffer(last.to_bytes(len(b) // 8 + 1, "little"), np.uint8), bitorder="little")[: len(b)]
    return np.concatenate([[0], np.cumsum(1 - bits.astype(np.int64))])


def common_lines(a: list[int], b: list[int], cells: int = 1 << 26) -> list[int]:
    """Indexes in ``a`` of one longest common subsequence with ``b``; memory is bounded by ``cells`` bits."""
    head = 0
    while head < min(len(a), len(b)) and a[head] == b[head]:
        head += 1
    tail = 0
    while tail < min(len(a), len(b)) - head and a[-1 - tail] == b[-1 - tail]:
        tail += 1
    edges = [*range(head)], [*range(len(a) - tail, len(a))]
    a, b = a[head : len(a) - tail], b[head : len(b) - tail]
    inner: list[int] = []
    if a and b and len(a) * len(b) > cells and len(a) > 1:
        half = len(a) // 2
        total = _lengths(a[:half], b) + _lengths(a[half:][::-1], b[::-1])[::-1]
        cut = int(total.argmax())
        inner = common_lines(a[:half], b[:cut], cells) + [half + i for i in common_lines(a[half:], b[cut:], cells)]
    elif a and b:
        rows, i, j = list(_rows(a, b)), len(a), len(b)
        while i and j:
            if rows[i - 1] >> j - 1 & 1:
                j -= 1
                continue
            i -= 1
            if not i or rows[i - 1] >> j - 1 & 1:
                j -= 1
                inner.append(i)
        inner.reverse()
    return edges[0] + [head + i for i in inner] + edges[1]


def shared_lines(page: list[int], near: list[list[int]]) -> list[int]:
    """Indexes of the lines that all near pages share, each by longest common subsequence."""
    votes = [0] * len(page)
    for other in near:
        # a line that the other page lacks altogether is in no common subsequence
        both = set(page) & set(other)
        mine = [i for i, x in enumerate(page) if x in both]
        for k in common_lines([page[i] for i in mine], [x for x in other if x in both]):
            votes[mine[k]] += 1
    return [i for i, n in enumerate(votes) if n == len(near) > 0]


def _parsed(df: DataFrame, id_col: str, url_col: str, html_col: str) -> DataFrame:
    """One row per page: its candidate lines, a hash of every line, and the candidate number of each line (-1: none)."""
    url = F.col(url_col)
    rows = df.select(
        F.col(id_col).alias("id"), url.alias("url"), F.col(html_col).alias("html"),
        F.coalesce(F.lower(F.try_parse_url(url, F.lit("HOST"))), F.lit("")).alias("host"),
        F.coalesce(F.try_parse_url(url, F.lit("PATH")), F.lit("")).alias("path"),
    )
    fields = [StructField("id", df.schema[id_col].dataType), *_parse_datatype_string("url string, host string, path string").fields]
    made = "landmark int, texts array<string>, hashes binary, places binary, digest long"
    out = StructType(fields + _parse_datatype_string(made).fields)
    schema = to_arrow_schema(out)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "html"):
                columns: list[list] = [[], [], [], [], []]
                for page in part.column("html").to_pylist():
                    lines, best = candidates(page or "")
                    own = np.array([keep for _, keep in lines], bool)
                    hashes = np.array([xxhash.xxh64_intdigest(t.encode("utf-8", "surrogatepass")) for t, _ in lines], "<u8").tobytes()
                    places = np.where(own, np.cumsum(own) - 1, -1).astype("<i4").tobytes()
                    digest = int(np.uint64(xxhash.xxh64_intdigest(hashes + places)).view(np.int64))
                    texts = [t for (t, _), keep in zip(lines, own, strict=True) if keep]
                    for column, value in zip(columns, (best, texts, hashes, places, digest), strict=True):
                        column.append(value)
                kept = [part.column(n) for n in ("id", "url", "host", "path")]
                kept += [pa.array(c, f.type) for c, f in zip(columns, list(schema)[4:], strict=True)]
                yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(kept, schema, strict=True)], schema=schema)

    return rows.mapInArrow(apply, out)


def _ranked(parsed: DataFrame) -> DataFrame:
    """The distinct pages of each host (host, path, digest, ...) with their rank by path, counted across range partitions."""
    spark = parsed.sparkSession
    distinct = parsed.where("host <> ''").groupBy("host", "digest").agg(
        F.min("path").alias("path"), F.first("hashes").alias("hashes"), F.first("places").alias("places"),
        F.count(F.lit(1)).alias("n"),
    )
    rows = distinct.select("host", "path", "digest", "hashes", "places", "n")
    keys = ["host", "path", "digest"]
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartitionByRange(parts, *keys).sortWithinPartitions(*keys)
    dealt = stored(dealt.withColumn("part", F.spark_partition_id()).withColumn("at", F.monotonically_increasing_id()), "ranked")
    # a row per host and range it reaches into
    runs = dealt.groupBy("host", "part").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("host").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.select("host", "part", (F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("first")).alias("offset"))
    return dealt.join(runs, ["host", "part"]).withColumn("rank", F.col("at") + F.col("offset")).drop("part", "at", "offset")


def _differenced(ranked: DataFrame, reach: int, near: int, run: int) -> DataFrame:
    """The distinct pages that share lines with all their near pages, and which.

    Runs of ``run`` ranks are tasks' units; ``reach`` rows at either edge are copied to the next run.
    """
    unit, place = F.floor(F.col("rank") / run), F.col("rank") % run
    there = F.array_compact(F.array(unit, F.when(place < reach, unit - 1), F.when(place >= run - reach, unit + 1)))
    rows = ranked.withColumn("own", unit).withColumn("unit", F.explode(there)).where("unit >= 0")
    rows = rows.repartition("host", "unit").sortWithinPartitions("host", "unit", "rank")
    out = _parse_datatype_string("host string, digest long, n long, gone array<int>, n_shared int")
    schema = to_arrow_schema(out)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made: list[tuple] = []
        held: list[dict] = []  # rows of one run: up to ``reach`` done ones, then those that wait for what follows

        def decide(i: int) -> None:
            page = held[i]
            if page["own"] != page["unit"]:
                return
            others = [(len(os.path.commonprefix([o["path"], page["path"]])), -abs(k - i), -k) for k, o in enumerate(held) if 0 < abs(k - i) <= reach]
            nearest = [held[-k] for *_, k in sorted(others, reverse=True)[:near]]
            lines = [np.frombuffer(x["hashes"], "<u8").tolist() for x in (page, *nearest)]
            # a single pair of pages cannot tell a copied paragraph from a menu
            shared = shared_lines(lines[0], lines[1:]) if len(nearest) > 1 else []
            if shared:
                places = np.frombuffer(page["places"], "<i4")[shared]
                made.append((page["host"], page["digest"], page["n"], places[places >= 0].tolist(), len(shared)))

        def batch_of() -> pa.RecordBatch:
            columns = [pa.array([r[i] for r in made], f.type) for i, f in enumerate(schema)]
            made.clear()
            return pa.RecordBatch.from_arrays(columns, schema=schema)

        done = 0  # how many of ``held`` are decided
        for batch in batches:
            for row in batch.to_pylist():
                if held and (held[0]["host"], held[0]["unit"]) != (row["host"], row["unit"]):
                    for i in range(done, len(held)):
                        decide(i)
                    held, done = [], 0
                held.append(row)
                if len(held) - done > reach:
                    decide(done)
                    done += 1
                if done > reach:
                    del held[0]
                    done -= 1
            if len(made) > 1024:
                yield batch_of()
        for i in range(done, len(held)):
            decide(i)
        yield batch_of()

    return rows.select("host", "unit", "own", "path", "digest", "hashes", "places", "n").mapInArrow(apply, out)


def extract_main_text(
    df: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", reach: int = 4, near: int = 4, run: int = 128
) -> DataFrame:
    """One row per page: id, url, text, n_chars, n_lines (candidates), n_shared (lines that near pages share),
    n_restored (shared candidate lines that stay, as a landmark's or as all that the page has).
    """
    parsed = stored(_parsed(df, id_col, url_col, html_col), "pages")
    ranked = stored(_ranked(parsed), "pages_ranked")
    decided = stored(_differenced(ranked, reach, near, run), "decided")
    # copies of one page may be a third of all rows, whether it shares lines or not; texts move only if the pages that share lines are many
    total = ranked.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    hot = ranked.where(F.col("n") * 1024 > total).join(decided.select("host", "digest"), ["host", "digest"], "left_anti").select("host", "digest", "n")
    known = stored(decided.unionByName(hot, allowMissingColumns=True), "decided_or_hot")
    pages = parsed.drop("hashes", "places", "path")
    both = spread_join(pages.where("host <> ''"), known, ["host", "digest"], how="left")
    both = both.unionByName(pages.where("host = ''"), allowMissingColumns=True)
    n = F.size("texts")
    left = F.when(n > 0, F.array_except(F.sequence(F.lit(0), n - 1), F.coalesce("gone", F.array().cast("array<int>")))).otherwise(F.array().cast("array<int>"))
    both = both.withColumn("left", left)
    whole = (F.col("landmark") > 0) | (F.size("left") == 0)
    texts = F.when(whole, F.col("texts")).otherwise(F.transform("left", lambda i: F.get("texts", i)))
    both = both.select(
        F.col("id").alias(id_col), "url", F.array_join(texts, "\n\n").alias("text"), n.alias("n_lines"),
        F.coalesce("n_shared", F.lit(0)).alias("n_shared"),
        F.when(whole, F.coalesce(F.size("gone"), F.lit(0))).otherwise(0).alias("n_restored"),
    )
    return both.withColumn("n_chars", F.length("text").cast("long"))
