"""Markdown and HTML regions: parsing, tables, boxes, assembly, fan-out."""

from __future__ import annotations

import html.parser
import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, IntegerType, StringType, StructType

from siltstone.functions.text import image_type

#: Region patterns (fixed values).
TABLE = r"(?is)<table>(.*?)</table>"
IMAGE = r"(?is)<img>(.*?)</img>"
EQUATION = r"(?s)\$\$(.*?)\$\$"
HEADING = r"(?md)^(#{1,6})\s+(.+)$"
ITEM = r"(?md)^(\s*)([-*]|\d+\.)\s+(.+)$"
LIST_GAP = 100

_TABLE_INFO = (
    StructType().add("rows", IntegerType()).add("cols", IntegerType()).add("has_header", BooleanType())
    .add("cells", ArrayType(ArrayType(StringType()))).add("markdown", StringType())
)


def _all(text: Column, pattern: str, group: int) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def special_removed(text: Column) -> Column:
    """Text without tables, images, equations, headings and list items."""
    for pattern in (TABLE, IMAGE, EQUATION, HEADING, ITEM):
        text = F.regexp_replace(text, pattern, "")
    return text


def paragraphs(text: Column) -> Column:
    """Blank-line separated paragraphs of 3 characters or more that are no heading and no list."""
    parts = F.transform(F.split(special_removed(text), r"\n\n"), lambda p: F.regexp_replace(p, r"^\s+|\s+$", ""))
    return F.filter(parts, lambda p: (F.length(p) >= 3) & ~p.startswith("#") & ~p.rlike(r"^(?:[-*]|\d+\.)\s"))


@F.pandas_udf(ArrayType(StringType()))
def list_groups(text: pd.Series) -> pd.Series:
    """Lists of a text; items that start over 100 characters apart belong to different ones.

    Match positions are needed here, and Spark's expressions do not give them.
    """
    pattern = re.compile(r"^(\s*)([-*]|\d+\.)\s+(.+)$", re.M)

    def one(t: str | None) -> list[str]:
        groups: list[list[str]] = []
        last = None
        for m in pattern.finditer(t or ""):
            if last is None or m.start() - last > LIST_GAP:
                groups.append([])
            groups[-1].append(m[0].strip())
            last = m.start()
        return ["\n".join(g) for g in groups]

    return text.map(one)


def markdown_regions(text: Column) -> Column:
    """Array of (region_type, content, level), by type: tables, images, equations, titles, lists, text."""
    plain = lambda kind, found: F.transform(
        found, lambda x: F.struct(F.lit(kind).alias("region_type"), F.trim(x).alias("content"), F.lit(None).cast("int").alias("level"))
    )
    titles = F.zip_with(
        _all(text, HEADING, 1), _all(text, HEADING, 2),
        lambda marks, title: F.struct(F.lit("title").alias("region_type"), F.trim(title).alias("content"), F.length(marks).alias("level")),
    )
    return F.concat(
        plain("table", _all(text, TABLE, 0)), plain("image", _all(text, IMAGE, 1)), plain("equation", _all(text, EQUATION, 1)),
        titles, plain("list", list_groups(text)), plain("text", paragraphs(text)),
    )


def table_metadata(table: Column) -> Column:
    """Rows, columns of the first row and presence of a header, by tags."""
    first = F.regexp_extract(table, r"(?is)<tr>(.*?)</tr>", 1)
    return F.struct(
        F.regexp_count(table, F.lit("(?i)<tr>")).alias("rows"),
        F.regexp_count(first, F.lit("(?i)<t[dh]>")).alias("cols"),
        F.lower(table).contains("<th>").alias("has_header"),
    )


class _TableReader(html.parser.HTMLParser):
    def __init__(self) -> None:
        super().__init__()
        self.rows: list[list[str]] = []
        self.header, self.cell = False, None

    def handle_starttag(self, tag, attrs) -> None:
        if tag == "tr":
            self.rows.append([])
        elif tag in ("td", "th"):
            self.header |= tag == "th"
            self.cell = []

    def handle_endtag(self, tag) -> None:
        if tag in ("td", "th") and self.cell is not None:
            if not self.rows:
                self.rows.append([])
            self.rows[-1].append("".join(self.cell).strip())
            self.cell = None

    def handle_data(self, data) -> None:
        if self.cell is not None:
            self.cell.append(data)


@F.pandas_udf(_TABLE_INFO)
def table_structure(table: pd.Series) -> pd.DataFrame:
    """Rows, columns, header, cells and pipe markdown of an HTML table."""
    out = []
    for text in table:
        reader = _TableReader()
        reader.feed(text or "")
        rows = [r for r in reader.rows if r]
        cols = max(map(len, rows), default=0)
        padded = [r + [""] * (cols - len(r)) for r in rows]
        lines = ["| " + " | ".join(r) + " |" for r in padded]
        if lines:
            lines.insert(1, "| " + " | ".join(["---"] * cols) + " |")
        out.append((len(rows), cols, reader.header, rows, "\n".join(lines)))
    return pd.DataFrame(out, columns=["rows", "cols", "has_header", "cells", "markdown"])


def boxes(text: Column) -> Column:
    """Valid ``<bbox>a,b,c,d</bbox>`` boxes, in order."""
    found = F.transform(
        _all(text, r"<bbox>([^<]*)</bbox>", 1), lambda x: F.transform(F.split(x, ","), lambda n: F.trim(n).try_cast("double"))
    )
    valid = F.filter(
        found,
        lambda v: (F.size(v) == 4) & F.forall(v, lambda n: n.isNotNull() & n.between(0, 1)) & (v[0] < v[2]) & (v[1] < v[3]),
    )
    return F.transform(valid, lambda v: F.struct(v[0].alias("x_min"), v[1].alias("y_min"), v[2].alias("x_max"), v[3].alias("y_max")))


def assembled(doc: Column, page: Column, text: Column) -> Column:
    """Regions of a page's text, the i-th with the i-th valid box; ids are ``doc_page_i``."""
    regions = markdown_regions(F.regexp_replace(text, r"<bbox>[^<]*</bbox>", ""))
    zipped = F.zip_with(regions, F.slice(boxes(text), F.lit(1), F.size(regions)), lambda r, b: F.struct(r.alias("region"), b.alias("bbox")))
    return F.transform(
        zipped,
        lambda z, i: F.struct(
            F.concat_ws("_", doc.cast("string"), page.cast("string"), i.cast("string")).alias("region_id"),
            i.alias("region_sequence"), page.alias("page_number"),
            z["region"]["region_type"].alias("region_type"), z["region"]["content"].alias("content"), z["bbox"].alias("bbox"),
        ),
    )


def fan_out(regions: DataFrame) -> DataFrame:
    """Rows to embed: text as it is, an image's description and its file if any, a table's HTML, an equation's formula."""
    row = lambda modality, content: F.struct(F.lit(modality).alias("modality"), content.alias("document"))
    kind, content = F.col("region_type"), F.col("content")
    described = F.concat(F.lit("[Image: "), F.coalesce("image_type", image_type(content)), F.lit("] "), content)
    rows = F.array_compact(
        F.array(
            F.when(kind.isin("text", "title", "heading", "list"), row("text", content)),
            F.when(kind == "image", row("image_description", described)),
            F.when((kind == "image") & F.col("image_path").isNotNull(), row("image", F.col("image_path"))),
            F.when(kind == "table", row("table", F.coalesce("table_html", content))),
            F.when(kind == "equation", row("equation", F.concat(F.lit("[Equation: "), F.coalesce("equation_type", F.lit("display")), F.lit("] "), content))),
        )
    )
    return regions.withColumn("row", F.explode(rows)).select("*", "row.*").drop("row")


def page_text(regions: DataFrame, *keys: str) -> DataFrame:
    """Non-empty region contents of each page, in order, joined by blank lines."""
    parts = F.sort_array(F.collect_list(F.when(F.coalesce("content", F.lit("")) != "", F.struct("region_sequence", "content"))))
    return regions.groupBy(*keys).agg(F.array_join(F.transform(parts, lambda p: p["content"]), "\n\n").alias("content"))


TYPES = ("text", "table", "image", "equation", "list", "title")


def type_counts(regions: DataFrame, *keys: str) -> DataFrame:
    """Regions of each of the six types, zeros included, and of those with a box."""
    return regions.groupBy(*keys).agg(*[F.count_if(F.col("region_type") == t).alias(t) for t in TYPES])


def merged(regions: DataFrame, *keys: str) -> DataFrame:
    """Contents joined in order, with types, ids, sorted distinct pages and tags."""
    rows = F.sort_array(F.collect_list(F.struct("region_sequence", "region_id", "region_type", "content")))
    made = regions.groupBy(*keys).agg(
        rows.alias("rows"), F.array_sort(F.collect_set("page_number")).alias("page_numbers"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("semantic_tags")))).alias("semantic_tags"),
    )
    pick = lambda name: F.transform("rows", lambda r: r[name])
    return made.select(
        *keys, F.array_join(pick("content"), "\n\n").alias("content"), pick("region_type").alias("region_types"),
        pick("region_id").alias("region_ids"), "page_numbers", "semantic_tags",
    )


def layout_summary(regions: DataFrame, *keys: str) -> DataFrame:
    """Counts by type and by vertical third of the box centres (cut at 0.33 and 0.67)."""
    y = (F.col("bbox.y_min") + F.col("bbox.y_max")) / 2
    return regions.groupBy(*keys).agg(
        *[F.count_if(F.col("region_type") == t).alias(t) for t in TYPES],
        F.count_if(y < 0.33).alias("top"), F.count_if((y >= 0.33) & (y < 0.67)).alias("middle"), F.count_if(y >= 0.67).alias("bottom"),
        F.count("bbox").alias("grounded"),
    )
