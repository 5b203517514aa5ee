"""Document sources: files to rows, by suffix; offices formats through the standard library.

Every loader gives (path, content, format, metadata, pages, error).  ``pages`` are the boundaries of a
PDF's pages or a presentation's slides in the content.  A file that cannot be read is a row with its
error, never a failed job.
"""

from __future__ import annotations

import io
import json
import re
import zipfile
from collections.abc import Callable, Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Accepted suffixes and size limits (fixed values).
DOCUMENTS = (".pdf", ".docx", ".pptx", ".txt", ".md", ".markdown")
IMAGES = (".png", ".jpg", ".jpeg", ".gif", ".bmp", ".tiff", ".webp")
MAX_DOCUMENT, MAX_IMAGE = 1 << 30, 100 << 20
SCHEMA = "path string, content string, format string, metadata map<string,string>, pages array<struct<page_number:int,start_index:int,end_index:int>>, error string"

#: bytes to (content, format, metadata), with the page boundaries as a fourth value if there are any
Loader = Callable[[bytes], tuple]
_LOADERS: list[tuple[tuple[str, ...], Loader]] = []


def suffix(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"(\.[^./\\]+)$", 1))


def files(spark: SparkSession, path: str, pattern: str | None = None, recursive: bool = True) -> DataFrame:
    """Files below a path with their bytes and size."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower())
    return (reader.option("pathGlobFilter", pattern) if pattern else reader).load(path)


def sniffed(content: Column) -> Column:
    """What the first bytes of a file say it is: its suffixes, or ``text`` without a zero byte, or null (signatures are fixed values)."""
    head = F.hex(F.substring(content, 1, 16))
    marks = (
        ("255044462D", (".pdf",)), ("504B0304", (".docx", ".pptx")), ("89504E470D0A1A0A", (".png",)), ("FFD8FF", (".jpg", ".jpeg")),
        ("47494638", (".gif",)), ("424D", (".bmp",)), ("49492A00", (".tiff",)), ("4D4D002A", (".tiff",)),
    )
    kind = F.when(head.startswith("52494646") & (F.substring(head, 17, 8) == "57454250"), F.array(F.lit(".webp")))
    for mark, suffixes in marks:
        kind = kind.when(head.startswith(mark), F.array(*map(F.lit, suffixes)))
    text = F.array(*map(F.lit, (".txt", ".md", ".markdown")))
    return kind.when(F.substring(F.hex(F.substring(content, 1, 512)), 1, 1024).rlike("^(?:(?!00)..)*$"), text)


def checked(found: DataFrame) -> DataFrame:
    """Files with the reason they are rejected for, if any: format, size, or first bytes that belong to another format."""
    kind = suffix(F.col("path"))
    reason = (
        F.when(~kind.isin(*DOCUMENTS, *IMAGES), F.concat(F.lit("unsupported format: "), kind))
        .when(kind.isin(*IMAGES) & (F.col("length") > MAX_IMAGE), "image too large")
        .when(F.col("length") > MAX_DOCUMENT, "file too large")
    )
    if "content" in found.columns:
        fits = F.coalesce(F.array_contains(sniffed(F.col("content")), kind), F.lit(False))
        reason = reason.when((F.col("length") > 0) & ~fits, F.concat(F.lit("content is not "), kind))
    return found.withColumn("error", reason)


def admitted(found: DataFrame) -> DataFrame:
    """One row per file (path, status, error) of an upload: rejected ones have failed, the others are pending."""
    return checked(found).select("path", F.when(F.col("error").isNull(), "pending").otherwise("failed").alias("status"), "error")


def register(suffixes: tuple[str, ...], load: Loader) -> None:
    """Add a loader; earlier ones win."""
    _LOADERS.append((tuple(s.lower() for s in suffixes), load))


def joined_pages(texts: list[str]) -> tuple[str, list[dict]]:
    """Page texts joined by a blank line, and where each of them lies."""
    pages, at = [], 0
    for n, text in enumerate(texts, 1):
        pages.append({"page_number": n, "start_index": at, "end_index": at + len(text)})
        at += len(text) + 2
    return "\n\n".join(texts), pages


def _properties(z: zipfile.ZipFile) -> dict:
    """Title, author and times of an office file; empty ones are left out."""
    names = {"title": "title", "creator": "author", "created": "created", "modified": "modified"}
    if "docProps/core.xml" not in z.namelist():
        return {}
    root = ElementTree.fromstring(z.read("docProps/core.xml"))
    found = {names[t]: e.text for e in root.iter() if (t := e.tag.rsplit("}", 1)[-1]) in names and e.text}
    return {k: v.strip() for k, v in found.items() if v.strip()}


def _plain(name: str) -> Loader:
    return lambda data: (data.decode("utf-8"), name, {})


def _words(node: ElementTree.Element, tag: str) -> str:
    return "".join(t.text or "" for t in node.iter() if t.tag.endswith(tag))


def _docx(data: bytes) -> tuple:
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        root, more = ElementTree.fromstring(z.read("word/document.xml")), _properties(z)
    paragraphs = [_words(p, "}t") for p in root.iter() if p.tag.endswith("}p")]
    solid = [p for p in paragraphs if p.strip()]
    return "\n\n".join(solid), "docx", {"paragraph_count": str(len(solid)), **more}


def _pptx(data: bytes) -> tuple:
    slides, described = [], []
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        more = _properties(z)
        names = [n for n in z.namelist() if re.fullmatch(r"ppt/slides/slide\d+\.xml", n)]
        for n, name in enumerate(sorted(names, key=lambda x: int(re.findall(r"\d+", x)[-1])), 1):
            root = ElementTree.fromstring(z.read(name))
            parts, shapes = [], 0
            for shape in root.iter():
                shapes += shape.tag.endswith(("}sp", "}pic", "}graphicFrame"))
                if shape.tag.endswith("}sp"):
                    parts.append("\n".join(_words(p, "}t") for p in shape.iter() if p.tag.endswith("}p")))
                elif shape.tag.endswith("}tr"):
                    parts.append(" | ".join(_words(c, "}t") for c in shape if c.tag.endswith("}tc")))
            body = "\n".join(p for p in parts if p.strip())
            slides.append(f"--- Slide {n} ---\n" + body)
            described.append({"slide_number": n, "shape_count": shapes, "text_length": len(body)})
    content, pages = joined_pages(slides)
    total = sum(d["shape_count"] for d in described)
    return content, "pptx", {"slide_count": str(len(slides)), "total_shapes": str(total), "slides": json.dumps(described), **more}, pages


def _pdf(data: bytes) -> tuple:
    try:
        from pypdf import PdfReader
    except ImportError as e:
        raise RuntimeError("reading PDF needs pypdf") from e
    reader = PdfReader(io.BytesIO(data))
    content, pages = joined_pages([p.extract_text() or "" for p in reader.pages])
    about = reader.metadata or {}
    more = {k: str(about.get(f"/{k.capitalize()}") or "") for k in ("title", "author", "creator", "producer", "subject")} if about else {}
    return content, "pdf", {"page_count": str(len(pages)), **more}, pages


register((".txt",), _plain("text"))
register((".md", ".markdown"), _plain("markdown"))
register((".docx",), _docx)
register((".pptx",), _pptx)
register((".pdf",), _pdf)


def loaded(found: DataFrame) -> DataFrame:
    """Contents of files (path, content bytes), each by the first loader of its suffix; files that ``checked`` rejected keep their error."""
    loaders = list(_LOADERS)
    if "error" in found.columns:
        failed = found.where(F.col("error").isNotNull()).select("path", F.create_map(F.lit("source"), F.col("path")).alias("metadata"), "error")
        good = loaded(found.where(F.col("error").isNull()).drop("error"))
        return good.unionByName(failed, allowMissingColumns=True)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for path, data in zip(pdf["path"], pdf["content"], strict=True):
                load = next((f for ends, f in loaders if path.lower().endswith(ends)), None)
                try:
                    if load is None:
                        raise ValueError("no loader for this format")
                    content, kind, metadata, *pages = load(bytes(data))
                    if not content.strip():
                        raise ValueError("no content")
                    rows.append((path, content, kind, {"source": path, **metadata}, pages[0] if pages else None, None))
                except Exception as e:  # noqa: BLE001  the row carries the error
                    rows.append((path, None, None, {"source": path}, None, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(rows, columns=["path", "content", "format", "metadata", "pages", "error"])

    return found.select("path", "content").mapInPandas(run, SCHEMA)


def page_rows(docs: DataFrame, key: str = "path") -> DataFrame:
    """Pages of loaded contents by their boundaries; a content without any is one page."""
    whole = F.array(F.struct(F.lit(1).alias("page_number"), F.lit(0).alias("start_index"), F.length("content").alias("end_index")))
    pages = docs.where("content IS NOT NULL").select(key, "content", F.explode(F.coalesce("pages", whole)).alias("p"))
    body = F.substring(F.col("content"), F.col("p.start_index") + 1, F.col("p.end_index") - F.col("p.start_index"))
    return pages.select(key, "p.page_number", "p.start_index", "p.end_index", body.alias("content"))


def query_set(spark: SparkSession, path: str, category: str | None = None) -> DataFrame:
    """(category, query) of a JSON query set: {categories: {name: {queries}}} or {queries}."""
    query = "array<string>"
    schema = f"queries {query}, categories map<string,struct<description:string,queries:{query}>>"
    raw = spark.read.schema(schema).option("multiLine", True).json(path)
    flat = raw.select(F.lit(None).cast("string").alias("category"), F.explode("queries").alias("query"))
    named = raw.select(F.explode("categories").alias("category", "c")).select("category", F.explode("c.queries").alias("query"))
    both = flat.unionByName(named)
    return both if category is None else both.where(F.col("category") == category)
