"""Slides to regions: the shape tree of a presentation, with positions.

A slide's shapes are walked in tree order.  Groups scale and move what they hold; positions are shares of the slide.  Reading order
goes by lines of shapes: those whose vertical middles overlap stand on one line, from left to right.
"""

from __future__ import annotations

import io
import re
import tempfile
import zipfile
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass
from functools import lru_cache
from posixpath import join, normpath
from xml.etree import ElementTree

import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string

from siltstone.operators import regions
from siltstone.sources import documents

_BOX = "struct<x_min:double,y_min:double,x_max:double,y_max:double>"
SCHEMA = (
    "path string, page_number int, region_id string, region_type string, region_sequence int, reading_order int, content string, "
    f"cells array<array<string>>, image_path string, bbox {_BOX}, error string"
)
#: A slide's size if the presentation does not say it (fixed value).
_DEFAULT_SIZE = (9144000, 6858000)
#: Bytes of a deck's rows that wait in memory (fixed value).
_WAITING = 8 << 20


@dataclass
class Shape:
    kind: str
    content: str
    box: tuple[float, float, float, float] | None
    cells: list[list[str]] | None = None
    image: str | None = None
    descent: int = 0


@lru_cache(1024)
def _local(name: str) -> str:
    return name.rsplit("}", 1)[-1]


def _tag(node: ElementTree.Element) -> str:
    return _local(node.tag)


def _child(node: ElementTree.Element | None, *path: str) -> ElementTree.Element | None:
    for name in path:
        if node is None:
            return None
        for c in node:
            if _local(c.tag) == name:
                node = c
                break
        else:
            return None
    return node


def _attribute(node: ElementTree.Element, name: str) -> str | None:
    return next((v for k, v in node.attrib.items() if k.rsplit("}", 1)[-1] == name), None)


def _paragraphs(node: ElementTree.Element) -> str:
    lines = []
    for p in node.iter():
        if _local(p.tag) == "p":
            tags = [(_local(n.tag), n.text) for n in p.iter()]
            lines.append("".join(["\n" if tag == "br" else text or "" for tag, text in tags if tag in ("t", "br")]))
    return "\n".join(lines)


def slide_names(archive: zipfile.ZipFile) -> list[str]:
    names = [n for n in archive.namelist() if re.fullmatch(r"ppt/slides/slide\d+\.xml", n)]
    return sorted(names, key=lambda n: int(re.findall(r"\d+", n)[-1]))


def slide_size(archive: zipfile.ZipFile) -> tuple[int, int]:
    if _has(archive, "ppt/presentation.xml"):
        for node in ElementTree.fromstring(archive.read("ppt/presentation.xml")).iter():
            if _tag(node) == "sldSz":
                return int(node.attrib["cx"]), int(node.attrib["cy"])
    return _DEFAULT_SIZE


def _has(archive: zipfile.ZipFile, name: str) -> bool:
    """Whether a file is in the archive; its names are not listed, as a deck asks once a slide."""
    try:
        archive.getinfo(name)
    except KeyError:
        return False
    return True


def _links(archive: zipfile.ZipFile, name: str) -> dict[str, str]:
    """Files that a slide refers to, by their id."""
    folder, file = name.rsplit("/", 1)
    rels = f"{folder}/_rels/{file}.rels"
    if not _has(archive, rels):
        return {}
    return {r.attrib["Id"]: normpath(join(folder, r.attrib["Target"])) for r in ElementTree.fromstring(archive.read(rels)) if "Target" in r.attrib}


#: x' = a x + b, y' = c y + d
_Transform = tuple[float, float, float, float]


def _frame(properties: ElementTree.Element | None) -> tuple[float, float, float, float] | None:
    at = _child(properties, "xfrm") if properties is not None and _tag(properties) != "xfrm" else properties
    off, ext = _child(at, "off"), _child(at, "ext")
    if off is None or ext is None:
        return None
    return float(off.attrib["x"]), float(off.attrib["y"]), float(ext.attrib["cx"]), float(ext.attrib["cy"])


def _inside(group: ElementTree.Element, outer: _Transform) -> _Transform:
    """Where a group puts the coordinates of what it holds."""
    at = _child(group, "grpSpPr", "xfrm")
    own, off, ext = _frame(at), _child(at, "chOff"), _child(at, "chExt")
    if own is None or off is None or ext is None:
        return outer
    x, y, w, h = own
    ox, oy, ow, oh = float(off.attrib["x"]), float(off.attrib["y"]), float(ext.attrib["cx"]), float(ext.attrib["cy"])
    sx, sy = (w / ow if ow else 1.0), (h / oh if oh else 1.0)
    a, b, c, d = outer
    return a * sx, a * (x - sx * ox) + b, c * sy, c * (y - sy * oy) + d


def shapes_of(archive: zipfile.ZipFile, name: str, size: tuple[int, int] | None = None) -> list[Shape]:
    """Titles, texts, tables and pictures of a slide, in tree order; empty ones are left out.  ``size`` is the slides', if known."""
    width, height = size or slide_size(archive)
    links = _links(archive, name)
    found: list[Shape] = []

    def box(frame, t: _Transform):
        if frame is None:
            return None
        x, y, w, h = frame
        cut = lambda v: min(1.0, max(0.0, v))
        return (cut((t[0] * x + t[1]) / width), cut((t[2] * y + t[3]) / height), cut((t[0] * (x + w) + t[1]) / width), cut((t[2] * (y + h) + t[3]) / height))

    def walk(node: ElementTree.Element, t: _Transform, depth: int) -> None:
        for shape in node:
            kind = _tag(shape)
            if kind == "grpSp":
                walk(shape, _inside(shape, t), depth + 1)
            elif kind == "sp":
                text = _paragraphs(shape).strip()
                about, holder = _child(shape, "nvSpPr", "cNvPr"), _child(shape, "nvSpPr", "nvPr", "ph")
                title = holder is not None and holder.attrib.get("type") in ("title", "ctrTitle") or about is not None and "title" in about.attrib.get("name", "").lower()
                if text:
                    found.append(Shape("title" if title else "text", text, box(_frame(_child(shape, "spPr")), t), descent=depth))
            elif kind == "graphicFrame":
                rows = [[_paragraphs(c).strip() for c in row if _tag(c) == "tc"] for row in shape.iter() if _tag(row) == "tr"]
                if any(c for r in rows for c in r):
                    lines = "\n".join(" | ".join(r) for r in rows)
                    found.append(Shape("table", lines, box(_frame(_child(shape, "xfrm")), t), cells=rows, descent=depth))
            elif kind == "pic":
                blip = next((n for n in shape.iter() if _tag(n) == "blip"), None)
                about = _child(shape, "nvPicPr", "cNvPr")
                target = links.get(_attribute(blip, "embed") or "") if blip is not None else None
                found.append(Shape("image", (about.attrib.get("descr") or "" if about is not None else "").strip(), box(_frame(_child(shape, "spPr")), t), image=target, descent=depth))

    root = ElementTree.fromstring(archive.read(name))
    tree = next((n for n in root.iter() if _tag(n) == "spTree"), root)
    walk(tree, (1.0, 0.0, 1.0, 0.0), 0)
    return found


def text_of(shapes: list[Shape]) -> str:
    return "\n".join(s.content for s in shapes if s.content)


def reading_order(boxes: list[tuple[float, float, float, float] | None]) -> list[int]:
    """Rank of each box: line by line, left to right; what has no place follows what stands before it in the tree."""
    placed = sorted((i for i, b in enumerate(boxes) if b), key=lambda i: (boxes[i][1] + boxes[i][3], i))
    lines: list[list[int]] = []
    for i in placed:
        middle = (boxes[i][1] + boxes[i][3]) / 2
        head = boxes[lines[-1][0]] if lines else None
        if head and head[1] <= middle <= head[3]:
            lines[-1].append(i)
        else:
            lines.append([i])
    order = [i for line in lines for i in sorted(line, key=lambda i: (boxes[i][0], i))]
    for i, b in enumerate(boxes):
        if not b:
            order.insert(order.index(i - 1) + 1 if i else 0, i)
    rank = [0] * len(order)
    for r, i in enumerate(order):
        rank[i] = r
    return rank


@contextmanager
def _opened(source: str | bytes | None) -> Iterator[zipfile.ZipFile]:
    """A presentation's archive, from its bytes or from the file at a path, of which a slide is read at a time."""
    if isinstance(source, str):
        system, place = documents._located(source)
        # of a file that is too short for an archive, zipfile expects what Python's files raise
        file = open(place, "rb") if isinstance(system, fs.LocalFileSystem) else system.open_input_file(place)
    else:
        file = io.BytesIO(source)
    with file, zipfile.ZipFile(file) as archive:
        yield archive


def _slides(archive: zipfile.ZipFile) -> Iterator[tuple[int, list[Shape]]]:
    size = slide_size(archive)
    for page, slide in enumerate(slide_names(archive), 1):
        yield page, shapes_of(archive, slide, size)


def _packed(rows: Iterator[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Rows in batches of 8,192, or as many as hold four million characters."""
    held, size = [], 0

    def made() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)

    for row in rows:
        held.append(row)
        size += sum(len(v) for v in row if isinstance(v, str))
        if len(held) >= 8192 or size > 4 << 20:
            yield made()
            held, size = [], 0
    if held:
        yield made()


def _each(found: DataFrame, document: str, schema: str, rows_of: Callable[[str, zipfile.ZipFile], Iterator[tuple]]) -> DataFrame:
    """Rows of each presentation, with its path first and an error last; a deck without rows, or that cannot be read, is its error.

    Presentations are their bytes (``content``) or, if there is such a column, the file that holds them (``file``).
    """
    arrow = to_arrow_schema(_parse_datatype_string(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, source in zip(*batch.columns, strict=True):
                # a deck is its rows or its error, so its rows wait, large ones in a file of the task's, until all are there
                with tempfile.SpooledTemporaryFile(_WAITING) as waiting:
                    try:
                        with _opened(source.as_py()) as archive, pa.ipc.new_stream(waiting, arrow) as out:
                            some = False
                            for part in _packed(rows_of(path.as_py(), archive), arrow):
                                some = True
                                out.write_batch(part)
                        if not some:
                            raise ValueError("no content")
                    except Exception as e:  # noqa: BLE001  the row carries the error
                        yield from _packed(iter([(path.as_py(), *[None] * (len(arrow) - 2), f"{type(e).__name__}: {e}")]), arrow)
                        continue
                    waiting.seek(0)
                    yield from pa.ipc.open_stream(waiting)

    source = "file" if "file" in found.columns else "content"
    return found.select(F.col(document).alias("path"), source).mapInArrow(run, schema)


def slide_regions(found: DataFrame, document: str = "path") -> DataFrame:
    """Regions of presentations (path, content bytes or file): titles, texts, tables with cells, pictures with their file in the archive.

    A deck without any is one row with an error, as is one that cannot be read.
    """

    def rows_of(path: str, archive: zipfile.ZipFile) -> Iterator[tuple]:
        name = re.sub(r"\.[^.]*$", "", path.rsplit("/", 1)[-1])
        for page, shapes in _slides(archive):
            ranks = reading_order([s.box for s in shapes])
            for n, (s, rank) in enumerate(zip(shapes, ranks, strict=True)):
                box = dict(zip(("x_min", "y_min", "x_max", "y_max"), s.box, strict=True)) if s.box else None
                yield path, page, f"{name}_slide{page}_shape{n}", s.kind, n, rank, s.content, s.cells, s.image, box, None

    return _each(found, document, SCHEMA, rows_of)


def deck_texts(found: DataFrame) -> DataFrame:
    """One row per presentation (path, content bytes or file): its regions as text by slide, and how many of each type it has.

    A deck's text is put together where its slides are read, in blocks of a million characters, so that no region is a row.
    """

    def rows_of(path: str, archive: zipfile.ZipFile) -> Iterator[tuple]:
        texts, size, counts, last, block = [], 0, dict.fromkeys(regions.TYPES, 0), None, 0

        def made() -> tuple:
            return path, block, "\n\n".join(texts) if texts else None, last, *counts.values(), None

        for page, shapes in _slides(archive):
            for s in shapes:
                last = page
                counts[s.kind] += 1
                if s.kind != "image" and s.content:
                    texts.append(f"--- Slide {page} ({s.kind}) ---\n{s.content}")
                    size += len(texts[-1])
            if size > 1 << 20:
                yield made()
                texts, size, counts, block = [], 0, dict.fromkeys(regions.TYPES, 0), block + 1
        if any(counts.values()):
            yield made()

    schema = f"path string, block int, content string, slide_count int, {', '.join(f'`{t}` bigint' for t in regions.TYPES)}, error string"
    each = _each(found, "path", schema, rows_of)
    shown = F.when(F.col("content").isNotNull(), F.struct("block", "content"))
    parts = F.sort_array(F.collect_list(shown))
    counts = [F.coalesce(F.sum(t), F.lit(0)).alias(t) for t in regions.TYPES]
    made = each.groupBy("path").agg(parts.alias("parts"), F.max("slide_count").alias("slide_count"), F.max("error").alias("error"), *counts)
    return made.select("path", F.array_join(F.transform("parts", lambda p: p["content"]), "\n\n").alias("content"), "slide_count", "error", *regions.TYPES)


#: Bytes of images to their markdown, one for one.
Analyzer = Callable[[list[bytes]], list[str]]


def analyzed(found: DataFrame, load: Callable[[], Analyzer], batch: int = 16) -> DataFrame:
    """Regions of images and presentations (path, content bytes) with an analyzer in the place of the reading model.

    Presentations keep their own texts and tables, and their pictures go to the analyzer; images go to it whole; what
    is neither, cannot be read or yields nothing is a row with an error.
    """
    kind = F.lower(F.regexp_extract("path", r"(\.[^./\\]+)$", 1))
    decks = slide_regions(found.where(kind == ".pptx"))
    pictures = kind.isin(".png", ".jpg", ".jpeg", ".gif", ".bmp", ".tiff", ".webp")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        analyze = load()
        for pdf in batches:
            for at in range(0, len(pdf), batch):
                part = pdf.iloc[at : at + batch]
                try:
                    texts, errors = analyze([bytes(x) for x in part["image"]]), [None] * len(part)
                except Exception:  # noqa: BLE001  one by one, so that only the bad ones fail
                    texts, errors = [], []
                    for x in part["image"]:
                        try:
                            texts.append(analyze([bytes(x)])[0])
                            errors.append(None)
                        except Exception as e:  # noqa: BLE001
                            texts.append(None)
                            errors.append(f"{type(e).__name__}: {e}")
                errors = [e or (None if (t or "").strip() else "ValueError: no content") for t, e in zip(texts, errors, strict=True)]
                yield part[["path", "page_number"]].assign(markdown=texts, error=errors)

    def embedded(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for path, data in zip(pdf["path"], pdf["content"], strict=True):
                try:
                    with zipfile.ZipFile(io.BytesIO(bytes(data))) as archive:
                        for page, slide in enumerate(slide_names(archive), 1):
                            rows += [(path, page, archive.read(s.image)) for s in shapes_of(archive, slide) if s.image and _has(archive, s.image)]
                except Exception:  # noqa: BLE001, S112  slide_regions has the row of the error
                    continue
            yield pd.DataFrame(rows, columns=["path", "page_number", "image"])

    shown = "path string, page_number int, image binary"
    inner = found.where(kind == ".pptx").select("path", "content").mapInPandas(embedded, shown)
    whole = found.where(pictures).select("path", F.lit(1).alias("page_number"), F.col("content").alias("image"))
    read = whole.unionByName(inner).mapInPandas(run, "path string, page_number int, markdown string, error string")
    name = F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"\.[^.]*$", "")
    assembled = F.when(F.col("error").isNull(), regions.assembled(name, F.col("page_number"), F.col("markdown")))
    each = read.select("path", "page_number", "error", F.explode_outer(assembled).alias("r"))
    columns = ["path", "page_number", "region_id", "region_type", "region_sequence", "content", "bbox", "error"]
    box = F.col("r.bbox")
    of_images = each.select(
        "path", "page_number", "r.region_id", "r.region_type", "r.region_sequence", "r.content",
        F.when(box.isNotNull(), F.struct(*[box[c].cast("double").alias(c) for c in ("x_min", "y_min", "x_max", "y_max")])).alias("bbox"), "error",
    )
    other = found.where(~pictures & (kind != ".pptx")).select("path", F.lit("ValueError: no analysis for this format").alias("error"))
    return decks.select(*columns).unionByName(of_images).unionByName(other, allowMissingColumns=True)
