"""Pages of documents as a Spark data source: ``spark.read.format("documents").load(path)``.

A task reads a range of pages of a file whose format can seek (presentations by slide, PDF by page), or several small files;
planning looks at names and sizes only.  Formats are tried in order, those a user registers come last.  Filters on ``path``,
``format`` and ``page_number`` reach the files and page ranges when ``spark.sql.python.filterPushdown.enabled`` is set.

A file that cannot be read, or whose pages are all blank, is one row with its error; so is a single page that fails.
"""

from __future__ import annotations

import codecs
import io
import re
import zipfile
from array import array
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from typing import BinaryIO

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

SCHEMA = "path string, format string, page_number int, n_pages int, content string, error string"
_ARROW = pa.schema([("path", pa.string()), ("format", pa.string()), ("page_number", pa.int32()), ("n_pages", pa.int32()), ("content", pa.string()), ("error", pa.string())])


@dataclass(frozen=True)
class Format:
    """How files of some suffixes are read: ``open`` gives their pages, by place; ``seeks`` if a page can be read without those before it."""

    name: str
    suffixes: tuple[str, ...]
    open: Callable[[BinaryIO], Sequence[str]]
    seeks: bool = False


class _Lazy(Sequence):
    """Pages that are read when they are asked for."""

    def __init__(self, n: int, read: Callable[[int], str]) -> None:
        self._n, self._read = n, read

    def __len__(self) -> int:
        return self._n

    def __getitem__(self, i: int) -> str:
        return self._read(i)


def _text(file: BinaryIO) -> Sequence[str]:
    """Form feeds part pages; one at the end closes the last page.  The file is checked and its pages found in blocks, then each is read when asked for."""
    if not file.seekable():
        file = io.BytesIO(file.read())
    ends, at, check = array("q"), 0, codecs.getincrementaldecoder("utf-8")()
    while block := file.read(1 << 20):
        check.decode(block)
        found = np.flatnonzero(np.frombuffer(block, np.uint8) == 12) + at
        ends.frombytes(found.astype(np.int64).tobytes())
        at += len(block)
    check.decode(b"", True)
    if not ends or ends[-1] != at - 1:
        ends.append(at)

    def page(i: int) -> str:
        start = ends[i - 1] + 1 if i else 0
        file.seek(start)
        return file.read(ends[i] - start).decode("utf-8")

    return _Lazy(len(ends), page)


def _docx(file: BinaryIO) -> list[str]:
    from siltstone.sources import loaders

    return [loaders._docx(file.read())[0]]


def _pptx(file: BinaryIO) -> Sequence[str]:
    from siltstone.sources import slides

    archive = zipfile.ZipFile(io.BytesIO(file.read()) if not file.seekable() else file)
    names = slides.slide_names(archive)
    size = slides.slide_size(archive) if names else None
    return _Lazy(len(names), lambda i: slides.text_of(slides.shapes_of(archive, names[i], size)))


def _pdf(file: BinaryIO) -> Sequence[str]:
    try:
        from pypdf import PdfReader
    except ImportError as e:
        raise RuntimeError("reading PDF needs pypdf") from e
    reader = PdfReader(file)
    return _Lazy(len(reader.pages), lambda i: reader.pages[i].extract_text() or "")


FORMATS = (
    Format("text", (".txt",), _text), Format("markdown", (".md", ".markdown"), _text), Format("docx", (".docx",), _docx),
    Format("pptx", (".pptx",), _pptx, True), Format("pdf", (".pdf",), _pdf, True),
)


@dataclass
class Share(InputPartition):
    """Files of one task, each with the share (``part`` of ``parts``) of its pages."""

    files: list[tuple[str, int, int]]


def _located(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if re.match(r"[A-Za-z][A-Za-z0-9+.-]*:", path) else (fs.LocalFileSystem(), path)


class DocumentReader(DataSourceReader):
    def __init__(self, options: dict, formats: tuple[Format, ...]) -> None:
        self.path, self.formats = options["path"], formats
        self.per_task = int(options.get("bytespertask", 32 << 20))  # names come in lower case
        self.suffixes = tuple(s for s in options.get("suffixes", "").lower().split(",") if s)
        self.paths: set[str] | None = None
        self.names: set[str] | None = None
        self.first, self.last = 1, 1 << 31

    def _format(self, path: str) -> Format | None:
        return next((f for f in self.formats if path.lower().endswith(f.suffixes)), None)

    def partitions(self) -> list[Share]:
        system, root = _located(self.path)
        scheme = self.path[: len(self.path) - len(root)] if self.path.endswith(root) else ""
        info = system.get_file_info(root)
        found = [info] if info.type == fs.FileType.File else system.get_file_info(fs.FileSelector(root, recursive=True))
        shares, held, size = [], [], 0
        for f in sorted((f for f in found if f.type == fs.FileType.File), key=lambda f: f.path):
            path = scheme + f.path
            kind = self._format(path)
            hidden = any(p[:1] in "._" for p in f.path[len(root) :].split("/") if p)
            if hidden or self.suffixes and not path.lower().endswith(self.suffixes) or self.paths is not None and path not in self.paths:
                continue
            if self.names is not None and (kind.name if kind else None) not in self.names:
                continue
            if kind and kind.seeks and f.size > self.per_task:
                parts = -(-f.size // self.per_task)
                shares += [Share([(path, k, parts)]) for k in range(parts)]
                continue
            if held and size + f.size > self.per_task:
                shares.append(Share(held))
                held, size = [], 0
            held.append((path, 0, 1))
            size += f.size
        return [*shares, Share(held)]

    def read(self, partition: Share) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        size = 0
        for path, part, parts in partition.files:
            for row in self._rows(path, part, parts):
                rows.append(row)
                size += len(row[4] or "")
                if len(rows) >= 256 or size > 4 << 20:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _ARROW, strict=True)], schema=_ARROW)
                    rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _ARROW, strict=True)], schema=_ARROW)

    def _rows(self, path: str, part: int, parts: int) -> Iterator[tuple]:
        kind = self._format(path)
        name = kind.name if kind else None
        try:
            if kind is None:
                raise ValueError("no format for this suffix")
            system, place = _located(path)
            with system.open_input_file(place) as file:
                pages = kind.open(file)
                total = len(pages)
                solid = parts > 1 or not total  # whether any page of a whole file has text
                for i in range(max(total * part // parts, self.first - 1), min(total * (part + 1) // parts, self.last)):
                    try:
                        content, error = pages[i], None
                    except Exception as e:  # noqa: BLE001  the row carries the error
                        content, error = None, f"{type(e).__name__}: {e}"
                    solid = solid or error is not None or bool(content.strip())
                    yield path, name, i + 1, total, content, error
                if not total or not solid and (self.first, self.last) == (1, 1 << 31):
                    raise ValueError("no content")
        except Exception as e:  # noqa: BLE001  the row carries the error
            if part == 0:
                yield path, name, None, None, None, f"{type(e).__name__}: {e}"


class PushingReader(DocumentReader):
    """A reader for sessions in which sources may take filters."""

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:  # noqa: N802
        """Take what names files, formats and page ranges; Spark keeps the rest."""
        for f in filters:
            column = ".".join(f.attribute) if hasattr(f, "attribute") else ""
            if isinstance(f, (EqualTo, In)) and column in ("path", "format"):
                values = {f.value} if isinstance(f, EqualTo) else set(f.value)
                target = "paths" if column == "path" else "names"
                held = getattr(self, target)
                setattr(self, target, values if held is None else held & values)
            elif isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual)) and column == "page_number":
                if isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual)):
                    self.first = max(self.first, f.value + isinstance(f, GreaterThan))
                if isinstance(f, (EqualTo, LessThan, LessThanOrEqual)):
                    self.last = min(self.last, f.value - isinstance(f, LessThan))
                yield f  # error rows have no page, so Spark looks again
            else:
                yield f


class DocumentSource(DataSource):
    """Options: ``path``, ``suffixes`` (comma-separated, all if empty), ``bytesPerTask``."""

    formats: tuple[Format, ...] = FORMATS
    pushes = False

    @classmethod
    def name(cls) -> str:
        return "documents"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DocumentReader:
        return (PushingReader if self.pushes else DocumentReader)(dict(self.options), self.formats)


def register(spark: SparkSession, *more: Format, name: str = "documents") -> None:
    """Make the source known to a session, with formats of the user's behind the given ones."""
    pushes = spark.conf.get("spark.sql.python.filterPushdown.enabled", "false") == "true"
    own = {"formats": (*FORMATS, *more), "pushes": pushes, "name": classmethod(lambda cls: name)}
    spark.dataSource.register(type("RegisteredDocuments", (DocumentSource,), own))
