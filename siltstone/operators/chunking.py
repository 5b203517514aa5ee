"""Chunkers: fixed, sliding, sentence and region based; page attribution.

Positions are code points, half open.  Fixed and sliding chunks are closed
forms over a sequence; sentence and region chunks depend on what came before
and fold over a document's array, one pass per document.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.operators import scans
from siltstone.sources.scratch import written

ATOMIC = ("table", "equation", "image")


def _cut(
    df: DataFrame, size: int, step: int, count: Column, id_col: str, text_col: str, keep: Sequence[str], pages: Column | None
) -> DataFrame:
    """Chunks made and numbered inside the row, so nothing is shuffled; ``keep`` names columns to carry along."""
    # the text in pieces of one step; a chunk lies in the first few from its own
    width = -(-size // step)

    def chunk(row: Column, slot: Column) -> Column:
        start = (slot * step).cast("int")
        end = F.least(start + size, row["length"]).cast("int")
        body = F.substring(F.array_join(F.slice(row["pieces"], slot + 1, F.lit(width)), ""), 1, size)
        fields = [start.alias("start_index"), end.alias("end_index"), body.alias("content")]
        return F.struct(*fields, *([_on_pages(row["pages"], start, end).alias("on")] if pages is not None else []))

    # what all chunks of a row need is computed once, as a variable
    pieces = F.regexp_extract_all(F.col(text_col), F.lit(f"(?s).{{1,{step}}}"), F.lit(0))
    row = F.struct(pieces.alias("pieces"), F.length(text_col).alias("length"), *([_searchable(pages).alias("pages")] if pages is not None else []))
    chunks = F.transform(F.array(row), lambda x: F.transform(F.sequence(F.lit(0), count - 1), lambda slot: chunk(x, slot)))[0]
    solid = df.select(id_col, *keep, F.filter(chunks, lambda c: c["content"].rlike(r"(?U)\S")).alias("chunks"))
    each = solid.select(id_col, *keep, F.size("chunks").alias("total_chunks"), F.posexplode("chunks").alias("chunk_index", "c"))
    made = each.select(id_col, *keep, "c.start_index", "c.end_index", "c.content", "chunk_index", "total_chunks", *(["c.on.*"] if pages is not None else []))
    return made if keep or pages is not None else made.drop("total_chunks")


def _searchable(pages: Column) -> Column:
    """Page boundaries by start, without empty ones, and for each the furthest end so far: what a binary search needs.

    The running maximum doubles its reach in each round.
    """
    full = F.filter(pages, lambda p: (p["page_start"] < p["page_end"]) & p["page_number"].isNotNull())
    by_start = F.array_sort(F.transform(full, lambda p: F.struct(p["page_start"].alias("start"), p["page_end"].alias("end"), p["page_number"].alias("number"))))

    def reached(sorted_: Column) -> Column:
        rounds = F.ceil(F.log2(F.greatest(F.size(sorted_), F.lit(2)))).cast("int")
        further = lambda ends, k: F.transform(ends, lambda x, i: F.greatest(x, F.get(ends, i - F.pow(2, k - 1).cast("int"))))
        return F.aggregate(F.sequence(F.lit(1), rounds), F.transform(sorted_, lambda p: p["end"]), further)

    return F.transform(F.array(by_start), lambda x: F.struct(x.alias("pages"), reached(x).alias("reach")))[0]


def _first_over(values: Column, at: Column, of: Callable[[Column], Column], strictly: bool) -> Column:
    """Place (from 0) of the first value over ``at`` (or at it, unless ``strictly``) in an array that never falls."""
    start = F.struct(F.lit(0).alias("low"), F.size(values).alias("high"))

    def halve(s: Column, _: Column) -> Column:
        mid = ((s["low"] + s["high"]) / 2).cast("int")
        value = of(F.get(values, mid))
        right = F.when(s["low"] < s["high"], value <= at if strictly else value < at).otherwise(False)
        done = s["low"] >= s["high"]
        return F.struct(F.when(right, mid + 1).otherwise(s["low"]).alias("low"), F.when(right | done, s["high"]).otherwise(mid).alias("high"))

    rounds = F.ceil(F.log2(F.size(values) + 2)).cast("int")
    return F.aggregate(F.sequence(F.lit(1), rounds), start, halve, lambda s: s["low"])


def _on_pages(found: Column, start: Column, end: Column) -> Column:
    """Primary page (largest overlap, first on ties), all pages in order and their number of a range; ``found`` is ``_searchable``."""

    def of(met: Column) -> Column:
        shared = F.transform(met, lambda p: F.struct(F.least(end, p["end"]) - F.greatest(start, p["start"]), (-p["number"]).alias("back")))
        return F.struct((-F.array_max(shared)["back"]).alias("page_number"), F.sort_array(F.transform(met, lambda p: p["number"])).alias("page_numbers"), F.size(met).alias("pages_spanned"))

    first = _first_over(found["reach"], start, lambda x: x, strictly=True)
    behind = _first_over(found["pages"], end, lambda p: p["start"], strictly=False)
    near = F.transform(F.array(F.struct(first.alias("a"), behind.alias("b"))), lambda r: F.slice(found["pages"], r["a"] + 1, F.greatest(r["b"] - r["a"], F.lit(0))))[0]
    met = F.filter(near, lambda p: p["end"] > start)
    return F.transform(F.array(met), lambda m: F.when(F.size(m) > 0, of(m)))[0]


def fixed_chunks(
    df: DataFrame, size: int = 512, overlap: int = 0, id_col: str = "doc_id", text_col: str = "text", keep: Sequence[str] = (), pages: Column | None = None
) -> DataFrame:
    """Chunks of ``size`` with ``overlap``; blank ones are dropped and numbering stays dense.

    With ``pages``, an array of (page_number, page_start, page_end) in the row, each chunk gets its primary page, all its pages
    and their number, found by binary search.  Pages may have any lengths, overlap, leave gaps or be empty; a chunk on none has nulls.
    """
    if size <= 0 or not 0 <= overlap < size:
        raise ValueError("need 0 <= overlap < size")
    count = F.greatest(F.lit(1), F.ceil((F.length(text_col) - overlap) / F.lit(size - overlap))).cast("int")
    return _cut(df.where(F.length(text_col) > 0), size, size - overlap, count, id_col, text_col, keep, pages)


def sliding_chunks(
    df: DataFrame, window: int = 512, step: int = 256, id_col: str = "doc_id", text_col: str = "text", keep: Sequence[str] = (), pages: Column | None = None
) -> DataFrame:
    """Windows that start every ``step``, up to the first that reaches the end."""
    if not 0 < step < window:
        raise ValueError("need 0 < step < window")
    count = F.when(F.length(text_col) <= window, 1).otherwise(F.ceil((F.length(text_col) - window) / F.lit(step)) + 1).cast("int")
    return _cut(df.where(F.length(text_col) > 0), window, step, count, id_col, text_col, keep, pages)


def page_boundaries(text: Column, size: int = 1000) -> Column:
    """Array of (page_number, page_start, page_end): a page every ``size`` characters."""
    count = F.ceil(F.length(text) / size).cast("int")
    return F.when(F.length(text) > 0, F.transform(F.sequence(F.lit(1), F.greatest(count, F.lit(1))), lambda n: F.struct(
        n.alias("page_number"), ((n - 1) * size).alias("page_start"), F.least(n * size, F.length(text)).alias("page_end")
    )))


def packed_sentences(parts: Column, max_size: int, overlap: int) -> Column:
    """Array of (content, start, end, sentence_count) from an array of sentences.

    Positions keep the published formula: they count each sentence with one
    separator, so the first chunk starts at 1.
    """
    if overlap < 0:
        raise ValueError("overlap must not be negative")
    chunk = "array<struct<content:string,start_index:int,end_index:int,sentence_count:int>>"
    state = F.struct(
        F.array().cast(chunk).alias("out"), F.array().cast("array<string>").alias("cur"), F.lit(0).alias("size"), F.lit(0).alias("pos")
    )

    def closed(s: Column) -> Column:
        return F.concat(s["out"], F.array(F.struct(
            F.array_join(s["cur"], " ").alias("content"), (s["pos"] - s["size"]).alias("start_index"),
            s["pos"].alias("end_index"), F.size(s["cur"]).alias("sentence_count"),
        )))

    def step(s: Column, sentence: Column) -> Column:
        n = F.length(sentence)
        flush = (s["size"] + n > max_size) & (F.size(s["cur"]) > 0)
        tail = F.slice(s["cur"], F.greatest(F.size(s["cur"]) - overlap + 1, F.lit(1)), F.lit(overlap)) if overlap else F.array().cast("array<string>")
        kept = F.when(flush, tail).otherwise(s["cur"])
        tail_size = F.aggregate(tail, F.lit(-1), lambda a, x: a + F.length(x) + 1)
        size = F.when(flush, tail_size).otherwise(s["size"])
        grown = size + n + F.when(size > 0, 1).otherwise(0)
        return F.struct(
            F.when(flush, closed(s)).otherwise(s["out"]).alias("out"), F.concat(kept, F.array(sentence)).alias("cur"),
            grown.alias("size"), (s["pos"] + n + 1).alias("pos"),
        )

    return F.aggregate(parts, state, step, lambda s: F.when(F.size(s["cur"]) > 0, closed(s)).otherwise(s["out"]))


def sentence_chunks(df: DataFrame, max_size: int = 512, overlap: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Whole sentences packed up to ``max_size``; the last ``overlap`` ones start the next chunk."""
    from siltstone.functions.text import sentences

    packed = df.select(id_col, F.posexplode(packed_sentences(sentences(F.col(text_col)), max_size, overlap)).alias("chunk_index", "c"))
    return packed.select(id_col, "chunk_index", "c.*")


def pages_of_length(df: DataFrame, size: int = 1000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Page boundaries every ``size`` characters: (id, page_number, page_start, page_end)."""
    pages = df.where(F.length(text_col) > 0).select(
        id_col, F.length(text_col).alias("n"), F.explode(F.sequence(F.lit(1), F.ceil(F.length(text_col) / size).cast("int"))).alias("page_number")
    )
    start = (F.col("page_number") - 1) * size
    return pages.select(id_col, "page_number", start.alias("page_start"), F.least(start + size, F.col("n")).alias("page_end"))


def attribute_pages(chunks: DataFrame, pages: DataFrame, id_col: str = "doc_id", width: int | None = None) -> DataFrame:
    """Primary page (largest overlap, first on ties), all pages and their number, for each chunk with any.

    A range join: both sides go to the bins of ``width`` characters (the mean page, if not given) that they touch, rows of one
    document and bin meet, and a pair counts in the first bin that both touch.  A document is thus dealt in as many parts as it
    has bins, and no chunk meets pages far from it.
    """
    full = pages.where((F.col("page_start") < F.col("page_end")) & F.col("page_number").isNotNull())
    if width is None:
        width = max(64, math.ceil(full.agg(F.avg(F.col("page_end") - F.col("page_start"))).first()[0] or 0))
    bin_of = lambda c: F.floor(F.col(c) / width) if isinstance(c, str) else F.floor(c / width)
    binned = lambda df, a, b: df.where(F.col(a) < F.col(b)).withColumn("__bin", F.explode(F.sequence(bin_of(a), bin_of(F.col(b) - 1))))
    left = binned(chunks.select(id_col, "chunk_index", "start_index", "end_index"), "start_index", "end_index")
    right = binned(full.select(id_col, "page_number", "page_start", "page_end"), "page_start", "page_end")
    first = F.greatest(bin_of("start_index"), bin_of("page_start"))
    both = left.join(right, [id_col, "__bin"]).where((F.greatest("start_index", "page_start") < F.least("end_index", "page_end")) & (F.col("__bin") == first))
    shared = F.least("end_index", "page_end") - F.greatest("start_index", "page_start")
    found = both.groupBy(id_col, "chunk_index").agg(
        F.max_by("page_number", F.struct(shared, -F.col("page_number"))).alias("page_number"),
        F.sort_array(F.collect_list("page_number")).alias("page_numbers"),
    )
    return found.withColumn("pages_spanned", F.size("page_numbers"))


def packed_regions(regions: Column, max_size: int, measured: bool = False) -> Column:
    """Array of sections, each an array of regions, from an array of regions in order.

    A table, equation or image is a section of its own, a title or heading opens one, and others join the section before them
    while the sum of their lengths stays within ``max_size``.  ``measured`` regions have a field ``length``.
    """
    atomic = lambda r: r["region_type"].isin(*ATOMIC)
    title = lambda r: r["region_type"].isin("title", "heading")
    length = lambda r: F.coalesce(r["length"] if measured else F.length(r["content"]), F.lit(0))

    def number(s: Column, r: Column) -> Column:
        joins = s["open"] & ~atomic(r) & ~title(r) & (s["size"] + length(r) <= max_size)
        return F.struct(
            F.when(joins, s["number"]).otherwise(s["number"] + 1).alias("number"), (~atomic(r)).alias("open"),
            F.when(joins, s["size"]).otherwise(F.lit(0)) + length(r), F.concat(s["starts"], F.when(joins, F.array().cast("array<int>")).otherwise(F.array(s["at"]))).alias("starts"),
            (s["at"] + 1).alias("at"),
        )

    begin = F.struct(F.lit(-1).alias("number"), F.lit(False).alias("open"), F.lit(0).alias("size"), F.array().cast("array<int>").alias("starts"), F.lit(0).alias("at"))
    starts = F.aggregate(regions, begin, lambda s, r: _renamed(number(s, r)), lambda s: s["starts"])
    cut = lambda at: F.transform(at, lambda a, i: F.slice(regions, a + 1, F.coalesce(F.get(at, i + 1), F.size(regions)) - a))
    return F.transform(F.array(starts), cut)[0]


def _renamed(state: Column) -> Column:
    return state.cast("struct<number:int,open:boolean,size:int,starts:array<int>,at:int>")


def region_chunks(
    regions: DataFrame, max_size: int = 1000, id_col: str = "doc_id", order_col: str = "region_sequence"
) -> DataFrame:
    """Chunks of regions: tables, equations and images alone, titles open a section, text fills up to ``max_size``.

    A document's regions are gathered in one row, in order, and packed there.
    """
    own = F.sort_array(F.collect_list(F.struct(order_col, "region_type", "content", F.col("page_number").cast("int").alias("page_number"))))
    each = regions.groupBy(id_col).agg(own.alias("regions"))
    chunks = each.select(id_col, F.posexplode(packed_regions(F.col("regions"), max_size)).alias("chunk_index", "c"))
    of = lambda name: F.transform("c", lambda r: r[name])
    return chunks.select(
        id_col, "chunk_index", F.array_join(F.transform("c", lambda r: F.coalesce(r["content"], F.lit(""))), "\n\n").alias("content"),
        of("region_type").alias("region_types"), F.array_compact(F.sort_array(F.array_distinct(of("page_number")))).alias("page_numbers"),
        F.size("c").alias("n_regions"), F.coalesce(F.get("c", F.lit(0))["region_type"].isin(*ATOMIC), F.lit(False)).alias("atomic"),
    )


#: Fields that only regions of one type bring to their chunk (fixed values).
_OWN = {
    "table": ("table_html", "table_rows", "table_cols"), "equation": ("equation_latex", "equation_type"), "image": ("image_description", "image_type"),
}


def semantic_chunks(regions: DataFrame, max_size: int = 1000, id_col: str = "doc_id", order_col: str = "region_sequence", content: bool = True) -> DataFrame:
    """Chunks of regions as ``region_chunks`` packs them, each with its metadata as a map of texts.

    A chunk of one table, equation or image carries that region's fields (empty ones and zeros are left out), any other the types, ids,
    pages and tags of all its regions.  Lists are joined by commas; regions may lack any of the optional columns.
    Without ``content`` the chunks have no texts, and only their lengths are gathered.
    """
    optional = ["region_id", "semantic_tags", "markdown_level", *[f for fields in _OWN.values() for f in fields]]
    some = [F.col(c) if c in regions.columns else F.lit(None).cast("array<string>" if c == "semantic_tags" else "string").alias(c) for c in optional]
    own = F.col("content") if content else F.xxhash64("content").alias("mark")
    row = F.struct(F.col(order_col).alias("sequence"), "region_type", own, F.length("content").alias("length"), F.col("page_number").cast("int").alias("page_number"), *some)
    each = regions.groupBy(id_col).agg(F.sort_array(F.collect_list(row)).alias("regions"))
    chunks = each.select(id_col, F.posexplode(packed_regions(F.col("regions"), max_size, measured=True)).alias("chunk_index", "c"))
    first, text = F.get("c", F.lit(0)), lambda c: c.cast("string")
    of = lambda name: F.transform("c", lambda r: r[name])
    joined = lambda c: F.nullif(F.array_join(c.cast("array<string>"), ","), F.lit(""))
    pages = F.array_compact(F.sort_array(F.array_distinct(of("page_number"))))
    tags = F.array_sort(F.array_distinct(F.flatten(F.array_compact(of("semantic_tags")))))
    alone = F.coalesce(first["region_type"].isin(*ATOMIC), F.lit(False))
    size = F.aggregate("c", F.lit(-2), lambda n, r: n + 2 + F.coalesce(r["length"], F.lit(0)))  # joined by blank lines
    texts = [F.array_join(F.transform("c", lambda r: F.coalesce(r["content"], F.lit(""))), "\n\n").alias("content")] if content else []
    solid = lambda c: F.when(~text(c).isin("", "0"), text(c))
    entries = {
        "chunk_index": text(F.col("chunk_index")), "chunking_strategy": F.lit("semantic_region"), "start_index": F.lit("0"), "end_index": text(size),
        "page_number": text(F.get(pages, F.lit(0))), "semantic_tags": joined(tags), "atomic": F.when(alone, "true"), "region_id": F.when(alone, first["region_id"]),
        "region_type": F.when(alone, first["region_type"]), "region_sequence": F.when(alone, text(first["sequence"])), "markdown_level": F.when(alone, text(first["markdown_level"])),
        **{f: F.when(alone & (first["region_type"] == kind), solid(first[f])) for kind, fields in _OWN.items() for f in fields},
        "merged_regions": F.when(~alone, text(F.size("c"))), "region_types": F.when(~alone, joined(of("region_type"))), "region_ids": F.when(~alone, joined(of("region_id"))),
        "page_numbers": F.when(~alone & (F.size(pages) > 1), joined(pages)), "pages_spanned": F.when(~alone & (F.size(pages) > 1), text(F.size(pages))),
    }
    metadata = F.create_map(*[x for k, v in entries.items() for x in (F.lit(k), v)])
    return chunks.select(id_col, "chunk_index", *texts, F.map_filter(metadata, lambda _, v: v.isNotNull()).alias("metadata"))


def token_batches(
    df: DataFrame, max_tokens: int = 8192, max_items: int = 32, key_col: str = "key", order_col: str = "id", text_col: str = "text", rows: int = 65_536
) -> DataFrame:
    """Greedy batches by estimated tokens (1.3 a word) within each key: batch_number, tokens per row.

    A batch holds ``max_items`` rows at most, so where the next one starts follows from a few rows.  A key is cut into pieces of
    ``rows`` rows, each with a look at the rows behind it.  For a first batch starting at each of the first
    ``max_items`` rows, a piece tells where the first batch behind it starts and how many start inside.  These maps are composed over the
    pieces of a key by doubling, which gives every piece its first batch and number; then batches are numbered inside the pieces.
    """
    from siltstone.functions.text import token_estimate

    tokens = df.select(key_col, order_col, token_estimate(F.coalesce(F.col(text_col), F.lit(""))).alias("tokens"))
    placed = scans.numbered(tokens, key_col, [order_col, "tokens"], "__n", rows)
    rows = max(rows, max_items)
    own = F.floor(F.col("__n") / rows)
    # the first rows of a piece are also seen by the piece before
    seen = F.when((F.col("__n") % rows < max_items) & (own > 0), F.array(own, own - 1)).otherwise(F.array(own))
    dealt = written(placed.withColumn(scans.GROUP, F.struct(key_col)).withColumn(scans.PIECE, F.explode(seen)), "token_pieces")
    narrow = dealt.select(scans.GROUP, scans.PIECE, "__n", "tokens")
    group = dealt.schema[scans.GROUP].dataType.simpleString()

    def ends(pdf: pd.DataFrame) -> tuple[pd.DataFrame, np.ndarray, int]:
        """Rows in order, for each the row at which the batch after its own starts, and how many rows are the piece's."""
        pdf = pdf.sort_values("__n", ignore_index=True)
        sums = np.concatenate([[0], np.cumsum(pdf["tokens"].to_numpy(np.int64))])
        at = np.arange(len(pdf))
        full = np.searchsorted(sums, sums[:-1] + max_tokens, "right") - 1  # a sum of max_tokens still fits
        own_rows = int((pdf["__n"] // rows == pdf[scans.PIECE].iloc[0]).sum())
        return pdf, np.minimum(np.maximum(full, at + 1), at + max_items), own_rows

    def mapped(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf, after, n = ends(pdf)
        exits, counts = [], []
        known: dict[int, tuple[int, int]] = {}
        for first in range(max_items):
            path, at = [], first
            while at < n and at not in known:
                path.append(at)
                at = int(after[at])
            leaves, more = known[at] if at in known else (at - n, 0)
            for i in reversed(path):
                more += 1
                known[i] = (leaves, more)
            exits.append(leaves)
            counts.append(more)
        return pd.DataFrame({scans.GROUP: [pdf[scans.GROUP].iloc[0]], scans.PIECE: [pdf[scans.PIECE].iloc[0]], "exits": [exits], "counts": [counts]})

    def marked(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf, after, n = ends(pdf)
        starts, at = np.zeros(n, np.int64), int(pdf["first"].iloc[0])
        while at < n:
            starts[at] = 1
            at = int(after[at])
        numbers = pdf["before"].iloc[0] + np.cumsum(starts) - 1
        return pd.DataFrame({scans.GROUP: pdf[scans.GROUP][:n], "__n": pdf["__n"][:n], "batch_number": numbers})

    maps = written(narrow.groupBy(*scans.KEYS).applyInPandas(mapped, f"{scans.GROUP} {group}, {scans.PIECE} long, exits array<int>, counts array<long>"), "token_maps")
    most = maps.agg(F.max(scans.PIECE)).first()[0] or 0
    step = 1
    while step <= most:
        early = maps.select(scans.GROUP, (F.col(scans.PIECE) + step).alias(scans.PIECE), F.col("exits").alias("e"), F.col("counts").alias("c"))
        both = maps.join(early, scans.KEYS, "left")
        # an entry goes through the earlier pieces first
        exits = F.transform("e", lambda x: F.get("exits", x))
        counts = F.zip_with("c", "e", lambda n, x: n + F.get("counts", x))
        maps = written(both.select(*scans.KEYS, F.coalesce(exits, "exits").alias("exits"), F.coalesce(counts, "counts").alias("counts")), "token_maps")
        step *= 2
    state = maps.select(scans.GROUP, (F.col(scans.PIECE) + 1).alias(scans.PIECE), F.get("exits", F.lit(0)).alias("first"), F.get("counts", F.lit(0)).alias("before"))
    entered = narrow.join(state, scans.KEYS, "left").fillna(0, ["first", "before"])
    numbers = entered.groupBy(*scans.KEYS).applyInPandas(marked, f"{scans.GROUP} {group}, __n long, batch_number int")
    kept = dealt.where(F.col(scans.PIECE) == own)
    return kept.join(numbers, [scans.GROUP, "__n"]).select(key_col, order_col, "tokens", "batch_number")
