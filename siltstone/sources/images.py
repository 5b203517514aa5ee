"""Image rows: sizes and colour statistics, patches, grid regions.

Spark's image source decodes the files; pixels are read in numpy per Arrow batch.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MAX_SIDE = 10_000


def images(spark: SparkSession, path: str) -> DataFrame:
    """(path, width, height, channels, data) of the readable images below a path."""
    raw = spark.read.format("image").option("dropInvalid", True).option("recursiveFileLookup", "true").load(path)
    return raw.select(
        F.col("image.origin").alias("path"), F.col("image.width").alias("width"), F.col("image.height").alias("height"),
        F.col("image.nChannels").alias("channels"), F.col("image.data").alias("data"),
    )


def _pixels(row) -> np.ndarray:
    flat = np.frombuffer(row.data, np.uint8).reshape(row.height, row.width, row.channels)
    return np.repeat(flat, 3, axis=2) if row.channels == 1 else flat[:, :, 2::-1]  # stored as BGR


def statistics(found: DataFrame) -> DataFrame:
    """Aspect ratio, mean and population deviation of red, green and blue."""
    names = ["mean_r", "mean_g", "mean_b", "std_r", "std_g", "std_b"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for r in pdf.itertuples(index=False):
                p = _pixels(r).reshape(-1, 3).astype(np.float64)
                rows.append((r.path, r.width, r.height, round(r.width / r.height, 2), *p.mean(0), *p.std(0)))
            yield pd.DataFrame(rows, columns=["path", "width", "height", "aspect_ratio", *names])

    fits = found.where((F.col("width") <= MAX_SIDE) & (F.col("height") <= MAX_SIDE))
    return fits.mapInPandas(run, "path string, width int, height int, aspect_ratio double, " + ", ".join(f"{n} double" for n in names))


def grid_regions(found: DataFrame, cell: int = 100, least: float = 10.0, text_below: float = 1000.0) -> DataFrame:
    """Cells whose grey variance exceeds ``least``: text under ``text_below``, else image; confidence by variance."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for r in pdf.itertuples(index=False):
                grey = _pixels(r).astype(np.float64) @ np.array([0.299, 0.587, 0.114])
                for y in range(0, r.height, cell):
                    for x in range(0, r.width, cell):
                        v = float(grey[y : y + cell, x : x + cell].var())
                        if v > least:
                            kind = "text" if v < text_below else "image"
                            rows.append((r.path, x, y, min(x + cell, r.width), min(y + cell, r.height), kind, min(1.0, v / 1000)))
            yield pd.DataFrame(rows, columns=["path", "x_min", "y_min", "x_max", "y_max", "region_type", "confidence"])

    return found.mapInPandas(run, "path string, x_min int, y_min int, x_max int, y_max int, region_type string, confidence double")


def region_features(b: Column, width: Column, height: Column) -> Column:
    """Size, centre, relative centre and aspect ratio of a pixel box."""
    w, h = b["x_max"] - b["x_min"], b["y_max"] - b["y_min"]
    cx, cy = (b["x_min"] + b["x_max"]) / 2, (b["y_min"] + b["y_max"]) / 2
    return F.struct(
        w.alias("width"), h.alias("height"), cx.alias("center_x"), cy.alias("center_y"),
        (cx / width).alias("relative_x"), (cy / height).alias("relative_y"), F.when(h > 0, w / h).otherwise(0.0).alias("aspect_ratio"),
    )


def patches(width: Column, height: Column, size: int) -> Column:
    """Corners (x, y) of whole grid crops, and three corner crops of an image larger than a patch."""
    xs, ys = (F.sequence(F.lit(0), F.greatest(F.floor(n / size).cast("int") - 1, F.lit(0))) for n in (width, height))
    at = lambda x, y: F.struct(x.cast("int").alias("x"), y.cast("int").alias("y"))
    grid = F.flatten(F.transform(ys, lambda y: F.transform(xs, lambda x: at(x * size, y * size))))
    fits = (width >= size) & (height >= size)
    corners = F.array(at(width - size, F.lit(0)), at(F.lit(0), height - size), at(width - size, height - size))
    return F.when(~fits, F.slice(grid, 1, 0)).when((width > size) & (height > size), F.concat(grid, corners)).otherwise(grid)


def _unfiltered(raw: bytes, height: int, stride: int, step: int) -> np.ndarray:
    """Rows of a PNG after its five row filters; ``step`` bytes make a pixel."""
    rows = np.frombuffer(raw, np.uint8)[: height * (stride + 1)].reshape(height, stride + 1)
    out = np.zeros((height + 1, stride + step), np.uint8)  # a border of zeros above and on the left
    for y in range(height):
        kind, line = rows[y, 0], rows[y, 1:]
        above, own = out[y], out[y + 1]
        if kind == 0:
            own[step:] = line
        elif kind == 1:
            for c in range(step):
                own[step + c :: step] = np.cumsum(line[c::step], dtype=np.uint8)
        elif kind == 2:
            own[step:] = line + above[step:]
        elif kind in (3, 4):
            up, left = above.tolist(), own.tolist()
            for i, v in enumerate(line.tolist(), step):
                a, b, c = left[i - step], up[i], up[i - step]
                if kind == 3:
                    guess = (a + b) >> 1
                else:
                    p, q, r = abs(b - c), abs(a - c), abs(a + b - 2 * c)
                    guess = a if p <= q and p <= r else b if q <= r else c
                left[i] = (v + guess) & 255
            own[:] = left
        else:
            raise ValueError(f"unknown row filter {kind}")
    return out[1:, step:]


def _png(data: bytes) -> np.ndarray:
    """Pixels (height, width, 4) of an 8-bit PNG that is not interlaced."""
    at, body, palette, clear = 8, [], None, b""
    width = height = depth = colour = 0
    while at + 12 <= len(data):
        size, name = int.from_bytes(data[at : at + 4], "big"), data[at + 4 : at + 8]
        chunk, crc = data[at + 8 : at + 8 + size], data[at + 8 + size : at + 12 + size]
        if zlib.crc32(name + chunk).to_bytes(4, "big") != crc:
            raise ValueError("damaged PNG")
        if name == b"IHDR":
            width, height, depth, colour, _, _, laced = struct.unpack(">IIBBBBB", chunk)
            if depth != 8 or laced:
                raise ValueError("only 8-bit PNG without interlacing")
        elif name == b"PLTE":
            palette = np.frombuffer(chunk, np.uint8).reshape(-1, 3)
        elif name == b"tRNS":
            clear = chunk
        elif name == b"IDAT":
            body.append(chunk)
        at += 12 + size
    step = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}[colour]
    pixels = _unfiltered(zlib.decompress(b"".join(body)), height, width * step, step).reshape(height, width, step)
    alpha = np.full((height, width, 1), 255, np.uint8)
    if colour == 3:
        table = np.full(256, 255, np.uint8)
        table[: len(clear)] = np.frombuffer(clear, np.uint8)
        return np.concatenate([palette[pixels[:, :, 0]], table[pixels[:, :, 0]][:, :, None]], 2)
    if colour in (0, 4):
        return np.concatenate([np.repeat(pixels[:, :, :1], 3, 2), pixels[:, :, 1:] if colour == 4 else alpha], 2)
    return pixels if colour == 6 else np.concatenate([pixels, alpha], 2)


def _bmp(data: bytes) -> np.ndarray:
    """Pixels (height, width, 4) of an uncompressed 24- or 32-bit BMP."""
    start, width, height, bits, packed = struct.unpack("<I4xii2xHI", data[10:34])
    if bits not in (24, 32) or packed:
        raise ValueError("only uncompressed 24- or 32-bit BMP")
    step, rows = bits // 8, abs(height)
    stride = (width * step + 3) // 4 * 4
    pixels = np.frombuffer(data, np.uint8, rows * stride, start).reshape(rows, stride)[:, : width * step].reshape(rows, width, step)
    pixels = pixels[::-1] if height > 0 else pixels
    return np.concatenate([pixels[:, :, 2::-1], np.full((rows, width, 1), 255, np.uint8)], 2)


def decoded(found: DataFrame, key: str = "path", content: str = "content") -> DataFrame:
    """(key, width, height, channels, data, error) of images held as bytes, PNG or BMP, in the form of ``images`` with four channels.

    Base64 texts are decoded before with ``unbase64``; other formats in files are read by ``images``.
    """
    kind = found.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for name, data in zip(pdf[key], pdf[content], strict=True):
                try:
                    data = bytes(data or b"")
                    read = _png if data[:8] == b"\x89PNG\r\n\x1a\n" else _bmp if data[:2] == b"BM" else None
                    if read is None:
                        raise ValueError("neither PNG nor BMP")
                    p = read(data)
                    rows.append((name, p.shape[1], p.shape[0], 4, p[:, :, [2, 1, 0, 3]].tobytes(), None))
                except Exception as e:  # noqa: BLE001  the row carries the error
                    rows.append((name, None, None, None, None, f"{type(e).__name__}: {e}"))
            made = pd.DataFrame(rows, columns=[key, "width", "height", "channels", "data", "error"])
            yield made.astype({c: "Int32" for c in ("width", "height", "channels")})

    return found.select(key, content).mapInPandas(run, f"{key} {kind}, width int, height int, channels int, data binary, error string")


def _opaque(row) -> np.ndarray:
    """Pixels (height, width, 3) as numbers, what is transparent laid on white."""
    flat = np.frombuffer(row.data, np.uint8).reshape(row.height, row.width, row.channels).astype(np.float64)
    if row.channels == 1:
        return np.repeat(flat, 3, axis=2)
    colours = flat[:, :, 2::-1]
    if row.channels < 4:
        return colours
    share = flat[:, :, 3:] / 255
    return colours * share + 255 * (1 - share)


def _shares(old: int, new: int) -> np.ndarray:
    """How much of each old cell lies in each new one; every row sums to 1."""
    edges = np.arange(new + 1) * (old / new)
    cells = np.arange(old)
    over = np.minimum(edges[1:, None], cells + 1) - np.maximum(edges[:-1, None], cells)
    return np.maximum(over, 0) * (new / old)


def thumbnail_size(width: int, height: int, most: tuple[int, int]) -> tuple[int, int]:
    """The largest size of the same shape within ``most``; never larger than the image."""
    scale = min(most[0] / width, most[1] / height, 1.0)
    return max(1, int(width * scale + 0.5)), max(1, int(height * scale + 0.5))


def thumbnails(found: DataFrame, most: tuple[int, int] = (256, 256), padded: bool = False, key: str = "path") -> DataFrame:
    """(key, name, width, height, data) of image rows: area means in RGB, transparency on white.

    With ``padded`` all have the full size, centred on white.  The name comes from the image's own bytes.
    """
    kind = found.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for r in pdf.itertuples(index=False):
                w, h = thumbnail_size(r.width, r.height, most)
                small = np.einsum("yh,hwc,xw->yxc", _shares(r.height, h), _opaque(r), _shares(r.width, w), optimize=True)
                small = np.floor(np.round(small, 9) + 0.5).astype(np.uint8)
                if padded:
                    canvas = np.full((most[1], most[0], 3), 255, np.uint8)
                    x, y = (most[0] - w) // 2, (most[1] - h) // 2
                    canvas[y : y + h, x : x + w] = small
                    small = canvas
                rows.append((getattr(r, key), f"{hashlib.sha256(r.data).hexdigest()[:16]}_thumb{'_padded' if padded else ''}", small.shape[1], small.shape[0], small.tobytes()))
            yield pd.DataFrame(rows, columns=[key, "name", "width", "height", "data"])

    some = found.where("data IS NOT NULL").select(key, "width", "height", "channels", "data")
    return some.mapInPandas(run, f"{key} {kind}, name string, width int, height int, data binary")


def feature_text(means: list[Column]) -> Column:
    """What a text model is given for an image it cannot see: its mean red, green and blue."""
    return F.format_string("Image features: RGB means %.2f, %.2f, %.2f", *means)


def encoded_images(found: DataFrame, load: Callable[[], Callable[[list[str]], list[list[float]]]], batch: int = 32) -> DataFrame:
    """Image rows with the vectors of their feature texts, ``batch`` texts meeting the model at a time."""
    from siltstone.operators.ingest import encoded

    text = feature_text([F.col(f"mean_{c}") for c in "rgb"])
    return encoded(statistics(found).withColumn("feature_text", text), load, "feature_text", batch=batch)
