import base64
import random
import struct
import zlib

from pyspark.sql import functions as F

from siltstone.operators import ingest
from siltstone.sources import images


def chunk(name, data):
    return struct.pack(">I", len(data)) + name + data + struct.pack(">I", zlib.crc32(name + data))


def png(width, height, colour, pixels, kinds, more=b""):
    """A PNG of these bytes a pixel, row by row with the given filters."""
    step = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}[colour]
    raw, before = b"", [0] * (width * step)
    for y in range(height):
        line = list(pixels[y * width * step : (y + 1) * width * step])
        kind, out = kinds[y % len(kinds)], []
        for i, v in enumerate(line):
            a, b, c = line[i - step] if i >= step else 0, before[i], before[i - step] if i >= step else 0
            near = min((abs(a + b - c - x), n, x) for n, x in enumerate((a, b, c)))[2]
            out.append((v - (0, a, b, (a + b) // 2, near)[kind]) & 255)
        raw, before = raw + bytes([kind, *out]), line
    head = struct.pack(">IIBBBBB", width, height, 8, colour, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + more + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


def test_decoded_png_and_bmp(spark):
    rng = random.Random(1)
    w, h = 7, 9
    noise = lambda n: bytes(rng.randrange(256) for _ in range(w * h * n))
    grey, rgb, both, rgba = noise(1), noise(3), noise(2), noise(4)
    palette = bytes(rng.randrange(256) for _ in range(768))
    rows = [
        ("grey", png(w, h, 0, grey, [0, 1, 2, 3, 4])), ("rgb", png(w, h, 2, rgb, [4, 3, 2, 1, 0])), ("both", png(w, h, 4, both, [3])), ("rgba", png(w, h, 6, rgba, [4, 1])),
        ("table", png(w, h, 3, grey, [2], chunk(b"PLTE", palette) + chunk(b"tRNS", b"\x00\x80"))), ("cut", png(w, h, 0, grey, [0])[:-20]), ("odd", b"GIF89a"), ("none", None),
    ]
    lines = [b"".join(bytes(rgb[(y * w + x) * 3 + c] for c in (2, 1, 0)) for x in range(w)) + b"\0" * (-w * 3 % 4) for y in reversed(range(h))]
    rows.append(("bmp", b"BM" + struct.pack("<IHHIIiiHHIIiiII", 54 + len(b"".join(lines)), 0, 0, 54, 40, w, h, 1, 24, 0, 0, 0, 0, 0, 0) + b"".join(lines)))
    texts = [(k, base64.b64encode(v).decode() if v is not None else None) for k, v in rows]
    df = spark.createDataFrame(texts, "path string, t string").select("path", F.unbase64("t").alias("content"))
    got = {r.path: r for r in images.decoded(df).collect()}
    bgra = lambda f: bytes(v for i in range(w * h) for v in f(i))
    assert bytes(got["grey"].data) == bgra(lambda i: [grey[i]] * 3 + [255]) and (got["grey"].width, got["grey"].height) == (w, h)
    three = bgra(lambda i: [rgb[3 * i + 2], rgb[3 * i + 1], rgb[3 * i], 255])
    assert bytes(got["rgb"].data) == three == bytes(got["bmp"].data)
    assert bytes(got["both"].data) == bgra(lambda i: [both[2 * i]] * 3 + [both[2 * i + 1]])
    assert bytes(got["rgba"].data) == bgra(lambda i: [rgba[4 * i + 2], rgba[4 * i + 1], rgba[4 * i], rgba[4 * i + 3]])
    clear = {0: 0, 1: 128}
    assert bytes(got["table"].data) == bgra(lambda i: [*palette[3 * grey[i] : 3 * grey[i] + 3][::-1], clear.get(grey[i], 255)])
    assert all(got[k].data is None and got[k].error for k in ("cut", "odd", "none"))


def area_mean(values, width, height, w, h):
    """Each new pixel is the mean of what it covers, cut into 60 x 60 parts a pixel."""
    out = []
    for y in range(h):
        for x in range(w):
            x0, x1, y0, y1 = x * width / w, (x + 1) * width / w, y * height / h, (y + 1) * height / h
            total = 0.0
            for j in range(int(y0), -int(-y1 // 1)):
                for i in range(int(x0), -int(-x1 // 1)):
                    total += values[j * width + i] * max(0, min(x1, i + 1) - max(x0, i)) * max(0, min(y1, j + 1) - max(y0, j))
            out.append(int(round(total / ((x1 - x0) * (y1 - y0)), 9) + 0.5))
    return out


def test_thumbnails_equal_brute_force(spark):
    rng = random.Random(2)
    rows, want = [], {}
    for n, (w, h) in enumerate([(10, 10), (13, 4), (3, 20), (2, 2), (1, 1), (7, 5)]):
        grey = [rng.randrange(256) for _ in range(w * h)]
        rows.append((str(n), w, h, 1, bytes(grey)))
        size = images.thumbnail_size(w, h, (5, 4))
        want[str(n)] = size, area_mean(grey, w, h, *size)
    assert [want[k][0] for k in "01234"] == [(4, 4), (5, 2), (1, 4), (2, 2), (1, 1)]
    rows.append(("clear", 2, 1, 4, bytes([10, 20, 30, 0, 10, 20, 30, 255])))
    rows.append(("none", None, None, None, None))
    df = spark.createDataFrame(rows, "path string, width int, height int, channels int, data binary")
    got = {r.path: r for r in images.thumbnails(df, (5, 4)).collect()}
    for k, (size, pixels) in want.items():
        assert (got[k].width, got[k].height) == size and list(got[k].data[::3]) == pixels == list(got[k].data[2::3])
    assert list(got["clear"].data) == [255, 255, 255, 30, 20, 10] and "none" not in got and got["0"].name.endswith("_thumb") and len(got["0"].name) == 22
    padded = {r.path: r for r in images.thumbnails(df, (5, 4), padded=True).collect()}
    assert all((r.width, r.height, len(r.data)) == (5, 4, 60) for r in padded.values())
    (w, h), pixels = want["2"]
    assert list(padded["2"].data[::3]) == [v for y in range(4) for v in [255, 255, pixels[y], 255, 255]]


def test_feature_texts(spark):
    df = spark.createDataFrame([("a", 2, 1, 3, bytes([1, 2, 3, 2, 4, 6]))], "path string, width int, height int, channels int, data binary")
    r = images.encoded_images(df, ingest.hash_encoder).first()
    assert r.feature_text == "Image features: RGB means 4.50, 3.00, 1.50" and len(r.embedding) == 64
