import hashlib
import random
import zlib

import numpy as np
import pytest

from siltstone.llm import jpeg


class Bits:
    def __init__(self):
        self.text = ""

    def put(self, code, n):
        self.text += f"{code:0{n}b}" if n else ""

    def bytes(self):
        text = self.text + "1" * (-len(self.text) % 8)
        raw = bytes(int(text[i : i + 8], 2) for i in range(0, len(text), 8))
        return raw.replace(b"\xff", b"\xff\x00")


def magnitude(v):
    n = abs(v).bit_length()
    return n, v if v >= 0 else v + (1 << n) - 1


def colour_image(rng, across, down, interval):
    """A 4:2:0 image with random coefficients, coded symbol by symbol; and its luminance DC levels."""
    ac_symbols = (0x00, 0x01, 0x02, 0x11, 0xF0, 0x23)
    ac_bits = (0, 0, 6, *[0] * 13)
    dc, ac = jpeg.huffman_codes(jpeg.DC_BITS, jpeg.DC_SYMBOLS), jpeg.huffman_codes(ac_bits, ac_symbols)
    luma, scan, bits = np.zeros((down * 2, across * 2), int), b"", Bits()
    last = [0, 0, 0]
    for m in range(across * down):
        if m and m % interval == 0:
            scan += bits.bytes() + bytes((0xFF, 0xD0 + (m // interval - 1) % 8))
            bits, last = Bits(), [0, 0, 0]
        for c, blocks in ((0, 4), (1, 1), (2, 1)):
            for b in range(blocks):
                level = rng.randint(-100, 100)
                n, extra = magnitude(level - last[c])
                last[c] = level
                bits.put(*dc[n])
                bits.put(extra, n)
                if c == 0:
                    luma[m // across * 2 + b // 2, m % across * 2 + b % 2] = level
                k = 1
                while k < 40 and rng.random() < 0.6:
                    symbol = rng.choice(ac_symbols[1:])
                    bits.put(*ac[symbol])
                    n = symbol & 15
                    bits.put(rng.randrange(1 << n), n)
                    k += (symbol >> 4) + 1
                bits.put(*ac[0])
    scan += bits.bytes()
    seg = jpeg._segment
    huff = lambda kind, b, s: bytes((kind,)) + bytes(b) + bytes(s)
    head = seg(0xDB, b"\x00" + bytes([8] * 64)) + seg(
        0xC0, b"\x08" + (down * 16).to_bytes(2, "big") + (across * 16).to_bytes(2, "big") + b"\x03\x01\x22\x00\x02\x11\x00\x03\x11\x00"
    )
    head += seg(0xC4, huff(0, jpeg.DC_BITS, jpeg.DC_SYMBOLS)) + seg(0xC4, huff(0x10, ac_bits, ac_symbols))
    head += seg(0xDD, interval.to_bytes(2, "big")) + seg(0xDA, b"\x03\x01\x00\x02\x00\x03\x00\x00\x3f\x00")
    return b"\xff\xd8" + head + scan + b"\xff\xd9", luma


def test_colour_scans_with_coefficients():
    rng = random.Random(3)
    for across, down, interval in ((1, 1, 9), (3, 2, 2), (4, 3, 5)):
        media, luma = colour_image(rng, across, down, interval)
        got = jpeg.thumbnails(jpeg.parse(media) * 2)
        assert all((g == np.clip(luma + 128, 0, 255)).all() for g in got)


def test_round_trip(monkeypatch):
    rng = random.Random(1)
    payloads = [jpeg.payload_of(x) for x in (b"", b"a", b"x" * 64, b"y" * 65, bytes(range(256)) * 9, bytes([0, 255] * 999), rng.randbytes(64 * 700))]
    for chunk, side, width in ((1 << 15, 8191, 4096), (7, 3, 128)):
        monkeypatch.setattr(jpeg, "_CHUNK", chunk)
        monkeypatch.setattr(jpeg, "MAX_SIDE", side)
        monkeypatch.setattr(jpeg, "MAX_WIDTH", width)
        media = jpeg.store_batch(payloads)
        assert [p for p, _ in jpeg.read_batch(media)] == payloads
        assert all(m.startswith(b"\xff\xd8") and m.endswith(b"\xff\xd9") for m in media)


def test_bad_streams():
    assert jpeg.parse(b"") == []
    for bad in (b"no image", b"\xff\xd8\xff\xc2\x00\x04\x00\x00"):
        with pytest.raises(ValueError):
            jpeg.parse(bad)


def test_query_rows(spark):
    rows = [(1, None), (2, ""), (3, "é" * 40), (3, "é" * 40), (4, "long " * 30000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS media", "2 AS width")
    got = jpeg.media_columns(df).collect()
    for r, (_, text) in zip(got, rows, strict=True):
        raw = (text or "").encode()
        payload = raw + bytes(-len(raw) % 64 or (64 if not raw else 0))
        assert (r.n_bytes, r.payload_bytes) == (len(raw), len(payload))
        assert r.payload_sha256 == hashlib.sha256(payload).hexdigest() and r.tail_crc32 == zlib.crc32(payload[-64:])
        assert r.media_bytes == len(r.media) and r.media_sha256 == hashlib.sha256(r.media).hexdigest()
    assert got[2][1:] == got[3][1:] and jpeg.media_columns(df.limit(0)).count() == 0


def test_damaged_streams_are_refused():
    media = jpeg.store_batch([bytes(range(256)) * 8])[0]
    assert len(jpeg.thumbnails(jpeg.parse(media))) == 1
    at = media.index(b"\xff\xd1")
    scan = media.index(b"\xff\xda") + 10
    no_code = media[:scan] + b"\xfb" * (media.index(b"\xff\xd0") - scan) + media[media.index(b"\xff\xd0") :]
    for bad in (media[:-2], media + b"x", media[:at] + b"\xff\xd5" + media[at + 2 :], media[: at - 8] + media[at:], media[:at] + media[at + 2 :],
                media[:scan] + b"\x00" * 40 + media[scan:], no_code, media[: len(media) // 2]):
        with pytest.raises(ValueError):
            jpeg.thumbnails(jpeg.parse(bad))


def test_feature_follows_all_frames(monkeypatch):
    monkeypatch.setattr(jpeg, "MAX_SIDE", 3)
    monkeypatch.setattr(jpeg, "MAX_WIDTH", 128)
    rng = random.Random(4)
    head = rng.randbytes(384)
    thumbs = [jpeg.whole_thumbnail(t) for _, t in jpeg.read_batch(jpeg.store_batch([head + rng.randbytes(640) for _ in range(2)]))]
    assert [t.shape for t in thumbs] == [(8, 128)] * 2 and jpeg.difference_hash(thumbs[0]) != jpeg.difference_hash(thumbs[1])


def test_reads_what_another_encoder_writes(spark):
    """Block means of images that Java's image library wrote, against the pixels it reads back."""
    jvm, rng = spark.sparkContext._jvm, random.Random(9)
    for kind, (width, height) in ((10, (40, 24)), (10, (17, 9)), (5, (64, 32))):
        image, bands = jvm.java.awt.image.BufferedImage(width, height, kind), 1 if kind == 10 else 3
        for y in range(height):
            for x in range(width):
                for band in range(bands):
                    image.getRaster().setSample(x, y, band, rng.randrange(70, 180))
        out = jvm.java.io.ByteArrayOutputStream()
        assert jvm.javax.imageio.ImageIO.write(image, "jpg", out)
        back = jvm.javax.imageio.ImageIO.read(jvm.java.io.ByteArrayInputStream(out.toByteArray())).getRaster()
        thumb = jpeg.thumbnails(jpeg.parse(bytes(out.toByteArray())))[0]
        for by in range(height // 8):
            for bx in range(width // 8):
                total = 0.0
                for y in range(8):
                    for x in range(8):
                        c = [back.getSample(8 * bx + x, 8 * by + y, band) for band in range(bands)]
                        total += c[0] if bands == 1 else 0.299 * c[0] + 0.587 * c[1] + 0.114 * c[2]
                assert abs(thumb[by, bx] - total / 64) < 4
