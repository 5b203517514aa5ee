"""Baseline JPEG: lossless byte carrier, marker parser, DC-only thumbnails.

A payload byte is the luminance of one 8x8 block: with a DC quantiser of 8 the
block's mean is its DC coefficient, so a DC-only decode returns the bytes
exactly.  Frames are grey, 64 blocks (or a power of two times that) wide, and every
64 blocks end with a restart marker.

The decoder parses markers, cuts the scan at restart markers, and decodes the
segments of many images in step with numpy: each step looks up one Huffman
code per segment in a 16-bit table.  It reads any baseline scan with all components
interleaved or a single one, skips AC coefficients, and returns the luminance mean per block.

Defined results: a null or empty text is stored as 64 zero bytes; equal texts
give equal media; payloads beyond one frame's size continue in further frames, and dimensions and
feature are those of all frames' rows one below the other; an empty table gives an empty result; other columns are
not read, whatever their names.  A stream that is not whole baseline JPEG (unknown codes, restart
markers out of turn, missing or spare bytes) raises ValueError.
"""

from __future__ import annotations

import hashlib
import zlib
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame

from siltstone.llm.common import per_document

INTERVAL = 64
MAX_SIDE = 8191  # blocks; 65,528 pixels
MAX_WIDTH = 4096
_CHUNK = 1 << 15  # segments that are coded at once

#: Huffman code counts by length 1 to 16 and symbols of the DC table (Annex K luminance, fixed values).
DC_BITS = (0, 1, 5, 1, 1, 1, 1, 1, 1, 0, 0, 0, 0, 0, 0, 0)
DC_SYMBOLS = tuple(range(12))
#: The only AC symbol is the end of a block.
AC_BITS = (1, *[0] * 15)
AC_SYMBOLS = (0,)


def huffman_codes(bits: tuple[int, ...], symbols: tuple[int, ...]) -> dict[int, tuple[int, int]]:
    """symbol -> (code, length) of a canonical table."""
    out, code, at = {}, 0, 0
    for length, n in enumerate(bits, 1):
        for symbol in symbols[at : at + n]:
            out[symbol] = (code, length)
            code += 1
        at += n
        code <<= 1
    return out


def lookup(bits: tuple[int, ...], symbols: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
    """Symbol and code length by the next 16 bits; length 0 is no code."""
    symbol, length = np.zeros(1 << 16, np.uint8), np.zeros(1 << 16, np.uint8)
    for s, (code, n) in huffman_codes(bits, symbols).items():
        symbol[code << 16 - n : code + 1 << 16 - n] = s
        length[code << 16 - n : code + 1 << 16 - n] = n
    return symbol, length


def _segment(marker: int, body: bytes) -> bytes:
    return bytes((0xFF, marker)) + (len(body) + 2).to_bytes(2, "big") + body


def _block_codes() -> tuple[np.ndarray, np.ndarray]:
    """Bits and their number for a block with DC difference -255 to 255, at index difference + 255."""
    dc, end = huffman_codes(DC_BITS, DC_SYMBOLS), huffman_codes(AC_BITS, AC_SYMBOLS)[0]
    codes, sizes = np.zeros(511, np.uint64), np.zeros(511, np.uint64)
    for d in range(-255, 256):
        size = abs(d).bit_length()
        code, n = dc[size]
        extra = d if d >= 0 else d + (1 << size) - 1
        codes[d + 255] = ((code << size | extra) << end[1]) | end[0]
        sizes[d + 255] = n + size + end[1]
    return codes, sizes


_CODES, _SIZES = _block_codes()


def entropy_coded(levels: np.ndarray, marks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Scan bytes of intervals (rows of 64 DC levels), each closed by marker ``marks``; and bytes per row."""
    diff = np.diff(levels.astype(np.int16), axis=1, prepend=np.int16(0)) + 255
    code, size = _CODES[diff], _SIZES[diff]
    # four blocks take at most 60 bits
    for _ in range(2):
        code = code[:, 0::2] << size[:, 1::2] | code[:, 1::2]
        size = size[:, 0::2] + size[:, 1::2]
    offset = np.cumsum(size, axis=1)
    total = offset[:, -1]
    pad = (np.uint64(0) - total) % np.uint64(8)
    code = np.concatenate([code, ((np.uint64(1) << pad) - np.uint64(1))[:, None]], axis=1)
    size = np.concatenate([size, pad[:, None]], axis=1)
    offset = np.concatenate([np.zeros_like(total)[:, None], offset], axis=1)
    words = np.zeros((len(levels), 18), np.uint64)
    rows = np.arange(len(levels))
    for j in range(code.shape[1]):
        c, at = code[:, j], offset[:, j]
        word, end = (at >> np.uint64(6)).astype(np.int64), (at & np.uint64(63)) + size[:, j]
        over = end > 64
        spill = np.where(over, end - np.uint64(64), np.uint64(0))
        # a shift by 64 would only meet an empty code
        left = np.where(over, np.uint64(0), (np.uint64(64) - end) & np.uint64(63))
        words[rows, word] |= (c >> spill) << left
        words[rows, word + 1] |= np.where(over, c << ((np.uint64(64) - spill) & np.uint64(63)), np.uint64(0))
    data = words.astype(">u8").view(np.uint8)
    n = ((total + pad) >> np.uint64(3)).astype(np.int64)
    data[rows, n] = 0xFF
    data[rows, n + 1] = marks
    column = np.arange(data.shape[1])
    flat = data[column < (n + 2)[:, None]]
    row = np.repeat(rows, n + 2)
    inside = np.arange(len(flat)) - np.repeat(np.cumsum(n + 2) - (n + 2), n + 2) < np.repeat(n, n + 2)
    stuffed = (flat == 0xFF) & inside
    copies = 1 + stuffed
    out = np.repeat(flat, copies)
    out[np.cumsum(copies)[stuffed] - 1] = 0
    return out, np.bincount(row, copies, len(levels)).astype(np.int64)


def _header(width: int, height: int, note: bytes) -> bytes:
    quant = bytes([8] * 64)
    huff = lambda kind, bits, symbols: bytes((kind,)) + bytes(bits) + bytes(symbols)
    return b"".join(
        (
            b"\xff\xd8", _segment(0xFE, note), _segment(0xDB, b"\x00" + quant),
            _segment(0xC0, b"\x08" + (height * 8).to_bytes(2, "big") + (width * 8).to_bytes(2, "big") + b"\x01\x01\x11\x00"),
            _segment(0xC4, huff(0x00, DC_BITS, DC_SYMBOLS)), _segment(0xC4, huff(0x10, AC_BITS, AC_SYMBOLS)),
            _segment(0xDD, INTERVAL.to_bytes(2, "big")), _segment(0xDA, b"\x01\x01\x00\x00\x3f\x00"),
        )
    )


def frame_shape(n: int) -> tuple[int, int]:
    """Width and height in blocks for ``n`` payload bytes."""
    width = INTERVAL
    while width < MAX_WIDTH and -(-n // width) > MAX_SIDE:
        width *= 2
    return width, -(-n // width)


def store_batch(payloads: list[bytes]) -> list[bytes]:
    """Each payload (a positive multiple of 64 bytes) as one or more JPEG frames."""
    frames: list[tuple[int, bytes, int, int]] = []
    room = MAX_WIDTH * MAX_SIDE
    for i, payload in enumerate(payloads):
        for at in range(0, len(payload), room):
            piece = payload[at : at + room]
            frames.append((i, piece, *frame_shape(len(piece))))
    out = [[] for _ in payloads]
    group: list[tuple[int, bytes, int, int]] = []
    held = 0
    for n, frame in enumerate(frames):
        group.append(frame)
        held += frame[2] * frame[3] // INTERVAL
        if held >= _CHUNK or n + 1 == len(frames):
            _store(group, out)
            group, held = [], 0
    return [b"".join(x) for x in out]


def _store(frames: list[tuple[int, bytes, int, int]], out: list[list[bytes]]) -> None:
    flat = np.frombuffer(b"".join(p + bytes(w * h - len(p)) for _, p, w, h in frames), np.uint8)
    levels = flat.reshape(-1, INTERVAL).astype(np.int16) - 128
    counts = np.array([w * h // INTERVAL for _, _, w, h in frames])
    ends = np.cumsum(counts)
    marks = 0xD0 + (np.arange(len(levels)) - np.repeat(ends - counts, counts)) % 8
    marks[ends - 1] = 0xD9
    made = [entropy_coded(levels[a : a + _CHUNK], marks[a : a + _CHUNK]) for a in range(0, len(levels), _CHUNK)]
    sizes = np.concatenate([m[1] for m in made])
    data = np.concatenate([m[0] for m in made]).tobytes()
    upto = np.concatenate([[0], np.cumsum(sizes)])
    for (i, piece, w, h), a, z in zip(frames, (ends - counts).tolist(), ends.tolist(), strict=True):
        out[i].append(_header(w, h, b"bytes=%d" % len(piece)) + data[upto[a] : upto[z]])


@dataclass
class Frame:
    """What the markers of one image say."""

    width: int = 0
    height: int = 0
    notes: list[bytes] = field(default_factory=list)
    quant: dict[int, list[int]] = field(default_factory=dict)
    huffman: dict[int, tuple[tuple[int, ...], tuple[int, ...]]] = field(default_factory=dict)
    components: dict[int, tuple[int, int, int]] = field(default_factory=dict)
    scan: list[tuple[int, int, int]] = field(default_factory=list)
    interval: int = 0
    data: np.ndarray | None = None
    edges: np.ndarray | None = None

    @property
    def luma(self) -> int:
        return next(iter(self.components))

    def blocks(self) -> tuple[int, int]:
        """Luminance blocks across and down, with the padding of whole MCUs."""
        hs, vs = max(c[0] for c in self.components.values()), max(c[1] for c in self.components.values())
        h, v, _ = self.components[self.luma]
        if len(self.components) == 1:
            return -(-self.width // 8), -(-self.height // 8)
        return -(-self.width // (8 * hs)) * h, -(-self.height // (8 * vs)) * v


def parse(media: bytes) -> list[Frame]:
    """All images of a stream, scans cut at restart markers with stuffing removed."""
    raw = np.frombuffer(media, np.uint8)
    ff = np.flatnonzero(raw[:-1] == 0xFF)
    after = raw[ff + 1]
    marker_at = ff[after != 0]
    frames, at = [], 0
    while at + 1 < len(media):
        if media[at : at + 2] != b"\xff\xd8":
            raise ValueError("no start of image")
        frame, at = Frame(), at + 2
        while True:
            if at + 4 > len(media) or media[at] != 0xFF:
                raise ValueError("marker expected")
            kind = media[at + 1]
            if kind == 0xFF:
                at += 1
                continue
            size = int.from_bytes(media[at + 2 : at + 4], "big")
            body, at = media[at + 4 : at + 2 + size], at + 2 + size
            if kind == 0xFE:
                frame.notes.append(body)
            elif kind == 0xDB:
                while body:
                    wide = body[0] >> 4
                    n = 128 if wide else 64
                    frame.quant[body[0] & 15] = list(np.frombuffer(body[1 : 1 + n], ">u2" if wide else "u1"))
                    body = body[1 + n :]
            elif kind == 0xC4:
                while body:
                    bits = tuple(body[1:17])
                    n = sum(bits)
                    frame.huffman[body[0]] = (bits, tuple(body[17 : 17 + n]))
                    body = body[17 + n :]
            elif kind == 0xC0:
                frame.height, frame.width = int.from_bytes(body[1:3], "big"), int.from_bytes(body[3:5], "big")
                frame.components = {body[6 + 3 * i]: (body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]) for i in range(body[5])}
            elif 0xC1 <= kind <= 0xCF and kind not in (0xC8, 0xCC):
                raise ValueError("only baseline is read")
            elif kind == 0xDD:
                frame.interval = int.from_bytes(body[:2], "big")
            elif kind == 0xDA:
                frame.scan = [(body[1 + 2 * i], body[2 + 2 * i] >> 4, 16 + (body[2 + 2 * i] & 15)) for i in range(body[0])]
                break
        # the scan goes on over stuffed bytes and restart markers
        first = np.searchsorted(marker_at, at)
        rest = marker_at[first:]
        kinds = raw[rest + 1]
        other = np.flatnonzero((kinds < 0xD0) | (kinds > 0xD7))
        if not len(other) or kinds[other[0]] != 0xD9:
            raise ValueError("no end of image behind the scan")
        stop = int(rest[other[0]])
        cuts = rest[: other[0]]
        if (raw[cuts + 1] != 0xD0 + np.arange(len(cuts)) % 8).any():
            raise ValueError("restart markers out of turn")
        keep = np.ones(stop - at, bool)
        inside = ff[(ff >= at) & (ff < stop)]
        stuffed = inside[raw[np.minimum(inside + 1, len(raw) - 1)] == 0] + 1
        keep[stuffed[stuffed < stop] - at] = False
        keep[cuts - at] = False
        keep[cuts - at + 1] = False
        place = np.concatenate([[0], np.cumsum(keep)])
        frame.data = raw[at:stop][keep]
        frame.edges = np.concatenate([[0], place[cuts - at], [place[-1]]])
        frames.append(frame)
        at = stop + 2
    if at != len(media):
        raise ValueError("spare bytes behind the image")
    return frames


def _decode_segments(
    data: np.ndarray, starts: np.ndarray, stops: np.ndarray, mcus: int, plan: list[tuple[int, tuple, tuple]]
) -> list[np.ndarray]:
    """DC differences of ``mcus`` MCUs of segments (byte ranges) in step; ``plan`` has (component, DC, AC table) per block."""
    padded = np.concatenate([data, np.zeros(16, np.uint8)])
    windows = np.lib.stride_tricks.as_strided(padded, (len(padded) - 7, 8), (1, 1))
    bit = starts.astype(np.int64) * 8
    out = [np.zeros((len(starts), mcus), np.int32) for _ in plan]
    limit = (len(padded) - 8) * 8

    def window() -> np.ndarray:
        w = windows[np.minimum(bit, limit) >> 3].view(">u8")[:, 0].astype(np.uint64)
        return w << (bit & 7).astype(np.uint64)

    for m in range(mcus):
        for block, (_, dc, ac) in enumerate(plan):
            w = window()
            top = (w >> np.uint64(48)).astype(np.int64)
            size, used = dc[0][top].astype(np.uint64), dc[1][top].astype(np.uint64)
            if not used.all() or size.max(initial=0) > 11:
                raise ValueError("no such code")
            w <<= used
            # the size's own bits; a leading 0 means a negative value
            value = ((w >> np.uint64(1)) >> (np.uint64(63) - size)).astype(np.int64)
            low = (np.int64(1) << size.astype(np.int64)) >> 1
            out[block][:, m] = np.where(value < low, value - 2 * low + 1, value)
            w <<= size
            used += size
            top = (w >> np.uint64(48)).astype(np.int64)
            symbol, n = ac[0][top], ac[1][top]
            if not n.all():
                raise ValueError("no such code")
            bit += (used + n + (symbol & 15)).astype(np.int64)
            place = np.where(symbol == 0, 64, 1 + (symbol >> 4).astype(np.int64) + 1)
            open_ = np.flatnonzero(place < 64)
            while len(open_):
                w = windows[np.minimum(bit[open_], limit) >> 3].view(">u8")[:, 0].astype(np.uint64) << (bit[open_] & 7).astype(np.uint64)
                top = (w >> np.uint64(48)).astype(np.int64)
                symbol, n = ac[0][top], ac[1][top]
                if not n.all():
                    raise ValueError("no such code")
                bit[open_] += (n + (symbol & 15)).astype(np.int64)
                place[open_] = np.where(symbol == 0, 64, place[open_] + (symbol >> 4) + 1)
                open_ = open_[place[open_] < 64]
    # what is left of a segment is less than a byte
    if (bit > stops * 8).any() or (bit + 8 <= stops * 8).any():
        raise ValueError("a scan of another length")
    return out


_TABLES: dict = {}


def _table(spec: tuple) -> tuple[np.ndarray, np.ndarray]:
    if spec not in _TABLES:
        if len(_TABLES) > 64:
            _TABLES.clear()
        _TABLES[spec] = lookup(*spec)
    return _TABLES[spec]


def thumbnails(frames: list[Frame]) -> list[np.ndarray]:
    """Mean luminance (0 to 255) of every 8x8 block of each image, decoded in step where tables agree."""
    jobs: dict[tuple, list[tuple[int, int, int, int]]] = {}
    values: list[np.ndarray] = []
    for i, f in enumerate(frames):
        if not f.scan or any(c not in f.components for c, _, _ in f.scan) or len(f.scan) != len(f.components):
            raise ValueError("one scan with all components is read")
        across, down = f.blocks()
        h, v, _ = f.components[f.luma]
        single = len(f.components) == 1
        per_mcu = 1 if single else h * v
        total = across * down // per_mcu
        plan = []
        for c, dc, ac in f.scan:
            n = 1 if single else f.components[c][0] * f.components[c][1]
            plan += [(c, f.huffman[dc], f.huffman[ac])] * n
        step = f.interval or total
        if len(f.edges) - 1 != -(-total // step):
            raise ValueError("a scan of another length")
        values.append(np.zeros((total, per_mcu), np.int32))
        for s, low in enumerate(range(0, total, step)):
            jobs.setdefault((min(step, total - low), tuple(plan), f.luma), []).append((i, s, low, step))
    for (mcus, plan, luma), rows in jobs.items():
        tables = [(c, _table(dc), _table(ac)) for c, dc, ac in plan]
        for at in range(0, len(rows), _CHUNK):
            part = rows[at : at + _CHUNK]
            used = sorted({i for i, *_ in part})
            # only the bytes of these segments
            spans: dict[int, list[int]] = {}
            for j, s, *_ in part:
                spans.setdefault(j, []).append(s)
            pieces, offset, starts = [], 0, {}
            for i in used:
                f, a, z = frames[i], int(frames[i].edges[min(spans[i])]), int(frames[i].edges[max(spans[i]) + 1])
                pieces.append(f.data[a:z])
                starts[i] = offset - a
                offset += z - a
            data = np.concatenate(pieces)
            begin, end = (np.array([starts[i] + int(frames[i].edges[s + k]) for i, s, *_ in part], np.int64) for k in (0, 1))
            diffs = _decode_segments(data, begin, end, mcus, tables)
            mine = [d for d, (c, _, _) in zip(diffs, tables, strict=True) if c == luma]
            # a component's blocks follow each other within and across MCUs
            levels = np.cumsum(np.stack(mine, axis=2).reshape(len(part), -1), axis=1).reshape(len(part), mcus, len(mine))
            for r, (i, _, low, _) in enumerate(part):
                values[i][low : low + mcus] = levels[r]
    out = []
    for f, level in zip(frames, values, strict=True):
        across, down = f.blocks()
        h, v, q = f.components[f.luma]
        if len(f.components) > 1 and h * v > 1:
            level = level.reshape(down // v, across // h, v, h).transpose(0, 2, 1, 3)
        grid = level.reshape(down, across) * int(f.quant[q][0])
        out.append(np.clip(np.floor_divide(grid + 4, 8) + 128, 0, 255).astype(np.uint8))
    return out


def difference_hash(thumb: np.ndarray) -> str:
    """64-bit difference hash of a thumbnail, as 16 hex digits."""
    rows = np.linspace(0, thumb.shape[0], 9).astype(np.int64)
    columns = np.linspace(0, thumb.shape[1], 10).astype(np.int64)
    top, bottom = rows[:-1], np.maximum(rows[1:], np.minimum(rows[:-1] + 1, thumb.shape[0]))
    left, right = columns[:-1], np.maximum(columns[1:], np.minimum(columns[:-1] + 1, thumb.shape[1]))
    bands = np.stack([thumb[a:z].sum(axis=0, dtype=np.int64) for a, z in zip(top, bottom, strict=True)])
    sums = np.concatenate([np.zeros((len(bands), 1), np.int64), bands.cumsum(axis=1)], axis=1)
    total = sums[:, right] - sums[:, left]
    mean = total / np.maximum((bottom - top)[:, None] * (right - left)[None, :], 1)
    return np.packbits(mean[:, 1:] > mean[:, :-1]).tobytes().hex()


def whole_thumbnail(thumbs: list[np.ndarray]) -> np.ndarray:
    """The blocks of all frames of a stream, in rows as wide as the first frame's; a last row is filled with 0."""
    if len(thumbs) == 1:
        return thumbs[0]
    flat = np.concatenate([t.reshape(-1) for t in thumbs])
    width = thumbs[0].shape[1]
    return np.concatenate([flat, np.zeros(-len(flat) % width, np.uint8)]).reshape(-1, width)


def payload_of(data: bytes) -> bytes:
    """UTF-8 bytes with zeros up to a positive multiple of 64."""
    return data + bytes(-len(data) % 64 or (0 if data else 64))


def read_batch(media: list[bytes]) -> list[tuple[bytes, list[np.ndarray]]]:
    """Payload bytes and thumbnails of each stored stream."""
    parsed = [parse(m) for m in media]
    thumbs = iter(thumbnails([f for frames in parsed for f in frames]))
    out = []
    for frames in parsed:
        own = [next(thumbs) for _ in frames]
        sizes = [int(next(n for n in f.notes if n.startswith(b"bytes="))[6:]) for f in frames]
        out.append((b"".join(t.reshape(-1)[:n].tobytes() for t, n in zip(own, sizes, strict=True)), own))
    return out


def media_columns(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per record: id, the stored JPEG, and what a decode of the stored bytes gives."""

    def run(texts: list[str]) -> dict[str, list]:
        raw = [t.encode() for t in texts]
        media = store_batch([payload_of(x) for x in raw])
        back = read_batch(media)
        whole = [whole_thumbnail(thumbs) for _, thumbs in back]
        return {
            "n_bytes": [len(x) for x in raw],
            "payload_bytes": [len(p) for p, _ in back],
            "payload_sha256": [hashlib.sha256(p).hexdigest() for p, _ in back],
            "tail_crc32": [zlib.crc32(p[-64:]) for p, _ in back],
            "media_bytes": [len(m) for m in media],
            "media_sha256": [hashlib.sha256(m).hexdigest() for m in media],
            "width": [8 * t.shape[1] for t in whole],
            "height": [8 * t.shape[0] for t in whole],
            "feature": [f"{8 * t.shape[1]}x{8 * t.shape[0]}:{difference_hash(t)}" for t in whole],
            "media": media,
        }

    schema = (
        "n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, "
        "media_sha256 string, width int, height int, feature string, media binary"
    )
    return per_document(df, id_col, text_col, schema, run, budget=2 << 20)
