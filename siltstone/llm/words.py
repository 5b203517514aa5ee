"""Words of a text, block by block."""

from __future__ import annotations

from collections.abc import Iterator

_WORD = b"0123456789abcdefghijklmnopqrstuvwxyz" + bytes(range(128, 256))
#: Lower-cases A-Z and turns every byte outside words into a blank.
_FOLD = bytes(c if c in _WORD else (c + 32 if 65 <= c <= 90 else 32) for c in range(256))


def word_blocks(text: str | None, size: int = 1 << 20) -> Iterator[list[bytes]]:
    """Runs of digits, letters a-z and all beyond ASCII, as UTF-8, in lists from about ``size`` bytes of text each."""
    data = (text or "").encode("utf-8", "surrogatepass").translate(_FOLD)
    start = 0
    while start < len(data):
        end = data.find(b" ", start + size)
        end = len(data) if end < 0 else end
        yield data[start:end].split()
        start = end
