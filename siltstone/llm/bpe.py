"""Byte-level BPE encoding and decoding in batched numpy merge rounds.

A text is cut at special tokens and by the vocabulary's word pattern.  Words
not met before are encoded together: their symbols lie in one flat array, each
round looks all neighbouring pairs up by binary search over sorted pair keys,
and every word merges its pair of lowest rank.  Words are remembered within a bound.
Words of more than ``LONG`` bytes, whose rounds would cost the square of their
length, merge through a priority queue instead.

Decoding gathers the tokens' bytes from one flat table and reads them as
UTF-8, malformed bytes replaced.

Defined results: a null or empty text has no ids and decodes to ""; very long texts and words are encoded whole;
of equal ranks the leftmost pair merges first; repeated rows give equal rows; an empty table gives an empty
result; other columns are not read, whatever their names.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import os
import re
import unicodedata
from itertools import chain, islice

import numpy as np
import regex
from pyspark.sql import DataFrame

from siltstone.llm.common import hold, per_document

LONG = 4096
_FAST_BELOW = 0x250


def byte_letters() -> dict[str, int]:
    """The printable letter that stands for each byte in byte-level vocabularies, to its byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}


def latin_class(pattern: str) -> str:
    """The characters below U+0250 of a regex class, as a class body for ``re``."""
    return "".join(re.escape(chr(c)) for c in range(_FAST_BELOW) if regex.fullmatch(pattern, chr(c)))


class Merger:
    """Pair merges of a vocabulary; words are sequences of first symbols (ints)."""

    def __init__(self, pairs: list[tuple[int, int, int]], n_symbols: int) -> None:
        """``pairs`` are (left, right, merged) by rising rank."""
        self.base = n_symbols
        keys = np.array([a * n_symbols + b for a, b, _ in pairs], np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.rank = keys[order], order.astype(np.int64)
        self.merged = np.array([m for _, _, m in pairs], np.int64)
        self.none = np.int64(len(pairs))
        self.by_pair = None
        self.pairs = pairs

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left * self.base + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.rank[at], self.none)

    def __call__(self, symbols: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Merge words that lie one after another in ``symbols``; the same layout returns."""
        word = np.repeat(np.arange(len(sizes)), sizes)
        ready: list[tuple[np.ndarray, np.ndarray]] = [(word[:0], symbols[:0])]
        if len(long := np.flatnonzero(sizes > LONG)):
            ends = np.cumsum(sizes)
            for w in long.tolist():
                merged = self.queued(symbols[ends[w] - sizes[w] : ends[w]].tolist())
                ready.append((np.full(len(merged), w), merged))
            short = ~np.isin(word, long)
            symbols, word = symbols[short], word[short]
        rank = np.full(len(symbols), self.none)
        at = np.flatnonzero(word[1:] == word[:-1])
        rank[at] = self.ranks(symbols[at], symbols[at + 1])
        while len(symbols):
            starts = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
            counts = np.diff(np.concatenate([starts, [len(symbols)]]))
            low = np.repeat(np.minimum.reduceat(rank, starts), counts)
            going = low < self.none
            ready.append((word[~going], symbols[~going]))
            word, symbols, rank, low = word[going], symbols[going], rank[going], low[going]
            merge = rank == low
            # in a run of overlapping pairs every other one merges, from the left
            first = merge & ~np.concatenate([[False], merge[:-1]])
            at = np.arange(len(merge))
            merge &= (at - np.maximum.accumulate(np.where(first, at, 0))) % 2 == 0
            at = np.flatnonzero(merge)
            symbols[at] = self.merged[rank[at]]
            keep = np.ones(len(merge), bool)
            keep[at + 1] = False
            symbols, word, rank, merge = symbols[keep], word[keep], rank[keep], merge[keep]
            # only the pairs on either side of a merged symbol are looked up again
            stale = merge.copy()
            stale[:-1] |= merge[1:]
            rank[stale] = self.none
            at = np.flatnonzero(stale[:-1] & (word[1:] == word[:-1]))
            rank[at] = self.ranks(symbols[at], symbols[at + 1])
        word, symbols = (np.concatenate(x) for x in zip(*ready, strict=True))
        order = np.argsort(word, kind="stable")
        return symbols[order], np.bincount(word, minlength=len(sizes))

    def queued(self, word: list[int]) -> np.ndarray:
        """The same merges for one long word, through a queue of (rank, position)."""
        if self.by_pair is None:
            self.by_pair = {(a, b): (r, m) for r, (a, b, m) in reversed(list(enumerate(self.pairs)))}
        known, sym, n = self.by_pair, list(word), len(word)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        queue = [(known[p][0], i) for i, p in enumerate(zip(sym, sym[1:], strict=False)) if p in known]
        heapq.heapify(queue)
        while queue:
            rank, i = heapq.heappop(queue)
            j = after[i]
            if sym[i] < 0 or j >= n or (found := known.get((sym[i], sym[j]))) is None or found[0] != rank:
                continue
            sym[i], sym[j], after[i] = found[1], -1, after[j]
            if after[j] < n:
                before[after[j]] = i
                if p := known.get((sym[i], sym[after[j]])):
                    heapq.heappush(queue, (p[0], i))
            if before[i] >= 0 and (p := known.get((sym[before[i]], sym[i]))):
                heapq.heappush(queue, (p[0], before[i]))
        return np.array([s for s in sym if s >= 0], np.int64)


class ByteBPE:
    """A byte-level BPE vocabulary read from a tokenizer file's JSON text."""

    #: Words that are remembered at most, about 200 bytes each in every worker, and all their characters.
    remembered, characters = 400_000, 16 << 20

    def __init__(self, text: str) -> None:
        spec = json.loads(text)
        vocab: dict[str, int] = spec["model"]["vocab"]
        self.specials = {t["content"]: t["id"] for t in spec["added_tokens"]}
        letters = byte_letters()
        split = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in spec["model"]["merges"]]
        self.suffix = spec["model"].get("end_of_word_suffix") or ""
        self.first = np.array([vocab[c] for c, _ in sorted(letters.items(), key=lambda x: x[1])], np.int64)
        self.last = np.array([vocab.get(c + self.suffix, -1) for c, _ in sorted(letters.items(), key=lambda x: x[1])])
        self.merger = Merger([(vocab[a], vocab[b], vocab[a + b]) for a, b in split], max(vocab.values()) + 1)
        size = max([*vocab.values(), *self.specials.values()]) + 1
        pieces = [b""] * size
        for token, i in vocab.items():
            pieces[i] = bytes(letters[c] for c in token.removesuffix(self.suffix)) if all(c in letters for c in token) else token.encode()
        for token, i in self.specials.items():
            pieces[i] = token.encode()
        self.flat = np.frombuffer(b"".join(pieces), np.uint8)
        self.ends = np.cumsum([len(p) for p in pieces])
        self.sizes = np.array([len(p) for p in pieces], np.int64)
        self.marks = {(t,): i.to_bytes(4, "little") for t, i in self.specials.items()}
        self.known: dict = dict(self.marks)
        self.weight = 0
        low = {k: latin_class(p) for k, p in (("L", r"\p{L}"), ("N", r"\p{N}"), ("S", r"\s"))}
        plain, full = self.patterns(low)
        self.fast, self.general = re.compile(plain).findall, regex.compile(full).findall
        self.exotic = re.compile(f"[^\x00-{chr(_FAST_BELOW - 1)}]").search
        self.cut = re.compile("(" + "|".join(map(re.escape, self.specials)) + ")").split if self.specials else None
        #: What every special begins with; a text without it has none.
        self.lead = os.path.commonprefix(list(self.specials))

    @staticmethod
    def patterns(low: dict[str, str]) -> tuple[str, str]:
        letters, numbers, space = low["L"], low["N"], low["S"]
        # the alternatives start with different characters but for the last three, so the common one comes first
        return (
            f" ?[{letters}]+|'(?:[sdmt]|ll|ve|re)| ?[{numbers}]+| ?[^{space}{letters}{numbers}]+|[{space}]+(?![^{space}])|[{space}]+",
            r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+",
        )

    def prepared(self, text: str) -> str:
        return text

    def pieces(self, text: str) -> list[str]:
        text = self.prepared(text)
        return (self.general if self.exotic(text) else self.fast)(text)

    def learn(self, words: list[str]) -> None:
        """Encode words, all at once, and remember them."""
        raw = [w.encode("utf-8", "surrogatepass") for w in words]
        flat = np.frombuffer(b"".join(raw), np.uint8)
        sizes = np.fromiter(map(len, raw), np.int64, len(raw))
        symbols = self.first[flat]
        if self.suffix:
            ends = np.cumsum(sizes) - 1
            symbols[ends] = self.last[flat[ends]]
        ids, counts = self.merger(symbols, sizes)
        packed, ends = ids.astype("<u4").tobytes(), (np.cumsum(counts) * 4).tolist()
        self.known.update(zip(words, (packed[a:b] for a, b in zip([0, *ends], ends, strict=False)), strict=True))

    def encode_batch(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers.

        Memory is bounded by the remembered words plus ``texts``.
        """
        plans: list[list] = []
        for text in texts:
            parts = self.cut(text) if self.cut and self.lead in text else [text]
            plan = self.pieces(parts[0])
            for special, plain in zip(parts[1::2], parts[2::2], strict=True):
                plan = [*plan, (special,), *self.pieces(plain)]
            plans.append(plan)
        # new words are found once among the distinct ones, so every word of a text is looked up once
        words = set(chain.from_iterable(plans))
        new = words.difference(self.known)
        if new:
            self.weight += sum(map(len, new))
            if len(self.known) + len(new) > self.remembered or self.weight > self.characters:
                # common words come early, so the oldest short ones stay
                kept = islice(((w, i) for w, i in self.known.items() if len(w) <= 64), self.remembered // 4)
                self.known = self.marks | dict(kept)
                new = words.difference(self.known)
                self.weight = sum(map(len, self.known)) + sum(map(len, new))
            self.learn(list(new))
        ids = self.known.__getitem__
        return [b"".join(map(ids, plan)) for plan in plans]

    def decode(self, ids: bytes) -> str:
        tokens = np.frombuffer(ids, "<u4").astype(np.int64)
        sizes = self.sizes[tokens]
        upto = np.cumsum(sizes)
        total = int(upto[-1]) if len(upto) else 0
        at = np.arange(total) + np.repeat(self.ends[tokens] - upto, sizes)
        return self.flat[at].tobytes().decode("utf-8", "replace")


class WordBPE(ByteBPE):
    """Lower-casing BPE with word ends, white space dropped."""

    remembered = 800_000

    def prepared(self, text: str) -> str:
        if not text.isascii():
            text = unicodedata.normalize("NFC", text)
            # one character at a time: no special final sigma
            text = text.replace("Σ", "σ")
        return text.lower()

    @staticmethod
    def patterns(low: dict[str, str]) -> tuple[str, str]:
        letters, numbers, space = low["L"], low["N"], low["S"]
        return (
            f"[{letters}]+|'s|'t|'re|'ve|'m|'ll|'d|[{numbers}]|[^{space}{letters}{numbers}]+",
            r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+",
        )


_VOCABS: dict[tuple[type, str], ByteBPE] = {}


def vocabulary(kind: type[ByteBPE], text: str) -> ByteBPE:
    """The worker's copy of a vocabulary; its text identifies it."""
    hold("bpe", _VOCABS.clear)
    key = (kind, hashlib.sha256(text.encode()).hexdigest())
    if key not in _VOCABS:
        _VOCABS[key] = kind(text)
    return _VOCABS[key]


def tokenize(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per record: id, n_tokens, ids (binary), ids_sha256, decoded, decoded_sha256.

    ``path`` is the vocabulary file; its few megabytes are read on the driver and broadcast.
    """
    with open(path, encoding="utf-8") as file:
        sent = df.sparkSession.sparkContext.broadcast(file.read())

    def run(texts: list[str]) -> dict[str, list]:
        bpe = vocabulary(ByteBPE, sent.value)
        ids = bpe.encode_batch(texts)
        decoded = [bpe.decode(x) for x in ids]
        return {
            "n_tokens": [len(x) // 4 for x in ids],
            "ids": ids,
            "ids_sha256": [hashlib.sha256(x).hexdigest() for x in ids],
            "decoded": decoded,
            "decoded_sha256": [hashlib.sha256(x.encode()).hexdigest() for x in decoded],
        }

    schema = "n_tokens long, ids binary, ids_sha256 string, decoded string, decoded_sha256 string"
    return per_document(df, id_col, text_col, schema, run)
