import hashlib

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from siltstone.llm import bpe

BYTE, WORD = (public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "word_bpe_49k.json"))
TEXTS = [
    "", "  a  b", "don't we'll 'S x's", "<|endoftext|>a <|endoftext|>", "ΣΑΣ İstanbul ǅ Ⅷ ½ ²", "ẹ́ 한국어 日本語 🎉",
    "\x1c\x1d x \x85y 　", "aaaa" * 40, "x" * 5000, "ab" * 3000 + "!!!" * 2000, "'''s't <|startoftext|> hi<|endof",
    "1234567 12a", "\x00\x01", "tab\tnew\r\n\nline  ", "ÀÉ über naïve Straße",
]


@pytest.mark.parametrize(("kind", "path"), [(bpe.ByteBPE, BYTE), (bpe.WordBPE, WORD)])
def test_matches_the_library(kind, path):
    vocab, library = kind(open(path, encoding="utf-8").read()), Tokenizer.from_file(path)
    want = [library.encode(t, add_special_tokens=False).ids for t in TEXTS]
    got = vocab.encode_batch(TEXTS)
    assert [[int.from_bytes(x[i : i + 4], "little") for i in range(0, len(x), 4)] for x in got] == want
    if kind is bpe.ByteBPE:
        assert [vocab.decode(x) for x in got] == [library.decode(w, skip_special_tokens=False) for w in want]
        assert [vocab.decode(x) for x in got] == TEXTS


def test_words_stay_right_when_the_memory_is_cleared(monkeypatch):
    monkeypatch.setattr(bpe.ByteBPE, "remembered", 5)
    vocab = bpe.ByteBPE(open(BYTE, encoding="utf-8").read())
    first = vocab.encode_batch(TEXTS)
    assert vocab.encode_batch(TEXTS[::-1])[::-1] == first


def test_query_rows(spark):
    rows = [(1, None), (2, ""), (3, "Hello world"), (3, "Hello world")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS ids", "'x' AS decoded")
    out = bpe.tokenize(df, BYTE).collect()
    assert [(r.doc_id, r.n_tokens, r.decoded) for r in out] == [(1, 0, ""), (2, 0, ""), (3, 2, "Hello world"), (3, 2, "Hello world")]
    ids = Tokenizer.from_file(BYTE).encode("Hello world").ids
    assert out[3].ids_sha256 == hashlib.sha256(b"".join(i.to_bytes(4, "little") for i in ids)).hexdigest()
    assert bpe.tokenize(df.limit(0), BYTE).count() == 0


def test_remembered_characters_are_bounded(monkeypatch):
    monkeypatch.setattr(bpe.ByteBPE, "characters", 5000)
    vocab = bpe.ByteBPE(open(BYTE, encoding="utf-8").read())
    library = Tokenizer.from_file(BYTE)
    for n in range(30):
        text = f"{'q' * (900 + n)} {'z' * 70}{n} short {n} <|endoftext|>"
        ids = library.encode(text, add_special_tokens=False).ids
        assert vocab.encode_batch([text]) == [b"".join(i.to_bytes(4, "little") for i in ids)]
        assert sum(map(len, vocab.known)) < 7000


def test_very_long_text_and_clashing_columns(spark):
    text = "Größe 12,5 km – and so on!\n" * 120_000
    df = spark.createDataFrame([(1, text)], "doc_id long, text string").selectExpr("*", "1 AS n_tokens", "2 AS ids_sha256", "3 AS id")
    row = bpe.tokenize(df, BYTE).first()
    assert row.decoded == text and row.n_tokens == len(Tokenizer.from_file(BYTE).encode(text, add_special_tokens=False).ids)
