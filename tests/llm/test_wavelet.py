import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from siltstone.llm import wavelet

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.mark.parametrize("n", [0, 1, 63, 64, 511, 512, 513, 3000])
def test_access_rank_select(n):
    rng = np.random.default_rng(n)
    symbols = rng.integers(0, 9, n).astype(np.uint16) * 7
    ids, lengths = np.array([5]), np.array([n])
    shard = wavelet.Shard.from_bytes(wavelet.Shard(ids, lengths, wavelet.WaveletMatrix.build(symbols, 6)).to_bytes())
    m = shard.matrix
    assert (m.decode() == symbols).all() and (m.access(np.arange(n)) == symbols).all()
    for s in (0, 7, 8, 56, 63, 200):
        at = np.flatnonzero(symbols == s)
        assert m.positions(s).tolist() == at.tolist() and m.count(s) == len(at)
        for i in {0, n // 2, n}:
            assert m.rank(s, i) == int((symbols[:i] == s).sum())
        if len(at):
            assert m.select(s, len(at) - 1) == at[-1]
        with pytest.raises(IndexError):
            m.select(s, len(at))


def test_query_rows(spark):
    rows = [(n, f"Text {n}! " * (n % 7) + "it's ü") for n in range(60, 0, -1)] + [(None, "x"), (7, None), (0, ""), (99, "<|endoftext|> END")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5).selectExpr("*", "1 AS tie", "2 AS part")
    path = wavelet.write_shards(df, PATH, shard_tokens=40)
    got = sorted(wavelet.read_documents(spark, path).collect(), key=lambda r: r.start)
    library = Tokenizer.from_file(PATH)
    texts = {}
    for d, t in rows:
        texts.setdefault(d, []).append(t or "")
    start = 0
    for r in got:
        choices = [[*library.encode(t, add_special_tokens=False).ids, 1] for t in texts[r.doc_id]]
        ids = next(x for x in choices if zlib.crc32(np.array(x, "<u4").tobytes()) == r.ids_crc32)
        assert (r.start, r.n_tokens) == (start, len(ids))
        start += len(ids)
    order = [r.doc_id for r in got]
    assert order[0] is None and order[1:] == sorted(order[1:]) and len(got) == len(rows)
    token = library.encode("text", add_special_tokens=False).ids[0]
    assert wavelet.find_token(spark, path, token).count() == sum(n % 7 for n in range(1, 61))
    empty = wavelet.write_shards(df.limit(0), PATH)
    assert wavelet.read_documents(spark, empty).count() == 0


def test_one_file_a_shard_readable_alone(spark, tmp_path):
    rows = [(n, f"word{n} some text " * 5) for n in range(50)] + [(100, "very long " * 200_000), (101, "end")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS start", "2 AS data")
    path = wavelet.write_shards(df, PATH, shard_tokens=100)
    files = spark.read.parquet(path).inputFiles()
    assert len(files) == spark.read.parquet(path).count() > 5
    library, seen = Tokenizer.from_file(PATH), 0
    texts = dict(rows)
    for f in files:
        alone = spark.read.parquet(f).collect()
        assert len(alone) == 1
        shard = wavelet.Shard.from_bytes(bytes(alone[0].data))
        for k, d in enumerate(shard.doc_ids.tolist()):
            ids = [*library.encode(texts[d], add_special_tokens=False).ids, 1]
            assert shard.document(k).tolist() == ids
            seen += 1
        ends = np.cumsum(shard.lengths)
        flat = shard.matrix.decode()
        for symbol in {1, int(flat[0]), 70_000}:
            assert shard.matrix.ranks(symbol, ends).tolist() == [int((flat[:e] == symbol).sum()) for e in ends]
    assert seen == len(rows)
    assert all(r.n_end_ids == 1 for r in wavelet.read_documents(spark, path).collect())
