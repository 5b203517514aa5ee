"""Token ids as one wavelet matrix per shard, in a compressed file of its own.

A wavelet matrix stores a sequence of b-bit symbols as b bit planes, highest bit first;
each plane is followed by a stable partition of the sequence by that
bit.  With counts of ones per 512 bits, reading a token, counting a symbol in a
prefix and finding its k-th occurrence take b rank or select steps.

A shard holds whole documents in ascending id order, so a token id may occur as
text and as end mark alike; document borders are kept beside the planes.

Each shard is one file: a Parquet file with one row, whose binary value is the shard and can be read without
any other file.  Its layout (with a zstandard frame around it): magic, header length, JSON header with
symbol bits, length, documents and zeros per plane; document ids (int64) and
lengths (int64); per plane its bits (64-bit words, lowest bit first) and its
counts (uint32).

Defined results: a null or empty text is a document with its end mark alone; a very long text is one document of
one shard, which may exceed ``shard_tokens`` by it; ids are integers, a null id comes first;
rows with equal ids follow each other in any order; an empty table writes no shard; other columns are
not read, whatever their names.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siltstone.llm.bpe import WordBPE, vocabulary
from siltstone.llm.common import shared_path, slices

MAGIC = b"WVMX0001"
SUPER = 8  # words per count


class WaveletMatrix:
    """Succinct sequence of unsigned integers with access, rank and select."""

    def __init__(self, n: int, planes: list[np.ndarray], zeros: list[int], counts: list[np.ndarray] | None = None) -> None:
        self.n, self.planes, self.zeros = n, planes, zeros
        self.counts = counts or [self._counts(p) for p in planes]

    @staticmethod
    def _counts(plane: np.ndarray) -> np.ndarray:
        ones = np.bitwise_count(plane[: len(plane) // SUPER * SUPER].reshape(-1, SUPER)).sum(axis=1)
        return np.concatenate([[0], np.cumsum(ones)]).astype("<u4")

    @classmethod
    def build(cls, symbols: np.ndarray, bits: int) -> WaveletMatrix:
        symbols, planes, zeros = np.asarray(symbols), [], []
        for level in range(bits - 1, -1, -1):
            one = (symbols >> symbols.dtype.type(level) & symbols.dtype.type(1)).astype(bool)
            packed = np.packbits(one, bitorder="little")
            words = np.zeros((len(symbols) // (64 * SUPER) + 1) * SUPER * 8, np.uint8)
            words[: len(packed)] = packed
            planes.append(words.view("<u8"))
            low = symbols[~one]
            zeros.append(len(low))
            symbols = np.concatenate([low, symbols[one]])
        return cls(len(symbols), planes, zeros)

    def ones(self, level: int, i: np.ndarray) -> np.ndarray:
        """Ones before position ``i`` of a plane."""
        i = np.asarray(i, np.int64)
        word, plane = i >> 6, self.planes[level]
        out = self.counts[level][word // SUPER].astype(np.int64)
        for k in range(SUPER - 1):
            at = word // SUPER * SUPER + k
            out += np.where(at < word, np.bitwise_count(plane[np.minimum(at, len(plane) - 1)]), 0)
        rest = plane[np.minimum(word, len(plane) - 1)] & ((np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1))
        return out + np.bitwise_count(rest)

    def access(self, i: np.ndarray) -> np.ndarray:
        """Symbols at positions."""
        i = np.asarray(i, np.int64)
        out = np.zeros(i.shape, np.int64)
        for level, plane in enumerate(self.planes):
            bit = (plane[i >> 6] >> (i & 63).astype(np.uint64) & np.uint64(1)).astype(np.int64)
            ones = self.ones(level, i)
            i = np.where(bit == 1, self.zeros[level] + ones, i - ones)
            out = out << 1 | bit
        return out

    def rank(self, symbol: int, i: int) -> int:
        """Occurrences of ``symbol`` before position ``i``."""
        start, end = self._range(symbol, i)
        return end - start

    def count(self, symbol: int) -> int:
        return self.rank(symbol, self.n)

    def ranks(self, symbol: int, i: np.ndarray) -> np.ndarray:
        """Occurrences of ``symbol`` before each position."""
        end, start = np.asarray(i, np.int64), 0
        if symbol >> len(self.planes):
            return np.zeros(end.shape, np.int64)
        for level in range(len(self.planes)):
            ones, first = self.ones(level, end), int(self.ones(level, np.array([start]))[0])
            if symbol >> len(self.planes) - 1 - level & 1:
                start, end = self.zeros[level] + first, self.zeros[level] + ones
            else:
                start, end = start - first, end - ones
        return end - start

    def _range(self, symbol: int, i: int) -> tuple[int, int]:
        start, end = 0, i
        if symbol >> len(self.planes):
            return 0, 0
        for level in range(len(self.planes)):
            a, z = self.ones(level, np.array([start, end])).tolist()
            if symbol >> len(self.planes) - 1 - level & 1:
                start, end = self.zeros[level] + a, self.zeros[level] + z
            else:
                start, end = start - a, end - z
        return start, end

    def positions(self, symbol: int) -> np.ndarray:
        """All positions of ``symbol``, ascending."""
        start, end = self._range(symbol, self.n)
        return self._lifted(symbol, np.arange(start, end))

    def select(self, symbol: int, k: int) -> int:
        """Position of occurrence ``k`` (from 0) of ``symbol``."""
        start, end = self._range(symbol, self.n)
        if not 0 <= k < end - start:
            raise IndexError(k)
        return int(self._lifted(symbol, np.array([start + k]))[0])

    def _lifted(self, symbol: int, i: np.ndarray) -> np.ndarray:
        for level in range(len(self.planes) - 1, -1, -1):
            bit = symbol >> len(self.planes) - 1 - level & 1
            rank = i - self.zeros[level] if bit else i
            # binary search for the position whose rank it is
            low, high = np.zeros(len(i), np.int64), np.full(len(i), self.n)
            while (open_ := low < high).any():
                middle = (low + high) >> 1
                ones = self.ones(level, middle + 1)
                enough = (ones if bit else middle + 1 - ones) > rank
                high, low = np.where(open_ & enough, middle, high), np.where(open_ & ~enough, middle + 1, low)
            i = low
        return i

    def decode(self) -> np.ndarray:
        """The whole sequence: undo the partitions from the lowest plane up."""
        out = np.zeros(self.n, np.uint16 if len(self.planes) <= 16 else np.uint32)
        for level in range(len(self.planes) - 1, -1, -1):
            one = np.unpackbits(self.planes[level].view(np.uint8), bitorder="little", count=self.n).view(bool)
            before = np.empty_like(out)
            before[~one] = out[: self.zeros[level]]
            before[one] = out[self.zeros[level] :] | out.dtype.type(1 << len(self.planes) - 1 - level)
            out = before
        return out


class Shard:
    """Documents of token ids around one wavelet matrix."""

    def __init__(self, doc_ids: np.ndarray, lengths: np.ndarray, matrix: WaveletMatrix) -> None:
        self.doc_ids, self.lengths, self.matrix = doc_ids, lengths, matrix

    def document(self, k: int) -> np.ndarray:
        """Tokens of the ``k``-th document, read one by one from the planes."""
        start = int(self.lengths[:k].sum())
        return self.matrix.access(np.arange(start, start + int(self.lengths[k])))

    def to_bytes(self) -> bytes:
        m = self.matrix
        header = json.dumps({"bits": len(m.planes), "n": m.n, "docs": len(self.lengths), "zeros": m.zeros}).encode()
        parts = [MAGIC, len(header).to_bytes(4, "little"), header, self.doc_ids.astype("<i8").tobytes(), self.lengths.astype("<i8").tobytes()]
        for plane, counts in zip(m.planes, m.counts, strict=True):
            parts += [plane.tobytes(), counts.tobytes()]
        return zstandard.ZstdCompressor(level=1).compress(b"".join(parts))

    @classmethod
    def from_bytes(cls, data: bytes) -> Shard:
        raw = zstandard.ZstdDecompressor().decompress(data)
        if raw[:8] != MAGIC:
            raise ValueError("not a wavelet shard")
        at = 12 + int.from_bytes(raw[8:12], "little")
        header = json.loads(raw[12:at])

        def take(kind: str, n: int) -> np.ndarray:
            nonlocal at
            out = np.frombuffer(raw, kind, n, at)
            at += out.nbytes
            return out

        ids, lengths = take("<i8", header["docs"]), take("<i8", header["docs"])
        words = (header["n"] // (64 * SUPER) + 1) * SUPER
        planes, counts = [], []
        for _ in range(header["bits"]):
            planes.append(take("<u8", words))
            counts.append(take("<u4", words // SUPER + 1))
        return cls(ids, lengths, WaveletMatrix(header["n"], planes, header["zeros"], counts))


NULL_ID = -(1 << 63)


def write_shards(
    df: DataFrame, vocabulary_path: str, end_id: int = 1, shard_tokens: int = 1 << 20, id_col: str = "doc_id", text_col: str = "text"
) -> str:
    """Encode all texts and write the shards in ascending id order; returns the path.

    Rows are range-partitioned by id (an input position breaks ties, so even a
    repeated id spreads); a task streams its range into shards of about
    ``shard_tokens`` tokens, whole documents each.
    """
    spark = df.sparkSession
    with open(vocabulary_path, encoding="utf-8") as file:
        sent = spark.sparkContext.broadcast(file.read())
    rows = df.select(df[id_col].cast("long").alias("id"), F.coalesce(df[text_col], F.lit("")).alias("text"))
    rows = rows.withColumn("tie", F.monotonically_increasing_id())
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartitionByRange(parts, "id", "tie").sortWithinPartitions("id", "tie").select("id", "text")
    schema = pa.schema([("part", pa.int32()), ("shard", pa.int64()), ("n_tokens", pa.int64()), ("n_docs", pa.int64()), ("data", pa.binary())])

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = vocabulary(WordBPE, sent.value)
        bits = max(1, max(len(bpe.sizes) - 1, end_id).bit_length())
        kind = np.uint16 if bits <= 16 else np.uint32
        end = np.array([end_id], kind)
        part, number = TaskContext.get().partitionId(), 0
        ids: list[int] = []
        tokens: list[np.ndarray] = []
        held = 0

        def shard() -> pa.RecordBatch:
            nonlocal number, held
            lengths = np.array([len(t) for t in tokens], np.int64)
            data = Shard(np.array(ids, np.int64), lengths, WaveletMatrix.build(np.concatenate(tokens), bits)).to_bytes()
            row = [[part], [number], [int(lengths.sum())], [len(ids)], [data]]
            number, held = number + 1, 0
            ids.clear()
            tokens.clear()
            return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(row, schema, strict=True)], schema=schema)

        for batch in batches:
            for piece in slices(batch, "text"):
                names = [NULL_ID if x is None else x for x in piece.column("id").to_pylist()]
                for name, found in zip(names, bpe.encode_batch(piece.column("text").to_pylist()), strict=True):
                    ids.append(name)
                    tokens.append(np.concatenate([np.frombuffer(found, "<u4").astype(kind), end]))
                    held += len(tokens[-1])
                    if held >= shard_tokens:
                        yield shard()
        if ids:
            yield shard()

    path = shared_path(spark, "shards")
    made = dealt.mapInArrow(encode, "part int, shard long, n_tokens long, n_docs long, data binary")
    made.write.option("compression", "none").option("maxRecordsPerFile", 1).option("parquet.enable.dictionary", "false").parquet(path)
    return path


def read_documents(spark: SparkSession, path: str, id_col: str = "doc_id", end_id: int = 1) -> DataFrame:
    """One row per document, from the shards: id, start, n_tokens, ids_crc32, n_end_ids.

    ``n_end_ids`` is how often the end mark's id occurs in the document, by rank at its borders; a
    document that does not end with it, by access at its last place, raises ValueError.
    """
    shards = spark.read.schema("part int, shard long, n_tokens long, n_docs long, data binary").parquet(path)
    sizes = shards.groupBy("part", "shard").agg(F.sum("n_tokens").alias("n"))
    # a row per range partition: as many as the session's shuffle partitions
    totals = sizes.groupBy("part").agg(F.sum("n").alias("total"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select("part", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("base"))
    inside = Window.partitionBy("part").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.withColumn("first", F.coalesce(F.sum("n").over(inside), F.lit(0))).join(totals, "part")
    offsets = offsets.select("part", "shard", (F.col("base") + F.col("first")).alias("offset"))
    schema = pa.schema(
        [("part", pa.int32()), ("shard", pa.int64()), ("id", pa.int64()), ("local", pa.int64()), ("n_tokens", pa.int64()),
         ("ids_crc32", pa.int64()), ("n_end_ids", pa.int64())]
    )

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                part, number = batch.column("part")[i].as_py(), batch.column("shard")[i].as_py()
                shard = Shard.from_bytes(batch.column("data")[i].as_py())
                flat = shard.matrix.decode().astype("<u4").tobytes()
                ends = np.cumsum(shard.lengths)
                starts = ends - shard.lengths
                if (shard.matrix.access(ends - 1) != end_id).any():
                    raise ValueError("a document without its end mark")
                upto = shard.matrix.ranks(end_id, ends)
                marks = np.diff(upto, prepend=0)
                crc = [zlib.crc32(flat[4 * a : 4 * z]) for a, z in zip(starts.tolist(), ends.tolist(), strict=True)]
                ids = pa.array(shard.doc_ids, pa.int64(), mask=shard.doc_ids == NULL_ID)
                n = len(crc)
                columns = [pa.array([part] * n, pa.int32()), pa.array([number] * n, pa.int64()), ids]
                columns += [pa.array(starts), pa.array(shard.lengths), pa.array(crc, pa.int64()), pa.array(marks)]
                yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    # a task reads several files, as starting one costs more than a shard
    tasks = max(spark.sparkContext.defaultParallelism, -(-shards.count() // 16))
    docs = shards.select("part", "shard", "data").coalesce(tasks).mapInArrow(
        decode, "part int, shard long, id long, local long, n_tokens long, ids_crc32 long, n_end_ids long"
    )
    return docs.join(offsets, ["part", "shard"]).select(
        F.col("id").alias(id_col), (F.col("offset") + F.col("local")).alias("start"), "n_tokens", "ids_crc32", "n_end_ids"
    )


def find_token(spark: SparkSession, path: str, token: int) -> DataFrame:
    """(part, shard, doc_id, position in the document) of every occurrence of a token, from the shards."""
    shards = spark.read.schema("part int, shard long, n_tokens long, n_docs long, data binary").parquet(path)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                shard = Shard.from_bytes(batch.column("data")[i].as_py())
                at = shard.matrix.positions(token)
                ends = np.cumsum(shard.lengths)
                doc = np.searchsorted(ends, at, "right")
                ids = shard.doc_ids[doc]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([batch.column("part")[i].as_py()] * len(at), pa.int32()),
                        pa.array([batch.column("shard")[i].as_py()] * len(at), pa.int64()),
                        pa.array(ids, pa.int64(), mask=ids == NULL_ID),
                        pa.array(at - (ends - shard.lengths)[doc], pa.int64()),
                    ],
                    names=["part", "shard", "doc_id", "position"],
                )

    return shards.select("part", "shard", "data").mapInArrow(find, "part int, shard long, doc_id long, position long")
