"""Token ids in succinct shards: a wavelet matrix each (operator 9).

Documents are sorted by id over the cluster and encoded; consecutive documents form
shards of about ``shard_tokens`` tokens. A shard is one row of the written table: where it
stands, its documents with their lengths, and one zstd-compressed payload. The payload is
a wavelet matrix: for each bit of an id, from the highest, a plane of bits in the order
that the planes above leave (zeros first, stably), with counts of ones before each block
of 512. One payload so gives the token at a place, the number of a token's occurrences in
any range, and the place of its k-th occurrence, without the ids beside it.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .runtime import tasks_for, text_or_empty
from .words import Encoder

MAGIC, BLOCK = b"WMX1", 512


class WaveletMatrix:
    """The ids of a shard. Places count from 0."""

    def __init__(self, n: int, planes: list[np.ndarray]):
        self.n, self.planes = n, planes  # highest bit first, each padded to whole blocks

    @classmethod
    def build(cls, ids: np.ndarray) -> "WaveletMatrix":
        planes, n = [], len(ids)
        size = -(-n // BLOCK) * BLOCK // 8
        for level in reversed(range(max(1, int(ids.max(initial=0)).bit_length()))):
            plane = np.zeros(size, np.uint8)
            bits = np.packbits((ids & ids.dtype.type(1 << level)).astype(bool), bitorder="little")
            plane[: len(bits)] = bits
            planes.append(plane)
            if level:  # Arrow selects by packed bits, several times faster than by bools
                row = pa.array(ids)
                zeros, ones = (row.filter(pa.Array.from_buffers(pa.bool_(), n, [None, pa.py_buffer(x)])) for x in (~plane, plane))
                ids = np.concatenate((zeros.to_numpy(), ones.to_numpy()))
        return cls(n, planes)

    def to_bytes(self) -> bytes:
        raw = b"".join(x.tobytes() for x in (*self.planes, *self.ranks))
        return MAGIC + struct.pack("<QB", self.n, len(self.planes)) + zstandard.ZstdCompressor(1).compress(raw)

    @classmethod
    def from_bytes(cls, data: bytes) -> "WaveletMatrix":
        if data[:4] != MAGIC:
            raise ValueError("not a token shard")
        n, levels = struct.unpack_from("<QB", data, 4)
        raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data[13:]), np.uint8)
        size, blocks = -(-n // BLOCK) * BLOCK // 8, -(-n // BLOCK)
        out = cls(n, [raw[i * size : (i + 1) * size] for i in range(levels)])
        counts = raw[levels * size :].view("<u4").reshape(levels, blocks + 1)
        out.ranks = list(counts)
        return out

    @cached_property
    def ranks(self) -> list[np.ndarray]:
        """Ones before each block; at the end their total."""
        ones = (np.bitwise_count(p.view("<u8")).reshape(-1, BLOCK // 64).sum(1, dtype=np.int64) for p in self.planes)
        return [np.r_[0, np.cumsum(x)].astype("<u4") for x in ones]

    def _zeros(self, level: int) -> int:
        return self.n - int(self.ranks[level][-1])

    def _ones(self, level: int, i: int) -> int:
        """Ones before place i."""
        block = i // BLOCK
        part = self.planes[level][block * BLOCK // 8 : -(-i // 8)]
        extra = int(part[-1] >> (i % 8)) if i % 8 and len(part) else 0
        return int(self.ranks[level][block]) + int(np.bitwise_count(part).sum()) - extra.bit_count()

    def access(self, i: int) -> int:
        """The token at place i."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        token = 0
        for level, plane in enumerate(self.planes):
            bit = plane[i // 8] >> (i % 8) & 1
            ones = self._ones(level, i)
            token = token << 1 | int(bit)
            i = self._zeros(level) + ones if bit else i - ones
        return token

    def _range(self, token: int, begin: int, end: int) -> tuple[int, int]:
        if token < 0 or token >> len(self.planes):
            return 0, 0
        for level in range(len(self.planes)):
            a, b = self._ones(level, begin), self._ones(level, end)
            if token >> (len(self.planes) - 1 - level) & 1:
                begin, end = self._zeros(level) + a, self._zeros(level) + b
            else:
                begin, end = begin - a, end - b
        return begin, end

    def count(self, token: int, begin: int = 0, end: int | None = None) -> int:
        """How often a token stands in [begin, end)."""
        a, b = self._range(token, begin, self.n if end is None else min(end, self.n))
        return b - a

    rank = count

    def select(self, token: int, k: int) -> int:
        """The place of the k-th occurrence, from 0."""
        begin, end = self._range(token, 0, self.n)
        if not 0 <= k < end - begin:
            raise IndexError(k)
        i = begin + k
        for level in reversed(range(len(self.planes))):
            one = token >> (len(self.planes) - 1 - level) & 1
            i = self._place(level, i - self._zeros(level) if one else i, one)
        return i

    def _place(self, level: int, k: int, one: int) -> int:
        """The place of the k-th one (or zero) of a plane."""
        before = self.ranks[level].astype(np.int64)
        if not one:
            before = np.arange(len(before)) * BLOCK - before
        block = int(np.searchsorted(before, k, side="right")) - 1
        bits = np.unpackbits(self.planes[level][block * BLOCK // 8 : (block + 1) * BLOCK // 8], bitorder="little")
        return block * BLOCK + int(np.flatnonzero(bits == one)[k - before[block]])

    def occurrences(self, token: int) -> list[int]:
        return [self.select(token, k) for k in range(self.count(token))]

    def decode(self) -> np.ndarray:
        """All ids in their order."""
        ids = np.zeros(self.n, "<u2" if len(self.planes) <= 16 else "<u4")
        for level in reversed(range(len(self.planes))):
            bit = np.unpackbits(self.planes[level], count=self.n, bitorder="little").view(bool)
            zeros, out = self._zeros(level), np.empty_like(ids)
            out[~bit] = ids[:zeros]
            out[bit] = ids[zeros:] | ids.dtype.type(1 << (len(self.planes) - 1 - level))
            ids = out
        return ids


def _shards(batches: Iterator[pa.RecordBatch], vocabulary: str, end_id: int, shard_tokens: int, kind: pa.DataType) -> Iterator[pa.RecordBatch]:
    encoder = Encoder.of(vocabulary)
    end = np.array([end_id], encoder.dtype).tobytes()
    part, nth, before, keys, parts, size = TaskContext.get().partitionId(), 0, 0, [], [], 0
    names = ["part", "shard", "before", "n_tokens", "ids", "lengths", "payload"]
    kinds = (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.list_(kind), pa.list_(pa.int64()), pa.binary())

    def shard() -> pa.RecordBatch:
        ids = np.frombuffer(b"".join(parts), encoder.dtype)
        lengths = [len(x) // encoder.dtype.itemsize for x in parts]
        row = (part, nth, before, len(ids), keys, lengths, WaveletMatrix.build(ids).to_bytes())
        return pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(row, kinds, strict=True)], names)

    for batch in batches:
        for key, ids in zip(batch["id"].to_pylist(), encoder.encode(batch["text"]), strict=True):
            keys.append(key)
            parts.append(ids + end)
            size += len(parts[-1]) // encoder.dtype.itemsize
            if size >= shard_tokens:
                yield shard()
                nth, before, keys, parts, size = nth + 1, before + size, [], [], 0
    if parts:
        yield shard()


def write_shards(
    df: DataFrame,
    path: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    vocabulary: str = "byte_bpe_50k.json",
    end_id: int = 2,
    shard_tokens: int = 1 << 20,
) -> None:
    """Encode all documents, ``end_id`` after each, and write them in ascending id order.

    A null text counts as empty (its end id alone stands there), null ids come first,
    repeated rows stay side by side, other columns are not read, an empty table writes an
    empty table. Documents are never split: one larger than ``shard_tokens`` has a shard
    of its own.
    """
    kind, field = df.schema[id_col].dataType.simpleString(), to_arrow_type(df.schema[id_col].dataType)
    docs = df.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("text"))
    docs = docs.repartitionByRange(tasks_for(df, text_col), "id").sortWithinPartitions("id")
    schema = f"part int, shard int, before long, n_tokens long, ids array<{kind}>, lengths array<long>, payload binary"
    shards = docs.mapInArrow(lambda it: _shards(it, vocabulary, end_id, shard_tokens, field), schema)
    shards.write.option("compression", "uncompressed").parquet(path)


def _bases(spark: SparkSession, path: str) -> dict[int, int]:
    """Tokens before each part: as many rows as the writer had tasks."""
    sizes = spark.read.parquet(path).groupBy("part").agg(F.sum("n_tokens").alias("n")).collect()
    out, total = {}, 0
    for part, n in sorted((r["part"], r["n"]) for r in sizes):
        out[part], total = total, total + n
    return out


def _documents(batches: Iterator[pa.RecordBatch], bases: dict[int, int], with_ids: bool) -> Iterator[pa.RecordBatch]:
    names = ["id", "start", "n_tokens", "ids_crc32", "tokens"]
    for batch in batches:
        for row, (part, before, payload) in enumerate(zip(*(batch[c].to_pylist() for c in ("part", "before", "payload")), strict=True)):
            tokens = WaveletMatrix.from_bytes(payload).decode().astype("<u4")
            lengths = batch["lengths"][row].values.to_numpy()
            ends = np.cumsum(lengths)
            starts = ends - lengths
            pieces = [tokens[a:b].tobytes() for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
            checks, raw = pa.array([zlib.crc32(x) for x in pieces], pa.int64()), pa.array(pieces if with_ids else [None] * len(pieces), pa.binary())
            yield pa.RecordBatch.from_arrays([batch["ids"][row].values, pa.array(bases[part] + before + starts), pa.array(lengths), checks, raw], names)


def read_documents(spark: SparkSession, path: str, id_col: str = "doc_id", with_ids: bool = False) -> DataFrame:
    """Documents from the shards: id, ``start``, ``n_tokens``, ``ids_crc32`` and, on
    request, ``tokens`` (little-endian 32-bit)."""
    shards = spark.read.parquet(path)
    kind = shards.schema["ids"].dataType.elementType.simpleString()
    bases = _bases(spark, path)
    schema = f"id {kind}, start long, n_tokens long, ids_crc32 long, tokens binary"
    out = shards.mapInArrow(lambda it: _documents(it, bases, with_ids), schema).withColumnRenamed("id", id_col)
    return out if with_ids else out.drop("tokens")


def find_token(spark: SparkSession, path: str, token: int, id_col: str = "doc_id") -> DataFrame:
    """Every occurrence of a token: its document and its place there, by select alone."""

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, payload in enumerate(batch["payload"].to_pylist()):
                at = np.array(WaveletMatrix.from_bytes(payload).occurrences(token), np.int64)
                lengths = batch["lengths"][row].values.to_numpy()
                ends = np.cumsum(lengths)
                k = np.searchsorted(ends, at, side="right")
                yield pa.RecordBatch.from_arrays([batch["ids"][row].values.take(pa.array(k, pa.int64())), pa.array(at - (ends - lengths)[k])], ["id", "at"])

    shards = spark.read.parquet(path)
    kind = shards.schema["ids"].dataType.elementType.simpleString()
    return shards.mapInArrow(found, f"id {kind}, at long").withColumnRenamed("id", id_col)
