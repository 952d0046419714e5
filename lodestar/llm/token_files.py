"""Token-ID files: a wavelet matrix per shard.

A shard is one row of a Parquet file: the ids of a run of documents as bit-planes, most significant
first, each plane stably partitioned by the one before it, with the number of set bits before every
block. From those alone come access to a position, the count of an id before a position (rank) and
the place of its k-th occurrence (select).
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import encode_ids16, map_arrow, saved, table

TOKENIZER = "word_bpe_49k.json"
END_ID = 2
#: Tokens of a shard, at most but for a longer single document.
SHARD_TOKENS = 1 << 20
#: Rows of a batch that is encoded, and pieces that a worker remembers (memory for time; no result depends on them).
BATCH_ROWS, CACHED = 6144, 1_200_000
#: Bits between two stored ranks.
RANK_BITS = 512


class WaveletMatrix:
    """Sequence of n ids of `bits` bits."""

    def __init__(self, n: int, bits: int, planes: np.ndarray, ranks: np.ndarray, zeros: np.ndarray):
        self.n, self.bits, self.planes, self.ranks, self.zeros = n, bits, planes, ranks, zeros

    @classmethod
    def build(cls, ids: np.ndarray, bits: int = 16) -> WaveletMatrix:
        x = np.ascontiguousarray(ids)
        n = len(x)
        planes, zeros = [], []
        for level in range(bits):
            bit = (x & x.dtype.type(1 << (bits - 1 - level))) != 0
            planes.append(np.packbits(bit, bitorder="little"))
            zero = x[~bit]
            zeros.append(len(zero))
            x = np.concatenate((zero, x[bit]))
        stacked = np.stack(planes)
        return cls(n, bits, stacked, cls._ranks(stacked, n), np.array(zeros, dtype=np.int64))

    @staticmethod
    def _ranks(planes: np.ndarray, n: int) -> np.ndarray:
        step = RANK_BITS // 8
        blocks = -(-planes.shape[1] // step) if n else 0
        padded = np.zeros((planes.shape[0], blocks * step), dtype=np.uint8)
        padded[:, : planes.shape[1]] = planes
        counts = np.bitwise_count(padded).reshape(planes.shape[0], blocks, step).sum(axis=2, dtype=np.uint32)
        out = np.zeros((planes.shape[0], blocks + 1), dtype=np.uint32)
        np.cumsum(counts, axis=1, out=out[:, 1:])
        return out

    def to_bytes(self) -> bytes:
        head = np.array([0x4D4C4F4C, self.bits, self.n], dtype="<i8").tobytes()
        return head + self.zeros.astype("<i8").tobytes() + self.ranks.astype("<u4").tobytes() + self.planes.tobytes()

    @classmethod
    def from_bytes(cls, blob: bytes) -> WaveletMatrix:
        magic, bits, n = np.frombuffer(blob, "<i8", 3).tolist()
        if magic != 0x4D4C4F4C:
            raise ValueError("not a wavelet matrix")
        at = 24
        zeros = np.frombuffer(blob, "<i8", bits, at)
        at += 8 * bits
        width = -(-n // 8)
        blocks = (-(-width // (RANK_BITS // 8)) if n else 0) + 1
        ranks = np.frombuffer(blob, "<u4", bits * blocks, at).reshape(bits, blocks)
        at += 4 * bits * blocks
        planes = np.frombuffer(blob, np.uint8, bits * width, at).reshape(bits, width)
        return cls(n, bits, planes, ranks, zeros)

    def _rank1(self, level: int, i: np.ndarray) -> np.ndarray:
        """Set bits before each position."""
        i = np.asarray(i, dtype=np.int64)
        block = i // RANK_BITS
        out = self.ranks[level][block].astype(np.int64)
        start = block * (RANK_BITS // 8)
        plane = self.planes[level]
        for k in range(RANK_BITS // 8):  # whole bytes of the block, then the last one's low bits
            at = start + k
            end = (i - 8 * at).clip(0, 8)
            byte = plane[np.minimum(at, len(plane) - 1)] if len(plane) else np.zeros_like(at, dtype=np.uint8)
            out += np.bitwise_count(byte & ((1 << end) - 1).astype(np.uint8))
        return out

    def access(self, i: int) -> int:
        """The id at position i."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        value = 0
        for level in range(self.bits):
            bit = (int(self.planes[level][i >> 3]) >> (i & 7)) & 1
            ones = int(self._rank1(level, np.array([i]))[0])
            value = value << 1 | bit
            i = int(self.zeros[level]) + ones if bit else i - ones
        return value

    def rank(self, value: int, i: int) -> int:
        """Occurrences of an id before position i."""
        if value < 0 or value >> self.bits:
            return 0
        lo, hi = 0, min(max(i, 0), self.n)
        for level in range(self.bits):
            a, b = self._rank1(level, np.array([lo, hi])).tolist()
            if value >> (self.bits - 1 - level) & 1:
                lo, hi = int(self.zeros[level]) + a, int(self.zeros[level]) + b
            else:
                lo, hi = lo - a, hi - b
        return hi - lo

    def select(self, value: int, k: int) -> int:
        """Position of the k-th occurrence (from 0) of an id, or -1."""
        if k < 0 or k >= self.rank(value, self.n):
            return -1
        lo = 0
        for level in range(self.bits):
            a = int(self._rank1(level, np.array([lo]))[0])
            lo = int(self.zeros[level]) + a if value >> (self.bits - 1 - level) & 1 else lo - a
        at = lo + k
        for level in reversed(range(self.bits)):
            one = bool(value >> (self.bits - 1 - level) & 1)
            want = at - int(self.zeros[level]) if one else at
            at = self._select(level, one, want)
        return at

    def _select(self, level: int, one: bool, k: int) -> int:
        ranks = self.ranks[level].astype(np.int64)
        before = ranks if one else np.minimum(np.arange(len(ranks)) * RANK_BITS, self.n) - ranks
        block = int(np.searchsorted(before, k, side="right")) - 1
        bits = np.unpackbits(self.planes[level][block * RANK_BITS // 8 : (block + 1) * RANK_BITS // 8], bitorder="little")[: self.n - block * RANK_BITS]
        return block * RANK_BITS + int(np.flatnonzero(bits == one)[k - int(before[block])])

    def occurrences(self, value: int) -> list[int]:
        return [self.select(value, k) for k in range(self.rank(value, self.n))]

    def decode(self) -> np.ndarray:
        """All ids, by undoing the planes from the last to the first."""
        x = np.zeros(self.n, dtype=np.uint16 if self.bits <= 16 else np.uint32)
        for level in reversed(range(self.bits)):
            bit = np.unpackbits(self.planes[level], count=self.n, bitorder="little").view(np.bool_)
            z = int(self.zeros[level])
            x[z:] |= x.dtype.type(1 << (self.bits - 1 - level))
            back = np.empty_like(x)
            back[bit] = x[z:]
            np.logical_not(bit, out=bit)
            back[bit] = x[:z]
            x = back
        return x


FILE_SCHEMA = "part int, shard int, doc_ids binary, id_nulls binary, lengths binary, n_tokens long, wavelet binary"


def _encode(tokenizer: str, end_id: int, shard_tokens: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        from pyspark import TaskContext

        part, shard = TaskContext.get().partitionId(), 0
        ids: list[bytes] = []
        docs: list[int | None] = []
        held = 0
        end = np.array([end_id], dtype="<u2").tobytes()

        def out() -> pa.RecordBatch:
            flat = np.frombuffer(b"".join(ids), "<u2")
            cols = [[part], [shard], [np.array([d or 0 for d in docs], "<i8").tobytes()], [np.array([d is None for d in docs], np.uint8).tobytes()], [np.array([len(x) // 2 for x in ids], "<i8").tobytes()], [len(flat)], [WaveletMatrix.build(flat).to_bytes()]]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.int64(), pa.binary()))], names=["part", "shard", "doc_ids", "id_nulls", "lengths", "n_tokens", "wavelet"])

        for b in batches:
            for d, x in zip(b.column("doc_id").to_pylist(), encode_ids16(tokenizer, b.column("text"), CACHED)):
                x += end
                if held and held + len(x) // 2 > shard_tokens:
                    yield out()
                    shard, ids, docs, held = shard + 1, [], [], 0
                ids.append(x)
                docs.append(d)
                held += len(x) // 2
        if docs:
            yield out()

    return run


def _decode(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
    for b in batches:
        for r in b.to_pylist():
            flat = WaveletMatrix.from_bytes(r["wavelet"]).decode().astype("<u4")
            lengths = np.frombuffer(r["lengths"], "<i8")
            starts = np.concatenate(([0], np.cumsum(lengths)[:-1]))
            data = memoryview(flat.tobytes())
            crc = [zlib.crc32(data[4 * s : 4 * (s + k)]) for s, k in zip(starts.tolist(), lengths.tolist())]
            doc = pa.array(np.frombuffer(r["doc_ids"], "<i8"), mask=np.frombuffer(r["id_nulls"], np.uint8).astype(bool))
            n = len(lengths)
            yield pa.RecordBatch.from_arrays([pa.array([r["part"]] * n, pa.int32()), pa.array([r["shard"]] * n, pa.int32()), doc, pa.array(starts, pa.int64()), pa.array(lengths, pa.int64()), pa.array(crc, pa.int64())], names=["part", "shard", "doc_id", "in_shard", "n_tokens", "ids_crc32"])


def write_token_files(docs: DataFrame, out_dir: str | None = None, tokenizer: str = TOKENIZER, end_id: int = END_ID, shard_tokens: int = SHARD_TOKENS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encodes whole texts, ends each with end_id and writes wavelet shards in ascending id order; returns the files' rows.

    Null and empty texts become end_id alone. Rows without id come first; repeated ids keep all their
    rows, in the order of a hash of their texts, so that only equal rows tie. Ids must stay below 65,536. Only id_col and text_col are read. No rows: no shard.
    """
    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text")]
    d = d.repartitionByRange(*order).sortWithinPartitions(*order)
    return saved(map_arrow(d, _encode(tokenizer, end_id, shard_tokens), FILE_SCHEMA, BATCH_ROWS), out_dir, compression="zstd")


def read_token_files(files: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) from the files: start counts the ids of all documents before.

    The running sum is over one row for each shard, first within partitions and then over them.
    """
    head = files.select("part", "shard", "n_tokens")
    in_part = head.select("part", "shard", (F.sum("n_tokens").over(W.partitionBy("part").orderBy("shard")) - F.col("n_tokens")).alias("in_part"))
    parts = head.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    before = parts.select("part", (F.sum("n").over(W.orderBy("part")) - F.col("n")).alias("before"))
    starts = in_part.join(before, "part").select("part", "shard", (F.col("in_part") + F.col("before")).alias("shard_start"))
    small = map_arrow(files, _decode, "part int, shard int, doc_id long, in_shard long, n_tokens long, ids_crc32 long", 4)
    return small.join(starts, ["part", "shard"]).select("doc_id", (F.col("shard_start") + F.col("in_shard")).alias("start"), "n_tokens", "ids_crc32")


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_token_files(write_token_files(table(spark, sf_dir, "documents")))
