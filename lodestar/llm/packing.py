"""Packing by Karmarkar-Karp multiway differencing.

Documents are dealt into blocks by a hash. In a block, every document's whole windows are sequences of
their own; what remains of each document is packed with the others' remains: partial partitions with
opposing imbalances are merged until one is left, which gives windows of near-equal fill, and the
number of windows rises while the fullest one exceeds the capacity.
"""

from __future__ import annotations

import heapq
import math
import zlib
from collections.abc import Iterable, Iterator
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import encode_ids16, map_arrow, numbered_copies, parts_for, sorted_groups, table, utf8_len

TOKENIZER = "byte_bpe_50k.json"
END_ID = 0
CAPACITY = 1024
#: Documents, and bytes of text, of a block (about); one longer document is a block nearly of its own.
BLOCK_DOCS, BLOCK_BYTES = 256, 2 << 20
#: Remains longer than this are cut in two halves, which lets the windows fill more evenly.
CUT = 512


def differencing(sizes: list[int], m: int) -> tuple[list[int], list[list[int]]]:
    """Sums and members of m windows: the two partial partitions of the largest spread are merged, opposed, until one is left."""
    if m == 1 or not sizes:
        return [sum(sizes)] + [0] * (m - 1), [list(range(len(sizes)))] + [[] for _ in range(m - 1)]
    # A partition: (sum, members) of the windows that hold anything, in descending order.
    heap = [(-n, i, [(n, (i, None, None))]) for i, n in enumerate(sizes)]
    heapq.heapify(heap)
    first = itemgetter(0)
    for tick in range(len(sizes), 2 * len(sizes) - 1):
        _, _, a = heapq.heappop(heap)
        _, _, b = heapq.heappop(heap)
        overlap = len(a) + len(b) - m
        if overlap <= 0:  # each window of one meets an empty one of the other
            merged = a + b
        else:  # a descending from the front, b ascending to the end
            free = len(a) - overlap
            merged = a[:free] + [(x + y, (None, t, u)) for (x, t), (y, u) in zip(a[free:], reversed(b[len(b) - overlap :]))] + b[: len(b) - overlap]
        merged.sort(key=first, reverse=True)
        spread = merged[0][0] - (merged[-1][0] if len(merged) == m else 0)
        heapq.heappush(heap, (-spread, tick, merged))
    sums, trees = [x for x, _ in heap[0][2]], [t for _, t in heap[0][2]]
    groups = []
    for t in trees:
        got, stack = [], [t]
        while stack:
            i, x, y = stack.pop()
            if i is not None:
                got.append(i)
            else:
                stack += [x, y]
        groups.append(got)
    return sums + [0] * (m - len(sums)), groups + [[] for _ in range(m - len(sums))]


def windows(sizes: list[int], capacity: int) -> list[list[int]]:
    """Members of the fewest windows for which the differencing stays within the capacity."""
    if not sizes:
        return []
    m = max(1, -(-sum(sizes) // capacity))
    step = 1
    while True:
        sums, groups = differencing(sizes, m)
        if max(sums) <= capacity:
            return [g for g in groups if g]
        if m >= len(sizes):
            return [[i] for i in range(len(sizes))]
        m = min(len(sizes), m + step)
        step = max(step, m // 200)


def _cuts(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces: whole windows, then its remains."""
    whole = n // capacity * capacity
    out = [(s, capacity) for s in range(0, whole, capacity)]
    left = n - whole
    while left > CUT:
        out.append((n - left, left // 2))
        left -= left // 2
    if left:
        out.append((n - left, left))
    return out


def _pack(tokenizer: str, end_id: int, capacity: int, cached: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        end = np.array([end_id], dtype="<u2").tobytes()
        encoded = (pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("block"), pa.array([x + end for x in encode_ids16(tokenizer, b.column("text"), cached)], pa.large_binary())], names=["doc_id", "block", "ids"]) for b in batches)
        for g in sorted_groups(encoded, ["block"]):
            block = g.column("block")[0].as_py()
            docs = g.column("doc_id").to_pylist()
            ids = g.column("ids").to_pylist()
            whole, rest = [], []  # (document, start, length)
            for k, x in enumerate(ids):
                for s, n in _cuts(len(x) // 2, capacity):
                    (whole if n == capacity else rest).append((k, s, n))
            rows = [(k, s, n, q, 0) for q, (k, s, n) in enumerate(whole)]
            q = len(whole)
            for members in windows([n for _, _, n in rest], capacity):
                at = 0
                for k, s, n in sorted(rest[i] for i in members):
                    rows.append((k, s, n, q, at))
                    at += n
                q += 1
            for i in range(0, len(rows), 2048):
                part = rows[i : i + 2048]
                cut = [np.frombuffer(ids[k], "<u2")[s : s + n].astype("<u4").tobytes() for k, s, n, _, _ in part]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([docs[r[0]] for r in part], pa.int64()), pa.array([r[1] for r in part], pa.int64()), pa.array([r[2] for r in part], pa.int64()),
                        pa.array([zlib.crc32(c) for c in cut], pa.int64()), pa.array([len(ids[r[0]]) // 2 for r in part], pa.int64()),
                        pa.array([block << 32 | r[3] for r in part], pa.int64()), pa.array([r[4] for r in part], pa.int64()), pa.array(cut, pa.binary()),
                    ],
                    names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids"],
                )

    return run


PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids binary"


def pack(docs: DataFrame, tokenizer: str = TOKENIZER, end_id: int = END_ID, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text", batch_rows: int = 6144, cached: int = 1_000_000) -> DataFrame:
    """One row per piece, with its ids (little-endian 32 bits), sequence and offset there.

    A document is its whole text's ids and end_id; null and empty texts are end_id alone. A sequence
    holds capacity ids at most. sequence_id is the block in the upper and a number in the lower 32
    bits, so it does not depend on how Spark deals the blocks out. Repeated rows and rows without id
    are packed like others; equal rows that would overfill a block are counted first and dealt by their
    number. Only id_col and text_col are read. No rows: no piece.

    batch_rows and cached (pieces that a worker remembers) trade memory for time and change no result.
    """
    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    d = d.withColumn("mark", F.xxhash64("doc_id", "text"))
    rows, size = d.agg(F.count(F.lit(1)), F.sum(utf8_len(F.col("text")))).first()
    blocks = max(1, math.ceil(rows / BLOCK_DOCS), math.ceil((size or 0) / BLOCK_BYTES))
    d = numbered_copies(d, BLOCK_DOCS)
    d = d.select("doc_id", "text", F.pmod(F.xxhash64("mark", "copy"), F.lit(blocks)).alias("block"))
    d = d.repartition(min(blocks, parts_for(docs.sparkSession, size or 0)), "block").sortWithinPartitions("block", "doc_id", "text")
    return map_arrow(d, _pack(tokenizer, end_id, capacity, cached), PIECES, batch_rows)


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents")).drop("ids")
