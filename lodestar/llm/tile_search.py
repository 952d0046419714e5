"""Approximate nearest neighbours by a block matrix join over int8 tiles.

Blocks of queries meet blocks of candidates. Unit vectors are rounded to int8 with a scale of their own, a
tile of products gives every cosine of the pair of blocks at once, and the lengths of what rounding took
away bound its error: |x.y - x'.y'| <= |x - x'| |y| + |x'| |y - y'|. Pairs whose upper bound reaches the
query's threshold are computed again in double precision and go through a heap. As nothing is dropped
without a bound, what is found are the nearest ones.
"""

from __future__ import annotations

import hashlib
import heapq
import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import map_arrow, saved, sorted_groups, table

#: Candidates, and queries, of a block; a task holds one of each.
BLOCK = 4096
#: Queries whose tile with a block of candidates is held at a time, and pairs computed again at a time.
STRIP, PAIRS = 256, 1 << 15
#: Components of one tile product: 127 * 127 * 1024 is below 2^24, so a product in single precision is exact.
TILE_WIDTH = 1024
#: Each round of blocks is this many times larger than all before it.
GROWTH = 3

VECTORS = "vec_id long, row long, is_query boolean, dim int, key binary, vec binary"


def _prepare(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
    """Vectors that take part, as doubles with a digest; a vector beyond 2^300, or wholly below 2^-300, is scaled by a power of two, which changes no cosine."""
    for b in batches:
        out: list[list] = [[], [], [], [], [], []]
        for vec_id, row, is_query, x in zip(*(b.column(c).to_pylist() for c in ("vec_id", "row", "is_query", "vec"))):
            if x is None or None in x:
                continue
            v = np.array(x, dtype="<f8")
            top = np.abs(v).max(initial=0.0)
            if not np.isfinite(top) or top == 0:
                continue
            if not 2.0**-300 < top < 2.0**300:
                v = np.ldexp(v, -math.frexp(top)[1])
            data = (v + 0.0).tobytes()  # no negative zeros
            for c, value in zip(out, (vec_id, row, is_query, len(v), hashlib.blake2b(data, digest_size=16).digest(), data)):
                c.append(value)
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.int64(), pa.bool_(), pa.int32(), pa.binary(), pa.binary()))], names=["vec_id", "row", "is_query", "dim", "key", "vec"])


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Products of pairs of rows, summed component by component: equal vectors get equal sums, wherever they stand."""
    out = np.zeros(len(a))
    for j in range(a.shape[1]):
        out += a[:, j] * b[:, j]
    return out


def lengths(x: np.ndarray) -> np.ndarray:
    return np.sqrt(products(x, x))


class Codes:
    """Rows as int8 with a scale each; `lost` bounds the length of what rounding took from the unit vector, `length` that of what is left."""

    def __init__(self, x: np.ndarray, length: np.ndarray):
        unit = x / length[:, None]
        self.scale = np.abs(unit).max(axis=1, initial=0.0) / 127
        codes = np.rint(unit / self.scale[:, None])
        self.codes = codes.astype(np.int8)
        rounded = codes * self.scale[:, None]
        self.lost = np.sqrt(((unit - rounded) ** 2).sum(axis=1)) + 1e-12
        self.length = np.sqrt((rounded**2).sum(axis=1)) + 1e-12

    def tile(self, other: Codes, at: slice) -> tuple[np.ndarray, np.ndarray]:
        """(rounded products of the rows `at` with all rows of the other, bounds of their errors)."""
        total = np.zeros((len(self.codes[at]), len(other.codes)))
        for j in range(0, self.codes.shape[1], TILE_WIDTH):
            total += self.codes[at, j : j + TILE_WIDTH].astype(np.float32) @ other.codes[:, j : j + TILE_WIDTH].astype(np.float32).T
        total *= self.scale[at, None]
        total *= other.scale[None, :]
        error = self.lost[at, None] + self.length[at, None] * other.lost[None, :] + 1e-9
        return total, error


def tile_top(q: np.ndarray, low: np.ndarray, vid: np.ndarray, vrow: np.ndarray, v: np.ndarray, k: int, tally: list[int] | None = None) -> Iterator[tuple[int, list[tuple[float, int, int]]]]:
    """(query's place, its k nearest of the block at most as (-cosine, id, row)), nothing below `low`. tally counts pairs and survivors."""
    if not len(q) or not len(v):
        return
    nq, nv = lengths(q), lengths(v)
    cq, cv = Codes(q, nq), Codes(v, nv)
    for at in range(0, len(q), STRIP):
        some = slice(at, at + STRIP)
        near, error = cq.tile(cv, some)
        least = low[some]
        if len(v) > k:
            least = np.maximum(least, np.partition(near - error, len(v) - k, axis=1)[:, len(v) - k])
        i, j = np.nonzero(near + error >= least[:, None])
        if tally is not None:
            tally[0] += near.size
            tally[1] += len(i)
        heaps: dict[int, list[tuple[float, int, int]]] = {}
        for s in range(0, len(i), PAIRS):
            a, b = i[s : s + PAIRS] + at, j[s : s + PAIRS]
            score = products(q[a], v[b]) / (nq[a] * nv[b])
            for x, c, d, r in zip(a.tolist(), score.tolist(), vid[b].tolist(), vrow[b].tolist()):
                heap = heaps.setdefault(x, [])
                item = (c, -d, -r)
                if len(heap) < k:
                    heapq.heappush(heap, item)
                elif item > heap[0]:
                    heapq.heapreplace(heap, item)
        for x, heap in heaps.items():
            yield x, sorted((-c, -d, -r) for c, d, r in heap if c >= low[x])


def _rows(column: pa.ChunkedArray, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<f8").reshape(-1, dim)


FOUND = "qkey binary, dim int, vec_id long, row long, score double"


def _search(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        for g in sorted_groups(batches, ["dim", "qb", "vb"]):
            dim = g.column("dim")[0].as_py()
            isq = g.column("asks").to_numpy(zero_copy_only=False).astype(bool)
            ids, rows, low = (g.column(c).to_numpy() for c in ("vec_id", "row", "low"))
            x = _rows(g.column("vec"), dim)
            keys = [key for key, ask in zip(g.column("key").to_pylist(), isq.tolist()) if ask]
            out = [(keys[a], *item) for a, best in tile_top(x[isq], low[isq], ids[~isq], rows[~isq], x[~isq], k) for item in best]
            if out:
                key, score, vid, row = zip(*out)
                yield pa.RecordBatch.from_arrays([pa.array(key, pa.binary()), pa.array([dim] * len(out), pa.int32()), pa.array(vid, pa.int64()), pa.array(row, pa.int64()), pa.array([-s for s in score], pa.float64())], names=["qkey", "dim", "vec_id", "row", "score"])

    return run


def nearest(vectors: DataFrame, is_query, k: int = 5, id_col: str = "vec_id", vec_col: str = "embedding", block: int = BLOCK) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k rows of the largest cosines, ties to the smaller id.

    Vectors that are null, empty, zero, or hold null or non-finite components take no part; those of
    different lengths are not compared. Rows without id are candidates for none and query nothing. A
    repeated id is a row of its own: a candidate for its twin, and a query with ranks of its own. Only
    id_col and vec_col are read. No rows: an empty result.

    Equal vectors are one query, and of them no more than the k + 1 first rows can be among anybody's k
    nearest; so copies do not meet all copies. Blocks are dealt by hash, in rounds of ever more blocks; a
    query takes the score of its (k + 1)-th best so far to the next round. Rounds grow with the logarithm of
    the rows.
    """
    raw = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.monotonically_increasing_id().alias("row"), F.col(vec_col).cast("array<double>").alias("vec")).where("vec_id is not null")
    v = saved(map_arrow(raw.withColumn("is_query", F.coalesce(is_query(F.col("vec_id")), F.lit(False))), _prepare, VECTORS, block))
    first = F.row_number().over(W.partitionBy("key", "dim").orderBy("vec_id", "row"))
    cand = v.withColumn("first", first).where(F.col("first") <= k + 1).drop("first")
    asked = v.where("is_query").groupBy("key", "dim", "vec").agg(F.count(F.lit(1)).alias("n"))
    cand, asked = saved(cand), saved(asked)
    blocks, qblocks = max(1, math.ceil(cand.count() / block)), max(1, math.ceil(asked.count() / block))
    numbers = lambda lo, hi: F.explode(F.sequence(F.lit(lo).cast("long"), F.lit(hi - 1).cast("long")))
    cand = cand.withColumn("vb", F.pmod(F.xxhash64("vec_id", "row"), F.lit(blocks)))
    asked = asked.select("key", "dim", "vec", F.pmod(F.xxhash64("key", "dim"), F.lit(qblocks)).alias("qb"))
    cols = ["dim", "qb", "vb", "asks", "key", "vec_id", "row", "low", "vec"]
    never = F.lit(float("-inf"))
    rank = F.row_number().over(W.partitionBy("qkey", "dim").orderBy(F.desc("score"), "vec_id", "row"))
    best: DataFrame | None = None
    lo = 0
    while lo < blocks:
        hi = min(blocks, lo + max(1, GROWTH * lo))
        quer = asked.withColumn("asks", F.lit(True)).withColumn("vec_id", F.lit(0).cast("long")).withColumn("row", F.lit(0).cast("long"))
        if best is None:
            quer = quer.withColumn("low", never)
        else:
            last = best.where(F.col("rank") == k + 1).select(F.col("qkey").alias("key"), "dim", F.col("score").alias("low"))
            quer = quer.join(last, ["key", "dim"], "left").withColumn("low", F.coalesce("low", never))
        met = cand.where(F.col("vb").between(lo, hi - 1)).withColumn("qb", numbers(0, qblocks)).withColumn("asks", F.lit(False)).withColumn("low", never)
        met = met.select(*cols).union(quer.withColumn("vb", numbers(lo, hi)).select(*cols)).repartition("dim", "qb", "vb").sortWithinPartitions("dim", "qb", "vb")
        found = map_arrow(met, _search(k + 1), FOUND, block)
        found = found if best is None else found.union(best.drop("rank"))
        best = saved(found.withColumn("rank", rank).where(F.col("rank") <= k + 1))
        lo = hi
    mine = best.groupBy("qkey", "dim").agg(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("less"), "vec_id", F.col("row").alias("found")))).alias("best"))  # k + 1 at most
    queries = v.where("is_query").select(F.col("vec_id").alias("query_id"), F.col("row").alias("own"), F.col("key").alias("qkey"), "dim")
    listed = queries.join(mine, ["qkey", "dim"]).select("query_id", F.posexplode(F.slice(F.filter("best", lambda x: x["found"] != F.col("own")), 1, k)).alias("at", "hit"))
    return listed.select("query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("hit.vec_id").alias("vec_id"), (-F.col("hit.less")).alias("score"))


def op13_tile_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"), lambda i: i % 50 == 0)


OP13_SQL = """
with v as (
  select vec_id, list_transform(embedding, lambda x: cast(x as double)) as e
  from embeddings
  where vec_id is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0 and len(list_filter(embedding, lambda x: x <> 0)) > 0
), n as (select vec_id, e, sqrt(list_dot_product(e, e)) as l from v), p as (
  select q.vec_id as query_id, c.vec_id, list_dot_product(q.e, c.e) / (q.l * c.l) as score
  from n q, n c where q.vec_id % 50 = 0 and q.vec_id <> c.vec_id and len(q.e) = len(c.e)
), r as (select *, cast(row_number() over (partition by query_id order by score desc, vec_id) as int) as rank from p)
select query_id, rank, vec_id, score from r where rank <= 5
"""
