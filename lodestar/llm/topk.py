"""Exact top-k search by multi-resolution segment statistics.

For vectors cut into segments, the inner product is at most the sum over segments of length * (product
of means + product of deviations). Coarse segments first, finer ones for what is left, then exact
products for survivors. In terms of distances this bounds |q - v|^2 = |q|^2 + |v|^2 - 2 q.v from below.

How much a level prunes depends on the vectors: neighbouring components that have nothing to do with each
other leave the coarse bounds loose. So the levels are chosen by what they prune of a bounded sample.
Where no bound can prune, every candidate reaches its exact product: the answer is the same, the work
that of comparing each query with each row, in blocks.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import map_arrow, saved, sorted_groups, table

SCALE = 256
#: Candidates, and queries, of a block; a task holds one of each.
BLOCK = 4096
#: Queries whose bounds with a block of candidates are held at a time.
STRIP = 256
#: Candidates of the highest bounds, beside k, whose exact scores set a block's threshold.
SEEDS = 192
#: Segments that levels may cut a vector into, coarse to fine; those of fewer segments than components count.
SEGMENTS = (4, 8, 16, 32, 64, 128)
#: Rows of the sample on which levels are chosen, and the share of what reaches it that a level must prune there.
SAMPLE_ROWS, LEAST_PRUNED = 2048, 0.1
#: Each round of blocks is this many times larger than all before it.
GROWTH = 3


def _stats(x: np.ndarray, segments: int) -> np.ndarray:
    """Means and deviations of the segments of rows, times the root of the segment's length, side by side: products of two are bounds."""
    cuts = np.array_split(np.arange(x.shape[1]), min(segments, max(1, x.shape[1])))
    mean = np.stack([x[:, c].mean(axis=1) if len(c) else np.zeros(len(x)) for c in cuts], axis=1)
    dev = np.stack([x[:, c].std(axis=1) if len(c) else np.zeros(len(x)) for c in cuts], axis=1)
    root = np.sqrt([len(c) for c in cuts])
    return np.concatenate((mean * root, dev * root), axis=1)


def _exact(q: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Integer products of a query with rows: in doubles while those are exact, else in whole numbers held at the ends of 64 bits."""
    bound = float(np.abs(q).max(initial=0)) * float(np.abs(v).max(initial=0)) * max(1, len(q))
    if bound < 2**53:
        return (v @ q).astype(np.int64)
    return np.array([max(-(2**63), min(2**63 - 1, sum(int(a) * int(b) for a, b in zip(q.tolist(), r)))) for r in v.tolist()], dtype=np.int64)


def choose_levels(x: np.ndarray, k: int, least: float = LEAST_PRUNED) -> tuple[int, ...]:
    """The levels worth their while for vectors like the rows of x: each prunes at least a share of what the ones before leave.

    The finest that there is stays if none does, so that a search always bounds before it multiplies.
    """
    n, dim = x.shape
    finest = [s for s in SEGMENTS if s < dim][-1:] or [1]
    if n <= 2 * k or not dim:
        return tuple(finest)
    with np.errstate(over="ignore", invalid="ignore"):
        q = x[:: max(1, n // 64)]
        score = q @ x.T
        low = np.partition(score, n - k - 1, axis=1)[:, n - k - 1 : n - k]
        live = np.ones(score.shape, dtype=bool)
        chosen = []
        for s in SEGMENTS:
            if s >= dim:
                break
            keep = live & (_stats(q, s) @ _stats(x, s).T >= low)
            if live.sum() - keep.sum() >= least * live.sum():
                chosen.append(s)
                live = keep
    return tuple(chosen or finest)


def block_top(qid: np.ndarray, q: np.ndarray, qrow: np.ndarray, low: np.ndarray, vid: np.ndarray, v: np.ndarray, vrow: np.ndarray, k: int, levels: tuple[int, ...], tally: list[int] | None = None) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """For each query what of the block can be among its k best, k rows at most, by score and then smaller id; own rows left out.

    low holds the k-th best score of each query so far (as a float; minus infinity before k are known).
    Within the block it rises to the k-th best exact score among the candidates of the highest bounds,
    so whatever is dropped is below k others. tally counts candidates and survivors.
    """
    if not len(v) or not len(q):
        return
    top = float(max(np.abs(q).max(initial=0), np.abs(v).max(initial=0)))
    bounded = top < 2**200  # beyond, bounds are no numbers
    vs = [_stats(v, s) for s in levels] if bounded else []
    qs = [_stats(q, s) for s in levels] if bounded else []
    for at in range(0, len(q), STRIP):
        first = qs[0][at : at + STRIP] @ vs[0].T if vs else None
        slack = 1e-9 * (1 + np.abs(first).max(initial=0)) * max(1, v.shape[1]) if vs else 0.0
        for r in range(at, min(at + STRIP, len(q))):
            least = low[r]
            live = np.flatnonzero(vrow != qrow[r])
            n = len(live)
            if vs and n > 2 * (k + SEEDS):
                bound = first[r - at][live]
                best = live[np.argpartition(-bound, k + SEEDS)[: k + SEEDS]]
                least = max(least, float(np.partition(_exact(q[r], v[best]), len(best) - k)[len(best) - k]))
                live = live[bound + slack >= least]
                for a, b in zip(qs[1:], vs[1:]):
                    live = live[b[live] @ a[r] + slack >= least]
            if tally is not None:
                tally[0] += n
                tally[1] += len(live)
            if not len(live):
                continue
            score = _exact(q[r], v[live])
            best = np.lexsort((vid[live], -score))[:k]
            best = best[score[best] >= least]
            if len(best):
                yield int(qid[r]), int(qrow[r]), vid[live][best], score[best]


def _vectors(column: pa.ChunkedArray, dim: int) -> np.ndarray:
    """The vectors of a group, all of dim components, as rows."""
    flat = column.combine_chunks()
    flat = flat.flatten() if isinstance(flat, pa.ListArray) else pa.concat_arrays([c.flatten() for c in flat.chunks])
    return flat.to_numpy(zero_copy_only=False).reshape(-1, dim) if dim else np.zeros((len(column), 0))


def _search(k: int, levels: dict[int, tuple[int, ...]]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        for g in sorted_groups(batches, ["dim", "qb", "vb"]):
            dim = g.column("dim")[0].as_py()
            ids, rows, low, isq = (g.column(c).to_numpy() for c in ("vec_id", "row", "low", "is_query"))
            x = _vectors(g.column("scaled"), dim)
            isq = isq.astype(bool)
            out = list(block_top(ids[isq], x[isq], rows[isq], low[isq], ids[~isq], x[~isq], rows[~isq], k, levels.get(dim, (1,))))
            if out:
                n = [len(s) for *_, s in out]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.repeat([a for a, *_ in out], n), pa.int64()), pa.array(np.repeat([b for _, b, *_ in out], n), pa.int64()), pa.array(np.concatenate([i for _, _, i, _ in out]), pa.int64()), pa.array(np.concatenate([s for *_, s in out]), pa.int64())],
                    names=["query_id", "query_row", "vec_id", "score"],
                )

    return run


def _scaled(x: Column) -> Column:
    """floor(256 * x) as a double: beyond 2^52 a double is whole."""
    y = F.lit(float(SCALE)) * x
    return F.when(F.rint(y) > y, F.rint(y) - 1.0).otherwise(F.rint(y))


def top_k(vectors: DataFrame, is_query, k: int = 5, id_col: str = "vec_id", vec_col: str = "embedding", block: int = BLOCK) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k highest integer inner products with all other rows.

    Components become floor(256 * x). Ties go to the smaller id. Vectors that are null or hold null or
    non-finite components, also those that are not finite once multiplied, take no part; vectors of
    different lengths are not compared. Rows without id are candidates for none and query nothing. A
    repeated id is a row of its own: it is a candidate for its twin, and each such query row has its own
    ranks. Scores beyond 64 bits are held at their ends. Only id_col and vec_col are read. No rows: an
    empty result.

    Rows are dealt into blocks by hash; each block of queries meets each block of candidates once, in
    rounds of ever more blocks. Of each meeting at most k rows a query go on, and the k-th best score of
    a query so far is the threshold that it takes to the next round. The number of rounds grows with the
    logarithm of the rows.
    """
    v = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.transform(F.col(vec_col).cast("array<double>"), _scaled).alias("scaled"))
    odd = F.exists("scaled", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    v = v.where(F.col("vec_id").isNotNull() & F.col("scaled").isNotNull()).where(~odd)
    v = saved(v.withColumn("row", F.monotonically_increasing_id()).withColumn("dim", F.size("scaled")).withColumn("q", is_query(F.col("vec_id"))))
    n, nq = v.agg(F.count(F.lit(1)), F.count_if("q")).first()
    blocks, qblocks = max(1, math.ceil(n / block)), max(1, math.ceil(nq / block))
    # a bounded sample, of which each length takes its own rows
    sample: dict[int, list] = {}
    for r in v.orderBy(F.xxhash64("vec_id", "row"), "row").select("dim", "scaled").limit(SAMPLE_ROWS).collect():
        sample.setdefault(r["dim"], []).append(r["scaled"])
    levels = {d: choose_levels(np.array(x, dtype=np.float64).reshape(-1, d), k) for d, x in sample.items()}

    spread = lambda m: F.pmod(F.xxhash64("vec_id", "row"), F.lit(m))
    numbers = lambda lo, hi: F.explode(F.sequence(F.lit(lo).cast("long"), F.lit(hi - 1).cast("long")))
    v = v.withColumn("vb", spread(blocks))
    cols = ["dim", "qb", "vb", "is_query", "vec_id", "row", "low", "scaled"]
    rank = F.row_number().over(W.partitionBy("query_id", "query_row").orderBy(F.desc("score"), "vec_id"))
    never = F.lit(float("-inf"))
    best: DataFrame | None = None
    lo = 0
    while lo < blocks:
        hi = min(blocks, lo + max(1, GROWTH * lo))
        cand = v.where(F.col("vb").between(lo, hi - 1)).withColumn("qb", numbers(0, qblocks)).withColumn("is_query", F.lit(False)).withColumn("low", never)
        quer = v.where("q").drop("vb").withColumn("qb", spread(qblocks)).withColumn("is_query", F.lit(True))
        if best is None:
            quer = quer.withColumn("low", never)
        else:
            kth = best.where(F.col("rank") == k).select(F.col("query_row").alias("row"), F.col("score").cast("double").alias("low"))
            quer = quer.join(kth, "row", "left").withColumn("low", F.coalesce("low", never))
        met = cand.select(*cols).union(quer.withColumn("vb", numbers(lo, hi)).select(*cols)).repartition("dim", "qb", "vb").sortWithinPartitions("dim", "qb", "vb")
        found = map_arrow(met, _search(k, levels), "query_id long, query_row long, vec_id long, score long", 4096)
        found = found if best is None else found.union(best.drop("rank"))
        best = found.withColumn("rank", rank).where(F.col("rank") <= k)
        best = saved(best) if hi < blocks else best
        lo = hi
    return best.select("query_id", "rank", "vec_id", "score")


def op8_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"), lambda i: i % 50 == 0)


OP8_SQL = """
with v as (
  select vec_id, list_transform(embedding, lambda x: cast(floor(256 * cast(x as double)) as bigint)) as e
  from embeddings
  where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(cast(x as double)))) = 0
), p as (
  select q.vec_id as query_id, c.vec_id, cast(list_sum(list_transform(range(1, len(q.e) + 1), lambda i: q.e[i] * c.e[i])) as bigint) as score
  from v q, v c where q.vec_id % 50 = 0 and q.vec_id <> c.vec_id
), r as (select *, cast(row_number() over (partition by query_id order by score desc, vec_id) as int) as rank from p)
select query_id, rank, vec_id, score from r where rank <= 5
"""
