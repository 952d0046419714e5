"""Sharding: minimum-cost-flow resharding.

From the byte sizes of the old shards and the capacities of the new ones a flow problem gives the
block transfers that move the fewest bytes; each old shard is then cut at the flow's byte positions
and the affected new shards are written. Positions come from sums of bounded blocks of rows, so no
task ever holds a whole shard.
"""

from __future__ import annotations

import heapq
import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import block_rows, numbered_copies, parts_for, saved, shared_dir, table, utf8_len

#: Groups of old shards beyond the new ones' numbers, inside which rows are blocked further; equal rows above COPIES are dealt by number.
BUCKETS, COPIES = 256, 1024


def min_cost_flow(supply: list[int], capacity: list[int], cost: list[list[int]]) -> dict[tuple[int, int], int]:
    """Cheapest shipment of every supply into the capacities: successive shortest paths with potentials.

    The network is source - old shard - new shard - sink. Needs sum(capacity) >= sum(supply).
    """
    n, m = len(supply), len(capacity)
    if sum(capacity) < sum(supply):
        raise ValueError("the capacities are smaller than what they must hold")
    flow: dict[tuple[int, int], int] = {}
    left, room = list(supply), list(capacity)
    pot_o, pot_n = [0] * n, [0] * m
    inf = math.inf
    while True:
        dist_o, dist_n = [inf] * n, [inf] * m
        from_o: list[int] = [-1] * n  # the new shard whose shipment is taken back
        from_n: list[int] = [-1] * m
        heap: list[tuple[float, int, int]] = []
        for i in range(n):
            if left[i]:
                dist_o[i] = 0
                heap.append((0, 0, i))
        if not heap:
            return flow
        heapq.heapify(heap)
        while heap:
            d, side, v = heapq.heappop(heap)
            if side == 0:
                if d > dist_o[v]:
                    continue
                for j in range(m):
                    nd = d + cost[v][j] + pot_o[v] - pot_n[j]
                    if nd < dist_n[j]:
                        dist_n[j], from_n[j] = nd, v
                        heapq.heappush(heap, (nd, 1, j))
            else:
                if d > dist_n[v]:
                    continue
                for i in range(n):
                    if flow.get((i, v), 0):
                        nd = d - cost[i][v] + pot_n[v] - pot_o[i]
                        if nd < dist_o[i]:
                            dist_o[i], from_o[i] = nd, v
                            heapq.heappush(heap, (nd, 0, i))
        ends = [(dist_n[j] + pot_n[j], j) for j in range(m) if room[j] and dist_n[j] < inf]
        _, j = min(ends)
        most = max(x for x in [*dist_n, *dist_o] if x < inf)
        path, at = [], j
        while True:
            i = from_n[at]
            path.append((i, at, 1))
            if from_o[i] < 0:
                break
            path.append((i, from_o[i], -1))
            at = from_o[i]
        amount = min([left[i], room[j], *(flow[a, b] for a, b, s in path if s < 0)])
        for a, b, s in path:
            flow[a, b] = flow.get((a, b), 0) + s * amount
        left[i] -= amount
        room[j] -= amount
        pot_o = [p + min(d, most) for p, d in zip(pot_o, dist_o)]
        pot_n = [p + min(d, most) for p, d in zip(pot_n, dist_n)]


def even_capacities(total: int, shards: int) -> list[int]:
    return [total // shards + (j < total % shards) for j in range(shards)]


def plan_transfers(old_sizes: dict[int, int], capacities: list[int]) -> list[tuple[int, int, int, int]]:
    """(old, from byte, to byte, new): byte ranges of the old shards; staying in the shard of the same number is free.

    Old shards whose number no new one has cost the same everywhere, so they may come as one, numbered
    len(capacities): the problem has at most one node more than there are new shards.
    """
    olds = sorted(old_sizes)
    cost = [[0 if o == j else 1 for j in range(len(capacities))] for o in olds]
    flow = min_cost_flow([old_sizes[o] for o in olds], capacities, cost)
    out = []
    for k, o in enumerate(olds):
        at = 0
        # what stays lies first
        for j in sorted((j for (i, j), x in flow.items() if i == k and x), key=lambda j: (j != o, j)):
            out.append((o, at, at + flow[k, j], j))
            at += flow[k, j]
    return out


def reshard(docs: DataFrame, old_shard: str, shards: int = 16, id_col: str = "doc_id", text_col: str = "text", out_dir: str | None = None) -> DataFrame:
    """Moves the rows of docs from the shards numbered in old_shard into `shards` new ones of near-equal bytes.

    The bytes that leave the shard of their number are the fewest for which the new shards' sizes are
    equal. Old shards whose number is null, negative or no new shard's are one sequence in the flow
    problem, in the order of a hash of their numbers in BUCKETS buckets. Writes the rows of every affected new shard below out_dir (partitioned by `shard`) and returns
    (doc_id, text, size, shard, slot) read back from those files, with the rows of shards that keep
    exactly their old content taken from docs. `slot` counts from 0 without gaps inside a shard. A
    row's size is its text's UTF-8 bytes plus 1 (null text: 1). Rows are placed one by one: repeated
    rows and null ids are placed like any other, and as only equal rows tie, reruns agree; other
    columns of docs are not read. A row that straddles a cut goes where its middle lies, so a new shard
    differs from its capacity by half a row a cut. No rows: an empty result.
    """
    spark = docs.sparkSession
    number = F.col(old_shard).cast("long")
    home = F.when(number.between(0, shards - 1), number).otherwise(shards).cast("int")
    bucket = F.when(home == shards, F.pmod(F.xxhash64(F.coalesce(number, F.lit(-1))), F.lit(BUCKETS))).otherwise(0).cast("int")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), home.alias("old"), bucket.alias("bucket"), F.xxhash64(F.col(id_col).cast("long"), text_col).alias("mark")).withColumn("size", utf8_len(F.col("text")) + 1)
    rows = numbered_copies(rows, COPIES)
    slim = saved(rows.drop("text"))
    per_bucket = slim.groupBy("old", "bucket").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("n")).collect()  # shards + BUCKETS rows at most
    most = max((r["n"] for r in per_bucket), default=1)
    n_blocks = max(1, math.ceil(most / block_rows(most)))
    sizes: dict[int, int] = {}
    for r in per_bucket:
        sizes[r["old"]] = sizes.get(r["old"], 0) + r["bytes"]
    moves = plan_transfers(sizes, even_capacities(sum(sizes.values()), shards))
    cuts = F.broadcast(spark.createDataFrame(moves or [(0, 0, 0, 0)], "old int, lo long, hi long, shard int"))  # 2 * shards + 1 rows, about
    whole = [j for j in range(shards) if [(o, k) for o, _, _, k in moves if j in (o, k)] == [(j, j)]]
    parts = parts_for(spark, sum(sizes.values()))

    block = F.pmod(F.xxhash64("mark", "copy"), F.lit(n_blocks))
    group = ["old", "bucket", "block"]
    in_block = W.partitionBy(*group).orderBy("doc_id", "size", "mark", "copy")

    def placed(rows: DataFrame, blocks: DataFrame) -> DataFrame:
        """A row goes where the middle of its bytes lies."""
        at = rows.withColumn("block", block).repartition(parts, *group).join(blocks, group).withColumn("mid2", 2 * (F.col("before") + F.sum("size").over(in_block.rowsBetween(W.unboundedPreceding, 0))) - F.col("size"))
        return at.join(cuts, "old").where((F.col("mid2") > 2 * F.col("lo")) & (F.col("mid2") <= 2 * F.col("hi")))

    def summed(of: DataFrame, what: str, within: str, as_: str) -> DataFrame:
        """The sum of `what` over all blocks before each one, inside a bucket first and then over buckets: a window holds n_blocks or a few hundred rows."""
        by = list(dict.fromkeys([within, "old", "bucket"]))
        of = of.withColumn(as_, F.sum(what).over(W.partitionBy(*by).orderBy("block")) - F.col(what))
        buckets = of.groupBy(*by).agg(F.sum(what).alias("all"))
        buckets = buckets.withColumn("ahead", F.sum("all").over(W.partitionBy(within).orderBy("old", "bucket")) - F.col("all")).drop("all")
        return of.join(buckets, by).withColumn(as_, F.col(as_) + F.col("ahead")).drop("ahead")

    sums = slim.withColumn("block", block).groupBy(*group).agg(F.sum("size").alias("bytes"))
    before = summed(sums, "bytes", "old", "before").select(*group, "before")
    runs = saved(placed(slim, before).groupBy(*group, "before", "shard").agg(F.count(F.lit(1)).alias("n")))
    first = summed(runs, "n", "shard", "first")
    # a block's rows go to `shards` shards at most
    blocks = first.groupBy(*group, "before").agg(F.map_from_entries(F.collect_list(F.struct("shard", "first"))).alias("firsts"))
    slot = F.try_element_at("firsts", F.col("shard")) + F.row_number().over(W.partitionBy(*group, "shard").orderBy("doc_id", "size", "mark", "copy")) - 1
    out = placed(rows, blocks).withColumn("slot", slot).select("doc_id", "text", "size", "slot", "shard")
    out_dir = out_dir or shared_dir(spark)
    (out.where(~F.col("shard").isin(whole)) if whole else out).write.partitionBy("shard").parquet(out_dir)
    files = spark.read.schema("doc_id long, text string, size long, slot long, shard int").parquet(out_dir)
    return files.union(out.where(F.col("shard").isin(whole))) if whole else files


def with_file_numbers(docs: DataFrame, file_col: str, shards: int) -> DataFrame:
    """docs with old_shard: the rank of the file's name if it is one of the first `shards`, else a number of its own beyond them."""
    names = [r[0] for r in docs.select(file_col).distinct().orderBy(file_col).limit(shards).collect()]
    rank = F.coalesce(*(F.when(F.col(file_col) == n, k) for k, n in enumerate(names)), F.lit(None).cast("int")) if names else F.lit(None)
    return docs.withColumn("old_shard", F.coalesce(rank.cast("long"), shards + F.pmod(F.xxhash64(file_col), F.lit(1 << 40))))


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, from the files they lie in into 16 shards; the first 16 files by name are the old shards of those numbers."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1).alias("file"))
    out = reshard(with_file_numbers(docs, "file", 16), "old_shard", 16)
    return out.select("doc_id", "size", F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"), F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
