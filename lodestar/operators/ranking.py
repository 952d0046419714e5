"""Reranking and stratified top-k."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def rerank(signal: DataFrame, scores: DataFrame, k: int) -> DataFrame:
    """The k best of signal (paper_id, ord) by scores (paper_id, score); unknown scores are 0, ties keep the order."""
    s = signal.join(scores.select("paper_id", "score"), "paper_id", "left").withColumn("score", F.coalesce("score", F.lit(0)))
    return s.orderBy(F.desc("score"), "ord", "paper_id").limit(k)


def largest_remainder(slots: int, weights: list[int], caps: list[int]) -> list[int]:
    """Slots shared out by weight: whole shares first (up to the caps), then one each by falling fraction, in rounds."""
    total = sum(weights)
    if slots <= 0 or total <= 0:
        return [0] * len(weights)
    got = [min(w * slots // total, c) for w, c in zip(weights, caps)]
    by_fraction = sorted(range(len(weights)), key=lambda i: -((weights[i] * slots) % total))
    left = slots - sum(got)
    while left > 0 and (open_ := [i for i in by_fraction if got[i] < caps[i]]):
        for i in open_[:left]:
            got[i] += 1
        left = slots - sum(got)
    return got


def diverse_top_k(signal: DataFrame, k: int, noise: int = -1) -> DataFrame:
    """(paper_id, cid, score) of a stratified top k of signal (paper_id, cid, score).

    With no more slots than clusters the k largest get one each; else each has one and the rest goes by
    size, by largest remainders. What is left is filled by score from all, noise included. One row a
    cluster comes to the driver.
    """
    s = signal.select("paper_id", "cid", F.coalesce("score", F.lit(0)).alias("score"))
    sizes = s.where(F.col("cid") != noise).groupBy("cid").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "cid").collect()
    spark = signal.sparkSession
    if k <= len(sizes):
        slots = {r["cid"]: 1 for r in sizes[:k]}
    else:
        extra = largest_remainder(k - len(sizes), [r["n"] for r in sizes], [r["n"] - 1 for r in sizes])
        slots = {r["cid"]: 1 + x for r, x in zip(sizes, extra)}
    q = spark.createDataFrame([(int(c), n) for c, n in slots.items()] or [(noise, 0)], "slot_cid long, slots long")
    r = s.join(F.broadcast(q), F.col("cid") == F.col("slot_cid"), "left")
    # of a cluster at most as many as it has slots; of all others at most k by score
    rank = F.row_number().over(W.partitionBy("cid").orderBy(F.desc("score"), "paper_id"))
    chosen = r.where("slots is not null").withColumn("rank", rank).where("rank <= slots").select("paper_id", "cid", "score")
    short = k - sum(slots.values())
    if short <= 0:
        return chosen
    return chosen.union(s.join(chosen.select("paper_id"), "paper_id", "left_anti").orderBy(F.desc("score"), "paper_id").limit(short))


def hitl_sample(screened: DataFrame, k: int, seed: str = "0") -> DataFrame:
    """(paper_id, accepted, category) for human review: half rejected, dealt round-robin over the categories, the rest accepted.

    screened has paper_id, accepted, category. The order inside a category is that of a digest of seed and
    id, so that it can be repeated anywhere.
    """
    key = F.md5(F.concat(F.lit(seed + ":"), F.col("paper_id").cast("string")).cast("binary"))
    s = screened.select("paper_id", "accepted", "category", key.alias("h"))
    turn = F.row_number().over(W.partitionBy("category").orderBy("h", "paper_id"))
    no = s.where("not accepted").withColumn("turn", turn).where(F.col("turn") <= k // 2).orderBy("turn", "category").limit(k // 2).drop("turn")
    yes = s.where("accepted").orderBy("h", "paper_id").limit(k - k // 2)
    return no.union(yes).drop("h")
