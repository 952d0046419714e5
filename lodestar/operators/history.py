"""A run's history as data: budgets, agreement with reviewers, rejection ledgers, outage breaker, caches."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .fixpoint import materialised, numbered

#: Dollars for a million input, output and reasoning tokens, by model name prefix; GENERIC for others.
GENERIC = (0.30, 2.50, 2.50)
#: Calls of a source that are searched together.
BLOCK = 4096


def priced(calls: DataFrame, prices: dict[str, tuple[float, float, float]]) -> DataFrame:
    """calls (model, input_tokens, output_tokens, reasoning_tokens) with cost_usd by the longest price prefix of the model's name."""
    spark = calls.sparkSession
    rows = [(k, *map(float, v)) for k, v in prices.items() if k not in ("GENERIC", "stub")]
    table = F.broadcast(spark.createDataFrame(rows or [("\0", *GENERIC)], "prefix string, p_in double, p_out double, p_reason double"))
    models = calls.select("model").distinct().join(table, F.col("model").startswith(F.col("prefix")))
    best = models.groupBy("model").agg(F.max_by(F.struct("p_in", "p_out", "p_reason"), F.length("prefix")).alias("p"))
    g = prices.get("GENERIC", GENERIC)
    rate = lambda k, i: F.coalesce(F.col("p")[k], F.lit(float(g[i])))
    usd = (F.col("input_tokens") * rate("p_in", 0) + F.col("output_tokens") * rate("p_out", 1) + F.col("reasoning_tokens") * rate("p_reason", 2)) / 1e6
    return calls.join(best, "model", "left").withColumn("cost_usd", usd).drop("p")


def budget_by(calls: DataFrame, *keys: str) -> DataFrame:
    return calls.groupBy(*keys).agg(F.count(F.lit(1)).alias("calls"), F.sum("input_tokens").alias("input_tokens"), F.sum("output_tokens").alias("output_tokens"))


def budget_gate(calls: DataFrame, tokens: int, by: str = "at") -> DataFrame:
    """calls with `used`, the tokens up to and with each call of its run, and whether the budget is `spent`.

    A run's calls are one window; runs are the partitions.
    """
    w = W.partitionBy("run").orderBy(by, "call_id").rowsBetween(W.unboundedPreceding, 0)
    return calls.withColumn("used", F.sum(F.col("input_tokens") + F.col("output_tokens")).over(w)).withColumn("spent", F.col("used") >= tokens)


def agreement(screened: DataFrame, labels: DataFrame) -> DataFrame:
    """(filter, n, agreement, low): how often a filter's verdict is the reviewer's, over papers it saw that are labelled."""
    j = screened.join(labels.select("paper_id", "keep"), "paper_id")
    a = F.avg((F.col("accepted") == F.col("keep")).cast("int"))
    return j.groupBy("filter").agg(F.count(F.lit(1)).alias("n"), a.alias("agreement")).withColumn("low", F.col("agreement") < 0.5)


def rejection_ledger(rejected: DataFrame, papers: DataFrame) -> DataFrame:
    """(paper_id, title, year, categories): each rejected paper's categories in order, once each."""
    c = rejected.groupBy("paper_id").agg(F.sort_array(F.collect_set(F.struct("seq", "category"))).alias("s"))
    c = c.select("paper_id", F.array_distinct(F.transform("s", lambda x: x["category"])).alias("categories"))
    return c.join(papers.select("paper_id", F.left(F.coalesce("title", F.lit("")), F.lit(200)).alias("title"), "year"), "paper_id", "left")


def breaker(calls: DataFrame, limit: int = 10) -> DataFrame:
    """calls (source, call_id, ok) with `streak`, failures in a row, and `open` once a streak has reached the limit.

    A streak is how far a call is from its source's last success, or start; a call of unknown outcome counts
    as a failure. The calls of a source are searched in blocks of BLOCK, then the blocks, so that one source
    may hold most calls.
    """
    c = numbered(calls, "source", "call_id")
    first = c.groupBy("source").agg(F.min("pos").alias("_first"))
    c = materialised(_with(c, first, "source").withColumn("_block", F.floor((F.col("pos") - F.col("_first")) / BLOCK)))
    good = F.when(F.col("ok"), F.col("pos"))
    blocks = c.groupBy("source", "_block").agg(F.max(good).alias("_good"))
    upto = W.partitionBy("source").orderBy("_block").rowsBetween(W.unboundedPreceding, -1)
    blocks = blocks.select("source", "_block", F.max("_good").over(upto).alias("_before"))
    inside = F.max(good).over(W.partitionBy("source", "_block").orderBy("pos").rowsBetween(W.unboundedPreceding, 0))
    s = _with(c.withColumn("_good", inside), blocks, "source", "_block")
    s = s.withColumn("streak", F.col("pos") - F.coalesce(F.greatest("_good", "_before"), F.col("_first") - 1))
    opens = s.where(F.col("streak") >= limit).groupBy("source").agg(F.min("pos").alias("_open"))
    s = _with(s, opens, "source").withColumn("open", F.coalesce(F.col("pos") >= F.col("_open"), F.lit(False)))
    return s.select(*calls.columns, "streak", "open")


def _with(df: DataFrame, few: DataFrame, *keys: str) -> DataFrame:
    """df with few's other columns, null keys being equal."""
    f = few.withColumnsRenamed({k: f"_of_{k}" for k in keys})
    on = [F.col(k).eqNullSafe(F.col(f"_of_{k}")) for k in keys]
    return df.join(f, on, "left").drop(*(f"_of_{k}" for k in keys))


def cache_hits(requests: DataFrame, cache: DataFrame) -> DataFrame:
    """(bucket, requests, hits): requests (bucket, key) found in cache (bucket, key)."""
    c = cache.select("bucket", "key", F.lit(1).alias("hit")).distinct()
    return requests.join(c, ["bucket", "key"], "left").groupBy("bucket").agg(F.count(F.lit(1)).alias("requests"), F.count("hit").alias("hits"))


def review_corpus(extractions: DataFrame) -> DataFrame:
    """(pos, paper_id, block): papers numbered by id for a synthesis, `[n] title` and its extraction each."""
    e = numbered(extractions.select("paper_id", "title", "body"), "paper_id", "title", "body")
    return e.withColumn("pos", (F.col("pos") + 1).cast("int")).select("pos", "paper_id", F.concat(F.lit("["), F.col("pos").cast("string"), F.lit("] "), F.coalesce("title", F.lit("")), F.lit("\n"), F.coalesce("body", F.lit(""))).alias("block"))


def fetch_stats(results: DataFrame) -> DataFrame:
    return results.groupBy("status").agg(F.count(F.lit(1)).alias("n"))
