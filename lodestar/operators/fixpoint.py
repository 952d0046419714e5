"""Iteration of DataFrame steps to a fixpoint, with the lineage cut by tables in the shared folder."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


@lru_cache(maxsize=1)
def _local_dir() -> str:
    return "file://" + tempfile.mkdtemp(prefix="lodestar-")


def scratch(spark: SparkSession) -> str:
    """A new path below spark.checkpoint.dir; where that is unset a session in local mode takes a folder of its one machine, and a cluster is an error."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = _local_dir()
    return f"{base.rstrip('/')}/step-{uuid.uuid4().hex}"


def materialised(df: DataFrame) -> DataFrame:
    """df written and read again: what follows does not repeat its plan, and a lost executor loses none of it."""
    path = scratch(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def numbered(df: DataFrame, *order: str | Column, name: str = "pos") -> DataFrame:
    """df with name, the number of each row from 0 in the order given, which must be total for reruns to agree.

    Rows are sorted by ranges and numbered inside them, so no task sees all; one row a range reaches the driver.
    """
    spark = df.sparkSession
    s = df.orderBy(*order).withColumn("_part", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1))
    s = materialised(s)
    start, before = [], 0
    for r in s.groupBy("_part").agg(F.count(F.lit(1)).alias("n")).orderBy("_part").collect():
        start.append((r["_part"], before))
        before += r["n"]
    starts = spark.createDataFrame(start, "_part int, _start long")  # a row for each range
    return s.join(F.broadcast(starts), "_part").withColumn(name, F.col("_start") + F.col("_at")).drop("_part", "_at", "_start")


def quantile(df: DataFrame, column: str, q: float) -> float | None:
    """The value at the share q of the sorted column, between two values in proportion; nulls do not count, without any value it is None.

    Equal values are counted before they are sorted by ranges. One row a range, and one or two values, reach the driver;
    running sums are taken in the range that holds the place.
    """
    counts = df.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("x")).agg(F.count(F.lit(1)).alias("n"))
    s = materialised(counts.orderBy("x").withColumn("part", F.spark_partition_id()))
    parts = s.groupBy("part").agg(F.sum("n").alias("n")).orderBy("part").collect()
    place = (sum(r["n"] for r in parts) - 1) * q
    if place < 0:
        return None

    def at(k: int) -> float:
        before = 0
        for r in parts:
            if k < before + r["n"]:
                upto = F.sum("n").over(W.orderBy("x").rowsBetween(W.unboundedPreceding, 0))
                return s.where(F.col("part") == r["part"]).withColumn("upto", upto).where(F.col("upto") > k - before).agg(F.min("x")).first()[0]
            before += r["n"]
        raise AssertionError("k is a place among the rows")

    low = at(int(place))
    return float(low) if place == int(place) else float(low + (at(int(place) + 1) - low) * (place - int(place)))


def fixpoint(start: DataFrame, step: Callable[[DataFrame], DataFrame], mark: Callable[[DataFrame], tuple] | None = None, most: int = 10_000) -> DataFrame:
    """step applied until the mark (by default a row count and hash sum) stays."""
    mark = mark or signature
    now = materialised(start)
    before = mark(now)
    for _ in range(most):
        now = materialised(step(now))
        after = mark(now)
        if after == before:
            return now
        before = after
    raise RuntimeError("no fixpoint was reached")


#: Edges that one task takes, once rounds have left no more of a graph: two columns of a megabyte each.
REST = 131_072


def in_one_task(df: DataFrame, run: Callable[[pd.DataFrame], pd.DataFrame], schema: str, beside: DataFrame | None = None) -> DataFrame:
    """run over all rows of df, and of another table beside it, in one task: for the rest of a graph, of REST edges at most."""
    one = df.withColumn("one", F.lit(0)).groupBy("one")
    if beside is None:
        return one.applyInPandas(lambda x: run(x.drop(columns="one")), schema)
    other = beside.withColumn("one", F.lit(0)).groupBy("one")
    return one.cogroup(other).applyInPandas(lambda x, y: run(x.drop(columns="one"), y.drop(columns="one")), schema)


def signature(df: DataFrame) -> tuple:
    return tuple(df.agg(F.count(F.lit(1)), F.sum(F.xxhash64(*df.columns).cast("decimal(38,0)"))).first())
