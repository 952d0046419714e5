"""Run events as streams: first sightings, counts by window, sessions, budgets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.fixpoint import scratch

EVENT_KINDS = ("step_start", "paper_added", "step_end", "paper_rejected", "shape_table_update", "hitl_request")


def event_stream(spark: SparkSession, path: str, schema: str, files_per_trigger: int = 1000) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def first_seen(events: DataFrame, *keys: str, at: str = "ts", delay: str = "1 hour") -> DataFrame:
    """The first event of each key; state of a key is kept for `delay` of event time."""
    return events.withWatermark(at, delay).dropDuplicatesWithinWatermark(list(keys))


def tumbling(events: DataFrame, width: str, *keys: str, at: str = "ts", delay: str = "1 hour") -> DataFrame:
    w = F.window(at, width)
    return events.withWatermark(at, delay).groupBy(w, *keys).agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("start"), *keys, "n")


def sliding(events: DataFrame, width: str, step: str, *keys: str, at: str = "ts", delay: str = "1 hour") -> DataFrame:
    w = F.window(at, width, step)
    return events.withWatermark(at, delay).groupBy(w, *keys).agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("start"), *keys, "n")


def sessions(events: DataFrame, gap: str, *keys: str, at: str = "ts", delay: str = "1 hour") -> DataFrame:
    w = F.session_window(at, gap)
    return events.withWatermark(at, delay).groupBy(w, *keys).agg(F.count(F.lit(1)).alias("n")).select(F.col("session_window.start").alias("start"), *keys, "n")


def run_to_table(stream: DataFrame, mode: str = "append") -> DataFrame:
    """All that is available now, written exactly once to a folder and read from there."""
    spark = stream.sparkSession
    base = scratch(spark)
    stream.writeStream.format("parquet").outputMode(mode).option("path", f"{base}/out").option("checkpointLocation", f"{base}/check").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{base}/out")


def run_complete(stream: DataFrame) -> DataFrame:
    """The final state of an aggregation: each batch overwrites the last one's table."""
    spark = stream.sparkSession
    base = scratch(spark)

    def keep(batch: DataFrame, k: int) -> None:
        batch.write.mode("overwrite").parquet(f"{base}/out")

    stream.writeStream.foreachBatch(keep).outputMode("complete").option("checkpointLocation", f"{base}/check").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{base}/out")
