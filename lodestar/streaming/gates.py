"""Decisions that wait for other events: review labels for the samples they answer, and calls for a run's budget."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

#: The store that keyed state of any form needs.
STATE_STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def label_answers(samples: DataFrame, labels: DataFrame, wait: str, delay: str = "1 hour") -> DataFrame:
    """(sample_id, key, asked, label, labelled) as a stream: each sample with the labels given for its key within `wait`.

    samples: (sample_id, key, asked); labels: (key, label, labelled). A sample that nobody labelled comes
    once, with a null label, when the watermark has passed its time; a label after that finds it gone. Both sides
    keep state for `wait` and `delay` of event time and no longer.
    """
    s = samples.withWatermark("asked", delay).alias("s")
    a = labels.withWatermark("labelled", delay).alias("a")
    within = F.expr(f"s.key = a.key and labelled >= asked and labelled <= asked + interval {wait}")
    return s.join(a, within, "left").select("sample_id", F.col("s.key").alias("key"), "asked", "label", "labelled")


def first_answers(answers: DataFrame) -> DataFrame:
    """One row a sample: its first label, or that it timed out."""
    return answers.groupBy("sample_id", "key", "asked").agg(F.min(F.struct("labelled", "label")).alias("a")).select("sample_id", "key", "asked", "a.label", F.col("a.labelled").isNull().alias("timed_out"))


class _Budget(StatefulProcessor):
    """Running sums of a run's tokens and requests; a call is allowed while both are below their caps."""

    def __init__(self, tokens: int, requests: int | None):
        self.tokens, self.requests = tokens, requests

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.sums = handle.getValueState("sums", "tokens long, requests long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        f = pd.concat(rows).sort_values(["at", "call_id"], kind="stable")
        tokens, requests = self.sums.get() if self.sums.exists() else (0, 0)
        used = tokens + f["tokens"].fillna(0).astype("int64").cumsum()
        made = requests + pd.Series(range(1, len(f) + 1), index=f.index, dtype="int64")
        spent = used >= self.tokens
        if self.requests is not None:
            spent |= made >= self.requests
        self.sums.update((int(used.iloc[-1]), int(made.iloc[-1])))
        yield pd.DataFrame({"run": key[0], "call_id": f["call_id"], "used": used, "requests": made, "spent": spent})

    def close(self) -> None:
        pass


def budget_stream(calls: DataFrame, tokens: int, requests: int | None = None) -> DataFrame:
    """(run, call_id, used, requests, spent) as a stream from calls (run long, call_id long, at, tokens).

    The state of a run is two numbers, which survive a restart from the checkpoint. Calls of one batch count
    in the order of `at` and call_id, later batches after them. A batch's calls of one run are held by one task.
    """
    calls.sparkSession.conf.set(*STATE_STORE)
    c = calls.select("run", "call_id", "at", "tokens")
    return c.groupBy("run").transformWithStateInPandas(_Budget(tokens, requests), "run long, call_id long, used long, requests long, spent boolean", "Append", "None")
