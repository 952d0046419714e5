"""Label answers and budgets over restarted streams, and the paged source."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from lodestar.sources import paged
from lodestar.streaming import gates


def at(minute):
    return dt.datetime(2024, 1, 1) + dt.timedelta(minutes=minute)


class Feed:
    """A folder to which a test adds files, and the stream of it."""

    def __init__(self, spark, folder, schema):
        self.spark, self.path, self.schema = spark, f"{folder}", schema
        spark.createDataFrame([], schema).write.parquet(self.path)

    def add(self, *rows):
        self.spark.createDataFrame(list(rows), self.schema).coalesce(1).write.mode("append").parquet(self.path)

    def stream(self):
        return self.spark.readStream.schema(self.schema).parquet(self.path)


def run(stream, out):
    """Whatever is there now, from the checkpoint of the last call on."""
    stream.writeStream.format("parquet").option("path", f"{out}/rows").option("checkpointLocation", f"{out}/check").trigger(availableNow=True).start().awaitTermination()


def test_labels_in_time_late_and_missing(spark, tmp_path):
    samples = Feed(spark, tmp_path / "s", "sample_id long, key long, asked timestamp")
    labels = Feed(spark, tmp_path / "l", "key long, label string, labelled timestamp")
    stream = lambda: gates.label_answers(samples.stream(), labels.stream(), "60 minutes", "10 minutes")
    samples.add((1, 10, at(0)), (2, 20, at(5)), (3, 30, at(6)))
    labels.add((10, "yes", at(30)), (10, "no", at(20)), (20, "early", at(1)))
    run(stream(), tmp_path / "out")
    samples.add((4, 40, at(200)))
    labels.add((40, "yes", at(210)))
    run(stream(), tmp_path / "out")
    labels.add((20, "too late", at(50)), (99, "x", at(220)))  # within the sample's hour, but after the watermark has passed it
    samples.add((5, 50, at(230)))
    run(stream(), tmp_path / "out")
    got = {r["sample_id"]: (r["label"], r["timed_out"]) for r in gates.first_answers(spark.read.parquet(f"{tmp_path}/out/rows")).collect()}
    assert got == {1: ("no", False), 2: (None, True), 3: (None, True), 4: ("yes", False)}


def test_budget_survives_a_restart(spark, tmp_path):
    calls = Feed(spark, tmp_path / "c", "run long, call_id long, at timestamp, tokens long")
    stream = lambda: gates.budget_stream(calls.stream(), 100, 4)
    calls.add((1, 2, at(2), 50), (1, 1, at(1), 30), (2, 1, at(0), 10), (2, 2, at(1), None))
    run(stream(), tmp_path / "out")
    calls.add((1, 3, at(3), 20), (2, 3, at(4), 1), (2, 4, at(5), 1), (3, 1, at(5), 500))
    run(stream(), tmp_path / "out")
    got = {(r["run"], r["call_id"]): (r["used"], r["requests"], r["spent"]) for r in spark.read.parquet(f"{tmp_path}/out/rows").collect()}
    assert got == {(1, 1): (30, 1, False), (1, 2): (80, 2, False), (1, 3): (100, 3, True), (2, 1): (10, 1, False), (2, 2): (10, 2, False), (2, 3): (11, 3, False), (2, 4): (12, 4, True), (3, 1): (500, 1, True)}


@pytest.fixture(scope="module")
def dump(spark, tmp_path_factory):
    path = f"file://{tmp_path_factory.mktemp('pages')}/dump"
    rows = [(k, i, f"t{k}.{i}") for k in range(6) for i in range(7 * k % 25)] + [(None, 1, "n")]
    paged.write_pages(spark.createDataFrame(rows, "paper long, ref long, note string").where("paper is not null").repartition(3), path, "paper", "ref", page_size=4)
    return path, [r for r in rows if r[0] is not None]


def test_pages_give_back_all_rows(spark, dump):
    path, rows = dump
    assert sorted(tuple(r) for r in paged.read_pages(spark, path, 4).select("paper", "ref", "note", "offset").collect()) == sorted((*r, r[1]) for r in rows)
    assert {tuple(r) for r in paged.read_pages(spark, path, 4, max_items=5).select("paper", "ref").collect()} == {r[:2] for r in rows if r[1] < 5}


def test_filters_choose_the_pages(spark, dump):
    from pyspark.sql.datasource import EqualTo, GreaterThan, LessThan

    path, rows = dump
    df = paged.read_pages(spark, path, 4)
    assert {tuple(r) for r in df.where("offset < 6 and offset > 1 and paper = 3").select("paper", "offset").collect()} == {(3, i) for i in range(2, 6)}
    r = paged.PagedReader(df.schema, {"path": path, "page_size": "4"})
    assert {p.page for p in r.partitions()} == {0, 1, 2, 3, 4, 5}
    left = list(r.pushFilters([LessThan(("offset",), 6), GreaterThan(("offset",), 3), EqualTo(("paper",), 3)]))
    assert len(left) == 1 and {p.page for p in r.partitions()} == {1}
    assert paged.PagedReader(df.schema, {"path": path, "page_size": "4", "max_items": "8"}).partitions()[-1].page == 1
    assert df.where(F.col("offset") > 1000).count() == 0
