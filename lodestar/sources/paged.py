"""Paged lists as a Spark data source: one input partition per range of pages, and what a filter or a limit rules out is never asked for.

A service that lists the references or citers of a paper hands them out in pages of a fixed size. A dump
of such answers is a folder `page=K` for the K-th page of every list, each row with its `offset` in its
list. `spark.read.format("paged")` reads it with the options

    path        the folder, of any file system that pyarrow knows
    page_size   rows of a page
    max_items   rows of each list at most: pages beyond it are not read
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.dataset as ds
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual
from pyspark.sql.types import StructType

from ..operators.fixpoint import materialised, numbered

#: Fixed value: rows of a page of the services.
PAGE_SIZE = 1000


@dataclass
class Pages(InputPartition):
    page: int
    files: list[str]


class PagedReader(DataSourceReader):
    def __init__(self, schema: StructType, options: dict[str, str]):
        self.schema = schema
        self.path = options["path"]
        self.size = int(options.get("page_size", PAGE_SIZE))
        self.low, self.high = 0, int(options["max_items"]) if "max_items" in options else None  # offsets wanted: low <= offset < high
        self.key: dict[str, object] = {}

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Bounds of offset choose the pages, equal keys the rows that are decoded; all other filters stay with Spark."""
        for f in filters:
            at = f.attribute if isinstance(f, (EqualTo, LessThan, LessThanOrEqual, GreaterThan, GreaterThanOrEqual)) else ()
            if at == ("offset",) and isinstance(f.value, int):
                if isinstance(f, (LessThan, LessThanOrEqual, EqualTo)):
                    top = f.value + (not isinstance(f, LessThan))
                    self.high = top if self.high is None else min(self.high, top)
                if isinstance(f, (GreaterThan, GreaterThanOrEqual, EqualTo)):
                    self.low = max(self.low, f.value + isinstance(f, GreaterThan))
            elif len(at) == 1 and isinstance(f, EqualTo):
                self.key[at[0]] = f.value
                yield f  # two values for one key leave nothing, which Spark sees to
            else:
                yield f

    def partitions(self) -> Sequence[InputPartition]:
        fs, root = pafs.FileSystem.from_uri(self.path)
        pages = []
        for folder in fs.get_file_info(pafs.FileSelector(root)):
            if folder.type == pafs.FileType.Directory and folder.base_name.startswith("page="):
                k = int(folder.base_name.removeprefix("page="))
                if (self.high is None or k * self.size < self.high) and (k + 1) * self.size > self.low:
                    for f in sorted(x.path for x in fs.get_file_info(pafs.FileSelector(folder.path)) if x.path.endswith(".parquet")):
                        pages.append(Pages(k, [f]))
        return sorted(pages, key=lambda p: (p.page, p.files)) or [Pages(0, [])]

    def read(self, partition: Pages) -> Iterator[pa.RecordBatch]:
        fs, _ = pafs.FileSystem.from_uri(self.path)
        names = self.schema.names
        keep = ds.field("offset") >= self.low
        if self.high is not None:
            keep &= ds.field("offset") < self.high
        for name, value in self.key.items():
            keep &= ds.field(name) == value
        for f in partition.files:
            for b in ds.dataset(f, filesystem=fs, format="parquet").to_batches(columns=names, filter=keep):
                if b.num_rows:
                    yield b


class PagedSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "paged"

    def schema(self) -> str:
        """The columns that the dump's note names."""
        fs, root = pafs.FileSystem.from_uri(self.options["path"])
        with fs.open_input_stream(f"{root}/_columns.json") as f:
            return json.loads(f.read())["schema"]

    def reader(self, schema: StructType) -> PagedReader:
        return PagedReader(schema, dict(self.options))


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(PagedSource)


def write_pages(rows: DataFrame, path: str, key: str, *order: str, page_size: int = PAGE_SIZE) -> None:
    """Dumps the lists of rows, one for each key in the order given, as pages below path.

    Offsets come from numbers in a total order, so a list of any length is numbered by many tasks.
    """
    pos = materialised(numbered(rows, key, *order))
    first = pos.groupBy(key).agg(F.min("pos").alias("first"))
    listed = pos.join(first, key).select(*rows.columns, (F.col("pos") - F.col("first")).alias("offset"))
    listed = listed.withColumn("page", F.floor(F.col("offset") / page_size))
    parts = max(1, math.ceil(pos.count() / 1_000_000))
    spread = F.pmod(F.xxhash64(key), F.lit(parts))  # files of about a million rows
    listed.repartition("page", spread).write.partitionBy("page").parquet(path)
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in listed.drop("page").schema)
    fs, root = pafs.FileSystem.from_uri(path)
    with fs.open_output_stream(f"{root}/_columns.json") as f:
        f.write(json.dumps({"schema": columns}).encode())


def read_pages(spark: SparkSession, path: str, page_size: int = PAGE_SIZE, max_items: int | None = None) -> DataFrame:
    register(spark)
    r = spark.read.format("paged").option("path", path).option("page_size", str(page_size))
    return (r.option("max_items", str(max_items)) if max_items is not None else r).load()
