"""Token counts with a digest cache.

The cache is a Parquet table of (text digest, count) for each tokenizer version, itself a digest of the
vocabulary file. Digests of the texts are joined to it, only distinct misses are encoded, and their
counts are appended.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ENCODE_BATCH_ROWS, digest, encode_ids16, map_arrow, saved, shared_dir, table, tokenizer_path, utf8_len

TOKENIZER = "byte_bpe_50k.json"
LIMIT = 512
CACHE_SCHEMA = "digest binary, n_tokens long"


def tokenizer_version(tokenizer: str) -> str:
    with open(tokenizer_path(tokenizer), "rb") as f:
        return hashlib.sha256(f.read()).hexdigest()[:16]


def _count(tokenizer: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("digest"), pa.array([len(x) // 2 for x in encode_ids16(tokenizer, b.column("text"))], pa.int64())], names=["digest", "n_tokens"])

    return run


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def token_counts(docs: DataFrame, cache_dir: str | None = None, tokenizer: str = TOKENIZER, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_tokens) for each row of docs; the cache below cache_dir has all its digests afterwards.

    Content is normalised by taking null as empty and by nothing else, as anything more could change a
    count. The text of a miss comes from the row with the smallest id that has it; among rows that
    share that id, each counts for its own digest. Rows without id are handled like others. Only
    id_col and text_col are read. No rows: an empty result.
    """
    spark = docs.sparkSession
    path = f"{cache_dir or shared_dir(spark)}/tokenizer={tokenizer_version(tokenizer)}"
    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    keys = d.select("doc_id", digest(F.col("text")).alias("digest"), utf8_len(F.col("text")).alias("n_bytes"))
    misses = keys.groupBy("digest").agg(F.min(F.coalesce("doc_id", F.lit(-(2**63) + 1))).alias("rep"))
    warm = _exists(spark, path)
    if warm:
        wanted = misses = saved(misses)
        misses = misses.join(spark.read.schema(CACHE_SCHEMA).parquet(path), "digest", "left_anti")
    texts = d.withColumn("rep", F.coalesce("doc_id", F.lit(-(2**63) + 1))).join(misses.withColumnRenamed("digest", "wanted"), "rep")
    texts = texts.withColumn("digest", digest(F.col("text"))).where("digest = wanted").select("digest", "text")
    map_arrow(texts, _count(tokenizer), CACHE_SCHEMA, ENCODE_BATCH_ROWS).write.mode("append").parquet(path)
    # only what was asked for; a repeated row, or a job that ran twice, may have stored a digest more than once
    asked = spark.read.schema(CACHE_SCHEMA).parquet(path).join(wanted, "digest", "left_semi") if warm else spark.read.schema(CACHE_SCHEMA).parquet(path)
    stored = saved(asked.groupBy("digest").agg(F.max("n_tokens").alias("n_tokens")))  # written, so that Spark can split a hot digest in the join
    return keys.join(stored, "digest").select("doc_id", "n_bytes", "n_tokens")


def token_counts_warm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, n_bytes, n_tokens) of all documents from a cache that a first run has filled: the second encodes nothing."""
    cache, docs = shared_dir(spark), table(spark, sf_dir, "documents")
    token_counts(docs, cache)
    return token_counts(docs, cache)


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = token_counts(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > LIMIT).alias("over_limit"))
