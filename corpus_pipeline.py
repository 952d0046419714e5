"""The corpus pipeline: language ID, near duplicates, personal data, source mix and packing.

Each stage takes what its predecessor kept, written as Parquet and read again, and all but the last
return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.llm import language_id, mixing, ngram_join, packing, pii
from lodestar.llm.common import saved, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _documents(docs: DataFrame) -> DataFrame:
    """The columns of documents, in their order; further columns do not go on."""
    return docs.select(*COLUMNS)


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with null text or without a letter go. The others stay, also if nothing could be learned; a null lang becomes the predicted one."""
    docs = _documents(docs)
    found = language_id.predict(docs, language_id.learn(docs))
    kept = found.where((F.col("lang_pred") != "und") | F.col("text").rlike(r"\p{L}"))
    return kept.withColumn("lang", F.coalesce("lang", F.nullif("lang_pred", F.lit("und")))).select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group that links of five-word shingles at a similarity of 0.8 tie, the smallest doc_id stays.

    Repeated rows of a doc_id are one document, of which one row stays. Rows without doc_id take no part and stay.
    """
    docs = _documents(docs)
    groups = ngram_join.similar_groups(docs, n=5, num=80, den=100)
    kept = groups.where("doc_id = component_id").select("doc_id").distinct()
    return docs.where("doc_id is not null").join(kept, "doc_id", "left_semi").dropDuplicates(["doc_id"]).select(*COLUMNS).union(docs.where("doc_id is null"))


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced by its kind in brackets; n_chars follows the new text."""
    return pii.redact(_documents(docs)).withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.char_length("text").cast("long"))).select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it, from never to three times."""
    return mixing.mix(_documents(docs), COLUMNS)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents, in sequences of 1,024 tokens at most."""
    return packing.pack(_documents(docs), batch_rows=256, cached=60_000)  # the executors still hold what earlier stages grew


STAGES = [
    ("language_id", identify_language),
    ("near_duplicates", drop_near_duplicates),
    ("personal_data", redact_personal_data),
    ("source_mix", mix_sources),
    ("packing", pack_sequences),
]

#: No SQL: the stages hold trained models, similarity components and packing.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = saved(docs)
    return docs
