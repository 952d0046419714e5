"""Mixing sources to target weights by systematic sampling; DataFrame functions only."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import WORD_RE, block_rows, numbered_copies, saved, table

#: The weights of the sources in code-point order, repeating, and the most copies of a source.
WEIGHTS = (5, 2, 1)
MOST = 3
SEED = "mix-1"
#: Equal rows above this number are dealt by number.
COPIES = 1024


def source_targets(sizes: DataFrame) -> DataFrame:
    """sizes (source, source_size) -> (source, source_size, target).

    All sizes are shared out by weight; a target stops at MOST times its source's size and the excess
    goes to the others by weight until none is above: a source is capped exactly if MOST * size /
    weight is below the level at which the remaining ones fill, found with running sums over the
    sources in the order of that ratio. One row a source.
    """
    w = F.array(*map(F.lit, WEIGHTS))
    by_name = W.orderBy(F.col("source").asc_nulls_last())
    s = sizes.withColumn("weight", F.get(w, (F.row_number().over(by_name) - 1) % len(WEIGHTS)).cast("long"))
    s = s.withColumn("most", MOST * F.col("source_size")).withColumn("ratio", F.col("most") / F.col("weight"))
    up = W.orderBy("ratio", F.col("source").asc_nulls_last())
    everything = W.partitionBy()
    s = s.withColumn("total", F.sum("source_size").over(everything)).withColumn("all_weight", F.sum("weight").over(everything))
    s = s.withColumn("capped_most", F.sum("most").over(up.rowsBetween(W.unboundedPreceding, -1))).withColumn("capped_weight", F.sum("weight").over(up.rowsBetween(W.unboundedPreceding, -1)))
    s = s.withColumn("rest", F.col("total") - F.coalesce("capped_most", F.lit(0))).withColumn("rest_weight", F.col("all_weight") - F.coalesce("capped_weight", F.lit(0)))
    # Each source is capped if, with all of smaller ratio capped, its share of the rest exceeds its most.
    s = s.withColumn("capped", F.col("weight") * F.col("rest") > F.col("most") * F.col("rest_weight"))
    level = W.partitionBy()
    s = s.withColumn("free_rest", F.min(F.when(~F.col("capped"), F.struct("ratio", F.col("source").isNull(), "source", "rest", "rest_weight"))).over(level))
    share = (F.col("weight") * F.col("free_rest.rest")).cast("double") / F.col("free_rest.rest_weight").cast("double")
    return s.select("source", "source_size", F.when(F.col("capped"), F.col("most").cast("double")).otherwise(F.coalesce(share, F.lit(0.0))).alias("target"))


def systematic_copies(docs: DataFrame, size_col: str, source_col: str, key_col: str, seed: str = SEED) -> DataFrame:
    """docs with `source_size`, `target` and `copies`, the times that the mix takes each row.

    A row is expected target / source_size times. Within a source the rows stand in the order of size
    class, block and size, which stratifies by size; expected copies are summed along that order, a
    random offset in [0, 1) from a hash of the source and the seed is added, and a row is taken once
    for each whole number that its step crosses, so never more than MOST times. Sums are over bounded
    blocks first and then over blocks, equal rows in many blocks. Reruns agree. Null sizes count as 0, a null source is a source
    of its own; repeated rows are rows of their own; no rows give none. docs must not have columns
    that begin with `mix_`.
    """
    d = docs.withColumn("mix_size", F.coalesce(F.col(size_col), F.lit(0)).cast("long")).withColumn("mix_source", F.col(source_col))
    d = d.withColumn("mix_class", F.length(F.bin("mix_size"))).withColumn("mix_mark", F.xxhash64(*docs.columns))
    d = numbered_copies(d, COPIES, "mix_mark", "mix_copy")
    per_source = saved(d.groupBy(F.col("mix_source").alias("source"), "mix_class").agg(F.sum("mix_size").alias("s"), F.count(F.lit(1)).alias("n")))
    rows = per_source.agg(F.max("n")).first()[0] or 0
    n_blocks = max(1, math.ceil(rows / block_rows(rows)))
    targets = source_targets(per_source.groupBy("source").agg(F.sum("s").alias("source_size")))
    d = d.withColumn("mix_block", F.pmod(F.xxhash64("mix_mark", "mix_copy"), F.lit(n_blocks)))
    group = ["mix_source", "mix_class", "mix_block"]
    counts = d.groupBy(*group).agg(F.count(F.lit(1)).alias("n"))
    offsets = counts.withColumn("mix_before", F.sum("n").over(W.partitionBy("mix_source").orderBy("mix_class", "mix_block")) - F.col("n"))
    u = F.conv(F.substring(F.md5(F.concat(F.coalesce("source", F.lit("")), F.lit("|" + seed)).cast("binary")), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)
    offsets = offsets.join(targets.withColumn("mix_u", u), F.col("mix_source").eqNullSafe(F.col("source"))).select(*(F.col(c).alias("o_" + c) for c in group), "mix_before", "source_size", "target", "mix_u")
    joined = d.join(offsets, F.col("mix_source").eqNullSafe(F.col("o_mix_source")) & (F.col("mix_class") == F.col("o_mix_class")) & (F.col("mix_block") == F.col("o_mix_block")))
    k = F.col("mix_before") + F.row_number().over(W.partitionBy(*group).orderBy("mix_size", F.col(key_col), "mix_mark", "mix_copy"))
    joined = joined.withColumn("mix_k", k.cast("double")).withColumn("mix_r", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size").cast("double")).otherwise(0.0))
    copies = F.floor(F.col("mix_k") * F.col("mix_r") + F.col("mix_u")) - F.floor((F.col("mix_k") - 1.0) * F.col("mix_r") + F.col("mix_u"))
    joined = joined.withColumn("copies", F.least(copies, F.lit(MOST)).cast("long"))
    return joined.select(*docs.columns, "source_size", "target", "copies")


def word_count(c) -> F.Column:
    return F.coalesce(F.regexp_count(c, F.lit(WORD_RE)), F.lit(0)).cast("long")


def mix(docs: DataFrame, columns: list[str], id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The mix itself: `columns` of every row of docs, as often as it is taken."""
    keep = docs.select(*(F.col(c).alias(f"c{i}") for i, c in enumerate(columns)), word_count(F.col(text_col)).alias("w"), F.col(source_col).alias("s"), F.col(id_col).alias("k"))
    counted = systematic_copies(keep, "w", "s", "k").where("copies > 0")
    many = counted.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    return many.select(*(F.col(f"c{i}").alias(c) for i, c in enumerate(columns)))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", word_count(F.col("text")).alias("size"))
    out = systematic_copies(saved(docs), "size", "source", "doc_id")
    return out.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))
