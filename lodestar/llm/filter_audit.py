"""Audit of how filters interact, over the edges of the lattice of their subsets.

An edge is (filters applied already, next filter): with five filters there are 80. Every document counts
on each of them, as kept, removed or redundant. An order of the filters is a path through the lattice, so
the 600 steps of the 120 orders are looked up among 80 edges instead of being run over the documents.
"""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce
from itertools import permutations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WORD_RE, saved, table

COUNTS = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost"]


def text_rules(text: Column) -> dict[str, Column]:
    """The failure conditions of filters A to D on a text that is not null."""
    words = F.regexp_extract_all(text, F.lit(WORD_RE), F.lit(0))
    n = F.size(words).cast("long")
    capitals = F.regexp_count(text, F.lit("[A-Z]")).cast("long")
    return {
        "A": n < 100,
        "B": 100 * F.size(F.array_distinct(words)).cast("long") < 80 * n,
        "C": 100 * capitals > 10 * F.char_length(text).cast("long"),
        "D": text.rlike("[#$%&*|]"),
    }


def edge_counts(failing: DataFrame, letters: str, by: str = "part") -> DataFrame:
    """(part, applied, next and COUNTS): all edges of the lattice from rows of (part, mask, n, good, toxic).

    `mask` and `applied` have bit k for the k-th letter, `next` is that bit alone. Documents that fail the
    same filters meet as one row beforehand; each then counts on every edge.
    """
    bits = [1 << k for k in range(len(letters))]
    edges = F.array(*(F.struct(F.lit(s).alias("applied"), F.lit(b).alias("next")) for s in range(1 << len(letters)) for b in bits if not s & b))
    e = failing.withColumn("edge", F.explode(edges)).select(by, "mask", "n", "good", "toxic", "edge.applied", "edge.next")
    fails = F.col("mask").bitwiseAND(F.col("next")) != 0
    there = F.col("mask").bitwiseAND(F.col("applied")) == 0
    total = lambda c, n="n": F.sum(F.when(c, F.col(n)).otherwise(0))
    return e.groupBy(by, "applied", "next").agg(
        total(there & ~fails).alias("kept"), total(there & fails).alias("removed"), total(~there & fails).alias("redundant"),
        total(F.col("mask") == F.col("next")).alias("unique_fails"), total(there & fails, "good").alias("good_lost"), total(there & fails, "toxic").alias("toxic_lost"),
    )


def lattice_paths(spark: SparkSession, letters: str) -> DataFrame:
    """(filter_order, step, applied, next): the steps of all orders, 600 of five filters."""
    rows = []
    for order in permutations(range(len(letters))):
        applied = 0
        for step, k in enumerate(order, 1):
            rows.append(("".join(letters[i] for i in order), step, applied, 1 << k))
            applied |= 1 << k
    return spark.createDataFrame(rows, "filter_order string, step int, applied int, next int")


def audit(docs: DataFrame, labels: DataFrame, rules: Mapping[str, Column] | None = None, copies: str = "E", id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """One row per part, order of the filters and step: COUNTS and `shapley`, zeros included.

    `rules` maps letters to failure conditions on the column `text` (null texts come as empty ones); the
    filter `copies` fails documents whose text a smaller id has too, anywhere in docs. Null parts are ''.
    Rows without id are identical to nothing and have no label; repeated rows of an id are documents of
    their own, none smaller than the other. A document is good (toxic) if any of its labels says so;
    labels without id or of unknown ids count nowhere. Other columns are not read. No rows: an empty
    result.

    Texts are read once. What goes on is a mask of failed filters, a digest and the id; equal rows are
    counted before they meet a label. Only (part, mask) counts reach the lattice.
    """
    spark = docs.sparkSession
    d = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rules = dict(rules if rules is not None else text_rules(F.col("text")))
    letters = "".join(sorted([*rules, copies]))
    bit = {c: 1 << k for k, c in enumerate(letters)}
    mask = reduce(lambda a, b: a.bitwiseOR(b), (F.when(fails, bit[c]).otherwise(0) for c, fails in rules.items()), F.lit(0))
    slim = saved(d.select("id", "part", mask.alias("mask"), F.unhex(F.sha2(F.col("text").cast("binary"), 256)).alias("same")))
    first = slim.where("id is not null").groupBy("same").agg(F.min("id").alias("id"))
    said = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("id")).agg(F.max(F.when(F.col("quality") == 1, 1).otherwise(0)).alias("good"), F.max(F.when(F.col("toxic") == 1, 1).otherwise(0)).alias("toxic"))
    counted = slim.where("id is not null").groupBy("id", "same", "part", "mask").agg(F.count(F.lit(1)).alias("n"))
    judged = counted.join(first.withColumn("is_first", F.lit(True)), ["id", "same"], "left").join(said, "id", "left").select(
        "part", F.col("mask").bitwiseOR(F.when(F.col("is_first"), 0).otherwise(bit[copies])).alias("mask"), "n",
        (F.col("n") * F.coalesce("good", F.lit(0))).alias("good"), (F.col("n") * F.coalesce("toxic", F.lit(0))).alias("toxic"),
    )
    nameless = slim.where("id is null").select("part", "mask", F.lit(1).cast("long").alias("n"), F.lit(0).cast("long").alias("good"), F.lit(0).cast("long").alias("toxic"))
    failing = judged.union(nameless).groupBy("part", "mask").agg(*(F.sum(c).alias(c) for c in ("n", "good", "toxic")))
    edges = edge_counts(failing, letters)
    steps = edges.join(F.broadcast(lattice_paths(spark, letters)), ["applied", "next"])
    # the orders that take an edge share its counts, so a filter's sum over all orders is one over its edges' steps
    over_orders = steps.groupBy("part", "next").agg(F.sum("removed").alias("shapley"))
    return steps.join(over_orders, ["part", "next"]).select("part", "filter_order", "step", *COUNTS, "shapley")


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


OP11_SQL = """
with recursive d as (
  select doc_id, coalesce(lang, '') as part, coalesce(text, '') as t, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') as w from documents
), f as (
  select part,
    [len(w) < 100, 100 * len(list_distinct(w)) < 80 * len(w), 100 * (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g'))) > 10 * length(t),
     regexp_matches(t, '[#$%&*|]'), coalesce(doc_id > min(doc_id) over (partition by t), false)] as fails,
    coalesce(doc_id in (select doc_id from labels where quality = 1), false) as good, coalesce(doc_id in (select doc_id from labels where toxic = 1), false) as toxic
  from d
), o(filter_order) as (
  select '' union all
  select o.filter_order || l.c from o, (select unnest(['A', 'B', 'C', 'D', 'E']) as c) l where not contains(o.filter_order, l.c)
), s as (
  select filter_order, cast(step as int) as step, list_transform(range(1, step), lambda i: ascii(filter_order[i]) - 64) as before, ascii(filter_order[step]) - 64 as k
  from o, range(1, 6) r(step) where length(filter_order) = 5
), g as (
  select part, fails, count(*) as n, count(*) filter (good) as good, count(*) filter (toxic) as toxic from f group by 1, 2
), x as (
  select part, filter_order, step, k, n, good, toxic, fails[k] as bad, len(list_filter(before, lambda i: fails[i])) > 0 as gone, len(list_filter(fails, lambda b: b)) = 1 as alone from g, s
), c as (
  select part, filter_order, step, k,
    cast(sum(case when not gone and not bad then n else 0 end) as bigint) as kept, cast(sum(case when not gone and bad then n else 0 end) as bigint) as removed,
    cast(sum(case when gone and bad then n else 0 end) as bigint) as redundant, cast(sum(case when alone and bad then n else 0 end) as bigint) as unique_fails,
    cast(sum(case when not gone and bad then good else 0 end) as bigint) as good_lost, cast(sum(case when not gone and bad then toxic else 0 end) as bigint) as toxic_lost
  from x group by all
)
select part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, cast(sum(removed) over (partition by part, k) as bigint) as shapley from c
"""
