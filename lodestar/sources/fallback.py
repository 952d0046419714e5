"""Ordered chains of sources: what one does not have the next one fills in, with the name of the one that had it."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def fill_fields(papers: DataFrame, sources: Sequence[tuple[str, DataFrame]], columns: Sequence[str]) -> DataFrame:
    """papers with the columns' nulls and blanks filled from the first source that has a value, and `<column>_source`.

    Sources are (name, table with paper_id and some of the columns); a paper's values in one source are its least ones.
    A value that papers already have is from `own`; where nobody has one, column and source are null.
    """
    out = papers
    had = {c: F.nullif(F.trim(F.col(c).cast("string")), F.lit("")).isNotNull() for c in columns if c in papers.columns}
    for c in columns:
        if c not in had:
            out = out.withColumn(c, F.lit(None).cast("string"))
        own = had.get(c, F.lit(False))
        out = out.withColumn(f"{c}_source", F.when(own, "own")).withColumn(c, F.when(own, F.col(c)))
    for name, table in sources:
        has = [c for c in columns if c in table.columns]
        if not has:
            continue
        # one row a paper, and none with nothing to give
        t = table.groupBy("paper_id").agg(*(F.min(F.when(F.trim(F.col(c).cast("string")) != "", F.col(c))).alias(f"_{c}") for c in has))
        out = out.join(t, "paper_id", "left")
        for c in has:
            use = F.col(c).isNull() & F.col(f"_{c}").isNotNull()
            out = out.withColumn(f"{c}_source", F.when(use, name).otherwise(F.col(f"{c}_source"))).withColumn(c, F.coalesce(c, f"_{c}"))
        out = out.drop(*(f"_{c}" for c in has))
    return out


def fallback_edges(papers: DataFrame, edges: DataFrame, sources: Sequence[tuple[str, DataFrame]]) -> DataFrame:
    """(citing_id, cited_id, found_in): the references of papers from edges, else from the first source that has any for the paper.

    Only rows of papers (paper_id) are read from any source; each source is asked for what is still without.
    """
    p = papers.select(F.col("paper_id").alias("citing_id")).distinct()
    ranked = [(0, "own", edges), *((k, name, e) for k, (name, e) in enumerate(sources, 1))]
    rows = reduce(DataFrame.union, (e.select("citing_id", "cited_id").where("cited_id is not null").join(p, "citing_id", "left_semi").select("citing_id", "cited_id", F.lit(k).alias("rank"), F.lit(name).alias("found_in")) for k, name, e in ranked))
    first = rows.groupBy("citing_id").agg(F.min("rank").alias("rank"))
    return rows.join(first, ["citing_id", "rank"]).select("citing_id", "cited_id", "found_in").distinct()
