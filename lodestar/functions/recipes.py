"""Which acquisition recipes a DOI is sent to, in order. Only the routing is data; nothing is fetched here."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# Rank, recipe, prefixes, kind.
RECIPES = (
    (1, "arxiv_http", ("10.48550/",), "http"),
    (2, "highwire_oa_http", ("10.1186/", "10.3389/", "10.1371/", "10.1073/"), "http"),
    (3, "elife_xml_http", ("10.7554/",), "http"),
    (4, "wiley_tdm_http", ("10.1002/", "10.15252/"), "http"),
    (5, "elsevier_tdm_http", ("10.1016/",), "http"),
    (6, "unpaywall_http", ("10.",), "http"),
    (7, "openalex_http", ("10.",), "http"),
    (8, "europepmc_http", ("10.",), "http"),
    (9, "biorxiv_browser", ("10.1101/",), "browser"),
    (10, "mdpi_browser", ("10.3390/",), "browser"),
    (11, "elife_browser", ("10.7554/",), "browser"),
    (12, "impact_browser", ("10.18632/",), "browser"),
    (13, "ijcai_browser", ("10.24963/",), "browser"),
    (14, "nature_browser", ("10.1038/",), "browser"),
    (15, "elsevier_browser", ("10.1016/",), "browser"),
    (16, "science_browser", ("10.1126/",), "browser"),
    (17, "wiley_browser", ("10.1002/",), "browser"),
    (18, "acs_browser", ("10.1021/",), "browser"),
    (19, "oxford_browser", ("10.1093/",), "browser"),
    (20, "rsc_browser", ("10.1039/",), "browser"),
    (21, "ieee_browser", ("10.1109/",), "browser"),
    (22, "acm_browser", ("10.1145/",), "browser"),
    (23, "springer_browser", ("10.1007/",), "browser"),
    (24, "iop_browser", ("10.1088/",), "browser"),
    (25, "aip_browser", ("10.1063/",), "browser"),
    (26, "embo_browser", ("10.15252/",), "browser"),
    (27, "tandf_browser", ("10.1080/",), "browser"),
    (28, "cshl_browser", ("10.1261/",), "browser"),
    (29, "pnas_browser", ("10.1073/",), "browser"),
    (30, "llm_finder", ("10.",), "llm"),
)


def recipe_rows() -> list[tuple[int, str, str, str]]:
    return [(rank, name, p, kind) for rank, name, prefixes, kind in RECIPES for p in prefixes]


def route(dois: DataFrame, allow_llm: bool = False) -> DataFrame:
    """(paper_id, doi, step, recipe, kind): each DOI's recipes in rank order; a DOI that none takes has no row."""
    spark: SparkSession = dois.sparkSession
    rows = [r for r in recipe_rows() if allow_llm or r[3] != "llm"]
    table = F.broadcast(spark.createDataFrame(rows, "rank int, recipe string, prefix string, kind string"))
    hits = dois.join(table, F.lower("doi").startswith(F.col("prefix"))).dropDuplicates(["paper_id", "rank"])
    step = F.row_number().over(W.partitionBy("paper_id").orderBy("rank"))
    return hits.select("paper_id", "doi", step.alias("step"), "recipe", "kind")


def plan_fetch(papers: DataFrame, done: DataFrame, prefix: str | None = None) -> DataFrame:
    """(paper_id, status): why a paper is skipped (no_doi, wrong_prefix, done, no_recipe), or `fetch`."""
    known = done.select("paper_id", F.lit(True).alias("is_done"))
    takes = F.lit(False)
    for p in sorted({p for r in RECIPES for p in r[2]}):
        takes |= F.lower("doi").startswith(p)
    status = F.when(F.coalesce("doi", F.lit("")) == "", "no_doi").when(F.lit(prefix is not None) & ~F.col("doi").startswith(prefix or ""), "wrong_prefix").when(F.col("is_done"), "done").when(~takes, "no_recipe").otherwise("fetch")
    return papers.join(known, "paper_id", "left").select("paper_id", status.alias("status"))
