"""A cluster may hold most papers."""

from pyspark.sql import functions as F

from lodestar.operators import dedup as D


def test_large_clusters_are_merged_where_their_rows_are(spark):
    m = spark.range(0, 1000, 1, 4).select(F.lit(0).alias("cluster"), F.col("id").alias("paper_id"), F.when(F.col("id") % 2 == 0, "arXiv").otherwise("Nature").alias("venue"), (F.col("id") % 7).alias("citation_count"), F.lit("x").alias("abstract"), F.lit(2000).alias("year"))
    merged = D.merge_clusters(D.ranked(m).withColumn("references", F.array().cast("array<bigint>"))).select("paper_id", "citation_count", "n_aliases")
    picked = D.pick_canonical(m).select("paper_id", "canonical")
    for df in (merged, picked):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "Window" not in plan and "collect_list" not in plan
    assert [tuple(r) for r in merged.collect()] == [(13, 6, 999)]
    assert picked.where("canonical = 13").count() == 1000


def test_titles_of_many_papers_are_dealt_over_tasks(spark, monkeypatch):
    from lodestar.sources import records

    monkeypatch.setattr(records, "TITLE_BLOCK", 4)
    monkeypatch.setattr(records, "TITLE_PAIRS", 100)
    title = F.when(F.col("id") % 3 == 0, "graph networks").when(F.col("id") % 3 == 1, "Graph-Networks at work").otherwise("short")
    p = spark.range(60).select(F.col("id").alias("paper_id"), title.alias("title"))
    got = records.match_titles(p, p.select(F.col("paper_id").alias("found_id"), "title"))
    rows = got.withColumn("task", F.spark_partition_id()).collect()
    assert sorted((r["paper_id"], r["found_id"]) for r in rows) == [(i, j) for i in range(60) for j in range(60) if i % 3 < 2 and j % 3 < 2]
    assert len({r["task"] for r in rows}) > 3
