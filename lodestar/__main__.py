"""Command line: run a pipeline, a main path, labels or extractions by a model, a query, or list what there is."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession
from pyspark.sql import functions as F


def _corpus(spark: SparkSession, path: str):
    from .plans.pipeline import Corpus

    p = spark.read.parquet(f"{path}/papers")
    optional = lambda n: spark.read.parquet(f"{path}/{n}") if n in {r.name for r in _entries(spark, path)} else None
    return Corpus(p, spark.read.parquet(f"{path}/edges"), optional("vectors"), optional("authorship"))


def _entries(spark: SparkSession, path: str):
    from collections import namedtuple

    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    entry = namedtuple("entry", "name")
    return [entry(s.getPath().getName()) for s in p.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(p)]


def _single(model):
    """A model that is asked once a text."""
    return lambda instruction, text: model(instruction, text, 0)


def main(argv: list[str] | None = None) -> int:
    ap = argparse.ArgumentParser(prog="lodestar")
    sub = ap.add_subparsers(dest="what", required=True)
    run = sub.add_parser("run", help="run a pipeline over a corpus of Parquet tables")
    run.add_argument("-c", "--config", required=True)
    run.add_argument("--corpus", required=True)
    run.add_argument("--data-dir")
    mp = sub.add_parser("mainpath", help="main path of a GraphML file")
    mp.add_argument("graph")
    mp.add_argument("--weight", default="spc")
    mp.add_argument("--search", default="key-route")
    mp.add_argument("--cycles", default="shrink")
    mp.add_argument("-o", "--out", required=True)
    an = sub.add_parser("annotate", help="label the papers of a GraphML file by a model")
    an.add_argument("graph")
    an.add_argument("-i", "--instruction", required=True)
    an.add_argument("--model", default="stub")
    an.add_argument("--batch", type=int, default=20)
    an.add_argument("--limit", type=int)
    an.add_argument("-o", "--out", required=True)
    ex = sub.add_parser("extract-info", help="a model's JSON on each text file of a folder")
    ex.add_argument("texts")
    ex.add_argument("-i", "--instruction", required=True)
    ex.add_argument("--model", default="stub")
    ex.add_argument("--max-input-chars", type=int, default=80_000)
    ex.add_argument("-o", "--out", required=True)
    q = sub.add_parser("query", help="run a registered query over a folder of tables")
    q.add_argument("name")
    q.add_argument("tables")
    sub.add_parser("list", help="registered queries")
    a = ap.parse_args(argv)
    if a.what == "list":
        from .plans.catalog import QUERIES

        print(*sorted(QUERIES), sep="\n")
        return 0
    spark = SparkSession.builder.appName("lodestar").getOrCreate()
    if a.what == "query":
        from .plans.catalog import QUERIES

        QUERIES[a.name](spark, a.tables).show(50, truncate=80)
    elif a.what == "run":
        from .plans.config import load_settings, warnings
        from .plans.pipeline import run_pipeline, shape_table

        settings = load_settings(a.config, {"data_dir": a.data_dir} if a.data_dir else None)
        for w in warnings(settings):
            print("warning:", w)
        shape_table(run_pipeline(spark, settings, _corpus(spark, a.corpus))).show(truncate=False)
    elif a.what == "annotate":
        from .operators import annotate
        from .sources.records import read_graphml

        v, e = read_graphml(spark, a.graph)
        annotate.write_annotated(annotate.annotate(v, a.instruction, a.model, a.batch, a.limit), e, a.out)
    elif a.what == "extract-info":
        from .operators import acquire, verdicts

        make = verdicts.maker(a.model)
        texts = spark.read.text(a.texts, wholetext=True).select(F.col("_metadata.file_path").alias("paper_id"), F.col("value").alias("text"))
        acquire.extract(texts, a.instruction, lambda: _single(make()), a.max_input_chars).write.mode("overwrite").json(a.out)
    else:
        from .operators import mainpath, output
        from .operators.annotate import summary
        from .operators.fixpoint import materialised, numbered
        from .sources.records import read_graphml

        v, e = read_graphml(spark, a.graph)
        names = numbered(v.select("id", "attrs"), "id", name="n").withColumn("n", F.col("n") + 1)
        coded = e.join(names.select(F.col("id").alias("src"), F.col("n").alias("s")), "src").join(names.select(F.col("id").alias("dst"), F.col("n").alias("d")), "dst").select(F.col("s").alias("src"), F.col("d").alias("dst"))
        papers = names.select(F.col("n").alias("paper_id"), F.col("attrs")["year"].try_cast("int").alias("year"), F.col("attrs")["citation_count"].try_cast("long").alias("citation_count"))
        arcs, roles = mainpath.main_path(coded, papers, a.weight, a.search, a.cycles)
        copies = mainpath.has_copies(coded, a.cycles)
        number = F.shiftright("id", 1) if copies else F.col("id")
        paper = F.when(F.lit(copies) & (F.col("id") % 2 == 1), F.concat("name", F.lit("#preprint"))).otherwise(F.col("name"))
        named = roles.withColumn("n", number).join(names.select(F.col("id").alias("name"), "n", "attrs"), "n").select("id", paper.alias("paper"), "role", "level", "attrs")
        named = materialised(named)
        ends = [named.select(F.col("id").alias(c), F.col("paper").alias(f"{c}_paper")) for c in ("src", "dst")]
        arcs = materialised(arcs.join(ends[0], "src").join(ends[1], "dst").select(F.col("src_paper").alias("src"), F.col("dst_paper").alias("dst"), "w"))
        on = named.select(F.col("paper").alias("id"), F.col("role").alias("mp_role"), "level", *(F.try_element_at("attrs", F.lit(c)).alias(c) for c in ("title", "year", "venue")))
        output.write_graphml(on, arcs.select("src", "dst", F.col("w").cast("double").alias("mp_weight")), a.out)
        lines = summary(a.graph, a.weight, a.search, a.cycles, arcs, named.select(F.col("paper").alias("id"), "role", "level", "attrs"), v.count(), e.count())
        lines.coalesce(1).write.mode("overwrite").text(f"{a.out}.json")
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
