"""Fallback sources, full texts and the request cap, through whole pipelines and alone."""

import glob
import json

from lodestar.plans import config
from lodestar.plans.pipeline import Corpus, run_pipeline
from lodestar.sources.fallback import fallback_edges, fill_fields

APART = {"step": "MergeDuplicates", "semantic_threshold": 1.1}
BLOCKS = {"recent": {"type": "YearFilter", "low": 2000}, "model": {"type": "LLMFilter", "prompt": "on topic"}}


def corpus(spark, **more):
    papers = [("S", "A seed about graphs and texts", "", 2010), ("R1", "First reference of the seed", "has one", 2005), ("R2", "Second reference found elsewhere", None, 2006), ("R3", "Third work that is too old to stay", None, 1990), ("C", "A citing work of later years", "c", 2015)]
    p = spark.createDataFrame([(*x, "V", 10) for x in papers], "paper_id string, title string, abstract string, year int, venue string, citation_count long")
    return Corpus(p, spark.createDataFrame([("C", "S")], "citing_id string, cited_id string"), **more)


def settings(tmp_path, steps, **more):
    return config.load_settings({"data_dir": str(tmp_path), "seed_papers": ["S"], "blocks": BLOCKS, "pipeline": steps} | more)


def test_fields_say_where_they_come_from(spark):
    p = spark.createDataFrame([(1, "own", None), (2, " ", None), (3, None, "u")], "paper_id long, abstract string, url string")
    a = spark.createDataFrame([(2, "from a"), (2, "from a, again"), (3, "")], "paper_id long, abstract string")
    b = spark.createDataFrame([(2, "b", "ub"), (3, "b", "ub"), (1, "b", None)], "paper_id long, abstract string, url string")
    got = sorted(tuple(r) for r in fill_fields(p, [("a", a), ("b", b)], ["abstract", "url"]).select("paper_id", "abstract", "abstract_source", "url", "url_source").collect())
    assert got == [(1, "own", "own", None, None), (2, "from a", "a", "ub", "b"), (3, "b", "b", "u", "own")]


def test_references_of_the_first_source_that_has_any(spark):
    s = "citing_id long, cited_id long"
    e = lambda *rows: spark.createDataFrame(list(rows), s)
    got = fallback_edges(spark.createDataFrame([(1,), (2,), (3,), (4,)], "paper_id long"), e((1, 10), (9, 10)), [("x", e((1, 11), (2, 12), (2, 13), (2, 13))), ("y", e((2, 14), (3, 15), (3, None)))])
    assert sorted(tuple(r) for r in got.collect()) == [(1, 10, "own"), (2, 12, "x"), (2, 13, "x"), (3, 15, "y")]


def test_backward_falls_back_and_the_end_fills_in(spark, tmp_path):
    more = {"more_edges": [("open", spark.createDataFrame([("S", "R1"), ("S", "R3"), ("C", "R2")], "citing_id string, cited_id string"))], "more_papers": [("open", spark.createDataFrame([("S", "filled")], "paper_id string, abstract string"))]}
    run = run_pipeline(spark, settings(tmp_path, [{"step": "ExpandBackward", "screener": "recent"}, APART]), corpus(spark, **more))
    assert {r["paper_id"] for r in run.collection.collect()} == {"S", "R1"}
    lines = [json.loads(x) for f in glob.glob(f"{tmp_path}/reference_sources/*.json") for x in open(f)]
    assert {(x["citing_id"], x["found_in"], x["n"]) for x in lines} == {("S", "open", 2)}
    assert {(r["paper_id"], r["abstract"], r["abstract_source"]) for r in spark.read.parquet(f"{tmp_path}/collection.parquet").collect()} == {("S", "filled", "open"), ("R1", "has one", "own")}
    assert {tuple(r)[:2] for r in run.edges().select("src", "dst").collect()} == {("R1", "S")}


def test_full_texts_lead_to_papers(spark, tmp_path):
    body = "Words of the text. " * 60
    refs = "\nReferences\n[1] Smith, J. (2005). First reference of the seed. Venue.\n[2] Doe, A. (1990). Third work that is too old to stay. Venue.\n[3] Roe, B. (2001). Nobody knows this one at all. Venue.\n"
    texts = spark.createDataFrame([("S", body + refs), ("C", "no list")], "paper_id string, text string")
    run = run_pipeline(spark, settings(tmp_path, [{"step": "ExpandByPDF", "screener": "recent"}, APART]), corpus(spark, texts=texts))
    assert {r["paper_id"] for r in run.collection.collect()} == {"S", "R1"}
    step = next(s for s in run.shape if s["step"] == "ExpandByPDF")
    assert step["stats"] | {"accepted": 1, "rejected": 1, "entries": 3, "resolved": 2} == step["stats"]
    got = {r["cited_id"]: (r["quotes"], r["resolved_by"]) for r in run.quotes.collect()}
    assert got["R1"] == (["Smith, J. (2005). First reference of the seed. Venue."], ["title"]) and set(got) == {"R1", "R3"}
    assert {tuple(r)[:2] for r in run.edges().select("src", "dst").collect()} == {("R1", "S")}
    assert run_pipeline(spark, settings(tmp_path / "none", [{"step": "ExpandByPDF", "screener": "recent"}, APART]), corpus(spark)).collection.count() == 1


def test_a_run_ends_at_its_requests(spark, tmp_path):
    edges = {"more_edges": [("open", spark.createDataFrame([("S", "R1"), ("R1", "R2")], "citing_id string, cited_id string"))]}
    steps = [{"step": "ExpandBackward", "screener": "model"}, {"step": "ExpandBackward", "screener": "model"}, APART]
    run = run_pipeline(spark, settings(tmp_path, steps, max_requests=1), corpus(spark, **edges))
    assert {r["paper_id"] for r in run.collection.collect()} == {"S", "R1"} and run.requests == 1
    assert run.shape[-1]["step"] == "Finalize"
