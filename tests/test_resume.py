"""Runs that break and go on, runs that start from an earlier one, and searches that are not repeated."""

import pytest
from pyspark.sql import functions as F

from lodestar.operators import expand, screening
from lodestar.plans import config
from lodestar.plans import pipeline as P
from lodestar.plans.pipeline import Corpus, Run, run_pipeline
from lodestar.plans.resume import chain

BLOCKS = {"recent": {"type": "YearFilter", "low": 2000}}
STEPS = [{"step": "ExpandForward", "screener": "recent"}, {"step": "Cluster", "store_as": "c/d", "algorithm": "walktrap"}, {"step": "ExpandBackward", "screener": "recent"}, {"step": "MergeDuplicates", "semantic_threshold": 1.1}]


def corpus(spark, **more):
    rows = [("S", "A seed about graphs", 2010, "10.1/s"), ("C", "A citing work of later years", 2015, None), ("D", "Another citing work, on texts", 2016, None), ("R", "A reference that is old enough", 2003, "10.1/r"), ("Q", "The same reference in print", 2004, "10.1/R"), ("O", "Out of the years asked for", 1990, None)]
    p = spark.createDataFrame([(i, t, y, "V", 9, {"DOI": d} if d else None) for i, t, y, d in rows], "paper_id string, title string, year int, venue string, citation_count long, external_ids map<string,string>")
    e = spark.createDataFrame([("C", "S"), ("D", "S"), ("C", "R"), ("D", "Q"), ("D", "O")], "citing_id string, cited_id string")
    return Corpus(p, e, **more)


def settings(tmp_path, steps, **more):
    return config.load_settings({"data_dir": str(tmp_path / "out"), "seed_papers": ["S"], "blocks": BLOCKS, "pipeline": steps} | more)


def facts(run):
    return (
        sorted((r["paper_id"], r["depth"], r["source"], tuple(r["supporting_papers"])) for r in run.collection.collect()), sorted(r[0] for r in run.seen.collect()), sorted(map(tuple, run.rejected.collect())),
        sorted(map(tuple, run.alias.collect())) if run.alias is not None else None, [(s["step"], s["in"], s["out"], s["delta"]) for s in run.shape], sorted(map(tuple, run.clusters["c/d"].collect())), sorted(map(tuple, run.edges().collect())),
    )


def test_a_broken_run_goes_on(spark, tmp_path, monkeypatch):
    whole = run_pipeline(spark, settings(tmp_path, STEPS), corpus(spark))
    kept = {"state_dir": str(tmp_path / "state")}
    made, broke = [], []
    steps = dict(Run.STEPS)

    def counted(name):
        def go(self, signal, **options):
            made.append(name)
            if name == "ExpandBackward" and not broke:
                broke.append(name)
                raise RuntimeError("the cluster went away")
            return steps[name](self, signal, **options)

        return go

    monkeypatch.setattr(P, "check_step", lambda spec: None)
    monkeypatch.setattr(Run, "STEPS", {n: counted(n) for n in steps})
    with pytest.raises(RuntimeError):
        run_pipeline(spark, settings(tmp_path, STEPS, **kept), corpus(spark))
    assert made == ["LoadSeeds", "ExpandForward", "Cluster", "ExpandBackward", "Finalize"]
    made.clear()
    again = run_pipeline(spark, settings(tmp_path, STEPS, **kept), corpus(spark))
    assert made == ["ExpandBackward", "MergeDuplicates", "Finalize"]
    assert facts(again) == facts(whole)
    assert facts(whole)[3] is not None and len(facts(whole)[0]) == 4  # R and Q became one
    # all is done but the end; papers and edges are those of the merged corpus
    made.clear()
    third = run_pipeline(spark, settings(tmp_path, STEPS, **kept), corpus(spark))
    assert made == ["Finalize"] and facts(third) == facts(whole)


def test_what_a_state_stands_for(spark, tmp_path):
    """Another option of a step changes its digest and those behind it; another corpus or block changes all."""
    of = lambda steps, c=None, **more: chain(Run(spark, settings(tmp_path, steps, **more), c or corpus(spark)), steps)
    base = of(STEPS)
    other = of([*STEPS[:2], STEPS[2] | {"screener": {"type": "YearFilter", "low": 2020}}, STEPS[3]])
    assert other[:2] == base[:2] and not set(other[2:]) & set(base) and of(STEPS) == base and len(set(base)) == 4
    for x in (of(STEPS, corpus(spark, version="2")), of(STEPS, blocks=BLOCKS | {"b": {"type": "YearFilter"}}), of(STEPS, seed_papers=["O"])):
        assert not set(x) & set(base)


def test_a_run_starts_from_an_earlier_one(spark, tmp_path):
    first = run_pipeline(spark, settings(tmp_path, [STEPS[0], STEPS[3]], state_dir=str(tmp_path / "state")), corpus(spark))
    found = {r["paper_id"] for r in first.collection.collect()}
    more = settings(tmp_path, [STEPS[0], STEPS[3]], start_from=str(tmp_path / "state"), seed_papers=["S", "O"])
    run = run_pipeline(spark, more, corpus(spark))
    # O is a new seed; its citer D is known already, and the seed S was expanded before
    assert {r["paper_id"] for r in run.collection.collect()} == found | {"O"}
    assert run.iteration == 2 and [s["in"] for s in run.shape if s["step"] == "ExpandForward"] == [1]
    assert {r[0] for r in first.seen.collect()} < {r[0] for r in run.seen.collect()}
    with pytest.raises(ValueError):
        run_pipeline(spark, settings(tmp_path, [], start_from=str(tmp_path / "nothing")), corpus(spark))


def test_merging_keeps_texts_and_fallbacks(spark, tmp_path):
    t = spark.createDataFrame([("R", "text of r"), ("Q", None)], "paper_id string, text string")
    m = [("more", spark.createDataFrame([("Q", "late"), ("R", "early")], "paper_id string, abstract string"))]
    e = [("more", spark.createDataFrame([("Q", "S"), ("R", "Q")], "citing_id string, cited_id string"))]
    run = Run(spark, settings(tmp_path, []), corpus(spark, texts=t, more_papers=m, more_edges=e))
    c = run.renamed_corpus(spark.createDataFrame([("R", "Q")], "alias string, canonical string"))
    assert [tuple(r) for r in c.texts.collect()] == [("Q", "text of r")] and c.papers.where("paper_id = 'R'").isEmpty()
    assert {r["paper_id"] for r in c.more_papers[0][1].collect()} == {"Q"} and [tuple(r) for r in c.more_edges[0][1].collect()] == [("Q", "S")]
    assert ("C", "Q") in {tuple(r) for r in c.edges.collect()} and c.vectors is None


def test_a_search_is_made_once(spark, tmp_path):
    search = {"step": "ExpandBySearch", "query": "reference", "screener": "recent"}
    run = Run(spark, settings(tmp_path, []), corpus(spark))
    signal = run.step({"step": "LoadSeeds"}, run._empty("paper_id string, ord int")).signal
    first, second, third = (run.step(s, signal) for s in (search, search, search | {"limit": 1}))
    assert second.stats["reason"] == "already_searched" and "reason" not in first.stats and "reason" not in third.stats
    assert [r[0] for r in second.signal.select("paper_id").collect()] == ["S"]
    ids = spark.createDataFrame([("b",), ("a",)], "paper_id string")
    one = lambda df, *a: expand.fingerprint(df, *a).first()[0]
    assert one(ids, "x") == one(ids.orderBy("paper_id"), "x") and len({one(ids, "x"), one(ids, "y"), one(ids, "x", "o"), one(ids.limit(1), "x"), one(ids.where("false"), "x")}) == 5
