"""Search that a model refines: queries, what they find and miss, and when it ends."""

import json

import pytest
from pyspark.sql import functions as F

from lodestar.operators import search_agent as A
from lodestar.operators import verdicts
from lodestar.operators.topics import NAMING
from lodestar.plans import config
from lodestar.plans.pipeline import Corpus, Run, check_step, run_pipeline

TITLES = {
    "S": "Graph neural networks for molecules", "T": "Message passing on molecular graphs", "A": "Graph kernels", "B": "Graph attention", "C": "Spectral convolution", "D": "Message queues in databases", "E": "Cooking at home", "N": None,
}


def papers(spark):
    rows = [(i, t, 2000 + k, 10 * k, "V") for k, (i, t) in enumerate(TITLES.items())]
    return spark.createDataFrame(rows, "paper_id string, title string, year int, citation_count long, venue string")


def worker(queries, log=None):
    """A model that answers the turns in a row: a worker knows no state, so the turn is read off the question."""

    def call(system, user, vote):
        assert system == A.TASK
        turn = sum(line.split(".")[0].isdigit() for line in user.splitlines())
        if log:
            with open(log, "a") as f:
                f.write(json.dumps(user) + "\n")
        q = queries[min(turn, len(queries) - 1)]
        if q is None:
            raise RuntimeError("no model")
        return q

    return lambda: call


def ids(df):
    return {r["paper_id"]: r["turn"] for r in df.collect()}


def test_queries_follow_what_was_missed(spark, tmp_path):
    log = str(tmp_path / "asked")
    verdicts.register_model("w", worker(['```json\n{"query": "graph AND NOT attention"}\n```', 'I would try {"query": "message OR graph"}.', '{"query": "spectral"}', '{"query": "graph"}'], log))
    p = papers(spark)
    anchors = p.where("paper_id in ('S', 'T')")
    found, turns = A.refine(p.withColumn("turn", F.lit("clash")), anchors, "graph learning", A.Agent("w", max_iterations=9))
    assert ids(found) == {"S": 1, "A": 1, "T": 2, "B": 2, "D": 2, "C": 3}
    assert [(t.query, t.matched, t.new, t.anchors_found) for t in turns] == [("graph -attention", 2, 2, 1), ("message | graph", 5, 3, 1), ("spectral", 1, 1, 0), ("graph", 3, 0, 0)]  # nothing new: the last
    asked = [json.loads(x) for x in open(log)]
    assert asked[0] == "Topic: graph learning"
    assert "- Message passing on molecular graphs" in asked[1] and "- Graph neural" not in asked[1].split("The last query added:")[0]
    assert "Known papers" not in asked[2] and "2. message | graph: 5 papers, 3 of them new, 1 of the known papers" in asked[2]
    assert A.turn_table(spark, turns).count() == 4 and A.turn_table(spark, []).count() == 0


def test_it_ends(spark):
    p = papers(spark)
    none = p.limit(0)
    for name, replies, most, want in (("again", ['{"query": "graph"}'], 5, 1), ("fails", ['{"query": "graph"}', None], 5, 1), ("prose", ["no idea"], 5, 0), ("empty", ['{"query": " "}'], 5, 0), ("once", ['{"query": "graph"}', '{"query": "message"}'], 1, 1)):
        verdicts.register_model(name, worker(replies))
        assert len(A.refine(p, none, "t", A.Agent(name, max_iterations=most))[1]) == want, name
    assert A.refine(p, none, "  ", A.Agent("once"))[1] == []
    assert A.refine(none, none, "t", A.Agent("once", max_iterations=3))[1][0].matched == 0
    left = [1]
    assert len(A.refine(p, none, "t", A.Agent("once", max_iterations=3), lambda q: bool(left and [left.pop()]))[1]) == 1
    found, _ = A.refine(p.union(p), none, "t", A.Agent("once", max_papers_per_iteration=2, sort="citationCount:asc"))
    assert ids(found) == {"S": 1}  # two rows of one paper are the first two hits
    assert set(ids(A.refine(p, none, "t", A.Agent("once", max_papers_per_iteration=2))[0])) == {"A", "B"}


def test_the_step(spark, tmp_path):
    verdicts.register_model("steps", worker(['{"query": "graph*"}', '{"query": "message"}', '{"query": "nothing"}']))
    edges = spark.createDataFrame([("A", "S")], "citing_id string, cited_id string")
    step = {"step": "ExpandBySearch", "agent": {"model": "steps", "max_iterations": 5}, "screener": "recent", "year_max": 2004}
    given = {"data_dir": str(tmp_path / "out"), "seed_papers": ["S"], "topic_description": "graphs", "blocks": {"recent": {"type": "YearFilter", "low": 2002}}, "pipeline": [step]}
    run = run_pipeline(spark, config.load_settings(given), Corpus(papers(spark), edges))
    assert {(r["paper_id"], r["source"]) for r in run.collection.collect()} == {("S", "seed"), ("A", "search"), ("B", "search")}
    stats = next(s for s in run.shape if s["step"] == "ExpandBySearch")["stats"]
    assert stats["agent_iterations"] == 3 and stats["agent_paperids"] == 5 and stats["last_query"] == "nothing" and stats["anchor_count"] == 1
    assert run.requests == 3 and run.tokens > 0
    # the budget ends the search, what was found is screened
    short = Run(spark, config.load_settings(given | {"max_requests": 1}), Corpus(papers(spark), edges))
    signal = short.step({"step": "LoadSeeds"}, short._empty("paper_id string, ord int")).signal
    assert short.step(step, signal).stats["agent_iterations"] == 1
    for odd, reason in (({"topic_description": "t", "agent": {"model": "prose2"}}, "no_results"), ({"agent": {}, "screener": None}, "no screener")):
        verdicts.register_model("prose2", worker(["-"]))
        got = short.__class__(spark, config.load_settings(given), Corpus(papers(spark), edges)).step(step | odd, signal)
        assert got.stats["reason"] == reason and got.signal.count() == 1
    quiet = Run(spark, config.load_settings(given | {"topic_description": ""}), Corpus(papers(spark), edges))
    assert quiet.step(step, signal).stats["reason"] == "no_topic_description"
    with pytest.raises(config.ConfigError):
        check_step(step | {"agent": {"turns": 3}})
    with pytest.raises(config.ConfigError):
        config.load_settings(given | {"pipeline": [step | {"agent": {"model": "unheard"}}]})


def test_the_offline_model(spark):
    found, turns = A.refine(papers(spark), papers(spark).limit(0), "Graph kernels of", A.Agent())
    assert [t.query for t in turns] == ["graph | kernels"] and set(ids(found)) == {"S", "A", "B"}
    assert json.loads(verdicts.stub_reply(NAMING, "cluster 0: a b\ncluster 7: c", 0))["results"][1] == {"cluster_id": 7, "topic_label": "stub-topic", "summary": "stub summary"}
    assert json.loads(verdicts.stub_reply(verdicts.SYSTEM, "x\n[1] a\n[2] b", 0))["results"] == [{"index": 1, "match": True}, {"index": 2, "match": True}]
