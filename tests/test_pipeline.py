"""A chain of papers through whole pipelines, and the checks of configurations."""

import glob
import json

import pytest
from pyspark.sql import functions as F

from lodestar.operators import output, topics, verdicts
from lodestar.plans import config
from lodestar.plans.pipeline import Corpus, rewritten, run_pipeline, shape_table
from lodestar.sources import records

CHAIN = [("REF1", 2015, 500, [], "Nature", None), ("REF2", 2016, 300, [], "Nature", None), ("REF3", 2017, 120, ["REF1"], "Nature", None), ("SEED", 2018, 1000, ["REF1", "REF2"], "Nature", [1.0, 0.0, 0.0]), ("CITER1", 2020, 250, ["SEED", "REF3"], "Nature", [0.9, 0.1, 0.0]), ("CITER2", 2022, 80, ["SEED", "CITER1"], "arXiv", [0.7, 0.3, 0.0]), ("WEAK", 2010, 1, ["REF1"], "Nature", [0.0, 0.0, 1.0])]
BLOCKS = {
    "year": {"type": "YearFilter", "low": 2012},
    "cited": {"type": "CitationFilter", "beta": 10, "reference_year": 2025},
    "model": {"type": "LLMFilter", "prompt": "on topic", "votes": 2, "min_accepts": 1},
    "all": {"type": "Sequential", "layers": ["year", "cited", "model"]},
}
#: The vectors of the chain are near each other; none of its papers is a duplicate.
APART = {"step": "MergeDuplicates", "semantic_threshold": 1.1}


@pytest.fixture(scope="module")
def corpus(spark):
    p = spark.createDataFrame([(i, f"Title of {i}", f"Abstract of {i}.", y, v, c) for i, y, c, _, v, _ in CHAIN], "paper_id string, title string, abstract string, year int, venue string, citation_count long")
    e = spark.createDataFrame([(i, r) for i, _, _, refs, _, _ in CHAIN for r in refs], "citing_id string, cited_id string")
    v = spark.createDataFrame([(i, x) for i, _, _, _, _, x in CHAIN if x], "paper_id string, embedding array<double>")
    return Corpus(p, e, v)


def settings(tmp_path, steps, **more):
    return config.load_settings({"data_dir": str(tmp_path), "seed_papers": ["SEED"], "blocks": BLOCKS, "pipeline": steps} | more)


def test_chain(spark, corpus, tmp_path):
    run = run_pipeline(spark, settings(tmp_path, [{"step": "ExpandForward", "screener": "all"}, {"step": "ExpandBackward", "screener": "all"}, {"step": "Rerank", "metric": "citation", "k": 3}, APART]), corpus)
    got = {r["paper_id"]: (r["depth"], r["source"]) for r in run.collection.collect()}
    # backward expansion starts from what forward expansion accepted
    assert got == {"SEED": (0, "seed"), "CITER1": (1, "forward"), "CITER2": (1, "forward"), "REF3": (2, "backward")}
    assert [s["step"] for s in run.shape] == ["LoadSeeds", "ExpandForward", "ExpandBackward", "Rerank", "MergeDuplicates", "Finalize"]
    assert shape_table(run).count() == 6
    assert glob.glob(f"{tmp_path}/citation_network.graphml/*.txt") and glob.glob(f"{tmp_path}/collection.bib/*.txt")
    v, e = records.read_graphml(spark, f"{tmp_path}/citation_network.graphml/*.txt")
    assert v.count() == 4
    assert {(r["src"], r["dst"]) for r in e.collect()} == {("SEED", "CITER1"), ("SEED", "CITER2"), ("CITER1", "CITER2"), ("REF3", "CITER1")}
    a = {(r["src"], r["dst"]): r["attrs"] for r in e.collect()}[("SEED", "CITER2")]
    # in the collection SEED has no references and CITER2 no citers: nothing is shared
    assert float(a["semantic_similarity"]) == pytest.approx(0.7 / 0.58**0.5) and float(a["ref_sim"]) == float(a["cit_sim"]) == 0.0 and float(a["weight"]) > 0
    assert v.where("id = 'SEED'").first()["attrs"]["title"] == "Title of SEED"


def test_search_semantics_parallel(spark, corpus, tmp_path):
    branches = [[{"step": "ExpandBySearch", "query": "title (REF1 | WEAK)", "screener": "year"}], [{"step": "ExpandBySemantics", "mode": "per_paper", "limit": 1, "screener": "year"}]]
    run = run_pipeline(spark, settings(tmp_path, [{"step": "Parallel", "branches": branches}, {"step": "Cluster", "algorithm": "louvain", "store_as": "c"}, {"step": "ReScreen", "screener": "cited"}, APART]), corpus)
    assert {r["paper_id"] for r in run.collection.collect()} == {"SEED", "REF1", "CITER1"}
    assert {(r["paper_id"], r["category"]) for r in run.rejected.collect()} == {("WEAK", "year")}
    assert "c" in run.clusters


def test_cap_and_rewrite(spark, corpus, tmp_path):
    run = run_pipeline(spark, settings(tmp_path, [{"step": "ExpandForward", "screener": "year"}, {"step": "ExpandBackward", "screener": "year"}], max_papers=2), corpus)
    assert [s["step"] for s in run.shape] == ["LoadSeeds", "ExpandForward", "Finalize"]
    assert [s["step"] for s in rewritten([])] == ["LoadSeeds", "MergeDuplicates", "Finalize"]


def test_configuration(monkeypatch):
    for bad in ({"api_key": "x"}, {"nonsense": 1}, {"blocks": {"a": {"type": "Nope"}}}, {"blocks": {"a": {"type": "Not", "layer": "b"}, "b": {"type": "Not", "layer": "a"}}}, {"blocks": {"a": {"type": "CitationFilter"}}}, {"pipeline": [{"step": "Cluster", "model": "gone"}]}):
        with pytest.raises(config.ConfigError):
            config.load_settings(bad)
    monkeypatch.setenv("LODESTAR_MAX_PAPERS", "7")
    s = config.load_settings({"max_papers": 3, "blocks": {"s": {"type": "SimilarityFilter", "measures": ["RefSim"]}}, "pipeline": [{"step": "ExpandBySearch", "screener": {"type": "Sequential", "layers": ["s"]}}]}, {"topic_description": "t"})
    assert s.max_papers == 7 and s.topic_description == "t" and len(config.warnings(s)) == 1


def test_records(spark):
    js = '{"paperId": "p", "title": "T", "venue": "", "references": [{"citedPaper": {"paperId": "q"}}, {"citedPaper": null}], "externalIds": {"DOI": "10.1/x", "MAG": null}, "fieldsOfStudy": ["B"], "s2FieldsOfStudy": [{"category": "B"}, {"category": "A"}]}'
    p = records.papers_from_json(spark.createDataFrame([(js,), ('{"title": "no id"}',), ("not json",)], "json string")).collect()
    assert len(p) == 1 and (p[0]["venue"], p[0]["references"], p[0]["external_ids"], p[0]["fields_of_study"]) == (None, ["q"], {"DOI": "10.1/x"}, ["B", "A"])
    e = records.edges_from_json(spark.createDataFrame([("p", '[{"citedPaper": {"paperId": "q"}, "isInfluential": true}, {"citedPaper": null}]')], "paper_id string, json string")).collect()
    assert len(e) == 1 and e[0]["is_influential"] and e[0]["contexts"] == []
    assert records.newest(["a/c.json", "a/c.exp2.json", "a/c.exp10.json"]) == "a/c.exp10.json" and records.newest([]) is None
    papers = spark.createDataFrame([("p", "Deep graph learning at scale", "1")], "paper_id string, title string, arxiv_id string")
    assert records.reconcile(papers, spark.createDataFrame([], "paper_id string, doi string, doi_source string"), arxiv=True).first()["doi"] == "10.48550/arXiv.1"
    assert records.match_titles(papers, spark.createDataFrame([("f", "Deep Graph Learning"), ("g", "Deep Sea")], "found_id string, title string")).collect()[0]["found_id"] == "f"


def test_output(spark):
    p = spark.createDataFrame([("a:1", "T {x}", None, 2020, "2020-05", 3)], "paper_id string, title string, venue string, year int, publication_date string, citation_count long")
    entry = output.bibtex(p).first()["entry"]
    assert entry.startswith("@article{a1,\n  title     = {T \\{x\\}},\n  year      = {2020},\n  month     = {5},\n  date      = {2020-05},\n  journal   = {}") and entry.endswith("note      = {S2: a:1, citations: 3},\n}")
    e = spark.createDataFrame([(1, 2)], "src int, dst int")
    meta = spark.createDataFrame([(9, 2, 1, ["x"], ["y"], True), (1, 2, 0, ["z"], [], False)], "cited_id int, citing_id int, ord int, contexts array<string>, intents array<string>, is_influential boolean")
    alias = spark.createDataFrame([(9, 1)], "alias int, canonical int")
    assert output.attach_edge_metadata(e, meta, alias).first()["contexts"] == ["z"]


def test_merge_duplicates_keeps_values_and_citations(spark, tmp_path):
    """P (preprint) and Q share a DOI only: Q stays with P's abstract, citations, supporters and seed."""
    p = spark.createDataFrame(
        [("P", "An early draft", "What it says.", 2019, "arXiv", 90, {"DOI": "https://doi.org/10.1/X"}), ("Q", "The final work", None, 2021, "Nature", 40, {"DOI": "10.1/x"}), ("R", "Third", "c", 2022, "Nature", 5, None), ("T", "Fourth", "d", 2015, "Nature", 7, None)],
        "paper_id string, title string, abstract string, year int, venue string, citation_count long, external_ids map<string,string>",
    )
    e = spark.createDataFrame([("R", "P"), ("P", "T"), ("Q", "P")], "citing_id string, cited_id string")
    s = config.load_settings({"data_dir": str(tmp_path), "seed_papers": ["P", "Q", "R", "T"], "blocks": BLOCKS, "pipeline": []})
    run = run_pipeline(spark, s, Corpus(p, e))
    assert {(r["alias"], r["canonical"]) for r in run.alias.collect()} == {("P", "Q")}
    assert {(r["paper_id"], r["source"]) for r in run.collection.collect()} == {("Q", "seed"), ("R", "seed"), ("T", "seed")}
    assert {(r["src"], r["dst"]) for r in run.edges().collect()} == {("Q", "R"), ("T", "Q")}
    q = run.corpus.papers.where("paper_id = 'Q'").first()
    assert (q["title"], q["abstract"], q["venue"], q["year"], q["citation_count"]) == ("The final work", "What it says.", "Nature", 2021, 90)


@pytest.mark.parametrize("step", [{"step": "Cluster", "namings": {"mode": "tfidf"}}, {"step": "LoadSeeds", "include_siblings": True}, {"step": "ExpandByGuess"}, {"step": "Parallel", "branches": [[{"step": "HumanInTheLoop", "wait": 1}]]}])
def test_refused_options(spark, corpus, tmp_path, step):
    with pytest.raises(config.ConfigError):
        run_pipeline(spark, settings(tmp_path, [step]), corpus)


def test_token_budget_ends_the_run(spark, corpus, tmp_path):
    """The first question spends the budget: the step ends, later ones do not run, the output is written."""
    steps = [{"step": "ExpandForward", "screener": "all"}, {"step": "ExpandBackward", "screener": "all"}]
    run = run_pipeline(spark, settings(tmp_path, steps, max_tokens=1), corpus)
    assert [s["step"] for s in run.shape] == ["LoadSeeds", "ExpandForward", "Finalize"]
    # CITER1 and CITER2 in one prompt, two votes, four characters a token
    texts = [f"Title: Title of {i}\nAbstract: Abstract of {i}." for i in ("CITER1", "CITER2")]
    assert run.tokens == 2 * (sum(-(-len(t) // 4) for t in texts) + -(-len(verdicts.SYSTEM + "on topic") // 4))
    assert {r["paper_id"] for r in run.collection.collect()} == {"SEED", "CITER1", "CITER2"}


def test_token_budget_inside_branches(spark, corpus, tmp_path):
    """In a branch nothing is asked once the budget is spent; what the branch before it found stays."""
    branch = [{"step": "ExpandForward", "screener": "all"}]
    back = [{"step": "ExpandBackward", "screener": "all"}]
    run = run_pipeline(spark, settings(tmp_path, [{"step": "Parallel", "branches": [branch, back]}], max_tokens=1), corpus)
    assert [e["kind"] for e in run.events].count("budget_spent") == 1 and run.shape[-1]["step"] == "Finalize"
    assert {r["paper_id"] for r in run.collection.collect()} == {"SEED", "CITER1", "CITER2"}


def test_semantic_similarity_to_the_source(spark, corpus, tmp_path):
    """CITER1 is within 0.95 of its source SEED, CITER2 is not; WEAK's source has no vector, so on_no_data decides."""
    near = {"type": "SimilarityFilter", "measures": [{"type": "SemanticSim"}], "threshold": 0.95, "on_no_data": "reject"}
    run = run_pipeline(spark, settings(tmp_path, [{"step": "ExpandForward", "screener": near}, APART]), corpus)
    assert {r["paper_id"] for r in run.collection.collect()} == {"SEED", "CITER1"}
    assert {(r["paper_id"], r["category"]) for r in run.rejected.collect()} == {("CITER2", "similarity")}
    run = run_pipeline(spark, settings(tmp_path, [{"step": "ExpandForward", "screener": near}, APART], seed_papers=["REF1"]), corpus)
    assert {r["category"] for r in run.rejected.where("paper_id = 'WEAK'").collect()} == {"similarity_no_data"}
    run = run_pipeline(spark, settings(tmp_path, [{"step": "ExpandForward", "screener": near}, APART]), Corpus(corpus.papers, corpus.edges))
    assert {r["category"] for r in run.rejected.collect()} == {"similarity_no_data"}
    with pytest.raises(config.ConfigError):
        config.build_block({"type": "SimilarityFilter", "measures": [{"type": "SemanticSim", "embedder": "other"}]}, {})


def _read(path):
    return "".join(open(f).read() for f in sorted(glob.glob(f"{path}/part-*")))


def test_review(spark, corpus, tmp_path):
    """The reviewer would not keep CITER2, the model accepts both; WEAK was rejected before any model saw it. The reviewer ends the run."""
    seen = []

    def review(sample):
        seen.extend((r["paper_id"], r["accepted"], r["title"]) for r in sample.collect())
        return spark.createDataFrame([("CITER1", True), ("CITER2", False), ("WEAK", False), ("OTHER", True)], "paper_id string, keep boolean"), True

    steps = [{"step": "ExpandForward", "screener": "all"}, {"step": "HumanInTheLoop", "enabled": True, "k": 6}, {"step": "ExpandBackward", "screener": "all"}]
    run = run_pipeline(spark, settings(tmp_path, steps, seed_papers=["SEED", "REF1"]), corpus, review)
    assert {(p, ok) for p, ok, _ in seen} == {("CITER1", True), ("CITER2", True), ("REF3", True), ("WEAK", False)}
    assert ("WEAK", False, "Title of WEAK") in seen
    report = json.loads(_read(tmp_path / "hitl_report.json"))
    assert (report["candidates"], report["labels_collected"], report["stop_requested"]) == (4, 3, True)
    assert report["agreement_by_filter"] == {"model": 0.5} and report["low_agreement_filters"] == []
    assert [s["step"] for s in run.shape] == ["LoadSeeds", "ExpandForward", "HumanInTheLoop", "Finalize"]
    ledger = [json.loads(x) for x in _read(tmp_path / "rejected_papers.json").splitlines()]
    assert [(x["paper_id"], x["categories"]) for x in ledger] == [("WEAK", ["year"])]
    assert _read(tmp_path / "shape_summary.txt").splitlines()[0].split() == ["step", "in", "out", "delta", "notes"]
    assert [s["step"] for s in json.loads(_read(tmp_path / "shape_summary.json"))] == ["LoadSeeds", "ExpandForward", "HumanInTheLoop"]


def test_review_without_reviewer(spark, corpus, tmp_path):
    run = run_pipeline(spark, settings(tmp_path, [{"step": "HumanInTheLoop"}, {"step": "HumanInTheLoop", "enabled": True}, APART]), corpus)
    assert [s["stats"].get("reason") for s in run.shape[1:3]] == ["disabled", "no_candidates"]


def test_siblings_and_author_graph(spark, tmp_path):
    """Of seed A: B shares its DOI, C title and author, D the title alone (other authors), E the title (no known author), F a short title."""
    long = "A study of very many things in one place"
    p = spark.createDataFrame(
        [("A", long, 2020, 5, {"DOI": "10.1/x"}), ("B", "Another name", 2021, 6, {"DOI": "https://doi.org/10.1/X"}), ("C", long.upper() + "!", 2019, None, None), ("D", long, 2018, 1, None), ("E", long, None, 1, None), ("F", "Short", 2018, 1, None), ("G", "Short", 2018, 1, None)],
        "paper_id string, title string, year int, citation_count long, external_ids map<string,string>",
    )
    p = p.withColumn("venue", F.lit("Nature"))
    e = spark.createDataFrame([("A", "F")], "citing_id string, cited_id string")
    a = spark.createDataFrame([("A", "u1", 1, "Ann"), ("A", "u2", 0, "Bo"), ("C", "u1", 0, "Ann"), ("D", "u3", 0, "Cy"), ("F", "u2", 0, "Bo"), ("G", "u2", 0, "Bo")], "paper_id string, author_id string, position int, name string")
    s = config.load_settings({"data_dir": str(tmp_path), "seed_papers": ["A", {"title": "short"}], "blocks": BLOCKS, "pipeline": [{"step": "ResolveSeeds", "include_siblings": True}, {"step": "MergeDuplicates", "title_threshold": 1.1}]})
    run = run_pipeline(spark, s, Corpus(p, e, None, a))
    assert [x["step"] for x in run.shape] == ["ResolveSeeds", "LoadSeeds", "MergeDuplicates", "Finalize"]
    assert {r["paper_id"] for r in run.resolved.collect()} == {"A", "B", "C", "E", "F"}
    assert run.shape[0]["stats"] == {"input_seeds": 2, "primaries_resolved": 2, "siblings_added": 3, "include_siblings": True}
    v, arcs = records.read_graphml(spark, f"{tmp_path}/collaboration_network.graphml/*.txt")
    got = {r["id"]: r["attrs"] for r in v.collect()}
    assert set(got) == {"u1", "u2"} and got["u1"]["papers"] == "2" and got["u1"]["author_name"] == "Ann" and got["u2"]["degree"] == "1"
    assert {(r["src"], r["dst"]) for r in arcs.collect()} == {("u1", "u2")}


def test_naming(spark, corpus, tmp_path):
    rows = [
        (1, '{"results": [{"cluster_id": 1, "topic_label": " One ", "summary": "s"}, {"cluster_id": true, "topic_label": "x"}, {"cluster_id": "4", "label": "x"}, {"cluster_id": 2, "label": "Two"}, {"cluster_id": 3}, {"cluster_id": 1, "label": "Last"}]}', [(1, "Last", ""), (2, "Two", "")]),
        (2, '```json\n[{"cluster_id": 7.0, "topic_label": "", "label": "Seven"}]\n```', [(7, "Seven", "")]),
        (3, "no json", None),
        (4, None, None),
    ]
    df = spark.createDataFrame([r[:2] for r in rows], "k int, reply string").select("k", topics.parsed_names("reply").alias("x"))
    got = {r["k"]: None if r["x"] is None else sorted(tuple(x) for x in r["x"]) for r in df.collect()}
    assert got == {k: v for k, _, v in rows}
    verdicts.register_model("namer", lambda: lambda system, user, vote: json.dumps([{"cluster_id": 0, "topic_label": "Zero", "summary": "all"}]))
    words = spark.createDataFrame([(0, "cat", 1), (0, "dog", 2), (5, "tree", 1)], "cid long, term string, rank int")
    named = {tuple(r) for r in topics.named(words, "namer").collect()}
    assert named == {(0, "Zero", "all"), (5, "tree", "")}
    run = run_pipeline(spark, settings(tmp_path, [{"step": "ExpandForward", "screener": "year"}, {"step": "Cluster", "store_as": "c", "naming": {"mode": "llm"}}, APART]), corpus)
    assert run.names["c"].count() == run.shape[2]["stats"]["clusters"] > 0


def test_reply_memo(spark, corpus, tmp_path):
    """The second run asks nothing, so no token is spent; another criterion is asked; failed calls are not stored."""
    memo = str(tmp_path / "memo")
    more = {"reply_memo": memo}
    steps = [{"step": "ExpandForward", "screener": "all"}, APART]
    one = run_pipeline(spark, settings(tmp_path, steps, **more), corpus)
    two = run_pipeline(spark, settings(tmp_path, steps, **more), corpus)
    assert one.tokens > 0 and two.tokens == 0
    assert sorted(map(tuple, one.collection.collect())) == sorted(map(tuple, two.collection.collect()))
    assert spark.read.parquet(memo).count() == 4  # two papers, two votes

    def broken():
        def call(system, user, vote):
            raise OSError("away")
        return call

    verdicts.register_model("broken", broken)
    p = corpus.papers.where("paper_id = 'SEED'")
    assert [tuple(r) for r in verdicts.verdicts(p, "on topic", model="broken", memo=memo).collect()] == [("SEED", 0, False)]
    assert [tuple(r) for r in verdicts.verdicts(p, "other", memo=memo).collect()] == [("SEED", 1, True)]
    assert spark.read.parquet(memo).count() == 5
