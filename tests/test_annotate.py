"""Labels by a model, the annotated graph, extraction and main path on the command line."""

import json

from pyspark.sql import functions as F

from lodestar import __main__ as cli
from lodestar.operators import annotate as A
from lodestar.operators import verdicts
from lodestar.operators.output import write_graphml
from lodestar.sources.records import read_graphml


def _odd(system, user, vote):
    """Leaves the second paper of a batch out, fails on one title, answers nonsense for others."""
    assert system == A.TASK and "p1" not in user
    if "boom" in user and user.count("Paper index=") > 1:
        raise RuntimeError("too much")
    n = user.count("Paper index=")
    if n == 1:
        return 'Sure: {"results": [{"index": "1", "label": "\\"Single\\"\\nmore"}]}' if "Second" in user else "none"
    return json.dumps({"results": [{"index": i, "label": f"L{i}"} for i in range(1, n + 1) if i != 2] + [{"index": "x", "label": "no"}, {"index": 3}, 7]})


def rows(df):
    return {r["id"]: r["attrs"]["label"] for r in df.collect()}


def test_labels(spark):
    verdicts.register_model("odd", lambda: _odd)
    v = spark.createDataFrame([("p1", {"title": "First paper", "label": "p1"}), ("p2", {"title": "Second paper", "abstract": None}), ("p3", {"title": "Third"}), ("p4", {}), ("p5", {"title": "x" * 60})], "id string, attrs map<string,string>").coalesce(1)
    got = A.annotate(v, "name it", "odd", batch=3)
    assert rows(got) == {"p1": "L1", "p2": "Single", "p3": "L3", "p4": "L1", "p5": "x" * 40}  # p5 is left out, then has no label
    at = {r["id"]: r["attrs"] for r in got.collect()}
    assert at["p1"] == {"title": "First paper", "original_title": "First paper", "label": "L1"} and at["p4"] == {"label": "L1"}
    assert rows(A.annotate(v, "name it", "odd", batch=3, limit=1)) == {"p1": "First paper", "p2": "Second paper", "p3": "Third", "p4": "?", "p5": "x" * 40}
    boom = spark.createDataFrame([("a", {"title": "boom Second"}), ("b", {"title": "boom"})], v.schema).coalesce(1)
    assert rows(A.annotate(boom, "name it", "odd")) == {"a": "Single", "b": "boom"}
    assert rows(A.annotate(v, "name it")) == {"p1": "First paper", "p2": "Second paper", "p3": "Third", "p4": "stub", "p5": "x" * 30}
    assert A.annotate(v.limit(0), "name it").count() == 0


def test_commands(spark, tmp_path):
    g = str(tmp_path / "graph")
    names = ["a", "b", "c", "d", "e"]
    v = spark.createDataFrame([(n, f"Title of {n} & more", 2000 + i, "V", 5) for i, n in enumerate(names)], "id string, title string, year int, venue string, citation_count int")
    e = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "d"), ("a", "e"), ("d", "c")], "src string, dst string")
    write_graphml(v, e, g)
    assert cli.main(["annotate", g, "-i", "two words", "-o", str(tmp_path / "labelled")]) == 0
    lv, le = read_graphml(spark, str(tmp_path / "labelled"))
    got = {r["id"]: r["attrs"] for r in lv.collect()}
    assert got["a"]["label"] == "Title of" and got["a"]["original_title"] == "Title of a & more" and le.count() == 5
    for cycles, want in (("shrink", ["a", "b", "c"]), ("preprint", None)):
        out = str(tmp_path / cycles)
        assert cli.main(["mainpath", g, "--cycles", cycles, "-o", out]) == 0
        lines = [json.loads(r[0]) for r in spark.read.text(out + ".json").collect()]
        head, papers = lines[0], lines[1:]
        assert head["stats"]["n_input_nodes"] == 5 and head["stats"]["n_mainpath_nodes"] == len(papers) and head["cycle_policy"] == cycles
        mv, me = read_graphml(spark, out)
        ids = {r["id"] for r in mv.collect()}
        assert ids == {p["paper_id"] for p in papers} and me.count() == head["stats"]["n_mainpath_edges"]
        assert {x for r in me.collect() for x in (r["src"], r["dst"])} <= ids
        assert papers[0] == {"paper_id": "a", "role": "source", "level": papers[0]["level"], "title": "Title of a & more", "year": 2000, "venue": "V"}
        if want:
            assert [p["paper_id"] for p in papers] == want
        else:
            assert {"c#preprint", "d#preprint"} & ids and {i.split("#")[0] for i in ids} <= set(names)
    texts = tmp_path / "texts"
    texts.mkdir()
    (texts / "one.txt").write_text("first\nsecond")
    verdicts.register_model("size", lambda: lambda system, user, vote: json.dumps({"n": len(user), "asked": system}))
    assert cli.main(["extract-info", str(texts), "-i", "count", "--model", "size", "-o", str(tmp_path / "info")]) == 0
    r = spark.read.json(str(tmp_path / "info")).withColumn("output", F.from_json("output", "n int, asked string")).collect()
    assert len(r) == 1 and r[0]["output"]["n"] == 12 and r[0]["output"]["asked"] == "count" and r[0]["paper_id"].endswith("one.txt")
