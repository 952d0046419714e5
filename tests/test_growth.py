"""Steps whose work must be dealt out, whatever the layout of their input."""

import glob
import random
import re
import xml.etree.ElementTree as ET
from itertools import combinations

from pyspark.sql import functions as F

from lodestar.operators import graph, output, topics
from lodestar.sources import records


def test_terms_are_cut_once_and_in_many_tasks(spark):
    texts = spark.createDataFrame([(i % 3, f"amber birch cobalt{i % 4} of delta") for i in range(40)], "cid int, text string").coalesce(1)
    got = topics.ctfidf(texts, 4)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan.count("RoundRobinPartitioning(4)") and "Generate explode" in plan
    rows = got.collect()
    plan = got._jdf.queryExecution().executedPlan().toString()  # the final one: shuffles are used again
    final = plan.split("+- == Initial Plan ==")[0]
    assert final.count("Generate explode") == 1 and final.count("ReusedExchange") >= 2
    assert {r["rank"] for r in rows} == {1, 2, 3, 4} and len(rows) == 12


def test_terms_of_short_texts(spark):
    of = lambda x, n=3: spark.createDataFrame([(x,)], "text string").select(topics.terms("text", n)).first()[0]
    assert of(None) == of("the a") == [] and of("one") == ["one"] and of("one two", 1) == ["one", "two"]
    assert of("One two three the four") == ["one", "two", "three", "four", "one two", "two three", "three four", "one two three", "two three four"]


def test_graphml_in_parts_and_foreign_files(spark, tmp_path):
    """A document in many files, read by lines; breaks inside a text; a file of another tool."""
    path = str(tmp_path / "g")
    v = spark.range(400).select("id", F.when(F.col("id") == 7, "two\nlines <&>").otherwise(F.array_join(F.transform(F.sequence(F.lit(1), F.lit(300)), lambda i: F.sha2(F.concat_ws("-", "id", i), 256)), " ")).alias("title"))
    e = spark.range(399).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst"))
    output.write_graphml(v, e, path)
    assert len(glob.glob(f"{path}/part-*.txt")) > 1
    text = "\n".join(open(f).read() for f in sorted(glob.glob(f"{path}/part-*.txt")))
    assert len([x for x in ET.fromstring(text).iter() if x.tag.endswith("}edge")]) == 399
    gv, ge = records.read_graphml(spark, f"{path}/*.txt")
    assert gv.where("id = 7").first()["attrs"] == {"title": "two\nlines <&>"} and gv.count() == 400
    assert {(r.src, r.dst) for r in ge.collect()} == {(str(i), str(i + 1)) for i in range(399)}
    assert "binaryFile" not in ge._jdf.queryExecution().toString()
    for k, odd in enumerate(['<node\n id="a">\n<data key="k">x</data></node><node id="b"/><edge source="a"\n target="b"/>', '<!-- <node id="z"/>\n<node id="y"/>\n-->\n<node id="a"><data key="k">x</data></node><node id="b"/>\n<edge source="a" target="b"/>']):
        f = tmp_path / f"odd{k}.graphml"
        f.write_text(f'<graphml xmlns="http://graphml.graphdrawing.org/xmlns">\n<key id="k" for="node" attr.name="title"/><graph>{odd}</graph></graphml>')
        gv, ge = records.read_graphml(spark, str(f))
        assert sorted(map(tuple, gv.collect())) == [("a", {"title": "x"}), ("b", {})] and [tuple(r) for r in ge.collect()] == [("a", "b", {})]


def test_pairs_of_authors_are_not_shuffled_one_by_one(spark, monkeypatch):
    rng = random.Random(3)
    rows = [(p, 1990 + p % 9 if p % 4 else None, a) for p in range(60) for a in sorted(rng.sample(range(40), 1 + p % 12))] + [(99, 2001, a) for a in range(40)]
    monkeypatch.setattr(graph, "AUTHOR_BLOCK", 4)
    monkeypatch.setattr(graph, "AUTHOR_WORK", 50)
    got = graph.collaboration(spark.createDataFrame(rows, "paper_id long, year int, author long"))
    assert not re.search(r"hashpartitioning\([^)]*\bb#", got._jdf.queryExecution().executedPlan().toString())
    want = {}
    for p in {r[0] for r in rows}:
        for (_, year, a), (_, _, b) in combinations(sorted((r for r in rows if r[0] == p), key=lambda r: r[2]), 2):
            want.setdefault((a, b), []).append((year, sum(r[0] == p for r in rows)))
    assert {(r.a, r.b): (r.n_papers, round(r.strength, 9), r.first_year, r.last_year, r.duration) for r in got.collect()} == {
        k: (len(x), round(sum(1 / n for _, n in x), 9), *(lambda y: (min(y, default=0), max(y, default=0), max(y, default=0) - min(y, default=0)))([y for y, _ in x if y is not None])) for k, x in want.items()
    }
