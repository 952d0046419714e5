"""Similarities and weights of edges against plain sets, hubs and odd graphs included."""

import math
import random
import statistics

import pytest
from pyspark.sql import functions as F

from lodestar.operators import graph as G
from lodestar.operators.fixpoint import quantile


def plain(edges):
    e = {x for x in edges if x[0] != x[1]}
    refs, citers = {}, {}
    for s, d in e:
        refs.setdefault(d, set()).add(s)
        citers.setdefault(s, set()).add(d)
    jac = lambda a, b: len(a & b) / len(a | b) if a | b else 0.0
    return {(s, d): (jac(refs.get(s, set()), refs.get(d, set())), jac(citers.get(s, set()), citers.get(d, set()))) for s, d in e}


def sims(spark, edges):
    got = G.edge_similarities(spark.createDataFrame(edges, "src long, dst long")).collect()
    out = {(r["src"], r["dst"]): (r["ref_sim"], r["cit_sim"]) for r in got}
    assert len(out) == len(got)
    return out


def near(got, want):
    assert got.keys() == want.keys()
    assert all(got[k] == pytest.approx(want[k]) for k in want)


@pytest.mark.parametrize("seed", [1, 2])
def test_edge_similarities(spark, seed):
    # cycles, mutual edges, repeats and loops
    rng = random.Random(seed)
    edges = [(rng.randrange(25), rng.randrange(25)) for _ in range(220)]
    near(sims(spark, edges + edges[:9]), plain(edges))


def test_hubs(spark, monkeypatch):
    # a hub both ways, and out-neighbours in several blocks
    monkeypatch.setattr(G, "WEDGE_BLOCK", 3)
    rng = random.Random(3)
    edges = [(0, i) for i in range(1, 400)] + [(i, 0) for i in range(400, 600)] + [(rng.randrange(1, 30), rng.randrange(30, 60)) for _ in range(400)]
    edges += [(i, j) for i in range(1000, 1014) for j in range(i + 1, 1014)]
    near(sims(spark, edges), plain(edges))
    star = spark.createDataFrame([(0, i) for i in range(1, 500)], "src long, dst long")
    assert G._ranked(star).groupBy("lo").count().agg(F.max("count")).first()[0] == 1  # arms begin the pairs, not the hub
    assert G.triangles(G._ranked(star)).isEmpty()


def test_no_edges(spark):
    assert sims(spark, []) == {} and sims(spark, [(1, 1)]) == {}
    assert G.edge_weights(G.edge_similarities(spark.createDataFrame([], "src long, dst long"))).isEmpty()


def test_quantile(spark):
    rng = random.Random(4)
    for n in (1, 2, 5, 333):
        x = [rng.choice([0.25, 0.5, rng.random()]) for _ in range(n)]
        df = spark.createDataFrame([(v,) for v in x] + [(None,)], "x double").repartition(3)
        want = x[0] if n == 1 else statistics.quantiles(x, n=4, method="inclusive")[0]
        assert quantile(df, "x", 0.25) == pytest.approx(want)
    assert quantile(spark.createDataFrame([(None,)], "x double"), "x", 0.5) is None


def test_semantic_similarities(spark):
    e = spark.createDataFrame([(1, 2), (1, 3), (1, 4), (1, 5), (1, 6)], "src long, dst long")
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 1.0]), (3, [0.0, 0.0]), (4, None), (6, [1.0])], "paper_id long, embedding array<double>")
    got = {r["dst"]: r["semantic_similarity"] for r in G.semantic_similarities(e, v).collect()}
    assert got == pytest.approx({2: math.sqrt(0.5), 3: 0.0, 4: 0.0, 5: 0.0, 6: 0.0})
