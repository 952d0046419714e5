import random

from lodestar.operators import fixpoint as X
from lodestar.operators import graph as G


def test_long_rings_take_few_rounds(spark, monkeypatch):
    """A ring of 60 that runs into another one, whose ids fall and rise along it: one step for each vertex of it, there and back, would be 120 rounds."""
    rounds, plain = [], X.materialised
    monkeypatch.setattr(X, "materialised", lambda df: rounds.append(1) or plain(df))
    ring = [(i, (i + 1) % 60) for i in range(60)] + [(100 + (i + 1) % 5, 100 + i) for i in range(5)] + [(7, 103), (103, 200)]
    got = {r["id"]: r["scc"] for r in G.strong_components(spark.createDataFrame(ring, "src long, dst long")).collect()}
    assert got == {i: 0 for i in range(60)} | {i: 100 for i in range(100, 105)} | {200: 200}
    assert len(rounds) < 100


def test_random_graph(spark):
    rng = random.Random(5)
    arcs = sorted({(rng.randrange(40), rng.randrange(40)) for _ in range(55)})
    ids = {v for a in arcs for v in a}
    to = {v: {v} for v in ids}
    for _ in ids:
        for s, d in arcs:
            to[s] |= to[d]
    want = {v: min(u for u in to[v] if v in to[u]) for v in ids}
    got = {r["id"]: r["scc"] for r in G.strong_components(spark.createDataFrame(arcs, "src long, dst long")).collect()}
    assert got == want
