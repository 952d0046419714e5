"""PageRank sends along the edges only what is still on its way; components draw the graph together."""

import numpy as np
import pytest

from lodestar.operators import graph as G


def _written(monkeypatch, kept=lambda df: True):
    """Row counts of the tables that the graph operators write."""
    sizes, real = [], G.materialised

    def materialised(df):
        got = real(df)
        if kept(got):
            sizes.append(got.count())
        return got

    monkeypatch.setattr(G, "materialised", materialised)
    return sizes


def _iterated(edges, n, rounds, reset=None):
    out = np.bincount([a for a, _ in edges], minlength=n)
    r = np.full(n, 1 / n) if reset is None else reset
    x = r.copy()
    for _ in range(rounds):
        came = np.zeros(n)
        for a, b in edges:
            came[b] += x[a] / out[a]
        x = 0.15 * r + 0.85 * (came + x[out == 0].sum() * r)
    return x


def test_pagerank_is_that_of_the_rounds(spark):
    rng = np.random.default_rng(3)
    edges = sorted({(int(a), int(b)) for a, b in rng.integers(0, 40, (90, 2)) if a != b})
    n = 1 + max(max(e) for e in edges)
    e = spark.createDataFrame([*edges, (n, n + 1)], "src long, dst long").repartition(3)
    edges.append((n, n + 1))
    seen = sorted({v for e_ in edges for v in e_})
    at = {v: i for i, v in enumerate(seen)}
    numbered = [(at[a], at[b]) for a, b in edges]
    for rounds in (0, 5):
        got = dict(tuple(r) for r in G.pagerank(e, rounds).collect())
        assert [got[v] for v in seen] == pytest.approx(_iterated(numbered, len(seen), rounds).tolist(), rel=1e-12)
    reset = np.array([0.5 if v in (0, n) else 0.0 for v in seen])
    seeded = dict(tuple(r) for r in G.pagerank(e, 4, seeds=spark.createDataFrame([(0,), (n,)], "id long")).collect())
    assert [seeded[v] for v in seen] == pytest.approx(_iterated(numbered, len(seen), 4, reset).tolist(), abs=1e-15)


def test_pagerank_ends_where_no_cycle_is(spark, monkeypatch):
    """Levels of a graph without cycles, not the tolerance, give the number of tables; hubs are listed in blocks."""
    monkeypatch.setattr(G, "LIST", 8)
    edges = [(0, i) for i in range(1, 61)] + [(1, 61), (61, 62)]
    written = _written(monkeypatch)
    got = dict(tuple(r) for r in G.pagerank(spark.createDataFrame(edges, "src long, dst long"), 1000, tolerance=1e-14).collect())
    assert len(written) <= 6
    assert [got[v] for v in range(63)] == pytest.approx(_iterated(edges, 63, 200).tolist(), rel=1e-12)


def test_components_have_fewer_edges_each_round(spark, monkeypatch):
    rng = np.random.default_rng(5)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 600, (900, 2))]
    edges += [(1000 + i, 1001 + i) for i in range(40)] + [(2000, 1900 + i) for i in range(30)] + [(5, 5), (3000, 3000)]
    comp = {v: v for e in edges if e[0] != e[1] for v in e}
    while True:
        was = dict(comp)
        for a, b in edges:
            if a != b:
                comp[a] = comp[b] = min(comp[a], comp[b])
        if was == comp:
            break
    sizes = _written(monkeypatch, lambda df: df.columns == ["lo", "hi"])
    got = G.components(spark.createDataFrame(edges, "src long, dst long").repartition(4)).collect()
    assert len(got) == len(comp) and dict(tuple(r) for r in got) == comp
    assert sizes[-1] == 0 and len(sizes) <= 6 and sum(sizes) < 2 * sizes[0]
    assert G.components(spark.createDataFrame([("b", "b")], "src string, dst string")).count() == 0
    assert {tuple(r) for r in G.components(spark.createDataFrame([("b", "a"), ("c", "b")], "src string, dst string")).collect()} == {("a", "a"), ("b", "a"), ("c", "a")}


def test_edge_weights_take_the_similarities_once(spark):
    similar = spark.createDataFrame([(1, 2, 0.5, 0.0), (1, 2, 0.5, 0.0), (2, 3, 0.0, 0.25), (3, 4, 0.0, 0.0)], "src long, dst long, ref_sim double, cit_sim double").distinct()
    got = G.edge_weights(similar)
    assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()
    assert sorted((r["src"], r["weight"]) for r in got.collect()) == [(1, 1.0), (2, 1.0), (3, 1.0)]
