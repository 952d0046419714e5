"""What rounds have left of a graph goes to one task, whatever its depth."""

import random

import pytest

from lodestar.operators import graph as G
from lodestar.operators import mainpath as M


def _counted(monkeypatch, *modules):
    tables, real = [], G.materialised
    for m in modules:
        monkeypatch.setattr(m, "materialised", lambda df: tables.append(1) or real(df))
    return tables


def test_deep_graphs_take_few_tables(spark, monkeypatch):
    """A chain of 200 before a ring of 50: rounds would trim or colour one vertex at a time."""
    tables = _counted(monkeypatch, G)
    e = [(i, i + 1) for i in range(200)] + [(200 + i, 200 + (i + 1) % 50) for i in range(50)] + [(220, 900), (900, 901)]
    got = {tuple(r) for r in M.preprint_transform(spark.createDataFrame(e, "src long, dst long")).collect()}
    ring = range(200, 250)
    want = {(s, s in ring, d, False) for s, d in e if not (s in ring and d in ring)} | {(u, False, v, True) for u in ring for v in ring}
    assert got == want and len(tables) <= 4


@pytest.mark.parametrize("rest", [0, 6, 1000])
def test_components_at_any_rest(spark, monkeypatch, rest):
    monkeypatch.setattr(G, "REST", rest)
    rng = random.Random(11)
    arcs = sorted({(f"v{rng.randrange(25)}", f"v{rng.randrange(25)}") for _ in range(32)}) + [("w1", "w2"), ("w2", "w1"), ("x", "x")]
    ids = {v for a in arcs for v in a}
    to = {v: {v} for v in ids}
    for _ in ids:
        for s, d in arcs:
            to[s] |= to[d]
    want = {v: min(u for u in to[v] if v in to[u]) for v in ids}
    e = spark.createDataFrame(arcs, "src string, dst string")
    assert {r["id"]: r["scc"] for r in G.strong_components(e).collect()} == want
    assert {r["id"] for r in G.cycles(e).collect()} == {v for v in ids if list(want.values()).count(want[v]) > 1}


@pytest.mark.parametrize("rest", [0, 9, 1000])
def test_weights_levels_and_roles_at_any_rest(spark, monkeypatch, rest):
    """A chain of 40 that a random graph hangs on; with a rest for one task the tables are few."""
    tables = _counted(monkeypatch, M, G)
    for m in (M, G):
        monkeypatch.setattr(m, "REST", rest)
    rng = random.Random(23)
    depth = 40 if rest == 1000 else 3
    arcs = sorted({tuple(sorted(rng.sample(range(12), 2))) for _ in range(30)} | {(11 + i, 12 + i) for i in range(depth)})
    ids = sorted({v for a in arcs for v in a})
    n_in, n_out, level = {}, {}, {}
    for v in ids:
        n_in[v] = sum(n_in[s] for s, d in arcs if d == v) or 1
        level[v] = max((level[s] + 1 for s, d in arcs if d == v), default=0)
    for v in reversed(ids):
        n_out[v] = sum(n_out[d] for s, d in arcs if s == v) or 1
    e = spark.createDataFrame(arcs, "src long, dst long")
    w = M.arc_weights(e)
    assert {(r["src"], r["dst"]): int(r["w"]) for r in w.withColumn("w", M.digits("w")).collect()} == {(s, d): n_in[s] * n_out[d] for s, d in arcs}
    assert {r["id"]: r["level"] for r in M.levels(e).collect()} == level
    assert {r["id"]: int(r["n"]) for r in M.path_counts(e).collect()} == n_in
    best = lambda s: [(s, d) for _, d in [a for a in arcs if a[0] == s] if n_out[d] == max(n_out[x] for y, x in arcs if y == s)]
    walk, path = set(), [v for v in ids if all(d != v for _, d in arcs)]
    for v in path:
        walk |= set(best(v))
        path += [d for _, d in best(v) if d not in path]
    assert {(r["src"], r["dst"]) for r in M.local_forward(w).collect()} == walk
    if rest == 1000:
        assert len(tables) < 20
    with pytest.raises(ValueError):
        M.levels(spark.createDataFrame([(0, 1), (1, 2), (2, 1), (2, 3)], "src long, dst long"))
    with pytest.raises(ValueError):
        M.arc_weights(spark.createDataFrame([(0, 1), (1, 2), (2, 1), (2, 3)], "src long, dst long"))
