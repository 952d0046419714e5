"""Title and vector duplicates over tiles against all pairs, with and without authors."""

import random

import numpy as np
import pytest

from lodestar.operators import dedup as D


def papers(seed=2, n=300):
    rng = random.Random(seed)
    words = ["graph", "neural", "networks", "genome", "analysis", "of", "deep", "maps", "étude", "learning", "single", "cell"]
    rows = []
    for i in range(n):
        t = " ".join(rng.choice(words) for _ in range(rng.choice([0, 2, 3, 4])))
        if rows and rng.random() < 0.5:
            t = list(rng.choice(rows)[1])
            for _ in range(rng.randrange(3)):
                if t:
                    t[rng.randrange(len(t))] = rng.choice("abcé")
            t = "".join(t)
        v = rng.choice([None, [], [0.0, 0.0], [1.0, rng.random()], [rng.random(), rng.random(), 1.0]])
        rows.append((i, t, rng.choice([None, None, "x", "y"]), rng.choice([None, 1999, 2000, 2001, 2003]), v))
    return rows


def all_pairs(rows):
    out = set()
    for k, (a, ta, aa, ya, va) in enumerate(rows):
        for b, tb, ab, yb, vb in rows[k + 1 :]:
            if aa != ab:
                continue
            near = va and vb and len(va) == len(vb) and any(va) and any(vb) and np.dot(va, vb) / np.sqrt(np.dot(va, va) * np.dot(vb, vb)) >= 0.98
            if near or (ta and tb and (ya is None or yb is None or abs(ya - yb) <= 1) and D.jaro_winkler_of(ta, tb) >= 0.95):
                out.add((a, b))
    return out


@pytest.mark.parametrize("tile", [16, 1024])
def test_tiles_find_all_pairs(spark, tile, monkeypatch):
    monkeypatch.setattr(D, "TILE", tile)
    rows = papers()
    p = spark.createDataFrame(rows, "paper_id long, norm_title string, author string, year int, embedding array<float>").repartition(3)
    got = {tuple(r) for r in D.duplicate_pairs(D.candidate_pairs(p), p).collect()}
    f32 = [(*r[:4], r[4] and [float(np.float32(x)) for x in r[4]]) for r in rows]
    assert got == all_pairs(f32) and len(got) > 100


def test_more_than_five_hundred_without_author(spark):
    p = spark.createDataFrame([(f"p{i:03d}", "one title of all", None, 2000, None) for i in range(501)], "paper_id string, norm_title string, author string, year int, embedding array<float>")
    assert D.duplicate_pairs(D.candidate_pairs(p), p).count() == 501 * 500 // 2
    assert D.duplicate_pairs(D.candidate_pairs(p.limit(0)), p.limit(0)).count() == 0


def test_a_seed_meets_every_title(spark):
    from lodestar.operators import expand

    rows = [(i, t) for i, (_, t, *_) in enumerate(papers(5, 400))] + [(900, "Graph neural networks for genomes"), (901, "graph neural networks for genomes"), (902, "Hraft beer brewing"), (903, None)]
    p = spark.createDataFrame(rows, "paper_id long, title string").repartition(4)
    seeds = ["Hraph neural networks for genomes", "deep maps", "étude of cells", "deep maps"]
    got = {r["seed"]: (r["paper_id"], r["score"]) for r in expand.resolve_titles(spark.createDataFrame([(s,) for s in seeds], "title string"), p).collect()}
    norm = lambda t: " ".join("".join(c for c in (t or "").lower() if c.isalnum() or c.isspace()).split())
    assert got == {s: max(((i, D.jaro_winkler_of(norm(s), norm(t))) for i, t in rows), key=lambda x: (x[1], -x[0])) for s in seeds}
    assert got[seeds[0]][0] == 900
    assert expand.resolve_titles(spark.createDataFrame([("zzz",)], "title string"), p, 0.9).count() == 0
    assert expand.resolve_titles(spark.createDataFrame([], "title string"), p).count() == 0
