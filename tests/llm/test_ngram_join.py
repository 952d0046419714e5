import random

import pytest

from lodestar.llm import ngram_join as nj


def brute(rows, n, num, den):
    def shingles(t):
        w = t.encode().lower().split() if t else []
        return {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()

    sets = [(d, shingles(t)) for d, t in rows]
    parent = {d: d for d, _ in sets if d is not None}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, (a, x) in enumerate(sets):
        for b, y in sets[:i]:
            if a is not None and b is not None and x and y and den * len(x & y) >= num * len(x | y):
                a1, b1 = find(a), find(b)
                parent[max(a1, b1)] = min(a1, b1)
    return sorted((d, len(s), None if d is None else find(d)) for d, s in sets if d is not None)


def noisy(rng, words, rate):
    return [rng.choice("abcdefghij") * 3 + str(rng.randrange(10**6)) if rng.random() < rate else w for w in words]


@pytest.mark.parametrize("n,num", [(4, 85), (5, 80)])
def test_against_brute_force(spark, n, num):
    rng = random.Random(n)
    passage = [f"p{i}" for i in range(55)]
    rows = []
    for i in range(60):
        base = [f"w{rng.randrange(4000)}" for _ in range(rng.choice([1, 3, 5, 8, 12, 30, 80, 200, 700]))]
        if i % 3 == 0:
            base[len(base) // 2 : len(base) // 2] = passage
        rows.append(" ".join(base))
        for _ in range(rng.randrange(5)):
            rows.append(" ".join(noisy(rng, base, rng.choice([0, 0.005, 0.01, 0.02, 0.04]))))
            rows.append(" ".join(base[: int(len(base) * rng.uniform(0.7, 1))]).upper())
    rows = list(enumerate([*rows, "", None, "  \n"]))
    got = nj.similar_groups(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), n, num, 100).collect()
    assert sorted(map(tuple, got)) == brute(rows, n, num, 100)


def test_keys_meet():
    """Any two sets at the bound share a key."""
    import numpy as np

    rng = np.random.default_rng(1)
    rule = nj.Rule(4, 85, 100)
    for a in [4, 7, 12, 13, 19, 40, 100, 333, 1000, 5000]:
        for _ in range(8):
            s = np.unique(rng.integers(0, 2**63, a).astype(np.uint64))
            gone = int(rng.integers(0, a * 0.16 + 1))
            for b in range(0, int(a * 0.17) + 1, max(1, a // 30)):
                t = np.unique(np.concatenate((s[gone:], rng.integers(0, 2**63, b).astype(np.uint64))))
                both = len(np.intersect1d(s, t))
                if 100 * both >= 85 * (len(s) + len(t) - both) and gone + b:
                    assert len(np.intersect1d(nj.keys_of(s, rule), nj.keys_of(t, rule))), (a, gone, b)


def test_odd_rows(spark):
    schema = "doc_id long, text string, n long, key string, bm string"
    assert nj.similar_groups(spark.createDataFrame([], schema)).count() == 0
    rows = [(1, "a b c d e f g", 1, "x", "y"), (1, "q r s t u v", 1, "x", None), (2, "A b C d e f g", None, None, None), (3, "q r s t u v", 1, "x", "y"), (None, "a b c d e f g", 1, "x", "y"), (5, None, 1, "x", "y")]
    got = nj.similar_groups(spark.createDataFrame(rows, schema)).collect()
    assert sorted(map(tuple, got), key=str) == sorted([(1, 3, 1), (1, 2, 1), (2, 3, 1), (3, 2, 1), (None, 3, None), (5, 0, 5)], key=str)
