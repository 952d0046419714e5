"""Queries without SQL that run over whole tables, against brute force on small tables."""

import math
import random
from collections import Counter
from itertools import combinations

import pytest

from lodestar.operators import communities, dedup
from lodestar.plans.catalog import QUERIES


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(4)
    d = str(tmp_path_factory.mktemp("whole"))
    words = "amber birch cobalt delta ember fjord garnet harbor indigo jasper".split()
    titles = {i: " ".join(rng.sample(words, 5)) for i in range(1, 61)}
    titles[12] = titles[11] + "s"  # nearly equal, one author
    titles[14] = titles[13] + "s"  # nearly equal, years apart
    titles[701] = "quite another name"  # shares the DOI of 1
    year = {i: 25 for i in titles} | {14: 40} | {i: 24 for i in range(21, 31)}
    author = {i: 1 + i // 3 for i in titles} | {11: 90, 12: 90, 13: 91, 14: 91, 15: 92, 16: 92, 17: 93, 18: 94}
    lines = [(1000 + i, i, author[i]) for i in titles] + [(1000 + i, i, author[i] + 200) for i in titles if i % 4 == 0]
    lines += [(rng.randrange(1, 80), rng.choice(list(titles)), 300 + rng.randrange(20)) for _ in range(150)]
    vec = {i: [float(rng.gauss(0, 1)) for _ in range(8)] for i in range(1, 61)}
    vec[16] = [x * 1.01 for x in vec[15]]  # equal direction, one author
    vec[18] = list(vec[17])  # equal vectors, other authors: they never meet
    spark.createDataFrame([(i, titles[i], f"B{i % 2}", year[i]) for i in titles], "p_partkey long, p_name string, p_brand string, p_size int").write.parquet(f"{d}/part.parquet")
    spark.createDataFrame(lines, "l_orderkey long, l_partkey long, l_suppkey long").write.parquet(f"{d}/lineitem.parquet")
    spark.createDataFrame([(i, v, 0) for i, v in vec.items()], "vec_id long, embedding array<float>, label int").write.parquet(f"{d}/embeddings.parquet")
    texts = [(i, " ".join(rng.choice(words) for _ in range(30)), "en" if i % 3 else "de", "s", 1) for i in range(1, 31)]
    spark.createDataFrame(texts, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{d}/documents.parquet")
    first = {}
    for _, p, a in lines:
        first[p] = min(a, first.get(p, a))
    return d, {"titles": titles, "year": {i: 1975 + y for i, y in year.items()}, "first": first, "vec": vec, "lines": lines, "texts": texts}


def rows(spark, folder, name):
    return sorted(map(tuple, QUERIES[name](spark, folder[0]).collect()))


def clusters(t):
    """The smallest id of each paper's duplicates, over all pairs."""
    cos = lambda x, y: sum(a * b for a, b in zip(x, y)) / (sum(a * a for a in x) * sum(b * b for b in y)) ** 0.5
    keys = lambda i: {("doi", i % 2, i % 700)} | ({("arxiv", i % 900)} if i % 3 == 0 else set())
    comp = {i: i for i in t["titles"]}
    for a, b in combinations(sorted(comp), 2):
        near = a in t["vec"] and b in t["vec"] and cos(t["vec"][a], t["vec"][b]) >= 0.98
        alike = abs(t["year"][a] - t["year"][b]) <= 1 and dedup.jaro_winkler_of(t["titles"][a], t["titles"][b]) >= 0.95
        if keys(a) & keys(b) or t["first"][a] == t["first"][b] and (near or alike):
            low, high = sorted((comp[a], comp[b]))
            comp = {i: low if c == high else c for i, c in comp.items()}
    return {i: c for i, c in comp.items() if list(comp.values()).count(c) > 1}


def test_duplicates(spark, folder):
    want = clusters(folder[1])
    assert want[12] == 11 and want[16] == 15 and want[701] == 1 and not {14, 18} & want.keys()
    assert dict(rows(spark, folder, "dup_clusters")) == want
    pairs = rows(spark, folder, "dup_pairs")
    assert {(11, 12), (15, 16), (1, 701)} <= set(pairs)
    picked = dict(rows(spark, folder, "canonical_pick"))
    assert picked.keys() == want.keys() and all(want[c] == want[i] for i, c in picked.items())
    merged = rows(spark, folder, "merge_clusters")
    assert sorted(r[0] for r in merged) == sorted(set(picked.values())) and sum(r[2] for r in merged) == len(picked) - len(merged)
    of = lambda i: want.get(i, i)
    assert rows(spark, folder, "alias_rewrite") == sorted({(of(o), of(p)) for o, p, _ in folder[1]["lines"] if of(o) != of(p)})


def test_keywords(spark, folder):
    tf = {"en": Counter(), "de": Counter()}
    for _, text, lang, *_ in folder[1]["texts"]:
        w = text.split()
        for n in (1, 2, 3):
            tf[lang].update(" ".join(w[i : i + n]) for i in range(len(w) - n + 1))
    size = {k: sum(c.values()) for k, c in tf.items()}
    mean = sum(size.values()) / 2
    score = {k: {t: round(n / size[k] * math.log(1 + mean / sum(c[t] for c in tf.values())), 9) for t, n in c.items()} for k, c in tf.items()}
    want = sorted((k, t, x) for k, s in score.items() for t, x in sorted(s.items(), key=lambda e: (-e[1], e[0]))[:10])
    got = rows(spark, folder, "ctfidf_keywords")
    assert [r[:2] for r in got] == [r[:2] for r in want] and [r[2] for r in got] == pytest.approx([r[2] for r in want])


def test_author_degree(spark, folder):
    of = {}
    for _, p, a in folder[1]["lines"]:
        of.setdefault(p, set()).add(a)
    mates = {}
    for s in of.values():
        for a in s:
            mates.setdefault(a, set()).update(s - {a})
    assert rows(spark, folder, "author_degree") == sorted((a, len(m)) for a, m in mates.items() if m)


def test_titles(spark, folder):
    t = folder[1]["titles"]
    got = rows(spark, folder, "title_search")
    assert got == sorted((a, b) for a in t for b in t if t[a].startswith(t[b]) or t[b].startswith(t[a])) and (701, 701) in got and (11, 12) in got


def test_expansion(spark, folder):
    t = folder[1]
    seeds = {i for i, y in t["year"].items() if y == 2000}
    refs = {(o, p) for o, p, _ in t["lines"]}
    count = {i: None if i % 17 == 0 else sum(p == i for _, p in refs) for i in t["titles"]}
    top = {(s, c) for s in seeds for c in sorted((o for o, p in refs if p == s), key=lambda o: (-(count.get(o) or 0), o))[:10]}
    assert rows(spark, folder, "top_k_citers") == sorted(top)
    first = {}
    for s, c in sorted(top):
        first.setdefault(c, s)
    ok = lambda c: 1990 <= t["year"].get(c, 0) <= 2020
    assert rows(spark, folder, "expand_forward") == sorted((s, c, ok(c)) for c, s in first.items() if c not in seeds)
    back = {}
    for o, p in sorted(refs):
        if o in seeds and p not in seeds:
            back.setdefault(p, o)
    assert back and rows(spark, folder, "expand_backward") == sorted((o, p) for p, o in back.items())
    raw = [o for o, p in refs if p in seeds]
    hydrated = set(raw) & set(t["titles"])
    novel = hydrated - seeds
    good = sum(map(ok, novel))
    assert rows(spark, folder, "expand_stats") == [(len(raw), len(hydrated), len(novel), good, len(novel) - good)]
    wrote = {(p, a) for _, p, a in t["lines"]}
    score = Counter()
    for p, a in wrote:
        score[a] += count[p] or 0
    best = sorted({a for p, a in wrote if p in seeds}, key=lambda a: (-score[a], a))[:5]
    want = {p for a in best for p in sorted(q for q, b in wrote if b == a)[:40]} - seeds
    assert rows(spark, folder, "expand_by_author") == sorted((p,) for p in want)
    assert len(rows(spark, folder, "step_fingerprint")) == 1


def test_graph_of_all_lines(spark, folder):
    arcs = {(p, a * 37 + o) for o, p, a in folder[1]["lines"]}
    dag = {(min(e), max(e)) for e in arcs if e[0] != e[1]}
    assert {tuple(r)[:2] for r in rows(spark, folder, "mp_spc")} == dag
    assert set(rows(spark, folder, "undirected_edges")) == dag
    comp = {v: v for e in dag for v in e}
    for a, b in dag:
        low, high = sorted((comp[a], comp[b]))
        comp = {v: low if c == high else c for v, c in comp.items()}
    assert dict(rows(spark, folder, "connected_components")) == comp
    level = dict.fromkeys(comp, 0)
    for a, b in sorted(dag):
        level[b] = max(level[b], level[a] + 1)
    assert dict(rows(spark, folder, "mp_levels")) == level
    out = Counter(a for a, _ in dag)
    score = dict.fromkeys(comp, 1 / len(comp))
    for _ in range(300):
        loose = sum(x for v, x in score.items() if not out[v])
        nxt = dict.fromkeys(comp, (0.15 + 0.85 * loose) / len(comp))
        for a, b in dag:
            nxt[b] += 0.85 * score[a] / out[a]
        score = nxt
    got = dict(rows(spark, folder, "pagerank"))
    assert got.keys() == score.keys() and all(abs(got[v] - x) < 1e-8 for v, x in score.items())
    assert {r[0] for r in rows(spark, folder, "louvain")} == comp.keys()


def test_label_propagation_ends(spark):
    """No vertex is left with a label that is rarer among its neighbours than another; a star never settles if all move at once."""
    star = [(100, i) for i in range(101, 106)]
    chain = [(i, i + 1) for i in range(40)]
    clique = list(combinations(range(200, 206), 2)) + list(combinations(range(206, 212), 2)) + [(205, 206)]
    edges = star + chain + clique
    label = {r["paper_id"]: r["cid"] for r in communities.label_propagation(spark.createDataFrame(edges, "a long, b long")).collect()}
    near = {}
    for a, b in edges:
        near.setdefault(a, []).append(label[b])
        near.setdefault(b, []).append(label[a])
    assert label.keys() == near.keys()
    assert all(x.count(label[v]) == max(map(x.count, x)) for v, x in near.items())
    assert len({label[v] for v in range(100, 106)}) == 1
