import pytest
from pyspark.sql import functions as F

from lodestar.operators import mainpath as M

ARCS = [(3, 5), (3, 21), (5, 12), (12, 15), (12, 20), (15, 22), (20, 21), (20, 22), (21, 22)]
WEIGHTS = {
    "spc": [3, 1, 3, 1, 2, 1, 1, 1, 2],
    "splc": [3, 1, 6, 3, 6, 4, 4, 4, 6],
    "spnp": [8, 2, 14, 6, 12, 4, 8, 4, 6],
}


@pytest.fixture(scope="module")
def graph(spark):
    return spark.createDataFrame(ARCS, "src long, dst long")


def arcs(df):
    return {(r["src"], r["dst"]) for r in df.collect()}


@pytest.mark.parametrize("kind", sorted(WEIGHTS))
def test_weights(graph, kind):
    got = {(r["src"], r["dst"]): int(r["w"]) for r in M.arc_weights(graph, kind).withColumn("w", M.digits("w")).collect()}
    assert got == dict(zip(ARCS, WEIGHTS[kind]))


def test_flow_law(graph):
    """What SPC brings into an inner vertex leaves it."""
    w = M.arc_weights(graph, "spc").withColumn("w", M.digits("w").cast("long"))
    into = {r[0]: r[1] for r in w.groupBy("dst").agg(F.sum("w")).collect()}
    out = {r[0]: r[1] for r in w.groupBy("src").agg(F.sum("w")).collect()}
    assert all(into[v] == out[v] for v in into if v in out)


def test_searches(graph):
    w = M.arc_weights(graph, "spc")
    forward = {(3, 5), (5, 12), (12, 20), (20, 21), (20, 22), (21, 22)}
    assert arcs(M.local_forward(w)) == forward
    assert arcs(M.local_backward(w)) == {(21, 22), (3, 21), (20, 21), (12, 20), (5, 12), (3, 5)}
    assert arcs(M.global_path(w)) == {(3, 5), (5, 12), (12, 20), (20, 21), (21, 22)}
    assert arcs(M.key_route(w, 1)) == forward
    assert arcs(M.key_route(w, 0)) == set()
    assert arcs(M.multi_local(w, 0.0)) == forward
    assert arcs(M.multi_local(w, 1.0)) == set(ARCS)


def test_levels_and_cycles(spark, graph):
    assert {r["id"]: r["level"] for r in M.levels(graph).collect()} == {3: 0, 5: 1, 12: 2, 15: 3, 20: 3, 21: 4, 22: 5}
    with pytest.raises(ValueError):
        M.levels(spark.createDataFrame([(1, 2), (2, 1)], "src long, dst long"))


def test_shrink_and_preprint(spark):
    e = spark.createDataFrame([(1, 2), (2, 3), (3, 2), (3, 4), (4, 4)], "src long, dst long")
    papers = spark.createDataFrame([(1, 2000, 5), (2, 2005, 1), (3, 2001, 9), (4, None, None)], "paper_id long, year int, citation_count long")
    edges, members = M.shrink(e, papers)
    assert arcs(edges) == {(1, 3), (3, 4)}
    assert {r["id"]: r["rep"] for r in members.collect()} == {1: 1, 2: 3, 3: 3, 4: 4}
    got = {tuple(r) for r in M.preprint_transform(e).collect()}
    inside = {(u, False, v, True) for u in (2, 3) for v in (2, 3)}
    assert got == {(1, False, 2, False), (3, True, 4, False)} | inside


def test_roles(spark, graph):
    papers = spark.createDataFrame([(v, 2000, 1) for v in {x for a in ARCS for x in a}], "paper_id long, year int, citation_count long")
    _, v = M.main_path(graph, papers, search="global")
    assert {r["id"]: r["role"] for r in v.collect()} == {3: "source", 5: "intermediate", 12: "intermediate", 20: "intermediate", 21: "intermediate", 22: "sink"}
    with pytest.raises(ValueError):
        M.main_path(graph, papers, search="nothing")


def plain_weights(arcs, kind):
    """Weights of arcs between ascending ids, with Python's whole numbers."""
    begin, end = M.WEIGHTS[kind]
    ids = sorted({v for a in arcs for v in a})
    heads, tails = {d for _, d in arcs}, {s for s, _ in arcs}
    n_in = {v: int(begin or v not in heads) for v in ids}
    n_out = {v: int(end or v not in tails) for v in ids}
    for s, d in sorted(arcs):
        n_in[d] += n_in[s]
    for s, d in sorted(arcs, key=lambda a: (-a[1], -a[0])):
        n_out[s] += n_out[d]
    return {(s, d): n_in[s] * n_out[d] for s, d in arcs}


def test_weights_of_any_size(spark):
    """Full layers of 70: counts of more than 38 digits, exact, and searches over them."""
    width, depth = 90, 22
    arcs_ = [(width * k + i, width * (k + 1) + j) for k in range(depth - 1) for i in range(width) for j in range(width)]
    arcs_ += [(width * k + 3, width * (k + 2) + 5) for k in range(depth - 2)]  # arcs that skip layers make the weights of the others differ
    want = plain_weights(arcs_, "spc")
    assert len(str(max(want.values()))) > 38
    w = M.arc_weights(spark.createDataFrame(arcs_, "src long, dst long"), "spc")
    assert {(r["src"], r["dst"]): int(r["w"]) for r in w.withColumn("w", M.digits("w")).collect()} == want
    heaviest = [(r["src"], r["dst"]) for r in w.orderBy(F.desc("w"), "src", "dst").limit(5).collect()]
    assert heaviest == sorted(want, key=lambda a: (-want[a], a))[:5]


@pytest.mark.parametrize("kind", sorted(M.WEIGHTS))
def test_weights_of_random_graphs(spark, kind):
    import random

    rng = random.Random(17)
    some = sorted({tuple(sorted(rng.sample(range(14), 2))) for _ in range(40)})
    got = M.arc_weights(spark.createDataFrame(some, "src long, dst long"), kind).withColumn("w", M.digits("w"))
    assert {(r["src"], r["dst"]): int(r["w"]) for r in got.collect()} == plain_weights(some, kind)


def test_a_round_reads_only_the_arcs_left(spark):
    """300 arcs leave sources and 3 go on behind them: the arcs are written once by level, and the later rounds see those 3 only."""
    e = spark.createDataFrame([(i, 1000 + i % 50) for i in range(300)] + [(1000, 2000), (2000, 3000), (1001, 2000)], "src long, dst long")
    folder, sizes = M._peeled(e)
    assert sizes == [300, 2, 1]
    assert [spark.read.parquet(f"{folder}/at={k}").count() for k in range(3)] == [303, 3, 1]
    assert {(r["src"], r["dst"]): r["at"] for r in M._by_level(e, folder).where("at > 0").collect()} == {(1000, 2000): 1, (1001, 2000): 1, (2000, 3000): 2}
    assert M.levels(e.limit(0)).count() == 0
    assert {r["id"]: r["n"] for r in M.path_counts(e).where("id >= 2000").collect()} == {2000: "12", 3000: "12"}
