from itertools import combinations

from lodestar.operators import graph as G
from lodestar.plans import graph_queries as Q


def test_collaborators_in_lists_and_blocks(spark, monkeypatch, tmp_path):
    """Papers of more authors than a block holds, repeated rows, busy authors; papers that no part describes count, as in the SQL."""
    monkeypatch.setattr(G, "AUTHOR_BLOCK", 4)
    monkeypatch.setattr(G, "AUTHOR_WORK", 9)
    by = {1: [1, 2, 3], 2: [3, 4], 3: list(range(10, 25)), 4: [5], 5: [2, 3, 10]}
    met = {frozenset(p) for a in by.values() for p in combinations(a, 2)}
    want = {v: sum(v in p for p in met) for a in by.values() for v in a if any(v in p for p in met)}
    rows = [(p, a) for p, x in by.items() for a in x]
    got = G.collaborators(spark.createDataFrame([*rows, (2, 4), (6, None)], "paper_id long, author long"))
    assert {r["id"]: r["degree"] for r in got.collect()} == want
    spark.createDataFrame([(p, a, 1) for p, a in rows], "l_partkey long, l_suppkey long, l_orderkey long").write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.createDataFrame([(1, "x", "y", 3)], "p_partkey long, p_name string, p_brand string, p_size int").write.parquet(f"{tmp_path}/part.parquet")
    assert {r["id"]: r["degree"] for r in Q.author_degree(spark, str(tmp_path)).collect()} == want
