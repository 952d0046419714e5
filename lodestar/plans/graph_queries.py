"""Queries over edges: expansion, set operations, similarity, PageRank, main path, authors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import expand as X
from ..operators import graph as G
from ..operators import mainpath as M
from ..operators import ranking as R
from ..sources.views import view
from .registry import Registry

query = Registry()


def dag(spark, d) -> DataFrame:
    return view(spark, d, "lit_dag")


# -- building and similarity ---------------------------------------------------------------------

_EDGES = "select distinct r.cited_id as src, r.citing_id as dst from lit_refs r join lit_papers a on a.paper_id = r.cited_id join lit_papers b on b.paper_id = r.citing_id where r.cited_id <> r.citing_id"


@query("citation_edges", _EDGES, "lit_papers", "lit_refs")
def citation_edges(spark, d):
    refs = view(spark, d, "lit_refs").groupBy(F.col("citing_id").alias("paper_id")).agg(F.collect_list("cited_id").alias("references"))
    p = view(spark, d, "lit_papers").join(refs, "paper_id", "left")
    return G.citation_edges(p)


@query("undirected_edges", "select distinct least(src, dst) as a, greatest(src, dst) as b from lit_cyc where src <> dst", "lit_cyc")
def undirected_edges(spark, d):
    return G.undirected(view(spark, d, "lit_cyc"))


_SIMS = """with refs as (select dst as id, src as item from lit_dag), cits as (select src as id, dst as item from lit_dag),
rn as (select id, count(*) as n from refs group by id), cn as (select id, count(*) as n from cits group by id),
rb as (select e.src, e.dst, count(*) as i from lit_dag e join refs a on a.id = e.src join refs b on b.id = e.dst and b.item = a.item group by 1, 2),
cb as (select e.src, e.dst, count(*) as i from lit_dag e join cits a on a.id = e.src join cits b on b.id = e.dst and b.item = a.item group by 1, 2),
r as (select e.src, e.dst, coalesce(rb.i, 0) as i, coalesce(r1.n, 0) + coalesce(r2.n, 0) - coalesce(rb.i, 0) as u, coalesce(cb.i, 0) as ci, coalesce(c1.n, 0) + coalesce(c2.n, 0) - coalesce(cb.i, 0) as cu
  from lit_dag e left join rb using (src, dst) left join cb using (src, dst) left join rn r1 on r1.id = e.src left join rn r2 on r2.id = e.dst left join cn c1 on c1.id = e.src left join cn c2 on c2.id = e.dst),
sims as (select src, dst, coalesce(i / nullif(cast(u as double), 0), 0) as ref_sim, coalesce(ci / nullif(cast(cu as double), 0), 0) as cit_sim from r)
"""


@query("edge_similarities", _SIMS + "select src, dst, round(ref_sim, 9) as ref_sim, round(cit_sim, 9) as cit_sim from sims", "lit_dag")
def edge_similarities(spark, d):
    return G.edge_similarities(dag(spark, d)).select("src", "dst", F.round("ref_sim", 9).alias("ref_sim"), F.round("cit_sim", 9).alias("cit_sim"))


@query("edge_weights", _SIMS + """, w as (select src, dst, greatest(coalesce(ref_sim / nullif((select max(ref_sim) from sims), 0), 0), coalesce(cit_sim / nullif((select max(cit_sim) from sims), 0), 0)) as w, ref_sim <= 0 and cit_sim <= 0 as z from sims)
select src, dst, round(case when z then coalesce((select quantile_cont(w, 0.25) from w where not z), 0.00001) else w end, 9) as weight from w""", "lit_dag")
def edge_weights(spark, d):
    return G.edge_weights(G.edge_similarities(dag(spark, d))).select("src", "dst", F.round("weight", 9).alias("weight"))


@query("semantic_similarities", """with v as (select * from lit_vectors where embedding is not null),
e as (select distinct src, dst from (select l_partkey as src, l_suppkey * 37 + l_orderkey as dst from lineitem) t where src <> dst)
select e.src, e.dst, round(case when a.embedding is null or b.embedding is null then 0 else coalesce(list_cosine_similarity(cast(a.embedding as double[]), cast(b.embedding as double[])), 0) end, 6) as semantic_similarity
from e left join v a on a.paper_id = e.src left join v b on b.paper_id = e.dst""", "lit_vectors")
def semantic_similarities(spark, d):
    e = view(spark, d, "lit_cyc").where("src <> dst").distinct()
    return G.semantic_similarities(e, view(spark, d, "lit_vectors")).select("src", "dst", F.round("semantic_similarity", 6).alias("semantic_similarity"))


@query("saturation", "select p.paper_id, round(s.x, 9) as saturation from (select distinct citing_id as paper_id from lit_refs) p left join (select citing_id, count(case when c.paper_id is not null then 1 end) / cast(count(*) as double) as x from lit_refs left join (select paper_id from lit_papers where citation_count >= 30) c on c.paper_id = cited_id where cited_id <> citing_id group by citing_id) s on s.citing_id = p.paper_id", "lit_papers", "lit_refs")
def saturation(spark, d):
    p = view(spark, d, "lit_refs").groupBy(F.col("citing_id").alias("paper_id")).agg(F.collect_list("cited_id").alias("references"))
    c = view(spark, d, "lit_papers").where("citation_count >= 30")
    return G.saturation(p, c).select("paper_id", F.round("saturation", 9).alias("saturation"))


# -- PageRank and components ---------------------------------------------------------------------

#: Rounds of the SQL, whose scores stay before that; the operator's run to a tolerance, and the rounds that it may take.
SQL_ROUNDS, RANK_ROUNDS, RANK_TOLERANCE = 60, 1000, 1e-14

_RANK = f"""with recursive v as (select src as id from lit_dag union select dst from lit_dag),
od as (select src, count(*) as d from lit_dag group by src), nn as (select count(*) as n from v),
r as (select 0 as it, id, cast(1.0 as double) / (select n from nn) as s from v
  union all
  select x.it + 1, v.id, 0.15 / nn.n + 0.85 * (coalesce(c.came, 0) + x.dang / nn.n)
  from v cross join nn cross join (select r.it, sum(case when od.d is null then r.s else 0 end) as dang from r left join od on od.src = r.id group by r.it) x
  left join (select e.dst, sum(r.s / od.d) as came from r join od on od.src = r.id join lit_dag e on e.src = r.id group by e.dst) c on c.dst = v.id
  where x.it < {SQL_ROUNDS})
select id, round(s, 10) as score from r where it = {SQL_ROUNDS}"""


@query("pagerank", _RANK, "lit_dag")
def pagerank(spark, d):
    return G.pagerank(dag(spark, d), RANK_ROUNDS, tolerance=RANK_TOLERANCE).select("id", F.round("score", 10).alias("score"))


#: Steps of the SQL, more than any shortest path here is long.
_COMP = """with recursive u as (select src as a, dst as b from lit_cyc where src <> dst union select dst, src from lit_cyc where src <> dst),
r as (select 0 as it, a as id, min(a) as comp from u group by a
  union all
  select it + 1, id, min(comp) from (select it, id, comp from r union all select r.it, u.b, r.comp from r join u on u.a = r.id) t where it < 40 group by it + 1, id)
"""


@query("connected_components", _COMP + "select id, comp from r where it = 40", "lit_cyc")
def connected_components(spark, d):
    return G.components(view(spark, d, "lit_cyc")).select("id", "comp")


_SCC = """with recursive e as (select distinct src, dst from lit_cyc where src <> dst),
w as (select src as a, dst as b from e union select w.a, e.dst from w join e on e.src = w.b),
ids as (select src as id from lit_cyc union select dst from lit_cyc),
scc as (select i.id, least(i.id, coalesce((select min(f.b) from w f join w g on g.a = f.b and g.b = f.a where f.a = i.id), i.id)) as scc from ids i)
"""


@query("strong_components", _SCC + "select id, scc from scc", "lit_cyc")
def strong_components(spark, d):
    return G.strong_components(view(spark, d, "lit_cyc"))


_SHRINK = _SCC + """, m as (select s.id, first_value(s.id) over (partition by scc order by coalesce(year, 99999), coalesce(citation_count, 0) desc, s.id) as rep from scc s left join lit_papers p on p.paper_id = s.id)
select distinct a.rep as src, b.rep as dst from lit_cyc c join m a on a.id = c.src join m b on b.id = c.dst where a.rep <> b.rep"""


@query("scc_shrink", _SHRINK, "lit_cyc", "lit_papers")
def scc_shrink(spark, d):
    return M.shrink(view(spark, d, "lit_cyc"), view(spark, d, "lit_papers"))[0]


@query("preprint_transform", _SCC + """, s as (select *, count(*) over (partition by scc) as n from scc)
select e.src, a.n > 1 as src_copy, e.dst, false as dst_copy from e join s a on a.id = e.src join s b on b.id = e.dst where a.scc <> b.scc
union select a.id, false, b.id, true from s a join s b on a.scc = b.scc where a.n > 1""", "lit_cyc")
def preprint_transform(spark, d):
    return M.preprint_transform(view(spark, d, "lit_cyc"))


# -- main path -----------------------------------------------------------------------------------

_COUNTS = """with recursive
bi as (select src as v from lit_dag except select dst from lit_dag), bo as (select dst as v from lit_dag except select src from lit_dag), al as (select src as v from lit_dag union select dst from lit_dag),
ri as (select 0 as it, v, cast(1 as hugeint) as n from {bi} union all select it + 1, dst, cast(sum(n) as hugeint) from ri join lit_dag e on e.src = ri.v group by it + 1, dst),
ro as (select 0 as it, v, cast(1 as hugeint) as n from {bo} union all select it + 1, src, cast(sum(n) as hugeint) from ro join lit_dag e on e.dst = ro.v group by it + 1, src),
arcs as (select e.src, e.dst, a.n * b.n as w from lit_dag e join (select v, sum(n) as n from ri group by v) a on a.v = e.src join (select v, sum(n) as n from ro group by v) b on b.v = e.dst)
"""
_KINDS = {"spc": ("bi", "bo"), "splc": ("al", "bo"), "spnp": ("al", "al")}


def _arcs_sql(kind: str) -> str:
    return _COUNTS.format(bi=_KINDS[kind][0], bo=_KINDS[kind][1])


def _written(df: DataFrame) -> DataFrame:
    return df.select("src", "dst", M.digits("w").alias("w"))


for _kind in _KINDS:

    @query(f"mp_{_kind}", _arcs_sql(_kind) + "select src, dst, cast(w as varchar) as w from arcs", "lit_dag")
    def _weights(spark, d, kind=_kind):
        return _written(M.arc_weights(dag(spark, d), kind))


_GREEDY = """, {n}_best as (select a.{f} as v, a.{t} as nxt, a.src, a.dst, a.w from arcs a where a.w > 0 and a.w >= {tol} * (select max(b.w) from arcs b where b.{f} = a.{f})),
{n}_walk as (select v from {start} union select g.nxt from {n}_walk k join {n}_best g on g.v = k.v),
{n}_on as (select g.src, g.dst, g.w from {n}_best g join {n}_walk k on k.v = g.v)
"""
_F = dict(f="src", t="dst", tol="1")
_B = dict(f="dst", t="src", tol="1")


@query("mp_local_forward", _arcs_sql("spc") + _GREEDY.format(n="f", start="bi", **_F) + "select src, dst, cast(w as varchar) as w from f_on", "lit_dag")
def mp_local_forward(spark, d):
    return _written(M.local_forward(M.arc_weights(dag(spark, d))))


@query("mp_local_backward", _arcs_sql("spc") + _GREEDY.format(n="f", start="bo", **_B) + "select src, dst, cast(w as varchar) as w from f_on", "lit_dag")
def mp_local_backward(spark, d):
    return _written(M.local_backward(M.arc_weights(dag(spark, d))))


@query("mp_multi_local", _arcs_sql("spc") + _GREEDY.format(n="f", start="bi", f="src", t="dst", tol="0.75") + "select src, dst, cast(w as varchar) as w from f_on", "lit_dag")
def mp_multi_local(spark, d):
    return _written(M.multi_local(M.arc_weights(dag(spark, d)), 0.25))


@query("mp_key_route", _arcs_sql("spc") + ", seeds as (select * from arcs where w > 0 order by w desc, src, dst limit 3), sf as (select dst as v from seeds), sb as (select src as v from seeds)" + _GREEDY.format(n="f", start="sf", **_F) + _GREEDY.format(n="g", start="sb", **_B) + "select src, dst, cast(w as varchar) as w from (select src, dst, w from seeds union select src, dst, w from f_on union select src, dst, w from g_on) t", "lit_dag")
def mp_key_route(spark, d):
    return _written(M.key_route(M.arc_weights(dag(spark, d)), 3))


@query("mp_global", _arcs_sql("spc") + """, sums as (select v, cast(0 as hugeint) as s from bi union select a.dst, cast(s + a.w as hugeint) from sums join arcs a on a.src = sums.v),
best as (select v, max(s) as best from sums group by v),
pred as (select a.dst as v, min(a.src) as p from arcs a join best x on x.v = a.src join best y on y.v = a.dst where x.best + a.w = y.best group by a.dst),
walk as (select v from (select b.v from best b join bo using (v) order by best desc, b.v limit 1) t union select p.p from walk k join pred p on p.v = k.v)
select a.src, a.dst, cast(a.w as varchar) as w from walk k join pred p on p.v = k.v join arcs a on a.src = p.p and a.dst = p.v""", "lit_dag")
def mp_global(spark, d):
    return _written(M.global_path(M.arc_weights(dag(spark, d))))


@query("mp_roles", None)
def mp_roles(spark, d):
    """The vertices of the key-route main path of the graph with cycles shrunk, with role and level."""
    return M.main_path(view(spark, d, "lit_cyc"), view(spark, d, "lit_papers"), "spc", "key-route", "shrink", k=2)[1]


@query("mp_levels", "with recursive l as (select v, 0 as level from (select src as v from lit_dag except select dst from lit_dag) t union select e.dst, l.level + 1 from l join lit_dag e on e.src = l.v) select v as id, max(level) as level from l group by v", "lit_dag")
def mp_levels(spark, d):
    return M.levels(dag(spark, d))


# -- expansion -----------------------------------------------------------------------------------

#: Expansion starts from all papers of this year.
SEED_YEAR = 2000


def _signal(spark, d) -> DataFrame:
    return view(spark, d, "lit_papers").where(F.col("year") == SEED_YEAR).select("paper_id", F.col("paper_id").alias("ord"))


_SOURCES = f"src as (select paper_id, paper_id as ord from lit_papers where year = {SEED_YEAR})"


@query("top_k_citers", f"with {_SOURCES} select source, cand from (select s.paper_id as source, r.citing_id as cand, row_number() over (partition by s.paper_id order by coalesce(p.citation_count, 0) desc, r.citing_id) as rn from src s join lit_refs r on r.cited_id = s.paper_id left join lit_papers p on p.paper_id = r.citing_id) t where rn <= 10", "lit_papers", "lit_refs")
def top_k_citers(spark, d):
    return X.top_citers(_signal(spark, d), view(spark, d, "lit_refs"), view(spark, d, "lit_papers"), 10).select("source", "cand")


@query("expand_forward", f"""with {_SOURCES}, top as (select source, cand from (select s.paper_id as source, r.citing_id as cand, row_number() over (partition by s.paper_id order by coalesce(p.citation_count, 0) desc, r.citing_id) as rn from src s join lit_refs r on r.cited_id = s.paper_id left join lit_papers p on p.paper_id = r.citing_id) t where rn <= 10),
claimed as (select cand, min(source) as source from top where cand not in (select paper_id from src) group by cand)
select c.source, c.cand, coalesce(p.year between 1990 and 2020, false) as passed from claimed c left join lit_papers p on p.paper_id = c.cand""", "lit_papers", "lit_refs")
def expand_forward(spark, d):
    from ..operators.screening import YearFilter

    papers, sig = view(spark, d, "lit_papers"), _signal(spark, d)
    claimed = X.expand_forward(sig, view(spark, d, "lit_refs"), papers, sig, 10)
    known = claimed.join(papers.withColumnRenamed("paper_id", "cand"), "cand", "left")
    return known.select("source", "cand", YearFilter(1990, 2020).passes().alias("passed"))


@query("expand_backward", f"with {_SOURCES}, claimed as (select cited_id as cand, min(citing_id) as source from lit_refs where citing_id in (select paper_id from src) and cited_id not in (select paper_id from src) group by cited_id) select source, cand from claimed", "lit_papers", "lit_refs")
def expand_backward(spark, d):
    sig = _signal(spark, d)
    return X.expand_backward(sig, view(spark, d, "lit_refs"), sig).select("source", "cand")


_CANDS = "coalesce(dotp / nullif(na * nb, 0), 0)"
_VPAIR = """vp as (select a.paper_id as anchor, b.paper_id as paper_id, list_sum(list_transform(range(1, len(a.embedding) + 1), lambda i: cast(a.embedding[i] as double) * cast(b.embedding[i] as double))) as dotp,
  sqrt(list_sum(list_transform(a.embedding, lambda v: cast(v as double) * cast(v as double)))) as na, sqrt(list_sum(list_transform(b.embedding, lambda v: cast(v as double) * cast(v as double)))) as nb
  from lit_vectors a join lit_vectors b on a.paper_id <> b.paper_id where a.paper_id in (0, 7, 14, 21, 28))"""


@query("expand_semantics_per_paper", f"with {_VPAIR} select anchor, paper_id, round({_CANDS}, 6) as score from (select *, row_number() over (partition by anchor order by {_CANDS} desc, paper_id) as rn from vp) t where rn <= 10", "lit_vectors")
def expand_semantics_per_paper(spark, d):
    v = view(spark, d, "lit_vectors")
    return X.nearest(v.where(F.col("paper_id").isin(0, 7, 14, 21, 28)), v, 10).select("anchor", "paper_id", F.round("score", 6).alias("score"))


_MULTI = """with d as (select i, avg(case when paper_id in (0, 7, 14) then cast(embedding[i] as double) end) - avg(case when paper_id in (3, 5) then cast(embedding[i] as double) end) as x from lit_vectors, range(1, 65) t(i) where paper_id in (0, 7, 14, 3, 5) group by i),
p as (select v.paper_id, sum(cast(v.embedding[d.i] as double) * d.x) as dotp, sqrt(sum(d.x * d.x)) as na, sqrt(sum(cast(v.embedding[d.i] as double) * cast(v.embedding[d.i] as double))) as nb from lit_vectors v, d where v.paper_id not in (0, 7, 14, 3, 5) group by v.paper_id)
select paper_id, round(dotp / (na * nb), 6) as score from p order by dotp / (na * nb) desc, paper_id limit 20"""


@query("expand_semantics_multi_anchor", _MULTI, "lit_vectors")
def expand_semantics_multi_anchor(spark, d):
    v = view(spark, d, "lit_vectors")
    return X.recommend(v.where(F.col("paper_id").isin(0, 7, 14)), v.where(F.col("paper_id").isin(3, 5)), v, 20).select("paper_id", F.round("score", 6).alias("score"))


@query("expand_by_author", f"""with {_SOURCES}, mine as (select distinct author_id from lit_authorship where paper_id in (select paper_id from src)), m as (select author_id, sum(coalesce(citation_count, 0)) as score from lit_authorship join lit_papers using (paper_id) group by author_id),
best as (select author_id from mine left join m using (author_id) order by coalesce(score, 0) desc, author_id limit 5),
p as (select a.author_id, a.paper_id, row_number() over (partition by a.author_id order by a.paper_id) as rn from lit_authorship a join best using (author_id))
select distinct paper_id from p where rn <= 40 and paper_id not in (select paper_id from src)""", "lit_papers", "lit_authorship")
def expand_by_author(spark, d):
    a, p, sig = view(spark, d, "lit_authorship"), view(spark, d, "lit_papers"), _signal(spark, d)
    metric = a.join(p, "paper_id").groupBy("author_id").agg(F.sum(F.coalesce("citation_count", F.lit(0))).alias("score"))
    return X.expand_by_author(sig, a, metric, sig, 5, 40)


@query("parallel_union", "select paper_id, cast(min(branch) as int) as branch from (select paper_id, 0 as branch from lit_papers where year >= 2010 union all select paper_id, 1 from lit_papers where coalesce(citation_count, 0) >= 30 union all select paper_id, 2 from lit_papers where contains(title, 'red')) t group by paper_id", "lit_papers")
def parallel_union(spark, d):
    p = view(spark, d, "lit_papers").withColumn("ord", F.col("paper_id"))
    return X.parallel_union([p.where("year >= 2010"), p.where("coalesce(citation_count, 0) >= 30"), p.where(F.col("title").contains("red"))]).select("paper_id", "branch")


@query("expand_stats", f"with {_SOURCES}, raw as (select citing_id from lit_refs where cited_id in (select paper_id from src)), h as (select distinct citing_id from raw), p as (select h.citing_id, q.year from h join lit_papers q on q.paper_id = h.citing_id), n as (select * from p where citing_id not in (select paper_id from src)) select (select count(*) from raw) as raw_hits, (select count(*) from p) as hydrated, (select count(*) from n) as novel, (select count(*) from n where year between 1990 and 2020) as accepted, (select count(*) from n where not coalesce(year between 1990 and 2020, false)) as rejected", "lit_papers", "lit_refs")
def expand_stats(spark, d):
    from ..operators.screening import YearFilter, screen

    p, sig = view(spark, d, "lit_papers"), _signal(spark, d)
    raw = view(spark, d, "lit_refs").join(sig.select(F.col("paper_id").alias("cited_id")), "cited_id", "left_semi").select(F.col("citing_id").alias("paper_id"))
    hydrated = raw.distinct().join(p, "paper_id")
    novel = hydrated.join(sig, "paper_id", "left_anti")
    return X.expand_stats(raw, hydrated, novel, screen(novel, YearFilter(1990, 2020)))


@query("rescreen", f"select paper_id from lit_papers where year = {SEED_YEAR} or coalesce(year between 1990 and 2020 and citation_count >= 25, false)", "lit_papers")
def rescreen(spark, d):
    from ..operators.screening import YearFilter

    p = view(spark, d, "lit_papers")
    kept, _ = X.rescreen(p, _signal(spark, d), p.where(YearFilter(1990, 2020).passes() & (F.coalesce("citation_count", F.lit(0)) >= 25)))
    return kept.select("paper_id")


@query("step_fingerprint", f"""with {_SOURCES} select sha256(concat_ws('|', 'ExpandForward', 'max_citations=10', cast(count(*) as varchar),
cast(sum(cast(cast('0x' || substr(md5(cast(paper_id as varchar)), 1, 15) as bigint) as hugeint)) as varchar))) as fingerprint from src""", "lit_papers")
def step_fingerprint(spark, d):
    return X.fingerprint(_signal(spark, d), "ExpandForward", "max_citations=10")


@query("collection_delta", "select paper_id from lit_papers where year >= 2000 except select paper_id from lit_papers where year >= 2010", "lit_papers")
def collection_delta(spark, d):
    p = view(spark, d, "lit_papers")
    return p.where("year >= 2000").select("paper_id").exceptAll(p.where("year >= 2010").select("paper_id"))


# -- ranking -------------------------------------------------------------------------------------

@query("rerank_citation", "select paper_id, coalesce(citation_count, 0) as score from lit_papers order by coalesce(citation_count, 0) desc, paper_id limit 100", "lit_papers")
def rerank_citation(spark, d):
    p = view(spark, d, "lit_papers")
    return R.rerank(p.select("paper_id", F.col("paper_id").alias("ord")), p.select("paper_id", F.col("citation_count").alias("score")), 100).select("paper_id", "score")


@query("rerank_pagerank", _RANK.replace("select id, round(s, 10) as score from r", "select id as paper_id from r") + " order by round(s, 10) desc, id limit 25", "lit_dag")
def rerank_pagerank(spark, d):
    s = G.pagerank(dag(spark, d), RANK_ROUNDS, tolerance=RANK_TOLERANCE).select(F.col("id").alias("paper_id"), F.round("score", 10).alias("score"))
    return R.rerank(s.select("paper_id", F.col("paper_id").alias("ord")), s, 25).select("paper_id")


_DIVERSE = """with s as (select v.paper_id, v.label as cid, coalesce(p.citation_count, 0) as score from lit_vectors v left join lit_papers p using (paper_id)),
z as (select cid, count(*) as n, 30 - (select count(distinct cid) from s) as surplus, (select count(*) from s) as total from s group by cid),
a as (select cid, n, least(n * surplus // total, n - 1) as g, (n * surplus) % total as f, surplus from z),
b as (select *, row_number() over (order by f desc, n desc, cid) as rn, surplus - sum(g) over () as rest from a),
q as (select cid, 1 + g + case when rn <= rest then 1 else 0 end as slots from b),
r as (select s.*, row_number() over (partition by s.cid order by score desc, paper_id) as rn from s)
select r.paper_id, r.cid, r.score from r join q on q.cid = r.cid where r.rn <= q.slots"""


@query("diverse_top_k", _DIVERSE, "lit_papers", "lit_vectors")
def diverse_top_k(spark, d):
    s = view(spark, d, "lit_vectors").join(view(spark, d, "lit_papers"), "paper_id", "left")
    return R.diverse_top_k(s.select("paper_id", F.col("label").alias("cid"), F.coalesce("citation_count", F.lit(0)).alias("score")), 30)


@query("hitl_sample", """with s as (select paper_id, coalesce(year between 1990 and 2020, false) and coalesce(citation_count, 0) >= 25 as accepted, case when not coalesce(year between 1990 and 2020, false) then 'year' else 'citation' end as category, md5('7:' || paper_id) as h from lit_papers),
n as (select *, row_number() over (partition by category order by h, paper_id) as turn from s where not accepted)
select paper_id, accepted, category from (select * from n where turn <= 10 order by turn, category limit 10) union all select paper_id, accepted, category from (select * from s where accepted order by h, paper_id limit 10)""", "lit_papers")
def hitl_sample(spark, d):
    year = F.coalesce(F.col("year").between(1990, 2020), F.lit(False))
    s = view(spark, d, "lit_papers").select("paper_id", (year & (F.coalesce("citation_count", F.lit(0)) >= 25)).alias("accepted"), F.when(~year, "year").otherwise("citation").alias("category"))
    return R.hitl_sample(s, 20, "7")


# -- authors -------------------------------------------------------------------------------------

def _authorship(spark, d) -> DataFrame:
    return view(spark, d, "lit_authorship").join(view(spark, d, "lit_papers"), "paper_id").select("paper_id", "year", "citation_count", F.col("author_id").alias("author"))


@query("collab_edges", "with n as (select paper_id, count(*) as n from lit_authorship group by paper_id) select a.author_id as a, b.author_id as b, count(*) as n_papers, round(sum(1.0 / n.n), 6) as strength, coalesce(min(year), 0) as first_year, coalesce(max(year), 0) as last_year, coalesce(max(year), 0) - coalesce(min(year), 0) as duration from lit_authorship a join lit_authorship b on a.paper_id = b.paper_id and a.author_id < b.author_id join n on n.paper_id = a.paper_id join lit_papers p on p.paper_id = a.paper_id group by 1, 2", "lit_papers", "lit_authorship")
def collab_edges(spark, d):
    return G.collaboration(_authorship(spark, d)).withColumn("strength", F.round("strength", 6))


@query("author_stats", "select author_id as author, coalesce(min(year), 0) as year_entered, count(*) as papers, cast(sum(coalesce(citation_count, 0)) as bigint) as citations from lit_authorship join lit_papers using (paper_id) group by author_id", "lit_papers", "lit_authorship")
def author_stats(spark, d):
    return G.author_stats(_authorship(spark, d))


@query("author_degree", "with e as (select distinct a.author_id as a, b.author_id as b from lit_authorship a join lit_authorship b on a.paper_id = b.paper_id and a.author_id < b.author_id) select id, count(*) as degree from (select a as id from e union all select b from e) t group by id", "lit_authorship")
def author_degree(spark, d):
    return G.collaborators(view(spark, d, "lit_authorship").select("paper_id", F.col("author_id").alias("author")))
