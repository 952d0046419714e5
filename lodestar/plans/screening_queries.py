"""Queries over predicates, screeners and similarity measures."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import screening as S
from ..operators import search_agent
from ..operators.verdicts import register_model
from ..sources.views import view
from .registry import Registry

YEAR = 2025
query = Registry()


def _flat(df: DataFrame, *cols: str) -> DataFrame:
    return df.select(*cols, F.col("outcome.passed").alias("passed"), F.col("outcome.category").alias("category"))


def _screened(spark: SparkSession, sf_dir: str, block: S.Block) -> DataFrame:
    return _flat(S.screen(view(spark, sf_dir, "lit_papers"), block), "paper_id")


def _case(ok: str, category: str) -> str:
    return f"select paper_id, coalesce({ok}, false) as passed, case when coalesce({ok}, false) then '' else '{category}' end as category from lit_papers"


@query("filter_year", _case("year between 1990 and 2020", "year"), "lit_papers")
def filter_year(spark, d):
    return _screened(spark, d, S.YearFilter(1990, 2020))


_CIT = """select paper_id,
  case when year is not null and year >= 2025 - 2 then true when citation_count is null then false else citation_count >= greatest(2025 - coalesce(year, 0), 1) * cast(1.0 as double) end as passed,
  case when year is not null and year >= 2025 - 2 then '' when citation_count is null then 'missing_data' when citation_count >= greatest(2025 - coalesce(year, 0), 1) * cast(1.0 as double) then '' else 'citation' end as category
from lit_papers"""


@query("filter_citation", _CIT, "lit_papers")
def filter_citation(spark, d):
    return _screened(spark, d, S.CitationFilter(YEAR, 1.0, 2))


@query("filter_citation_strict", """select paper_id, case when citation_count is null then false else citation_count >= greatest(2025 - coalesce(year, 0), 1) * cast(1.5 as double) end as passed,
  case when citation_count is null then 'missing_data' when citation_count >= greatest(2025 - coalesce(year, 0), 1) * cast(1.5 as double) then '' else 'citation' end as category from lit_papers""", "lit_papers")
def filter_citation_strict(spark, d):
    return _screened(spark, d, S.CitationFilter(YEAR, 1.5, -1))


@query("filter_keyword_title", _case("contains(lower(title), 'red')", "title_keyword"), "lit_papers")
def filter_keyword_title(spark, d):
    return _screened(spark, d, S.KeywordFilter("title", keyword="Red"))


@query("filter_keyword_whole_word", "select paper_id, regexp_matches(coalesce(abstract, ''), '(?i)(^|[^\\p{L}\\p{N}_])the($|[^\\p{L}\\p{N}_])') as passed from lit_abstracts", "lit_abstracts")
def filter_keyword_whole_word(spark, d):
    out = S.screen(view(spark, d, "lit_abstracts"), S.KeywordFilter("abstract", keyword="the", match="whole_word"))
    return _flat(out, "paper_id").drop("category")


@query("filter_keyword_starts_with", "select paper_id, regexp_matches(ltrim(coalesce(abstract, ''), ' \n\t'), '(?i)^the($|[^\\p{L}\\p{N}_])') as passed from lit_abstracts", "lit_abstracts")
def filter_keyword_starts_with(spark, d):
    out = S.screen(view(spark, d, "lit_abstracts"), S.KeywordFilter("abstract", keyword="the", match="starts_with"))
    return _flat(out, "paper_id").drop("category")


_FORMULA = "(contains(lower(coalesce(abstract, '')), 'tion') and not contains(lower(coalesce(abstract, '')), 'ment')) or contains(lower(coalesce(abstract, '')), 'keit')"


@query("filter_keyword_formula", f"select paper_id, {_FORMULA} as passed, case when {_FORMULA} then '' else 'abstract_keyword' end as category from lit_abstracts", "lit_abstracts")
def filter_keyword_formula(spark, d):
    block = S.KeywordFilter("abstract", formula="tion & !ment | keit", keywords={"tion": "tion", "ment": "ment", "keit": "keit"})
    return _flat(S.screen(view(spark, d, "lit_abstracts"), block), "paper_id")


@query("filter_venue_in", _case("contains(lower(venue), 'brand#1') or contains(lower(venue), '#23')", "venue_in"), "lit_papers")
def filter_venue_in(spark, d):
    return _screened(spark, d, S.VenueIn(("Brand#1", "", "#23")))


@query("filter_venue_preset", "select paper_id, lower(venue) in ('src3', 'src5', 'src7') as passed from lit_abstracts", "lit_abstracts")
def filter_venue_preset(spark, d):
    block = S.VenuePreset(("odd",), {"odd": ("SRC3", " src5", "Src7")})
    return _flat(S.screen(view(spark, d, "lit_abstracts"), block), "paper_id").drop("category")


@query("filter_at_least", "select paper_id, coalesce(citation_count, 0) >= 30 as cited, coalesce(year, 0) >= 2000 as recent from lit_papers", "lit_papers")
def filter_at_least(spark, d):
    p = view(spark, d, "lit_papers")
    return p.select("paper_id", S.CitAtLeast(30).passes().alias("cited"), S.YearAtLeast(2000).passes().alias("recent"))


def screener() -> S.Sequential:
    """The screener of the flagship query."""
    return S.Sequential([S.YearFilter(1990, 2020), S.CitationFilter(YEAR, 1.0, 0), S.KeywordFilter("title", formula="red | !blue", keywords={"red": "red", "blue": "blue"})])


_SCREEN = """select paper_id, category = '' as passed, category from (
  select paper_id, case
    when year is null or not year between 1990 and 2020 then 'year'
    when year >= 2025 then (case when {kw} then '' else 'title_keyword' end)
    when citation_count is null then 'missing_data'
    when citation_count < greatest(2025 - coalesce(year, 0), 1) * cast(1.0 as double) then 'citation'
    when {kw} then '' else 'title_keyword' end as category from lit_papers) t""".replace("{kw}", "(contains(lower(title), 'red') or not contains(lower(title), 'blue'))")


@query("screen_sequential", _SCREEN, "lit_papers")
def screen_sequential(spark, d):
    return _screened(spark, d, screener())


@query("screen_outcome", f"select s.*, coalesce(r.n, 0) as n_citing from ({_SCREEN}) s left join (select cited_id, count(*) as n from lit_refs group by cited_id) r on r.cited_id = s.paper_id", "lit_papers", "lit_refs")
def screen_outcome(spark, d):
    """The flagship: which papers survive, why the others do not, and how often each is cited in the graph."""
    n = view(spark, d, "lit_refs").groupBy(F.col("cited_id").alias("paper_id")).agg(F.count(F.lit(1)).alias("n"))
    out = _screened(spark, d, screener()).join(n, "paper_id", "left")
    return out.select("paper_id", "passed", "category", F.coalesce("n", F.lit(0)).alias("n_citing"))


@query("rejection_counts", f"select category, count(*) as n from ({_SCREEN}) s where not passed group by category", "lit_papers")
def rejection_counts(spark, d):
    out = S.screen(view(spark, d, "lit_papers"), screener())
    return S.rejections(out).groupBy("category").agg(F.count(F.lit(1)).alias("n"))


@query("block_any", "select paper_id, p as passed, case when p then '' when citation_count is null then 'missing_data' else 'citation' end as category from (select *, (year between 2015 and 2020) or case when citation_count is null then false else citation_count >= greatest(2025 - year, 1) * cast(2.0 as double) end as p from lit_papers) t", "lit_papers")
def block_any(spark, d):
    return _screened(spark, d, S.AnyOf([S.YearFilter(2015, 2020), S.CitationFilter(YEAR, 2.0, -1)]))


@query("block_not", _case("not (year between 1990 and 2020)", "not_year"), "lit_papers")
def block_not(spark, d):
    return _screened(spark, d, S.Not(S.YearFilter(1990, 2020)))


@query("block_route", """select paper_id, category = '' as passed, category from (select paper_id, case
  when contains(lower(venue), 'brand#1') then (case when year >= 1990 then '' else 'year' end)
  when coalesce(citation_count, 0) >= 32 then (case when contains(lower(title), 'red') then '' else 'title_keyword' end)
  else 'no_route_match' end as category from lit_papers) t""", "lit_papers")
def block_route(spark, d):
    return _screened(spark, d, S.Route([(S.VenueIn(("brand#1",)), S.YearFilter(1990)), (S.CitAtLeast(32), S.KeywordFilter("title", keyword="red"))]))


@query("local_query", "select paper_id, year, citation_count from lit_papers where year >= 1985 and year <= 2015 and citation_count >= 25 and regexp_matches(venue, '(?i)brand#[1-3]') and regexp_matches(title, '(?i)red|blue')", "lit_papers")
def local_query(spark, d):
    out = S.local_query(view(spark, d, "lit_papers"), venue_regex="brand#[1-3]", year_min=1985, year_max=2015, min_citations=25, title_regex="red|blue")
    return out.select("paper_id", "year", "citation_count")


@query("search_bulk", """select paper_id, year, citation_count from (select *, row_number() over (order by coalesce(citation_count, -1) desc, paper_id) as rn from lit_papers
  where ((regexp_matches(title, '(?i)(^|[^a-z0-9_])red($|[^a-z0-9_])') or regexp_matches(title, '(?i)(^|[^a-z0-9_])green')) and not regexp_matches(title, '(?i)(^|[^a-z0-9_])small($|[^a-z0-9_])')) and year >= 1980) t where rn <= 200""", "lit_papers")
def search_bulk(spark, d):
    p = view(spark, d, "lit_papers").where(S.search_predicate("(red | green*) -small", F.col("title")))
    _, desc = S.sanitize_sort("citationCount:desc")
    c = F.coalesce("citation_count", F.lit(-1))
    return S.local_query(p, year_min=1980).orderBy(c.desc() if desc else c.asc(), "paper_id").limit(200).select("paper_id", "year", "citation_count")


def _scripted(system: str, user: str, vote: int) -> str:
    """Queries in a row, by how many the question says were asked."""
    asked = sum(line[:1].isdigit() for line in user.splitlines())
    return json.dumps({"query": ("red AND NOT small", "plate OR rin*", '"hot rod" OR new')[min(asked, 2)]})


def _scripted_model():
    return _scripted


_WORD = "regexp_matches(title, '(?i)(^|[^a-z0-9_])%s($|[^a-z0-9_])')"


@query("search_refine", f"""select paper_id, turn from (select paper_id, case when {_WORD % "red"} and not {_WORD % "small"} then 1
  when {_WORD % "plate"} or regexp_matches(title, '(?i)(^|[^a-z0-9_])rin') then 2 when {_WORD % "hot rod"} or {_WORD % "new"} then 3 end as turn from lit_papers) t where turn is not null""", "lit_papers")
def search_refine(spark, d):
    register_model("scripted", _scripted_model)
    p = view(spark, d, "lit_papers")
    agent = search_agent.Agent("scripted", max_iterations=4, max_papers_per_iteration=None, min_new=0.0)
    return search_agent.refine(p, p.where("year = 2000").select("paper_id", "title"), "parts", agent)[0]


# -- pairs of papers: measures -------------------------------------------------------------------

def _ref_lists(spark, d) -> DataFrame:
    """References of each citing paper (an order) as an array; and for cited ones their citers."""
    return view(spark, d, "lit_refs").groupBy(F.col("citing_id").alias("id")).agg(F.collect_set("cited_id").alias("items"))


def _pairs(spark, d, lists: DataFrame) -> DataFrame:
    a = lists.select((F.col("id") + 1).alias("next"), F.col("id").alias("a"), F.col("items").alias("source_refs"))
    return a.join(lists.select(F.col("id").alias("next"), F.col("items").alias("references")), "next").select("a", F.col("next").alias("b"), "source_refs", "references")


_PAIR_SQL = """with l as (select {k} as id, list_sort(list({v})) as items from lit_refs group by 1), p as (select a.id as a, b.id as b, a.items as x, b.items as y from l a join l b on b.id = a.id + 1)
"""


@query("ref_sim", _PAIR_SQL.format(k="citing_id", v="cited_id") + "select a, b, round(len(list_intersect(x, y)) / cast(least(len(x), len(y)) as double), 9) as score from p", "lit_refs")
def ref_sim(spark, d):
    return _pairs(spark, d, _ref_lists(spark, d)).select("a", "b", F.round(S.RefSim().score(), 9).alias("score"))


@query("cit_sim", _PAIR_SQL.format(k="cited_id", v="citing_id") + "select a, b, case when c.citation_count >= 45 then cast(1.0 as double) else round(len(list_intersect(x, y)) / cast(least(len(x), len(y)) as double), 9) end as score from p join lit_papers c on c.paper_id = b", "lit_papers", "lit_refs")
def cit_sim(spark, d):
    lists = view(spark, d, "lit_refs").groupBy(F.col("cited_id").alias("id")).agg(F.collect_set("citing_id").alias("items"))
    p = _pairs(spark, d, lists).select("a", "b", F.col("source_refs").alias("source_citers"), F.col("references").alias("citers"))
    p = p.join(view(spark, d, "lit_papers").select(F.col("paper_id").alias("b"), "citation_count"), "b")
    return p.select("a", "b", F.round(S.CitSim(45).score(), 9).alias("score"))


_COS = "list_sum(list_transform(range(1, len(a.embedding) + 1), lambda i: cast(a.embedding[i] as double) * cast(b.embedding[i] as double))) / (sqrt(list_sum(list_transform(a.embedding, lambda v: cast(v as double) * cast(v as double)))) * sqrt(list_sum(list_transform(b.embedding, lambda v: cast(v as double) * cast(v as double)))))"


def _vector_pairs(spark, d) -> DataFrame:
    v = view(spark, d, "lit_vectors")
    a = v.select(F.col("paper_id").alias("a"), F.col("embedding").alias("source_embedding"), (F.col("paper_id") + 1).alias("b"))
    return a.join(v.select(F.col("paper_id").alias("b"), "embedding"), "b")


@query("semantic_sim", f"select a.paper_id as a, b.paper_id as b, round(greatest({_COS}, 0), 6) as score from lit_vectors a join lit_vectors b on b.paper_id = a.paper_id + 1", "lit_vectors")
def semantic_sim(spark, d):
    return _vector_pairs(spark, d).select("a", "b", F.round(S.SemanticSim().score(), 6).alias("score"))


@query("similarity_filter", _PAIR_SQL.format(k="citing_id", v="cited_id") + """, s as (select p.a, p.b, len(list_intersect(x, y)) / cast(least(len(x), len(y)) as double) as r, (select greatest(""" + _COS + """, 0) from lit_vectors a join lit_vectors b on b.paper_id = a.paper_id + 1 where a.paper_id = p.a) as c from p)
select a, b, coalesce(greatest(r, c), r, c) >= 0.1 as passed, case when coalesce(greatest(r, c), r, c) >= 0.1 then '' else 'similarity' end as category from s""", "lit_refs", "lit_vectors")
def similarity_filter(spark, d):
    p = _pairs(spark, d, _ref_lists(spark, d)).join(_vector_pairs(spark, d), ["a", "b"], "left")
    return _flat(S.screen(p, S.SimilarityFilter([S.RefSim(), S.SemanticSim()], 0.1)), "a", "b")


@query("normalize_title", "select paper_id, trim(regexp_replace(regexp_replace(lower(title), '[^\\p{L}\\p{N}\\s]', '', 'g'), '\\s+', ' ', 'g')) as norm from lit_abstracts", "lit_abstracts")
def normalize_title(spark, d):
    return view(spark, d, "lit_abstracts").select("paper_id", T.normalize_title("title").alias("norm"))


