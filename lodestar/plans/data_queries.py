"""Queries over duplicates, clusters, texts, sinks, history and streams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import recipes, references
from ..functions import text as T
from ..operators import communities as C
from ..operators import dedup as D
from ..operators import history as H
from ..operators import output as O
from ..operators import topics as K
from ..operators import verdicts as V
from ..operators.fixpoint import scratch
from ..sources import paged
from ..sources import records as S
from ..sources.views import view
from ..streaming import events as E
from ..streaming import gates
from .registry import Registry

query = Registry()


def _table(spark, d, name) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


# -- duplicates ----------------------------------------------------------------------------------

@query("external_keys", "select paper_id, key from (select paper_id, 'doi:10.1000/' || lower(venue) || '.' || (paper_id % 700) as key from lit_papers union select paper_id, 'arxiv:' || (paper_id % 900) from lit_papers where paper_id % 3 = 0) t", "lit_papers")
def external_keys(spark, d):
    return D.external_keys(_with_ids(spark, d))


def _with_ids(spark, d) -> DataFrame:
    """Papers with made-up external ids, in the spellings that sources use."""
    i = F.col("paper_id")
    doi = F.concat(F.when(i % 2 == 0, "https://doi.org/").otherwise(""), F.lit("10.1000/"), F.col("venue"), F.lit("."), (i % 700).cast("string"))
    arxiv = F.when(i % 3 == 0, F.concat(F.when(i % 2 == 0, "arXiv:").otherwise(""), (i % 900).cast("string")))
    return view(spark, d, "lit_papers").withColumn("external_ids", F.create_map(F.lit("DOI"), doi, F.lit("ArXiv"), arxiv))


_NORM = "trim(regexp_replace(regexp_replace(lower(title), '[^\\p{L}\\p{N}\\s]', '', 'g'), '\\s+', ' ', 'g'))"
_DUP_SQL = f"""with k as (select paper_id, '10.1000/' || lower(venue) || '.' || (paper_id % 700) as key from lit_papers union all select paper_id, 'a' || (paper_id % 900) from lit_papers where paper_id % 3 = 0),
kp as (select distinct least(a, b) as a, greatest(a, b) as b from (select min(paper_id) over (partition by key) as a, paper_id as b from k) t where a <> b),
p as (select p.paper_id, year, {_NORM} as norm, author, embedding from lit_papers p left join (select paper_id, min(author_id) as author from lit_authorship group by paper_id) au using (paper_id) left join lit_vectors v using (paper_id)),
tp as (select a, b from (
  select x.paper_id as a, y.paper_id as b, coalesce(list_cosine_similarity(cast(x.embedding as double[]), cast(y.embedding as double[])) >= 0.98, false) as near, coalesce(abs(x.year - y.year) <= 1, true) and x.norm <> '' and y.norm <> '' as may,
    jaro_similarity(x.norm, y.norm) as j, case when left(x.norm, 4) = left(y.norm, 4) then 4 when left(x.norm, 3) = left(y.norm, 3) then 3 when left(x.norm, 2) = left(y.norm, 2) then 2 when left(x.norm, 1) = left(y.norm, 1) then 1 else 0 end as same
  from p x join p y on x.author is not distinct from y.author and x.paper_id < y.paper_id) t where near or may and j + same * 0.1 * (1 - j) >= 0.95),
pairs as (select a, b from kp union select a, b from tp)
"""


def _dup_pairs(spark, d) -> DataFrame:
    """By all signals at the operator's thresholds; the author of a paper is the one of the smallest id."""
    author = view(spark, d, "lit_authorship").groupBy("paper_id").agg(F.min("author_id").cast("string").alias("author"))
    p = D.with_normal_titles(_with_ids(spark, d)).join(author, "paper_id", "left").join(view(spark, d, "lit_vectors").select("paper_id", "embedding"), "paper_id", "left")
    return D.duplicate_pairs(D.candidate_pairs(p, D.external_keys(p)), p)


_DUP_VIEWS = ("lit_papers", "lit_authorship", "lit_vectors")


@query("dup_pairs", _DUP_SQL + "select a, b from pairs", *_DUP_VIEWS)
def dup_pairs(spark, d):
    return _dup_pairs(spark, d)


_CC_SQL = _DUP_SQL.replace("with k as", "with recursive k as", 1).rstrip() + """, u as (select a, b from pairs union select b, a from pairs),
cc as (select 0 as it, a as id, a as comp from (select distinct a from u) t
  union all select it + 1, id, min(comp) from (select c.it, u.a as id, c.comp from cc c join u on u.b = c.id where c.it < 40 union all select it, id, comp from cc where it < 40) t group by it + 1, id),
cl as (select id as paper_id, comp as cluster from cc where it = 40)
"""


@query("dup_clusters", _CC_SQL + "select paper_id, cluster from cl", *_DUP_VIEWS)
def dup_clusters(spark, d):
    return D.duplicate_clusters(_dup_pairs(spark, d))


def _members(spark, d) -> DataFrame:
    a = view(spark, d, "lit_abstracts").select("paper_id", "abstract")
    p = view(spark, d, "lit_papers").join(a, "paper_id", "left")
    p = p.withColumn("venue", F.when(F.col("paper_id") % 5 == 0, F.concat(F.lit("arXiv "), "venue")).otherwise(F.col("venue")))
    return D.duplicate_clusters(_dup_pairs(spark, d)).join(p, "paper_id")


@query("canonical_pick", _CC_SQL + "select cl.paper_id, first_value(cl.paper_id) over (partition by cluster order by cl.paper_id % 5 = 0, coalesce(citation_count, 0) desc, length(coalesce(abstract, '')) desc, cl.paper_id) as canonical from cl join lit_papers p using (paper_id) left join lit_abstracts a using (paper_id)", *_DUP_VIEWS, "lit_abstracts")
def canonical_pick(spark, d):
    return D.pick_canonical(_members(spark, d)).select("paper_id", "canonical")


_MERGE = _CC_SQL + """, m as (select cl.cluster, cl.paper_id, p.year, p.citation_count, row_number() over (partition by cluster order by cl.paper_id % 5 = 0, coalesce(citation_count, 0) desc, length(coalesce(abstract, '')) desc, cl.paper_id) as pos from cl join lit_papers p using (paper_id) left join lit_abstracts a using (paper_id))
select max(case when pos = 1 then paper_id end) as paper_id, max(citation_count) as citation_count, cast(count(*) - 1 as int) as n_aliases from m group by cluster"""


@query("merge_clusters", _MERGE, *_DUP_VIEWS, "lit_abstracts")
def merge_clusters(spark, d):
    m = D.ranked(_members(spark, d)).withColumn("references", F.array().cast("array<bigint>"))
    return D.merge_clusters(m).select("paper_id", "citation_count", "n_aliases")


@query("alias_rewrite", _CC_SQL + ", al as (select paper_id as alias, cluster as canonical from cl where paper_id <> cluster), r as (select coalesce(y.canonical, citing_id) as paper_id, coalesce(x.canonical, cited_id) as ref from lit_refs left join al x on x.alias = cited_id left join al y on y.alias = citing_id) select distinct paper_id, ref from r where paper_id <> ref", *_DUP_VIEWS, "lit_refs")
def alias_rewrite(spark, d):
    a = D.duplicate_clusters(_dup_pairs(spark, d)).where("paper_id <> cluster").select(F.col("paper_id").alias("alias"), F.col("cluster").alias("canonical"))
    r = view(spark, d, "lit_refs").select(F.col("citing_id").alias("paper_id"), F.col("cited_id").alias("ord"), F.col("cited_id").alias("ref"))
    return D.rewrite_references(r, a).select("paper_id", "ref")


@query("jaro_winkler", "with p as (select a.paper_id as a, b.paper_id as b, a.title as x, b.title as y from lit_papers a join lit_papers b on b.paper_id = a.paper_id + 1) select a, b, round(j + (1 - j) * 0.1 * least(4, case when left(x, 4) = left(y, 4) then 4 when left(x, 3) = left(y, 3) then 3 when left(x, 2) = left(y, 2) then 2 when left(x, 1) = left(y, 1) then 1 else 0 end), 6) as score from (select *, jaro_similarity(x, y) as j from p) t", "lit_papers")
def jaro_winkler(spark, d):
    p = view(spark, d, "lit_papers")
    pairs = p.select((F.col("paper_id") + 1).alias("b"), F.col("paper_id").alias("a"), F.col("title").alias("x")).join(p.select(F.col("paper_id").alias("b"), F.col("title").alias("y")), "b")
    return pairs.select("a", "b", F.round(D.jaro_winkler("x", "y"), 6).alias("score"))


# -- clusters ------------------------------------------------------------------------------------

def _labelled(spark, d) -> DataFrame:
    return view(spark, d, "lit_vectors").select("paper_id", F.col("label").alias("cid"), "embedding")


@query("cluster_sizes", "select label as cid, count(*) as n from lit_vectors group by label", "lit_vectors")
def cluster_sizes(spark, d):
    return _labelled(spark, d).groupBy("cid").agg(F.count(F.lit(1)).alias("n"))


_CENT = "m as (select label as cid, i, avg(cast(embedding[i] as double)) as x from lit_vectors, range(1, 65) t(i) group by label, i)"


@query("centroids", f"with {_CENT} select cid, cast(i - 1 as int) as pos, round(x, 9) as x from m", "lit_vectors")
def centroids(spark, d):
    return K.centroid(_labelled(spark, d)).select("cid", F.posexplode("centroid").alias("pos", "x")).withColumn("x", F.round("x", 9))


@query("representative_papers", f"with {_CENT}, s as (select v.label as cid, v.paper_id, sum(cast(v.embedding[m.i] as double) * m.x) / (sqrt(sum(m.x * m.x)) * sqrt(sum(cast(v.embedding[m.i] as double) * cast(v.embedding[m.i] as double)))) as s from lit_vectors v join m on m.cid = v.label group by 1, 2), r as (select *, row_number() over (partition by cid order by s desc, paper_id) as rn from s) select cid, paper_id, round(s, 6) as score from r where rn <= 3", "lit_vectors")
def representative_papers(spark, d):
    return K.representatives(_labelled(spark, d), 3).select("cid", "paper_id", F.round("score", 6).alias("score"))


_STOPS = ", ".join(f"'{w}'" for w in K.STOP_WORDS)
_CTFIDF = f"""with w as (select lang as cid, list_filter(regexp_extract_all(lower(coalesce(abstract, '')), '[\\p{{L}}\\p{{N}}_]{{2,}}'), lambda x: x not in ({_STOPS})) as w from lit_abstracts),
t as (select cid, unnest(list_concat(w, list_transform(range(1, greatest(len(w), 1)), lambda i: w[i] || ' ' || w[i + 1]), list_transform(range(1, greatest(len(w) - 1, 1)), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]))) as term from w),
tf as (select cid, term, count(*) as tf from t group by 1, 2), c as (select cid, sum(tf) as n from tf group by 1), e as (select term, sum(tf) as f from tf group by 1),
s as (select tf.cid, tf.term, round(tf.tf / cast(c.n as double) * ln(1 + (select avg(n) from c) / cast(e.f as double)), 9) as score from tf join c using (cid) join e using (term)), r as (select *, row_number() over (partition by cid order by score desc, term) as rn from s)
select cid, term, score from r where rn <= 10"""


@query("ctfidf_keywords", _CTFIDF, "lit_abstracts")
def ctfidf_keywords(spark, d):
    m = view(spark, d, "lit_abstracts").select(F.col("lang").alias("cid"), F.col("abstract").alias("text"))
    return K.ctfidf(m, 10, noise="").select("cid", "term", "score")


@query("topic_labels", None)
def topic_labels(spark, d):
    m = view(spark, d, "lit_abstracts").select(F.col("lang").alias("cid"), F.col("abstract").alias("text"))
    return K.fallback_labels(K.ctfidf(m, 5, noise=""))


@query("louvain")
def louvain(spark, d):
    return C.cluster("louvain", edges=view(spark, d, "lit_dag"))


@query("walktrap")
def walktrap(spark, d):
    return C.cluster({"type": "walktrap", "n_communities": 5}, edges=view(spark, d, "lit_dag_folded"))


@query("topic_model")
def topic_model(spark, d):
    return C.cluster("topic_model", vectors=view(spark, d, "lit_vectors").select("paper_id", "embedding"))


# -- texts ---------------------------------------------------------------------------------------

@query("abstract_from_index", "select paper_id, title as text from lit_papers", "lit_papers")
def abstract_from_index(spark, d):
    """Titles turned into inverted indexes and back."""
    w = F.split("title", " ")
    idx = F.map_from_entries(F.transform(F.array_distinct(w), lambda x: F.struct(x, F.filter(F.sequence(F.lit(0), F.size(w) - 1), lambda i: F.get(w, i) == x))))
    return view(spark, d, "lit_papers").select("paper_id", T.abstract_from_index(idx).alias("text"))


@query("doi_extract", "select paper_id, case when paper_id % 4 = 0 then null else '10.' || (1000 + paper_id) || '/x' || (paper_id % 50) end as doi from lit_papers", "lit_papers")
def doi_extract(spark, d):
    i = F.col("paper_id")
    text = F.when(i % 4 == 0, "no link").otherwise(F.concat(F.lit("see (https://doi.org/10."), (i + 1000).cast("string"), F.lit("/x"), (i % 50).cast("string"), F.lit(").")))
    return view(spark, d, "lit_papers").select("paper_id", T.extract_doi(text).alias("doi"))


def _attribute(tag: str, name: str) -> str:
    """SQL of a tag's attribute, quoted in either way or not at all."""
    forms = [f"""nullif(regexp_extract({tag}, '(?is)\\s{name}\\s*=\\s*{q}([^{q}]*){q}', 1), '')""" for q in ('"', "''")] + [f"""nullif(regexp_extract({tag}, '(?is)\\s{name}\\s*=\\s*([^\\s"''>]+)', 1), '')"""]
    return f"trim(coalesce({', '.join(forms)}, ''))"


@query("pdf_url_from_html", f"""with t as (select page_id, regexp_extract_all(html, '(?s)<[A-Za-z][^>]*>') as tags from pages)
select page_id, list_concat(
  list_filter(list_transform(list_filter(tags, lambda t: regexp_matches(t, '(?i)^<meta\\s') and lower({_attribute('t', 'name')}) = 'citation_pdf_url'), lambda t: {_attribute('t', 'content')}), lambda u: u <> ''),
  list_filter(list_transform(tags, lambda t: {_attribute('t', 'href')}), lambda u: contains(lower(u), '.pdf')))[1] as link from t""")
def pdf_url_from_html(spark, d):
    return _table(spark, d, "pages").select("page_id", T.pdf_url_from_html("html").alias("link"))


@query("truncate_middle", "select paper_id, case when length(abstract) <= 400 then abstract else left(abstract, 238) || chr(10) || '...' || chr(10) || right(abstract, 158) end as cut from lit_abstracts", "lit_abstracts")
def truncate_middle(spark, d):
    return view(spark, d, "lit_abstracts").select("paper_id", T.truncate_middle("abstract", 400).alias("cut"))


_MADE_REFS = "(select string_agg(i || '. Smith, J. (2020). A long title of work number ' || i || '. Venue.', chr(10) order by i) from range(1, 7) t(i))"


@query("split_references", f"""with t as (select paper_id, abstract, length(abstract) + 1 as head, abstract || chr(10) || 'References' || chr(10) || {_MADE_REFS} as whole from lit_abstracts),
c as (select *, whole is not null and head >= 0.15 * length(whole) as has from t)
select paper_id, cast(case when whole is null then 0 when has then least(length(regexp_replace(abstract, '\\s+$', '')), 300) else least(length(whole), 500) end as int) as body_chars, cast(case when has then 6 else 0 end as int) as n_entries from c""", "lit_abstracts")
def split_references(spark, d):
    """Texts with a made-up list of references, cut in two and shared into a budget."""
    a = view(spark, d, "lit_abstracts")
    refs = F.array_join(F.transform(F.sequence(F.lit(1), F.lit(6)), lambda i: F.concat(i.cast("string"), F.lit(". Smith, J. (2020). A long title of work number "), i.cast("string"), F.lit(". Venue."))), "\n")
    s = a.select("paper_id", references.split_references(F.concat("abstract", F.lit("\nReferences\n"), refs)).alias("s"))
    b = references.share_budget(F.col("s.body"), F.col("s.refs"), 500)
    return s.select("paper_id", F.char_length(b["body"]).alias("body_chars"), F.size(references.entries(F.col("s.refs"))).alias("n_entries"))


@query("translate_query", "select paper_id, replace(trim(title), ' ', ' | ') || ' ' || venue || ' -' || coalesce(cast(year as varchar), 'undated') as q from lit_papers", "lit_papers")
def translate_query(spark, d):
    """Each paper's title words as alternatives, with its venue and without its year."""
    words = F.array_join(F.split(F.trim("title"), " "), " OR ")
    q = F.concat(words, F.lit("  AND "), "venue", F.lit(" AND NOT "), F.coalesce(F.col("year").cast("string"), F.lit("undated")))
    return view(spark, d, "lit_papers").select("paper_id", T.translate_query(q).alias("q"))


@query("publication_month", "select paper_id, year * 12 + case when paper_id % 3 = 0 then cast(paper_id % 12 + 1 as int) else 1 end as month from lit_papers", "lit_papers")
def publication_month(spark, d):
    i = F.col("paper_id")
    date = F.when(i % 3 == 0, F.concat(F.col("year").cast("string"), F.lit("-"), F.lpad((i % 12 + 1).cast("string"), 2, "0"))).when(i % 3 == 1, F.concat(F.col("year").cast("string"), F.lit("-99")))
    return view(spark, d, "lit_papers").select("paper_id", T.publication_month_ordinal(date, "year").alias("month"))


@query("parse_matches", "select conv_id, turn, turn % 2 = 0 as first, false as second from conversations")
def parse_matches(spark, d):
    c = _table(spark, d, "conversations")
    reply = F.concat(F.lit('```json\n{"results": [{"index": 1, "match": '), (F.col("turn") % 2 == 0).cast("string"), F.lit('}, {"index": 2, "match": false}]}\n```'))
    m = V.parsed_matches(reply)
    return c.select("conv_id", "turn", F.element_at(m, F.lit(1)).alias("first"), F.element_at(m, F.lit(2)).alias("second"))


@query("llm_votes", "select paper_id, cast(3 as bigint) as accepts, true as verdict from lit_abstracts where trim(abstract) <> '' union all select paper_id, 0, false from lit_abstracts where coalesce(trim(abstract), '') = ''", "lit_abstracts")
def llm_votes(spark, d):
    return V.verdicts(view(spark, d, "lit_abstracts").withColumn("full_text", F.lit(None).cast("string")), "on topic", votes=3, min_accepts=2)


@query("llm_formula", "select paper_id, false as verdict from lit_papers", "lit_papers")
def llm_formula(spark, d):
    p = view(spark, d, "lit_papers").withColumn("abstract", F.lit(None).cast("string"))
    return V.formula_verdicts(p, "a & !b", {"a": "about graphs", "b": "a survey"}, scope="title")


@query("route_recipes", "with r(rank, recipe, prefix) as (values " + ", ".join(f"({a}, '{b}', '{c}')" for a, b, c, k in recipes.recipe_rows() if k != "llm") + "), p as (select paper_id, case paper_id % 4 when 0 then '10.1016/x' when 1 then '10.15252/x' when 2 then '10.48550/arXiv.' else 'none' end || paper_id as doi from lit_papers), h as (select distinct paper_id, rank, recipe from p join r on starts_with(lower(doi), prefix)) select paper_id, cast(row_number() over (partition by paper_id order by rank) as int) as step, recipe from h", "lit_papers")
def route_recipes(spark, d):
    i = F.col("paper_id")
    p = view(spark, d, "lit_papers").select("paper_id", F.concat(F.when(i % 4 == 0, "10.1016/x").when(i % 4 == 1, "10.15252/x").when(i % 4 == 2, "10.48550/arXiv.").otherwise("none"), i.cast("string")).alias("doi"))
    return recipes.route(p).select("paper_id", "step", "recipe")


@query("fetch_plan", "select case paper_id % 4 when 0 then 'no_doi' when 1 then (case when paper_id % 8 = 1 then 'done' else 'fetch' end) when 2 then 'no_recipe' else 'fetch' end as status, count(*) as n from lit_papers group by 1", "lit_papers")
def fetch_plan(spark, d):
    i = F.col("paper_id")
    p = view(spark, d, "lit_papers").select("paper_id", F.when(i % 4 == 0, "").when(i % 4 == 2, "99/x").otherwise("10.1016/x").alias("doi"))
    return H.fetch_stats(recipes.plan_fetch(p, p.where("paper_id % 8 = 1")))


@query("harvest_dois", "select paper_id, case when paper_id % 2 = 0 then '10.1/a' || paper_id else '10.5555/b' || paper_id end as doi, case when paper_id % 2 = 0 then 'external_ids' else 'disclaimer' end as doi_source from lit_papers where paper_id % 4 <> 3", "lit_papers")
def harvest_dois(spark, d):
    i = F.col("paper_id")
    s = i.cast("string")
    js = F.when(i % 2 == 0, F.concat(F.lit('{"externalIds": {"DOI": "10.1/a'), s, F.lit('"}}'))).when(i % 4 == 1, F.concat(F.lit('{"openAccessPdf": {"disclaimer": "at https://doi.org/10.5555/b'), s, F.lit('), which"}}'))).otherwise("{}")
    return S.harvest_dois(view(spark, d, "lit_papers").select("paper_id", js.alias("json")))


@query("papers_from_json", "select cast(paper_id as varchar) as paper_id, title, case when paper_id % 5 = 0 then null else venue end as venue, cast(2 as int) as n_fields, cast(case when paper_id % 2 = 0 then 1 else 0 end as int) as n_ids from lit_papers", "lit_papers")
def papers_from_json(spark, d):
    i = F.col("paper_id")
    fields = F.struct(
        i.cast("string").alias("paperId"), "title", F.when(i % 5 == 0, "").otherwise(F.col("venue")).alias("venue"), "year",
        F.array(F.lit("Biology")).alias("fieldsOfStudy"), F.array(F.struct(F.lit("Biology").alias("category")), F.struct(F.lit("Medicine").alias("category"))).alias("s2FieldsOfStudy"),
        F.create_map(F.lit("DOI"), F.when(i % 2 == 0, "10.1/x")).alias("externalIds"),
    )
    p = S.papers_from_json(view(spark, d, "lit_papers").select(F.to_json(fields, {"ignoreNullFields": "false"}).alias("json")))
    return p.select("paper_id", "title", "venue", F.size("fields_of_study").alias("n_fields"), F.size("external_ids").alias("n_ids"))


@query("cache_latest", "select user_id, event_id, value from (select *, row_number() over (partition by user_id order by ts desc, event_id desc) as rn from events) t where rn = 1")
def cache_latest(spark, d):
    e = _table(spark, d, "events").withColumn("at", F.struct("ts", "event_id"))
    return S.latest(e.select("user_id", "event_id", "value", "at"), "user_id", "at").select("user_id", "event_id", "value")


@query("fill_abstracts", "select p.paper_id, coalesce(nullif(a.abstract, ''), p.title) as abstract from lit_papers p left join lit_abstracts a on a.paper_id = p.paper_id and a.paper_id % 2 = 0", "lit_papers", "lit_abstracts")
def fill_abstracts(spark, d):
    p = view(spark, d, "lit_papers").select("paper_id", F.lit(None).cast("string").alias("abstract"))
    first = view(spark, d, "lit_abstracts").where("paper_id % 2 = 0")
    return S.fill_missing(p, first, view(spark, d, "lit_papers").withColumn("abstract", F.col("title")))


# -- sinks and history ---------------------------------------------------------------------------

@query("collection_summary", "select 'year' as field, coalesce(cast(year as varchar), 'None') as value, count(*) as n from lit_papers group by 2 union all select 'venue', coalesce(venue, 'None'), count(*) from lit_papers group by 2 union all select 'citation_count', coalesce(cast(citation_count as varchar), 'None'), count(*) from lit_papers group by 2", "lit_papers")
def collection_summary(spark, d):
    return O.distributions(view(spark, d, "lit_papers"), ("year", "venue", "citation_count"))


@query("collection_totals", "select (select count(*) from lit_papers where year >= 2000) as accepted, (select count(*) from lit_papers where year < 2000) as rejected, (select count(*) from lit_papers) as seen", "lit_papers")
def collection_totals(spark, d):
    p = view(spark, d, "lit_papers")
    return O.summary(p.where("year >= 2000"), p.where("year < 2000"), p)


@query("bibtex_entries", "select paper_id, '@article{' || paper_id || ',' || chr(10) || '  title     = {' || title || '},' || chr(10) || '  year      = {' || year || '},' || chr(10) || '  journal   = {' || venue || '},' || chr(10) || '  note      = {S2: ' || paper_id || ', citations: ' || coalesce(citation_count, 0) || '},' || chr(10) || '}' as entry from lit_papers", "lit_papers")
def bibtex_entries(spark, d):
    return O.bibtex(view(spark, d, "lit_papers"))


@query("graphml_lines", "select 0 as part, '<node id=\"' || paper_id || '\"><data key=\"n_title\">' || title || '</data><data key=\"n_year\">' || year || '</data></node>' as line from lit_papers union all select 1, '<edge source=\"' || src || '\" target=\"' || dst || '\"></edge>' from lit_dag", "lit_papers", "lit_dag")
def graphml_lines(spark, d):
    v = view(spark, d, "lit_papers").select(F.col("paper_id").alias("id"), "title", "year")
    return O.graphml_lines(v, view(spark, d, "lit_dag"))[1]


_CALLS = "calls as (select conv_id, turn, case role when 'user' then 'gpt-x-mini' else 'gem-flash-09' end as model, length(coalesce(text, '')) // 4 as input_tokens, cast(turn as bigint) as output_tokens, cast(0 as bigint) as reasoning_tokens from conversations)"


def _calls(spark, d) -> DataFrame:
    c = _table(spark, d, "conversations")
    return c.select("conv_id", "turn", F.when(F.col("role") == "user", "gpt-x-mini").otherwise("gem-flash-09").alias("model"), T.token_estimate("text").alias("input_tokens"), F.col("turn").cast("long").alias("output_tokens"), F.lit(0).cast("long").alias("reasoning_tokens"))


PRICES = {"gpt-x": (1.0, 2.0, 2.0), "gpt-x-mini": (0.5, 1.0, 1.0), "GENERIC": (0.30, 2.50, 2.50)}


@query("budget_by_model", f"with {_CALLS} select model, count(*) as calls, cast(sum(input_tokens) as bigint) as input_tokens, round(sum(case model when 'gpt-x-mini' then input_tokens * 0.5 + output_tokens * 1.0 else input_tokens * 0.3 + output_tokens * 2.5 end) / 1e6, 9) as usd from calls group by model")
def budget_by_model(spark, d):
    return H.priced(_calls(spark, d), PRICES).groupBy("model").agg(F.count(F.lit(1)).alias("calls"), F.sum("input_tokens").alias("input_tokens"), F.round(F.sum("cost_usd"), 9).alias("usd"))


@query("budget_gate", f"with {_CALLS}, u as (select conv_id, turn, cast(sum(input_tokens + output_tokens) over (partition by conv_id order by turn rows unbounded preceding) as bigint) as used from calls) select conv_id, turn, used, used >= 60 as spent from u")
def budget_gate(spark, d):
    c = _calls(spark, d).withColumn("run", F.col("conv_id")).withColumn("call_id", F.col("turn"))
    return H.budget_gate(c, 60, by="turn").select("conv_id", "turn", "used", "spent")


@query("hitl_agreement", "with s as (select doc_id as paper_id, 'llm_length' as filter, n_chars >= 1000 as accepted from documents union all select doc_id, 'llm_lang', lang = 'en' from documents where n_chars >= 300) select filter, count(*) as n, round(avg(case when accepted = (quality = 1) then 1.0 else 0.0 end), 9) as agreement from s join labels on doc_id = paper_id group by filter")
def hitl_agreement(spark, d):
    doc = _table(spark, d, "documents")
    a = doc.select(F.col("doc_id").alias("paper_id"), F.lit("llm_length").alias("filter"), (F.col("n_chars") >= 1000).alias("accepted"))
    b = doc.where("n_chars >= 300").select(F.col("doc_id").alias("paper_id"), F.lit("llm_lang").alias("filter"), (F.col("lang") == "en").alias("accepted"))
    labels = _table(spark, d, "labels").select(F.col("doc_id").alias("paper_id"), (F.col("quality") == 1).alias("keep"))
    return H.agreement(a.union(b), labels).select("filter", "n", F.round("agreement", 9).alias("agreement"))


@query("rejection_ledger", "with r as (select paper_id, 1 as seq, 'year' as category from lit_papers where year < 1990 union all select paper_id, 2, 'citation' from lit_papers where citation_count < 28 union all select paper_id, 3, 'year' from lit_papers where year < 1980), f as (select paper_id, category, min(seq) as seq from r group by 1, 2) select f.paper_id, string_agg(category, ',' order by seq) as categories, any_value(left(title, 200)) as title, any_value(year) as year from f join lit_papers p using (paper_id) group by f.paper_id", "lit_papers")
def rejection_ledger(spark, d):
    p = view(spark, d, "lit_papers")
    parts = [p.where(c).select("paper_id", F.lit(i).alias("seq"), F.lit(n).alias("category")) for i, c, n in ((1, "year < 1990", "year"), (2, "citation_count < 28", "citation"), (3, "year < 1980", "year"))]
    led = H.rejection_ledger(parts[0].union(parts[1]).union(parts[2]), p)
    return led.select("paper_id", F.array_join("categories", ",").alias("categories"), "title", "year")


@query("breaker_replay", "with c as (select user_id as source, event_id as call_id, event_type <> 'error' as ok from events), i as (select *, sum(case when ok then 1 else 0 end) over (partition by source order by call_id rows unbounded preceding) as island from c), s as (select source, call_id, ok, sum(case when ok then 0 else 1 end) over (partition by source, island order by call_id rows unbounded preceding) as streak from i) select source, call_id, cast(streak as bigint) as streak, max(streak) over (partition by source order by call_id rows unbounded preceding) >= 3 as open from s")
def breaker_replay(spark, d):
    e = _table(spark, d, "events")
    return H.breaker(e.select(F.col("user_id").alias("source"), F.col("event_id").alias("call_id"), (F.col("event_type") != "error").alias("ok")), 3).select("source", "call_id", "streak", "open")


@query("cache_hits", "select event_type as bucket, count(*) as requests, count(case when user_id % 3 = 0 then 1 end) as hits from events group by event_type")
def cache_hits(spark, d):
    e = _table(spark, d, "events").select(F.col("event_type").alias("bucket"), F.col("user_id").alias("key"))
    return H.cache_hits(e, e.where("key % 3 = 0"))


@query("review_corpus", "select cast(row_number() over (order by paper_id) as int) as pos, paper_id, '[' || row_number() over (order by paper_id) || '] ' || title || chr(10) || venue as block from lit_papers where citation_count >= 40", "lit_papers")
def review_corpus(spark, d):
    return H.review_corpus(view(spark, d, "lit_papers").where("citation_count >= 40").withColumn("body", F.col("venue")))


# -- streams -------------------------------------------------------------------------------------

_EVENTS = "event_id bigint, ts timestamp, user_id bigint, event_type string, value double, props string"


def _stream(spark, d) -> DataFrame:
    """The events table, read as a stream of files."""
    schema = spark.read.parquet(f"{d}/events.parquet").schema
    s = spark.readStream.schema(schema).parquet(f"{d}/[e]vents.parquet")
    return s.withColumn("ts", F.col("ts").cast("timestamp"))


@query("events_seen_dedup", "select event_type, user_id, count(*) as n from (select distinct user_id, event_type from events) t group by 1, 2")
def events_seen_dedup(spark, d):
    s = E.first_seen(_stream(spark, d), "user_id", "event_type", delay="400 days")
    return E.run_to_table(s.select("user_id", "event_type")).groupBy("event_type", "user_id").agg(F.count(F.lit(1)).alias("n"))


@query("events_tumbling", "select cast(epoch(time_bucket(interval '1 hour', ts)) as bigint) as start, event_type, count(*) as n from events group by 1, 2")
def events_tumbling(spark, d):
    out = E.run_complete(E.tumbling(_stream(spark, d), "1 hour", "event_type"))
    return out.select(F.unix_timestamp("start").alias("start"), "event_type", "n")


@query("events_sliding", "select cast(epoch(time_bucket(interval '30 minutes', ts)) as bigint) - 1800 * k as start, event_type, count(*) as n from events, range(0, 2) t(k) group by 1, 2")
def events_sliding(spark, d):
    out = E.run_complete(E.sliding(_stream(spark, d), "1 hour", "30 minutes", "event_type"))
    return out.select(F.unix_timestamp("start").alias("start"), "event_type", "n")


@query("events_sessions", "with g as (select *, case when ts - lag(ts) over (partition by user_id order by ts) < interval '2 hours' then 0 else 1 end as new from events), s as (select *, sum(new) over (partition by user_id order by ts rows unbounded preceding) as k from g) select cast(floor(epoch(min(ts))) as bigint) as start, user_id, count(*) as n from s group by user_id, k")
def events_sessions(spark, d):
    out = E.run_complete(E.sessions(_stream(spark, d), "2 hours", "user_id"))
    return out.select(F.unix_timestamp("start").alias("start"), "user_id", "n")


_BUDGET = 1000
_REQUESTS = 40


@query("budget_stream", f"""with u as (select user_id as run, event_id as call_id, cast(sum(cast(floor(value) as bigint)) over w as bigint) as used, count(*) over w as requests from events
  window w as (partition by user_id order by ts, event_id rows unbounded preceding))
select run, call_id, used, requests, used >= {_BUDGET} or requests >= {_REQUESTS} as spent from u""")
def budget_stream(spark, d):
    """Each user's events as calls of one run, whose values are their tokens."""
    calls = _stream(spark, d).select(F.col("user_id").alias("run"), F.col("event_id").alias("call_id"), F.col("ts").alias("at"), F.floor("value").cast("long").alias("tokens"))
    return E.run_to_table(gates.budget_stream(calls, _BUDGET, _REQUESTS))


@query("label_stream", """with s as (select event_id as sample_id, user_id as key, ts as asked from events where event_type = 'signup'),
a as (select user_id as key, event_id as label, ts as labelled from events where event_type = 'click'),
w as (select least((select max(asked) from s), (select max(labelled) from a)) - interval '1 hour' as mark),
j as (select sample_id, s.key, asked, labelled, label from s left join a on s.key = a.key and labelled between asked and asked + interval '2 hours')
select sample_id, key, arg_min(label, labelled) as label, max(labelled) is null as timed_out from j, w group by sample_id, key, asked, mark having max(labelled) is not null or asked + interval '2 hours' < mark""")
def label_stream(spark, d):
    """Sign-ups as samples that a click of the same user within two hours labels; what nobody can label any more times out."""
    e = _stream(spark, d)
    samples = e.where("event_type = 'signup'").select(F.col("event_id").alias("sample_id"), F.col("user_id").alias("key"), F.col("ts").alias("asked"))
    labels = e.where("event_type = 'click'").select(F.col("user_id").alias("key"), F.col("event_id").alias("label"), F.col("ts").alias("labelled"))
    out = E.run_to_table(gates.label_answers(samples, labels, "2 hours"))
    return gates.first_answers(out).drop("asked")


@query("paged_references", "select citing_id, cited_id, n - 1 as \"offset\" from (select *, row_number() over (partition by citing_id order by cited_id) as n from lit_refs) t where n <= 5", "lit_refs")
def paged_references(spark, d):
    """Reference lists dumped in pages of two, and the first five of each read back."""
    path = scratch(spark)
    paged.write_pages(view(spark, d, "lit_refs"), path, "citing_id", "cited_id", page_size=2)
    return paged.read_pages(spark, path, 2, max_items=5)
