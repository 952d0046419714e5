"""Queries over sources and full texts."""

from __future__ import annotations

import json

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import acquire as A
from ..operators import expand as X
from ..operators import output as O
from ..operators.fixpoint import scratch
from ..sources import records
from ..sources.views import view
from .registry import Registry

query = Registry()


@query("load_seeds", "select paper_id, 0 as depth, 'seed' as source from lit_papers where paper_id in (3, 5, 8) and paper_id not in (5)", "lit_papers")
def load_seeds(spark, d):
    p = view(spark, d, "lit_papers")
    seeds = spark.createDataFrame([(3,), (5,), (8,), (10**12,)], "paper_id long")
    held = spark.createDataFrame([(5,)], "paper_id long")
    new = p.join(F.broadcast(seeds), "paper_id", "left_semi").join(held, "paper_id", "left_anti")
    return new.select("paper_id", F.lit(0).alias("depth"), F.lit("seed").alias("source"))


@query("resolve_seeds", "select distinct title as seed, min(paper_id) over (partition by title) as paper_id, cast(1.0 as double) as score from lit_papers where title in (select title from lit_papers where paper_id in (1, 2, 3))", "lit_papers")
def resolve_seeds(spark, d):
    p = view(spark, d, "lit_papers")
    return X.resolve_titles(p.where("paper_id in (1, 2, 3)").select("title").distinct(), p)


@query("fetch_references", "select cited_id from lit_refs where citing_id = 1", "lit_refs")
def fetch_references(spark, d):
    return view(spark, d, "lit_refs").where("citing_id = 1").select("cited_id")


@query("fetch_citers", "select citing_id, citation_count, year from lit_refs join lit_papers on paper_id = citing_id where cited_id = 7", "lit_refs", "lit_papers")
def fetch_citers(spark, d):
    c = view(spark, d, "lit_refs").where("cited_id = 7").select(F.col("citing_id").alias("paper_id"))
    return c.join(view(spark, d, "lit_papers"), "paper_id").select(F.col("paper_id").alias("citing_id"), "citation_count", "year")


@query("fetch_embeddings", "select p.paper_id, v.paper_id is not null as known, case when v.paper_id is null then 0 else len(v.embedding) end as dims from lit_papers p left join lit_vectors v on v.paper_id = p.paper_id", "lit_papers", "lit_vectors")
def fetch_embeddings(spark, d):
    v = view(spark, d, "lit_vectors").select("paper_id", "embedding")
    return view(spark, d, "lit_papers").join(v, "paper_id", "left").select("paper_id", F.col("embedding").isNotNull().alias("known"), F.coalesce(F.size("embedding"), F.lit(0)).cast("long").alias("dims"))


@query("author_papers", "select author_id, paper_id from (select *, row_number() over (partition by author_id order by paper_id) as rn from lit_authorship) t where rn <= 5", "lit_authorship")
def author_papers(spark, d):
    rank = F.row_number().over(W.partitionBy("author_id").orderBy("paper_id"))
    return view(spark, d, "lit_authorship").withColumn("rn", rank).where("rn <= 5").drop("rn")


@query("enrich_batch", "select w.i as ord, p.paper_id, p.title from (select unnest([9, 4, 999999999, 2]) as id, unnest([0, 1, 2, 3]) as i) w join lit_papers p on p.paper_id = w.id", "lit_papers")
def enrich_batch(spark, d):
    w = spark.createDataFrame([(0, 9), (1, 4), (2, 999999999), (3, 2)], "ord int, paper_id long")
    return view(spark, d, "lit_papers").join(F.broadcast(w), "paper_id").select("ord", "paper_id", "title")


@query("edge_records", "select cast(src as varchar) as paper_id, cast(dst as varchar) as other_id, dst % 2 = 0 as is_influential from lit_dag", "lit_dag")
def edge_records(spark, d):
    e = view(spark, d, "lit_dag").groupBy("src").agg(F.to_json(F.collect_list(F.struct(F.struct(F.col("dst").cast("string").alias("paperId")).alias("citingPaper"), (F.col("dst") % 2 == 0).alias("isInfluential")))).alias("json"))
    return records.edges_from_json(e.withColumn("paper_id", F.col("src").cast("string")), inner="citingPaper").select("paper_id", "other_id", "is_influential")


@query("open_works", "select '10.1/w' || paper_id as doi, title from lit_papers", "lit_papers")
def open_works(spark, d):
    js = F.to_json(F.struct(F.concat(F.lit("https://doi.org/10.1/w"), F.col("paper_id").cast("string")).alias("doi"), "title"))
    return records.works_from_json(view(spark, d, "lit_papers").select(js.alias("json"))).select("doi", "title")


@query("title_search", "with n as (select paper_id, regexp_replace(lower(title), '[^a-z0-9]+', ' ', 'g') as t from lit_papers) select a.paper_id, b.paper_id as found_id from n a join n b on starts_with(a.t, b.t) or starts_with(b.t, a.t) where length(a.t) >= 10 and length(b.t) >= 10", "lit_papers")
def title_search(spark, d):
    p = view(spark, d, "lit_papers")
    return records.match_titles(p, p.select(F.col("paper_id").alias("found_id"), "title"))


@query("checkpoint_roundtrip", "select cast(paper_id as varchar) as paper_id, title, year from lit_papers", "lit_papers")
def checkpoint_roundtrip(spark, d):
    """The collection written as one document and read back as a checkpoint."""
    path = scratch(spark)
    p = view(spark, d, "lit_papers").select(F.col("paper_id").cast("string").alias("paper_id"), "title", "year")
    p.agg(F.collect_list(F.struct("paper_id", "title", "year")).alias("papers")).write.json(path)
    return records.load_checkpoint(spark, path).select("paper_id", "title", "year")


@query("graphml_roundtrip", "select cast(src as varchar) as src, cast(dst as varchar) as dst from lit_dag", "lit_dag")
def graphml_roundtrip(spark, d):
    path, e = scratch(spark), view(spark, d, "lit_dag")
    v = e.select(F.col("src").alias("id")).union(e.select("dst")).distinct()
    O.write_graphml(v, e, path)
    return records.read_graphml(spark, f"{path}/*.txt")[1].select("src", "dst")


@query("text_state", "select paper_id, case when paper_id % 5 = 0 then 'cached' when paper_id % 5 = 1 then 'disk' when paper_id % 5 = 2 then 'too_large' else 'fetch' end as state from lit_papers", "lit_papers")
def text_state(spark, d):
    p = view(spark, d, "lit_papers")
    m = F.col("paper_id") % 5
    cache = p.where(m.isin(0, 2, 3)).select("paper_id", F.when(m == 0, F.col("title")).alias("text"), F.when(m == 2, "too_large").when(m == 3, "download_failed").alias("error"))
    parsed = p.where(m.isin(1, 4)).select("paper_id", F.when(m == 1, F.col("title")).otherwise(" ").alias("body_text"))
    return A.text_state(p, cache, parsed).select("paper_id", "state")


@query("pdf_references", "with t as (select title, min(paper_id) as ref_id from lit_papers group by title) select p.paper_id, cast(0 as int) as pos, case when p.paper_id % 3 = 0 then p.paper_id + 1000000 else ref_id end as ref_id, case when p.paper_id % 3 = 0 then 'doi' else 'title' end as by from lit_papers p join t using (title) where length(title) >= 8 or p.paper_id % 3 = 0", "lit_papers")
def pdf_references(spark, d):
    """Each title found in a made-up list, resolved by DOI where it has one, else by title."""
    p = view(spark, d, "lit_papers")
    doi = F.when(F.col("paper_id") % 3 == 0, F.concat(F.lit("10.1234/p"), F.col("paper_id").cast("string")))
    found = p.select("paper_id", F.lit(0).alias("pos"), F.concat(F.lit("Smith (2020). "), "title").alias("entry"), "title", doi.alias("doi"))
    held = p.select("paper_id", "title", F.lit(None).cast("string").alias("doi")).union(p.where("paper_id % 3 = 0").select(F.col("paper_id") + 1000000, F.lit(""), doi))
    return A.resolve_references(found, held).where("ref_id is not null").select("paper_id", "pos", "ref_id", "by")


@query("reference_entries", "select paper_id, cast(i - 1 as int) as pos, 'A long title of work number ' || i as title from lit_abstracts, range(1, 7) t(i)", "lit_abstracts")
def reference_entries(spark, d):
    refs = F.array_join(F.transform(F.sequence(F.lit(1), F.lit(6)), lambda i: F.concat(i.cast("string"), F.lit(". Smith, J. (2020). A long title of work number "), i.cast("string"), F.lit(". Venue."))), "\n")
    t = view(spark, d, "lit_abstracts").select("paper_id", F.concat(F.rpad(F.coalesce("abstract", F.lit("")), 600, "x"), F.lit("\nReferences\n"), refs).alias("text"))
    return A.found_references(t).select("paper_id", "pos", "title")


@query("pdf_provenance", "select min(paper_id) over (partition by title) as src, paper_id as dst from lit_papers qualify src <> dst", "lit_papers")
def pdf_provenance(spark, d):
    p = view(spark, d, "lit_papers")
    r = p.select("paper_id", F.lit(0).alias("pos"), F.col("title").alias("entry"), F.min("paper_id").over(W.partitionBy("title")).alias("ref_id"))
    return A.provenance(r).select("src", "dst")


@query("fetch_chain", "select paper_id, case when paper_id % 3 = 0 then 'ok' when paper_id % 3 = 1 then 'ok' else 'not_found' end as status, case when paper_id % 3 = 0 then 'a' else 'b' end as recipe from lit_papers", "lit_papers")
def fetch_chain(spark, d):
    p = view(spark, d, "lit_papers").select("paper_id", (F.col("paper_id") % 3).alias("m"))
    a = p.select("paper_id", F.lit(1).alias("step"), F.lit("a").alias("recipe"), F.lit("http").alias("kind"), F.when(F.col("m") == 0, "ok").otherwise("not_found").alias("status"))
    b = p.select("paper_id", F.lit(2).alias("step"), F.lit("b").alias("recipe"), F.lit("http").alias("kind"), F.when(F.col("m") == 1, "ok").otherwise("not_found").alias("status"))
    return A.fetch_chain(a.union(b))


@query("annotate_labels", "select paper_id, case when paper_id % 2 = 0 then 'Label ' || paper_id else left(title, 40) end as label from lit_papers", "lit_papers")
def annotate_labels(spark, d):
    p = view(spark, d, "lit_papers")
    m = p.where("paper_id % 2 = 0").select("paper_id", F.concat(F.lit('"Label '), F.col("paper_id").cast("string"), F.lit('"\nmore')).alias("label"))
    return A.labels(p, m)


def _echo():
    return lambda instruction, text: "```json\n" + json.dumps({"n": len(text)}) + "\n```" if text else "nothing"


@query("extract_info", "select paper_id, '{\"n\": ' || length(title) || '}' as output, false as extraction_failed from lit_papers", "lit_papers")
def extract_info(spark, d):
    t = view(spark, d, "lit_papers").select("paper_id", F.col("title").alias("text"))
    return A.extract(t, "count", _echo).select("paper_id", "output", "extraction_failed")


@query("query_reply", "select conv_id, turn, 'q' || turn as q from conversations")
def query_reply(spark, d):
    c = spark.read.parquet(f"{d}/conversations.parquet")
    t = F.col("turn").cast("string")
    r = F.when(F.col("turn") % 2 == 0, F.concat(F.lit('{"query": "q'), t, F.lit('"}'))).otherwise(F.concat(F.lit('Sure: {"query": "q'), t, F.lit('"} ok')))
    return c.select("conv_id", "turn", A.query_reply(r).alias("q"))


@query("safe_filenames", "select paper_id, regexp_replace(title || '/' || paper_id, '[^A-Za-z0-9._-]', '_', 'g') as name from lit_papers", "lit_papers")
def safe_filenames(spark, d):
    return view(spark, d, "lit_papers").select("paper_id", T.safe_filename(F.concat("title", F.lit("/"), F.col("paper_id").cast("string"))).alias("name"))


@query("venue_normalized", "select paper_id, trim(regexp_replace(lower(venue), '\\s+', ' ', 'g')) as venue, contains(lower(venue), 'arxiv') as preprint from lit_papers", "lit_papers")
def venue_normalized(spark, d):
    return view(spark, d, "lit_papers").select("paper_id", T.normalize_venue("venue").alias("venue"), T.is_preprint_venue("venue").alias("preprint"))

