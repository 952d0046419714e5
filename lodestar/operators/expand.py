"""Expansion of a signal along citations, search, vectors and authors: equi-joins, windows and anti-joins.

A signal is a DataFrame with paper_id and ord, its order. Edges are (citing_id, cited_id).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.vectors import cosine_or_zero


def claim(candidates: DataFrame, seen: DataFrame) -> DataFrame:
    """Each unseen candidate once, with the first source of the signal that reaches it, whether or not it passes later."""
    new = candidates.join(seen.select(F.col("paper_id").alias("cand")), "cand", "left_anti")
    first = F.row_number().over(W.partitionBy("cand").orderBy("source_ord", "source"))
    return new.withColumn("rn", first).where("rn = 1").drop("rn")


def top_citers(sources: DataFrame, edges: DataFrame, papers: DataFrame, k: int) -> DataFrame:
    """(source, source_ord, cand): the k most cited citers of each source (unknown counts as 0; ties by id)."""
    e = edges.join(sources.select(F.col("paper_id").alias("cited_id"), F.col("ord").alias("source_ord")), "cited_id")
    c = e.join(papers.select(F.col("paper_id").alias("citing_id"), F.coalesce("citation_count", F.lit(0)).alias("n")), "citing_id", "left")
    rank = F.row_number().over(W.partitionBy("cited_id").orderBy(F.desc(F.coalesce("n", F.lit(0))), "citing_id"))
    return c.withColumn("rank", rank).where(F.col("rank") <= k).select(F.col("cited_id").alias("source"), "source_ord", F.col("citing_id").alias("cand"))


def expand_forward(sources: DataFrame, edges: DataFrame, papers: DataFrame, seen: DataFrame, max_citations: int = 100) -> DataFrame:
    """(source, source_ord, cand): what forward expansion screens. The cut to max_citations comes before the seen ones go."""
    return claim(top_citers(sources, edges, papers, max_citations), seen)


def expand_backward(sources: DataFrame, edges: DataFrame, seen: DataFrame) -> DataFrame:
    """(source, source_ord, cand): the references of the sources."""
    e = edges.join(sources.select(F.col("paper_id").alias("citing_id"), F.col("ord").alias("source_ord")), "citing_id")
    return claim(e.select(F.col("citing_id").alias("source"), "source_ord", F.col("cited_id").alias("cand")), seen)


def with_source_sets(claimed: DataFrame, citers: DataFrame, edges: DataFrame) -> DataFrame:
    """claimed with source_refs and source_citers, for similarity to the source."""
    refs = edges.groupBy(F.col("citing_id").alias("source")).agg(F.collect_set("cited_id").alias("source_refs"))
    top = citers.groupBy("source").agg(F.collect_set("cand").alias("source_citers"))
    return claimed.join(refs, "source", "left").join(top, "source", "left")


def nearest(anchors: DataFrame, vectors: DataFrame, k: int) -> DataFrame:
    """(anchor, paper_id, score, rank): each anchor's k nearest others by cosine, ties by id.

    anchors (paper_id, embedding) are a stated, bounded set and are broadcast; of each task at most k rows
    an anchor go to the ranking.
    """
    a = anchors.select(F.col("paper_id").alias("anchor"), F.col("embedding").alias("a_vec"))
    pairs = vectors.join(F.broadcast(a), F.col("paper_id") != F.col("anchor"))
    scored = pairs.select("anchor", "paper_id", cosine_or_zero(F.col("a_vec"), F.col("embedding")).alias("score"))
    rank = F.row_number().over(W.partitionBy("anchor").orderBy(F.desc("score"), "paper_id"))
    return scored.withColumn("rank", rank).where(F.col("rank") <= k)


def recommend(positive: DataFrame, negative: DataFrame | None, vectors: DataFrame, k: int) -> DataFrame:
    """(paper_id, score): cosine with the mean of the positive less the mean of the negative vectors; anchors left out."""
    from .topics import centroid

    p = centroid(positive.select(F.lit(0).alias("cid"), "embedding")).select(F.col("centroid").alias("p"))
    ids = positive.select("paper_id")
    if negative is not None:
        n = centroid(negative.select(F.lit(0).alias("cid"), "embedding")).select(F.col("centroid").alias("n"))
        ids = ids.union(negative.select("paper_id"))
        p = p.join(n, how="left")
        mean = F.when(F.col("n").isNull(), F.col("p")).otherwise(F.zip_with("p", "n", lambda x, y: x - y))
        p = p.select(mean.alias("p"))
    rest = vectors.join(ids, "paper_id", "left_anti")
    return rest.join(F.broadcast(p)).select("paper_id", cosine_or_zero(F.col("p"), F.col("embedding")).alias("score")).orderBy(F.desc("score"), "paper_id").limit(k)


def top_authors(authorship: DataFrame, metric: DataFrame, signal: DataFrame, k: int) -> DataFrame:
    """(author_id, score): the k best authors of the signal's papers by metric (author_id, score), ties by id."""
    mine = authorship.join(signal.select("paper_id"), "paper_id", "left_semi").select("author_id").distinct()
    return mine.join(metric, "author_id", "left").select("author_id", F.coalesce("score", F.lit(0)).alias("score")).orderBy(F.desc("score"), "author_id").limit(k)


def expand_by_author(signal: DataFrame, authorship: DataFrame, metric: DataFrame, seen: DataFrame, top_k: int = 10, per_author: int = 100) -> DataFrame:
    """(paper_id): unseen papers of the signal's best authors, per_author of each by id."""
    best = top_authors(authorship, metric, signal, top_k).select("author_id")
    rank = F.row_number().over(W.partitionBy("author_id").orderBy("paper_id"))
    p = authorship.join(best, "author_id", "left_semi").withColumn("rn", rank).where(F.col("rn") <= per_author)
    return p.select("paper_id").distinct().join(seen.select("paper_id"), "paper_id", "left_anti")


def parallel_union(branches: list[DataFrame]) -> DataFrame:
    """(paper_id, branch, ord): the union of the branches' signals; of a paper in several the first branch stays."""
    all_ = reduce(DataFrame.unionByName, (b.select("paper_id", F.lit(i).alias("branch"), "ord") for i, b in enumerate(branches)))
    first = F.row_number().over(W.partitionBy("paper_id").orderBy("branch", "ord"))
    return all_.withColumn("rn", first).where("rn = 1").drop("rn")


def expand_stats(raw: DataFrame, hydrated: DataFrame, novel: DataFrame, screened: DataFrame) -> DataFrame:
    """One row: raw hits, hydrated, novel, accepted and rejected candidates of a step."""
    one = lambda df, name: df.agg(F.count(F.lit(1)).alias(name))
    s = screened.agg(F.count_if("outcome.passed").alias("accepted"), F.count_if(~F.col("outcome.passed")).alias("rejected"))
    return one(raw, "raw_hits").join(one(hydrated, "hydrated")).join(one(novel, "novel")).join(s)


def rescreen(collection: DataFrame, seeds: DataFrame, passed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(kept, rejected ids): papers of the collection that are neither seeds nor in passed (paper_id) go."""
    out = collection.join(seeds.select("paper_id"), "paper_id", "left_anti").join(passed.select("paper_id"), "paper_id", "left_anti").select("paper_id")
    return collection.join(out, "paper_id", "left_anti"), out


#: Seed titles that one task compares its papers with at a time.
SEED_TITLES = 2000


def resolve_titles(seeds: DataFrame, papers: DataFrame, least: float = 0.0) -> DataFrame:
    """(seed, paper_id, score): the most similar title of all papers for each seed title, ties to the smallest id; none below `least`.

    Every paper is compared with every seed, but only what letter counts leave room for is computed. A task
    keeps the best paper of each seed among its own, so what is shuffled is a row a seed and task. Seeds go
    over the papers in shares of SEED_TITLES, a share at a time with the task.
    """
    from ..functions.text import normalize_title
    from .dedup import best_titles

    s = seeds.select(F.col("title").alias("seed")).where("seed is not null").distinct()
    n = s.count()
    out = None
    kind = dict(papers.dtypes)["paper_id"]
    p = papers.select("paper_id", normalize_title("title").alias("pt"))
    for part in range(-(-n // SEED_TITLES)):
        share = s if n <= SEED_TITLES else s.where(F.pmod(F.xxhash64("seed"), F.lit(-(-n // SEED_TITLES))) == part)
        # bounded: the titles of one share
        titles = [tuple(r) for r in share.select("seed", normalize_title("seed").alias("st")).collect()]
        found = p.mapInPandas(best_titles(titles, least), f"seed string, paper_id {kind}, score double")
        out = found if out is None else out.union(found)
    if out is None:
        return p.select(F.lit("").alias("seed"), "paper_id", F.lit(0.0).alias("score")).limit(0)
    best = out.groupBy("seed").agg(F.max("score").alias("score"), F.min_by("paper_id", F.struct(F.negative("score"), "paper_id")).alias("paper_id"))
    return best.select("seed", "paper_id", "score")


def fingerprint(signal: DataFrame, step: str, options: str = "") -> DataFrame:
    """(fingerprint): a digest of a step, its options and its signal's ids (paper_id) in any order, from their number and the sum of their hashes."""
    h = F.conv(F.substring(F.md5(F.col("paper_id").cast("string").cast("binary")), 1, 15), 16, 10).cast("decimal(38,0)")
    n = signal.agg(F.count("paper_id").cast("string").alias("n"), F.coalesce(F.sum(h), F.lit(0).cast("decimal(38,0)")).cast("string").alias("total"))
    return n.select(F.sha2(F.concat_ws("|", F.lit(step), F.lit(options), "n", "total").cast("binary"), 256).alias("fingerprint"))
