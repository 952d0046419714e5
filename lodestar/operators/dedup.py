"""Duplicate papers: blocking, pair rules, clusters, canonical records, merge and rewrite."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import external_key, is_preprint_venue, normalize_title
from ..functions.vectors import cosine
from .fixpoint import materialised
from .graph import components

#: The weight and length of the common prefix in the similarity.
PREFIX_WEIGHT, PREFIX_LENGTH = 0.1, 4
#: Papers of one author that meet in one tile, and the classes into which letters are counted.
TILE, LETTERS = 1024, 64


def jaro(a: str, b: str) -> float:
    """Share of matching characters within half the longer length, less half the swapped ones (rounded down)."""
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    reach = max(0, max(len(a), len(b)) // 2 - 1)
    free = [True] * len(b)
    ours: list[str] = []
    for i, c in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if free[j] and b[j] == c:
                free[j] = False
                ours.append(c)
                break
    if not ours:
        return 0.0
    theirs = [c for c, f in zip(b, free) if not f]
    swapped = sum(x != y for x, y in zip(ours, theirs)) // 2
    m = len(ours)
    return (m / len(a) + m / len(b) + (m - swapped) / m) / 3


def jaro_winkler_of(a: str, b: str) -> float:
    """Jaro, raised for up to four common first characters whatever its value."""
    j = jaro(a, b)
    common = 0
    for x, y in zip(a[:PREFIX_LENGTH], b):
        if x != y:
            break
        common += 1
    return j + common * PREFIX_WEIGHT * (1 - j)


def _jw(a: pd.Series, b: pd.Series) -> pd.Series:
    memo: dict[tuple[str, str], float] = {}
    out = []
    for pair in zip(a.fillna(""), b.fillna("")):
        if pair not in memo:
            memo[pair] = jaro_winkler_of(*pair)
        out.append(memo[pair])
    return pd.Series(out, dtype="float64")


def jaro_winkler(a: str | Column, b: str | Column) -> Column:
    return F.pandas_udf(_jw, T.DoubleType())(a, b)


def external_keys(papers: DataFrame) -> DataFrame:
    """(paper_id, key) for each external id of papers' external_ids map."""
    e = papers.select("paper_id", F.explode("external_ids").alias("ns", "value"))
    return e.select("paper_id", external_key("ns", "value").alias("key")).where("key is not null").distinct()


def first_author(authors: str | Column = "authors") -> Column:
    """The id of the first author that has one."""
    a = F.col(authors) if isinstance(authors, str) else authors
    return F.get(F.filter(a, lambda x: x["authorId"].isNotNull() & (x["authorId"] != "")), F.lit(0))["authorId"]


def candidate_pairs(papers: DataFrame, keys: DataFrame | None = None) -> DataFrame:
    """(a, b, same_key): papers that share an external key, each tied to the smallest one that has it."""
    if keys is None:
        return papers.select(F.col("paper_id").alias("a"), F.col("paper_id").alias("b"), F.lit(True).alias("same_key")).limit(0)
    low = keys.groupBy("key").agg(F.min("paper_id").alias("a"))
    return keys.join(low, "key").where("paper_id > a").select("a", F.col("paper_id").alias("b"), F.lit(True).alias("same_key")).distinct()


def title_bounds(counts: np.ndarray, sizes: np.ndarray, heads: np.ndarray, x: int, others: np.ndarray) -> np.ndarray:
    """Upper bounds of the title similarity of x with others: they match in no more characters than they have of each class of letters together."""
    common = np.minimum(counts[others], counts[x]).sum(axis=1, dtype=np.int64)
    j = np.where(common > 0, (common / sizes[x] + common / sizes[others] + 1) / 3, 0.0)
    same = np.cumprod(heads[others] == heads[x], axis=1).sum(axis=1)
    return j + same * PREFIX_WEIGHT * (1 - j)


def _coded(titles: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(letters of each class, lengths, first characters) of titles; a first character that is not there equals none."""
    n = len(titles)
    sizes = np.array([max(1, len(t)) for t in titles], dtype=np.int64)
    counts = np.zeros((n, LETTERS), dtype=np.int16)
    heads = np.repeat(-1 - np.arange(n, dtype=np.int64)[:, None], PREFIX_LENGTH, axis=1)
    for i, t in enumerate(titles):
        codes = np.frombuffer(t.encode("utf-32-le"), "<u4")
        np.add.at(counts[i], codes % LETTERS, 1)
        head = codes[:PREFIX_LENGTH]
        heads[i, : len(head)] = head
    return counts, sizes, heads


def best_titles(seeds: list[tuple[str, str]], least: float):
    """A function over frames (paper_id, pt) that gives the best paper of each (title, normal title) among those of its task."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        best: dict[str, tuple[float, object]] = {}
        for f in frames:
            f = f.sort_values("paper_id")
            ids, titles = f["paper_id"].tolist(), f["pt"].fillna("").tolist()
            if not ids:
                continue
            coded = _coded([*titles, *(t for _, t in seeds)])
            for k, (seed, title) in enumerate(seeds):
                score, at = best.get(seed, (-1.0, None))
                bound = title_bounds(*coded, len(ids) + k, np.arange(len(ids)))
                # the likeliest first: once a score is known, nothing whose bound is below it is computed
                for i in np.argsort(-bound, kind="stable").tolist():
                    if bound[i] < max(score, least) - 1e-9:
                        break
                    s = jaro_winkler_of(title, titles[i])
                    if s >= least and (s > score or s == score and ids[i] < at):
                        score, at = s, ids[i]
                if at is not None:
                    best[seed] = (score, at)
        if best:
            yield pd.DataFrame([(seed, at, score) for seed, (score, at) in best.items()], columns=["seed", "paper_id", "score"])

    return run


def _alike(ids: list, titles: list[str], years: list, vectors: list, left: np.ndarray, right: np.ndarray | None, titled: float, near: float, window: int) -> Iterator[tuple]:
    """(a, b) of a tile's rows that the vectors, or titles and years, make duplicates; right None: pairs inside left."""
    n = len(ids)
    counts, sizes, heads = _coded(titles)
    year = np.array([np.nan if y is None else y for y in years], dtype=float)
    has = np.array([bool(t) for t in titles])
    dims: dict[int, list[int]] = {}
    for i, v in enumerate(vectors):
        if v is not None and len(v) and None not in v and any(v):
            dims.setdefault(len(v), []).append(i)
    unit, dim = {}, np.zeros(n, dtype=int)
    for d, rows in dims.items():
        x = np.array([vectors[i] for i in rows], dtype=float)
        x /= np.sqrt((x * x).sum(axis=1))[:, None]
        unit |= dict(zip(rows, x))
        dim[rows] = d
    for x in left.tolist():
        others = right if right is not None else left[left > x]
        if not len(others):
            continue
        found = np.zeros(len(others), dtype=bool)
        if dim[x]:
            same = np.flatnonzero(dim[others] == dim[x])
            if len(same):
                found[same] = np.stack([unit[i] for i in others[same].tolist()]) @ unit[x] >= near
        if has[x]:
            may = np.flatnonzero(~found & has[others] & ~(np.abs(year[others] - year[x]) > window))
            may = may[title_bounds(counts, sizes, heads, x, others[may]) >= titled - 1e-9]
            for k in may.tolist():
                found[k] = jaro_winkler_of(titles[x], titles[others[k]]) >= titled
        for k in others[found].tolist():
            yield (ids[x], ids[k]) if ids[x] < ids[k] else (ids[k], ids[x])


def _tiles(titled: float, near: float, window: int):
    def run(key: tuple, t: pa.Table) -> pa.Table:
        side = t.column("side").to_numpy()
        i, j = key[1].as_py(), key[2].as_py()
        left, right = (np.flatnonzero(side == 0), np.flatnonzero(side == 1)) if i != j else (np.arange(len(side)), None)
        pairs = list(_alike(*(t.column(c).to_pylist() for c in ("paper_id", "norm_title", "year", "embedding")), left, right, titled, near, window))
        kind = t.schema.field("paper_id").type
        return pa.table({name: pa.array([p[k] for p in pairs], kind) for k, name in enumerate("ab")})

    return run


def duplicate_pairs(pairs: DataFrame, papers: DataFrame, title_threshold: float = 0.95, semantic_threshold: float = 0.98, year_window: int = 1) -> DataFrame:
    """(a, b): the pairs of a shared key, and all pairs of one first author, or of none, that the vectors, or titles and years, make duplicates.

    papers has paper_id, norm_title, author (null if unknown), year and embedding. An author's papers are dealt into tiles
    by hash and each pair of tiles meets in one task, so an author of any size, or the missing one, is compared
    whole. Letter counts bound the title similarity from above; what may reach the threshold is computed.
    """
    p = papers.select("paper_id", F.coalesce("norm_title", F.lit("")).alias("norm_title"), F.concat(F.lit("a"), F.col("author").cast("string")).alias("author"), F.col("year").cast("double").alias("year"), F.col("embedding").cast("array<double>").alias("embedding"))
    p = materialised(p.withColumn("author", F.coalesce("author", F.lit(""))))
    tiles = p.groupBy("author").agg(F.ceil(F.count(F.lit(1)) / TILE).cast("int").alias("tiles"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    p = p.join(tiles, "author").withColumn("blk", F.pmod(F.xxhash64("paper_id"), F.col("tiles")).cast("int"))
    p = p.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    p = p.select("author", F.least("blk", "other").alias("i"), F.greatest("blk", "other").alias("j"), F.when(F.col("blk") <= F.col("other"), 0).otherwise(1).alias("side"), "paper_id", "norm_title", "year", "embedding")
    kind = dict(papers.dtypes)["paper_id"]
    alike = p.groupBy("author", "i", "j").applyInArrow(_tiles(title_threshold, semantic_threshold, year_window), f"a {kind}, b {kind}")
    return pairs.select("a", "b").union(alike).distinct()


def duplicate_clusters(pairs: DataFrame) -> DataFrame:
    """(paper_id, cluster): the smallest id that duplicate pairs reach; clusters of two and more."""
    return components(pairs, "a", "b").select(F.col("id").alias("paper_id"), F.col("comp").alias("cluster"))


def ranked(members: DataFrame) -> DataFrame:
    """members with `pos`, their order in a cluster: published before preprint, then more citations, longer abstract, smaller id."""
    return members.withColumn("pos", F.struct(
        is_preprint_venue("venue").alias("preprint"), F.negative(F.coalesce("citation_count", F.lit(0))).alias("cited"),
        F.negative(F.char_length(F.coalesce("abstract", F.lit("")))).alias("length"), F.col("paper_id").alias("id"),
    ))


def pick_canonical(members: DataFrame) -> DataFrame:
    """members (cluster, paper_id, venue, citation_count, abstract) ranked, with `canonical`, the cluster's best record.

    Keys may tie most papers into one cluster: its best record is found where its rows are, and no task holds it whole.
    """
    m = ranked(members)
    return m.join(m.groupBy("cluster").agg(F.min("pos").alias("best")).select("cluster", F.col("best.id").alias("canonical")), "cluster")


def merge_clusters(ranked: DataFrame) -> DataFrame:
    """One record a cluster from ranked (as `ranked` or `pick_canonical` gives, with year, references): the canonical one first.

    Missing values are filled from the next ones, citations are the largest, references the union in
    order, aliases the other ids, n_aliases their number. Only references and aliases, where they are asked for, hold a cluster in one row.
    """
    first = lambda c: F.min_by(F.when(F.col(c).isNotNull() & (F.col(c).cast("string") != ""), F.col(c)), F.when(F.col(c).isNotNull() & (F.col(c).cast("string") != ""), F.col("pos"))).alias(c)
    held = F.transform(F.sort_array(F.collect_list(F.struct("pos", "references"))), lambda x: x["references"])
    canonical = F.min("pos")["id"]
    return ranked.groupBy("cluster").agg(
        canonical.alias("paper_id"), first("abstract"), first("venue"), first("year"), F.max("citation_count").alias("citation_count"),
        F.array_distinct(F.flatten(held)).alias("references"), F.array_sort(F.array_remove(F.collect_list("paper_id"), canonical)).alias("aliases"), (F.count(F.lit(1)) - 1).cast("int").alias("n_aliases"),
    )


def rewrite_references(refs: DataFrame, alias: DataFrame) -> DataFrame:
    """(paper_id, ord, ref) with references and papers replaced by their canonical ids (alias, canonical); repeats and self-references go, the first of equals stays."""
    a = alias.select("alias", "canonical")
    r = refs.join(a.withColumnRenamed("alias", "ref").withColumnRenamed("canonical", "to_ref"), "ref", "left").join(a.withColumnRenamed("alias", "paper_id").withColumnRenamed("canonical", "to_paper"), "paper_id", "left")
    r = r.select(F.coalesce("to_paper", "paper_id").alias("paper_id"), "ord", F.coalesce("to_ref", "ref").alias("ref")).where("paper_id <> ref")
    return r.groupBy("paper_id", "ref").agg(F.min("ord").alias("ord"))


def rewrite_signal(signal: DataFrame, alias: DataFrame) -> DataFrame:
    """signal (paper_id, ord) with aliases replaced; the first of equals stays."""
    s = signal.join(alias.withColumnRenamed("alias", "paper_id"), "paper_id", "left").select(F.coalesce("canonical", "paper_id").alias("paper_id"), "ord")
    return s.groupBy("paper_id").agg(F.min("ord").alias("ord"))


def with_normal_titles(papers: DataFrame) -> DataFrame:
    return papers.withColumn("norm_title", normalize_title("title"))
