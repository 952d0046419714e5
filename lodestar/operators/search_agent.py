"""Search refined by a model: it proposes a query, the corpus answers, and what the query found and missed goes into the next question."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import asdict, dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import strip_fences, strip_think, translate_query
from .acquire import query_reply
from .fixpoint import materialised
from .screening import sanitize_sort, search_predicate
from .verdicts import maker

#: What a model is told.
TASK = 'You search for papers. Write one Boolean query of words, "phrases", word*, AND, OR, NOT and parentheses. Reply {"query": text}.'
#: Titles of missed anchors, and of new hits, that a question shows.
SHOWN = 5
#: Columns by which hits can be sorted, by the fields of a sort clause.
SORTED = {"paperId": "paper_id", "publicationDate": "publication_date", "citationCount": "citation_count"}


@dataclass
class Agent:
    """Options: turns and hits of one turn at most, the share of new hits among a turn's below which it was the last, the order of hits."""

    model: str = "stub"
    max_iterations: int = 1
    max_papers_per_iteration: int | None = 10_000
    min_new: float = 0.05
    max_anchor_papers: int = 20
    sort: str | None = None


@dataclass
class Turn:
    number: int
    query: str
    matched: int
    new: int
    anchors_found: int

    def line(self) -> str:
        return f"{self.number}. {self.query}: {self.matched} papers, {self.new} of them new, {self.anchors_found} of the known papers"


def question(topic: str, turns: list[Turn], missed: list[str], fresh: list[str]) -> str:
    """The topic, and after the first turn the queries so far, known papers that none found, and some papers that the last one added."""
    parts = [f"Topic: {topic}"]
    if turns:
        parts += ["Queries so far:", *(t.line() for t in turns)]
    if missed:
        parts += ["Known papers that no query found:", *(f"- {t}" for t in missed)]
    if fresh:
        parts += ["The last query added:", *(f"- {t}" for t in fresh)]
    return "\n".join(parts)


def ask(spark: SparkSession, model: str, text: str) -> str | None:
    """The model's query in search syntax; null if the call fails or its reply holds none."""
    make = maker(model)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        call = make()
        for f in frames:
            replies = []
            for user in f["user"]:
                try:
                    replies.append(call(TASK, user, 0))
                except Exception:  # no reply ends the search, not the run
                    replies.append(None)
            yield pd.DataFrame({"reply": pd.Series(replies, dtype=object)})

    got = spark.createDataFrame([(text,)], "user string").mapInPandas(run, "reply string")
    return got.select(F.nullif(translate_query(query_reply(strip_fences(strip_think("reply")))), F.lit(""))).first()[0]


def _order(papers: DataFrame, sort: str | None) -> list[Column]:
    by = sanitize_sort(sort)
    if by is None:
        return [F.desc_nulls_last("citation_count"), F.col("paper_id")] if "citation_count" in papers.columns else [F.col("paper_id")]
    name, down = SORTED[by[0]], by[1]
    if name not in papers.columns:
        return [F.col("paper_id")]
    return [F.desc_nulls_last(name) if down else F.asc_nulls_last(name), F.col("paper_id")]


def refine(papers: DataFrame, anchors: DataFrame, topic: str, agent: Agent, spend: Callable[[str], bool] | None = None) -> tuple[DataFrame, list[Turn]]:
    """(paper_id, turn) that the model's queries match in papers (paper_id, title, abstract if known), each with the first turn that found it, and the turns.

    Anchors (paper_id, title) are papers known to be wanted, at most max_anchor_papers of which are followed: the
    state of the loop is whether a query has found each. It ends after max_iterations, on a reply without a query or
    with one that was asked before, once a turn's share of new papers falls below min_new, or when spend, called with
    each question, says that nothing is left. An empty topic asks nothing. A turn takes max_papers_per_iteration
    papers in the order of sort, by default the most cited, or all if that is None; the driver gets counts and SHOWN titles.
    """
    spark = papers.sparkSession
    found = spark.createDataFrame([], f"paper_id {dict(papers.dtypes)['paper_id']}, turn int")
    turns: list[Turn] = []
    if not topic.strip():
        return found, turns
    text = F.concat_ws(" ", *(F.col(c) for c in ("title", "abstract") if c in papers.columns))
    open_ = materialised(anchors.orderBy("paper_id").limit(agent.max_anchor_papers).select("paper_id", "title").withColumn("found", F.lit(None).cast("int")))
    fresh: list[str] = []
    for i in range(1, max(1, agent.max_iterations) + 1):
        missed = [r[0] for r in open_.where("found is null and title is not null").orderBy("paper_id").limit(SHOWN).select("title").collect()] if turns else []
        asked = question(topic, turns, missed, fresh)
        if spend is not None and not spend(TASK + asked):
            break
        query = ask(spark, agent.model, asked)
        if query is None or query in {t.query for t in turns}:
            break
        hits = papers.where(search_predicate(query, text))
        if agent.max_papers_per_iteration is not None:
            hits = hits.orderBy(*_order(papers, agent.sort)).limit(max(1, agent.max_papers_per_iteration))
        hits = materialised(hits.select("paper_id", "title"))
        new = materialised(hits.join(found, "paper_id", "left_anti"))
        open_ = materialised(open_.join(hits.select("paper_id", F.lit(i).alias("now")).distinct(), "paper_id", "left").select("paper_id", "title", F.coalesce("found", "now").alias("found")))
        n, more = hits.count(), new.count()
        turns.append(Turn(i, query, n, more, open_.where(F.col("found") == i).count()))
        found = materialised(found.union(new.select("paper_id", F.lit(i).alias("turn")).distinct()))
        if more <= agent.min_new * n:
            break
        fresh = [r[0] for r in new.where("title is not null").orderBy("paper_id").limit(SHOWN).select("title").collect()]
    return found, turns


def turn_table(spark: SparkSession, turns: list[Turn]) -> DataFrame:
    return spark.createDataFrame([tuple(asdict(t).values()) for t in turns], "number int, query string, matched long, new long, anchors_found long")
