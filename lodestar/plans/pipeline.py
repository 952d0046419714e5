"""Runs a configured pipeline of steps over a corpus; each step maps a signal to a signal and updates the run's tables."""

from __future__ import annotations

import inspect
import json
from collections.abc import Callable
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import normalize_title
from ..operators import acquire, communities, dedup, expand, history, output, ranking, screening, search_agent, topics, verdicts
from ..operators.fixpoint import materialised, numbered
from ..operators.formula import Formula
from ..operators.graph import author_stats, citation_edges, collaboration, degrees, edge_similarities, edge_weights, pagerank, semantic_similarities
from ..sources.fallback import fallback_edges, fill_fields
from .config import ConfigError, Settings, build_block, walk
from .resume import States, chain, continue_from


#: Fields that the last step fills from fallbacks.
FILLED = ("abstract", "pdf_url", "venue")
#: Rejected papers that a semantic expansion takes as negatives at most.
NEGATIVES = 50
#: Shorter titles are too general to tell a seed's other version.
SIBLING_TITLE = 30

#: Takes the sample (paper_id, accepted, category, and the papers' columns); gives labels (paper_id, keep) and whether to stop.
Review = Callable[[DataFrame], tuple[DataFrame, bool]]


class OutageError(BaseException):
    """A service stays away: not an Exception, so that no step's handler takes it for a failed item."""


class BudgetSpent(Exception):
    """No tokens are left for a model: the step that asks ends, and the run goes to its last step."""


@dataclass
class Corpus:
    """What expansion draws from: papers (with external_ids if known), edges (citing_id, cited_id), and if there vectors, authorship and full texts (paper_id, text).

    Fallbacks are asked in their order, by name, for what is missing: tables of papers' fields, and of edges.
    The version tells a resumed run whether its corpus is still the same.
    """

    papers: DataFrame
    edges: DataFrame
    vectors: DataFrame | None = None
    authorship: DataFrame | None = None
    texts: DataFrame | None = None
    more_papers: list[tuple[str, DataFrame]] = field(default_factory=list)
    more_edges: list[tuple[str, DataFrame]] = field(default_factory=list)
    version: str = ""


@dataclass
class StepResult:
    signal: DataFrame
    stats: dict = field(default_factory=dict)
    stop: bool = False


class Run:
    """State of a run: collection (paper_id, depth, source, supporting_papers), seen, rejections, clusters, events."""

    def __init__(self, spark: SparkSession, settings: Settings, corpus: Corpus, review: Review | None = None):
        self.spark, self.settings, self.corpus, self.review = spark, settings, corpus, review
        self.id_type = dict(corpus.papers.dtypes)["paper_id"]
        self.collection = self._empty(f"paper_id {self.id_type}, depth int, source string, supporting_papers array<{self.id_type}>")
        self.seen = self._empty(f"paper_id {self.id_type}")
        self.rejected = self._empty(f"paper_id {self.id_type}, category string, seq int")
        self.clusters: dict[str, DataFrame] = {}
        self.names: dict[str, DataFrame] = {}
        self.judged: list[DataFrame] = []
        self.resolved: DataFrame | None = None
        self.alias: DataFrame | None = None
        self.shape: list[dict] = []
        self.events: list[dict] = []
        self.done: set[str] = set()
        self.original, self.given, self.iteration = corpus, "", 1
        self.tokens = self.requests = 0
        self.quotes = self._empty(f"citing_id {self.id_type}, cited_id {self.id_type}, quotes array<string>, resolved_by array<string>")

    def _empty(self, schema: str) -> DataFrame:
        return self.spark.createDataFrame([], schema)

    def emit(self, kind: str, **what: object) -> None:
        self.events.append({"seq": len(self.events), "kind": kind, **what})

    def signal(self, ids: DataFrame) -> DataFrame:
        return numbered(ids.select("paper_id"), "paper_id", name="ord").withColumn("ord", (F.col("ord") + 1).cast("int")) if "ord" not in ids.columns else ids.select("paper_id", "ord")

    # -- screening ------------------------------------------------------------------------------

    def screen(self, cands: DataFrame, screener: str | dict) -> DataFrame:
        """cands with outcome; model verdicts are asked only of what the blocks before them let pass."""
        block = build_block(screener, self.settings.blocks)
        specs = list(walk(screener, self.settings.blocks))
        if any((m if isinstance(m, str) else m.get("type")) == "SemanticSim" for s in specs for m in s.get("measures", [])):
            cands = self._with_vectors(cands)
        for s in specs:
            if s.get("type") == "LLMFilter":
                cands = self._verdict(cands, s, screener)
        return screening.screen(cands, block)

    def _with_vectors(self, cands: DataFrame) -> DataFrame:
        """cands with embedding and source_embedding; null for papers without vector and candidates without source."""
        cands = cands.drop("embedding", "source_embedding")
        v = self.corpus.vectors
        if v is None:
            return cands.withColumns({n: F.lit(None).cast("array<double>") for n in ("embedding", "source_embedding")})
        v = v.groupBy("paper_id").agg(F.first("embedding", ignorenulls=True).alias("embedding"))
        cands = cands.join(v, "paper_id", "left")
        if "supporting_papers" not in cands.columns:
            return cands.withColumn("source_embedding", F.lit(None).cast(cands.schema["embedding"].dataType))
        of = v.select(F.col("paper_id").alias("_source"), F.col("embedding").alias("source_embedding"))
        return cands.withColumn("_source", F.try_element_at("supporting_papers", F.lit(1))).join(of, "_source", "left").drop("_source")

    def _verdict(self, cands: DataFrame, spec: dict, screener: str | dict) -> DataFrame:
        name = spec.get("name") or next((n for n, b in self.settings.blocks.items() if b is spec or b == spec), "llm")
        how = {k: spec[k] for k in ("scope", "votes", "min_accepts", "model") if k in spec} | {"batch": self.settings.llm_batch_size, "memo": self.settings.reply_memo or None}
        top = screener if isinstance(screener, dict) else self.settings.blocks.get(screener, {})
        ahead: list = []
        if top.get("type") == "Sequential":  # the layers before the first model are cheap and go first
            for layer in top["layers"]:
                if any(x.get("type") == "LLMFilter" for x in walk(layer, self.settings.blocks)):
                    break
                ahead.append(build_block(layer, self.settings.blocks))
        for c in ("full_text", "abstract", "title", "venue"):
            if c not in cands.columns:
                cands = cands.withColumn(c, F.lit(None).cast("string"))
        if self.spent():
            raise BudgetSpent(f"{self.tokens} of {self.settings.max_tokens} tokens and {self.requests} of {self.settings.max_requests} requests are used")
        asked = materialised(cands.where(screening.Sequential(ahead).passes()))
        criteria = [spec["queries"][n] for n in Formula(spec["formula"]).names()] if spec.get("formula") else [spec.get("prompt", "")]
        self.requests += -(-asked.count() // max(1, self.settings.llm_batch_size)) * len(criteria) * int(spec.get("votes", 1))
        self.tokens += verdicts.tokens_of(asked, criteria, **{k: how[k] for k in ("scope", "votes", "batch", "memo", "model") if k in how})
        if spec.get("formula"):
            got = verdicts.formula_verdicts(asked, spec["formula"], spec["queries"], **how)
        else:
            got = verdicts.verdicts(asked, spec.get("prompt", ""), **how)
        got = materialised(got.select("paper_id", F.col("verdict").alias(f"verdict_{name}")))
        self.judged.append(got.select("paper_id", F.lit(name).alias("filter"), F.col(f"verdict_{name}").alias("accepted"), F.lit(len(self.judged)).alias("seq")))
        return cands.join(got, "paper_id", "left")

    def spent(self) -> bool:
        """Whether models were asked for all tokens, or as often, as the settings allow; the last question may go beyond."""
        return self.tokens >= self.settings.max_tokens or self.requests >= self.settings.max_requests

    def admit(self, screened: DataFrame, source: str) -> StepResult:
        """Passed candidates join the collection, the others the ledger; all were seen."""
        screened = materialised(screened)
        n = len(self.shape)
        ok = screened.where("outcome.passed")
        depth = F.coalesce(F.col("depth"), F.lit(1)) if "depth" in screened.columns else F.lit(1)
        by = F.col("supporting_papers") if "supporting_papers" in screened.columns else F.array().cast(f"array<{self.id_type}>")
        new = ok.select("paper_id", depth.cast("int").alias("depth"), F.lit(source).alias("source"), by.alias("supporting_papers")).join(self.collection, "paper_id", "left_anti")
        self.collection = materialised(self.collection.union(new))
        self.rejected = materialised(self.rejected.union(screening.rejections(screened).select("paper_id", "category", F.lit(n).alias("seq"))))
        self.seen = materialised(self.seen.union(screened.select("paper_id")).distinct())
        counts = screened.agg(F.count_if("outcome.passed").alias("accepted"), F.count_if(~F.col("outcome.passed")).alias("rejected")).first()
        return StepResult(self.signal(ok.select("paper_id")), counts.asDict())

    def known(self, ids: DataFrame) -> DataFrame:
        return ids.join(self.corpus.papers, "paper_id")

    # -- steps ----------------------------------------------------------------------------------

    def _primaries(self) -> DataFrame:
        """(paper_id) of the seeds in the corpus, by id or by title."""
        ids = [(p.paper_id,) for p in self.settings.seed_papers if p.paper_id is not None]
        s = self.spark.createDataFrame(ids, f"paper_id {self.id_type}")
        titles = [(p.title,) for p in self.settings.seed_papers if p.paper_id is None and p.title]
        if titles:
            s = s.union(expand.resolve_titles(self.spark.createDataFrame(titles, "title string"), self.corpus.papers).select("paper_id"))
        return materialised(s.distinct().join(self.corpus.papers.select("paper_id"), "paper_id", "left_semi"))

    def _siblings(self, seeds: DataFrame) -> DataFrame:
        """(paper_id) of other versions of seeds: papers that share an external id, or a long title and an author; unknown authors do not speak against it."""
        p = self.corpus.papers
        out = self._empty(f"paper_id {self.id_type}")
        if "external_ids" in p.columns:
            keys = dedup.external_keys(p)
            out = out.union(keys.join(keys.join(seeds, "paper_id", "left_semi").select("key").distinct(), "key", "left_semi").select("paper_id"))
        t = p.where(F.char_length(F.trim("title")) >= SIBLING_TITLE).select("paper_id", normalize_title("title").alias("t")).where("t <> ''")
        mine = t.join(seeds, "paper_id", "left_semi").select(F.col("paper_id").alias("seed"), "t")
        pairs = materialised(t.join(mine, "t").where("paper_id <> seed").select("seed", "paper_id"))
        if self.corpus.authorship is not None:
            both = pairs.select("paper_id").union(pairs.select("seed")).distinct()
            known = self.corpus.authorship.where("author_id is not null").join(both, "paper_id", "left_semi").groupBy("paper_id").agg(F.collect_set("author_id").alias("authors"))
            pairs = pairs.join(known, "paper_id", "left").join(known.select(F.col("paper_id").alias("seed"), F.col("authors").alias("seed_authors")), "seed", "left")
            pairs = pairs.where("authors is null or seed_authors is null or arrays_overlap(authors, seed_authors)")
        return out.union(pairs.select("paper_id")).distinct()

    def resolve_seeds(self, signal: DataFrame, include_siblings: bool = False) -> StepResult:
        """What LoadSeeds will load; the signal goes through."""
        s = self._primaries()
        self.resolved = materialised(s.union(self._siblings(s)).distinct()) if include_siblings else s
        n, total = s.count(), self.resolved.count()
        return StepResult(signal, {"input_seeds": len(self.settings.seed_papers), "primaries_resolved": n, "siblings_added": total - n, "include_siblings": include_siblings})

    def load_seeds(self, signal: DataFrame) -> StepResult:
        s = self._primaries() if self.resolved is None else self.resolved
        s = materialised(s.join(self.collection, "paper_id", "left_anti"))
        new = s.select("paper_id", F.lit(0).alias("depth"), F.lit("seed").alias("source"), F.array().cast(f"array<{self.id_type}>").alias("supporting_papers"))
        self.collection = materialised(self.collection.union(new))
        self.seen = materialised(self.seen.union(s).distinct())
        return StepResult(self.signal(s), {"seeds": s.count()})

    def _claimed(self, claimed: DataFrame, source: str, screener: str | dict | None) -> StepResult:
        if screener is None:
            return StepResult(self.signal(self._empty(f"paper_id {self.id_type}")), {"reason": "no screener"})
        depth = self.collection.select(F.col("paper_id").alias("source"), (F.col("depth") + 1).alias("depth"))
        c = claimed.join(depth, "source", "left").withColumn("supporting_papers", F.array("source")).withColumnRenamed("cand", "paper_id").drop("source", "source_ord")
        return self.admit(self.screen(self.known(c), screener), source)

    def expand_forward(self, signal: DataFrame, max_citations: int = 100, screener: str | dict | None = None) -> StepResult:
        new = self._unexpanded(signal, "forward")
        top = expand.top_citers(new, self.corpus.edges, self.corpus.papers, max_citations)
        claimed = expand.with_source_sets(expand.claim(top, self.seen), top, self.corpus.edges)
        claimed = materialised(claimed)
        # only the candidates' own neighbours
        e, c = self.corpus.edges, claimed.select("cand").distinct()
        refs = e.withColumnRenamed("citing_id", "cand").join(c, "cand", "left_semi").groupBy("cand").agg(F.collect_set("cited_id").alias("references"))
        citers = e.withColumnRenamed("cited_id", "cand").join(c, "cand", "left_semi").groupBy("cand").agg(F.collect_set("citing_id").alias("citers"))
        return self._claimed(claimed.join(refs, "cand", "left").join(citers, "cand", "left"), "forward", screener)

    def expand_backward(self, signal: DataFrame, screener: str | dict | None = None) -> StepResult:
        new = self._unexpanded(signal, "backward")
        edges = fallback_edges(new, self.corpus.edges, self.corpus.more_edges) if self.corpus.more_edges else self.corpus.edges
        c = expand.expand_backward(new, edges, self.seen)
        none = F.lit(None).cast(f"array<{self.id_type}>")
        return self._claimed(c.withColumn("source_refs", none).withColumn("source_citers", none).withColumn("references", none).withColumn("citers", none), "backward", screener)

    def expand_by_pdf(self, signal: DataFrame, screener: str | dict | None = None, limit: int | None = None) -> StepResult:
        """Papers that the full texts of the signal cite in their lists: entries resolved by DOI or title, kept as quotes of the edge.

        Without texts, or without a list in them, nothing is found. An entry of a paper in the collection is a quote as well.
        """
        if self.corpus.texts is None:
            return StepResult(self.signal(self._empty(f"paper_id {self.id_type}")), {"reason": "no texts"})
        new = self._unexpanded(signal, "pdf")
        held = self.corpus.papers
        held = held.select("paper_id", "title", (F.try_element_at("external_ids", F.lit("DOI")) if "external_ids" in held.columns else F.lit(None).cast("string")).alias("doi"))
        found = acquire.found_references(self.corpus.texts.join(new, "paper_id", "left_semi"), limit)
        r = materialised(acquire.resolve_references(found, held).where("ref_id is not null and ref_id <> paper_id"))
        quotes = r.groupBy(F.col("paper_id").alias("citing_id"), F.col("ref_id").alias("cited_id")).agg(F.sort_array(F.collect_list(F.struct("pos", "entry", "by"))).alias("q"))
        quotes = quotes.select("citing_id", "cited_id", F.transform("q", lambda x: x["entry"]).alias("quotes"), F.transform("q", lambda x: x["by"]).alias("resolved_by"))
        self.quotes = materialised(self.quotes.union(quotes.join(self.quotes, ["citing_id", "cited_id"], "left_anti")))
        c = expand.expand_backward(new, r.select(F.col("paper_id").alias("citing_id"), F.col("ref_id").alias("cited_id")).distinct(), self.seen)
        none = F.lit(None).cast(f"array<{self.id_type}>")
        got = self._claimed(c.withColumn("source_refs", none).withColumn("source_citers", none).withColumn("references", none).withColumn("citers", none), "pdf", screener)
        got.stats |= {"entries": found.count(), "resolved": r.count()}
        return got

    def _unexpanded(self, signal: DataFrame, way: str) -> DataFrame:
        old = self.clusters.get(f"_{way}")
        new = materialised(signal if old is None else signal.join(old, "paper_id", "left_anti"))
        self.clusters[f"_{way}"] = materialised(new.select("paper_id") if old is None else old.union(new.select("paper_id")))
        return new

    def _sourceless(self, ids: DataFrame, source: str, screener: str | dict | None, signal: DataFrame) -> StepResult:
        if screener is None:
            return StepResult(signal, {"reason": "no screener"})
        none = F.lit(None).cast(f"array<{self.id_type}>")
        c = self.known(ids.distinct().join(self.seen, "paper_id", "left_anti"))
        for n in ("source_refs", "source_citers", "references", "citers"):
            c = c.withColumn(n, none)
        got = self.admit(self.screen(c, screener), source)
        return StepResult(self.signal(signal.select("paper_id").union(got.signal.select("paper_id")).distinct()), got.stats)

    def expand_by_search(self, signal: DataFrame, query: str = "", screener: str | dict | None = None, limit: int = 1000, year_min: int | None = None, year_max: int | None = None, min_citations: int | None = None, venue_regex: str | None = None, title_regex: str | None = None, abstract_regex: str | None = None, agent: dict | None = None, topic_description: str | None = None) -> StepResult:
        """What query finds in the corpus, or, with agent {model, max_iterations, ...}, what a model's queries on the topic find; local predicates hold for both.

        The signal's first papers are the agent's anchors. Without topic or hits the signal goes through.
        """
        local = {k: v for k, v in {"year_min": year_min, "year_max": year_max, "min_citations": min_citations, "venue_regex": venue_regex, "title_regex": title_regex, "abstract_regex": abstract_regex}.items() if v is not None}
        if agent is not None:
            return self._agent_search(signal, agent, topic_description or self.settings.topic_description, screener, local)
        p = self.corpus.papers.where(screening.search_predicate(query, F.concat_ws(" ", "title", "abstract") if "abstract" in self.corpus.papers.columns else F.col("title")))
        p = screening.local_query(p, **local)
        return self._sourceless(p.orderBy(F.desc(F.coalesce("citation_count", F.lit(0))), "paper_id").limit(limit).select("paper_id"), "search", screener, signal)

    def _agent_search(self, signal: DataFrame, agent: dict, topic: str, screener: str | dict | None, local: dict) -> StepResult:
        if screener is None:
            return StepResult(signal, {"reason": "no screener"})
        if not topic.strip():
            return StepResult(signal, {"reason": "no_topic_description"})
        how = search_agent.Agent(**{"model": self.settings.screening_model} | agent)

        def spend(asked: str) -> bool:
            if self.spent():
                return False
            self.requests += 1
            self.tokens += -(-len(asked) // 4)
            return True

        anchors = signal.orderBy("ord").limit(how.max_anchor_papers).select("paper_id").join(self.corpus.papers, "paper_id").select("paper_id", "title")
        found, turns = search_agent.refine(self.corpus.papers, anchors, topic, how, spend)
        about = {"agent_iterations": len(turns), "agent_paperids": found.count(), "anchor_count": anchors.count(), "turns": [vars(t) for t in turns]}
        if turns:
            about["last_query"] = turns[-1].query[:200]
        if not about["agent_paperids"]:
            return StepResult(signal, {"reason": "no_results", **about})
        ids = screening.local_query(self.known(found.select("paper_id")), **local).select("paper_id")
        got = self._sourceless(ids, "search", screener, signal)
        got.stats |= about
        return got

    def expand_by_semantics(self, signal: DataFrame, mode: str = "multi_anchor", max_anchor_papers: int = 10, limit: int = 100, screener: str | dict | None = None, use_rejected_as_negatives: bool = False) -> StepResult:
        v = self.corpus.vectors
        a = v.join(signal.orderBy("ord").limit(max_anchor_papers).select("paper_id"), "paper_id", "left_semi")
        # rejected papers steer away, the first NEGATIVES of them
        away = v.join(self.rejected.groupBy("paper_id").agg(F.min("seq").alias("seq")).orderBy("seq", "paper_id").limit(NEGATIVES).select("paper_id"), "paper_id", "left_semi") if use_rejected_as_negatives else None
        got = expand.recommend(a, away, v, limit) if mode == "multi_anchor" else expand.nearest(a, v, limit)
        return self._sourceless(got.select("paper_id"), "semantic", screener, signal)

    def expand_by_author(self, signal: DataFrame, top_k_authors: int = 10, papers_per_author: int = 100, screener: str | dict | None = None) -> StepResult:
        a = self.corpus.authorship
        metric = a.join(self.corpus.papers, "paper_id").groupBy("author_id").agg(F.sum(F.coalesce("citation_count", F.lit(0))).alias("score"))
        return self._sourceless(expand.expand_by_author(signal, a, metric, self.seen, top_k_authors, papers_per_author), "author", screener, signal)

    def rescreen(self, signal: DataFrame, screener: str | dict | None = None) -> StepResult:
        none = F.lit(None).cast(f"array<{self.id_type}>")
        c = self.known(self.collection.where("source <> 'seed'").select("paper_id"))
        for n in ("source_refs", "source_citers", "references", "citers"):
            c = c.withColumn(n, none)
        passed = self.screen(c, screener).where("outcome.passed").select("paper_id")
        kept, out = expand.rescreen(self.collection, self.collection.where("source = 'seed'"), passed)
        out = materialised(out)
        self.collection = materialised(kept)
        return StepResult(signal.join(out, "paper_id", "left_anti"), {"removed": out.count()})

    def rerank(self, signal: DataFrame, metric: str = "citation", k: int = 100, diversity: str | dict | None = None) -> StepResult:
        if metric == "citation":
            scores = self.corpus.papers.select("paper_id", F.coalesce("citation_count", F.lit(0)).alias("score"))
        elif metric == "pagerank":
            scores = pagerank(self.edges(), 50, tolerance=1e-9).select(F.col("id").alias("paper_id"), "score")
        else:
            raise ConfigError(f"unknown metric {metric!r}")
        if diversity is None:
            return StepResult(ranking.rerank(signal, scores, k).select("paper_id", F.row_number().over(W.orderBy(F.desc("score"), "ord")).alias("ord")))
        name = diversity["cluster"] if isinstance(diversity, dict) and "cluster" in diversity else None
        labels = self.clusters[name] if name else communities.cluster(diversity, self.edges(), self.corpus.vectors)
        s = signal.join(scores, "paper_id", "left").join(labels, "paper_id", "left").withColumn("cid", F.coalesce("cid", F.lit(-1)))
        return StepResult(self.signal(ranking.diverse_top_k(s, k).select("paper_id")))

    def cluster(self, signal: DataFrame, store_as: str = "clusters", algorithm: str | dict = "louvain", drop_noise: bool = False, naming: dict | None = None) -> StepResult:
        """naming {mode: tfidf or llm, model} gives clusters names, kept in `names`."""
        naming = {"mode": "tfidf", "model": "stub"} | naming if naming else None
        if naming and (set(naming) != {"mode", "model"} or naming["mode"] not in ("tfidf", "llm")):
            raise ConfigError(f"bad naming {naming!r}")
        labels = communities.cluster(algorithm, self.edges(), self.corpus.vectors)
        labels = materialised(signal.select("paper_id").join(labels, "paper_id", "left").select("paper_id", F.coalesce("cid", F.lit(-1)).alias("cid")))
        self.clusters[store_as] = labels
        if naming:
            texts = [F.col(c) for c in ("title", "abstract") if c in self.corpus.papers.columns]
            keywords = materialised(topics.ctfidf(labels.join(self.corpus.papers, "paper_id").select("cid", F.concat_ws(" ", *texts).alias("text"))))
            self.names[store_as] = materialised(topics.named(keywords, naming["model"] if naming["mode"] == "llm" else None))
        out = signal.join(labels.where("cid = -1"), "paper_id", "left_anti") if drop_noise else signal
        return StepResult(out, {"clusters": labels.where("cid <> -1").select("cid").distinct().count()})

    def merge_duplicates(self, signal: DataFrame, title_threshold: float = 0.95, semantic_threshold: float = 0.98, year_window: int = 1) -> StepResult:
        """Duplicates become one paper: in the collection, the signal, and the run's papers and edges."""
        p = dedup.with_normal_titles(self.known(self.collection.select("paper_id")))
        # the first author by position where that is known
        first = F.min_by("author_id", "position") if self.corpus.authorship is not None and "position" in self.corpus.authorship.columns else F.min("author_id")
        author = self.corpus.authorship.where("author_id is not null").groupBy("paper_id").agg(first.cast("string").alias("author")) if self.corpus.authorship is not None else p.select("paper_id", F.lit(None).cast("string").alias("author"))
        vec = self.corpus.vectors if self.corpus.vectors is not None else p.select("paper_id", F.lit(None).cast("array<float>").alias("embedding"))
        p = materialised(p.select("paper_id", "norm_title", *(c for c in ("year", "venue", "citation_count", "abstract", "external_ids") if c in p.columns)).join(author, "paper_id", "left").join(vec.select("paper_id", "embedding"), "paper_id", "left"))
        if "abstract" not in p.columns:
            p = p.withColumn("abstract", F.lit(None).cast("string"))
        keys = dedup.external_keys(p) if "external_ids" in p.columns else None
        pairs = dedup.duplicate_pairs(dedup.candidate_pairs(p, keys), p, title_threshold, semantic_threshold, year_window)
        best = materialised(dedup.pick_canonical(dedup.duplicate_clusters(pairs).join(p, "paper_id")))
        alias = materialised(best.where("paper_id <> canonical").select(F.col("paper_id").alias("alias"), "canonical"))
        n = alias.count()
        if not n:
            return StepResult(signal, {"merged": 0})
        self.alias = alias if self.alias is None else materialised(self._renamed(self.alias, "canonical", alias).union(alias))
        self._merge_corpus(best, alias)
        w = W.partitionBy("canonical")
        held = self.collection.join(alias.withColumnRenamed("alias", "paper_id"), "paper_id", "left")
        # the canonical paper stays as it came, but as a seed if any of its records was one; its supporters are those of all
        by = self._renamed(held.select("paper_id", F.coalesce("canonical", "paper_id").alias("of"), F.explode("supporting_papers").alias("sp")), "sp", alias)
        by = by.where("sp <> of").groupBy(F.col("of").alias("paper_id")).agg(F.array_sort(F.collect_set("sp")).alias("supporting_papers"))
        held = held.withColumn("canonical", F.coalesce("canonical", "paper_id")).withColumn("depth", F.min("depth").over(w)).withColumn("seed", F.max(F.col("source") == "seed").over(w))
        held = held.where("paper_id = canonical").select("paper_id", "depth", F.when(F.col("seed"), "seed").otherwise(F.col("source")).alias("source"))
        none = F.array().cast(f"array<{self.id_type}>")
        self.collection = materialised(held.join(by, "paper_id", "left").select("paper_id", "depth", "source", F.coalesce("supporting_papers", none).alias("supporting_papers")))
        return StepResult(dedup.rewrite_signal(signal, alias), {"merged": n})

    @staticmethod
    def _renamed(df: DataFrame, column: str, alias: DataFrame) -> DataFrame:
        """df with the ids of column replaced by their canonical ones."""
        a = alias.select(F.col("alias").alias(column), F.col("canonical").alias("_to"))
        return df.join(a, column, "left").withColumn(column, F.coalesce("_to", column)).select(df.columns)

    def _merge_corpus(self, best: DataFrame, alias: DataFrame) -> None:
        """The run's own corpus with merged records: canonical papers take what the others know, edges and authors the canonical ids."""
        c = self.corpus
        merged = dedup.merge_clusters(best.withColumn("references", F.array().cast(f"array<{self.id_type}>"))).drop("cluster", "references", "aliases", "n_aliases")
        filled = [x for x in merged.columns if x != "paper_id" and x in c.papers.columns]
        m = merged.select("paper_id", *(F.col(x).alias(f"_{x}") for x in filled))
        p = c.papers.join(alias.select(F.col("alias").alias("paper_id")), "paper_id", "left_anti").join(m, "paper_id", "left")
        # the largest count and, of other values, the first that is not blank in canonical order
        p = p.select(*(F.coalesce(f"_{x}", x).alias(x) if x in filled else F.col(x) for x in c.papers.columns))
        refs = dedup.rewrite_references(c.edges.select(F.col("citing_id").alias("paper_id"), F.col("cited_id").alias("ord"), F.col("cited_id").alias("ref")), alias)
        self.corpus = replace(self.renamed_corpus(alias), papers=materialised(p), edges=materialised(refs.select(F.col("paper_id").alias("citing_id"), F.col("ref").alias("cited_id"))))

    def renamed_corpus(self, alias: DataFrame) -> Corpus:
        """The run's corpus by canonical ids, fallbacks too: papers without aliases, one vector and one text a paper."""
        c = self.corpus
        ends = lambda e: materialised(self._renamed(self._renamed(e, "citing_id", alias), "cited_id", alias).where("citing_id <> cited_id").distinct())

        def one(t: DataFrame | None, value: str) -> DataFrame | None:
            # the canonical paper's own before those of its aliases
            if t is None:
                return None
            v = self._renamed(t.withColumn("_of", F.col("paper_id")), "paper_id", alias)
            first = F.struct(F.col(value).isNull(), F.col("_of") != F.col("paper_id"), "_of")
            return materialised(v.withColumn("_n", F.row_number().over(W.partitionBy("paper_id").orderBy(first))).where("_n = 1").select(t.columns))

        return replace(
            c, papers=materialised(c.papers.join(alias.select(F.col("alias").alias("paper_id")), "paper_id", "left_anti")), edges=ends(c.edges.select("citing_id", "cited_id")),
            vectors=one(c.vectors, "embedding"), texts=one(c.texts, "text"),
            authorship=None if c.authorship is None else materialised(self._renamed(c.authorship, "paper_id", alias).distinct()),
            more_papers=[(n, materialised(self._renamed(t, "paper_id", alias))) for n, t in c.more_papers], more_edges=[(n, ends(t.select("citing_id", "cited_id"))) for n, t in c.more_edges],
        )

    def parallel(self, signal: DataFrame, branches: list[list[dict]] | None = None) -> StepResult:
        out = []
        for b in branches or []:
            s = signal
            for step in b:
                r = self.step(step, s)
                s = r.signal
                if r.stop:
                    break
            out.append(materialised(s))
        return StepResult(self.signal(expand.parallel_union(out).select("paper_id")) if out else signal)

    def edges(self) -> DataFrame:
        e = self.corpus.edges
        if self.corpus.more_edges:
            e = fallback_edges(self.collection, e, self.corpus.more_edges)
        e = e.select("citing_id", "cited_id").union(self.quotes.select("citing_id", "cited_id")).distinct()
        refs = e.withColumnRenamed("citing_id", "paper_id").join(self.collection, "paper_id", "left_semi").groupBy("paper_id").agg(F.collect_list("cited_id").alias("references"))
        c = self.collection.join(refs, "paper_id", "left")
        return materialised(citation_edges(c))

    def human_in_the_loop(self, signal: DataFrame, enabled: bool = False, k: int = 20, seed: str = "0", include_accepted: bool = True, include_rejected: bool = True) -> StepResult:
        """A sample goes to the run's reviewer; how far models agree with the labels goes to a report. The signal stays.

        At most k papers are read in full. Without a reviewer the sample is written, and the report says that nothing was labelled.
        """
        if not enabled:
            return StepResult(signal, {"reason": "disabled"})
        no = self.rejected.groupBy("paper_id").agg(F.min_by("category", "seq").alias("category")).join(self.collection, "paper_id", "left_anti")
        yes = self.collection.where("source <> 'seed'").select("paper_id", F.lit(True).alias("accepted"), F.lit(None).cast("string").alias("category"))
        pool = no.select("paper_id", F.lit(False).alias("accepted"), "category").where(F.lit(include_rejected)).union(yes.where(F.lit(include_accepted)))
        sample = materialised(ranking.hitl_sample(pool, k, seed).join(self.corpus.papers.drop("accepted", "category"), "paper_id", "left"))
        if not (n := sample.count()):
            return StepResult(signal, {"reason": "no_candidates"})
        base = self.settings.data_dir
        sample.write.mode("overwrite").json(f"{base}/hitl_sample.json")
        labels, stop = self.review(sample) if self.review else (self._empty(f"paper_id {self.id_type}, keep boolean"), False)
        labels = materialised(labels.where("keep is not null").join(sample.select("paper_id"), "paper_id", "left_semi").groupBy("paper_id").agg(F.max("keep").alias("keep")))
        judged = self._empty(f"paper_id {self.id_type}, filter string, accepted boolean, seq int")
        for j in self.judged:
            judged = judged.union(j)
        judged = judged.join(labels, "paper_id", "left_semi").groupBy("filter", "paper_id").agg(F.max_by("accepted", "seq").alias("accepted"))
        agreed = history.agreement(judged, labels).orderBy("filter").collect()  # one row a filter
        report = {
            "candidates": n, "labels_collected": labels.count(), "stop_requested": bool(stop), "agreement_by_filter": {r["filter"]: r["agreement"] for r in agreed},
            "low_agreement_filters": [r["filter"] for r in agreed if r["low"]], "config": {"k": k, "seed": seed, "include_accepted": include_accepted, "include_rejected": include_rejected},
        }
        self._text(json.dumps(report), "hitl_report.json")
        return StepResult(signal, {x: report[x] for x in ("candidates", "labels_collected", "low_agreement_filters", "stop_requested")}, stop=bool(stop))

    def _text(self, text: str, name: str) -> None:
        self.spark.createDataFrame([(text,)], "line string").coalesce(1).write.mode("overwrite").text(f"{self.settings.data_dir}/{name}")

    def _author_graph(self, papers: DataFrame) -> None:
        a = papers.select("paper_id", *(F.col(c) if c in papers.columns else F.lit(None).cast("long").alias(c) for c in ("year", "citation_count"))).join(self.corpus.authorship.where("author_id is not null"), "paper_id")
        held = materialised(a.select("paper_id", "year", "citation_count", F.col("author_id").alias("author")).distinct())
        pairs = materialised(collaboration(held))
        # further columns of the authorship table describe the author
        more = [c for c in a.columns if c not in ("paper_id", "year", "citation_count", "author_id", "position")]
        v = author_stats(held).withColumnRenamed("author", "id").join(degrees(pairs), "id", "left").withColumn("degree", F.coalesce("degree", F.lit(0)))
        if more:
            v = v.join(a.groupBy(F.col("author_id").alias("id")).agg(*(F.min(c).alias(f"author_{c}") for c in more)), "id", "left")
        e = pairs.select(F.col("a").alias("src"), F.col("b").alias("dst"), "strength", "first_year", "last_year", "duration", F.col("n_papers").alias("n_collaborations"))
        output.write_graphml(v, e, f"{self.settings.data_dir}/collaboration_network.graphml", directed=False)

    def finalize(self, signal: DataFrame) -> StepResult:
        base = self.settings.data_dir
        papers = self.collection.join(self.corpus.papers, "paper_id", "left")
        if self.corpus.more_papers:
            papers = materialised(fill_fields(papers, self.corpus.more_papers, [c for c in FILLED if c in papers.columns or any(c in t.columns for _, t in self.corpus.more_papers)]))
        if self.corpus.more_edges:
            # where each paper's references come from, the run's own edges first
            fallback_edges(self.collection, self.corpus.edges, self.corpus.more_edges).groupBy("citing_id", "found_in").agg(F.count(F.lit(1)).alias("n")).write.mode("overwrite").json(f"{base}/reference_sources")
        if self.corpus.texts is not None:
            self.quotes.write.mode("overwrite").json(f"{base}/quotes")
        output.write_collection(papers, base)
        output.bibtex(output.by_citations(papers)).select("entry").write.mode("overwrite").text(f"{base}/collection.bib")
        e = self.edges()
        if self.collection.count() >= 2:
            attrs = [c for c in ("title", "year", "venue", "citation_count", "depth", "source") if c in papers.columns]
            e = edge_weights(edge_similarities(e))
            if self.corpus.vectors is not None:
                e = semantic_similarities(e, self.corpus.vectors)
            output.write_graphml(papers.select(F.col("paper_id").alias("id"), *attrs), e, f"{base}/citation_network.graphml")
        if self.corpus.authorship is not None:
            self._author_graph(papers)
        self.rejected.write.mode("overwrite").parquet(f"{base}/rejections")
        about = self.corpus.papers.select("paper_id", *(F.col(c) if c in self.corpus.papers.columns else F.lit(None).cast(t).alias(c) for c, t in (("title", "string"), ("year", "int"))))
        history.rejection_ledger(self.rejected, about).write.mode("overwrite").json(f"{base}/rejected_papers.json")
        for name, labels in self.names.items():
            labels.write.mode("overwrite").json(f"{base}/clusters_{name}.json")
        self._text(json.dumps(self.shape), "shape_summary.json")
        self._text(shape_text(self.shape), "shape_summary.txt")
        state = output.run_state(self.iteration, [str(p.paper_id) for p in self.settings.seed_papers], self.settings.start_from or None, {"max_tokens": self.settings.max_tokens, "used_tokens": self.tokens, "max_requests": self.settings.max_requests, "used_requests": self.requests})
        self.spark.createDataFrame([(state,), (json.dumps(self.shape),)], "line string").write.mode("overwrite").text(f"{base}/run_state")
        return StepResult(self.signal(self._empty(f"paper_id {self.id_type}")), stop=True)

    STEPS = {
        "LoadSeeds": load_seeds, "ResolveSeeds": resolve_seeds, "ExpandForward": expand_forward, "ExpandBackward": expand_backward, "ExpandBySearch": expand_by_search, "ExpandBySemantics": expand_by_semantics,
        "ExpandByAuthor": expand_by_author, "ExpandByPDF": expand_by_pdf, "ReScreen": rescreen, "Rerank": rerank, "Cluster": cluster, "MergeDuplicates": merge_duplicates, "Parallel": parallel,
        "HumanInTheLoop": human_in_the_loop, "Finalize": finalize,
    }

    def _searched(self, name: str, spec: dict, signal: DataFrame) -> StepResult | None:
        """The result of a search that the run has made before on the same papers with the same options; None the first time."""
        if name not in ONCE:
            return None
        digest = expand.fingerprint(signal, name, json.dumps(spec, sort_keys=True, default=str)).first()[0]
        if digest not in self.done:
            self.done.add(digest)
            return None
        return StepResult(signal if ONCE[name] else self.signal(self._empty(f"paper_id {self.id_type}")), {"reason": "already_searched", "fingerprint": digest[:12]})

    def step(self, spec: dict, signal: DataFrame) -> StepResult:
        spec = dict(spec)
        name = spec.pop("step", None)
        check_step({"step": name, **spec})
        before, n_in = self.collection.count(), signal.count()
        self.emit("step_start", name=name)
        r = self._searched(name, spec, signal) or self.STEPS[name](self, signal, **spec)
        r.signal = materialised(r.signal)
        self.shape.append({"step": name, "in": n_in, "out": r.signal.count(), "delta": self.collection.count() - before, "stats": r.stats})
        self.emit("step_end", name=name, **{k: v for k, v in self.shape[-1].items() if k != "step"})
        return r


#: Searches of one signal that are not repeated in a run, and whether a repeated one hands its signal on.
ONCE = {"ExpandBySearch": True, "ExpandBySemantics": True, "ExpandByAuthor": False, "ExpandByPDF": False}


def check_step(spec: dict) -> None:
    """Refuses unknown steps and options that a step does not have."""
    name = spec.get("step")
    if name not in Run.STEPS:
        raise ConfigError(f"unknown step {name!r}")
    has = set(inspect.signature(Run.STEPS[name]).parameters) - {"self", "signal"}
    if odd := sorted(set(spec) - has - {"step"}):
        raise ConfigError(f"step {name} has no option {', '.join(odd)}")
    if odd := sorted(set(spec.get("agent") or {}) - set(search_agent.Agent.__dataclass_fields__)):
        raise ConfigError(f"the agent of step {name} has no option {', '.join(odd)}")
    for branch in spec.get("branches") or []:
        for s in branch:
            check_step(s)


def rewritten(steps: list[dict]) -> list[dict]:
    """Seeds are loaded first and duplicates merged before the end, whether or not the configuration says so."""
    steps = list(steps)
    first = 1 if steps and steps[0].get("step") == "ResolveSeeds" else 0
    if len(steps) == first or steps[first].get("step") != "LoadSeeds":
        steps.insert(first, {"step": "LoadSeeds"})
    if not any(s.get("step") == "MergeDuplicates" for s in steps):
        at = next((i for i, s in enumerate(steps) if s.get("step") == "Finalize"), len(steps))
        steps.insert(at, {"step": "MergeDuplicates"})
    if steps[-1].get("step") != "Finalize":
        steps.append({"step": "Finalize"})
    return steps


def run_pipeline(spark: SparkSession, settings: Settings, corpus: Corpus, review: Review | None = None) -> Run:
    """All steps in turn. Beyond max_papers, max_tokens or max_requests, or if a step fails or an outage ends it, what there is gets finalised.

    Tokens are counted as verdicts.tokens_of estimates them, before a model is asked. With settings.state_dir the run's
    state is kept after each step, and a run with the same beginning goes on behind the last step that was kept; with
    settings.start_from it begins with what an earlier run, whatever its steps, has found and seen.
    """
    steps = rewritten(settings.pipeline)
    for s in steps:
        check_step(s)
    run = Run(spark, settings, corpus, review)
    if settings.start_from:
        continue_from(run, settings.start_from)
    signal = run._empty(f"paper_id {run.id_type}, ord int")
    states = digests = None
    done, ended = 0, False
    if settings.state_dir:
        states, digests = States(spark, settings.state_dir), chain(run, steps[:-1])
        for i in reversed(range(len(digests))):
            if old := states.load(digests[i]):
                signal, done, ended = states.restore(run, old), i + 1, old["ended"]
                run.emit("resumed", after=steps[i]["step"], steps=done)
                break
    try:
        for i, spec in enumerate(steps[:-1]):
            if ended:
                break
            if i < done:
                continue
            try:
                r = run.step(spec, signal)
            except BudgetSpent as e:
                run.emit("budget_spent", reason=str(e))
                break
            signal = r.signal
            ended = bool(r.stop or run.spent() or run.collection.count() >= settings.max_papers)
            if states:
                states.save(digests[i], run, signal, ended)
    finally:
        run.step(steps[-1], signal)
    return run


def shape_text(shape: list[dict]) -> str:
    """The steps as a table of text: signal in and out, change of the collection, the first 80 characters of the notes."""
    rows = [("step", "in", "out", "delta", "notes")] + [(s["step"], str(s["in"]), str(s["out"]), f"{s['delta']:+d}", json.dumps(s["stats"])[:80]) for s in shape]
    width = [max(len(r[i]) for r in rows) for i in range(4)]
    return "\n".join("  ".join([r[0].ljust(width[0]), *(r[i].rjust(width[i]) for i in (1, 2, 3)), r[4]]).rstrip() for r in rows)


def shape_table(run: Run) -> DataFrame:
    """One row a step: signal in and out, change of the collection, notes."""
    rows = [(i, s["step"], s["in"], s["out"], s["delta"], json.dumps(s["stats"])[:80]) for i, s in enumerate(run.shape)]
    return run.spark.createDataFrame(rows, "pos int, step string, n_in long, n_out long, delta long, notes string")


