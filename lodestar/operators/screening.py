"""Screeners: a tree of predicates compiled to one outcome column.

An outcome is struct<passed boolean, reason string, category string>. Everything but model verdicts is
an expression of Catalyst's; verdict columns are joined in by `operators.verdicts` beforehand.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import normalize_venue
from ..functions.vectors import cosine, overlap_coefficient
from ..functions.venues import VENUE_PRESETS
from .formula import Formula

def _passed() -> Column:
    return F.struct(F.lit(True).alias("passed"), F.lit("").alias("reason"), F.lit("").alias("category"))


def _rejected(reason: str | Column, category: str | Column) -> Column:
    lit = lambda x: F.lit(x) if isinstance(x, str) else x
    return F.struct(F.lit(False).alias("passed"), lit(reason).alias("reason"), lit(category).alias("category"))


def _when(ok: Column, reason: str, category: str) -> Column:
    return F.when(F.coalesce(ok, F.lit(False)), _passed()).otherwise(_rejected(reason, category))


class Block:
    """A node of a screener."""

    name = "block"

    def outcome(self) -> Column:
        raise NotImplementedError

    def passes(self) -> Column:
        return self.outcome()["passed"]

    def columns(self) -> set[str]:
        """Columns that the caller must supply beside those of papers."""
        return set()


@dataclass
class YearFilter(Block):
    """Years from low to high; a paper without year is rejected."""

    low: int | None = None
    high: int | None = None
    name: str = "year"

    def outcome(self) -> Column:
        y = F.col("year")
        ok = y.isNotNull()
        if self.low is not None:
            ok &= y >= self.low
        if self.high is not None:
            ok &= y <= self.high
        return _when(ok, "year outside the range", "year")


@dataclass
class CitationFilter(Block):
    """beta citations for each year of age (one at least), with an exemption of recent years.

    A paper without year counts as reference_year years old; one without count is rejected as missing_data.
    """

    reference_year: int
    beta: float = 5.0
    exemption_years: int = 0
    name: str = "citation"

    def outcome(self) -> Column:
        y, n = F.col("year"), F.col("citation_count")
        age = F.greatest(F.lit(self.reference_year) - F.coalesce(y, F.lit(0)), F.lit(1))
        enough = F.when(n.isNull(), _rejected("missing citation count", "missing_data")).when(n >= age * F.lit(float(self.beta)), _passed()).otherwise(_rejected("too few citations for its age", "citation"))
        if self.exemption_years < 0:
            return enough
        return F.when(y.isNotNull() & (y >= self.reference_year - self.exemption_years), _passed()).otherwise(enough)


def keyword_match(text: Column, keyword: str, match: str = "substring", case_sensitive: bool = False) -> Column:
    """Whether a keyword is in a text (null: empty, which matches nothing)."""
    t = F.coalesce(text, F.lit(""))
    if match == "substring":
        hit = t.contains(keyword) if case_sensitive else F.lower(t).contains(keyword.lower())
    elif match in ("whole_word", "starts_with"):
        quoted = "\\Q" + keyword.replace("\\E", "\\E\\\\E\\Q") + "\\E"
        head = "\\A" if match == "starts_with" else "(?<![\\p{L}\\p{N}_])"
        hit = (F.ltrim(t) if match == "starts_with" else t).rlike(("" if case_sensitive else "(?iu)") + head + quoted + "(?![\\p{L}\\p{N}_])")
    else:
        raise ValueError(f"unknown match {match!r}")
    return hit & (t != "") if keyword else F.lit(False)


@dataclass
class KeywordFilter(Block):
    """One keyword, or a formula over named keywords, on title, abstract or venue."""

    on: str = "title"
    keyword: str | None = None
    formula: str | None = None
    keywords: dict[str, str] = field(default_factory=dict)
    match: str = "substring"
    case_sensitive: bool = False
    name: str = "keyword"

    def __post_init__(self) -> None:
        if (self.keyword is None) == (self.formula is None):
            raise ValueError("give either a keyword or a formula")
        if self.formula is not None and (missing := Formula(self.formula).names() - set(self.keywords)):
            raise ValueError(f"the formula names unknown keywords: {sorted(missing)}")

    def outcome(self) -> Column:
        hit = lambda k: keyword_match(F.col(self.on), k, self.match, self.case_sensitive)
        ok = hit(self.keyword) if self.keyword is not None else Formula(self.formula).compile({n: hit(k) for n, k in self.keywords.items()})
        return _when(ok, f"{self.on} does not match", f"{self.on}_keyword")


@dataclass
class VenueIn(Block):
    """Any value as a part of the venue, in any case; empty values are ignored."""

    values: tuple[str, ...]
    name: str = "venue_in"

    def outcome(self) -> Column:
        v = F.lower(F.coalesce(F.col("venue"), F.lit("")))
        return _when(reduce(lambda a, b: a | b, (v.contains(x.lower()) for x in self.values if x), F.lit(False)), "venue not listed", self.name)


@dataclass
class VenuePreset(Block):
    """Venues of the named lists, exactly."""

    presets: tuple[str, ...]
    lists: dict[str, tuple[str, ...]] = field(default_factory=lambda: VENUE_PRESETS)
    name: str = "venue_preset"

    def __post_init__(self) -> None:
        if unknown := set(self.presets) - set(self.lists):
            raise ValueError(f"unknown presets: {sorted(unknown)}")

    def outcome(self) -> Column:
        return _when(normalize_venue("venue").isin(sorted({" ".join(v.lower().split()) for p in self.presets for v in self.lists[p]})), "venue not in the presets", self.name)


@dataclass
class CitAtLeast(Block):
    n: int
    name: str = "cit_at_least"

    def outcome(self) -> Column:
        return _when(F.coalesce(F.col("citation_count"), F.lit(0)) >= self.n, "too few citations", self.name)


@dataclass
class YearAtLeast(Block):
    n: int
    name: str = "year_at_least"

    def outcome(self) -> Column:
        return _when(F.coalesce(F.col("year"), F.lit(0)) >= self.n, "too old", self.name)


@dataclass
class Verdict(Block):
    """A boolean column that a model's votes made beforehand (null: rejected)."""

    column: str
    name: str = "llm"

    def outcome(self) -> Column:
        return _when(F.col(self.column), "rejected by the model", f"llm_{self.name}")

    def columns(self) -> set[str]:
        return {self.column}


@dataclass
class Sequential(Block):
    """All layers in turn; the first that fails says why. No layer: everything passes."""

    layers: list[Block]
    name: str = "sequential"

    def outcome(self) -> Column:
        out = _passed()
        for layer in reversed(self.layers):
            mine = layer.outcome()
            out = F.when(mine["passed"], out).otherwise(mine)
        return out

    def passes(self) -> Column:
        return reduce(lambda a, b: a & b, (x.passes() for x in self.layers), F.lit(True))

    def columns(self) -> set[str]:
        return set().union(*(x.columns() for x in self.layers))


@dataclass
class AnyOf(Block):
    """One layer at least; if all fail, the last says why. No layer: everything is rejected."""

    layers: list[Block]
    name: str = "any"

    def outcome(self) -> Column:
        if not self.layers:
            return _rejected("no layer", "any")
        some = reduce(lambda a, b: a | b, (x.passes() for x in self.layers))
        return F.when(some, _passed()).otherwise(self.layers[-1].outcome())

    def columns(self) -> set[str]:
        return set().union(*(x.columns() for x in self.layers))


@dataclass
class Not(Block):
    layer: Block

    def __post_init__(self) -> None:
        self.name = f"not_{self.layer.name}"

    def outcome(self) -> Column:
        return _when(~self.layer.passes(), f"passed {self.layer.name}", self.name)

    def columns(self) -> set[str]:
        return self.layer.columns()


@dataclass
class Route(Block):
    """The target of the first case whose predicate holds, else the default, else a rejection."""

    cases: list[tuple[Block, Block]]
    default: Block | None = None
    name: str = "route"

    def outcome(self) -> Column:
        out = self.default.outcome() if self.default else _rejected("no case matched", "no_route_match")
        for test, target in reversed(self.cases):
            out = F.when(test.passes(), target.outcome()).otherwise(out)
        return out

    def columns(self) -> set[str]:
        return set().union(*(x.columns() for c in self.cases for x in c), self.default.columns() if self.default else set())


# -- measures between a candidate and its source ------------------------------------------------

@dataclass
class RefSim:
    """Overlap coefficient of the reference sets of source and candidate."""

    source: str = "source_refs"
    own: str = "references"

    def score(self) -> Column:
        return overlap_coefficient(F.col(self.source), F.col(self.own))


@dataclass
class CitSim:
    """Overlap coefficient of the citer sets; 1 at once for a candidate that is cited often enough."""

    pass_if_cited_at_least: int = 10**9
    source: str = "source_citers"
    own: str = "citers"

    def score(self) -> Column:
        return F.when(F.col("citation_count") >= self.pass_if_cited_at_least, F.lit(1.0)).otherwise(overlap_coefficient(F.col(self.source), F.col(self.own)))


@dataclass
class SemanticSim:
    """Cosine of the embeddings, not below 0."""

    source: str = "source_embedding"
    own: str = "embedding"

    def score(self) -> Column:
        c = cosine(F.col(self.source), F.col(self.own))
        return F.when(c.isNotNull(), F.greatest(c, F.lit(0.0)))


@dataclass
class SimilarityFilter(Block):
    """The largest known score must reach the threshold; without any the choice is on_no_data."""

    measures: list
    threshold: float = 0.10
    on_no_data: str = "pass"
    name: str = "similarity"

    def score(self) -> Column:
        scores = [m.score() for m in self.measures]
        return F.greatest(*scores) if len(scores) > 1 else scores[0]

    def outcome(self) -> Column:
        s = self.score()
        none = _passed() if self.on_no_data == "pass" else _rejected("no similarity data", "similarity_no_data")
        return F.when(s.isNull(), none).when(s >= self.threshold, _passed()).otherwise(_rejected("not similar enough", "similarity"))

    def columns(self) -> set[str]:
        return {c for m in self.measures for c in (m.source, m.own)}


# -- application --------------------------------------------------------------------------------

def screen(papers: DataFrame, block: Block, into: str = "outcome") -> DataFrame:
    """papers with the block's outcome."""
    return papers.withColumn(into, block.outcome())


def rejections(screened: DataFrame, outcome: str = "outcome") -> DataFrame:
    """(paper_id, category) of what was rejected; an empty category is `unknown`."""
    c = F.col(outcome)["category"]
    return screened.where(~F.col(outcome)["passed"]).select("paper_id", F.when(F.coalesce(c, F.lit("")) == "", "unknown").otherwise(c).alias("category"))


def local_query(papers: DataFrame, venue_regex: str | None = None, year_min: int | None = None, year_max: int | None = None, min_citations: int | None = None, fields_any: list[str] | None = None, types_any: list[str] | None = None, abstract_regex: str | None = None, title_regex: str | None = None) -> DataFrame:
    """All given predicates hold. A missing value rejects, except a missing abstract; an empty list of wanted values rejects all."""
    ok: list[Column] = []
    search = lambda c, r: F.col(c).rlike(f"(?iu){r}")
    if year_min is not None:
        ok.append(F.col("year") >= year_min)
    if year_max is not None:
        ok.append(F.col("year") <= year_max)
    if min_citations is not None:
        ok.append(F.col("citation_count") >= min_citations)
    if venue_regex:
        ok.append((F.col("venue") != "") & search("venue", venue_regex))
    if title_regex:
        ok.append(search("title", title_regex))
    if abstract_regex:
        ok.append(F.col("abstract").isNull() | search("abstract", abstract_regex))
    for name, wanted in (("fields_of_study", fields_any), ("publication_types", types_any)):
        if wanted is not None:
            ok.append(F.arrays_overlap(F.col(name), F.array(*map(F.lit, wanted))) if wanted else F.lit(False))
    return papers.where(reduce(lambda a, b: a & b, ok, F.lit(True)))


#: Search syntax of the bulk search: terms, "phrases", |, -term, term*, ( ).
_SEARCH = re.compile(r'\s*(?:"([^"]*)"|([|()+-])|([^\s|()"]+))')
SORT_FIELDS = ("paperId", "publicationDate", "citationCount")


def search_predicate(query: str, text: Column) -> Column:
    """Boolean text search over lower-cased words: a blank is AND, | is OR, - is NOT, a final * a prefix."""
    tokens = [(m.group(1), m.group(2), m.group(3)) for m in _SEARCH.finditer(query.strip())]
    at = 0
    t = F.lower(F.coalesce(text, F.lit("")))

    def word(w: str, phrase: bool) -> Column:
        prefix = not phrase and w.endswith("*")
        quoted = re.escape(w.rstrip("*").lower() if prefix else w.lower())
        return t.rlike(r"(?<![\p{L}\p{N}_])" + quoted + ("" if prefix else r"(?![\p{L}\p{N}_])"))

    def either() -> Column:
        nonlocal at
        out = both()
        while at < len(tokens) and tokens[at][1] == "|":
            at += 1
            out = out | both()
        return out

    def both() -> Column:
        nonlocal at
        out: Column | None = None
        while at < len(tokens) and tokens[at][1] not in ("|", ")"):
            nxt = one()
            out = nxt if out is None else out & nxt
        return F.lit(True) if out is None else out

    def one() -> Column:
        nonlocal at
        phrase, sign, w = tokens[at]
        at += 1
        if sign == "-":
            return ~one() if at < len(tokens) else F.lit(True)
        if sign == "+":
            return one() if at < len(tokens) else F.lit(True)
        if sign == "(":
            inner = either()
            if at < len(tokens) and tokens[at][1] == ")":
                at += 1
            return inner
        return word(phrase if phrase is not None else w, phrase is not None)

    return either() if tokens else F.lit(True)


def sanitize_sort(sort: str | None) -> tuple[str, bool] | None:
    """(field, descending) of a sort clause; an unknown field is none, an unknown direction ascending."""
    if not sort:
        return None
    name, _, way = sort.partition(":")
    return (name, way.strip().lower() == "desc") if name.strip() in SORT_FIELDS else None
