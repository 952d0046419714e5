"""Model verdicts: prompts' contents, batching, votes, tolerant parsing, and a memo of replies.

A model is a function from a list of items to a reply; the offline stub accepts everything. Network
adapters are not part of this library: register one with `register_model`.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .fixpoint import materialised
from .formula import Formula

#: What a model is told and the form of its reply.
SYSTEM = "You screen papers. Decide for each numbered item whether it matches the criterion."
SCHEMA = {"type": "object", "properties": {"results": {"type": "array", "items": {"type": "object", "properties": {"index": {"type": "integer"}, "match": {"type": "boolean"}}, "required": ["index", "match"]}}}, "required": ["results"]}

Model = Callable[[str, str, int], str]
_models: dict[str, Callable[[], Model]] = {}


def register_model(name: str, make: Callable[[], Model]) -> None:
    """make travels to the Python workers and is called there; it returns reply = model(system, user, vote)."""
    _models[name] = make


def maker(name: str) -> Callable[[], Model]:
    """What makes the model: looked up on the driver, as workers know no registrations."""
    if name not in _models:
        raise ValueError(f"no model {name!r} is registered")
    return _models[name]


def stub_reply(system: str, user: str, vote: int) -> str:
    """The offline answer to each kind of question, told by the field that its instruction asks for: names, labels, a query of the topic's words, matches."""
    if '"topic_label"' in system:
        return json.dumps({"results": [{"cluster_id": int(c), "topic_label": "stub-topic", "summary": "stub summary"} for c in re.findall(r"(?m)^cluster (-?\d+):", user)]})
    if '"label"' in system:
        titles = re.findall(r"(?m)^Paper index=(\d+)\nTitle: (.*)$", user)
        return json.dumps({"results": [{"index": int(i), "label": " ".join(t.split()[:2])[:30] or "stub"} for i, t in titles]})
    if '"query"' in system:
        topic = re.search(r"Topic: (.*)", user)
        return json.dumps({"query": " OR ".join(dict.fromkeys(re.findall(r"\w{3,}", topic[1].lower()))) if topic else ""})
    return json.dumps({"results": [{"index": int(i), "match": True} for i in re.findall(r"(?m)^\[(\d+)\]", user)]})


def _stub() -> Model:
    return stub_reply


register_model("stub", _stub)


def content(scope: str) -> Column:
    """What of a paper a model sees; a full text that is missing falls back on title and abstract."""
    title, abstract = F.coalesce("title", F.lit("")), F.coalesce(F.nullif(F.col("abstract"), F.lit("")), F.lit("(no abstract)"))
    both = F.concat(F.lit("Title: "), title, F.lit("\nAbstract: "), abstract)
    if scope == "title":
        return title
    if scope == "venue":
        return F.coalesce("venue", F.lit(""))
    if scope == "title_abstract":
        return both
    if scope == "full_text":
        return F.coalesce(F.nullif(F.col("full_text"), F.lit("")), both)
    raise ValueError(f"unknown scope {scope!r}")


def parse_matches(raw: str | None, n: int) -> list[bool] | None:
    """n booleans from a reply, wrapped or bare, fenced or not; what is missing is false, what cannot be read is None."""
    text = (raw or "").strip()
    fenced = re.search(r"```(?:json)?\s*(.*?)```", text, re.DOTALL)
    try:
        data = json.loads(fenced.group(1) if fenced else text)
    except ValueError:
        return None
    if isinstance(data, dict):
        data = data.get("results")
    if not isinstance(data, list):
        return None
    out = [False] * n
    for x in data:
        if isinstance(x, dict) and isinstance(x.get("match"), bool) and isinstance(x.get("index"), (int, float)) and 1 <= int(x["index"]) <= n:
            out[int(x["index"]) - 1] = x["match"]
    return out


def parsed_matches(reply: Column | str) -> Column:
    """Map from item to verdict of a well-formed reply, as a Column; null if it cannot be read."""
    from ..functions.text import strip_fences

    t = strip_fences(reply)
    bare = F.from_json(t, "array<struct<index:int,match:boolean>>")
    wrapped = F.from_json(t, "struct<results:array<struct<index:int,match:boolean>>>")["results"]
    rows = F.when(F.left(t, F.lit(1)) == "[", bare).otherwise(wrapped)
    good = F.filter(rows, lambda r: r["index"].isNotNull() & r["match"].isNotNull())
    return F.map_from_entries(F.transform(good, lambda r: F.struct(r["index"], r["match"])))


def cache_key(model: str, system: str, user: str) -> str:
    return hashlib.sha256(json.dumps([model, system, user], ensure_ascii=False).encode()).hexdigest()


def _ask(model: str, criterion: str, votes: int, batch: int):
    make = maker(model)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        call = make()
        for f in frames:
            rows = []
            for i in range(0, len(f), batch):
                part = f.iloc[i : i + batch]
                user = f"Criterion: {criterion}\n\n" + "\n\n".join(f"[{k}] {c}" for k, c in enumerate(part["content"], 1))
                for v in range(votes):
                    try:
                        got = parse_matches(call(SYSTEM, user, v), len(part))
                    except Exception:  # a failed call is a vote against, and not remembered
                        got = None
                    rows += [(key, v, m) for key, m in zip(part["key"], got or [None] * len(part))]
            yield pd.DataFrame(rows, columns=["key", "vote", "match"], dtype=object)

    return run


def _items(papers: DataFrame, scope: str) -> tuple[DataFrame, DataFrame]:
    """(papers with content and key, the distinct contents that are asked about)."""
    p = papers.withColumn("content", content(scope)).select("paper_id", "content").withColumn("key", F.sha2(F.col("content").cast("binary"), 256))
    return p, p.where("trim(content) <> ''").select("key", "content").dropDuplicates(["key"])


def tokens_of(papers: DataFrame, criteria: list[str], scope: str = "title_abstract", votes: int = 1, batch: int = 20, memo: str | None = None, model: str = "stub") -> int:
    """Tokens, about, that verdicts on these criteria send: models here report none, so four characters count as one.

    Contents once per criterion and vote, and instructions once per prompt; a partition's last prompt may
    be shorter than batch, so this is a lower estimate. What the memo answers is not sent. One row of sums
    reaches the driver.
    """
    _, items = _items(papers, scope)
    total = 0
    for c in criteria:
        asked = items if memo is None else _recalled(items, memo, cache_key(model, SYSTEM, c), max(1, votes))[1]
        n, size = asked.agg(F.count(F.lit(1)), F.sum(F.ceil(F.length("content") / 4))).first()
        prompts = -(-n // (1 if scope == "full_text" else batch))
        total += max(1, votes) * ((size or 0) + prompts * -(-len(SYSTEM + c) // 4))
    return total


_REPLIES = "key string, vote int, match boolean"


def _recalled(items: DataFrame, memo: str, question: str, votes: int) -> tuple[DataFrame, DataFrame]:
    """(stored replies to the question, items that lack some); a memo that is not there yet is empty."""
    try:
        stored = items.sparkSession.read.schema(f"question string, {_REPLIES}").parquet(memo)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return items.sparkSession.createDataFrame([], _REPLIES), items
    known = stored.where((F.col("question") == question) & (F.col("vote") < votes)).join(items.select("key"), "key", "left_semi").select("key", "vote", "match").dropDuplicates(["key", "vote"])
    full = known.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= votes).select("key")
    return known.join(full, "key", "left_semi"), items.join(full, "key", "left_anti")


def verdicts(papers: DataFrame, criterion: str, scope: str = "title_abstract", votes: int = 1, min_accepts: int = 1, model: str = "stub", batch: int = 20, memo: str | None = None) -> DataFrame:
    """(paper_id, accepts, verdict): accepted with min_accepts of the votes or more.

    Equal contents are asked about once (venues above all); empty contents are rejected without asking.
    Full texts go one by one. Papers go through Arrow batches, so no prompt is built on the driver.
    With a memo (a folder of Parquet) only contents without stored replies of this model to this criterion
    are asked about, at once, and their replies appended.
    """
    p, items = _items(papers, scope)
    ask = _ask(model, criterion, max(1, votes), 1 if scope == "full_text" else batch)
    if memo is None:
        replies = items.mapInPandas(ask, _REPLIES)
    else:
        question = cache_key(model, SYSTEM, criterion)
        known, missing = _recalled(items, memo, question, max(1, votes))
        known, new = materialised(known), materialised(missing.mapInPandas(ask, _REPLIES))
        new.where("match is not null").select(F.lit(question).alias("question"), "key", "vote", "match").write.mode("append").parquet(memo)
        replies = known.union(new)
    tally = replies.groupBy("key").agg(F.sum(F.col("match").cast("int")).alias("accepts"))
    n = F.coalesce("accepts", F.lit(0)).cast("long")
    return p.join(tally, "key", "left").select("paper_id", n.alias("accepts"), (n >= min_accepts).alias("verdict"))


def formula_verdicts(papers: DataFrame, formula: str, queries: dict[str, str], **how: object) -> DataFrame:
    """(paper_id, verdict): each query the formula names is asked of every paper, and the formula decides."""
    f = Formula(formula)
    out = papers.select("paper_id")
    for name in sorted(f.names()):
        out = out.join(verdicts(papers, queries[name], **how).select("paper_id", F.col("verdict").alias(f"q_{name}")), "paper_id")
    return out.select("paper_id", f.compile({n: F.col(f"q_{n}") for n in f.names()}).alias("verdict"))


def misses(requests: DataFrame, memo: DataFrame) -> DataFrame:
    """Requests (key, ...) without a stored reply, each key once."""
    return requests.join(memo.select("key"), "key", "left_anti").dropDuplicates(["key"])
