"""Full texts as data: cache states, references found in them, their resolution, provenance, labels and extractions."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import references as R
from ..functions.text import clean_label, extract_doi, normalize_title
from .fixpoint import materialised, numbered

#: Cached failures; those after which a text, or the bytes, are not asked for again.
ERRORS = ("no_pdf", "download_failed", "parse_failed", "too_large")
FINAL_FOR_TEXT = ("parse_failed", "too_large")
LEAST_TITLE, LEAST_TEXT = 8, 12


def text_state(papers: DataFrame, cache: DataFrame, parsed: DataFrame | None = None) -> DataFrame:
    """(paper_id, text, state): a cached text, else one parsed to disk (blank counts as none); `cached`, `disk`, a final error, or `fetch`."""
    out = papers.select("paper_id").join(cache.select("paper_id", F.col("text").alias("c_text"), "error"), "paper_id", "left")
    if parsed is not None:
        out = out.join(parsed.select("paper_id", F.nullif(F.trim("body_text"), F.lit("")).alias("d_text")), "paper_id", "left")
    else:
        out = out.withColumn("d_text", F.lit(None).cast("string"))
    state = F.when(F.col("c_text").isNotNull(), "cached").when(F.col("d_text").isNotNull(), "disk").when(F.col("error").isin(*FINAL_FOR_TEXT), F.col("error")).otherwise("fetch")
    return out.select("paper_id", F.coalesce("c_text", "d_text").alias("text"), state.alias("state"))


def found_references(texts: DataFrame, limit: int | None = None) -> DataFrame:
    """(paper_id, pos, entry, title, doi) of the entries of each text's reference list; with limit, of what a budget of so many characters leaves of it."""
    s = texts.select("paper_id", R.split_references(F.col("text")).alias("s"))
    refs = F.col("s.refs") if limit is None else R.share_budget(F.col("s.body"), F.col("s.refs"), limit)["refs"]
    e = s.select("paper_id", refs.alias("refs")).select("paper_id", F.posexplode(R.entries(F.col("refs"))).alias("pos", "entry"))
    return e.select("paper_id", "pos", "entry", R.entry_title(F.col("entry")).alias("title"), extract_doi("entry").alias("doi"))


def resolve_references(found: DataFrame, papers: DataFrame) -> DataFrame:
    """found with ref_id and `by`: the paper of the DOI, else of the normal title (8 and more characters), else of the entry's normal text (12 and more).

    papers has paper_id, title, doi. Of papers with one title the smallest id stands for it.
    """
    by_doi = papers.where("doi is not null").groupBy(F.lower("doi").alias("doi_key")).agg(F.min("paper_id").alias("doi_id"))
    by_title = papers.select(normalize_title("title").alias("t"), "paper_id").where("t <> ''").groupBy("t").agg(F.min("paper_id").alias("id"))
    f = found.withColumn("doi_key", F.lower("doi")).withColumn("title_key", F.when(F.char_length(F.coalesce("title", F.lit(""))) >= LEAST_TITLE, normalize_title("title"))).withColumn("text_key", F.when(F.char_length("entry") >= LEAST_TEXT, normalize_title("entry")))
    f = f.join(by_doi, "doi_key", "left").join(by_title.select(F.col("t").alias("title_key"), F.col("id").alias("title_id")), "title_key", "left").join(by_title.select(F.col("t").alias("text_key"), F.col("id").alias("text_id")), "text_key", "left")
    how = F.when(F.col("doi_id").isNotNull(), "doi").when(F.col("title_id").isNotNull(), "title").when(F.col("text_id").isNotNull(), "text")
    return f.select(*found.columns, F.coalesce("doi_id", "title_id", "text_id").alias("ref_id"), how.alias("by"))


def provenance(resolved: DataFrame) -> DataFrame:
    """(src, dst, quotes): edges from the found paper, which is cited, to the one it was found in, with the entries as quotes."""
    r = resolved.where("ref_id is not null and ref_id <> paper_id")
    return r.groupBy(F.col("ref_id").alias("src"), F.col("paper_id").alias("dst")).agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "entry"))), lambda x: x["entry"]).alias("quotes"))


def fetch_chain(attempts: DataFrame) -> DataFrame:
    """(paper_id, status, recipe) from attempts (paper_id, step, recipe, kind, status): the first ok; else the last attempt's.

    Attempts of a recipe that once asked for a login, or of a browser recipe after three hard failures in a
    row over the papers in order, do not count: they would not have been made.
    """
    # a recipe is suppressed after the first row that does it and stays so: few recipes hold all attempts, so no window goes over one
    a = materialised(numbered(attempts, "recipe", "paper_id", "step"))
    hard = a.where((F.col("kind") == "browser") & F.col("status").isin("blocked", "error")).select("recipe", "pos")
    for _ in range(2):  # the last row of two hard failures in a row, then of three
        hard = hard.join(a.where(F.col("status").isin("blocked", "error")).select("recipe", (F.col("pos") - 1).alias("pos")), ["recipe", "pos"], "left_semi").select("recipe", (F.col("pos") + 1).alias("pos"))
    ends = a.where("status = 'auth_required'").select("recipe", "pos").union(hard).groupBy("recipe").agg(F.min("pos").alias("last"))
    a = a.join(ends, "recipe", "left").where("last is null or pos <= last")
    best = F.struct((F.col("status") != "ok").cast("int").alias("bad"), F.when(F.col("status") == "ok", F.col("step")).otherwise(-F.col("step")).alias("pos"))
    return a.groupBy("paper_id").agg(F.min_by(F.struct("status", "recipe"), best).alias("r")).select("paper_id", "r.status", "r.recipe")


def labels(papers: DataFrame, model: DataFrame | None = None) -> DataFrame:
    """(paper_id, label): a model's cleaned label, else the first 40 characters of the title."""
    out = papers.select("paper_id", F.left(F.coalesce("title", F.lit("")), F.lit(40)).alias("short"))
    if model is None:
        return out.select("paper_id", F.col("short").alias("label"))
    m = model.select("paper_id", F.nullif(clean_label("label"), F.lit("")).alias("m"))
    return out.join(m, "paper_id", "left").select("paper_id", F.coalesce("m", "short").alias("label"))


def salvage(reply: str | None) -> dict | None:
    """The JSON object in a reply: as it is, without fences, or from its first brace to its last."""
    t = (reply or "").strip()
    fenced = re.search(r"```(?:json)?\s*(.*?)```", t, re.DOTALL)
    for c in (t, fenced.group(1) if fenced else "", t[t.find("{") : t.rfind("}") + 1] if "{" in t else ""):
        try:
            got = json.loads(c)
        except ValueError:
            continue
        if isinstance(got, dict):
            return got
    return None


def extract(texts: DataFrame, instruction: str, make_model: Callable[[], Callable[[str, str], str]], limit: int = 80_000) -> DataFrame:
    """(paper_id, output, extraction_failed, error): a model's JSON on each text; a failure is a row, never an exception.

    make_model is called in the worker. Texts over the limit lose their middle.
    """
    from ..functions.text import truncate_middle

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = make_model()
        for f in frames:
            rows = []
            for pid, t in zip(f["paper_id"], f["text"]):
                try:
                    got, error = salvage(model(instruction, t or "")), None
                except Exception as e:  # the row says so
                    got, error = None, str(e)
                rows.append((pid, json.dumps(got, sort_keys=True) if got is not None else None, got is None, error or (None if got is not None else "no JSON object")))
            yield pd.DataFrame(rows, columns=["paper_id", "output", "extraction_failed", "error"])

    kind = dict(texts.dtypes)["paper_id"]
    return texts.select("paper_id", truncate_middle("text", limit).alias("text")).mapInPandas(run, f"paper_id {kind}, output string, extraction_failed boolean, error string")


def query_reply(reply: Column | str) -> Column:
    """The search query in a model's reply: of its JSON, of the first object in it, or behind `"query"`."""
    r = F.col(reply) if isinstance(reply, str) else reply
    whole = F.get_json_object(r, "$.query")
    inner = F.get_json_object(F.regexp_extract(r, r"(?s)(\{.*\})", 1), "$.query")
    scraped = F.nullif(F.regexp_extract(r, r'"query"\s*:\s*"([^"]*)"', 1), F.lit(""))
    return F.coalesce(whole, inner, scraped)
