"""Scalar functions as Column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Servers whose name in a venue marks a preprint.
PREPRINT_SERVERS = ("arxiv", "biorxiv", "medrxiv", "chemrxiv", "ssrn")


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def normalize_title(title: Column | str) -> Column:
    """Lower case; letters, digits and white space only (other characters go without a gap); white space collapsed."""
    kept = F.regexp_replace(F.lower(F.coalesce(_c(title), F.lit(""))), r"[^\p{L}\p{N}\s]", "")
    return F.trim(F.regexp_replace(kept, r"\s+", " "))


def normalize_venue(venue: Column | str) -> Column:
    return F.trim(F.regexp_replace(F.lower(F.coalesce(_c(venue), F.lit(""))), r"\s+", " "))


def is_preprint_venue(venue: Column | str) -> Column:
    v = F.lower(F.coalesce(_c(venue), F.lit("")))
    return reduce(lambda a, b: a | b, (v.contains(s) for s in PREPRINT_SERVERS))


def publication_month_ordinal(date: Column | str, year: Column | str) -> Column:
    """year * 12 + month of a partial ISO date; a missing or bad month counts as January; without a date the year's January."""
    parts = F.split(F.coalesce(_c(date), F.lit("")), "-")
    y = F.get(parts, F.lit(0)).try_cast("int")
    m = F.get(parts, F.lit(1)).try_cast("int")
    m = F.when(m.between(1, 12), m).otherwise(1)
    return F.coalesce(y * 12 + m, _c(year).cast("int") * 12 + 1)


def bibtex_key(x: Column | str) -> Column:
    """Letters and digits only, as a citation key must be."""
    return F.regexp_replace(_c(x).cast("string"), r"[^a-zA-Z0-9]", "")


def bibtex_escape(x: Column | str) -> Column:
    """Braces behind a backslash, so that they do not end a field."""
    return F.regexp_replace(F.coalesce(_c(x), F.lit("")), r"([{}])", r"\\$1")


def safe_filename(x: Column | str) -> Column:
    return F.regexp_replace(_c(x).cast("string"), r"[^A-Za-z0-9._-]", "_")


def clean_label(x: Column | str) -> Column:
    """First line, without surrounding quotes and blanks."""
    return F.btrim(F.regexp_replace(F.btrim(_c(x), F.lit(" \t\r\n\"'`")), r"[\r\n]+.*$", ""), F.lit(" \"'`"))


def truncate_middle(x: Column | str, limit: int, head: float = 0.6, marker: str = "\n...\n") -> Column:
    """The head and the tail of a text longer than limit, with the marker between; half of the marker's length is taken off each side."""
    x = _c(x)
    front = int(limit * head)
    half = len(marker) // 2
    cut = F.concat(F.left(x, F.lit(max(0, front - half))), F.lit(marker), F.right(x, F.lit(max(0, limit - front - half))))
    return F.when(F.char_length(x) <= limit, x).otherwise(cut)


def strip_fences(x: Column | str) -> Column:
    """A reply without the marks of a code block around it."""
    x = F.btrim(_c(x), F.lit(" \t\r\n"))
    return F.btrim(F.regexp_replace(F.regexp_replace(x, r"\A```[A-Za-z]*\s*", ""), r"\s*```\z", ""), F.lit(" \t\r\n"))


#: Names of tags, and of channels, that hold a model's thinking.
THINKING = ("think", "thinking", "thought", "thoughts", "reasoning")
CHANNELS = ("analysis", "commentary")


def strip_think(x: Column | str) -> Column:
    """A reply without what a model thought aloud.

    Blocks between tags of THINKING, with attributes or not, go, and so does what stands before a closing
    tag that nothing opened. A tag that is never closed goes alone: what follows it may be the answer. Of a reply
    in channels its final one stays, or what is left when the thinking channels go.
    """
    name = "|".join(THINKING)
    x = _c(x)
    final = r"(?s)<\|channel\|>final.*?<\|message\|>(.*?)(?:<\|(?:end|return|start)\|>|\z)"
    x = F.when(x.rlike(final), F.regexp_extract(x, final, 1)).otherwise(x)
    x = F.regexp_replace(x, rf"(?is)(?:<\|start\|>[a-z]*)?<\|channel\|>(?:{'|'.join(CHANNELS)})\b.*?<\|message\|>.*?(?:<\|end\|>|(?=<\|start\|>)|\z)", "")
    x = F.regexp_replace(x, rf"(?is)<({name})\b[^>]*>.*?</\1\s*>", "")
    x = F.regexp_replace(x, rf"(?is)\A.*</(?:{name})\s*>", "")
    return F.btrim(F.regexp_replace(x, rf"(?i)<(?:{name})\b[^>]*>", ""), F.lit(" \t\r\n"))


#: Fixed value: the form of a DOI in running text.
DOI = r"\b(10\.\d{4,9}/[^\s,;)\]]+)"


def extract_doi(x: Column | str) -> Column:
    """The first DOI of a text without trailing punctuation, or null."""
    got = F.regexp_extract(F.coalesce(_c(x), F.lit("")), DOI, 1)
    return F.nullif(F.rtrim(got, F.lit(".,;)]")), F.lit(""))


def strip_doi_prefix(x: Column | str) -> Column:
    return F.regexp_replace(F.btrim(_c(x), F.lit(" ")), r"(?i)\A(?:https?://(?:dx\.)?doi\.org/|doi:\s*)", "")


def strip_arxiv_prefix(x: Column | str) -> Column:
    return F.regexp_replace(F.btrim(_c(x), F.lit(" ")), r"(?i)\A(?:https?://arxiv\.org/abs/|arxiv:\s*)", "")


def external_key(namespace: Column | str, value: Column | str) -> Column:
    """`namespace:value` in lower case, without the prefixes of DOIs and arXiv ids; null for an empty value."""
    ns, v = F.lower(_c(namespace)), _c(value).cast("string")
    v = F.when(ns == "doi", strip_doi_prefix(v)).when(ns == "arxiv", strip_arxiv_prefix(v)).otherwise(F.btrim(v, F.lit(" ")))
    return F.when(F.char_length(v) > 0, F.concat(ns, F.lit(":"), F.lower(v)))


def abstract_from_index(index: Column | str) -> Column:
    """A text from its inverted index (word -> positions): gaps are empty words, the last word of a clash wins."""
    words = F.flatten(F.transform(F.map_entries(_c(index)), lambda e: F.transform(e["value"], lambda p: F.struct(p.alias("p"), e["key"].alias("w")))))
    size = F.coalesce(F.array_max(F.transform(words, lambda e: e["p"])) + 1, F.lit(0))
    at = lambda p: F.coalesce(F.element_at(F.concat(F.array(F.struct(F.lit(0).alias("p"), F.lit("").alias("w"))), F.filter(words, lambda e: e["p"] == p)), -1)["w"], F.lit(""))
    return F.when(size > 0, F.array_join(F.transform(F.sequence(F.lit(0), size - 1), at), " ")).otherwise(F.lit(None).cast("string"))


def arxiv_title(x: Column | str) -> Column:
    return F.btrim(F.regexp_replace(F.lower(_c(x)), r"[^a-z0-9]+", " "), F.lit(" "))


def token_estimate(x: Column | str) -> Column:
    """A quarter of the characters, as the offline model bills."""
    return F.floor(F.char_length(F.coalesce(_c(x), F.lit(""))) / 4).cast("long")


def translate_query(x: Column | str) -> Column:
    """Boolean words to search syntax: AND to a blank, OR to |, NOT x to -x."""
    x = F.regexp_replace(_c(x), r"\bNOT\s+", "-")
    x = F.regexp_replace(x, r"\s+OR\s+", " | ")
    x = F.regexp_replace(x, r"\s+AND\s+", " ")
    return F.btrim(F.regexp_replace(x, r"\s+", " "), F.lit(" "))


def join_url(base: Column | str, url: Column | str) -> Column:
    """url made absolute below base, which counts as a folder."""
    base, url = _c(base), _c(url)
    scheme = F.regexp_extract(base, r"\A([A-Za-z][A-Za-z0-9+.-]*:)//", 1)
    host = F.regexp_extract(base, r"\A([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1)
    folder = F.concat(F.regexp_replace(base, r"[?#].*\z|/\z", ""), F.lit("/"))
    return F.when(url.rlike(r"\A[A-Za-z][A-Za-z0-9+.-]*:"), url).when(url.startswith("//"), F.concat(scheme, url)).when(url.startswith("/"), F.concat(host, url)).otherwise(F.concat(folder, url))


def tag_attribute(tag: Column, name: str) -> Column:
    """The value of a tag's attribute, quoted in either way or not at all; empty if it has none."""
    quoted = [F.regexp_extract(tag, rf"(?is)\s{name}\s*=\s*{q}([^{q}]*){q}", 1) for q in ('"', "'")]
    bare = F.regexp_extract(tag, rf"(?is)\s{name}\s*=\s*([^\s\"'>]+)", 1)
    return F.btrim(F.coalesce(*(F.nullif(x, F.lit("")) for x in (*quoted, bare)), F.lit("")), F.lit(" \t\r\n"))


def pdf_url_from_html(html: Column | str, base: Column | str | None = None) -> Column:
    """The citation_pdf_url of a page, else its first link to a .pdf, made absolute below base; null if none.

    Tags are taken one by one and their attributes in any order.
    """
    tags = F.regexp_extract_all(F.coalesce(_c(html), F.lit("")), F.lit(r"(?s)<[A-Za-z][^>]*>"), F.lit(0))
    metas = F.filter(tags, lambda t: t.rlike(r"(?i)\A<meta\s") & (F.lower(tag_attribute(t, "name")) == "citation_pdf_url"))
    named = F.filter(F.transform(metas, lambda t: tag_attribute(t, "content")), lambda u: u != "")
    links = F.filter(F.transform(tags, lambda t: tag_attribute(t, "href")), lambda u: F.lower(u).contains(".pdf"))
    found = F.get(F.concat(named, links), F.lit(0))
    return found if base is None else F.when(found.isNotNull(), join_url(base, found))


def content_status(body: Column | str, cap: int) -> Column:
    """too_large beyond the cap, not_pdf for a web page or anything without a PDF's mark at its head, else ok."""
    body = _c(body)
    head = F.lower(F.ltrim(F.left(body, F.lit(32))))
    return F.when(F.octet_length(body) > cap, "too_large").when(head.startswith("%pdf") & F.ltrim(F.left(body, F.lit(32))).startswith("%PDF"), "ok").otherwise("not_pdf")
