"""Reference lists in full texts: where they begin, how they share a budget, which lines name titles."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The lines that head a reference list, whatever their case and spacing.
HEADINGS = frozenset({"reference", "references", "references and notes", "reference and notes", "references cited", "reference cited", "bibliography", "works cited", "literature cited"})
#: Shares of the text from which on a heading counts by itself, or with enough entries behind it; how many are enough, and within how many characters.
LATE, EARLY, ENTRIES, SAMPLE = 0.40, 0.15, 5, 3000

HEAD, NUMBER, AUTHOR, OTHER = "head", "number", "author", ""


def _capital(word: str) -> bool:
    return "A" <= word[:1] <= "Z"


def is_number(word: str) -> bool:
    """Whether a word numbers an entry: up to three digits in brackets, or before a full stop or a bracket."""
    bare = word[1:-1] if word[0] == "[" and word[-1] == "]" else word[:-1] if word[-1] in ".)" else ""
    return 1 <= len(bare) <= 3 and bare.isdecimal()


def line_kind(line: str) -> str:
    """What a line opens: a reference list, an entry by its number ([3] or 3. or 3), an entry by its author (Name, N.), or neither."""
    words = line.split(None, 3)
    if not words:
        return OTHER
    if len(line) < 80 and " ".join(line.split()).lower() in HEADINGS:
        return HEAD
    if len(words) < 2 or not _capital(words[1]):
        return OTHER
    first = words[0]
    if is_number(first):
        return NUMBER
    name = first[:-1].replace("-", "").replace("'", "")
    if first[-1] == "," and len(first) > 2 and _capital(first) and name.isascii() and name.isalpha():
        return AUTHOR
    return OTHER


def _lines(text: str, start: int = 0, end: int | None = None) -> Iterator[tuple[int, str]]:
    """(position, kind) of each line that lies in text[start:end], which may cut the last one short."""
    end = len(text) if end is None else min(end, len(text))
    while start < end:
        stop = text.find("\n", start, end)
        stop = end if stop < 0 else stop
        yield start, line_kind(text[start:stop])
        start = stop + 1


def is_bibliography(text: str, start: int = 0) -> bool:
    """Whether enough entries of one kind open near the start."""
    kinds = [k for _, k in _lines(text, start, start + SAMPLE)]
    return max(kinds.count(NUMBER), kinds.count(AUTHOR)) >= ENTRIES


def reference_start(text: str) -> int | None:
    """Where the reference list begins.

    Each heading is weighed: one late in the text counts fully, one earlier less and only before enough
    entries; of the weightiest the last one wins. Without any, the first of enough numbered entries in
    the late part.
    """
    found = list(_lines(text))
    late = LATE * len(text)
    weighed = [(2 if at >= late else 1, at) for at, kind in found if kind == HEAD and (at >= late or at >= EARLY * len(text) and is_bibliography(text, text.find("\n", at) + 1 or len(text)))]
    if weighed:
        return max(weighed)[1]
    numbered = [at for at, kind in found if kind == NUMBER and at >= int(late)]
    return numbered[0] if len(numbered) >= ENTRIES else None


def _split(texts: pd.Series) -> pd.DataFrame:
    rows = []
    for t in texts.fillna(""):
        at = reference_start(t)
        rows.append((t, "") if at is None else (t[:at].rstrip(), t[at:].strip()))
    return pd.DataFrame(rows, columns=["body", "refs"])


def split_references(text: Column) -> Column:
    """struct<body, refs> of a whole text; without a list all is body."""
    return F.pandas_udf(_split, T.StructType([T.StructField("body", T.StringType()), T.StructField("refs", T.StringType())]))(text)


def share_budget(body: Column, refs: Column, limit: int, most_refs: float = 0.4) -> Column:
    """body and refs cut to limit characters together: the list gets 40 % at most, the body what is left."""
    r = F.left(refs, F.lit(int(limit * most_refs)))
    return F.struct(F.left(body, F.lit(limit) - F.char_length(r)).alias("body"), r.alias("refs"))


def cut_entries(refs: str) -> list[str]:
    """The entries of a list, without its heading and their numbers: cut before numbered lines if two or more are, else each line is one."""
    lines = [x.split() for x in refs.split("\n")]
    while lines and (not lines[0] or line_kind(" ".join(lines[0])) == HEAD):
        del lines[0]
    opens = [len(words) > 1 and is_number(words[0]) for words in lines]
    if sum(opens) < 2:
        return [" ".join(words) for words in lines if words]
    out: list[list[str]] = [[]]
    for words, new in zip(lines, opens):
        if new:
            out.append([])
        out[-1] += words[new:]
    return [" ".join(words) for words in out if words]


def _entries(refs: pd.Series) -> pd.Series:
    return refs.fillna("").map(cut_entries)


def entries(refs: Column) -> Column:
    return F.pandas_udf(_entries, T.ArrayType(T.StringType()))(refs)


def entry_title(entry: Column) -> Column:
    """The quoted part of an entry, else the first sentence of four or more words behind the authors and the year; null if none."""
    quoted = F.regexp_extract(entry, "[\u201c\"]([^\u201d\"]{8,})[\u201d\"]", 1)
    behind = F.regexp_replace(entry, r"\A.*?\(?(?:19|20)\d{2}[a-z]?\)?[.,:;]?\s*", "")
    sentences = F.filter(F.split(behind, r"\.\s+"), lambda s: F.size(F.split(F.trim(s), r"\s+")) >= 4)
    return F.coalesce(F.nullif(F.rtrim(quoted, F.lit(" ,.")), F.lit("")), F.rtrim(F.get(sentences, F.lit(0)), F.lit(" .")))
