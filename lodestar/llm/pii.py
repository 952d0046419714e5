"""Personal data by candidate gradient boosting.

Generators propose overlapping spans with high recall; boosted trees score them from their format and
context; thresholds that are calibrated on held-out cases select what is redacted beside the base
spans, which are fixed patterns and always stay.
"""

from __future__ import annotations

import bisect
import hashlib
import random
import re
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_arrow, table

KINDS = ("email", "ip", "card", "phone")

# The base patterns.
_email_at = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_local = re.compile(r"[A-Za-z0-9._%+-]*\Z")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_dotted = re.compile(r"[0-9]+(?:\.[0-9]+)*")  # four groups of such a run at a time are what the address pattern matches
_card = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_phone = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

Span = tuple[int, int, int]  # kind, start, end


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        x = ord(c) - 48
        if k & 1:
            x = x * 2 - 9 * (x > 4)
        total += x
    return total % 10 == 0


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def base_spans(text: str) -> list[Span]:
    """The spans of the base patterns, by kind and start. Each kind's are leftmost and do not overlap."""
    out: list[Span] = []
    end = 0
    for m in _email_at.finditer(text):
        s = m.start()
        while s > end and text[s - 1] in _LOCAL:
            s -= 1
        if s < m.start():
            out.append((0, s, m.end()))
            end = m.end()
    for m in _dotted.finditer(text):
        if m.end() - m.start() < 7:
            continue
        parts, at = m.group().split("."), m.start()
        for i in range(0, len(parts) - 3, 4):
            four = parts[i : i + 4]
            size = sum(map(len, four)) + 3
            if all(len(p) <= 3 and int(p or "0") <= 255 for p in (x.lstrip("0") for x in four)):
                out.append((1, at, at + size))
            at += size + 1
    for m in _card.finditer(text):
        if m.end() - m.start() >= 16:
            d = _digits(m.group())
            if 16 <= len(d) <= 19 and luhn(d):
                out.append((2, m.start(), m.end()))
    if "+" in text:
        for m in _phone.finditer(text):
            if 8 <= len(_digits(m.group())) <= 15:
                out.append((3, m.start(), m.end()))
    return out


# Generators of further candidates: written-out or masked addresses, masked or spaced address numbers,
# digit runs with any separators. They overlap each other and the base spans. An address is found from its
# mark outwards and the numbers have bounded lengths, so that each is linear in the text.
_mask = re.compile(r" ?(?:\(at\)|\[at\]|\{at\}|<at>|@) ?[A-Za-z0-9-]+(?: ?(?:\(dot\)|\[dot\]|\{dot\}|<dot>|\.) ?[A-Za-z0-9-]+)+", re.IGNORECASE)
_GENERATORS = (
    (1, re.compile(r"[0-9]{1,3}(?:(?:\[\.\]|\(\.\)|\[dot\]|\(dot\)| ?\. ?| dot )[0-9]{1,3}){3}", re.IGNORECASE)),
    (2, re.compile(r"[0-9](?:[\x20./_-]?[0-9]){12,18}")),
    (3, re.compile(r"(?:\(?[0-9]{2,4}\)?[\x20./-]{1,2}){1,4}[0-9]{3,5}")),
)
_MASKS = ("@", "(at)", "[at]", "{at}", "<at>")
_IP_MASKS = ("[.]", "(.)", "[dot]", "(dot)", " dot ")
_has_digits = re.compile(r"[0-9][^a-zA-Z\n]{0,3}[0-9][^a-zA-Z\n]{0,3}[0-9]").search

#: Words that stand before personal data, and before numbers that are none.
_CUES = (("mail", "contact", "write", "reach"), ("ip", "host", "server", "address", "client"), ("card", "visa", "mastercard", "amex", "credit", "payment"), ("tel", "phone", "call", "fax", "mobile", "cell"), ("version", "release", "isbn", "order", "invoice", "ref", "section", "date", "page", "id", "no", "vol", "figure", "between", "from"))
_last_word = re.compile(r"([A-Za-z]+)[^A-Za-z0-9]{0,4}\Z")
_last_part = re.compile(r"[A-Za-z0-9]*\Z")
_date = re.compile(r"(?:\d{4}[-./]\d{1,2}[-./]\d{1,2}|\d{1,2}[-./]\d{1,2}[-./]\d{2,4})")


def features(text: str, kind: int, start: int, end: int) -> list[float]:
    s = text[start:end]
    d = _digits(s)
    groups = re.findall(r"[0-9]+", s)
    seps = set(re.sub(r"[0-9A-Za-z]", "", s))
    before = text[max(0, start - 24) : start]
    m = _last_word.search(before)
    cue = m.group(1).lower() if m else ""
    nxt = text[end : end + 1]
    return [
        *(float(kind == k) for k in range(4)), len(s), len(d), len(s) - len(d), len(groups), len(groups[0]) if groups else 0, len(groups[-1]) if groups else 0,
        max((len(g) for g in groups), default=0), min((len(g) for g in groups), default=0), len(seps), float("(" in s), float("-" in s), float("." in s), float(" " in s), float("/" in s),
        float(len(d) >= 12 and luhn(d)), float(s[:1] == "0"), float(d[:1] in ("4", "5", "3")), float(bool(_date.fullmatch(s))), float(all(int(g) <= 255 for g in groups if len(g) < 10)) if groups else 0.0,
        *(float(cue in words) for words in _CUES), float(before[-1:].isalnum()), float(before[-1:] in ("#", "$", "/", "=", ".", "-", ":")), float(nxt.isalnum()), float(nxt in ("%", "/", "-")), float("@" in s), float("at" in s.lower()[:-3]), float("dot" in s.lower()),
        len(_last_part.search(s).group()), len(s.rsplit(".", 1)[-1]), float(s.rsplit(".", 1)[-1].isalpha()),
    ]


# -- boosted trees ------------------------------------------------------------------------------

class Boosted:
    """Logistic gradient boosting with trees of a fixed depth over binned features."""

    def __init__(self, rounds: int = 60, depth: int = 3, rate: float = 0.3, bins: int = 16):
        self.rounds, self.depth, self.rate, self.bins = rounds, depth, rate, bins

    def fit(self, x: np.ndarray, y: np.ndarray) -> Boosted:
        self.edges = [np.unique(np.quantile(c, np.linspace(0, 1, self.bins + 1)[1:-1])) for c in x.T]
        b = self._bin(x)
        mean = y.mean()
        self.start = float(np.log(mean / (1 - mean)))
        f = np.full(len(y), self.start)
        self.trees = []
        for _ in range(self.rounds):
            p = 1 / (1 + np.exp(-f))
            tree = self._grow(b, y - p, p * (1 - p))
            self.trees.append(tree)
            f += self.rate * self._run(tree, b)
        return self

    def _bin(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, c, side="right") for e, c in zip(self.edges, x.T)], axis=1)

    def _grow(self, b: np.ndarray, g: np.ndarray, h: np.ndarray) -> list[tuple[int, int, float]]:
        """Nodes in heap order: feature (-1: leaf), bin, value."""
        nodes = [(-1, 0, 0.0)] * (2 ** (self.depth + 1) - 1)
        at = np.zeros(len(g), dtype=np.int64)
        for k in range(len(nodes)):
            mine = np.flatnonzero(at == k)
            gs, hs = g[mine].sum(), h[mine].sum()
            nodes[k] = (-1, 0, float(gs / (hs + 1)))
            if 2 * k + 2 >= len(nodes) or len(mine) < 10:
                continue
            best = (1e-6, -1, 0)
            for j in range(b.shape[1]):
                n = len(self.edges[j]) + 1
                if n < 2:
                    continue
                gl = np.bincount(b[mine, j], g[mine], n).cumsum()[:-1]
                hl = np.bincount(b[mine, j], h[mine], n).cumsum()[:-1]
                gain = gl**2 / (hl + 1) + (gs - gl) ** 2 / (hs - hl + 1) - gs**2 / (hs + 1)
                t = int(np.argmax(gain))
                if gain[t] > best[0]:
                    best = (float(gain[t]), j, t)
            if best[1] >= 0:
                nodes[k] = (best[1], best[2], nodes[k][2])
                right = b[mine, best[1]] > best[2]
                at[mine] = 2 * k + 1 + right
        return nodes

    def _run(self, tree: list[tuple[int, int, float]], b: np.ndarray) -> np.ndarray:
        out = np.zeros(len(b))
        stack = [(0, np.arange(len(b)))]
        while stack:
            k, mine = stack.pop()
            j, t, v = tree[k]
            if j < 0:
                out[mine] = v
            else:
                right = b[mine, j] > t
                stack += [(2 * k + 1, mine[~right]), (2 * k + 2, mine[right])]
        return out

    def margin(self, x: np.ndarray) -> np.ndarray:
        b = self._bin(x)
        return self.start + self.rate * sum(self._run(t, b) for t in self.trees)


# -- cases to learn from ------------------------------------------------------------------------

def labelled_cases(n: int = 6000, seed: int = 7) -> list[tuple[str, int, int, int, int]]:
    """(text, kind, start, end, label) from rules: written-out personal data, and numbers and words that look like it."""
    rng = random.Random(seed)
    num = lambda k: "".join(rng.choice("0123456789") for _ in range(k))
    name = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randrange(3, 9)))
    octet = lambda: str(rng.randrange(256))

    def with_luhn(k: int, right: bool) -> str:
        d = rng.choice("345") + num(k - 2)
        good = next(c for c in "0123456789" if luhn(d + c))
        return d + (good if right else rng.choice([c for c in "0123456789" if c != good]))

    def grouped(d: str, sep: str) -> str:
        return sep.join(d[i : i + 4] for i in range(0, len(d), 4))

    def positive() -> tuple[int, str]:
        k = rng.randrange(4)
        if k == 0:
            at, dot = rng.choice([(" (at) ", " (dot) "), ("(at)", "(dot)"), (" [at] ", " [dot] "), ("[at]", "."), (" @ ", "."), ("{at}", "{dot}"), ("<at>", "<dot>")])
            return 0, f"{name()}{rng.choice(['', '.' + name(), num(2)])}{at}{name()}{dot}{rng.choice(['com', 'org', 'net', 'example', 'de', 'fr'])}"
        if k == 1:
            return 1, rng.choice(["[.]", "(.)", "[dot]", " dot "]).join(octet() for _ in range(4))
        if k == 2 and rng.random() < 0.2:
            d, sep = with_luhn(15, True), rng.choice([" ", "-"])
            return 2, f"{d[:4]}{sep}{d[4:10]}{sep}{d[10:]}"
        if k == 2:
            sep = rng.choice(["", ".", "/", "_"])
            size = rng.choice([13, 15]) if sep == "" else 16
            return 2, grouped(with_luhn(size, True), sep)
        return 3, rng.choice([f"({num(3)}) {num(3)}-{num(4)}", f"{num(3)}-{num(3)}-{num(4)}", f"{num(3)}.{num(3)}.{num(4)}", f"00{num(2)} {num(3)} {num(3)} {num(4)}", f"0{num(2)} {num(2)} {num(2)} {num(3)}", f"({num(4)}) {num(3)} {num(3)}"])

    def negative() -> tuple[int, str]:
        k = rng.randrange(10)
        if k == 9:  # a piece of longer digits or of a digest, or two numbers side by side, whatever the check digit says
            return 2, rng.choice([with_luhn(rng.choice([13, 15, 16, 17, 19]), True) + "|" + num(rng.randrange(1, 9)), with_luhn(rng.choice([13, 16]), True) + "|" + rng.choice("abcdef") + num(3), f"{num(rng.randrange(5, 13))} {with_luhn(13, True)[:rng.randrange(4, 13)]}"])
        if k == 0:
            return 0, rng.choice([f"{name()} @ {num(2)}.{num(2)}", f"{name()}@{num(1)}.{num(1)}", f"look (at) {name()} . {name()}", f"{name()} @ {name()}. {name().title()}"])
        if k == 1:
            return 1, rng.choice([". ".join(num(rng.randrange(1, 4)).lstrip("0") or "1" for _ in range(4)), f"{octet()} . {octet()} . {num(3)} . {num(2)}"])
        if k == 2:
            return 2, rng.choice([with_luhn(rng.choice([13, 14, 15, 17]), False), num(rng.randrange(13, 20)), f"978-{num(1)}-{num(2)}-{num(6)}-{num(1)}", grouped(with_luhn(16, False), rng.choice(["", ".", "/"]))])
        if k == 3:
            return 3, rng.choice([f"{rng.randrange(1900, 2030)}-{num(2)}-{num(4)}", f"{num(2)}.{num(2)}.{rng.randrange(1900, 2030)}", f"{num(2)}/{num(2)}/{rng.randrange(1900, 2030)}"])
        if k == 4:
            return 3, rng.choice([f"{num(4)}-{num(4)}", f"{rng.randrange(1900, 2030)}-{rng.randrange(1900, 2030)}", f"{num(3)} {num(3)}", f"{num(2)} {num(4)}"])
        if k == 5:
            return 3, rng.choice([f"{num(3)}.{num(3)}", f"{num(3)}.{num(3)}.{num(3)}", f"{num(2)} {num(3)} {num(3)}", f"{num(3)}/{num(4)}"])
        if k == 6:
            return 3, f"{num(4)} {num(4)} {num(4)}"
        if k == 7:
            return 2, "-".join(num(rng.choice([2, 3, 5])) for _ in range(5))[:23].rstrip("-")
        return 3, f"{num(2)} {num(2)} {num(2)} {num(3)}"

    out = []
    for i in range(n):
        label = i % 2
        kind, s = positive() if label else negative()
        cues = _CUES[kind] if label else _CUES[4]
        word = rng.choice(cues) if rng.random() < 0.5 else name()
        lead = f"{name()} {word}{rng.choice([' ', ': ', ' ', ' no. ' if not label else ' '])}"
        if not label and rng.random() < 0.2:
            lead += rng.choice(["#", "$", "v", "="])
        s, _, behind = s.partition("|")  # what follows the span at once
        out.append((lead + s + behind + rng.choice([" ", ".", ", ", "\n", "" if label else "%"]) + name(), kind, len(lead), len(lead) + len(s), label))
    return out


@lru_cache(maxsize=1)
def trained() -> tuple[Boosted, tuple[float, ...]]:
    """The trees, and for each kind the lowest margin from which on at least 998 of 1,000 held-out candidates are personal data."""
    cases = labelled_cases()
    x = np.array([features(t, k, s, e) for t, k, s, e, _ in cases])
    y = np.array([float(c[4]) for c in cases])
    kind = np.array([c[1] for c in cases])
    fit = np.arange(len(cases)) % 3 != 0
    model = Boosted().fit(x[fit], y[fit])
    margin = model.margin(x[~fit])
    cuts = []
    for k in range(4):
        m, label = margin[kind[~fit] == k], y[~fit][kind[~fit] == k]
        order = np.argsort(-m)
        right = np.cumsum(label[order]) / np.arange(1, len(m) + 1)
        good = np.flatnonzero(right >= 0.998)
        cuts.append(float(m[order[good[-1]]]) if len(good) else float("inf"))
    return model, tuple(cuts)


def candidates(text: str) -> list[Span]:
    """Spans that any generator proposes."""
    digits = _has_digits(text) is not None
    out = []
    lower = text.lower()
    if any(x in lower for x in _MASKS):
        end = 0
        for m in _mask.finditer(text):
            s = m.start()
            while s > end and text[s - 1] in _LOCAL:
                s -= 1
            if s < m.start():
                out.append((0, s, m.end()))
            end = m.end()
    masked = any(x in lower for x in _IP_MASKS)
    for kind, pattern in _GENERATORS:
        if digits or (kind == 1 and masked):
            out += [(kind, m.start(), m.end()) for m in pattern.finditer(text)]
    return out


class _Taken:
    """Spans that are taken, as disjoint ranges in order."""

    def __init__(self, spans: Iterable[Span]):
        self.starts: list[int] = []
        self.ends: list[int] = []
        for s, e in sorted((s, e) for _, s, e in spans):
            if self.ends and s < self.ends[-1]:
                self.ends[-1] = max(self.ends[-1], e)
            else:
                self.starts.append(s)
                self.ends.append(e)

    def meets(self, c: Span) -> bool:
        k = bisect.bisect_right(self.ends, c[1])
        return k < len(self.starts) and self.starts[k] < c[2]

    def add(self, c: Span) -> None:
        k = bisect.bisect_left(self.starts, c[1])
        self.starts.insert(k, c[1])
        self.ends.insert(k, c[2])


def find(text: str | None, model: Boosted, cuts: tuple[float, ...]) -> tuple[list[Span], list[Span]]:
    """(base spans, all spans), by kind and start; what is added overlaps nothing else."""
    text = text or ""
    base = base_spans(text)
    taken = _Taken(base)
    more = [c for c in candidates(text) if not taken.meets(c)]
    if not more:
        return base, base
    margin = model.margin(np.array([features(text, *c) for c in more]))
    found = list(base)
    for m, c in sorted(zip(margin.tolist(), more), key=lambda x: (-x[0], x[1])):
        if m >= cuts[c[0]] and not taken.meets(c):
            taken.add(c)
            found.append(c)
    return base, sorted(found)


def _text(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for k, s, e in spans)


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
    model, cuts = trained()
    for b in batches:
        got = [find(t, model, cuts) for t in b.column("text").to_pylist()]
        counts = [pa.array([sum(s[0] == k for s in base) for base, _ in got], pa.int64()) for k in range(4)]
        yield pa.RecordBatch.from_arrays(
            [b.column("doc_id"), *counts, pa.array([hashlib.sha256(_text(base).encode()).hexdigest() for base, _ in got]), pa.array([_text(spans) for _, spans in got])],
            names=["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans"],
        )


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans): counts and digest of the base spans, and all spans.

    Null and empty texts have none. Each row stands for itself, repeated or without id. Only id_col
    and text_col are read. No rows: an empty result.
    """
    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return map_arrow(d, _scan, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")


def redacted(text: str, spans: list[Span]) -> str:
    """text with every span (overlapping ones as one, under the first one's kind) replaced by its kind in brackets."""
    out, at, end = [], 0, -1
    for k, s, e in sorted(spans, key=lambda x: (x[1], -x[2], x[0])):
        if s < end:
            end = max(end, e)
            at = max(at, end)
            continue
        out += [text[at:s], f"[{KINDS[k].upper()}]"]
        at = end = e
    return "".join([*out, text[at:]])


def _redact(text_at: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        model, cuts = trained()
        for b in batches:
            texts = b.column(text_at).to_pylist()
            new = []
            for t in texts:
                spans = find(t, model, cuts)[1] if t else []
                new.append(redacted(t, spans) if spans else t)
            cols = [b.column(i) for i in range(b.num_columns)]
            cols[text_at] = pa.array(new, pa.string())
            yield pa.RecordBatch.from_arrays(cols, names=b.schema.names)

    return run


def redact(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with all spans of text_col replaced by [EMAIL], [IP], [CARD] or [PHONE]; a null text stays null."""
    return map_arrow(docs, _redact(docs.columns.index(text_col)), docs.schema)


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_pii(table(spark, sf_dir, "documents"))
