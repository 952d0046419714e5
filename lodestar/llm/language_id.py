"""Language ID by segmentation-marginalised unigrams.

Each language has a probability for every piece of a fixed public vocabulary. The score of a word is
the sum, over all its segmentations into pieces, of the product of their probabilities, computed by
the forward algorithm; a text's is the product over its words. The probabilities are estimated by
expectation maximisation with forward-backward passes over the words of a bounded sample of labelled
documents.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator
from itertools import chain

import ahocorasick
import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_arrow, table, tokenizer_path

VOCABULARY = "piece_bpe_32k.model"
#: Labelled documents of a language that the estimation takes, in expectation; those of the lowest hashes of doc_id.
SAMPLE_DOCS = 400
ROUNDS = 3
#: Letters of a word that are scored together with others; longer runs of letters are scored one by one, in steps. Learning counts them in parts of this length.
WORD_LETTERS = 24
#: Pseudo-count of every piece, and the probability of a letter that no piece covers.
SMOOTH, UNKNOWN = 0.05, 1e-7
MARK = "▁"

_letters = regex.compile(r"\p{L}[\p{L}\p{M}]*").findall
_ascii_letters = re.compile(r"[a-z]+").findall


def words_of(text: str | None) -> list[str]:
    """The runs of letters, with the marks that belong to them."""
    if not text:
        return []
    return _ascii_letters(text.lower()) if text.isascii() else _letters(text.lower())


def vocabulary(name: str = VOCABULARY) -> list[str]:
    """The vocabulary's pieces that can stand in a word: letters, with or without the mark of a word's start."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=tokenizer_path(name))
    pieces = {sp.id_to_piece(i) for i in range(sp.get_piece_size())}
    return sorted(p for p in {x.lower() for x in pieces} if p == MARK or words_of(p.removeprefix(MARK)) == [p.removeprefix(MARK)])


def arcs(word: str, known: dict[str, int], longest: int) -> list[tuple[int, int, int]]:
    """(from, to, piece) of every piece in the marked word; -1 for a letter that begins no piece of its own."""
    w = MARK + word
    out = []
    n = len(w)
    for i in range(n):
        if w[i] not in known:
            out.append((i, i + 1, -1))
        for j in range(i + 1, min(n, i + longest) + 1):
            p = known.get(w[i:j])
            if p is not None:
                out.append((i, j, p))
    return out


def estimate(counts: Counter, pieces: list[str], rounds: int = ROUNDS) -> dict[str, float]:
    """Piece probabilities of the words' language: the expected counts of the pieces seen, and SMOOTH for each piece."""
    known = {p: k for k, p in enumerate(pieces)}
    longest = max(map(len, pieces), default=1)
    lattices = [(len(w) + 1, arcs(w, known, longest), c) for w, c in counts.items()]
    prob = [1.0 / len(pieces)] * len(pieces)
    for k, p in enumerate(pieces):  # longer pieces begin likelier than the product of their letters
        prob[k] *= 1.0 + len(p)
    total = sum(prob)
    prob = [x / total for x in prob]
    for _ in range(rounds):
        seen: dict[int, float] = {}
        for n, lat, c in lattices:
            fore = [1.0] + [0.0] * n
            for i, j, p in lat:
                fore[j] += fore[i] * (prob[p] if p >= 0 else UNKNOWN)
            if not fore[n]:
                continue
            back = [0.0] * n + [1.0]
            for i, j, p in reversed(lat):
                back[i] += back[j] * (prob[p] if p >= 0 else UNKNOWN)
            scale = c / fore[n]
            for i, j, p in lat:
                if p >= 0:
                    seen[p] = seen.get(p, 0.0) + fore[i] * prob[p] * back[j] * scale
        total = sum(seen.values()) + SMOOTH * len(pieces)
        prob = [SMOOTH / total] * len(pieces)
        for p, c in seen.items():
            prob[p] += c / total
    return {p: prob[k] for p, k in known.items()}


class Model:
    """Scores words under all languages at once; remembers each word's scores."""

    ROWS = 500_000

    def __init__(self, langs: list[str], pieces: dict[str, tuple[float, ...]]):
        self.langs, self.pieces = langs, pieces
        if not pieces:
            return
        self.finder = ahocorasick.Automaton()
        for k, p in enumerate(pieces):
            self.finder.add_word(p, k)
        self.finder.make_automaton()
        self.length = np.array([len(p) for p in pieces], dtype=np.int64)
        self.single = np.array([ord(p) for p in pieces if len(p) == 1], dtype=np.uint32)
        #: One row a piece; the last is that of a letter that is none.
        self.prob = np.array([*pieces.values(), (UNKNOWN,) * len(langs)]).reshape(len(pieces) + 1, len(langs))
        self._clear()

    def _clear(self) -> None:
        self.index: dict[str, int] = {}
        self.rows = np.zeros((1024, len(self.langs)))

    def score(self, words: list[str]) -> np.ndarray:
        """Log of the summed probability of all segmentations, a row a word."""
        out = np.zeros((len(words), len(self.langs)))
        short = [k for k, w in enumerate(words) if len(w) <= WORD_LETTERS]
        out[short] = self._short([words[k] for k in short])
        for k, w in enumerate(words):
            if len(w) > WORD_LETTERS:
                out[k] = self._long(w)
        return out

    def _long(self, word: str) -> np.ndarray:
        """The same of one word of any length: the sums of the last positions only are held, and scaled at each step."""
        text = MARK + word
        reach = max(int(self.length.max()), 1)
        fore = np.zeros((reach + 1, len(self.langs)))  # fore[k]: the sum k letters back, once begun
        fore[0] = 1.0
        log = np.zeros(len(self.langs))
        found = self.finder.iter(text)
        end, piece = next(found, (-1, 0))
        single = set(self.single.tolist())
        for at, letter in enumerate(text):
            now = np.zeros(len(self.langs))
            while end == at:
                now += fore[self.length[piece] - 1] * self.prob[piece]
                end, piece = next(found, (-1, 0))
            if ord(letter) not in single:
                now += fore[0] * UNKNOWN
            now = np.maximum(now, 1e-300)
            fore[1:] = fore[:-1]
            fore[0] = now
            scale = fore.max(axis=0)
            fore /= scale
            log += np.log(scale)
        return log + np.log(fore[0])

    def _short(self, words: list[str]) -> np.ndarray:
        """An automaton finds all pieces in all words; the forward algorithm then goes from each pair of
        positions to the next, over all words that have a piece there.
        """
        if not words:
            return np.zeros((0, len(self.langs)))
        text = "\n".join(MARK + w for w in words)
        size = np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1
        start = np.concatenate(([0], np.cumsum(size + 1)[:-1]))
        word_at = np.repeat(np.arange(len(words)), size + 1)
        found = np.fromiter(chain.from_iterable(self.finder.iter(text)), dtype=np.int64).reshape(-1, 2)
        end, piece = found[:, 0] + 1, found[:, 1]
        begin = end - self.length[piece]
        # a letter that is no piece is a step of its own
        code = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        bare = np.flatnonzero(~np.isin(code, self.single) & (code != 10))
        begin, end, piece = np.concatenate((begin, bare)), np.concatenate((end, bare + 1)), np.concatenate((piece, np.full(len(bare), len(self.pieces))))
        word = word_at[begin]
        i, j = begin - start[word], end - start[word]
        step = (j << 8) + i
        order = np.argsort(step, kind="stable")
        word, piece, step = word[order], piece[order], step[order]
        cuts = np.concatenate(([0], np.flatnonzero(step[1:] != step[:-1]) + 1, [len(step)]))
        fore = np.zeros((int(size.max()) + 1, len(words), len(self.langs)))
        fore[0] = 1.0
        for a, b in zip(cuts.tolist(), cuts[1:].tolist()):
            to, at = int(step[a]) >> 8, int(step[a]) & 255
            some = word[a:b]
            fore[to, some] += fore[at, some] * self.prob[piece[a:b]]
        return np.log(np.maximum(fore[size, np.arange(len(words))], 1e-300))

    def word(self, word: str) -> list[float]:
        return self.score([word])[0].tolist()

    def texts(self, texts: list[str | None]) -> list[tuple[str, float]]:
        """(language, posterior) of each; ties go to the smaller name."""
        if not self.langs:
            return [("und", 0.0)] * len(texts)
        if len(self.index) > self.ROWS:
            self._clear()
        index = self.index
        cut = [words_of(t) for t in texts]
        new = list(set().union(*cut) - index.keys())
        for i in range(0, len(new), 10_000):
            part = new[i : i + 10_000]
            at = len(index)
            while at + len(part) > len(self.rows):
                self.rows = np.concatenate((self.rows, np.zeros_like(self.rows)))
            self.rows[at : at + len(part)] = self.score(part)
            index.update(zip(part, range(at, at + len(part))))
        out = []
        for words in cut:
            if not words:
                out.append(("und", 0.0))
                continue
            total = self.rows[np.fromiter(map(index.__getitem__, words), dtype=np.int64, count=len(words))].sum(axis=0)
            best = int(np.argmax(total))
            out.append((self.langs[best], float(1.0 / np.exp(total - total[best]).sum())))
        return out

    def text(self, text: str | None) -> tuple[str, float]:
        return self.texts([text])[0]


def held_out(id_col: Column) -> Column:
    """Those whose crc32 of the id as text is divisible by 5 are never learned from; false for a null id."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def _estimate_group(vocab: str):
    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        counts: Counter = Counter()
        for t in pdf["text"]:
            counts.update(w[i : i + WORD_LETTERS] for w in words_of(t) for i in range(0, len(w), WORD_LETTERS))
        if not counts:
            return pd.DataFrame({"lang": [], "piece": [], "p": []})
        got = estimate(counts, vocabulary(vocab))
        low = min(got.values())
        keep = [(p, x) for p, x in got.items() if x > low] + [("", low)]
        return pd.DataFrame({"lang": key[0], "piece": [p for p, _ in keep], "p": [x for _, x in keep]})

    return run


def learn(docs: DataFrame, vocab: str = VOCABULARY, sample_docs: int = SAMPLE_DOCS, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model:
    """A model of the labelled documents that are not held out; sample_docs of each language, in expectation.

    Rows without text, label or id are not learned from. The result has at most as many numbers as the
    vocabulary has pieces for each language.
    """
    spark = docs.sparkSession
    d = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    d = d.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    n = d.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()  # one row a language
    if not n:
        return Model([], {})
    share = F.create_map(*(F.lit(x) for r in n for x in (r["lang"], min(1.0, sample_docs / r["n"]))))
    chosen = d.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)).cast("double") < share[F.col("lang")] * float(1 << 30))
    got = chosen.select("lang", "text").groupBy("lang").applyInPandas(_estimate_group(vocab), "lang string, piece string, p double").toPandas()
    langs = sorted(set(got["lang"]))
    rest = {x.lang: x.p for x in got[got["piece"] == ""].itertuples()}
    by_piece: dict[str, dict[str, float]] = {}
    for x in got[got["piece"] != ""].itertuples():
        by_piece.setdefault(x.piece, {})[x.lang] = x.p
    return Model(langs, {p: tuple(by_piece.get(p, {}).get(k, rest[k]) for k in langs) for p in vocabulary(vocab)})


def _predict(langs: list[str], pieces: dict[str, tuple[float, ...]], at: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        model = Model(langs, pieces)
        for b in batches:
            got = model.texts(b.column(at).to_pylist())
            rest = [b.column(i) for i in range(b.num_columns)]
            yield pa.RecordBatch.from_arrays([*rest, pa.array([x for x, _ in got], pa.string()), pa.array([p for _, p in got], pa.float64())], names=[*b.schema.names, "lang_pred", "score"])

    return run


def predict(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """docs (without columns named text, lang_pred or score of another meaning) with lang_pred and score.

    A text that is null or has no letter, and any text if nothing was learned, gets `und` with score 0.
    """
    schema = docs.select(*docs.columns, F.lit("").alias("lang_pred"), F.lit(0.0).alias("score")).schema
    return map_arrow(docs, _predict(model.langs, model.pieces, docs.columns.index(text_col)), schema, 512)


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = learn(docs)
    return predict(docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text"), model).drop("text")
