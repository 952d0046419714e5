"""What the operators of this package share: reading, shared folders, tokenizers, graph components."""

from __future__ import annotations

import ctypes
import math
import os
import re
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of text in one Arrow batch; texts average a few KB, and one batch is held whole.
TEXT_BATCH_ROWS = 1024
#: Rows of a batch whose texts are encoded: the more, the fewer distinct parts come up anew.
ENCODE_BATCH_ROWS = 4096
#: Pieces that one worker remembers before it starts anew (about 150 bytes each).
CACHE_PIECES = 800_000

#: Bytes of one Arrow batch at most; a single longer row is a batch of its own.
BATCH_BYTES = 32 << 20
#: Bytes of text that one task of a shuffle takes, about.
PART_BYTES = 16 << 20

#: The white space of the word definitions, \x20 and \x09 to \x0D.
WORD_RE = "[^\\x20\\x09-\\x0D]+"
SPACES = " \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@lru_cache(maxsize=1)
def _local_dir() -> str:
    return "file://" + tempfile.mkdtemp(prefix="lodestar-")


def shared_dir(spark: SparkSession) -> str:
    """A new folder of this application below spark.checkpoint.dir.

    Where that is unset a session in local mode takes a folder of its one machine; on a cluster it is an error.
    """
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = _local_dir()
    return f"{base.rstrip('/')}/lodestar-{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"


def parts_for(spark: SparkSession, size: int, each: int = PART_BYTES) -> int:
    """Partitions of about `each` bytes (or rows) for `size`; not fewer than the cores at hand."""
    return max(math.ceil(size / each), spark.sparkContext.defaultParallelism)


def saved(df: DataFrame, where: str | None = None, **options: str) -> DataFrame:
    """df written as Parquet in the shared folder and read again: cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    where = where or shared_dir(spark)
    df.write.options(**options).parquet(where)
    return spark.read.schema(df.schema).parquet(where)


def small_batches(spark: SparkSession, rows: int = TEXT_BATCH_ROWS) -> None:
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def map_arrow(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterable[pa.RecordBatch]], schema: str, rows: int = TEXT_BATCH_ROWS) -> DataFrame:
    small_batches(df.sparkSession, rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        yield from fn(batches)
        give_back()

    return df.mapInArrow(run, schema)


def utf8_len(c: Column) -> Column:
    return F.coalesce(F.octet_length(c), F.lit(0)).cast("long")


def digest(text: Column) -> Column:
    """128 bits that stand for a whole text (null: empty)."""
    return F.unhex(F.substring(F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256), 1, 32))


def block_rows(rows: int) -> int:
    """Rows of a block when a hot group of `rows` is summed in two levels: as many blocks as rows in one, about."""
    return max(256, math.isqrt(rows))


def numbered_copies(d: DataFrame, limit: int, mark: str = "mark", as_: str = "copy") -> DataFrame:
    """d with one more column: rows of a mark that more than `limit` rows share are numbered among their equals, all others are 0.

    Equal rows meet as their count only, and part again by number, so that a hash of mark and copy deals them apart.
    """
    columns = d.columns
    many = d.groupBy(mark).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > limit).select(mark)
    many = saved(many)
    if many.isEmpty():
        return d.withColumn(as_, F.lit(0).cast("long"))
    counted = d.join(many, mark, "left_semi").groupBy(*columns).agg(F.count(F.lit(1)).alias(as_ + "_n"))
    dealt = counted.withColumn(as_, F.explode(F.sequence(F.lit(1).cast("long"), F.col(as_ + "_n"))))
    return d.join(many, mark, "left_anti").select(*columns, F.lit(0).cast("long").alias(as_)).union(dealt.select(*columns, as_))


def give_back() -> None:
    """Returns freed memory to the system: workers live long and share an executor with the JVM."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


# -- tokenizers ---------------------------------------------------------------------------------

def tokenizer_path(name: str) -> str:
    """Place of a public vocabulary file; `name` may be a path already."""
    if os.path.sep in name:
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


#: Fixed value: the characters of Unicode's White_Space.
_WS = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
_WS_RE2 = "\\t-\\r \\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}"
_LATIN_RE2 = "A-Za-z\\x{c0}-\\x{d6}\\x{d8}-\\x{f6}\\x{f8}-\\x{ff}"
#: A word of Latin letters, with its leading blank and one final mark: the pre-tokenizers cut before the mark.
_PLAIN = f"^(?P<stem> ?[{_LATIN_RE2}]+)(?P<mark>[.,]?)\\z"
_STEM = f"^ ?[{_LATIN_RE2}]+\\z"
#: White space as the byte-level pre-tokenizer groups it, with the words behind it.
_whole_cut = re.compile(f" ?[^{_WS}]+|[{_WS}]+(?![^{_WS}])|[{_WS}]+").findall
#: A blank or line end inside or at the end of longer white space, where a cut before it would change the grouping.
_UNSAFE = f"[{_WS_RE2}][ \\n](?:[{_WS_RE2}]|\\z)|\\x00"


def _byte_letters() -> dict[int, str]:
    """The byte-level alphabet: each byte of a character's UTF-8 as the letter that stands for it."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letter = {b: chr(b) for b in shown}
    for k, b in enumerate(b for b in range(256) if b not in letter):
        letter[b] = chr(256 + k)
    return {c: "".join(letter[b] for b in chr(c).encode()) for c in range(128, 256)}


class PieceEncoder:
    """Encodes whole texts exactly as the tokenizers library does, asking it once for each distinct part.

    A text is cut where the vocabulary's pre-tokenizer is sure to cut, whatever stands around: before
    white space that follows a word. The parts of a batch are dictionary-encoded by Arrow, so that
    Python sees each distinct one once; the ids of all of them are then gathered. Texts with a special
    token's string, or with white space that a cut would regroup, are cut on their own or not at all.
    """

    def __init__(self, name: str, pieces: int = CACHE_PIECES):
        self.pieces = pieces
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        self.lib = Tokenizer.from_file(tokenizer_path(name))
        self.bytewise = type(self.lib.pre_tokenizer).__name__ == "ByteLevel"
        self.special = [t.content for t in self.lib.get_added_tokens_decoder().values()]
        # the same merges over words that stand already in the byte-level alphabet, with blanks between them
        self.bare = Tokenizer.from_file(tokenizer_path(name))
        self.bare.normalizer = normalizers.Sequence([])
        self.bare.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        vocab = self.lib.get_vocab(with_added_tokens=False)
        self.last = np.zeros(max(vocab.values()) + 1, dtype=bool)
        self.letters = _byte_letters()
        if self.bytewise:
            self.last[vocab["\u010a"]] = True
        else:
            for w, i in vocab.items():
                self.last[i] = w.endswith("</w>")
        self.cache: dict[str, bytes] = {}

    def _library(self, parts: list[str]) -> list[bytes]:
        return [np.asarray(e.ids, dtype="<u2").tobytes() for e in self.lib.encode_batch_fast(parts, add_special_tokens=False)]

    def _words(self, stems: list[str]) -> list[bytes]:
        """Ids of words of Latin letters, many in one call; the ends of words are seen from the ids."""
        out: list[bytes] = []
        for i in range(0, len(stems), 2000):
            part = stems[i : i + 2000]
            text = "\n".join(part)
            plain = text.isascii()
            text = text.replace(" ", "\u0120").replace("\n", " \u010a ") if self.bytewise else text.replace("\n", " ")
            ids = np.asarray(self.bare.encode_batch_fast([text if plain else text.translate(self.letters)], add_special_tokens=False)[0].ids, dtype="<u2")
            ends = np.flatnonzero(self.last[ids])
            if self.bytewise:
                starts, ends = np.concatenate(([0], ends + 1)), np.append(ends, len(ids))
            else:
                starts, ends = np.concatenate(([0], ends[:-1] + 1)), ends + 1
            if len(starts) != len(part):
                out += self._library(part)
                continue
            flat = ids.tobytes()
            out += [flat[a:b] for a, b in zip((2 * starts).tolist(), (2 * ends).tolist())]
        return out

    def _known(self, keys: pa.Array) -> pa.Array:
        """Ids of each of some distinct stems and odd parts, remembered."""
        names = keys.to_pylist()
        out = list(map(self.cache.get, names))
        new = [k for k, x in enumerate(out) if x is None]
        if new:
            stem = pc.match_substring_regex(keys.take(pa.array(new)), _STEM).to_pylist()
            words = [k for k, s in zip(new, stem) if s]
            groups = ([k for k in words if names[k].isascii()], [k for k in words if not names[k].isascii()], [k for k, s in zip(new, stem) if not s])
            for group, encode in zip(groups, (self._words, self._words, self._library)):
                for i in range(0, len(group), 20_000):
                    some = group[i : i + 20_000]
                    for k, x in zip(some, encode([names[k] for k in some])):
                        out[k] = self.cache[names[k]] = x
        return pa.array(out, pa.large_binary())

    def parts(self, parts: pa.Array) -> pa.Array:
        """Ids of each part on its own: those of its word and of the mark behind it."""
        if len(self.cache) > self.pieces:
            self.cache = {}
        cut = pc.extract_regex(parts, _PLAIN)
        stem, mark = pc.struct_field(cut, "stem"), pc.fill_null(pc.struct_field(cut, "mark"), "")
        stem = pc.coalesce(stem if self.bytewise else pc.utf8_lower(stem), parts)
        each = []
        for x in (stem, mark):
            coded = x.dictionary_encode()
            each.append(self._known(coded.dictionary).take(coded.indices))
        return pc.binary_join_element_wise(*each, pa.scalar(b"", pa.large_binary()))

    def _cut(self, texts: pa.Array) -> pa.ListArray:
        if self.bytewise:
            return pc.split_pattern(pc.replace_substring(pc.replace_substring(texts, " ", "\x00 "), "\n", "\x00\n"), "\x00")
        return pc.split_pattern(pc.replace_substring(texts, "\n", " "), " ")

    def _gather(self, texts: pa.Array) -> tuple[memoryview, list[int]]:
        """(ids of all texts, byte offsets of each text's)."""
        lists = self._cut(texts)
        coded = lists.flatten().dictionary_encode()
        each = self.parts(coded.dictionary).take(coded.indices)
        _, offsets, data = each.buffers()
        ends = np.frombuffer(offsets, np.int64)[each.offset : each.offset + len(each) + 1]
        at = lists.offsets.to_numpy()
        return memoryview(data) if data is not None else memoryview(b""), ends[at - at[0]].tolist()

    def __call__(self, texts: pa.Array) -> list[bytes]:
        """Ids of each text (null: empty), little-endian, 16 bits each."""
        texts = pc.fill_null(texts, "")
        own = np.zeros(len(texts), dtype=bool)
        for x in self.special:
            own |= pc.match_substring(texts, x).to_numpy(zero_copy_only=False)
        grouped = pc.match_substring_regex(texts, _UNSAFE).to_numpy(zero_copy_only=False) & ~own if self.bytewise else np.zeros(len(texts), dtype=bool)
        out: list[bytes] = [b""] * len(texts)
        plain = np.flatnonzero(~own & ~grouped)
        if len(plain):
            data, at = self._gather(texts if len(plain) == len(texts) else texts.take(pa.array(plain)))
            for k, a, b in zip(plain.tolist(), at, at[1:]):
                out[k] = bytes(data[a:b])
        for k in np.flatnonzero(grouped).tolist():
            out[k] = b"".join(self.parts(pa.array(_whole_cut(texts[k].as_py()), pa.string())).to_pylist())
        if own.any():
            some = np.flatnonzero(own).tolist()
            for k, x in zip(some, self._library([texts[k].as_py() for k in some])):
                out[k] = x
        return out


_encoders: dict[str, PieceEncoder] = {}


def encode_ids16(name: str, texts: pa.Array, pieces: int = CACHE_PIECES) -> list[bytes]:
    """Ids of each text by this worker's encoder, 16 bits each (vocabularies below 65,536)."""
    if name not in _encoders:
        _encoders[name] = PieceEncoder(name)
    _encoders[name].pieces = pieces
    return _encoders[name](texts)


# -- sorted partitions --------------------------------------------------------------------------

def sorted_groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """The groups of a partition that is sorted by keys (no null among them), each as one table."""
    held: list[pa.RecordBatch] = []
    last: tuple | None = None
    for b in batches:
        if not b.num_rows:
            continue
        cols = [b.column(k).to_numpy(zero_copy_only=False) for k in keys]
        change = np.zeros(b.num_rows, dtype=bool)
        for c in cols:
            change[1:] |= c[1:] != c[:-1]
        starts = [0, *np.flatnonzero(change).tolist(), b.num_rows]
        for s, e in zip(starts, starts[1:]):
            key = tuple(c[s] for c in cols)
            if held and key != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(b.slice(s, e - s))
            last = key
    if held:
        yield pa.Table.from_batches(held)


# -- connected components -----------------------------------------------------------------------

def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, comp): the smallest node reachable from each node that has an edge.

    Alternating large-star and small-star steps; each star takes a minimum that is aggregated before
    the shuffle, so a hub's links never meet in one task. Every round is written to the shared folder.
    """
    spark = edges.sparkSession
    e = saved(edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    if e.isEmpty():
        return e.select(F.col("u").alias("node"), F.col("v").alias("comp"))

    def large_star(e: DataFrame) -> DataFrame:
        both = e.select("u", "v").union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        return both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()

    def small_star(e: DataFrame) -> DataFrame:
        low = e.groupBy("u").agg(F.min("v").alias("m"))
        moved = e.join(low, "u")
        return moved.select(F.col("v").alias("u"), F.col("m").alias("v")).union(moved.select("u", F.col("m").alias("v"))).where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()

    def mark(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    before = mark(e)
    while True:
        e = saved(small_star(large_star(e)))
        now = mark(e)
        if now == before:
            break
        before = now
    stars = e.select(F.col("u").alias("node"), F.col("v").alias("comp"))
    return stars.union(e.select(F.col("v").alias("node"), F.col("v").alias("comp")).distinct())
