"""Exact self-join of documents on the Jaccard similarity of their word n-gram sets.

Size-banded tiles. Documents fall into bands by the size of their set; two sets that link differ in at
most (1 - t) / (1 + t) * (a + b) elements. The hash space is cut into p parts, the same for all sets
of a tile (a band with the sets just below it), so two linking sets agree in at least p - k of the
parts; by the prefix argument on parts ordered by their number of elements, they share one of the
k + 1 fullest parts of each. The contents of those parts, hashed, are the keys under which documents
meet. Candidates are then bounded by the bit counts of hashed bitmap signatures, and what remains is
settled by intersecting sorted arrays. No link between different sets can be lost.

A key that many documents share is never expanded into all its pairs: each document is first compared
with the most central one of its keys; only keys whose documents are then not all in one component are
compared in blocks, by bitmap, across components.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import components, map_arrow, parts_for, saved, sorted_groups, table

#: Ratio of a band's upper to its lower size.
BAND = 1.5
#: Parts of a tile for each of the largest number of differing elements.
SPARE = 1.15
#: Keys that one task holds before it passes them on.
HELD_KEYS = 400_000
#: Keys of a task where they meet, about; a task holds its part whole.
MET_KEYS = 300_000
#: Documents of a key that are compared in one block.
BLOCK = 1024

_M1, _M2, _M3 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))
_U64 = np.dtype("<u8")


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M2
    x = (x ^ (x >> np.uint64(27))) * _M3
    return x ^ (x >> np.uint64(31))


class _Words(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > 200_000:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


_words = _Words()


def shingle_set(text: bytes | None, n: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the n-word shingles of a UTF-8 text, A-Z lower-cased."""
    words = text.lower().split() if text else []  # on bytes: A-Z only, and exactly \x20 and \x09 to \x0D
    if not words:
        return np.empty(0, dtype=_U64)
    w = np.fromiter(map(_words.__getitem__, words), dtype=_U64, count=len(words))
    m = max(1, len(w) - n + 1)
    k = min(n, len(w))
    h = np.full(m, np.uint64(k), dtype=_U64)
    for i in range(k):
        h = _mix((h + w[i : i + m]) * _M1 + np.uint64(i))
    h.sort()
    return h[np.concatenate(([True], h[1:] != h[:-1]))]


def bitmap(s: np.ndarray) -> bytes:
    """Hashed bitmap of a power of two of bits: 512 at least, and four times the size up to 16,384."""
    bits = min(16_384, max(512, 1 << int(4 * len(s) - 1).bit_length())) if len(s) else 512
    bm = np.zeros(bits, dtype=np.uint8)
    bm[(s & np.uint64(bits - 1)).astype(np.int64)] = 1
    return np.packbits(bm, bitorder="little").tobytes()


def _fold(bm: np.ndarray, width: int) -> np.ndarray:
    while len(bm) > width:
        half = len(bm) // 2
        bm = bm[:half] | bm[half:]
    return bm


class Rule:
    """Links at den * |A & B| >= num * |A | B|, in whole numbers."""

    def __init__(self, n: int, num: int, den: int):
        self.n, self.num, self.den = n, num, den

    def needed(self, a, b):
        """The least |A & B| of a link."""
        return -(-self.num * (a + b) // (self.num + self.den))

    def differ(self, a: int, b: int) -> int:
        """The most elements in which linking sets of these sizes differ."""
        return (a + b) * (self.den - self.num) // (self.den + self.num)

    def largest_partner(self, a: int) -> int:
        return a * self.den // self.num

    def bands(self, most: int) -> list[tuple[int, int]]:
        out, lo = [], 1
        while lo <= most:
            hi = max(lo + 1, int(lo * BAND))
            out.append((lo, hi))
            lo = hi
        return out


_BANDS: dict[tuple, list[tuple[int, int]]] = {}


def _band_of(rule: Rule, a: int) -> tuple[int, list[tuple[int, int]]]:
    key = (rule.num, rule.den)
    bands = _BANDS.get(key)
    if bands is None or bands[-1][1] <= 2 * a + 2:
        bands = _BANDS[key] = rule.bands(4 * a + 1000)
    lo, hi = 0, len(bands) - 1
    while lo < hi:
        mid = (lo + hi) // 2
        if bands[mid][1] <= a:
            lo = mid + 1
        else:
            hi = mid
    return lo, bands


def keys_of(s: np.ndarray, rule: Rule) -> np.ndarray:
    """The keys under which a set meets every set that it may link to, equal ones apart."""
    a = len(s)
    if not a:
        return np.empty(0, dtype=_U64)
    band, bands = _band_of(rule, a)
    tiles = [band]
    if rule.largest_partner(a) >= bands[band][1]:
        tiles.append(band + 1)  # as a guest of the band above
    out = []
    for t in tiles:
        hi = bands[t][1]
        b = min(rule.largest_partner(a), hi - 1)
        k = rule.differ(a, b)
        if k == 0:
            continue  # only equal sets link
        p = int(SPARE * rule.differ(hi - 1, hi - 1)) + 2
        part = ((s >> np.uint64(32)) * np.uint64(p)) >> np.uint64(32)  # ascends with s
        first = np.flatnonzero(np.concatenate(([True], part[1:] != part[:-1])))
        size = np.diff(np.append(first, a))
        ids = part[first]
        content = np.add.reduceat(_mix(s * _M1), first)
        if len(ids) < k + 1:  # empty parts may be what two sets agree in
            empty = np.setdiff1d(np.arange(p, dtype=_U64), ids, assume_unique=True)
            ids = np.concatenate((ids, empty))
            size = np.concatenate((size, np.zeros(len(empty), dtype=size.dtype)))
            content = np.concatenate((content, np.zeros(len(empty), dtype=_U64)))
        # a total order on (part, content), fullest first; the k + 1 first parts are kept
        mark = _mix(content + ids * _M3 + np.uint64(t))
        order = np.lexsort((mark, -size))[: k + 1]
        out.append(mark[order] ^ np.uint64(0x51ED270B0129))
    return np.concatenate(out) if out else np.empty(0, dtype=_U64)


def _binary(x: pa.Array | pa.ChunkedArray) -> list[bytes | None]:
    return x.to_pylist()


def _describe(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        for b in batches:
            sets = [shingle_set(t, n) for t in _binary(b.column("text"))]
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array([len(s) for s in sets], pa.int64()), pa.array([xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets], pa.binary()), pa.array([bitmap(s) if len(s) else None for s in sets], pa.binary())],
                names=["doc_id", "n", "dig", "bm"],
            )

    return run


def _keys(rule: Rule):
    """(at, key, node, pivot): of each key one row for the shuffle, and one for each further document of this task.

    Documents of the task with an equal set are left out but for the first: their sets are tied by digest.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        keys: list[np.ndarray] = []
        nodes: list[np.ndarray] = []
        seen: set[bytes] = set()
        held = 0

        def out() -> Iterator[pa.RecordBatch]:
            k, v = np.concatenate(keys), np.concatenate(nodes)
            order = np.lexsort((v, k))
            k, v = k[order], v[order]
            first = np.concatenate(([True], k[1:] != k[:-1]))
            pivot = v[np.flatnonzero(first)][np.cumsum(first) - 1]
            at = np.where(first, k, _mix(k + v.astype(_U64) * _M1)).view(np.int64)
            k = k.view(np.int64)
            for i in range(0, len(k), 100_000):
                yield pa.RecordBatch.from_arrays([pa.array(x[i : i + 100_000]) for x in (at, k, v, pivot)], names=["at", "key", "node", "pivot"])

        for b in batches:
            for d, t in zip(b.column("doc_id").to_pylist(), _binary(b.column("text"))):
                s = shingle_set(t, rule.n)
                if len(s) == 0:
                    continue
                dig = xxhash.xxh3_128_digest(s.tobytes())
                if dig in seen:
                    continue
                seen.add(dig)
                k = keys_of(s, rule)
                if len(k):
                    keys.append(k)
                    nodes.append(np.full(len(k), d, dtype=np.int64))
                    held += len(k)
            if held > HELD_KEYS:
                yield from out()
                keys, nodes, seen, held = [], [], set(), 0
        if held:
            yield from out()

    return run


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
    """(key, node) of the keys that more than one document has."""
    got = [b for b in batches if b.num_rows]
    if not got:
        return
    t = pa.Table.from_batches(got)
    k, v, p = (t.column(c).to_numpy() for c in ("key", "node", "pivot"))
    local = v != p  # these have met already, in the task that they come from
    kk, vv = k[~local], v[~local]
    order = np.argsort(kk, kind="stable")
    kk, vv = kk[order], vv[order]
    many = np.zeros(len(kk), dtype=bool)
    many[1:] = kk[1:] == kk[:-1]
    many[:-1] |= many[1:]
    keys, nodes = np.concatenate((kk[many], k[local], k[local])), np.concatenate((vv[many], v[local], p[local]))
    for i in range(0, len(keys), 100_000):
        yield pa.RecordBatch.from_arrays([pa.array(keys[i : i + 100_000]), pa.array(nodes[i : i + 100_000])], names=["key", "node"])


def _bound(rule: Rule):
    """Keeps the pairs whose bit counts allow a link."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        for b in batches:
            keep = []
            for na, ba, nb, bb in zip(*(b.column(c).to_pylist() for c in ("na", "ba", "nb", "bb"))):
                x, y = np.frombuffer(ba, np.uint8), np.frombuffer(bb, np.uint8)
                w = min(len(x), len(y))
                x, y = _fold(x, w), _fold(y, w)
                both = min(na - int(np.bitwise_count(x & ~y).sum()), nb - int(np.bitwise_count(y & ~x).sum()))
                keep.append(both >= rule.needed(na, nb))
            yield b.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def _blocks(rule: Rule):
    """Pairs of a key's block pair that are in different components and whose bit counts allow a link."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        for g in sorted_groups(batches, ["key", "i", "j"]):
            node, comp, n, side = (g.column(c).to_numpy() for c in ("node", "comp", "n", "side"))
            i, j = g.column("i")[0].as_py(), g.column("j")[0].as_py()
            raw = [np.frombuffer(x, np.uint8) for x in g.column("bm").to_pylist()]
            w = min(map(len, raw))
            bm = np.stack([_fold(x, w) for x in raw]).view(np.uint64)
            left = np.flatnonzero(side == 0) if i != j else np.arange(len(node))
            right = np.flatnonzero(side == 1) if i != j else left
            for x in left:
                ok = right if i != j else right[right > x]
                ok = ok[comp[ok] != comp[x]]
                if not len(ok):
                    continue
                ok = ok[(np.minimum(n[ok], n[x]) * rule.den >= rule.num * np.maximum(n[ok], n[x]))]
                if not len(ok):
                    continue
                y = bm[ok]
                both = np.minimum(n[x] - np.bitwise_count(bm[x] & ~y).sum(axis=1, dtype=np.int64), n[ok] - np.bitwise_count(y & ~bm[x]).sum(axis=1, dtype=np.int64))
                ok = ok[both >= rule.needed(n[ok], n[x])]
                if len(ok):
                    a, b = np.minimum(node[ok], node[x]), np.maximum(node[ok], node[x])
                    yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    return run


def _intersect(rule: Rule):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        last: tuple[bytes, np.ndarray] | None = None
        for b in batches:
            keep = []
            for ta, tb in zip(_binary(b.column("ta")), _binary(b.column("tb"))):
                if last is None or last[0] != ta:
                    last = (ta, shingle_set(ta, rule.n))
                x, y = last[1], shingle_set(tb, rule.n)
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(len(x) > 0 and len(y) > 0 and rule.den * both >= rule.num * (len(x) + len(y) - both))
            yield b.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def _verified(pairs: DataFrame, described: DataFrame, docs: DataFrame, rule: Rule) -> DataFrame:
    """The pairs (a, b) that link: by bit counts first, then by their whole texts."""
    d = described.select("doc_id", "n", "bm")
    with_bits = pairs.join(d.select(F.col("doc_id").alias("a"), F.col("n").alias("na"), F.col("bm").alias("ba")), "a").join(d.select(F.col("doc_id").alias("b"), F.col("n").alias("nb"), F.col("bm").alias("bb")), "b")
    likely = saved(map_arrow(with_bits, _bound(rule), "a long, b long", 4096))
    ids = likely.select(F.col("a").alias("doc_id")).union(likely.select("b")).distinct()
    texts = saved(docs.join(ids, "doc_id", "left_semi"))
    both = likely.join(texts.select(F.col("doc_id").alias("b"), F.col("text").alias("tb")), "b").join(texts.select(F.col("doc_id").alias("a"), F.col("text").alias("ta")), "a")
    return map_arrow(both, _intersect(rule), "a long, b long")


def similar_groups(docs: DataFrame, n: int = 5, num: int = 80, den: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id) for each row of docs.

    Rows link at a Jaccard similarity of num / den or more on their sets of distinct n-word shingles (a
    shorter text: its whole word sequence). component_id is the smallest doc_id that links reach. A
    null, empty or blank text has no shingles and links with nothing. Rows with equal doc_id count as
    one document that links as each of its rows does; a row without doc_id keeps a null component_id.
    Only id_col and text_col are read. No rows: an empty result.
    """
    spark = docs.sparkSession
    rule = Rule(n, num, den)
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    described = saved(map_arrow(docs, _describe(n), "doc_id long, n long, dig binary, bm binary"))
    known = described.where("doc_id is not null and n > 0")
    lowest = saved(known.groupBy("dig").agg(F.min("doc_id").alias("rep")))  # written, so that Spark can split a hot digest in the join
    classes = saved(known.join(lowest, "dig").select("doc_id", "rep").distinct())

    usable = docs.where("doc_id is not null and text is not null")
    keys = map_arrow(usable, _keys(rule), "at long, key long, node long, pivot long")
    # a set of n has at most as many keys as elements in which a partner of the largest size can differ, and one, in each of two tiles
    most = F.floor(F.col("n") * (1 + den / num) * (den - num) / (den + num)) + 1
    parts = parts_for(spark, 2 * int(known.agg(F.sum(most)).first()[0] or 0), MET_KEYS)
    met = saved(map_arrow(keys.repartition(parts, "at").select("key", "node", "pivot"), _meet, "key long, node long", 16_384))
    reps = classes.select(F.col("doc_id").alias("node"), "rep")
    members = saved(met.join(reps, "node").select("key", F.col("rep").alias("node")).distinct())

    # The most central document of a key, the one whose keys many share, is the one to compare the others with first.
    size = members.groupBy("key").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    central = members.join(size, "key").groupBy("node").agg(F.sum("size").alias("weight"))
    pivots = members.join(central, "node").groupBy("key").agg(F.max_by("node", F.struct("weight", F.negative("node"))).alias("pivot"))
    best = members.join(pivots, "key").where("node <> pivot").groupBy("node", "pivot").agg(F.count(F.lit(1)).alias("c")).groupBy("node").agg(F.max_by("pivot", F.struct("c", F.negative("pivot"))).alias("pivot"))
    tried = saved(best.select(F.least("node", "pivot").alias("a"), F.greatest("node", "pivot").alias("b")).distinct())
    links = saved(_verified(tried, described, docs, rule))

    # rows that share a doc_id tie the classes that they are in
    shared = classes.groupBy("doc_id").agg(F.min("rep").alias("a"), F.count(F.lit(1)).alias("c")).where("c > 1")
    links = links.union(shared.join(classes, "doc_id").select("a", F.col("rep").alias("b")))
    first = components(links)
    placed = saved(members.join(first, "node", "left").select("key", "node", F.coalesce("comp", "node").alias("comp")))
    open_keys = placed.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count(F.lit(1)).alias("c")).where("lo <> hi").select("key", F.ceil(F.col("c") / BLOCK).cast("int").alias("blocks"))
    left = placed.join(open_keys, "key").withColumn("blk", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    left = left.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    left = left.join(described.select(F.col("doc_id").alias("node"), "n", "bm"), "node")
    left = left.select("key", F.least("blk", "other").alias("i"), F.greatest("blk", "other").alias("j"), F.when(F.col("blk") <= F.col("other"), 0).otherwise(1).alias("side"), "node", "comp", "n", "bm")
    more = left.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j").mapInArrow(_blocks(rule), "a long, b long").distinct().join(tried, ["a", "b"], "left_anti")
    more = saved(more)
    if not more.isEmpty():
        links = links.union(saved(_verified(more, described, docs, rule)))
        first = components(links)
    comp = classes.join(first.withColumnRenamed("node", "rep"), "rep", "left").groupBy("doc_id").agg(F.min(F.coalesce("comp", "rep")).alias("component_id"))
    out = described.select("doc_id", F.col("n").alias("n_shingles")).join(comp, "doc_id", "left")
    return out.select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))


def op10_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar_groups(table(spark, sf_dir, "documents"), n=4, num=85, den=100)
