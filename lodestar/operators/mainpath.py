"""Main-path analysis of an acyclic edge table (src, dst): path counts, arc weights and searches.

Path counts are exact whatever their size: whole numbers of LIMB digits each in an array, summed limb by
limb with the sums combined before the shuffle. Arcs from sources and to sinks are counted at once; of those between, levels
are peeled off, so that a round reads only the arcs of the levels left, until REST arcs are left for one task, however deep they
lie. Counting joins each arc once. Weights `w` are arrays of one length, most significant limb first, so Spark orders them like
the numbers; `digits` writes them out.
"""

from __future__ import annotations

import math
from fractions import Fraction

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .fixpoint import REST, fixpoint, in_one_task, materialised, scratch
from .graph import coded, vertices
from .graph import cycles as strong_cycles

#: Decimal digits of a limb: products of two and sums of millions of them fit 64 bits.
LIMB = 6
BASE = 10**LIMB
#: Limbs that a number has free before it takes part in a sum.
SPARE = 2


def digits(w: Column | str) -> Column:
    """The number as a string of decimal digits."""
    w = F.col(w) if isinstance(w, str) else w
    return F.regexp_replace(F.array_join(F.transform(w, lambda x: F.lpad(x.cast("string"), LIMB, "0")), ""), "^0+(?!$)", "")


def _carried(x: Column) -> Column:
    """Limbs, least significant first, with what exceeds a limb carried on; the last ones must have been free."""
    start = F.struct(F.lit(0).cast("long").alias("c"), F.array().cast("array<long>").alias("o"))

    def add(s: Column, d: Column) -> Column:
        t = s["c"] + d
        return F.struct(F.call_function("div", t, F.lit(BASE)).alias("c"), F.concat(s["o"], F.array(t % BASE)).alias("o"))

    return F.aggregate(x, start, add, lambda s: F.when(s["c"] == 0, s["o"]).otherwise(F.raise_error(F.lit("a path count outgrew its limbs")).cast("array<long>")))


def _plus(a: Column, b: Column) -> Column:
    """Sum of two numbers of one length, most significant limb first."""
    return F.reverse(_carried(F.zip_with(F.reverse(a), F.reverse(b), lambda x, y: x + y)))


def _times(a: Column, c: int) -> Column:
    """A number, most significant limb first, times a whole number below BASE."""
    return F.reverse(_carried(F.transform(F.reverse(a), lambda x: x * c)))


def starts(e: DataFrame) -> DataFrame:
    """(id) without in-arcs."""
    return e.select(F.col("src").alias("id")).distinct().join(e.select(F.col("dst").alias("id")).distinct(), "id", "left_anti")


def _marked(e: DataFrame) -> DataFrame:
    """(src, dst, entered, goes), written: whether any arc enters the source, and whether any leaves the target."""
    both = materialised(e.select(F.col("src").alias("id")).distinct().join(e.select(F.col("dst").alias("id")).distinct(), "id", "left_semi"))
    of = lambda c, name: both.select(F.col("id").alias(c), F.lit(True).alias(name))
    no = F.lit(False)
    m = e.join(of("src", "entered"), "src", "left").join(of("dst", "goes"), "dst", "left")
    return materialised(m.select("src", "dst", F.coalesce("entered", no).alias("entered"), F.coalesce("goes", no).alias("goes")))


def _peeled(e: DataFrame, least: int = 0) -> tuple[str, list[int]]:
    """(folder, arcs of each level): arcs (src, dst) by the level of their source, one folder `at=<level>/rest=false` each. A cycle is an error.

    A level's sources are those that no arc enters any more; their arcs go, and only what is left is read in the next round. Once
    that is least arcs or fewer, they stay in the last `rest=true`.
    """
    spark, folder = e.sparkSession, scratch(e.sparkSession)
    rest, sizes = e.select("src", "dst"), []
    schema = rest.schema
    left = rest.count()
    while left > least:
        entered = rest.select(F.col("dst").alias("src")).distinct().withColumn("rest", F.lit(True))
        seen = Observation()
        parted = rest.join(entered, "src", "left").select("src", "dst", F.coalesce("rest", F.lit(False)).alias("rest"))
        parted.observe(seen, F.count_if("rest").alias("rest"), F.count_if(~F.col("rest")).alias("gone")).write.partitionBy("rest").parquet(f"{folder}/at={len(sizes)}")
        gone, left = seen.get["gone"], seen.get["rest"]
        if not gone:
            raise ValueError("the graph has a cycle")
        sizes.append(gone)
        if left:
            rest = spark.read.schema(schema).parquet(f"{folder}/at={len(sizes) - 1}/rest=true")
    return folder, sizes


def _by_level(e: DataFrame, folder: str) -> DataFrame:
    """(src, dst, at) of the arcs in the folder of `_peeled`, at the level of their source."""
    t = e.select("src", "dst").withColumn("rest", F.lit(True)).withColumn("at", F.lit(0))
    return e.sparkSession.read.schema(t.schema).parquet(folder).where("not rest").select("src", "dst", "at")


def _left(e: DataFrame, folder: str, sizes: list[int]) -> DataFrame:
    """The arcs (src, dst) that `_peeled` left: all if it took none."""
    e = e.select("src", "dst")
    t = e.withColumn("rest", F.lit(True))
    return e.sparkSession.read.schema(t.schema).parquet(f"{folder}/at={len(sizes) - 1}").where("rest").select("src", "dst") if sizes else e


def _in_order(first: list[int], to: list[int]) -> list[int]:
    """Vertices of `coded` arcs, each after all that have arcs to it; those on cycles and behind them are missing."""
    n = len(first) - 1
    missing = np.bincount(np.array(to, dtype=np.int64), minlength=n).tolist()
    order = [v for v in range(n) if not missing[v]]
    for v in order:
        for w in to[first[v] : first[v + 1]]:
            missing[w] -= 1
            if not missing[w]:
                order.append(w)
    return order


def _levels_in_task(arcs: pd.DataFrame) -> pd.DataFrame:
    """(src, dst, at): arcs at the level of their source; where a cycle is, all are at -1."""
    ids, s, first, to = coded(arcs["src"], arcs["dst"])
    level, order = [0] * len(ids), _in_order(first, to)
    for v in order:
        for w in to[first[v] : first[v + 1]]:
            level[w] = max(level[w], level[v] + 1)
    return arcs[["src", "dst"]].assign(at=np.array(level, dtype=np.int32)[s] if len(order) == len(ids) else np.int32(-1))


def _inner_levels(e: DataFrame) -> DataFrame:
    """(src, dst, at): arcs at the level of their source, the longest path that ends there."""
    folder, sizes = _peeled(e, REST)
    arcs = _left(e, folder, sizes)
    rest = materialised(in_one_task(arcs, _levels_in_task, arcs.withColumn("at", F.lit(0)).schema.simpleString()[len("struct<") : -1]))
    if not rest.where("at < 0").isEmpty():
        raise ValueError("the graph has a cycle")
    rest = rest.withColumn("at", F.col("at") + len(sizes))
    return _by_level(e, folder).union(rest) if sizes else rest


def levels(e: DataFrame) -> DataFrame:
    """(id, level): the longest path that ends at each vertex, one more than the highest source of its in-arcs. A cycle is an error."""
    e = materialised(e.select("src", "dst"))
    n = e.count()
    if not n:
        return vertices(e).select("id", F.lit(0).alias("level"))
    if n <= REST:
        arcs = _inner_levels(e)
    else:
        m = _marked(e)
        inner = _inner_levels(m.where("entered and goes"))
        high = inner.groupBy(F.col("dst").alias("src")).agg((F.max("at") + 1).alias("high"))
        arcs = m.join(high, "src", "left").select("src", "dst", F.when(F.col("entered"), 1 + F.coalesce("high", F.lit(0))).otherwise(0).alias("at"))
    arcs = materialised(arcs)
    ends = arcs.groupBy(F.col("dst").alias("id")).agg((F.max("at") + 1).alias("level"))
    return ends.union(arcs.where("at = 0").select(F.col("src").alias("id"), F.lit(0).alias("level")).distinct())


def _fitted(x: Column | str, n: int) -> Column:
    """Limbs, least significant first, with zeros up to n of them."""
    return F.concat(x, F.array_repeat(F.lit(0).cast("long"), F.lit(n) - F.size(x)))


def _one(n: int) -> Column:
    return F.array(F.lit(1).cast("long"), *[F.lit(0).cast("long")] * (n - 1))


def _summed(n: int) -> Column:
    return F.array(*(F.sum(F.get("limbs", F.lit(i))) for i in range(n)))


def _limbs(x: int) -> list[int]:
    out = []
    while x:
        x, low = divmod(x, BASE)
        out.append(low)
    return out


def _sums_in_task(every: bool):
    """(id, limbs): what arcs (src, dst) bring to their targets, beside (id, limbs) that came to the sources before; limbs are null where a cycle is."""

    def run(arcs: pd.DataFrame, came: pd.DataFrame) -> pd.DataFrame:
        ids, _, first, to = coded(arcs["src"], arcs["dst"])
        before = [int(every)] * len(ids)
        at = {x: i for i, x in enumerate(ids.tolist())}
        for x, limbs in zip(came["id"].tolist(), came["limbs"]):
            n = 0
            for limb in reversed(limbs.tolist()):
                n = n * BASE + limb
            before[at[x]] += n
        brought, order = [0] * len(ids), _in_order(first, to)
        if len(order) < len(ids):
            return pd.DataFrame({"id": ids[:1], "limbs": [None]})
        for v in order:
            n = before[v] + brought[v]
            for w in to[first[v] : first[v + 1]]:
                brought[w] += n
        ends = [v for v in range(len(ids)) if brought[v]]
        return pd.DataFrame({"id": ids[ends], "limbs": [_limbs(brought[v]) for v in ends]})

    return run


def _counts(inner: DataFrame, base: DataFrame, every: bool) -> tuple[DataFrame, int]:
    """((id, n), limbs of n): the paths that end at each vertex which arcs enter and leave, from a source or (every) from any vertex; sources have one.

    inner are the arcs between such vertices, base (id, n) their arcs from sources. What a level hands on is summed for each
    target, beside whether the target has arcs at a later level; only such sums are read on the way. Each arc is joined once.
    """
    spark = inner.sparkSession
    folder, sizes = _peeled(inner, REST)
    of = lambda k: spark.read.schema(inner.select("src", "dst").schema).parquet(f"{folder}/at={k}/rest=false")
    rest = _left(inner, folder, sizes)
    handed = scratch(spark)
    id_type = inner.schema["src"].dataType.simpleString()
    read = lambda: spark.read.schema(f"id {id_type}, limbs array<long>, goes boolean").parquet(handed)
    # no count is more than the largest one before it times the most in-arcs of a vertex, and one
    entering = inner.groupBy(F.col("dst").alias("id")).agg(F.count(F.lit(1)).alias("n")).union(base)
    most = entering.groupBy("id").agg(F.sum("n").alias("n")).agg(F.max("n")).first()[0] or 0
    step = math.log10(2 + most)
    size, grown = SPARE + 1, 0.0
    total = lambda t, n, every=every: t.groupBy("id").agg(_carried(_summed(n)).alias("limbs")).select("id", (_carried(F.zip_with("limbs", _one(n), lambda x, y: x + y)) if every else F.col("limbs")).alias("limbs"))

    def used(t: DataFrame) -> int:
        top = F.size("limbs") - F.coalesce(F.array_position(F.transform(F.reverse("limbs"), lambda x: x > 0), True), F.size("limbs")) + 1
        got = t.agg(F.max(top), F.count_if(F.col("limbs").isNull())).first()
        if got[1]:
            raise ValueError("the graph has a cycle")
        return got[0] or 1

    def came(arcs: DataFrame, n: int) -> DataFrame:
        """What came to the sources of arcs."""
        return read().where("goes").select("id", _fitted("limbs", n).alias("limbs")).join(arcs.select(F.col("src").alias("id")).distinct(), "id", "left_semi")

    for k in range(len(sizes) + 1):
        if not k:
            on = base.select("id", _carried(_fitted(F.array("n"), size)).alias("limbs"))
            later = inner
        else:
            arcs, later = of(k - 1), _left(inner, folder, sizes[:k])
            on = arcs.join(total(came(arcs, size), size).withColumnRenamed("id", "src"), "src").groupBy(F.col("dst").alias("id")).agg(_carried(_summed(size)).alias("limbs"))
        on = on.join(later.select(F.col("src").alias("id")).distinct().withColumn("goes", F.lit(True)), "id", "left").select("id", "limbs", F.coalesce("goes", F.lit(False)).alias("goes"))
        on.write.partitionBy("goes").parquet(f"{handed}/at={k}")
        grown += step
        if grown + step > LIMB * (SPARE - 1):  # what was free may be used up: measure
            size, grown = max(size, used(read()) + SPARE + 1), 0.0  # sums of a vertex are not added up yet
    brought = in_one_task(rest, _sums_in_task(every), f"id {id_type}, limbs array<long>", total(came(rest, size), size, False))
    brought.withColumn("goes", F.lit(False)).write.partitionBy("goes").parquet(f"{handed}/at={len(sizes) + 1}")
    size = max(size, used(read()) + SPARE)
    n = materialised(total(read().select("id", _fitted("limbs", size).alias("limbs")), size))
    size = used(n)
    return n.select("id", F.slice("limbs", 1, size).alias("n")), size


def _into(m: DataFrame, every: bool) -> tuple[DataFrame, int]:
    """`_counts` of arcs as `_marked`."""
    base = m.where("goes and not entered").groupBy(F.col("dst").alias("id")).agg(F.count(F.lit(1)).alias("n"))
    return _counts(m.where("entered and goes").select("src", "dst"), base, every)


def path_counts(e: DataFrame, every: bool = False) -> DataFrame:
    """(id, n): paths that end at each vertex and begin at a source (or at every vertex, itself included), as digits."""
    e = materialised(e.select("src", "dst"))
    if e.isEmpty():
        return e.select(F.col("src").alias("id"), F.lit("1").alias("n"))
    m = _marked(e)
    n, size = _into(m, every)
    size += SPARE
    sinks = m.where("not goes").join(n.withColumnRenamed("id", "src"), "src", "left").select(F.col("dst").alias("id"), F.coalesce(_fitted("n", size), _one(size)).alias("limbs"))
    sinks = sinks.groupBy("id").agg(_carried(_summed(size)).alias("limbs"))
    if every:
        sinks = sinks.select("id", _carried(F.zip_with("limbs", _one(size), lambda x, y: x + y)).alias("limbs"))
    n = n.union(sinks).select("id", digits(F.reverse("n")).alias("n"))
    return materialised(n.union(starts(e).select("id", F.lit("1").alias("n"))))


#: Whether paths begin at every vertex, and whether they end at every vertex.
WEIGHTS = {"spc": (False, False), "splc": (True, False), "spnp": (True, True)}


def arc_weights(e: DataFrame, kind: str = "spc") -> DataFrame:
    """(src, dst, w): paths through each arc: those into its source times those out of its target."""
    if kind not in WEIGHTS:
        raise ValueError(f"unknown weight {kind!r}")
    e = materialised(e.select("src", "dst"))
    if e.isEmpty():
        return e.withColumn("w", F.array(F.lit(0).cast("long")))
    begin, end = WEIGHTS[kind]
    m = _marked(e)
    back = m.select(F.col("dst").alias("src"), F.col("src").alias("dst"), F.col("goes").alias("entered"), F.col("entered").alias("goes"))
    (n_in, a), (n_out, b) = _into(m, begin), _into(back, end)
    both = e.join(n_in.select(F.col("id").alias("src"), F.col("n").alias("a")), "src", "left").join(n_out.select(F.col("id").alias("dst"), F.col("n").alias("b")), "dst", "left")
    both = both.select("src", "dst", F.coalesce("a", _one(a)).alias("a"), F.coalesce("b", _one(b)).alias("b"))
    # two limbs more: what the last product carries, and one free for sums of weights
    product = F.expr(f"concat(transform(sequence(0, {a + b - 2}), k -> aggregate(sequence(greatest(0, k - {b - 1}), least(k, {a - 1})), 0L, (s, i) -> s + a[i] * b[k - i])), array(0L, 0L))")
    return materialised(both.select("src", "dst", F.reverse(_carried(product)).alias("w")))


def _positive(w: str = "w") -> Column:
    return F.exists(w, lambda x: x > 0)


def _reached_in_task(arcs: pd.DataFrame, start: pd.DataFrame) -> pd.DataFrame:
    """(id) that arcs (src, dst) reach from start (id), itself included."""
    ids, _, first, to = coded(arcs["src"], arcs["dst"])
    seen = np.isin(ids, np.asarray(start["id"])).tolist()
    path = [v for v in range(len(ids)) if seen[v]]
    for v in path:
        for w in to[first[v] : first[v + 1]]:
            if not seen[w]:
                seen[w] = True
                path.append(w)
    return pd.DataFrame({"id": ids[path]})


def _greedy(arcs: DataFrame, start: DataFrame, tolerance: float = 0.0) -> DataFrame:
    """Arcs that a walk from start takes which follows, at each vertex, all arcs of (1 - tolerance) of its best or more.

    A walk goes on only along arcs that start or another one leads to, and behind which there are more; they are trimmed until
    REST are left for one task, or none goes any more.
    """
    top = F.max("w").over(W.partitionBy("src"))
    share = 1 - Fraction(str(tolerance)).limit_denominator(BASE // 10)
    near = _times(F.col("w"), share.denominator) >= _times(F.col("top"), share.numerator) if tolerance else F.col("w") == F.col("top")
    good = materialised(arcs.withColumn("top", top).where(_positive("top")).where(near).select("src", "dst", "w"))
    start = materialised(start.select("id").distinct())
    on = materialised(good.select("src", "dst").join(good.select(F.col("src").alias("dst")).distinct(), "dst", "left_semi").select("src", "dst"))
    n = on.count()
    while n > REST:
        on = materialised(on.join(on.select(F.col("dst").alias("src")).union(start.select("id")).distinct(), "src", "left_semi").select("src", "dst"))
        n, before = on.count(), n
        if n == before:
            break

    def step(now: DataFrame) -> DataFrame:
        return now.union(on.join(now.withColumnRenamed("id", "src"), "src", "left_semi").select(F.col("dst").alias("id"))).distinct()

    if n > REST:
        visited = fixpoint(start, step)
    else:
        begin = start.join(on.select(F.col("src").alias("id")).distinct(), "id", "left_semi")
        visited = start.union(in_one_task(on, _reached_in_task, f"id {on.schema['src'].dataType.simpleString()}", begin))
    return good.join(visited.withColumnRenamed("id", "src"), "src", "left_semi").select("src", "dst", "w")


def _back(arcs: DataFrame) -> DataFrame:
    return arcs.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "w")


def local_forward(arcs: DataFrame, **_: object) -> DataFrame:
    return _greedy(arcs, starts(arcs))


def local_backward(arcs: DataFrame, **_: object) -> DataFrame:
    return _back(_greedy(_back(arcs), starts(_back(arcs))))


def multi_local(arcs: DataFrame, tolerance: float = 0.0, **_: object) -> DataFrame:
    return _greedy(arcs, starts(arcs), min(1.0, max(0.0, tolerance)))


def global_path(arcs: DataFrame, **_: object) -> DataFrame:
    """The arcs of one path of the largest sum from a source to a sink; ties go to the smaller vertices."""
    arcs = materialised(arcs)
    size = arcs.agg(F.max(F.size("w"))).first()[0] or 1
    nothing = F.array_repeat(F.lit(0).cast("long"), size)
    best = materialised(starts(arcs).select("id", nothing.alias("best"), F.lit(None).cast(arcs.schema["src"].dataType).alias("pred")))
    wave = best.select("id", "best")
    while True:  # values that grew go on
        came = arcs.join(wave.withColumnRenamed("id", "src"), "src").select(F.col("dst").alias("id"), _plus(F.col("best"), F.col("w")).alias("cand"), "src")
        came = came.groupBy("id").agg(F.max(F.struct("cand", (-F.col("src")).alias("neg"))).alias("m")).select("id", F.col("m.cand").alias("cand"), (-F.col("m.neg")).alias("via"))
        old = best.join(came, "id", "full_outer")
        grew = F.col("best").isNull() | (F.col("cand") > F.col("best")) | ((F.col("cand") == F.col("best")) & (F.col("via") < F.col("pred")))
        take = F.col("cand").isNotNull() & grew
        nxt = materialised(old.select("id", F.when(take, F.col("cand")).otherwise(F.col("best")).alias("best"), F.when(take, F.col("via")).otherwise(F.col("pred")).alias("pred"), (take & (F.col("best").isNull() | (F.col("cand") > F.col("best")))).alias("changed")))
        best = nxt.select("id", "best", "pred")
        wave = nxt.where("changed").select("id", "best")
        if wave.isEmpty():
            break
    sinks = starts(_back(arcs))
    end = best.join(sinks, "id").orderBy(F.desc("best"), "id").select("id").limit(1)

    def step(now: DataFrame) -> DataFrame:
        return now.union(best.join(now, "id", "left_semi").where("pred is not null").select(F.col("pred").alias("id"))).distinct()

    on = fixpoint(end, step)
    return best.join(on, "id", "left_semi").where("pred is not null").select(F.col("pred").alias("src"), F.col("id").alias("dst")).join(arcs, ["src", "dst"]).select("src", "dst", "w")


def key_route(arcs: DataFrame, k: int = 1, **_: object) -> DataFrame:
    """The k heaviest arcs (ties by vertices), what follows forward from their targets and backward from their sources."""
    seeds = arcs.where(_positive()).orderBy(F.desc("w"), "src", "dst").limit(max(0, k))
    seeds = materialised(seeds)
    on = _greedy(arcs, seeds.select(F.col("dst").alias("id")))
    back = _back(_greedy(_back(arcs), seeds.select(F.col("src").alias("id"))))
    return seeds.select("src", "dst", "w").union(on).union(back).distinct()


SEARCHES = {"local-forward": local_forward, "local-backward": local_backward, "global": global_path, "key-route": key_route, "multi-local": multi_local}


# -- cycles -------------------------------------------------------------------------------------

def shrink(e: DataFrame, papers: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(edges, members): strong components become one vertex, the oldest paper (unknown year last), then the most cited, then the smallest id.

    members is (id, rep, size) of every vertex. Arcs inside a component and loops go.
    """
    info = strong_cycles(e).join(papers.select(F.col("paper_id").alias("id"), "year", "citation_count"), "id", "left")
    first = F.min(F.struct(F.coalesce("year", F.lit(99999)), F.negative(F.coalesce("citation_count", F.lit(0))), F.col("id").alias("id")))
    by = info.groupBy("scc").agg(first.alias("first"), F.count(F.lit(1)).alias("size"))
    held = materialised(info.join(by, "scc").select("id", F.col("first.id").alias("rep"), "size"))
    members = vertices(e).join(held, "id", "left").select("id", F.coalesce("rep", "id").alias("rep"), F.coalesce("size", F.lit(1).cast("long")).alias("size"))
    out = e.join(held.select(F.col("id").alias("src"), F.col("rep").alias("s")), "src", "left").join(held.select(F.col("id").alias("dst"), F.col("rep").alias("d")), "dst", "left")
    out = out.select(F.coalesce("s", "src").alias("src"), F.coalesce("d", "dst").alias("dst"))
    return out.where("src <> dst").distinct(), members


def preprint_transform(e: DataFrame) -> DataFrame:
    """Edges (src, src_copy, dst, dst_copy) after each vertex of a strong component got a preprint copy.

    Arcs out of a component leave from the copies, arcs inside it go, and each member points to every
    member's copy, its own included: k * k arcs for a component of k, which is what the method asks for.
    """
    held = strong_cycles(e)
    of = lambda c: held.select(F.col("id").alias(c), F.col("scc").alias(f"c_{c}"))
    kept = e.where("src <> dst").select("src", "dst").distinct().join(of("src"), "src", "left").join(of("dst"), "dst", "left").where("not coalesce(c_src = c_dst, false)")
    kept = kept.select("src", F.col("c_src").isNotNull().alias("src_copy"), "dst", F.lit(False).alias("dst_copy"))
    new = held.withColumnRenamed("id", "src").join(held.withColumnRenamed("id", "dst"), "scc").select("src", F.lit(False).alias("src_copy"), "dst", F.lit(True).alias("dst_copy"))
    return kept.union(new)  # no arc of the one kind is one of the other


def has_copies(e: DataFrame, cycles: str) -> bool:
    """Whether main_path gives ids as 2 * id, and 2 * id + 1 for a preprint copy: that policy, on a graph with cycles."""
    return cycles == "preprint" and not strong_cycles(e).isEmpty()


def main_path(e: DataFrame, papers: DataFrame | None = None, weight: str = "spc", search: str = "key-route", cycles: str = "shrink", **options: object) -> tuple[DataFrame, DataFrame]:
    """(arcs, vertices) of the main path: arcs (src, dst, w as digits), vertices (id, role, level) by their degrees inside it."""
    if search not in SEARCHES:
        raise ValueError(f"unknown search {search!r}")
    e = e.where("src <> dst").distinct()
    if cycles == "shrink":
        if papers is None:
            raise ValueError("shrinking needs papers")
        e, _members = shrink(e, papers)
    elif cycles == "preprint":
        t = preprint_transform(e)
        if t.where("src_copy or dst_copy").isEmpty():
            e = t.select("src", "dst")
        else:  # ids of originals and copies on one scale: 2 * id and 2 * id + 1
            e = t.select((2 * F.col("src") + F.col("src_copy").cast("int")).alias("src"), (2 * F.col("dst") + F.col("dst_copy").cast("int")).alias("dst"))
    else:
        raise ValueError(f"unknown cycle policy {cycles!r}")
    arcs = materialised(SEARCHES[search](arc_weights(materialised(e), weight), **options))
    ins, outs = arcs.select(F.col("dst").alias("id"), F.lit(1).alias("i")).distinct(), arcs.select(F.col("src").alias("id"), F.lit(1).alias("o")).distinct()
    role = F.when(F.col("i").isNull(), "source").when(F.col("o").isNull(), "sink").otherwise("intermediate")
    v = levels(arcs.select("src", "dst")).join(ins, "id", "left").join(outs, "id", "left").select("id", role.alias("role"), "level")
    return arcs.withColumn("w", digits("w")), v
