"""Graphs as edge tables: building, PageRank, components, collaboration, edge similarity.

Edges are (src, dst), from the cited to the citing paper.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.vectors import cosine_or_zero
from .fixpoint import REST, fixpoint, in_one_task, materialised, quantile, scratch

#: Damping, and the weight of edges in a graph without any similarity.
DAMPING = 0.85
LEAST_WEIGHT = 1e-5
#: Out-edges of a vertex that one row lists, but for chance.
LIST = 1024


def citation_edges(papers: DataFrame) -> DataFrame:
    """Edges among papers (paper_id, references, and if there: supporting_papers, source), without loops and repeats.

    A supporting paper of a forward-found paper is cited by it; of any other it is the citing one.
    """
    ids = papers.select("paper_id").distinct()
    e = papers.select(F.explode("references").alias("src"), F.col("paper_id").alias("dst"))
    if "supporting_papers" in papers.columns:
        s = papers.select("paper_id", "source", F.explode("supporting_papers").alias("sp"))
        forward = F.col("source") == "forward"
        e = e.union(s.select(F.when(forward, F.col("sp")).otherwise(F.col("paper_id")), F.when(forward, F.col("paper_id")).otherwise(F.col("sp"))))
    return induced(e, ids)


def induced(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """The distinct edges between the papers of ids (paper_id)."""
    e = edges.where("src <> dst").distinct()
    return e.join(ids.withColumnRenamed("paper_id", "src"), "src", "left_semi").join(ids.withColumnRenamed("paper_id", "dst"), "dst", "left_semi").select("src", "dst")


def vertices(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("src").alias("id")).union(edges.select("dst")).distinct()


def undirected(edges: DataFrame) -> DataFrame:
    """(a, b), a < b; mutual edges are one."""
    return edges.where("src <> dst").select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).distinct()


def pagerank(edges: DataFrame, rounds: int = 20, damping: float = DAMPING, ids: DataFrame | None = None, seeds: DataFrame | None = None, tolerance: float | None = None) -> DataFrame:
    """(id, score): power iteration; the mass of vertices without out-edges follows the reset vector.

    The reset is even over all vertices, or over the seeds (id). With a tolerance the rounds end once
    the scores move by less in all. What a round sends along the edges is a term of its own, linear in the reset: the scores of any
    round are the terms so far, weighed by what the loose mass was in the rounds between. So only vertices that the
    last term reached send, and where no cycle is left the terms end. Out-edges are lists of bounded length; once
    half of them can send no more they are left out. A term's sums are numbers on the driver.
    """
    edges = materialised(edges.select("src", "dst"))
    deg = edges.select(F.col("src").alias("id"), F.lit(1).cast("long").alias("one")).union(edges.select("dst", F.lit(0).cast("long"))).groupBy("id").agg(F.sum("one").alias("deg"))
    if ids is not None:
        deg = ids.select("id").join(deg, "id", "left").select("id", F.coalesce("deg", F.lit(0).cast("long")).alias("deg"))
    v = materialised(deg)
    n = v.count()
    if n == 0:
        return v.select("id", F.lit(0.0).alias("score"))
    even = True
    if seeds is not None:
        s = seeds.select("id").distinct().withColumn("is_seed", F.lit(True))
        v = v.join(s, "id", "left")
        k = v.where("is_seed").count()
        even = k == 0
        v = materialised(v.select("id", "deg", F.when(F.col("is_seed") & F.lit(k > 0), 1.0 / max(k, 1)).otherwise(0.0 if k else 1.0 / n).alias("reset")))
    else:
        v = v.withColumn("reset", F.lit(1.0 / n))
    held = edges if ids is None else edges.join(ids.select(F.col("id").alias("dst")), "dst", "left_semi")
    senders = v.where("deg > 0").select(F.col("id").alias("src"), F.ceil(F.col("deg") / LIST).cast("int").alias("blocks"))
    held = held.join(senders, "src").groupBy("src", F.pmod(F.xxhash64("dst"), F.col("blocks")).alias("block")).agg(F.collect_list("dst").alias("dsts"))
    held = materialised(held.select("src", "dsts"))

    folder = scratch(v.sparkSession)
    term = v.select("id", "deg", F.col("reset").alias("t"))
    sums = [F.coalesce(F.sum("t"), F.lit(0.0)), F.coalesce(F.sum(F.when(F.col("deg") == 0, F.col("t"))), F.lit(0.0)), F.coalesce(F.sum(F.when(F.col("t") > 0, F.col("deg"))), F.lit(0))]
    size, lost, live = term.agg(*sums).first()
    listed, sizes, losses, back, written = live, [size], [lost], [], 0
    for r in range(rounds):
        loose = losses[r] + sum(back[r - 1 - j] * losses[j] for j in range(r))
        back.append(1 - damping + damping * loose)
        size = lost = 0.0
        if live:
            if even and 2 * live < listed:  # what a later term reaches, an earlier one reached
                held, listed = materialised(held.join(term.where("deg > 0").select(F.col("id").alias("src")), "src", "left_semi")), live
            gives = term.where("deg > 0 and t > 0").select(F.col("id").alias("src"), (damping * F.col("t") / F.col("deg")).alias("t"))
            came = held.join(gives, "src").select(F.explode("dsts").alias("id"), "t").groupBy("id").agg(F.sum("t").alias("t"))
            written = r + 1
            came.join(v.select("id", "deg"), "id").select("id", "deg", "t").write.parquet(f"{folder}/round={written}")
            term = v.sparkSession.read.schema(v.select("id", "deg", F.lit(0.0).alias("t")).schema).parquet(f"{folder}/round={written}")
            size, lost, live = term.agg(*sums).first()
        sizes.append(size)
        losses.append(lost)
        # no less than what the scores moved in all
        moved = sizes[r + 1] + abs(back[0] - 1) * sizes[r] + sum(abs(back[r - j] - back[r - 1 - j]) * sizes[j] for j in range(r))
        if tolerance is not None and moved < tolerance:
            break
    last = len(back)
    weight = [back[last - 1 - j] for j in range(last)] + [1.0]
    if not written:
        return v.select("id", (F.lit(weight[0]) * F.col("reset")).alias("score"))
    terms = v.sparkSession.read.schema(T.StructType([*term.schema, T.StructField("round", T.IntegerType())])).option("basePath", folder).parquet(folder)
    came = terms.groupBy("id").agg(F.sum(F.col("t") * F.get(F.array(*map(F.lit, weight)), F.col("round"))).alias("came"))
    return v.join(came, "id", "left").select("id", (F.lit(weight[0]) * F.col("reset") + F.coalesce("came", F.lit(0.0))).alias("score"))


def components(edges: DataFrame, a: str = "src", b: str = "dst") -> DataFrame:
    """(id, comp): the smallest id that edges, taken both ways, reach.

    Each vertex points to its smallest neighbour if that is smaller, pointers jump until they end, and the graph is drawn
    together along them. What is left lies between vertices that had no smaller neighbour, so later rounds have few edges.
    """
    left = materialised(edges.where(F.col(a) != F.col(b)).select(F.least(a, b).alias("lo"), F.greatest(a, b).alias("hi")))
    moves: list[DataFrame] = []
    while not left.isEmpty():
        to = materialised(left.groupBy(F.col("hi").alias("id")).agg(F.min("lo").alias("to")))
        while True:
            nxt = materialised(to.join(to.select(F.col("id").alias("to"), F.col("to").alias("further")), "to", "left").select("id", F.coalesce("further", "to").alias("to"), F.col("further").isNotNull().alias("moved")))
            to = nxt.drop("moved")
            if nxt.where("moved").isEmpty():
                break
        moves.append(to)
        both = left.join(to.withColumnRenamed("id", "hi"), "hi").select("lo", F.col("to").alias("x"))
        both = both.join(to.withColumnRenamed("id", "lo"), "lo", "left").select("x", F.coalesce("to", "lo").alias("y")).where("x <> y")
        left = materialised(both.select(F.least("x", "y").alias("lo"), F.greatest("x", "y").alias("hi")).distinct())
    if not moves:
        return edges.select(F.col(a).alias("id"), F.col(a).alias("comp")).limit(0)
    found = moves[-1].withColumnRenamed("to", "comp")
    for m in moves[-2::-1]:
        found = materialised(m.join(found.withColumnRenamed("id", "to"), "to", "left").select("id", F.coalesce("comp", "to").alias("comp")).union(found))
    return found.union(found.select("comp", "comp").distinct())


def reach(edges: DataFrame, start: DataFrame, within: DataFrame | None = None) -> DataFrame:
    """(id) that can be reached from start (id) along edges, itself included."""

    def step(now: DataFrame) -> DataFrame:
        new = edges.join(now.withColumnRenamed("id", "src"), "src", "left_semi").select(F.col("dst").alias("id"))
        return now.union(new).distinct()

    return fixpoint(start.select("id").distinct(), step)


def largest_before(edges: DataFrame) -> DataFrame:
    """(id, colour): the largest id that reaches each vertex, itself included.

    What reaches a vertex's colour reaches the vertex, so it takes its colour's colour too, and long chains take few rounds.
    """
    start = vertices(edges).select("id", F.col("id").alias("colour"))

    def spread(now: DataFrame) -> DataFrame:
        jump = now.join(now.select(F.col("id").alias("colour"), F.col("colour").alias("further")), "colour").select("id", F.col("further").alias("colour"))
        came = edges.join(now.withColumnRenamed("id", "src"), "src").select(F.col("dst").alias("id"), "colour")
        return jump.union(came).groupBy("id").agg(F.max("colour").alias("colour"))

    return fixpoint(start, spread)


def coded(src: pd.Series, dst: pd.Series) -> tuple[np.ndarray, np.ndarray, list[int], list[int]]:
    """(ids in order, codes of src, first, to): the targets of vertex v are to[first[v]:first[v + 1]]."""
    ids, code = np.unique(np.concatenate((np.asarray(src), np.asarray(dst))), return_inverse=True)
    s, t = code[: len(src)], code[len(src) :]
    by = np.argsort(s, kind="stable")
    return ids, s, np.searchsorted(s[by], np.arange(len(ids) + 1)).tolist(), t[by].tolist()


def _cycles_in_task(edges: pd.DataFrame) -> pd.DataFrame:
    """(id, scc) of the vertices in components of two and more, by one walk in depth."""
    ids, _, first, to = coded(edges["src"], edges["dst"])
    n = len(ids)
    number, low, at, held = [0] * n, [0] * n, first[:-1], bytearray(n)
    path: list[int] = []
    open_: list[int] = []
    found: list[tuple[int, int]] = []
    seen = 0
    for root in range(n):
        if not number[root]:
            path.append(root)
        while path:
            v = path[-1]
            if not number[v]:
                seen += 1
                number[v] = low[v] = seen
                open_.append(v)
                held[v] = 1
            while at[v] < first[v + 1]:
                w = to[at[v]]
                if not number[w]:  # it is looked at again once w is done
                    path.append(w)
                    break
                at[v] += 1
                if held[w] and low[w] < low[v]:
                    low[v] = low[w]
            else:
                path.pop()
                if low[v] == number[v]:
                    k = len(open_) - 1
                    while open_[k] != v:
                        k -= 1
                    part = open_[k:]
                    del open_[k:]
                    for w in part:
                        held[w] = 0
                    if len(part) > 1:
                        least = min(part)
                        found += [(w, least) for w in part]
    of = lambda i: pd.Series(ids[np.array([x[i] for x in found], dtype=np.int64)])
    return pd.DataFrame({"id": of(0), "scc": of(1)})


def cycles(edges: DataFrame) -> DataFrame:
    """(id, scc): the vertices of strong components of two and more, with the smallest id of each, written.

    Vertices that no cycle can hold are trimmed; once REST edges are left, one task takes them. While there are more, and none is
    trimmed, the largest id that reaches a vertex is its colour. No vertex of a colour is larger than the colour's own one, so
    those of which that is the largest they reach inside are its component. The rest goes on.
    """
    left = materialised(edges.where("src <> dst").select("src", "dst").distinct())
    done: list[DataFrame] = []
    n = left.count()
    while n > REST:
        while n > REST:
            trimmed = left.join(left.select(F.col("dst").alias("src")).distinct(), "src", "left_semi").join(left.select(F.col("src").alias("dst")).distinct(), "dst", "left_semi")
            left, before = materialised(trimmed.select("src", "dst")), n
            n = left.count()
            if n == before:
                break
        if n <= REST:
            break
        colour = largest_before(left)
        inside = left.join(colour.select(F.col("id").alias("src"), F.col("colour").alias("cs")), "src").join(colour.select(F.col("id").alias("dst"), F.col("colour").alias("cd")), "dst").where("cs = cd").select("src", "dst")
        inside = materialised(inside)
        after = largest_before(inside.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).withColumnRenamed("colour", "after")
        member = materialised(colour.join(after, "id", "left").where("coalesce(after, id) = colour").select("id", "colour"))
        done.append(member)
        gone = member.select("id")
        left = materialised(left.join(gone.withColumnRenamed("id", "src"), "src", "left_anti").join(gone.withColumnRenamed("id", "dst"), "dst", "left_anti").select("src", "dst"))
        n = left.count()
    id_type = left.schema["src"].dataType.simpleString()
    found = in_one_task(left, _cycles_in_task, f"id {id_type}, scc {id_type}")
    if done:
        members = done[0]
        for m in done[1:]:
            members = members.union(m)
        least = members.groupBy("colour").agg(F.min("id").alias("scc"), F.count(F.lit(1)).alias("n")).where("n > 1")
        found = found.union(members.join(least, "colour").select("id", "scc"))
    return materialised(found)


def strong_components(edges: DataFrame) -> DataFrame:
    """(id, scc): the smallest id of each vertex's strong component."""
    return vertices(edges).join(cycles(edges), "id", "left").select("id", F.coalesce("scc", "id").alias("scc"))


# -- similarity of linked papers ----------------------------------------------------------------

#: Out-neighbours of a vertex that one task pairs with all its others.
WEDGE_BLOCK = 256


def _ranked(edges: DataFrame) -> DataFrame:
    """(lo, hi, up, down, dl, dh, and in_ and out_ degrees of both): each linked pair once, from the vertex of fewer links to that of more.

    up tells of an edge lo -> hi, down of one hi -> lo. A vertex is lo of at most the root of twice the edges, hubs too.
    """
    e = edges.where("src <> dst").select("src", "dst").distinct()
    pairs = e.groupBy(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).agg(F.max(F.col("src") < F.col("dst")).alias("ab"), F.max(F.col("src") > F.col("dst")).alias("ba"))
    pairs = materialised(pairs)
    one = lambda c: F.col(c).cast("long")
    ends = pairs.select(F.col("a").alias("id"), one("ab").alias("o"), one("ba").alias("i")).union(pairs.select("b", one("ba"), one("ab")))
    deg = materialised(ends.groupBy("id").agg(F.sum("i").alias("in"), F.sum("o").alias("out"), F.count(F.lit(1)).alias("links")))
    of = lambda c: deg.select(F.col("id").alias(c), F.struct("links", "id", "in", "out").alias(f"v{c}"))
    both = pairs.join(of("a"), "a").join(of("b"), "b")
    first = F.struct("va.links", "a") < F.struct("vb.links", "b")
    pick = lambda x, y: F.when(first, F.col(x)).otherwise(F.col(y))
    lo, hi = pick("va", "vb"), pick("vb", "va")
    return both.select(
        lo["id"].alias("lo"), hi["id"].alias("hi"), pick("ab", "ba").alias("up"), pick("ba", "ab").alias("down"), hi["links"].alias("dh"),
        lo["in"].alias("in_lo"), hi["in"].alias("in_hi"), lo["out"].alias("out_lo"), hi["out"].alias("out_hi"),
    )


def triangles(ranked: DataFrame) -> DataFrame:
    """(u, v, w, and up and down of uv, uw and vw): each three linked vertices once, in the order of `_ranked`.

    Pairs of out-neighbours of u that are linked. Those of a vertex are paired in blocks, so that no task holds all of them.
    """
    n = ranked.groupBy("lo").agg(F.ceil(F.count(F.lit(1)) / WEDGE_BLOCK).cast("int").alias("blocks"))
    t = ranked.select(F.col("lo").alias("u"), "hi", "up", "down", "dh").join(n.withColumnRenamed("lo", "u"), "u")
    left = t.select("u", F.col("hi").alias("v"), F.col("dh").alias("dv"), F.col("up").alias("uv_up"), F.col("down").alias("uv_down"), F.pmod(F.xxhash64("hi"), F.col("blocks")).cast("int").alias("block"))
    right = t.select("u", F.col("hi").alias("w"), F.col("dh").alias("dw"), F.col("up").alias("uw_up"), F.col("down").alias("uw_down"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
    wedges = left.join(right, ["u", "block"]).where(F.struct("dv", "v") < F.struct("dw", "w")).drop("block", "dv", "dw")
    return wedges.join(ranked.select(F.col("lo").alias("v"), F.col("hi").alias("w"), F.col("up").alias("vw_up"), F.col("down").alias("vw_down")), ["v", "w"])


def edge_similarities(edges: DataFrame) -> DataFrame:
    """(src, dst, ref_sim, cit_sim): Jaccard ratios of in-graph references and of in-graph citers; 0 if both ends have none.

    Edges are taken once, loops are dropped. What two linked vertices share closes a triangle, and triangles are listed from
    their vertex of fewest links, so a hub costs no more than the others. Each gives its three pairs a shared reference,
    a shared citer, or neither; these are summed before the shuffle.
    """
    r = materialised(_ranked(edges))
    f = {c: F.col(c) for c in ("uv_up", "uv_down", "uw_up", "uw_down", "vw_up", "vw_down")}
    mark = lambda lo, hi, ref, cit: F.struct(F.col(lo).alias("lo"), F.col(hi).alias("hi"), ref.cast("long").alias("ref"), cit.cast("long").alias("cit"))
    three = F.array(
        mark("u", "v", f["uw_down"] & f["vw_down"], f["uw_up"] & f["vw_up"]),
        mark("u", "w", f["uv_down"] & f["vw_up"], f["uv_up"] & f["vw_down"]),
        mark("v", "w", f["uv_up"] & f["uw_up"], f["uv_down"] & f["uw_down"]),
    )
    shared = triangles(r).select(F.inline(three)).where("ref > 0 or cit > 0").groupBy("lo", "hi").agg(F.sum("ref").alias("ref"), F.sum("cit").alias("cit"))
    ratio = lambda both, x, y: F.coalesce(F.try_divide(F.coalesce(both, F.lit(0)), F.col(x) + F.col(y) - F.coalesce(both, F.lit(0))), F.lit(0.0))
    sims = r.join(shared, ["lo", "hi"], "left").select("lo", "hi", "up", "down", ratio("ref", "in_lo", "in_hi").alias("ref_sim"), ratio("cit", "out_lo", "out_hi").alias("cit_sim"))
    ways = F.array(F.when(F.col("up"), F.struct(F.col("lo").alias("src"), F.col("hi").alias("dst"))), F.when(F.col("down"), F.struct(F.col("hi").alias("src"), F.col("lo").alias("dst"))))
    return sims.select(F.explode(F.array_compact(ways)).alias("e"), "ref_sim", "cit_sim").select("e.src", "e.dst", "ref_sim", "cit_sim")


def semantic_similarities(edges: DataFrame, vectors: DataFrame) -> DataFrame:
    """edges with semantic_similarity, the cosine of both ends' vectors (paper_id, embedding); 0 if one is missing, zero or of another length."""
    v = vectors.where("embedding is not null").groupBy("paper_id").agg(F.max("embedding").alias("e"))
    of = lambda c: v.select(F.col("paper_id").alias(c), F.col("e").alias(f"e_{c}"))
    j = edges.join(of("src"), "src", "left").join(of("dst"), "dst", "left")
    return j.select(*edges.columns, cosine_or_zero(F.col("e_src"), F.col("e_dst")).alias("semantic_similarity"))


def edge_weights(similar: DataFrame) -> DataFrame:
    """similar (src, dst, ref_sim, cit_sim) with weight: the larger of both as shares of their maxima.

    Edges without any signal get the lower quartile of the others' weights; without any others, LEAST_WEIGHT.
    The maxima and the quartile are numbers on the driver; the similarities are written once for all three uses.
    """
    similar = materialised(similar)
    top = similar.agg(F.max("ref_sim"), F.max("cit_sim")).first()
    share = lambda x, m: F.col(x) / F.lit(m) if m else F.lit(0.0)
    w = similar.withColumn("w", F.greatest(share("ref_sim", top[0]), share("cit_sim", top[1]))).withColumn("none", (F.col("ref_sim") <= 0) & (F.col("cit_sim") <= 0))
    low = quantile(w.where("not none"), "w", 0.25)
    return w.select("src", "dst", "ref_sim", "cit_sim", F.when(F.col("none"), F.lit(LEAST_WEIGHT if low is None else low)).otherwise(F.col("w")).alias("weight"))


# -- authors ------------------------------------------------------------------------------------

def keyed_authors(papers: DataFrame) -> DataFrame:
    """(paper_id, year, citation_count, author) of papers with an `authors` array; the key is the id or `name:` and the name."""
    a = papers.select("paper_id", "year", "citation_count", F.explode("authors").alias("x"))
    key = F.coalesce(F.nullif(F.col("x.authorId"), F.lit("")), F.when(F.coalesce(F.col("x.name"), F.lit("")) != "", F.concat(F.lit("name:"), F.col("x.name"))))
    return a.select("paper_id", "year", "citation_count", key.alias("author")).where("author is not null").distinct()


#: Authors of a paper that one row lists, and partners met on an author's papers that one task may count.
AUTHOR_BLOCK, AUTHOR_WORK = 256, 1_000_000


def _dealt(met: DataFrame, x: DataFrame) -> DataFrame:
    """met (a, bs and others) as rows of a, part, b and the others, where the author is; x (a, n) tells the authors of each paper. No b is in two parts of an author."""
    others = [c for c in met.columns if c not in ("a", "bs")]
    busy = x.groupBy("a").agg(F.sum("n").alias("met")).where(F.col("met") > AUTHOR_WORK).select("a", F.ceil(F.col("met") / AUTHOR_WORK).cast("int").alias("parts"))
    met = met.join(F.broadcast(busy), "a", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))  # few: as many as there are millions of pairs
    met = met.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    bs = F.when(F.col("parts") == 1, F.col("bs")).otherwise(F.filter("bs", lambda b: F.pmod(F.xxhash64(b), F.col("parts")) == F.col("part")))
    return met.select("a", "part", *others, bs.alias("bs")).repartition("a", "part").select("a", "part", *others, F.explode("bs").alias("b"))


def collaborators(authorship: DataFrame) -> DataFrame:
    """(id, degree): with how many others each author of (paper_id, author) shares a paper; those without any are left out.

    A paper's authors are listed in order, in blocks as for `collaboration`, and the lists are written once; each author gets the rest of
    the list behind it, and pairs are made and taken once where the author is.
    """
    n = authorship.groupBy("paper_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    x = authorship.where("author is not null").join(n, "paper_id").select("paper_id", "n", F.col("author").alias("a"), F.ceil(F.col("n") / AUTHOR_BLOCK).cast("int").alias("blocks"))
    lists = x.groupBy("paper_id", "n", "blocks", F.pmod(F.xxhash64("a"), F.col("blocks")).cast("int").alias("block")).agg(F.sort_array(F.collect_list("a")).alias("bs"))
    lists = materialised(lists)
    one = lists.where("blocks = 1").select(F.posexplode("bs").alias("at", "a"), "bs").select("a", F.slice("bs", F.col("at") + 2, F.size("bs")).alias("bs"))
    many = lists.where("blocks > 1").select("paper_id", "bs")
    across = many.withColumnRenamed("bs", "as").join(many, "paper_id").select(F.explode("as").alias("a"), "bs").select("a", F.filter("bs", lambda b: b > F.col("a")).alias("bs"))
    met = one.union(across).where(F.size("bs") > 0)
    pairs = _dealt(met, lists.select(F.explode("bs").alias("a"), "n")).where("a <> b").groupBy("a", "part", "b").agg(F.lit(1).alias("one"))
    return degrees(pairs.select("a", "b"))


def collaboration(authorship: DataFrame) -> DataFrame:
    """(a, b, n_papers, strength, first_year, last_year, duration) for each pair of authors of (paper_id, year, author).

    Each shared paper gives 1 / its number of authors; unknown years count as 0. Each author gets the later authors of a paper as lists, a block of
    them a row, so pairs are not shuffled one by one; they are counted where the author is. Authors of much work are
    dealt out by their partners.
    """
    n = authorship.groupBy("paper_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    block = F.ceil(F.col("n") / AUTHOR_BLOCK).cast("int")
    x = authorship.where("author is not null").join(n, "paper_id").select("paper_id", "year", "n", F.col("author").alias("a"), block.alias("blocks"))
    lists = x.groupBy("paper_id", F.pmod(F.xxhash64("a"), F.col("blocks")).cast("int").alias("block")).agg(F.collect_list("a").alias("bs"))
    left = x.select("paper_id", "year", "n", "a", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
    met = left.join(lists, ["paper_id", "block"]).select("a", "year", "n", F.filter("bs", lambda b: b > F.col("a")).alias("bs")).where(F.size("bs") > 0)
    pairs = _dealt(met, x)
    first, last = F.coalesce(F.min("year"), F.lit(0)), F.coalesce(F.max("year"), F.lit(0))
    sums = pairs.groupBy("a", "part", "b").agg(F.count(F.lit(1)).alias("n_papers"), F.sum(1.0 / F.col("n")).alias("strength"), first.alias("first_year"), last.alias("last_year"), (last - first).alias("duration"))
    return sums.drop("part")


def author_stats(authorship: DataFrame) -> DataFrame:
    """(author, year_entered, papers, citations) from (paper_id, year, citation_count, author)."""
    return authorship.groupBy("author").agg(F.coalesce(F.min("year"), F.lit(0)).alias("year_entered"), F.count(F.lit(1)).alias("papers"), F.sum(F.coalesce("citation_count", F.lit(0))).alias("citations"))


def degrees(pairs: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(id, degree) of undirected pairs."""
    return pairs.select(F.col(a).alias("id")).union(pairs.select(b)).groupBy("id").agg(F.count(F.lit(1)).alias("degree"))


def saturation(papers: DataFrame, collection: DataFrame) -> DataFrame:
    """(paper_id, saturation): the share of a paper's references that are in the collection; null without any.

    Blank references and the paper itself do not count.
    """
    r = papers.select("paper_id", F.explode(F.array_distinct("references")).alias("ref")).where("ref is not null and ref <> paper_id and cast(ref as string) <> ''")
    held = r.join(collection.select(F.col("paper_id").alias("ref"), F.lit(1).alias("there")), "ref", "left")
    s = held.groupBy("paper_id").agg((F.count("there") / F.count(F.lit(1))).alias("saturation"))
    return papers.select("paper_id").join(s, "paper_id", "left")


