"""Filter interaction audit, conversation structure repair and tile search against brute force and on odd rows."""

import hashlib
import heapq
import itertools
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestar.llm import filter_audit, tile_search, turn_repair
from lodestar.llm.queries import ORACLE_SQL, QUERIES

# -- 11 filter interaction audit ------------------------------------------------------------------

DOCS = "doc_id long, text string, lang string, mask int, n long, good long, part string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def some_docs(seed=5, n=150):
    rng = random.Random(seed)
    texts = ["", "a", "A B C " * 40, "one # two", " ".join(f"w{i}" for i in range(120)), " ".join(f"W{i} &" for i in range(130)), "x y " * 70, " ".join(f"v{i}" for i in range(99)), "É é\x0b#"]
    rows = [(i, rng.choice(texts + [None]), rng.choice(["en", "de", "", None]), 1, 2, 3, "x") for i in range(n)]
    rows += [(3, rows[3][1], rows[3][2], 1, 2, 3, "x")] * 3 + [(4, "other text", "en", 1, 2, 3, "x")] + [(None, "", "en", 1, 2, 3, "x")] * 2
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1])) for i in range(0, n + 20, 2)] + [(2, 1, 1), (2, 0, 0), (None, 1, 1)]
    return rows, labels


def brute_audit(rows, labels):
    good, toxic = ({d for d, q, t in labels if d is not None and (q, t)[k] == 1} for k in (0, 1))
    least = {}
    for d, t, *_ in rows:
        if d is not None:
            least[t or ""] = min(d, least.get(t or "", d))
    docs = []
    for d, t, lang, *_ in rows:
        t = t or ""
        w = WORD.findall(t)
        fails = {c for c, bad in zip("ABCDE", (len(w) < 100, 100 * len(set(w)) < 80 * len(w), 100 * len(re.findall("[A-Z]", t)) > 10 * len(t), bool(re.search(r"[#$%&*|]", t)), d is not None and d > least[t])) if bad}
        docs.append((lang or "", fails, d in good, d in toxic))
    out, shapley = {}, Counter()
    for part in {p for p, *_ in docs}:
        for order in itertools.permutations("ABCDE"):
            left = [x for x in docs if x[0] == part]
            for step, c in enumerate(order, 1):
                gone = [x for x in left if c in x[1]]
                left = [x for x in left if c not in x[1]]
                failing = sum(c in x[1] for x in docs if x[0] == part)
                out[part, "".join(order), step] = (len(left), len(gone), failing - len(gone), sum(x[1] == {c} for x in docs if x[0] == part), sum(x[2] for x in gone), sum(x[3] for x in gone))
                shapley[part, c] += len(gone)
    return {k: (*v, shapley[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def audited(df):
    rows = df.collect()
    out = {(r["part"], r["filter_order"], r["step"]): tuple(r[c] for c in (*filter_audit.COUNTS, "shapley")) for r in rows}
    assert len(out) == len(rows)
    return out


def test_audit(spark):
    rows, labels = some_docs()
    docs = spark.createDataFrame(rows, DOCS).repartition(3)
    want = brute_audit(rows, labels)
    assert len(want) == 600 * 3
    assert audited(filter_audit.audit(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))) == want
    assert filter_audit.audit(docs.where("false"), spark.createDataFrame([], "doc_id long, quality int, toxic int")).count() == 0
    assert filter_audit.audit(docs, spark.createDataFrame([], "doc_id long, quality int, toxic int")).agg(F.sum("good_lost") + F.sum("toxic_lost")).first()[0] == 0


def test_audit_of_long_text(spark):
    docs = spark.createDataFrame([(1, "word other " * 100_000, "en"), (2, " ".join(map(str, range(200_000))), "en")], "doc_id long, text string, lang string")
    got = audited(filter_audit.audit(docs, spark.createDataFrame([], "doc_id long, quality int, toxic int")))
    assert got["en", "ABCDE", 2][:2] == (1, 1)


def test_audit_with_other_rules(spark):
    docs = spark.createDataFrame([(1, "ab", "x"), (2, "b", "x"), (3, "b", "x")], "doc_id long, text string, lang string")
    got = audited(filter_audit.audit(docs, spark.createDataFrame([], "doc_id long, quality int, toxic int"), {"P": F.col("text").contains("a")}, copies="Q"))
    assert got == {("x", "PQ", 1): (2, 1, 0, 1, 0, 0, 2), ("x", "PQ", 2): (1, 1, 0, 1, 0, 0, 2), ("x", "QP", 1): (2, 1, 0, 1, 0, 0, 2), ("x", "QP", 2): (1, 1, 0, 1, 0, 0, 2)}


def fixture_tables(spark, tmp_path, **frames):
    con = duckdb.connect()
    for name, df in frames.items():
        df.write.parquet(f"{tmp_path}/{name}.parquet")
        con.sql(f"create view {name} as select * from '{tmp_path}/{name}.parquet/*.parquet'")
    return con


def test_op11_filter_audit(spark, tmp_path):
    rows, labels = some_docs(8, 90)
    docs = spark.createDataFrame([(*r[:3], "s", 1) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
    con = fixture_tables(spark, tmp_path, documents=docs, labels=spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    got = audited(QUERIES["op11_filter_audit"](spark, str(tmp_path)))
    assert got == brute_audit(rows, labels)
    assert got == {tuple(r[:3]): tuple(r[3:]) for r in con.sql(f"select part, filter_order, step, {', '.join(filter_audit.COUNTS)}, shapley from ({ORACLE_SQL['op11_filter_audit']})").fetchall()}


# -- 12 conversation structure repair --------------------------------------------------------------

ACCEPTED = re.compile(r"(s?(ua)+)?\Z")
GRAMMAR = {("q", "s"): "s", ("q", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}


def cheapest(rows):
    """(cost, least audit, repaired lines) by uniform-cost search over whole edit scripts; rows are (role, text, fault)."""
    heap, done = [(0, "", "q", 0, ())], set()
    while heap:
        cost, audit, state, i, lines = heapq.heappop(heap)
        if (state, i) in done:
            continue
        if i == len(rows) and state in "qa":
            return cost, audit, lines
        done.add((state, i))
        go = lambda c: GRAMMAR.get((state, c))
        for role in ("user", "assistant"):
            if go(role[0]):
                heapq.heappush(heap, (cost + 2, audit + "I", go(role[0]), i, (*lines, role + ":")))
        if i < len(rows):
            role, text, fault = rows[i]
            heapq.heappush(heap, (cost + 3, audit + "D", state, i + 1, lines))
            if fault not in ("blank", "duplicate"):
                t = fault == "truncated"
                if role and go(role[0]):
                    heapq.heappush(heap, (cost + t, audit + "K", go(role[0]), i + 1, (*lines, f"{role}:{text}")))
                for new in ("user", "assistant"):
                    if go(new[0]):
                        heapq.heappush(heap, (cost + 2 + t, audit + "R", go(new[0]), i + 1, (*lines, f"{new}:{text}")))


def brute_repair(turns):
    out = {}
    by = defaultdict(list)
    for conv, turn, role, text in turns:
        by[conv].append((turn, " " if role is None else role, " " if text is None else text))
    for conv, rows in by.items():
        rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        seen, marked = set(), []
        for _, role, text in rows:
            body = text.strip(" \t\n\x0b\x0c\r")
            fault = "blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else ""
            seen.add((role, text))
            marked.append((role, text, fault))
        known = [t for t, *_ in rows if t is not None]
        cost, audit, lines = cheapest(marked)
        initials = [r[:1] for r, *_ in marked]
        count = Counter(f for *_, f in marked)
        assert ACCEPTED.match("".join(x[0] for x in lines))
        out[conv] = (max(known) - min(known) + 1 - len(set(known)) if known else 0, count["blank"], count["duplicate"], count["truncated"], sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:])), cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest(), lines)
    return out


def some_turns(seed, n=120, longest=9):
    rng = random.Random(seed)
    roles = ["user", "user", "assistant", "assistant", "system", "tool", "", None, "sage"]
    texts = ["Hello there.", "Why?", "no end", "", " \n", None, "Ça va!", "end. ", "x\ny", "!", "é"]
    rows = []
    for c in range(n):
        for k in range(rng.randrange(1, longest)):
            r = (c if c else None, rng.choice([k, k, k + 1, None]), rng.choice(roles), rng.choice(texts) if rng.random() < 0.4 else f"{rng.choice('abc')}{k}{rng.choice(['.', ''])}")
            rows += [r] * rng.choice([1, 1, 1, 2, 4])
    return rows


TURNS = "conv_id long, turn long, role string, text string"
COLS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def repaired(df):
    rows = df.collect()
    out = {r["conv_id"]: tuple(r[c] for c in COLS) for r in rows}
    assert len(out) == len(rows)
    return out


@pytest.mark.parametrize("block", [1, 2, 5, 2048])
def test_blocks_meet_at_the_cheapest_audit(block, monkeypatch):
    """Rows cut into blocks of any size, anywhere, give the cost and audit of the whole."""
    monkeypatch.setattr(turn_repair, "BLOCK_ROWS", block)
    rng = random.Random(block)
    for _ in range(150):
        rows = [(rng.choice(["user", "assistant", "system", "x", ""]), "t", rng.choice(["", "", "truncated", "blank", "duplicate"])) for _ in range(rng.randrange(1, 14))]
        blocks = [turn_repair.Block()]
        for i, (role, text, fault) in enumerate(rows):
            if blocks[-1].full():
                blocks.append(turn_repair.Block())
            blocks[-1].add(i, role, text, fault, 1)
        cost, audit, lines = cheapest(rows)
        made = [turn_repair._row((True, 1), b, 0, i, False, True) for i, b in enumerate(blocks)]
        met = turn_repair._joined([r | {"n_forced": sum(r["forced"])} for r in made])
        parts = [turn_repair._lines(r | m) for r, m in zip(made, met)]
        assert met[-1]["cost"] == cost
        assert "".join(a for a, _ in parts) == audit
        assert [f"{r}:{t}" for _, x in parts for r, t in x] == list(lines)
        if len(blocks) == 1:
            whole = turn_repair._row((True, 1), blocks[0], 0, 0, True, False)
            assert (whole["cost"][0] + 3 * sum(whole["forced"]), whole["audit"]) == (cost, audit)


def test_repair(spark):
    rows = some_turns(1)
    df = spark.createDataFrame([(*r, 1, True, "y") for r in rows], TURNS + ", part int, known boolean, fault string").repartition(3)
    want = brute_repair(rows)
    assert repaired(turn_repair.repair(df)) == {k: v[:8] for k, v in want.items()}
    lines = defaultdict(list)
    for r in sorted(turn_repair.repaired_turns(df).collect(), key=lambda r: (r["part"], r["no"], r["position"])):
        lines[r["conv_id"]].append(f"{r['role']}:{r['text']}")
    assert {k: tuple(v) for k, v in lines.items()} == {k: v[8] for k, v in want.items() if v[8]}
    assert turn_repair.repair(df.where("false")).count() == 0


def test_repair_of_a_long_conversation(spark, monkeypatch):
    """One conversation over many partitions, with a text of its own in thousands of rows and one very long."""
    rng = random.Random(4)
    rows = [(1, i, rng.choice(["user", "assistant"]), f"t{i}" + rng.choice([".", ""])) for i in range(3000)] + [(1, i, "user", "same.") for i in range(0, 9000, 3)]
    rows += [(c, 0, "user", "hi.") for c in (0, 2)] + [(2, 1, "assistant", "word " * 200_000 + ".")]
    monkeypatch.setattr(turn_repair, "parts_for", lambda *a: 7)
    want = brute_repair(rows)
    assert repaired(turn_repair.repair(spark.createDataFrame(rows, TURNS).repartition(5))) == {k: v[:8] for k, v in want.items()}


def plain_damage(rows):
    out = []
    for conv, turn, role, text in rows:
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if kind == 0:
            continue
        r = (conv, turn, "user" if kind == 4 else role, "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text)
        out += [r, r] if kind == 3 else [r]
    return out


def test_op12_turn_repair(spark, tmp_path):
    rows = some_turns(2, 200) + [(c, 0, "user", "hi.") for c in range(1000, 1100)]
    spark.createDataFrame(rows, TURNS).repartition(4).write.parquet(f"{tmp_path}/conversations.parquet")
    want = brute_repair(plain_damage(rows))
    nothing = (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    assert repaired(QUERIES["op12_turn_repair"](spark, str(tmp_path))) == {c: want[c][:8] if c in want else nothing for c in {r[0] for r in rows}}


# -- 13 tile search ---------------------------------------------------------------------------------

VECS = "vec_id long, embedding array<double>, label int, row long, dim int, key string, score double"


def vectors(seed=0, n=300, dim=24):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, dim))
    x[n // 2 :] += 3 * rng.normal(size=dim)  # a cluster
    x[20:60] = x[100]  # copies
    x[61], x[62] = 2 * x[63], -x[63]
    x[70] *= 1e200
    x[71] *= 1e-200
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(50, x[5].tolist()), (50, x[50].tolist()), (100, None), (150, [0.0] * dim), (200, [float("nan")] * dim), (250, [None] + [1.0] * (dim - 1)), (300, [float("inf")] * dim), (350, [1.0, 2.0]), (351, [2.0, 1.0]), (400, []), (None, x[3].tolist())]
    return [(*r, 1, 7, 3, "k", 0.5) for r in rows]


def brute_nearest(rows, k, is_query):
    ok = [(i, np.array(v)) for i, v, *_ in rows if i is not None and v and None not in v and np.isfinite(v).all() and np.any(v)]
    out = []
    for a, (qi, q) in enumerate(ok):
        if not is_query(qi):
            continue
        best = []
        for b, (vi, v) in enumerate(ok):
            if a != b and len(q) == len(v):
                x, y = q / np.abs(q).max(), v / np.abs(v).max()
                best.append((round(-float(x @ y / (np.linalg.norm(x) * np.linalg.norm(y))), 12) + 0.0, vi))
        out += [(qi, rank, vi, -s) for rank, (s, vi) in enumerate(sorted(best)[:k], 1)]
    return sorted(out)


@pytest.mark.parametrize("block", [16, 64, 4096])
def test_nearest(spark, block):
    rows = vectors()
    df = spark.createDataFrame(rows, VECS).repartition(3)
    got = sorted((r["query_id"], r["rank"], r["vec_id"], round(r["score"], 12) + 0.0) for r in tile_search.nearest(df, lambda i: i % 10 == 0, 5, block=block).collect())
    want = brute_nearest(rows, 5, lambda i: i % 10 == 0)
    assert [g[:3] for g in got] == [w[:3] for w in want]
    assert np.allclose([g[3] for g in got], [w[3] for w in want], rtol=0, atol=1e-11)


def test_nearest_of_nothing(spark):
    df = spark.createDataFrame(vectors(), VECS)
    assert tile_search.nearest(df.where("false"), lambda i: i % 10 == 0).count() == 0
    assert tile_search.nearest(df.where("vec_id = 50").limit(1), lambda i: i % 10 == 0).count() == 0


def test_tiles_bound_their_error():
    rng = np.random.default_rng(3)
    for dim in (1, 3, 64, 2500):
        a, b = rng.standard_cauchy(size=(40, dim)), rng.normal(size=(50, dim))
        ca, cb = tile_search.Codes(a, tile_search.lengths(a)), tile_search.Codes(b, tile_search.lengths(b))
        near, error = ca.tile(cb, slice(0, 40))
        cosine = (a / np.linalg.norm(a, axis=1)[:, None]) @ (b / np.linalg.norm(b, axis=1)[:, None]).T
        assert (np.abs(cosine - near) <= error).all()


def test_tiles_prune():
    rng = np.random.default_rng(4)
    v, q = rng.normal(size=(4000, 64)), rng.normal(size=(30, 64))
    tally = [0, 0]
    list(tile_search.tile_top(q, np.full(30, -np.inf), np.arange(4000), np.arange(4000), v, 6, tally))
    assert tally[0] == 120_000 and tally[1] < 1500


def test_op13_tile_search(spark, tmp_path):
    rng = np.random.default_rng(9)
    x = rng.normal(size=(400, 16)).astype(np.float32)
    x[300:330] = x[50]
    df = spark.createDataFrame([(i, v.tolist(), 1) for i, v in enumerate(x)] + [(500, None, 1), (550, [0.0] * 16, 1)], "vec_id long, embedding array<float>, label int")
    con = fixture_tables(spark, tmp_path, embeddings=df)
    got = sorted(tuple(r) for r in QUERIES["op13_tile_search"](spark, str(tmp_path)).select("query_id", "rank", "vec_id", "score").collect())
    assert got == sorted(con.sql(ORACLE_SQL["op13_tile_search"]).fetchall())
    assert [g[:3] for g in got] == [w[:3] for w in brute_nearest([(i, v.tolist()) for i, v in enumerate(x)], 5, lambda i: i % 50 == 0)]


# -- hot rows of earlier operators --------------------------------------------------------------------

def test_many_files_and_equal_rows_are_dealt_apart(spark, monkeypatch):
    """800 files and one row 3,000 times: no block holds more than about the root of the rows, and the placement stays gapless."""
    from lodestar.llm import common, sharding

    monkeypatch.setattr(sharding, "COPIES", 50)
    rows = [(i, f"t{i}", f"f{i % 800:04d}") for i in range(8000)] + [(5, "same", "f0790")] * 3000
    docs = sharding.with_file_numbers(spark.createDataFrame(rows, "doc_id long, text string, file string"), "file", 16)
    out = sharding.reshard(docs, "old_shard", 16).collect()
    assert Counter((r["doc_id"], r["text"]) for r in out) == Counter((i, t) for i, t, _ in rows)
    by = defaultdict(list)
    for r in out:
        by[r["shard"]].append(r)
    assert all(sorted(r["slot"] for r in x) == list(range(len(x))) for x in by.values())
    sizes = [sum(r["size"] for r in by[s]) for s in range(16)]
    assert max(sizes) - min(sizes) <= 2 * max(r["size"] for r in out)
    d = common.numbered_copies(spark.createDataFrame(rows, "doc_id long, text string, file string").withColumn("mark", F.xxhash64("doc_id", "text")), 50)
    assert d.count() == len(rows) and d.groupBy("mark", "copy").count().agg(F.max("count")).first()[0] == 1


def test_mix_of_equal_rows(spark):
    from lodestar.llm import mixing

    rows = [(None, "a b c", "s1")] * 5000 + [(i, "x " * (i % 7), "s2") for i in range(500)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    taken = sorted(tuple(r) for r in mixing.mix(df, ["doc_id", "text", "source"]).collect() if r["doc_id"] is not None)
    assert taken == sorted(tuple(r) for r in mixing.mix(df.repartition(7), ["doc_id", "text", "source"]).collect() if r["doc_id"] is not None)
    out = mixing.systematic_copies(df.withColumn("w", mixing.word_count(F.col("text"))), "w", "source", "doc_id")
    assert out.count() == len(rows) and out.agg(F.max("copies")).first()[0] <= 3


def test_packing_bounds_blocks_by_bytes(spark, monkeypatch):
    from lodestar.llm import packing

    monkeypatch.setattr(packing, "BLOCK_BYTES", 20_000)
    df = spark.createDataFrame([(i, "long words here " * 700) for i in range(40)], "doc_id long, text string")
    out = packing.pack(df).collect()
    blocks = Counter(r["sequence_id"] >> 32 for r in out if r["start"] == 0)
    assert len(blocks) > 10
    assert sum(r["length"] for r in out) == sum({r["doc_id"]: r["doc_tokens"] for r in out}.values())
