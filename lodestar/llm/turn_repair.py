"""Repair of the structure of conversations by cost layers, after Wu and Manber.

A conversation should read `(s?(ua)+)?` in the initials of its roles. States of that grammar are bits; at
each turn there is one bitset of states for each cost, all layers of a turn side by side in one whole
number, so that an edit of cost c is a shift by c layers. Layers are built from the last turn to the first:
a bit says that from this state an accepted end can be reached at exactly this cost. The first layer with
the start state's bit at the first turn is the least cost, and the bits, followed forward, give the audit.

A conversation may be of any length. Rows are sorted by ranges, so a long one spreads over many tasks, each
of which cuts it into blocks. A block keeps its least cost and audit from every state to every state; the
blocks of a conversation, a few numbers each, choose the states where they meet, and then every block
writes its own part.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import PART_BYTES, map_arrow, parts_for, saved, table, utf8_len

#: The costs of the edits, and of keeping a truncated row in any way.
REROLE, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1
#: States: nothing read, after s, after u, after a. What an end costs in each: the inserts that it still takes.
STATES = 4
END_COST = (0, 2 * INSERT, INSERT, 0)
LEGAL = ("su", "ua", "au")
NEXT = {"u": (2, 2, None, 2), "a": (None, None, 3, None), "s": (1, None, None, None)}
TURNING = tuple(u if u is not None else a for u, a in zip(NEXT["u"], NEXT["a"]))
ROLE = {2: "user", 3: "assistant"}
#: A block holds so many rows and bytes of text at most (a single row may be longer).
BLOCK_ROWS, BLOCK_BYTES = 2048, 4 << 20
NEVER = 1 << 60


class Layers:
    """Cost layers of a run of rows; each row is (initial of its role, 1 if truncated).

    Lanes lie side by side in a layer, four bits each. `whole`: one lane, which accepts the ends of a
    conversation at their cost. Else a lane for each state in which the run may end, at no cost; inserts
    behind the last row then belong to what follows.
    """

    def __init__(self, rows: list[tuple[str, int]], whole: bool):
        self.rows, self.whole = rows, whole
        self.lanes = 1 if whole else STATES
        self.width = STATES * self.lanes
        self.ones = sum(1 << STATES * k for k in range(self.lanes))
        most = DELETE * len(rows) + max(END_COST) + 1
        size = 8 if whole else most
        while True:
            self._build(min(size, most))
            if not whole or size >= most or self.cost(0, 0) < NEVER:
                return
            size *= 2

    def _build(self, layers: int) -> None:
        w = self.width
        ones = 0
        for _ in range(layers):
            ones = ones << w | self.ones
        full = (1 << w * layers) - 1
        if self.whole:
            at = sum(1 << w * c + s for s, c in enumerate(END_COST))
        else:
            at = sum(1 << STATES * k + k for k in range(STATES))
        at &= full
        self.at = [at]
        for initial, t in reversed(self.rows):
            # states before a user's row are those of which u leads to the third, and so on
            u, a = at >> 2 & ones, at >> 3 & ones
            turn = u | u << 1 | u << 3 | a << 2
            keep = {"u": u | u << 1 | u << 3, "a": a << 2, "s": at >> 1 & ones}.get(initial, 0)
            at = (keep << w * t | turn << w * (REROLE + t) | at << w * DELETE) & full
            for _ in range(2):  # more inserts on end lead back to where they began
                u, a = at >> 2 & ones, at >> 3 & ones
                at |= (u | u << 1 | u << 3 | a << 2) << w * INSERT & full
            self.at.append(at)
        self.at.reverse()

    def has(self, i: int, cost: int, lane: int, state: int) -> bool:
        return cost >= 0 and bool(self.at[i] >> self.width * cost + STATES * lane + state & 1)

    def cost(self, start: int, lane: int) -> int:
        """The first layer in which the lane's end is reached from the start state."""
        bits = self.at[0] >> STATES * lane + start
        every = sum(1 << self.width * k for k in range(-(-bits.bit_length() // self.width)))
        bits &= every
        return ((bits & -bits).bit_length() - 1) // self.width if bits else NEVER

    def audit(self, start: int, lane: int) -> str:
        """The least of the cheapest audits, by trying edits in the order of their letters."""
        out, state, left = [], start, self.cost(start, lane)
        for i, (initial, t) in enumerate(self.rows):
            while True:
                if self.has(i + 1, left - DELETE, lane, state):
                    out.append("D")
                    left -= DELETE
                    break
                turned = TURNING[state]
                if self.has(i, left - INSERT, lane, turned):
                    out.append("I")
                    left -= INSERT
                    state = turned
                    continue
                kept = NEXT[initial][state] if initial in NEXT else None
                if kept is not None and self.has(i + 1, left - t, lane, kept):
                    out.append("K")
                    left -= t
                    state = kept
                else:
                    out.append("R")
                    left -= REROLE + t
                    state = turned
                break
        return "".join(out) + "I" * (left // INSERT)


def rewrite(audit: str, start: int, rows: list[tuple[str, str]]) -> tuple[list[tuple[str, str]], int]:
    """(what an audit makes of (role, text) rows, the state that it ends in)."""
    out, state, i = [], start, 0
    for edit in audit:
        if edit == "I":
            state = TURNING[state]
            out.append((ROLE[state], ""))
            continue
        role, text = rows[i]
        i += 1
        if edit == "K":
            state = NEXT[role[0]][state]
            out.append((role, text))
        elif edit == "R":
            state = TURNING[state]
            out.append((ROLE[state], text))
    return out, state


def with_forced(audit: str, forced: list[int]) -> str:
    """An audit of rows that may be kept, with the deletions of the others before and behind them: D sorts first, so no insert stands before those."""
    out, k = ["D" * forced[0]], 0
    for edit in audit:
        out.append(edit)
        if edit != "I":
            k += 1
            out.append("D" * forced[k])
    return "".join(out)


class Block:
    """Rows of one conversation, in order; forced deletions are kept as counts before each row and at the end."""

    def __init__(self) -> None:
        self.rows: list[tuple[str, str]] = []
        self.marks: list[tuple[str, int]] = []
        self.forced = [0]
        self.bytes = self.read = 0
        self.blank = self.duplicate = self.truncated = self.illegal = 0
        self.first = self.last = None  # initials of the first and last row
        self.turns = 0
        self.low = self.high = None  # least and greatest turn; rows come by turn

    def add(self, turn: int | None, role: str, text: str, fault: str, n: int) -> None:
        initial = role[:1]
        self.read += 1
        pairs = ([self.last + initial] if self.last is not None else []) + [initial * 2] * (n > 1)
        self.illegal += sum((n - 1 if k == len(pairs) - 1 and n > 1 else 1) for k, p in enumerate(pairs) if p not in LEGAL)
        self.first = initial if self.first is None else self.first
        self.last = initial
        if turn is not None:
            self.low = turn if self.low is None else self.low
            self.turns += turn != self.high
            self.high = turn
        deleted = n
        if fault == "blank":
            self.blank += n
        elif fault == "duplicate":
            self.duplicate += n
        else:
            self.truncated += fault == "truncated"
            self.duplicate += n - 1
            self.rows.append((role, text))
            self.marks.append((initial, int(fault == "truncated")))
            self.forced.append(0)
            self.bytes += len(text) + len(role)
            deleted = n - 1
        self.forced[-1] += deleted

    def full(self) -> bool:
        return self.read >= BLOCK_ROWS or self.bytes >= BLOCK_BYTES


OUT = {
    "conv_id": "long", "known": "boolean", "open": "boolean", "part": "long", "no": "long", "turns": "long", "low": "long", "high": "long", "first": "string", "last": "string",
    "blank": "long", "duplicate": "long", "truncated": "long", "illegal": "long", "forced": "array<int>", "cost": "array<long>", "rank": "array<int>", "audits": "array<string>",
    "roles": "array<string>", "texts": "array<string>", "audit": "string", "sha256": "string",
}
TYPES = {"long": pa.int64(), "int": pa.int32(), "boolean": pa.bool_(), "string": pa.string(), "binary": pa.binary(), "array<int>": pa.list_(pa.int32()), "array<long>": pa.list_(pa.int64()), "array<string>": pa.list_(pa.string())}


def _schema(columns: dict[str, str]) -> str:
    return ", ".join(f"{c} {t}" for c, t in columns.items())


def _batch(rows: list[dict], columns: dict[str, str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r.get(c) for r in rows], TYPES[t]) for c, t in columns.items()], names=list(columns))


def _row(key: tuple, b: Block, part: int, no: int, whole: bool, keep: bool) -> dict:
    row = {
        "conv_id": key[1], "known": key[0], "open": not whole, "part": part, "no": no, "turns": b.turns, "low": b.low, "high": b.high, "first": b.first, "last": b.last,
        "blank": b.blank, "duplicate": b.duplicate, "truncated": b.truncated, "illegal": b.illegal, "forced": b.forced,
    }
    if keep or not whole:
        row |= {"roles": [r for r, _ in b.rows], "texts": [t for _, t in b.rows]}
    layers = Layers(b.marks, whole)
    if whole:
        audit = layers.audit(0, 0)
        text = "\n".join(f"{r}:{t}" for r, t in rewrite(audit, 0, b.rows)[0])
        return row | {"cost": [layers.cost(0, 0)], "audits": [audit], "audit": with_forced(audit, b.forced), "sha256": hashlib.sha256(text.encode()).hexdigest()}
    pairs = [(s, k) for s in range(STATES) for k in range(STATES)]
    cost = [layers.cost(s, k) for s, k in pairs]
    audits = [layers.audit(s, k) if c < NEVER else None for (s, k), c in zip(pairs, cost)]
    rank = []
    for s in range(STATES):
        mine = audits[s * STATES : (s + 1) * STATES]
        order = sorted(x for x in mine if x is not None)
        rank += [order.index(x) if x is not None else STATES for x in mine]
    return row | {"cost": cost, "rank": rank, "audits": audits}


def _blocks(keep: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        """The blocks of a sorted partition. A conversation in one block that lies in it whole is ended here; its first and last ones, and all of several blocks, stay open."""
        out: list[dict] = []
        held, no, part = 0, 0, 0
        key, block, cut = None, Block(), True
        for b in batches:
            part = b.column("part")[0].as_py() if b.num_rows else part
            for known, conv, turn, role, text, fault, n in zip(*(b.column(c).to_pylist() for c in ("known", "conv_id", "turn", "role", "text", "fault", "n"))):
                now = (known, conv)
                if key is not None and (now != key or block.full()):
                    same = now == key
                    out.append(_row(key, block, part, no, not (same or cut), keep))
                    held += block.bytes
                    cut = same
                    no, block = no + 1, Block()
                key = now
                block.add(turn, role, text, fault, n)
                if len(out) >= 512 or held > BLOCK_BYTES:
                    yield _batch(out, OUT)
                    out, held = [], 0
        if key is not None:
            out.append(_row(key, block, part, no, False, keep))
        if out:
            yield _batch(out, OUT)

    return run


COUNTS = ("blank", "duplicate", "truncated", "illegal")
MET = {"conv_id": "long", "known": "boolean", "part": "long", "no": "long", "start": "int", "stop": "int", "last_block": "boolean", "gaps": "long", **dict.fromkeys(COUNTS, "long"), "cost": "long"}


def _met(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
    """Where the blocks of each conversation meet; partitions are sorted by conversation, part and number."""
    key, blocks = None, []
    for b in batches:
        for r in b.to_pylist():
            if blocks and (r["known"], r["conv_id"]) != key:
                yield _batch(_joined(blocks), MET)
                blocks = []
            key = (r["known"], r["conv_id"])
            blocks.append(r)
    if blocks:
        yield _batch(_joined(blocks), MET)


def _joined(blocks: list[dict]) -> list[dict]:
    """The state in which each block starts and stops, and the conversation's counts in its last block's row."""
    ends = [list(END_COST)]
    for b in reversed(blocks):
        ends.append([min(b["cost"][s * STATES + k] + ends[-1][k] for k in range(STATES)) for s in range(STATES)])
    ends.reverse()
    rows, state = [], 0
    total = dict.fromkeys(COUNTS, 0)
    turns, low, high, last = 0, None, None, None
    for i, b in enumerate(blocks):
        # no audit of a block is the beginning of another one of it, so the least of the cheapest goes on with the least
        ways = [k for k in range(STATES) if b["cost"][state * STATES + k] + ends[i + 1][k] == ends[i][state]]
        stop = min(ways, key=lambda k: b["rank"][state * STATES + k])
        rows.append({"conv_id": b["conv_id"], "known": b["known"], "part": b["part"], "no": b["no"], "start": state, "stop": stop, "last_block": i == len(blocks) - 1})
        state = stop
        for c in COUNTS:
            total[c] += b[c]
        total["illegal"] += last is not None and last + b["first"] not in LEGAL
        last = b["last"]
        if b["low"] is not None:
            turns += b["turns"] - (high == b["low"])
            low = b["low"] if low is None else low
            high = b["high"]
    rows[-1] |= total | {"gaps": high - low + 1 - turns if low is not None else 0, "cost": ends[0][0] + DELETE * sum(b["n_forced"] for b in blocks)}
    return rows


def _lines(r: dict) -> tuple[str, list[tuple[str, str]]]:
    """(audit, repaired rows) of a block that knows where it starts and stops."""
    plain = r["audits"][r["start"] * STATES + r["stop"]] if r["open"] else r["audits"][0]
    lines, state = rewrite(plain, r["start"], list(zip(r["roles"], r["texts"])))
    audit = with_forced(plain, r["forced"])
    if r["open"] and r["last_block"]:
        more = "I" * (END_COST[state] // INSERT)
        audit += more
        lines += rewrite(more, state, [])[0]
    return audit, lines


PIECES = {"conv_id": "long", "known": "boolean", "part": "long", "no": "long", "audit": "string", "piece": "binary"}


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
    for b in batches:
        for r in b.to_pylist():
            audit, lines = _lines(r)
            yield _batch([{c: r[c] for c in ("conv_id", "known", "part", "no")} | {"audit": audit, "piece": "\n".join(f"{x}:{t}" for x, t in lines).encode() if lines else None}], PIECES)


ENDED = {"conv_id": "long", "known": "boolean", "audit": "string", "sha256": "string"}


def _ended(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
    """Audit and hash of conversations whose blocks come in order; of their texts one block is held at a time."""
    key, audit, sha, some = None, [], hashlib.sha256(), False
    for b in batches:
        for r in b.to_pylist():
            now = (r["known"], r["conv_id"])
            if key is not None and now != key:
                yield _batch([dict(zip(("known", "conv_id"), key)) | {"audit": "".join(audit), "sha256": sha.hexdigest()}], ENDED)
                audit, sha, some = [], hashlib.sha256(), False
            key = now
            audit.append(r["audit"])
            if r["piece"] is not None:
                if some:
                    sha.update(b"\n")
                sha.update(r["piece"])
                some = True
    if key is not None:
        yield _batch([dict(zip(("known", "conv_id"), key)) | {"audit": "".join(audit), "sha256": sha.hexdigest()}], ENDED)


TURNS = {"conv_id": "long", "part": "long", "no": "long", "position": "int", "role": "string", "text": "string"}


def _turns(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
    for b in batches:
        for r in b.to_pylist():
            rows = [{"conv_id": r["conv_id"], "part": r["part"], "no": r["no"], "position": i, "role": role, "text": text} for i, (role, text) in enumerate(_lines(r)[1])]
            if rows:
                yield _batch(rows, TURNS)


def _judged(turns: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    """Distinct rows with their number n and first fault."""
    t = turns.select(F.col(conv_col).cast("long").alias("conv_id"), F.col(turn_col).cast("long").alias("turn"), F.coalesce(F.col(role_col), F.lit(" ")).alias("role"), F.coalesce(F.col(text_col), F.lit(" ")).alias("text"))
    t = t.select(F.col("conv_id").isNotNull().alias("known"), "conv_id", F.col("turn").isNotNull().alias("turn_known"), "turn", "role", "text", F.unhex(F.sha2(F.col("text").cast("binary"), 256)).alias("same"))
    conv, at = F.coalesce("conv_id", F.lit(0)).alias("conv"), F.coalesce("turn", F.lit(0)).alias("at")
    # the first row of each role and text: equal rows and copies meet as their counts and least turns
    first = t.groupBy("known", conv, "role", "same").agg(F.min(F.struct("turn_known", at)).alias("least")).select("known", "conv", "least.turn_known", "least.at", "role", "same", F.lit(True).alias("is_first"))
    rows = t.groupBy("known", conv, "turn_known", at, "role", "same").agg(F.max("text").alias("text"), F.count(F.lit(1)).alias("n"))
    rows = rows.join(first, ["known", "conv", "turn_known", "at", "role", "same"], "left")
    text = F.col("text")
    fault = F.when(~text.rlike("[^\\x20\\x09-\\x0D]"), "blank").when(F.col("is_first").isNull(), "duplicate").when(~text.rlike("[.!?][\\x20\\x09-\\x0D]*\\z"), "truncated").otherwise("")
    return rows.select("known", F.when(F.col("known"), F.col("conv")).alias("conv_id"), "turn_known", F.when(F.col("turn_known"), F.col("at")).alias("turn"), "role", "text", "n", fault.alias("fault"))


def blocks(turns: DataFrame, keep: bool, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """The blocks of all conversations, written; with keep also those that are ended hold their rows."""
    spark = turns.sparkSession
    size = turns.agg(F.sum(utf8_len(F.col(text_col)) + 64)).first()[0] or 0
    order = ["known", "conv_id", "turn_known", "turn", "role", "text"]
    rows = _judged(turns, conv_col, turn_col, role_col, text_col).repartitionByRange(parts_for(spark, size), *order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id().cast("long"))
    return saved(map_arrow(rows, _blocks(keep), _schema(OUT)))


def _meet(b: DataFrame) -> DataFrame:
    """Where the open blocks meet, written: a few numbers for each, without their texts."""
    key = ["known", "conv_id"]
    slim = b.where("open").select(*key, "part", "no", "turns", "low", "high", "first", "last", *COUNTS, F.aggregate("forced", F.lit(0).cast("long"), lambda a, x: a + x).alias("n_forced"), "cost", "rank")
    return saved(map_arrow(slim.repartition(*key).sortWithinPartitions(*key, "part", "no"), _met, _schema(MET)))


def repair(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row per conversation that has rows: conv_id, gaps, COUNTS, cost, audit, repaired_sha256.

    Null roles and texts are one space. Rows come by turn, null turns first, ties by role and text. Null
    conv_ids are one conversation. A role whose initial is not s, u or a, also an empty one, cannot be kept
    under it. Repeated rows are duplicates of their first one. The blocks of a conversation, a row of
    numbers for 2,048 rows, are read by one task; so is its repaired text, of which the task holds a block at a
    time: a hash goes through a text from end to end. An audit holds a letter a row, in one cell. Other
    columns are not read. No rows: an empty result.
    """
    b = blocks(turns, False, conv_col, turn_col, role_col, text_col)
    key = ["known", "conv_id"]
    met = _meet(b)
    at = met.select(F.col("part").alias("p"), F.col("no").alias("k"), "start", "stop", "last_block")
    mine = b.where("open").join(at, (F.col("part") == F.col("p")) & (F.col("no") == F.col("k")))
    pieces = map_arrow(mine.select(*key, "part", "no", "open", "start", "stop", "last_block", "forced", "audits", "roles", "texts"), _pieces, _schema(PIECES), 64)
    ended = map_arrow(pieces.repartition(*key).sortWithinPartitions(*key, "part", "no"), _ended, _schema(ENDED), 64)
    long = ended.alias("e").join(met.where("last_block").alias("m"), F.expr("e.known = m.known and e.conv_id <=> m.conv_id")).select("e.known", "e.conv_id", "gaps", *COUNTS, "m.cost", "audit", "sha256")
    gaps = F.coalesce(F.col("high") - F.col("low") + 1 - F.col("turns"), F.lit(0))
    cost = F.col("cost")[0] + DELETE * F.aggregate("forced", F.lit(0).cast("long"), lambda a, x: a + x)
    short = b.where("not open").select(*key, gaps.alias("gaps"), *COUNTS, cost.alias("cost"), "audit", "sha256")
    return short.union(long).drop("known").withColumnRenamed("sha256", "repaired_sha256")


def repaired_turns(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """The repaired rows themselves: (conv_id, part, no, position, role, text), in the order of these columns within a conversation."""
    b = blocks(turns, True, conv_col, turn_col, role_col, text_col)
    at = _meet(b).select(F.col("part").alias("p"), F.col("no").alias("k"), "start", "stop", "last_block")
    mine = b.join(at, (F.col("part") == F.col("p")) & (F.col("no") == F.col("k")), "left").withColumn("start", F.coalesce("start", F.lit(0)))
    return map_arrow(mine.select("conv_id", "part", "no", "open", "start", "stop", "last_block", "forced", "audits", "roles", "texts"), _turns, _schema(TURNS), 64)


def damage(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) with faults set by the digest of conv_id:turn; nulls are one space there."""
    part = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(part("conv_id"), F.lit(":"), part("turn")).cast("binary")) % 20
    t = turns.select("conv_id", "turn", part("role").alias("role"), part("text").alias("text"), kind.alias("kind")).where("kind <> 0")
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("kind") == 4, "user").otherwise(F.col("role"))
    times = F.when(F.col("kind") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    return t.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(times).alias("copy")).drop("copy")


def op12_turn_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    found = repair(damage(c))
    every = c.select(F.col("conv_id").cast("long").alias("every")).distinct()
    counts = ["gaps", *COUNTS, "cost"]
    out = every.join(found, F.expr("every <=> conv_id"), "left")
    nothing = hashlib.sha256(b"").hexdigest()
    return out.select(F.col("every").alias("conv_id"), *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in counts), F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(nothing)).alias("repaired_sha256"))
