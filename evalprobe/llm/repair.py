"""Conversation structure repair: the cheapest edits that give every conversation the roles ``(system? (user assistant)+)?``.

A conversation of n rows spans a lattice of n + 1 columns of four states: nothing emitted, a system turn, a user turn, an
assistant turn. Keeping, re-roling and deleting a row leads to the next column, inserting a turn to another state of the
same column. Every edge has a cost and a letter; a path's letters are its audit. Two Dijkstra searches, forward from the
first column and in reverse from the goals, meet: they go on until the sum of both heads exceeds the best crossing, so
every crossing of that cost has been seen, and the least concatenated audit wins. An audit determines its path, so no two
audits of a node are one the beginning of the other, and the least audits of halves make the least of the whole.

Conversations of up to ``BLOCK`` rows are searched whole. Longer ones, of any length, are cut into blocks of that many
rows: each block's cheapest audits from every state to every state are searched on their own, a pass over the blocks'
tables picks the states at the cuts, and every block is repaired where it stands. No task holds such a conversation's
texts; inserts at a cut belong to the block before it.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.ordering import matched, running
from .common import stored

#: Rows of a conversation that are searched at once.
BLOCK = 1024
RE_ROLE, DELETE, INSERT, CUT_SHORT = 3, 4, 3, 3
#: From a state, the role initials that may follow and the states that they lead to; 0 nothing, 1 system, 2 user, 3 assistant.
NEXT = ((("s", 1), ("u", 2)), (("u", 2),), (("a", 3),), (("u", 2),))
BEFORE = ((), (("s", 0),), (("u", 0), ("u", 1), ("u", 3)), (("a", 2),))
GOALS = (0, 3)
ROLES = {"u": "user", "a": "assistant"}
INFINITE = 1 << 60

#: One row for the search: role initial, whether it must go, what it costs to leave it cut short.
Step = tuple[str, bool, int]


def _forward(rows: list[Step], node: int, front: bool) -> Iterator[tuple[int, int, str]]:
    """The edges from a node (4 * column + state): node, cost, letter. ``front``: inserts are allowed in the first column."""
    i, s = divmod(node, 4)
    if i < len(rows):
        initial, gone, more = rows[i]
        yield node + 4, DELETE, "D"
        if not gone:
            for r, t in NEXT[s]:
                if r == initial:
                    yield 4 * i + 4 + t, more, "K"
                elif r != "s":
                    yield 4 * i + 4 + t, RE_ROLE + more, "R"
    if i or front:
        for r, t in NEXT[s]:
            if r != "s":
                yield 4 * i + t, INSERT, "I"


def _backward(rows: list[Step], node: int, front: bool) -> Iterator[tuple[int, int, str]]:
    """The edges into a node."""
    i, t = divmod(node, 4)
    if i:
        initial, gone, more = rows[i - 1]
        yield node - 4, DELETE, "D"
        if not gone:
            for r, s in BEFORE[t]:
                if r == initial:
                    yield 4 * i - 4 + s, more, "K"
                elif r != "s":
                    yield 4 * i - 4 + s, RE_ROLE + more, "R"
    if i or front:
        for r, s in BEFORE[t]:
            if r != "s":
                yield 4 * i + s, INSERT, "I"


def cheapest(rows: list[Step], start: int = 0, goals: tuple[int, ...] = GOALS, front: bool = True) -> tuple[int, str] | None:
    """Cost and least audit of the cheapest paths from state ``start`` to one of ``goals``; None if there is none."""
    n = len(rows)
    ahead, behind = [(0, "", start)], [(0, -n, "", 4 * n + t) for t in goals]
    heapq.heapify(behind)
    left: dict[int, tuple[int, str]] = {}
    right: dict[int, tuple[int, str]] = {}
    best = (INFINITE, "")
    while ahead and behind and ahead[0][0] + behind[0][0] <= best[0]:
        if ahead[0][0] < behind[0][0]:
            cost, audit, x = heapq.heappop(ahead)
            if x in left:
                continue
            left[x] = cost, audit
            if x in right:
                best = min(best, (cost + right[x][0], audit + right[x][1]))
            for y, more, letter in _forward(rows, x, front):
                if y in right:
                    best = min(best, (cost + more + right[y][0], audit + letter + right[y][1]))
                if y not in left:
                    heapq.heappush(ahead, (cost + more, audit + letter, y))
        else:
            # of equal costs later columns come first: an edge of no cost leads one column back
            cost, _, audit, y = heapq.heappop(behind)
            if y in right:
                continue
            right[y] = cost, audit
            if y in left:
                best = min(best, (cost + left[y][0], left[y][1] + audit))
            for x, more, letter in _backward(rows, y, front):
                if x in left:
                    best = min(best, (left[x][0] + more + cost, left[x][1] + letter + audit))
                if x not in right:
                    heapq.heappush(behind, (cost + more, -(x // 4), letter + audit, x))
    return best if best[0] < INFINITE else None


def applied(turns: list[tuple[str, str]], audit: str, state: int = 0) -> list[tuple[str, str]]:
    """The turns (role, text) after the edits of ``audit``."""
    out, i = [], 0
    for letter in audit:
        if letter == "K":
            state = next(t for r, t in NEXT[state] if r == turns[i][0][:1])
            out.append(turns[i])
        elif letter != "D":
            r, state = next(x for x in NEXT[state] if x[0] != "s")
            out.append((ROLES[r], turns[i][1] if letter == "R" else ""))
        i += letter != "I"
    return out


#: White space of the word rule, and the marks at which a text may end.
_BLANK = " \t\n\x0b\x0c\r"


def fault(role: str, text: str, seen: bool) -> str | None:
    """The first fault of a row: blank, duplicate (``seen``), truncated, or none."""
    own = text.rstrip(_BLANK)
    return "blank" if not own else "duplicate" if seen else None if own[-1] in ".!?" else "truncated"


def _steps(turns: list[tuple[str, str]], faults: list[str | None]) -> list[Step]:
    return [(role[:1], f in ("blank", "duplicate"), CUT_SHORT if f == "truncated" else 0) for (role, _), f in zip(turns, faults, strict=True)]


def _illegal(initials: list[str]) -> int:
    return sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:], strict=False))


_TURN = pa.struct([("role", pa.string()), ("text", pa.string())])
_COUNTS = ["blank", "duplicate", "truncated"]


def _columns(rows: list[tuple], names: list[str], kinds: list[pa.DataType]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)


def _told(turns: list[tuple[str, str]]) -> list[dict[str, str]]:
    return [{"role": r, "text": t} for r, t in turns]


def _whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Conversations of one block: faults, audit and repaired turns."""
    for batch in batches:
        for low in range(0, batch.num_rows, 256):
            part, rows = batch.slice(low, 256), []
            for conv, gaps, own in zip(*(part.column(k).to_pylist() for k in range(3)), strict=True):
                turns = [(x["role"], x["text"]) for x in own]
                seen: set[tuple[str, str]] = set()
                faults = []
                for turn in turns:
                    faults.append(fault(*turn, turn in seen))
                    seen.add(turn)
                cost, audit = cheapest(_steps(turns, faults))
                rows.append((conv, 0, 1, gaps, *(faults.count(f) for f in _COUNTS), _illegal([r[:1] for r, _ in turns]), cost, audit, _told(applied(turns, audit))))
            long = pa.int64()
            yield _columns(rows, ["conv_id", "block", "blocks", "gaps", *_COUNTS, "illegal", "cost", "audit", "turns"], [part.schema.field(0).type, *[long] * 8, pa.string(), pa.list_(_TURN)])


_ANY = [(s, t) for s in range(4) for t in range(4)]


def _tables(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of long conversations: counts of faults, initials at both ends, and the cheapest audit from each state to each."""
    kind = pa.list_(pa.struct([("s", pa.int32()), ("t", pa.int32()), ("cost", pa.int64()), ("audit", pa.string())]))
    for batch in batches:
        for k in range(batch.num_rows):
            conv, block, own = (batch.column(c)[k].as_py() for c in range(3))
            turns, faults = [(x["role"], x["text"]) for x in own], [fault(x["role"], x["text"], x["seen"]) for x in own]
            steps, initials = _steps(turns, faults), [r[:1] for r, _ in turns]
            found = [(s, t, cheapest(steps, s, (t,), block == 0)) for s, t in _ANY if block or s == 0]
            table = [{"s": s, "t": t, "cost": x[0], "audit": x[1]} for s, t, x in found if x]
            long, text = pa.int64(), pa.string()
            yield _columns([(conv, block, *(faults.count(f) for f in _COUNTS), _illegal(initials), initials[0], initials[-1], table)], ["conv_id", "block", *_COUNTS, "illegal", "first", "last", "table"], [batch.schema.field(0).type, *[long] * 5, text, text, kind])


def chosen(tables: list[dict[tuple[int, int], tuple[int, str]]]) -> list[tuple[int, int, str]]:
    """Of the blocks' tables (states to cost and audit) the path of least cost and audit: cost, entry state and audit of each block.

    From the last block back, every state's best way on is found. Of two audits of a block that lead to ways of the same
    cost, one may be the other's beginning (an insert at the cut): then the next letter of the shorter one's way decides.
    """
    after = {t: (0, "") for t in GOALS}  # cost of the way on, and its first letter
    ways = []
    for table in reversed(tables):
        own: dict[int, tuple[int, int, str]] = {}
        for (s, t), (cost, audit) in table.items():
            if t not in after:
                continue
            total = cost + after[t][0]
            if s not in own or total < own[s][0] or (total == own[s][0] and audit + after[t][1] < own[s][2] + after[own[s][1]][1]):
                own[s] = total, t, audit
        ways.append((table, own))
        after = {s: (total, (audit + after[t][1])[:1]) for s, (total, t, audit) in own.items()}
    out, s = [], 0
    for table, own in reversed(ways):
        _, t, audit = own[s]
        out.append((table[s, t][0], s, audit))
        s = t
    return out


def damaged(rows: DataFrame) -> DataFrame:
    """``rows`` (conv_id, turn, role, text; nulls read as one space) with faults by a checksum of conversation and turn; dropped rows stay, marked ``gone``."""
    word = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(word("conv_id"), F.lit(":"), word("turn")).cast("binary")) % 20
    text = F.when(kind == 1, "").when(kind == 2, F.regexp_replace(word("text"), "[.!?]", "")).otherwise(word("text"))
    own = rows.select("conv_id", F.col("turn").cast("long").alias("turn"), F.when(kind == 4, "user").otherwise(word("role")).alias("role"), text.alias("text"), (kind == 0).alias("gone"), F.when(kind == 3, 2).otherwise(1).alias("times"))
    return own.withColumn("times", F.explode(F.sequence(F.lit(1), "times"))).drop("times")


def _present(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, gone) with nulls as one space; ``gone`` is false unless ``rows`` says otherwise."""
    word = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    gone = F.coalesce("gone", F.lit(False)) if "gone" in rows.columns else F.lit(False)
    return rows.select("conv_id", F.col("turn").cast("long").alias("turn"), word("role").alias("role"), word("text").alias("text"), gone.alias("gone"))


def _gaps(low: Column, high: Column, distinct: Column) -> Column:
    return F.coalesce(high - low + 1 - distinct, F.lit(0)).cast("long")


def _short(rows: DataFrame, kind: str) -> DataFrame:
    turn = F.when(~F.col("gone"), F.struct("turn", "role", F.md5(F.col("text").cast("binary")).alias("m"), "text"))
    folded = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("own"))
    at = F.filter(F.transform("own", lambda x: x["turn"]), lambda x: x.isNotNull())
    gaps = _gaps(F.array_min(at), F.array_max(at), F.size(F.array_distinct(at)))
    return folded.select("conv_id", gaps.alias("gaps"), F.transform("own", lambda x: F.struct(x["role"].alias("role"), x["text"].alias("text"))).alias("own")).mapInArrow(_whole, f"conv_id {kind}, block long, blocks long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, turns array<struct<role: string, text: string>>")


def _long(rows: DataFrame, kind: str, size: int) -> DataFrame:
    """Conversations of more than ``size`` rows, a row a block; counts, gaps and cost of the whole stand in block 0."""
    by, counts = ["conv_id"], ["blank", "duplicate", "truncated", "illegal"]
    marked = rows.filter("NOT gone").withColumn("m", F.md5(F.col("text").cast("binary")))
    placed = stored(running(marked, by, ["turn", "role", "m"], "at"), "repair-placed")
    first = placed.groupBy("conv_id", "role", "m").agg(F.min("at").alias("first"))
    told = matched(placed, first, ["conv_id", "role", "m"]).select("conv_id", F.floor((F.col("at") - 1) / size).alias("block"), F.struct("at", "role", "text", (F.col("at") > F.col("first")).alias("seen")).alias("x"))
    blocks = stored(told.groupBy("conv_id", "block").agg(F.sort_array(F.collect_list("x")).alias("own")), "repair-blocks", (placed,))
    tables = stored(blocks.mapInArrow(_tables, f"conv_id {kind}, block long, blank long, duplicate long, truncated long, illegal long, first string, last string, table array<struct<s: int, t: int, cost: long, audit: string>>"), "repair-tables")

    def pick(own):
        own = own.sort_values("block")
        path = chosen([{(x["s"], x["t"]): (x["cost"], x["audit"]) for x in table} for table in own["table"]])
        cuts = _cuts(own["first"].tolist(), own["last"].tolist())
        found = own[["conv_id", "block"]].copy()
        found["cost"], found["state"], found["audit"] = zip(*path, strict=True)
        zero = found["block"] == 0
        for c in counts:
            found[c] = zero * (int(own[c].sum()) + (cuts if c == "illegal" else 0))
        found["cost"] = zero * int(found["cost"].sum())
        found["blocks"] = len(own)
        return found

    # a row of this table has a block's audits, 17 bytes a row of the conversation: what a conversation's own audit, one value, is made of
    way = tables.groupBy("conv_id").applyInPandas(pick, f"conv_id {kind}, block long, cost long, state int, audit string, blank long, duplicate long, truncated long, illegal long, blocks long")
    gaps = rows.filter("NOT gone").groupBy("conv_id").agg(_gaps(F.min("turn"), F.max("turn"), F.count_distinct("turn")).alias("gaps"))
    joined = matched(matched(blocks, stored(way, "repair-way"), [*by, "block"]), gaps, by).withColumn("gaps", F.when(F.col("block") == 0, F.col("gaps")).otherwise(0).cast("long"))

    def mend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                part = batch.slice(k, 1)
                own, audit, state = (part.column(c)[0].as_py() for c in ("own", "audit", "state"))
                turns = pa.array([_told(applied([(x["role"], x["text"]) for x in own], audit, state))], pa.list_(_TURN))
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in names), turns], names=[*names, "turns"])

    names = ["conv_id", "block", "blocks", "gaps", *counts, "cost", "audit"]
    return joined.select(*names, "own", "state").mapInArrow(mend, f"conv_id {kind}, block long, blocks long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, turns array<struct<role: string, text: string>>")


def _cuts(first: list[str], last: list[str]) -> int:
    """Illegal neighbours across the borders of blocks."""
    return sum(_illegal([a, b]) for a, b in zip(last, first[1:], strict=False))


def repaired(rows: DataFrame, block: int = BLOCK) -> DataFrame:
    """Every conversation of ``rows`` (conv_id, turn, role, text, perhaps ``gone``) repaired, a row a block of at most ``block`` turns.

    Columns: ``conv_id``, ``block`` (from 0), ``blocks``, ``audit`` and ``turns`` (role, text) of the block, and, of the whole
    conversation, in block 0: ``gaps`` (turn numbers missing between the least and the largest), ``blank``, ``duplicate``,
    ``truncated`` (rows by their first fault), ``illegal`` (neighbours whose role initials are not su, ua or au), ``cost``.

    Rows come by turn, nulls first, ties by role and the text's MD5. Null roles and texts read as one space, so such texts
    are blank and such roles cannot be kept; nor can an empty role. Rows with ``gone`` are left out, but their conversation
    stays. Null ids are one conversation. Repeated rows are duplicates. Other columns are ignored. An empty table gives an
    empty result.
    """
    own, kind = _present(rows), dict(rows.dtypes)["conv_id"]
    sizes = own.groupBy("conv_id").agg(F.count("*").alias("n")).filter(F.col("n") > block).select("conv_id")
    sizes = stored(sizes, "repair-long")  # one row for every ``block`` rows at most
    left = matched(own, sizes, ["conv_id"], "left_anti")
    found = _short(left, kind)
    if sizes.isEmpty():
        return found
    empty = matched(own, sizes, ["conv_id"], "left_semi")
    kept = empty.groupBy("conv_id").agg(F.count_if(~F.col("gone")).alias("n"))
    lost = matched(empty, kept.filter("n = 0").select("conv_id"), ["conv_id"], "left_semi").dropDuplicates(["conv_id"])
    return found.unionByName(_long(empty, kind, block)).unionByName(_short(lost, kind))


def digest(rows: DataFrame, block: int = BLOCK) -> DataFrame:
    """Per conversation of ``repaired``: conv_id, the counts, cost, audit and ``repaired_sha256`` of ``role:text`` lines."""
    found, counts = stored(repaired(rows, block), "repair-found"), ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    line = F.array_join(F.transform("turns", lambda x: F.concat(x["role"], F.lit(":"), x["text"])), "\n")
    whole = found.filter("blocks = 1").select("conv_id", *counts, "audit", F.sha2(line.cast("binary"), 256).alias("repaired_sha256"))
    kind = dict(rows.dtypes)["conv_id"]

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Blocks of a conversation come one after another: what is held is the state of the hash, and the audit."""
        held = None
        for batch in batches:
            for k in range(batch.num_rows):
                block, blocks, audit, turns = (batch.column(c)[k].as_py() for c in ("block", "blocks", "audit", "turns"))
                if block == 0:
                    held = (batch.slice(k, 1).select(["conv_id", *counts]), hashlib.sha256(), [], [True])
                own, state, audits, none = held
                for x in turns:
                    state.update(("" if none[0] else "\n").encode() + f"{x['role']}:{x['text']}".encode("utf-8", "surrogatepass"))
                    none[0] = False
                audits.append(audit)
                if block == blocks - 1:
                    yield pa.RecordBatch.from_arrays([*own.columns, pa.array(["".join(audits)]), pa.array([state.hexdigest()])], names=[*own.schema.names, "audit", "repaired_sha256"])

    longer = found.filter("blocks > 1").repartition("conv_id").sortWithinPartitions("conv_id", "block")
    longer = longer.mapInArrow(hashed, f"conv_id {kind}, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string")
    return whole.unionByName(longer)
