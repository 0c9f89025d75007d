"""Conversation repair against a plain search by columns, with conversations in one block and in many."""

from __future__ import annotations

import hashlib
import random
import re
import zlib

import pytest

from evalprobe.llm import repair

CONV = "conv_id long, turn long, role string, text string, block long, n long"


def edits(rows):
    """Cost and least audit, and the roles and texts it gives: columns one after another, all audits of least cost compared."""
    follows = {"": "su", "s": "u", "u": "a", "a": "u"}

    def inserted(states):
        for _ in range(4):
            for state, (cost, audit, out) in list(states.items()):
                for r in follows[state].replace("s", ""):
                    new = (cost + 3, audit + "I", out + [({"u": "user", "a": "assistant"}[r], "")])
                    if r not in states or new[:2] < states[r][:2]:
                        states[r] = new
        return states

    states = inserted({"": (0, "", [])})
    for role, text, fault in rows:
        new = {}

        def put(r, x, new=new):
            if r not in new or x[:2] < new[r][:2]:
                new[r] = x

        for state, (cost, audit, out) in states.items():
            put(state, (cost + 4, audit + "D", out))
            if fault in ("blank", "duplicate"):
                continue
            more = 3 * (fault == "truncated")
            for r in follows[state]:
                if role[:1] == r:
                    put(r, (cost + more, audit + "K", out + [(role, text)]))
                if r != "s":
                    put(r, (cost + more + 3, audit + "R", out + [({"u": "user", "a": "assistant"}[r], text)]))
        states = inserted(new)
    return min((states[s] for s in ("", "a") if s in states), key=lambda x: x[:2])


def brute(rows):
    out = {}
    for conv in {r[0] for r in rows}:
        own = []
        for c, turn, role, text in (r[:4] for r in rows if r[0] == conv):
            role, text = (" " if x is None else x for x in (role, text))
            kind = zlib.crc32(f"{' ' if c is None else c}:{' ' if turn is None else turn}".encode()) % 20
            if kind == 0:
                continue
            text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
            own += [(turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.md5(r[2].encode()).hexdigest()))
        seen, told = set(), []
        for _, role, text in own:
            bare = re.sub("[ \t-\r]+$", "", text)
            told.append((role, text, "blank" if not bare else "duplicate" if (role, text) in seen else None if bare[-1] in ".!?" else "truncated"))
            seen.add((role, text))
        cost, audit, fixed = edits(told)
        turns = {r[0] for r in own if r[0] is not None}
        count = lambda f: sum(x[2] == f for x in told)  # noqa: E731, B023
        illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(told, told[1:], strict=False))
        sha = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in fixed).encode()).hexdigest()
        out[conv] = (max(turns) - min(turns) + 1 - len(turns) if turns else 0, count("blank"), count("duplicate"), count("truncated"), illegal, cost, audit, sha)
    return out


def made(seed, convs, turns, roles=("system", "user", "user", "assistant", "assistant", "tool", None, "")):
    draw = random.Random(seed)
    texts = ["One.", "Two?", "cut", " \t", None, "End. \n", "x" * 30 + "!", ""]
    rows = []
    for conv in convs:
        for turn in range(draw.randrange(1, turns)):
            text = draw.choice(texts)
            rows.append((conv, None if draw.random() < 0.05 else turn + 3 * (draw.random() < 0.1), draw.choice(roles), text if draw.random() < 0.3 else f"{turn} {text}", 1, 2))
    return rows


def found(spark, rows, block):
    table = repair.damaged(spark.createDataFrame(rows, CONV).repartition(3))
    return {r.conv_id: (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, r.repaired_sha256) for r in repair.digest(table, block).collect()}


@pytest.mark.parametrize("block", [1024, 4, 1])
def test_against_a_search_by_columns(spark, block):
    """Nulls in every column, repeated rows, ties, several rows a turn, dropped conversations; whole and in blocks."""
    rows = made(1, [*range(40), None], 14) + made(2, [100], 40)
    rows += rows[:7] + [(50, 0, "user", "long " * 200_000 + ".", 1, 2), (50, 1, "assistant", None, 1, 2)]
    gone = next(c for c in range(1000, 2000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    rows += [(gone, 0, "user", "a.", 1, 2)] * 3
    want = brute(rows)
    assert want[gone][6:] == ("", hashlib.sha256(b"").hexdigest()) and found(spark, rows, block) == want


def test_blocks_give_what_the_whole_gives():
    """The least audit over the tables of blocks is the least of the whole, for every cut."""
    draw = random.Random(5)
    for _ in range(300):
        steps = [(draw.choice("suaaut"), draw.random() < 0.2, draw.choice((0, 0, 3))) for _ in range(draw.randrange(1, 12))]
        want, size = repair.cheapest(steps), draw.randrange(1, 6)
        parts = [steps[k : k + size] for k in range(0, len(steps), size)]
        tables = [{(s, t): x for s in range(4) for t in range(4) if (x := repair.cheapest(p, s, (t,), k == 0))} for k, p in enumerate(parts)]
        path = repair.chosen(tables)
        assert (sum(c for c, _, _ in path), "".join(a for _, _, a in path)) == want


def test_both_searches_meet_at_the_least_audit():
    draw = random.Random(6)
    for _ in range(500):
        faults = [(draw.choice(["system", "user", "assistant", "tool"]), "x", draw.choice([None, None, None, "blank", "duplicate", "truncated"])) for _ in range(draw.randrange(0, 9))]
        steps = [(r[:1], f in ("blank", "duplicate"), 3 * (f == "truncated")) for r, _, f in faults]
        assert repair.cheapest(steps) == edits(faults)[:2]


def test_general_interface_and_empty_table(spark):
    rows = [(1, 0, "user", "Hi.", 0, 0), (1, 1, "user", "Again.", 0, 0), (2, 0, "assistant", "Oh.", 0, 0)]
    got = {r.conv_id: (r.audit, [(t.role, t.text) for t in r.turns]) for r in repair.repaired(spark.createDataFrame(rows, CONV)).collect()}
    assert got[1] == ("KR", [("user", "Hi."), ("assistant", "Again.")])
    assert got[2] == ("IK", [("user", ""), ("assistant", "Oh.")])
    empty = spark.createDataFrame([], CONV)
    assert repair.digest(repair.damaged(empty)).count() == 0 and repair.repaired(empty).count() == 0
