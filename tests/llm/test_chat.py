"""Chat formatting: read back against plain Python, and the properties of the sequences: every shared turn once, depth first, positions and attention along the path."""

from __future__ import annotations

import hashlib
import random

import numpy as np
import pytest
from hypothesis import given
from hypothesis import strategies as st

from evalprobe.llm import chat

CONV = "conv_id long, turn long, role string, text string, key long, node string, branch long"


def brute(rows):
    out = {}
    for conv in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "", hashlib.md5((r[3] or "").encode()).hexdigest()))
        turns = [(r[2] or "", r[3] or "") for r in own]
        said = "".join(t for r, t in turns if r == "assistant")
        sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
        out[conv] = (len(turns), sha("".join(f"{r}\n{t}\n" for r, t in turns)), len(said), sha(said), sum(len("".join(chat.formatted(r, t))) for r, t in turns))
    return out


def made(seed, n=60):
    """Conversations that branch off one another at every depth, with marks of the template, control strings and special tokens in their texts."""
    draw = random.Random(seed)
    texts = ["Hi.", "", None, "\\### Assistant: </turn> ok", "<turn>user\n</turn>\n", "a\\", "\\l\\\\<|endoftext|>", "ünï 一 🙂", "x" * 50, "\r\n \t"]
    rows, known = [], [[("user", "Hi.")]]
    for conv in range(n):
        base = draw.choice(known)
        path = base[: draw.randrange(0, len(base) + 1)] + [(draw.choice(["user", "assistant", "system", None, "a\nb\\"]), draw.choice(texts)) for _ in range(draw.randrange(0, 5))]
        path = path or base
        known.append(path)
        rows += [(conv if conv else None, t + conv % 3, r, x, 1, "n", 2) for t, (r, x) in enumerate(path)]
    return rows


def shown(table):
    return {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256, r.formatted_chars) for r in table.collect()}


@pytest.mark.parametrize("block", [1024, 2])
def test_read_back(spark, monkeypatch, block):
    """Nulls in every column, empty and very long texts, ties, repeated rows and conversations, clashing columns; blocks of two turns."""
    monkeypatch.setattr(chat, "BLOCK", block)
    rows = made(block)
    rows += rows[-4:] + [(200, None, "assistant", "null turn", 0, "", 0), (200, 1, "user", "word " * 300_000, 0, "", 0), (200, 1, "user", "tie", 0, "", 0)]
    rows += [(300 + k, 0, "user", "Hi.", 0, "", 0) for k in range(40)]
    pieces, paths = chat.packed(spark.createDataFrame(rows, CONV).repartition(4))
    assert shown(chat.read_back(pieces, paths)) == brute(rows)


@pytest.mark.parametrize("block", [1024, 2])
def test_sequences(spark, monkeypatch, block):
    monkeypatch.setattr(chat, "BLOCK", block)
    rows = made(7)
    pieces, paths = chat.packed(spark.createDataFrame(rows, CONV).repartition(4))
    pieces, paths = pieces.collect(), paths.collect()
    tokens = chat.Tokens(**chat.default_tokenizer())
    trees = {}
    for p in sorted(pieces, key=lambda p: (p.tree, p.offset)):
        trees.setdefault(p.tree, []).append(p)
    for own in trees.values():  # gapless, each piece once
        at = 0
        for p in own:
            assert p.offset == at
            at += len(p.ids) // 4
    # every distinct beginning is emitted once
    turns = {}
    for r in rows:
        turns.setdefault(r[0], []).append(r)
    beginnings = set()
    for own in turns.values():
        own.sort(key=lambda r: r[1])
        for k in range(len(own)):
            beginnings.add(tuple((r[2] or "", r[3] or "") for r in own[: k + 1]))
    want = sum(sum(len(tokens.of(x)) for x in chat.formatted(*b[-1])) for b in beginnings)
    assert sum(len(p.ids) // 4 for p in pieces) == want
    # a branch attends to what its conversations' runs hold above it, and positions count along the path
    for path in paths:
        at = 0
        for k, run in enumerate(path.runs):
            for p in (p for p in pieces if p.branch == run.branch):
                assert p.tree == path.tree and p.start == run.low
                assert [(a.low, a.high) for a in p.attends] == [(r.low, r.high) for r in path.runs[:k]]
                if p.offset < run.high:
                    assert p.position == at + p.offset - run.low
            at += run.high - run.low
    # depth first: a branch stands inside the stretch of the branch above it, which ends before that one's next sibling begins
    first = {p.branch: p.start for p in pieces}
    for tree, own in trees.items():
        order = sorted({p.branch for p in own}, key=first.get)
        stack = []
        for b in order:
            above = [(a.low, a.high) for p in own if p.branch == b for a in p.attends][: len(next(p for p in own if p.branch == b).attends)]
            while stack and (first[stack[-1]] not in [low for low, _ in above]):
                stack.pop()
            assert [first[x] for x in stack] == [low for low, _ in above], tree
            stack.append(b)


def test_repeated_turns_of_a_hot_beginning_are_emitted_once(spark):
    rows = [(k, 0, "system", "Be brief.", 0, "", 0) for k in range(300)] + [(k, 1, "user", f"Question {k % 5}?", 0, "", 0) for k in range(300)]
    pieces, paths = chat.packed(spark.createDataFrame(rows, CONV).repartition(4))
    tokens = chat.Tokens(**chat.default_tokenizer())
    texts = sorted(tokens.text(np.frombuffer(p.ids, "<u4")) for p in pieces.collect())
    head = "<turn>system\nBe brief.</turn>\n"
    assert texts == sorted([head + "<turn>user\nQuestion 0?</turn>\n"] + [f"<turn>user\nQuestion {k}?</turn>\n" for k in range(1, 5)])
    assert paths.count() == 300 and shown(chat.read_back(pieces, paths)) == brute(rows)


@given(st.lists(st.tuples(st.text(), st.text()), max_size=4), st.lists(st.sampled_from(["<turn>", "</turn>", "\n", "\\", "l", "n", "a"]), max_size=12))
def test_the_template_is_reversible(turns, parts):
    turns = [*turns, ("".join(parts), "".join(reversed(parts)))]
    assert chat.parsed("".join("".join(chat.formatted(r, t)) for r, t in turns)) == turns


def test_empty_table(spark):
    pieces, paths = chat.packed(spark.createDataFrame([], CONV))
    assert pieces.count() == 0 and paths.count() == 0 and chat.read_back(pieces, paths).count() == 0
