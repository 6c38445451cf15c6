"""Conversation repair against exhaustive search."""

from __future__ import annotations

import hashlib
import random
import zlib

import numpy as np
import pytest

from haulmark.llm import conversations
from haulmark.llm.conversations import damaged, digest, repair

SPACE = " \t\n\x0b\f\r"
READS = [{"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2}]
NAMES = {"u": "user", "a": "assistant"}
SCHEMA = "conv_id long, turn long, role string, text string, copies int, task string, block int, hash long, cost string"


def damage(rows):
    """Rows of each conversation after damage, in order."""
    shown = lambda x: " " if x is None else str(x)
    out: dict = {}
    for conv, turn, role, text in rows:
        left = out.setdefault(conv, [])
        kind = zlib.crc32(f"{shown(conv)}:{shown(turn)}".encode()) % 20
        role, text = shown(role), shown(text)
        text = {1: "", 2: text.translate(str.maketrans("", "", ".!?"))}.get(kind, text)
        left += [(turn, "user" if kind == 4 else role, text)] * {0: 0, 3: 2}.get(kind, 1)
    return {c: sorted(left, key=lambda r: (r[0] is not None, r[0] or 0, r[1])) for c, left in out.items()}


def cheapest(rows):
    """The contract's columns by keeping the best edits of every state."""
    seen, faults, items = set(), [0, 0, 0], []
    for _, role, text in rows:
        visible, again = text.rstrip(SPACE), (role, text) in seen
        seen.add((role, text))
        fault = 0 if not visible else 1 if again else 2 if visible[-1] not in ".!?" else None
        if fault is not None:
            faults[fault] += 1
        items.append((role, text, fault in (0, 1), fault == 2))

    def with_insertions(best):
        for _ in range(3):
            for s, (c, a, out) in list(best.items()):
                for r, t in READS[s].items():
                    if r in NAMES and (c + 5, a + "I") < best.get(t, (10**9,))[:2]:
                        best[t] = (c + 5, a + "I", [*out, f"{NAMES[r]}:"])
        return best

    best = {0: (0, "", [])}
    for role, text, gone, cut in items:
        after: dict = {}
        for s, (c, a, out) in with_insertions(best).items():
            ways = [(s, (c + 2, a + "D", out))]
            for r, t in {} if gone else READS[s].items():
                if role[:1] == r:
                    ways.append((t, (c + 5 * cut, a + "K", [*out, f"{role}:{text}"])))
                if r in NAMES:
                    ways.append((t, (c + 1 + 5 * cut, a + "R", [*out, f"{NAMES[r]}:{text}"])))
            for t, way in ways:
                if way[:2] < after.get(t, (10**9,))[:2]:
                    after[t] = way
        best = after
    cost, audit, out = min((v for s, v in with_insertions(best).items() if s in (0, 3)), key=lambda v: v[:2])
    initials = [r[1][:1] for r in rows]
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:], strict=False))
    turns = [r[0] for r in rows if r[0] is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    return (gaps, *faults, illegal, cost, audit, hashlib.sha256("\n".join(out).encode()).hexdigest())


def dialogue(rng, n):
    texts = ["Yes.", "no", "What?", "", " \n", "Go on.", "Fine!", "well", None, "Tail. \t", "é."]
    roles = ["user", "assistant"] * 4 + ["system", "tool", "", "s", None, "User"]
    return [(rng.choice(roles), rng.choice(texts) if rng.random() < 0.4 else f"{rng.random()}{rng.choice(['.', ''])}") for _ in range(n)]


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(4)
    rows = [(c, t, *m) for c in range(150) for t, m in enumerate(dialogue(rng, rng.randrange(1, 12)))]
    rows += [(200, t * 2, *m) for t, m in enumerate(dialogue(rng, 700))]
    rows += [(None, t, *m) for t, m in enumerate(dialogue(rng, 9))] + [(201, None, "user", "One."), (201, None, "assistant", "Two.")]
    dropped = next(i for i in range(10**4) if zlib.crc32(f"300:{i}".encode()) % 20 == 0)
    long = "word " * 50_000 + "."
    return [*rows, (300, dropped, "user", "Gone."), (301, 7, "user", long), (301, 8, "assistant", long)]


def got(spark, rows, partitions=4):
    clashing = [(*r, 5, "t", 6, 7, "c") for r in rows]
    df = spark.createDataFrame(clashing, SCHEMA).repartition(partitions)
    return {r[0]: tuple(r)[1:] for r in digest(repair(df, **damaged(df))).collect()}


@pytest.mark.parametrize("block", [1024, 3])
def test_repair_is_the_cheapest(spark, rows, monkeypatch, block):
    monkeypatch.setattr(conversations, "BLOCK", block)
    want = {c: cheapest(left) for c, left in damage(rows).items()}
    assert got(spark, rows) == want
    assert want[300] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())


def test_one_conversation_over_many_tasks(spark, monkeypatch):
    monkeypatch.setattr(conversations, "BLOCK", 16)
    rng = random.Random(5)
    rows = [(1, t, *m) for t, m in enumerate(dialogue(rng, 600))]
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert got(spark, rows, 7) == {1: cheapest(damage(rows)[1])}
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)


def test_pieces_hold_the_repaired_messages(spark):
    rows = [(1, 0, "user", "Hi."), (1, 1, "user", "Hi."), (1, 2, "assistant", "Hello."), (2, 0, "assistant", "Alone.")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    out = {r.conv_id: r for r in repair(df).collect()}
    assert (out[1].audit, out[1].roles, out[1].texts) == ("KDK", ["user", "assistant"], ["Hi.", "Hello."])
    assert (out[2].audit, out[2].cost, out[2].roles) == ("D", 2, [])


def test_repeated_rows_and_an_empty_table(spark):
    rows = [(1, 5, "user", "Same.")] * 4 + [(1, 6, "assistant", "Ok.")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(5)
    row = digest(repair(df)).first()
    assert (row.duplicate, row.audit, row.cost, row.gaps) == (3, "KDDDK", 6, 0)
    assert digest(repair(df.limit(0))).collect() == []


def test_halving_equals_one_sweep():
    rng = np.random.default_rng(6)
    for n in (1, 2, 3, 7, 40):
        codes = rng.integers(0, conversations._GONE + 1, n)
        end = conversations._ACCEPT[None, :]
        after = conversations.paths(conversations.ROWS, codes, np.array([0, n]), np.zeros(1, np.int64), end)
        states = [0, *after.tolist()]
        steps = [conversations._STEPS[c, s, e] for c, s, e in zip(codes.tolist(), states, states[1:], strict=False)]
        cost, place = conversations.forward(conversations.ROWS, codes, np.array([0]), np.array([n]), np.zeros(1, np.int64))
        assert sum(s.cost for s in steps) + end[0, states[-1]] == (cost + end).min()
