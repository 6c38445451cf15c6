"""Conversation structure repair by Hirschberg's divide and conquer.

A conversation's role initials should read ``(s?(ua)+)?``: nothing, or user and assistant in
turn after at most one system message. Its rows are kept (0), given the other role (1) or
deleted (2, blank rows and copies always); empty user or assistant messages may be inserted
(5); a truncated row that stays adds 5. The cheapest edits are wanted, and of these the ones
whose initials, the audit, come first in ASCII order.

Reading the pattern takes four states. The cheapest ways to the middle of a run of rows are a
forward vector of four costs, those from there to its end a backward vector; the crossing with
the smallest sum lies on a cheapest path. Beside each forward cost stands the place of its
least audit among the four. Audits of different states end in the operation of the same row, so
none begins another and places follow from places; of equal sums the crossing with the
least audit is taken. Both halves are then solved alike, down to single rows: linear space, and
runs of many conversations are solved side by side in numpy.

Rows are sorted by range, so a conversation of any length is spread over tasks, and cut into
blocks of at most ``BLOCK`` rows. A block that is a whole conversation is repaired where it is.
Other blocks first find which of their rows an earlier block holds, by a shuffle of hashes;
each then turns into a 4 x 4 table of costs and places, the tables of a conversation are solved
by the same divide and conquer, and every block is repaired between the two states found.

Defined results: a missing role or text is one space, so a missing text is blank, a missing role
has no role's initial. Rows with no turn come first and do not count for gaps; rows of the same
turn come by role, then by a 64-bit hash of the text, then by text. A missing conv_id is a
conversation of its own. An empty role cannot be kept. Equality of two 64-bit hashes stands for
equality of role and text. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from haulmark.llm.common import arrow_schema, keep, record

#: Rows of a block at most, and bytes of text at which one is closed.
BLOCK = 1024
BLOCK_BYTES = 8 << 20
KEEP, REROLE, DELETE, INSERT = 0, 1, 2, 5
TRUNCATED = 5

_INF = 1 << 50
_STATES = 4
#: States: nothing yet, after system, after user, after assistant. What each may read next.
_NEXT = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
_NAMES = {"u": "user", "a": "assistant"}
_SPACE = " \t\n\x0b\f\r"
_KINDS = [(initial, cut) for initial in "sua?" for cut in (False, True)]
#: The code of a row that has to go.
_GONE = len(_KINDS)


def _inserted(state: int) -> dict[int, str]:
    """Where insertions lead, and the roles inserted."""
    found = {state: ""}
    at, roles = state, ""
    for _ in range(2):
        role = "a" if at == 2 else "u"
        at, roles = _NEXT[at][role], roles + role
        found.setdefault(at, roles)
    return found


@dataclass(frozen=True)
class Step:
    """The least edits of one row from a state to another."""

    cost: int
    audit: str
    #: Roles of what is inserted before the row, and the row's new role (empty: its own; None: gone).
    inserted: str
    role: str | None


def _step(code: int, start: int, end: int) -> Step | None:
    ways = []
    for at, roles in _inserted(start).items():
        before, marks = INSERT * len(roles), "I" * len(roles)
        if at == end:
            ways.append(Step(before + DELETE, marks + "D", roles, None))
        if code == _GONE:
            continue
        initial, cut = _KINDS[code]
        more = before + TRUNCATED * cut
        for role, to in _NEXT[at].items():
            if to == end and role == initial:
                ways.append(Step(more + KEEP, marks + "K", roles, ""))
            if to == end and role in _NAMES:
                ways.append(Step(more + REROLE, marks + "R", roles, _NAMES[role]))
    return min(ways, key=lambda w: (w.cost, w.audit), default=None)


_STEPS = {(c, s, e): _step(c, s, e) for c, s, e in product(range(_GONE + 1), range(_STATES), range(_STATES))}
_TAILS = [_inserted(s) for s in range(_STATES)]
#: Insertions at the end of a conversation, and their cost.
_TAIL = ["" if s in (0, 3) else _TAILS[s][3] for s in range(_STATES)]
_ACCEPT = np.array([INSERT * len(t) for t in _TAIL], dtype=np.int64)


@dataclass(frozen=True)
class Steps:
    """Costs of steps from state to state, and the place of their audits among those of a start."""

    cost: np.ndarray
    place: np.ndarray


def _row_steps() -> Steps:
    cost = np.full((_GONE + 1, _STATES, _STATES), _INF, dtype=np.int64)
    place = np.zeros_like(cost)
    for (c, s, e), step in _STEPS.items():
        if step is not None:
            cost[c, s, e] = step.cost
    for c, s in product(range(_GONE + 1), range(_STATES)):
        audits = ["~" if (x := _STEPS[c, s, e]) is None else x.audit for e in range(_STATES)]
        place[c, s] = np.argsort(np.argsort(audits, kind="stable"), kind="stable")
    return Steps(cost, place)


ROWS = _row_steps()


def forward(steps: Steps, codes: np.ndarray, low: np.ndarray, high: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least cost from ``start`` to each state over codes[low:high] of each run, and places."""
    n = len(low)
    cost = np.full((n, _STATES), _INF, dtype=np.int64)
    cost[np.arange(n), start] = 0
    place = np.tile(np.arange(_STATES), (n, 1))
    size = high - low
    order = np.argsort(-size, kind="stable")
    active = np.searchsorted(-size[order], 0, side="left")
    for i in range(int(size.max(initial=0))):
        while active and size[order[active - 1]] <= i:
            active -= 1
        run = order[:active]
        code = codes[low[run] + i]
        # the sum and, below it, the place of the audit that it continues
        total = (cost[run][:, :, None] + steps.cost[code]) * _STATES + place[run][:, :, None]
        best = total.argmin(1)
        least = np.take_along_axis(total, best[:, None, :], 1)[:, 0, :]
        rank = (least % _STATES) * _STATES + np.take_along_axis(steps.place[code], best[:, None, :], 1)[:, 0, :]
        cost[run] = np.minimum(least // _STATES, _INF)
        place[run] = rank.argsort(1, kind="stable").argsort(1, kind="stable")
    return cost, place


def backward(steps: Steps, codes: np.ndarray, low: np.ndarray, high: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Least cost from each state over codes[low:high] to what ``end`` asks for each last state."""
    cost = end.copy()
    size = high - low
    order = np.argsort(-size, kind="stable")
    active = len(order)
    for i in range(int(size.max(initial=0))):
        while active and size[order[active - 1]] <= i:
            active -= 1
        run = order[:active]
        cost[run] = np.minimum((steps.cost[codes[high[run] - 1 - i]] + cost[run][:, None, :]).min(2), _INF)
    return cost


def paths(steps: Steps, codes: np.ndarray, edges: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The state after every code on the least path of each run codes[edges[i]:edges[i + 1]]."""
    after = np.zeros(len(codes), dtype=np.int64)
    some = np.flatnonzero(np.diff(edges) > 0)
    low, high, start, end = edges[some], edges[some + 1], start[some], end[some]
    while len(low):
        one = high - low == 1
        if one.any():
            code, s = codes[low[one]], start[one]
            total = (steps.cost[code, s] + end[one]) * _STATES + steps.place[code, s]
            after[low[one]] = total.argmin(1)
        low, high, start, end = low[~one], high[~one], start[~one], end[~one]
        if not len(low):
            break
        middle = (low + high) // 2
        there, place = forward(steps, codes, low, middle, start)
        onward = backward(steps, codes, middle, high, end)
        cross = ((there + onward) * _STATES + place).argmin(1)
        only = np.full((len(low), _STATES), _INF, dtype=np.int64)
        only[np.arange(len(low)), cross] = 0
        low, high = np.concatenate((low, middle)), np.concatenate((middle, high))
        start, end = np.concatenate((start, cross)), np.concatenate((only, end))
    return after


def tables(codes: np.ndarray, edges: np.ndarray) -> Steps:
    """What each run of rows costs from state to state, with places."""
    n = len(edges) - 1
    low, high = np.repeat(edges[:-1], _STATES), np.repeat(edges[1:], _STATES)
    cost, place = forward(ROWS, codes, low, high, np.tile(np.arange(_STATES), n))
    return Steps(cost.reshape(n, _STATES, _STATES), place.reshape(n, _STATES, _STATES))


# --- blocks ------------------------------------------------------------------------------

_PIECE = (
    "conv_id long, task int, block int, whole boolean, rows long, first_turn long, last_turn long, turns long, "
    "first_initial string, last_initial string, illegal long, blank long, duplicate long, truncated long, "
    "cost long, audit string, roles array<string>, texts array<string>"
)
_OPEN = _PIECE + ", codes binary, hashes binary"
_KEYS = ["task", "block"]


@dataclass
class _Block:
    """Rows of one conversation, in order."""

    roles: list[str] = field(default_factory=list)
    texts: list[str] = field(default_factory=list)
    turns: list[int | None] = field(default_factory=list)
    blank: list[bool] = field(default_factory=list)
    cut: list[bool] = field(default_factory=list)
    hashes: list[tuple[int, int]] = field(default_factory=list)
    size: int = 0


def _initial(role: str) -> str:
    return role[:1]


def _illegal(before: str, after: str) -> bool:
    return before + after not in ("su", "ua", "au")


def _facts(block: _Block) -> dict:
    """What does not depend on other blocks."""
    turns = [t for t in block.turns if t is not None]
    initials = [_initial(r) for r in block.roles]
    return {
        "rows": len(block.roles),
        "first_turn": turns[0] if turns else None,
        "last_turn": turns[-1] if turns else None,
        "turns": sum(a != b for a, b in zip(turns, turns[1:], strict=False)) + bool(turns),
        "first_initial": initials[0] if initials else None,
        "last_initial": initials[-1] if initials else None,
        "illegal": sum(map(_illegal, initials, initials[1:])),
    }


def _codes(block: _Block, seen: set) -> tuple[list[int], dict]:
    """Codes of the rows, and counts of first faults; ``seen`` are rows of earlier blocks."""
    codes, faults = [], {"blank": 0, "duplicate": 0, "truncated": 0}
    seen = set(seen)
    for role, blank, cut, key in zip(block.roles, block.blank, block.cut, block.hashes, strict=True):
        again = key in seen
        seen.add(key)
        faults["blank"] += blank
        faults["duplicate"] += again and not blank
        faults["truncated"] += cut and not again and not blank
        initial = _initial(role)
        gone = blank or again
        codes.append(_GONE if gone else 2 * "sua?".index(initial if initial and initial in "sua" else "?") + cut)
    return codes, faults


def _edited(block_roles: list, block_texts: list, codes: list, after: list, start: int, last: bool) -> dict:
    """Cost, audit and repaired rows of a block between two states; ``last`` ends the conversation."""
    cost, audit, roles, texts, at = 0, [], [], [], start
    for role, text, code, to in zip(block_roles, block_texts, codes, after, strict=True):
        step = _STEPS[code, at, to]
        cost += step.cost
        audit.append(step.audit)
        roles += [_NAMES[r] for r in step.inserted]
        texts += [""] * len(step.inserted)
        if step.role is not None:
            roles.append(step.role or role)
            texts.append(text)
        at = to
    if last:
        cost += int(_ACCEPT[at])
        audit.append("I" * len(_TAIL[at]))
        roles += [_NAMES[r] for r in _TAIL[at]]
        texts += [""] * len(_TAIL[at])
    return {"cost": cost, "audit": "".join(audit), "roles": roles, "texts": texts}


def _solve(codes: list[list[int]], start: list[int], end: np.ndarray) -> list[list[int]]:
    edges = np.cumsum([0, *map(len, codes)])
    flat = np.fromiter((c for x in codes for c in x), np.int64, int(edges[-1]))
    after = paths(ROWS, flat, edges, np.array(start, dtype=np.int64), end).tolist()
    return [after[edges[i] : edges[i + 1]] for i in range(len(codes))]


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(c.to_pylist() for c in batch.columns), strict=True)


def prepare(conversations: DataFrame, conv: str, turn: str, role: Column, text: Column, copies: Column) -> DataFrame:
    """Rows to repair in order; a conversation whose rows all have no copies leaves one mark."""
    rows = conversations.select(
        F.col(conv).cast("long").alias("conv_id"),
        F.col(turn).cast("long").alias("turn"),
        F.coalesce(role.cast("string"), F.lit(" ")).alias("role"),
        F.coalesce(text.cast("string"), F.lit(" ")).alias("text"),
        copies.alias("copies"),
    )
    visible = F.rtrim(F.col("text"), F.lit(_SPACE))
    gone = F.col("copies") == 0
    marked = rows.select(
        "conv_id",
        F.when(~gone, F.col("turn")).alias("turn"),
        F.when(~gone, F.col("role")).otherwise("").alias("role"),
        F.when(~gone, F.col("text")).otherwise("").alias("text"),
        gone.alias("gone"),
        (visible == "").alias("blank"),
        (~F.substring(visible, -1, 1).isin(".", "!", "?")).alias("cut"),
        F.xxhash64("text").alias("hash"),
        F.xxhash64("role", F.lit(1), "text").alias("again"),
        F.monotonically_increasing_id().alias("at"),
        F.explode(F.sequence(F.lit(1), F.greatest(F.col("copies"), F.lit(1)))).alias("copy"),
    )
    # equal rows may be parted anywhere, so their place in the input spreads them
    return marked.repartitionByRange("conv_id", "turn", "role", "hash", "at").sortWithinPartitions(
        "conv_id", "turn", "role", "hash", "text", "at"
    )


def _blocks(rows: DataFrame) -> DataFrame:
    """Sorted rows as blocks; those that are whole conversations are repaired."""
    schema = arrow_schema(_OPEN)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, number = TaskContext.get().partitionId(), 0
        ready: list[tuple[int | None, _Block, bool]] = []

        def flush() -> pa.RecordBatch:
            nonlocal number
            out: dict[str, list] = {f.name: [] for f in schema}
            made = [_codes(b, set()) for _, b, _ in ready]
            end = np.tile(_ACCEPT, (len(ready), 1))
            closed = [i for i, x in enumerate(ready) if x[2]]
            after = dict(zip(closed, _solve([made[i][0] for i in closed], [0] * len(closed), end[closed]), strict=True))
            for i, (conv, block, whole) in enumerate(ready):
                codes, faults = made[i]
                row = {"conv_id": conv, "task": task, "block": number, "whole": whole} | _facts(block)
                if whole:
                    row |= faults | _edited(block.roles, block.texts, codes, after[i], 0, True)
                    row |= {"codes": None, "hashes": None}
                else:
                    flags = np.array([block.blank, block.cut], dtype=np.uint8)
                    row |= dict.fromkeys(("blank", "duplicate", "truncated", "cost", "audit"))
                    row |= {"roles": block.roles, "texts": block.texts, "codes": flags.tobytes()}
                    row |= {"hashes": np.array(block.hashes, dtype=np.int64).tobytes()}
                number += 1
                for name, value in row.items():
                    out[name].append(value)
            ready.clear()
            return record(out, schema)

        current, conv, begun, held = _Block(), None, False, 0
        whole = False  # the first conversation of a task may have begun in the one before
        for conv_id, turn, role, text, gone, blank, cut, h1, h2 in _rows(batches):
            if begun and (conv_id != conv or len(current.roles) == BLOCK or current.size > BLOCK_BYTES):
                new = conv_id != conv
                ready.append((conv, current, whole and new))
                held += current.size + 200 * len(current.roles)
                current, whole = _Block(), new
                if held > BLOCK_BYTES or len(ready) == 2000:
                    yield flush()
                    held = 0
            conv, begun = conv_id, True
            if not gone:
                current.roles.append(role)
                current.texts.append(text)
                current.turns.append(turn)
                current.blank.append(blank)
                current.cut.append(cut)
                current.hashes.append((h1, h2))
                current.size += len(text)
        if begun:
            ready.append((conv, current, False))  # it may go on in the next task
            yield flush()

    narrow = rows.select("conv_id", "turn", "role", "text", "gone", "blank", "cut", "hash", "again")
    return keep(narrow.mapInArrow(run, _OPEN), "conversation-blocks")


def _known(row: dict) -> _Block:
    flags = np.frombuffer(row["codes"], dtype=np.uint8).reshape(2, -1).astype(bool).tolist()
    hashes = np.frombuffer(row["hashes"], dtype=np.int64).reshape(-1, 2).tolist()
    return _Block(row["roles"], row["texts"], [], flags[0], flags[1], [tuple(h) for h in hashes])


def _earlier(blocks: DataFrame) -> DataFrame:
    """For each block the hashes of its rows that an earlier block of the conversation holds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                pairs = np.unique(np.frombuffer(row["hashes"], dtype=np.int64).reshape(-1, 2), axis=0)
                n = len(pairs)
                cols = {k: [row[k]] * n for k in ("conv_id", "task", "block")}
                yield record(cols | {"h1": pairs[:, 0], "h2": pairs[:, 1]}, schema)

    ddl = "conv_id long, task int, block int, h1 long, h2 long"
    schema = arrow_schema(ddl)
    rows = blocks.select("conv_id", "task", "block", "hashes").mapInArrow(run, ddl)
    key = ["conv_id", "h1", "h2"]
    place = F.struct("task", "block")
    first = rows.groupBy(*key).agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("n"))
    again = first.filter(F.col("n") > 1).select(*[F.col(c).alias(f"_{c}") for c in key], "first")
    same = rows["conv_id"].eqNullSafe(F.col("_conv_id")) & (F.col("h1") == F.col("_h1")) & (F.col("h2") == F.col("_h2"))
    later = rows.join(again, same).filter(place != F.col("first"))
    return later.groupBy(*_KEYS).agg(F.collect_list(F.struct("h1", "h2")).alias("seen"))


_TABLE = "conv_id long, task int, block int, cost array<long>, place array<long>"
_BETWEEN = "task int, block int, start int, stop int"


def _across(tables_of: DataFrame) -> DataFrame:
    """The states every block lies between; ``stop`` is missing for a conversation's last block."""
    schema = arrow_schema(_BETWEEN)

    def run(part: pa.Table) -> pa.Table:
        part = part.sort_by([("task", "ascending"), ("block", "ascending")])
        n = part.num_rows
        cost, place = (
            np.array(part.column(c).combine_chunks().flatten(), dtype=np.int64).reshape(n, _STATES, _STATES)
            for c in ("cost", "place")
        )
        after = paths(Steps(cost, place), np.arange(n), np.array([0, n]), np.zeros(1, np.int64), _ACCEPT[None, :])
        cols = {
            "task": part.column("task").combine_chunks(),
            "block": part.column("block").combine_chunks(),
            "start": np.concatenate(([0], after[:-1])),
            "stop": [*after[:-1].tolist(), None],
        }
        return pa.Table.from_batches([record(cols, schema)])

    return tables_of.groupBy("conv_id").applyInArrow(run, _BETWEEN)


def _joined(blocks: DataFrame) -> DataFrame:
    """Blocks that may be parts of longer conversations, repaired."""
    seen = keep(blocks.join(_earlier(blocks), _KEYS, "left"), "conversation-parts")
    table_schema, piece_schema = arrow_schema(_TABLE), arrow_schema(_PIECE)

    def coded(row: dict) -> tuple[_Block, list[int], dict]:
        block = _known(row)
        return block, *_codes(block, {(s["h1"], s["h2"]) for s in row["seen"] or ()})

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.to_pylist()
            codes = [coded(row)[1] for row in rows]
            edges = np.cumsum([0, *map(len, codes)])
            steps = tables(np.fromiter((c for x in codes for c in x), np.int64, int(edges[-1])), edges)
            cols = {k: [row[k] for row in rows] for k in ("conv_id", "task", "block")}
            flat = {"cost": list(steps.cost.reshape(-1, 16)), "place": list(steps.place.reshape(-1, 16))}
            yield record(cols | flat, table_schema)

    def repair(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.to_pylist()
            made = [coded(row) for row in rows]
            end = np.tile(_ACCEPT, (len(rows), 1))
            for i, row in enumerate(rows):
                if row["stop"] is not None:
                    end[i] = _INF
                    end[i, row["stop"]] = 0
            after = _solve([codes for _, codes, _ in made], [row["start"] for row in rows], end)
            out: dict[str, list] = {f.name: [] for f in piece_schema}
            for row, (block, codes, faults), states in zip(rows, made, after, strict=True):
                edited = _edited(block.roles, block.texts, codes, states, row["start"], row["stop"] is None)
                for name in out:
                    out[name].append((row | faults | edited)[name])
            yield record(out, piece_schema)

    between = _across(seen.mapInArrow(measure, _TABLE))
    return seen.join(between, _KEYS).mapInArrow(repair, _PIECE)


def repair(
    conversations: DataFrame,
    conv: str = "conv_id",
    turn: str = "turn",
    role: Column | None = None,
    text: Column | None = None,
    copies: Column | None = None,
) -> DataFrame:
    """Repaired conversations in pieces, in the order of ``task`` and ``block``.

    A piece holds the roles and texts after repair, the audit and cost of its edits, and counts
    of its rows: faults, neighbours that may not follow each other, turns. Most conversations
    are one piece (``whole``). Rows with 0 ``copies`` are left out; a conversation that
    loses all its rows keeps an empty piece.
    """
    role, text = F.col("role") if role is None else role, F.col("text") if text is None else text
    copies = F.lit(1) if copies is None else copies
    blocks = _blocks(prepare(conversations, conv, turn, role, text, copies))
    columns = [c.split()[0] for c in _PIECE.split(", ")]
    whole = blocks.filter("whole").select(*columns)
    return whole.unionByName(_joined(blocks.filter(~F.col("whole"))))


_DIGEST = (
    "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, "
    "audit string, repaired_sha256 string"
)


def digest(pieces: DataFrame) -> DataFrame:
    """One row a conversation: counts, audit, and SHA-256 of its ``role:text`` lines.

    SHA-256 reads a text from its beginning, so the pieces of one conversation are streamed
    through one task; no more than a piece and the audit is held.
    """
    schema = arrow_schema(_DIGEST)
    gaps = F.coalesce(F.col("last_turn") - F.col("first_turn") + 1 - F.col("turns"), F.lit(0))
    lines = F.concat_ws("\n", F.zip_with("roles", "texts", lambda r, t: F.concat(r, F.lit(":"), t)))
    counts = ["blank", "duplicate", "truncated", "illegal", "cost"]
    whole = pieces.filter("whole").select("conv_id", gaps.alias("gaps"), *counts, "audit", F.sha2(lines, 256).alias("repaired_sha256"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict | None = None

        def close() -> pa.RecordBatch:
            gaps = held["last_turn"] - held["first_turn"] + 1 - held["turns"] if held["turns"] else 0
            row = held | {"gaps": gaps, "audit": "".join(held["audit"]), "repaired_sha256": held["sha"].hexdigest()}
            return record({f.name: [row[f.name]] for f in schema}, schema)

        for batch in batches:
            for row in batch.to_pylist():
                if held is None or held["conv_id"] != row["conv_id"]:
                    if held is not None:
                        yield close()
                    held = dict.fromkeys(counts, 0) | {"conv_id": row["conv_id"], "audit": [], "sha": hashlib.sha256()}
                    held |= {"turns": 0, "first_turn": None, "last_turn": None, "initial": None, "begun": False}
                for c in counts:
                    held[c] += row[c]
                if row["rows"]:
                    held["illegal"] += held["initial"] is not None and _illegal(held["initial"], row["first_initial"])
                    held["initial"] = row["last_initial"]
                if row["turns"]:
                    held["turns"] += row["turns"] - (held["last_turn"] == row["first_turn"])
                    held["first_turn"] = row["first_turn"] if held["first_turn"] is None else held["first_turn"]
                    held["last_turn"] = row["last_turn"]
                held["audit"].append(row["audit"])
                text = "\n".join(f"{r}:{t}" for r, t in zip(row["roles"], row["texts"], strict=True))
                if row["roles"]:
                    held["sha"].update((("\n" if held["begun"] else "") + text).encode())
                    held["begun"] = True
        if held is not None:
            yield close()

    parts = pieces.filter(~F.col("whole")).repartition("conv_id").sortWithinPartitions("conv_id", "task", "block")
    return whole.unionByName(parts.mapInArrow(run, _DIGEST))


def damaged(conversations: DataFrame) -> dict[str, Column]:
    """The damage by crc32 of ``conv_id:turn``: roles, texts and copies of the rows."""
    blank = F.lit(" ")
    key = F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), blank) for c in ("conv_id", "turn")])
    kind = F.pmod(F.crc32(key), F.lit(20))
    text, role = (F.coalesce(F.col(c).cast("string"), blank) for c in ("text", "role"))
    return {
        "text": F.when(kind == 1, "").when(kind == 2, F.translate(text, ".!?", "")).otherwise(text),
        "role": F.when(kind == 4, "user").otherwise(role),
        "copies": F.when(kind == 0, 0).when(kind == 3, 2).otherwise(1),
    }
