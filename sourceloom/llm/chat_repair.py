"""Minimum-cost role repair of conversations by dynamic programming over a legal-turn automaton.

A legal conversation is an optional system turn and then user and assistant turns in alternation, the user first. Each turn may keep its role, be relabelled,
be merged into the turn before it, or get an empty turn inserted before it; the cheapest sequence is chosen, ties by the
order of ``ROLES``. Costs combine as (min, +) matrices, so a conversation of any length may lie across many partitions: rows are range
partitioned by conversation and turn and keep the number of their range in a column. Each range reports one matrix for its first and its last conversation, the
driver chains those (two rows a range), and each range's rows are then traced. What the caller does with the result, such as ``coalesce``, changes no row.

Defined cases: null or unknown roles cost a relabel whatever they become; null texts render as empty; a null conversation
id is one conversation; ties in the turn are ordered by role, then text; repeated rows are turns of their own; an
empty table gives an empty result; long texts pass whole; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sourceloom.plans.durable import cut

ROLES = ("system", "user", "assistant")
RELABEL, MERGE, INSERT = 2.0, 1.0, 3.0
_START = 3
_RANGE = "_range"
_LEGAL = {(3, 0), (3, 1), (0, 1), (1, 2), (2, 1)}


def _steps() -> tuple[np.ndarray, dict]:
    """Costs [role, from, to] without a turn's relabel, and what each step does: (merged, inserted role or None)."""
    cost, does = np.full((4, 4), np.inf), {}
    for s in range(4):
        for q in range(3):
            options = []
            if (s, q) in _LEGAL:
                options.append((0.0, False, None))
            if s == q:
                options.append((MERGE, True, None))
            options += [(INSERT, False, x) for x in range(3) if (s, x) in _LEGAL and (x, q) in _LEGAL]
            if options:
                best = min(options, key=lambda o: o[0])
                cost[s, q], does[s, q] = best[0], best[1:]
    relabel = np.array([[0.0 if q == r else RELABEL for q in range(4)] for r in range(4)])
    return cost[None] + relabel[:, None, :], does


STEP, DOES = _steps()


def _role(value: str | None) -> int:
    return ROLES.index(value) if value in ROLES else 3


def matrix(roles: list[int]) -> np.ndarray:
    """The least cost of all turns from each state to each state."""
    out = np.where(np.eye(4) > 0, 0.0, np.inf)
    for r in roles:
        out = (out[:, :, None] + STEP[r][None]).min(1)
    return out


def trace(roles: list[int], begin: int, end: int | None) -> tuple[list[int], list[float]]:
    """The states after each turn and their costs, from ``begin`` to ``end`` (None: the cheapest)."""
    costs = [np.where(np.arange(4) == begin, 0.0, np.inf)]
    for r in roles:
        costs.append((costs[-1][:, None] + STEP[r]).min(0))
    state = int(costs[-1].argmin()) if end is None else end
    states, paid = [], []
    for k in range(len(roles) - 1, -1, -1):
        states.append(state)
        before = int((costs[k] + STEP[roles[k]][:, state]).argmin())
        paid.append(float(STEP[roles[k]][before, state]))
        state = before
    return states[::-1], paid[::-1]


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[object, list[tuple]]]:
    """Each range's conversations, in order, as (range, conversation) and rows; one conversation's share of a range is held at a time."""
    key, rows = None, []
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns)):
            if rows and (row[-1], row[0]) != key:
                yield key, rows
                rows = []
            key = (row[-1], row[0])
            rows.append(row)
    if rows:
        yield key, rows


def _summary(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    ends: list[tuple[int, int, tuple, list]] = []
    for key, rows in _runs(batches):
        if ends and ends[-1][0] == key[0] and ends[-1][1] == 1:
            ends.pop()
        ends.append((key[0], 1 if ends and ends[-1][0] == key[0] else 0, key, rows))
    if ends:
        cols = [
            pa.array([e[0] for e in ends], pa.int32()), pa.array([e[1] for e in ends], pa.int32()), pa.array([None if e[2][1] is None else str(e[2][1]) for e in ends], pa.string()),
            pa.array([len(e[3]) for e in ends], pa.int64()), pa.array([matrix([_role(x[2]) for x in e[3]]).ravel().tolist() for e in ends], pa.list_(pa.float64())),
        ]
        yield pa.RecordBatch.from_arrays(cols, names=["place", "part", "key", "n", "m"])


def _borders(parts: list) -> dict[tuple[int, int], tuple[int, int | None, int, bool]]:
    """(range, part) to (state before, state after, turns before, whether the conversation ends there)."""
    out, k = {}, 0
    parts = sorted(parts, key=lambda p: (p.place, p.part))
    while k < len(parts):
        group = [parts[k]]
        # A conversation goes on only from a range's last run to the next one's first.
        while k + len(group) < len(parts) and parts[k + len(group)].key == group[0].key and parts[k + len(group)].part == 0:
            group.append(parts[k + len(group)])
        mats = [np.array(p.m).reshape(4, 4) for p in group]
        costs = [np.where(np.arange(4) == _START, 0.0, np.inf)]
        for m in mats:
            costs.append((costs[-1][:, None] + m).min(0))
        state, borders = int(costs[-1].argmin()), []
        for i in range(len(group) - 1, -1, -1):
            before = int((costs[i] + mats[i][:, state]).argmin())
            borders.append((before, state))
            state = before
        seen = 0
        for i, (p, (a, b)) in enumerate(zip(group, borders[::-1])):
            out[p.place, p.part] = (a, b, seen, i == len(group) - 1)
            seen += p.n
        k += len(group)
    return out


def repair(turns: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv_id, position, turn, role, new_role, action, inserted, cost, rendered): one row a turn.

    A conversation's ``rendered`` pieces in order of position are the repaired conversation.
    """
    rows = turns.select(conv_id, turn, role, text)
    order = [F.col(conv_id), F.col(turn), F.col(role), F.md5(F.coalesce(F.col(text), F.lit("")))]
    # The number of the range is stored; where a row lies later does not matter.
    dealt = cut(rows.repartitionByRange(*order).sortWithinPartitions(*order).select("*", F.spark_partition_id().alias(_RANGE)))
    # A conversation that lies across ranges shows as equal keys at their borders.
    borders = _borders(dealt.mapInArrow(_summary, "place int, part int, key string, n long, m array<double>").collect())
    kinds = [dealt.schema[c].dataType.simpleString() for c in (conv_id, turn)]
    names = [conv_id, "position", turn, "role", "new_role", "action", "inserted", "cost", "rendered"]
    schema = f"`{conv_id}` {kinds[0]}, position long, `{turn}` {kinds[1]}, role string, new_role string, action string, inserted string, cost double, rendered string"
    shared = dealt.sparkSession.sparkContext.broadcast(borders)

    def one(key, rows, border) -> list[tuple]:
        begin, end, seen, ends = border
        roles = [_role(r[2]) for r in rows]
        states, paid = trace(roles, begin, end)
        out, before = [], begin
        for k, (row, state, cost) in enumerate(zip(rows, states, paid)):
            merged, extra = DOES[before, state]
            head = "\n" if merged else ("" if before == _START else "<|end|>\n") + (f"<|{ROLES[extra]}|>\n<|end|>\n" if extra is not None else "") + f"<|{ROLES[state]}|>\n"
            tail = "<|end|>\n" if ends and k == len(rows) - 1 else ""
            action = "+".join(a for a, used in (("merge", merged), ("relabel", roles[k] != state), ("insert", extra is not None)) if used) or "keep"
            out.append((row[0], seen + k, row[1], row[2], ROLES[state], action, None if extra is None else ROLES[extra], cost, head + (row[3] or "") + tail))
            before = state
        return out

    def trace_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = _runs(batches)
        held, before, out = next(found, None), None, []
        while held is not None:
            following = next(found, None)
            place = held[0][0]
            part = 0 if place != before else 1 if following is None or following[0][0] != place else None
            out += one(*held, (_START, None, 0, True) if part is None else shared.value[place, part])
            before, held = place, following
            if len(out) >= 2000 or held is None:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names=names)
                out = []

    from pyspark.sql.pandas.types import to_arrow_type

    types = [to_arrow_type(dealt.schema[conv_id].dataType), pa.int64(), to_arrow_type(dealt.schema[turn].dataType), *[pa.string()] * 4, pa.float64(), pa.string()]
    return dealt.mapInArrow(trace_all, schema)
