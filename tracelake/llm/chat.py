"""Chat formatting by minimum-cost role repair.

A legal conversation is a word of an automaton: an optional system turn, then user and assistant in turn, the user first. Each
input turn is kept, relabelled, merged into the turn before it, or preceded by an empty turn that makes it legal; a dynamic
program over the automaton's states picks the cheapest repair. The cost of a turn depends on its role only, so a run of turns is a
matrix of least costs from state to state. Long conversations are cut into blocks of turns: blocks give their matrices, a fold over
a conversation's blocks fixes the state at each border, and blocks then repair their own turns. No task holds the turns of a whole
conversation; the fold holds about 200 bytes for each block of 256.
Where turn numbers are null or repeated, a block of turn numbers is cut again by the rank of its rows.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelake.llm.common import stage_table

ROLES = ["system", "user", "assistant"]
STATES = ["start", *ROLES]  # the last turn written
NEXT = {"start": ["system", "user"], "system": ["user"], "user": ["assistant"], "assistant": ["user"]}
RELABEL, MERGE_SAME, MERGE_OTHER, INSERT = 3, 1, 4, 2
BLOCK = 256
NO_TURN = -(1 << 62)
END = "\n<|end|>\n"
KEY = ["conv", "block", "cut"]
NEVER = 10**9


def _moves(role: str | None) -> list[tuple[int, int, int, str, str | None, str | None]]:
    """(from, to, cost, action, role written or None, role inserted or None) for a turn of this role, best first among equals."""
    out = []
    for i, state in enumerate(STATES):
        for to in NEXT[state]:
            out.append((i, STATES.index(to), 0 if to == role else RELABEL, "keep" if to == role else "relabel", to, None))
            for after in NEXT[to]:
                if after == role:
                    out.append((i, STATES.index(after), INSERT, "insert", after, to))
        if state != "start":
            out.append((i, i, MERGE_SAME if state == role else MERGE_OTHER, "merge", None, None))
    rank = {"keep": 0, "merge": 1, "insert": 2, "relabel": 3}
    return sorted(out, key=lambda m: (m[2], rank[m[3]], m[0], m[1]))


MOVES = {r: _moves(r) for r in (*ROLES, None)}
STEP = {}
for _role, _all in MOVES.items():
    STEP[_role] = np.full((len(STATES), len(STATES)), NEVER, np.int64)
    for _m in _all:
        STEP[_role][_m[0], _m[1]] = min(STEP[_role][_m[0], _m[1]], _m[2])


def escape(text: str) -> str:
    """The text with a backslash more in every ``<|``, ``<\\|`` and so on, so no text can forge a turn; :func:`unescape` undoes it."""
    return re.sub(r"<(\\*)\|", r"<\1\\|", text)


def unescape(text: str) -> str:
    return re.sub(r"<\\(\\*)\|", r"<\1|", text)


def known(role: str | None) -> str | None:
    """The role in lower case without outer space if it is legal; None for any other value and null."""
    role = (role or "").strip().lower()
    return role if role in ROLES else None


def compose(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Least costs of two runs of turns, one after the other."""
    return np.minimum((a[:, :, None] + b[None, :, :]).min(1), NEVER)


def path(roles: list[str | None], enter: int, leave: int | None = None) -> tuple[int, list[tuple]]:
    """Least cost from state ``enter`` to ``leave`` (any but start if None) and the move of each turn; ties fall to the first move."""
    cost = np.full(len(STATES), NEVER, np.int64)
    cost[enter] = 0
    back = []
    for role in roles:
        new, how = np.full(len(STATES), NEVER, np.int64), [None] * len(STATES)
        for m in MOVES[role]:
            if cost[m[0]] + m[2] < new[m[1]]:
                new[m[1]], how[m[1]] = cost[m[0]] + m[2], m
        cost = new
        back.append(how)
    at = int(np.argmin(cost)) if leave is None else leave
    total, moves = int(cost[at]), []
    for how in reversed(back):
        moves.append(how[at])
        at = how[at][0]
    return total, moves[::-1]


def _ordered(table: pa.Table) -> pa.Table:
    return table.sort_by([("turn", "ascending"), ("place", "ascending"), ("role", "ascending")])


def _matrix(table: pa.Table) -> pa.Table:
    roles = [known(r) for r in _ordered(table).column("role").to_pylist()]
    out = STEP[roles[0]]
    for r in roles[1:]:
        out = compose(out, STEP[r])
    return pa.table({c: table.column(c)[:1] for c in KEY} | {"n": pa.array([len(roles)], pa.int64()), "least": pa.array([out.ravel().tolist()], pa.list_(pa.int64()))})


def _borders(table: pa.Table) -> pa.Table:
    table = table.sort_by([("block", "ascending"), ("cut", "ascending")])
    steps = [np.array(x).reshape(len(STATES), -1) for x in table.column("least").to_pylist()]
    cost = np.full(len(STATES), NEVER, np.int64)
    cost[0] = 0
    costs = [cost]
    for m in steps:
        costs.append(np.minimum((costs[-1][:, None] + m).min(0), NEVER))
    leave = [int(np.argmin(costs[-1]))]
    for before, m in zip(costs[-2::-1], steps[::-1]):
        leave.append(int(np.argmin(before + m[:, leave[-1]])))
    states = leave[::-1]
    n = table.num_rows
    first = np.cumsum(table.column("n").to_numpy()) - table.column("n").to_numpy()
    return pa.table({c: table.column(c) for c in KEY} | {"first": pa.array(first), "last": pa.array(np.arange(n) == n - 1), "enter": pa.array(states[:-1], pa.int32()), "leave": pa.array(states[1:], pa.int32()), "total": pa.array([int(costs[-1][states[-1]])] * n, pa.int64())})


def _repair(table: pa.Table) -> pa.Table:
    table = _ordered(table)
    roles = [known(r) for r in table.column("role").to_pylist()]
    _, moves = path(roles, table.column("enter")[0].as_py(), table.column("leave")[0].as_py())
    rendered = []
    for m, text in zip(moves, (escape(t or "") for t in table.column("text").to_pylist())):
        head = ("" if m[0] == 0 else END) + ("" if m[5] is None else f"<|{m[5]}|>\n{END}")  # nothing is open at the start
        rendered.append(f"\n{text}" if m[4] is None else f"{head}<|{m[4]}|>\n{text}")
    if table.column("last")[0].as_py():
        rendered[-1] += END
    out = {c: table.column(c) for c in ("conv", "turn", "role", "total")}
    out |= {"new_role": pa.array([m[4] or STATES[m[1]] for m in moves]), "action": pa.array([m[3] for m in moves]), "inserted": pa.array([m[5] for m in moves], pa.string()), "cost": pa.array([m[2] for m in moves], pa.int64())}
    position = table.column("first")[0].as_py() + np.arange(len(moves))
    return pa.table(out | {"rendered": pa.array(rendered, pa.string()), "position": pa.array(position)})


def blocks(rows: DataFrame, block: int) -> DataFrame:
    """``rows(conv, turn, place, role, text)`` with block and cut, in whose order the rows of a conversation run.

    A block is a stretch of turn numbers. One of more than ``block`` rows, so with null or repeated numbers, is sorted over all
    tasks and cut by rank; equal rows can change places, so they are dealt too.
    """
    rows = rows.withColumn("block", F.floor(F.col("turn") / block))
    long = rows.groupBy("conv", "block").count().where(F.col("count") > block)
    long = stage_table(long.select(F.col("conv").alias("c"), F.col("block").alias("b")), "long")
    if long.isEmpty():
        return rows.withColumn("cut", F.lit(0).cast("long"))
    same = rows["conv"].eqNullSafe(long["c"]) & (rows["block"] == long["b"])
    order = ["conv", "turn", "place", "role", "tie"]
    held = rows.withColumn("tie", F.xxhash64(F.monotonically_increasing_id())).join(long, same, "left_semi")
    held = held.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("rank", F.monotonically_increasing_id())
    held = stage_table(held.withColumn("cut", F.expr(f"rank div {block}")).drop("tie", "rank"), "cut")
    return rows.join(long, same, "left_anti").withColumn("cut", F.lit(0).cast("long")).unionByName(held)


def repair_roles(conversations: DataFrame, block: int = BLOCK) -> DataFrame:
    """A row for each row of ``conversations(conv_id, turn, role, text, ...)``: its role after repair and its rendered piece.

    Columns conv_id, turn, role, new_role, action (keep, relabel, merge, insert), inserted (role of the empty turn put before it),
    cost, conv_cost, rendered and position (from 0 in the conversation). The pieces of a conversation, in order of position, are its
    text: ``<|role|>``, text (see :func:`escape`) and ``<|end|>`` for each turn. A piece that begins a turn closes the one before it; the last piece
    closes its own. Turns run in order of turn, nulls first, then of a hash of role and text, so repeated rows stay in a fixed
    order. Unknown and null roles are relabelled or merged; null texts are empty and very long ones stay whole; all rows of a null
    conv_id are one conversation. Other columns are ignored; an empty table gives no rows.
    """
    rows = conversations.select(
        F.col("conv_id").cast("long").alias("conv"), F.coalesce(F.col("turn").cast("long"), F.lit(NO_TURN)).alias("turn"),
        F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"),
        F.xxhash64("role", "text").alias("place"),
    )
    rows = blocks(rows, block)
    # adaptive execution goes by bytes, and these rows are few bytes and much work: the number of tasks is kept
    tasks = int(conversations.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    least = rows.select(*KEY, "turn", "place", "role").repartition(tasks, *KEY).groupBy(*KEY).applyInArrow(_matrix, "conv long, block long, cut long, n long, least array<long>")
    borders = least.repartition(tasks, "conv").groupBy("conv").applyInArrow(_borders, "conv long, block long, cut long, first long, last boolean, enter int, leave int, total long")
    borders = stage_table(borders, "borders").withColumnsRenamed({"conv": "c", "block": "b", "cut": "k"})
    joined = rows.join(borders, rows["conv"].eqNullSafe(borders["c"]) & (rows["block"] == borders["b"]) & (rows["cut"] == borders["k"])).drop("c", "b", "k")
    kinds = "conv long, turn long, role string, total long, new_role string, action string, inserted string, cost long, rendered string, position long"
    out = joined.repartition(tasks, *KEY).groupBy(*KEY).applyInArrow(_repair, kinds)
    turn = F.when(F.col("turn") != NO_TURN, F.col("turn"))
    return out.select(F.col("conv").alias("conv_id"), turn.alias("turn"), "role", "new_role", "action", "inserted", "cost", F.col("total").alias("conv_cost"), "rendered", "position")
