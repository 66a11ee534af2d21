"""Chat formatting: the cheapest repair of a conversation's roles to a legal sequence of turns.

Legal is: at most one system message first, then user and assistant in turn, the assistant last.
A turn may keep its role, be relabelled, or be merged into the message before it; an empty message
may be inserted before a turn or at the end. Dynamic programming over the automaton's states finds
the cheapest repair. Costs compose as (min, +) matrices, so a conversation of any length is cut
into blocks whose matrices are multiplied along a tree; then the states at the blocks' ends are
handed down and every block is repaired by itself.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, running_sum

ROLES = ("", "system", "user", "assistant")
START, SYSTEM, USER, ASSISTANT = range(4)
LEGAL = {(START, SYSTEM), (START, USER), (SYSTEM, USER), (USER, ASSISTANT), (ASSISTANT, USER)}
#: The empty messages that lead from the last state to a legal end.
ENDING = {START: (), SYSTEM: (USER, ASSISTANT), USER: (ASSISTANT,), ASSISTANT: ()}
INF = 1 << 40
#: Turns in a block, and matrices multiplied together.
BLOCK = 512


class Costs(NamedTuple):
    merge: int = 1
    relabel: int = 2
    insert: int = 3


class Step(NamedTuple):
    to: int
    cost: int
    action: str
    inserted: int


def steps(role: int, costs: Costs = Costs()) -> list[list[Step]]:
    """For each state, what can be done with a turn of ``role`` (0: unknown), preferred first."""
    out = []
    for state in range(4):
        found = []
        for to in (SYSTEM, USER, ASSISTANT):
            own = 0 if to == role else costs.relabel
            name = "keep" if to == role else "relabel"
            if (state, to) in LEGAL:
                found.append(Step(to, own, name, 0))
            elif state == to:
                found.append(Step(to, own + costs.merge, "merge" if to == role else "relabel and merge", 0))
            for mid in (USER, ASSISTANT):
                if (state, mid) in LEGAL and (mid, to) in LEGAL:
                    found.append(Step(to, own + costs.insert, name, mid))
        out.append(sorted(found, key=lambda s: (s.inserted > 0, s.action != "keep", "merge" in s.action, s.to)))
    return out


def number(role: str | None) -> int:
    r = (role or "").strip().lower()
    return ROLES.index(r) if r in ROLES[1:] else 0


def matrix(roles: list[int], costs: Costs) -> np.ndarray:
    """Least cost from each state before the turns to each state after them."""
    one = [np.full((4, 4), INF, np.int64) for _ in ROLES]
    for r in range(4):
        for s, options in enumerate(steps(r, costs)):
            for o in options:
                one[r][s, o.to] = min(one[r][s, o.to], o.cost)
    out = np.where(np.eye(4, dtype=bool), 0, INF)
    for r in roles:
        out = np.minimum((out[:, :, None] + one[r][None]).min(axis=1), INF)
    return out


def product(parts: list[np.ndarray]) -> np.ndarray:
    out = np.where(np.eye(4, dtype=bool), 0, INF)
    for m in parts:
        out = np.minimum((out[:, :, None] + m[None]).min(axis=1), INF)
    return out


def through(parts: list[np.ndarray], start: int, end: int) -> list[int]:
    """States before, between and after the parts on a cheapest way; ties to the smaller state."""
    togo = [np.where(np.arange(4) == end, 0, INF)]
    for m in reversed(parts):
        togo.append(np.minimum((m + togo[-1][None]).min(axis=1), INF))
    togo.reverse()
    states = [start]
    for m, rest in zip(parts, togo[1:], strict=True):
        states.append(int(np.argmin(m[states[-1]] + rest)))
    return states


@lru_cache(maxsize=8)
def choices(costs: Costs) -> list[list[list[Step]]]:
    return [steps(r, costs) for r in range(4)]


def repair(roles: list[int], start: int, end: int, costs: Costs = Costs()) -> list[Step]:
    """The cheapest steps from ``start`` to ``end`` (-1: to any legal end), the preferred among
    equals from the first on."""
    options = choices(costs)
    togo = [[0 if s == end else INF for s in range(4)] if end >= 0 else ending(costs).tolist()]
    for r in reversed(roles):
        rest = togo[-1]
        togo.append([min((o.cost + rest[o.to] for o in options[r][s]), default=INF) for s in range(4)])
    togo.reverse()
    out, s = [], start
    for r, rest in zip(roles, togo[1:], strict=True):
        out.append(min(options[r][s], key=lambda o: o.cost + rest[o.to]))
        s = out[-1].to
    return out


def ending(costs: Costs) -> np.ndarray:
    return np.array([len(ENDING[s]) * costs.insert if s else INF for s in range(4)])


def message(role: int, text: str = "") -> str:
    return f"<|im_start|>{ROLES[role]}\n{text}"


CLOSE = "<|im_end|>\n"


def rendered(step: Step, text: str | None, first: bool, last: bool) -> str:
    """A turn's part of the whole: what closes the message before it, inserted messages, its own."""
    out = ""
    if "merge" in step.action:
        out = "\n\n" + (text or "")
    else:
        out = ("" if first else CLOSE) + (message(step.inserted) + CLOSE if step.inserted else "") + message(step.to, text or "")
    if last:
        out += CLOSE + "".join(message(r) + CLOSE for r in ENDING[step.to])
    return out


def format_chats(turns: DataFrame, costs: Costs = Costs()) -> DataFrame:
    """(conv_id, pos, turn, role, text, new_role, action, inserted, cost, closing, rendered), one row
    for each row of ``turns`` (conv_id, turn, role, text).

    ``rendered`` of a conversation's rows, joined by ``pos``, is the repaired conversation. Turns are
    taken in the order of (turn, role, text), nulls last; unknown and null roles can only be
    relabelled; null texts are empty; rows with a null conv_id form one conversation. Repeated rows
    are turns of their own. ``closing`` lists the empty messages put after the last turn.
    """
    rows = turns.select(
        F.coalesce(F.concat(F.lit("="), F.col("conv_id").cast("string")), F.lit("null")).alias("conv"), F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"), F.lit(1).cast("long").alias("one"),
    )
    placed = checkpointed(
        running_sum(rows, ["conv"], ["turn", "role", "text"], "one", "pos").drop("one").withColumn("block", F.floor(F.col("pos") / BLOCK))
    )
    cost_matrix = "conv string, node long, m array<long>"

    def leaf(pdf: pd.DataFrame) -> pd.DataFrame:
        m = matrix([number(r) for r in pdf.sort_values("pos")["role"]], costs)
        return pd.DataFrame({"conv": [pdf["conv"].iloc[0]], "node": [pdf["block"].iloc[0]], "m": [m.ravel()]})

    def parent(pdf: pd.DataFrame) -> pd.DataFrame:
        m = product([np.reshape(x, (4, 4)) for x in pdf.sort_values("node")["m"]])
        return pd.DataFrame({"conv": [pdf["conv"].iloc[0]], "node": [pdf["node"].iloc[0] // BLOCK], "m": [m.ravel()]})

    up = F.floor(F.col("node") / BLOCK).alias("up")
    wide = placed.filter("block > 0").select("conv").distinct()  # all others are a block each, whose end is free
    levels = [checkpointed(placed.join(wide, "conv", "left_semi").groupBy("conv", "block").applyInPandas(leaf, cost_matrix))]
    while (levels[-1].agg(F.max("node")).first()[0] or 0) > 0:
        levels.append(checkpointed(levels[-1].groupBy("conv", up).applyInPandas(parent, cost_matrix)))

    ends = ending(costs)
    best = F.array_min(F.array(*[F.struct((F.element_at("m", t + 1) + int(ends[t])).alias("c"), F.lit(t).alias("t")) for t in range(4)]))
    given = levels.pop().select("conv", "node", F.lit(START).alias("s"), best.getField("t").alias("t"), F.lit(True).alias("final"))

    def down(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("node")
        row = pdf.iloc[0]
        states = through([np.reshape(x, (4, 4)) for x in pdf["m"]], int(row["s"]), int(row["t"]))
        last = np.arange(len(pdf)) == len(pdf) - 1
        return pd.DataFrame({"conv": pdf["conv"], "node": pdf["node"], "s": states[:-1], "t": states[1:], "final": last & row["final"]})

    while levels:
        own = levels.pop().withColumn("up", F.floor(F.col("node") / BLOCK))
        met = own.join(given.select("conv", F.col("node").alias("up"), "s", "t", "final"), ["conv", "up"])
        given = met.groupBy("conv", "up").applyInPandas(down, "conv string, node long, s int, t int, final boolean")

    def repaired(pdf: pd.DataFrame) -> pd.DataFrame:
        """Whole blocks, one after the other."""
        roles, at = [number(r) for r in pdf["role"]], np.append(starts(pdf), len(pdf))
        s, t, final = pdf["s"].to_numpy(), pdf["t"].to_numpy(), pdf["final"].to_numpy(bool)
        done, last = [], np.zeros(len(pdf), bool)
        for i, j in zip(at, at[1:]):
            done += repair(roles[i:j], int(s[i]), int(t[i]), costs)
            last[j - 1] = final[i]
        text = [t if isinstance(t, str) else "" for t in pdf["text"]]
        out = pdf[["conv_id", "pos", "turn", "role", "text"]].copy()
        out["conv_id"], out["turn"] = out["conv_id"].astype("Int64"), out["turn"].astype("Int64")
        out["new_role"] = [ROLES[d.to] for d in done]
        out["action"] = [d.action for d in done]
        out["inserted"] = [ROLES[d.inserted] or None for d in done]
        out["cost"] = [d.cost + (len(ENDING[d.to]) * costs.insert if z else 0) for d, z in zip(done, last, strict=True)]
        out["closing"] = [",".join(ROLES[r] for r in ENDING[d.to]) if z else "" for d, z in zip(done, last, strict=True)]
        out["rendered"] = [rendered(d, t, p == 0, z) for d, t, p, z in zip(done, text, pdf["pos"], last, strict=True)]
        return out

    def in_order(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Repairs the blocks of sorted rows; a block that a batch cuts waits for the rest of it."""
        held = None
        for pdf in batches:
            if not len(pdf):
                continue
            pdf = pdf if held is None else pd.concat([held, pdf], ignore_index=True)
            cut = int(starts(pdf)[-1])
            if cut:
                yield repaired(pdf.iloc[:cut])
            held = pdf.iloc[cut:]
        if held is not None:
            yield repaired(held)

    joined = placed.join(given.select("conv", F.col("node").alias("block"), "s", "t", "final"), ["conv", "block"], "left")
    joined = joined.fillna({"s": START, "t": -1, "final": True})
    return joined.repartition("conv", "block").sortWithinPartitions("conv", "block", "pos").mapInPandas(
        in_order, "conv_id long, pos long, turn long, role string, text string, new_role string, action string, inserted string, cost long, closing string, rendered string"
    )


def starts(pdf: pd.DataFrame) -> np.ndarray:
    """Where blocks begin in rows that are sorted by conversation and block."""
    conv, block = pdf["conv"].to_numpy(), pdf["block"].to_numpy()
    return np.flatnonzero(np.append(True, (conv[1:] != conv[:-1]) | (block[1:] != block[:-1])))
