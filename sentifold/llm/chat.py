"""Chat formatting with the cheapest repair of roles.

A legal conversation is an optional system turn and then user and assistant in turns, ending with the assistant.  Each
turn may keep its role or be relabelled, may be merged into the turn before it, and empty turns may be put
in before it; the costs are parameters.  The cheapest repair is the shortest path through the automaton whose
states are the last turn's role.  Each turn is a 4 x 4 matrix of costs (state before, state after), and matrices combine
by sums and minima, so a conversation of any length can be cut:

1. Turns are dealt out by ranges of (conversation, turn), so a long conversation lies in many parts.
2. Each part gives the matrix of the conversation it begins in the middle of and of the one it does not end: at most two
   small rows a part.
3. These are folded per conversation, which fixes the states at the cuts.
4. Each part then finds its paths and renders its turns.

The result has one row per turn with a fragment of the rendered text; the fragments of a conversation, in the order of `seq`,
are the whole.  So no row, however long the conversation, holds more than one turn.

Defined cases: a null or unknown role must be relabelled; a null text is empty; turns with a null number come last; turns with
equal numbers are ordered by role and a hash of the text, repeated rows being turns of their own; a null conversation id is an id
like others; an empty table gives no rows; other columns are ignored.  Markers inside a text are broken up.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import modest_batches, written

ROLES = ("system", "user", "assistant")
START, SYSTEM, USER, ASSISTANT = range(4)
# States that may follow a state directly.
_NEXT = {START: (SYSTEM, USER), SYSTEM: (USER,), USER: (ASSISTANT,), ASSISTANT: (USER,)}
ROWS_PER_PART = 20_000


@dataclass(frozen=True)
class Costs:
    merge: float = 2.0
    insert: float = 3.0
    relabel: float = 3.0  # between user and assistant
    relabel_system: float = 4.0  # from or to system
    unknown: float = 1.0  # any role for a turn that has none

    @cached_property
    def between(self) -> dict[tuple[int, int], tuple[int, ...]]:
        """Fewest empty turns that make `b` legal after `a`, where any do."""
        out = {}
        for a in range(4):
            paths = [(a, ())]
            for last, put in paths:
                for b in _NEXT[last]:
                    out.setdefault((a, b), put)
                    if len(put) < 3:
                        paths.append((b, (*put, b)))
        return out

    def step(self, a: int, b: int) -> tuple[float, bool, tuple[int, ...]]:
        """Cost of a turn with final role `b` after state `a`: merged or not, and the empty turns before it."""
        put = self.between.get((a, b))
        apart = float("inf") if put is None else self.insert * len(put)
        if a == b and self.merge <= apart:
            return self.merge, True, ()
        return apart, False, put or ()

    def label(self, role: int | None, b: int) -> float:
        if role == b:
            return 0.0
        if role is None:
            return self.unknown
        return self.relabel_system if SYSTEM in (role, b) else self.relabel

    @cached_property
    def matrices(self) -> dict[int | None, np.ndarray]:
        out = {}
        for role in (SYSTEM, USER, ASSISTANT, None):
            out[role] = np.array([[self.step(a, b)[0] + self.label(role, b) if b else float("inf") for b in range(4)] for a in range(4)])
        return out

    @cached_property
    def closing(self) -> list[tuple[int, ...]]:
        """Empty turns that complete a conversation that stands in a state."""
        return [() if a == ASSISTANT else (*self.between[a, ASSISTANT], ASSISTANT) for a in range(4)]

    @cached_property
    def final(self) -> np.ndarray:
        return np.array([self.insert * len(x) for x in self.closing])


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a[:, :, None] + b[None, :, :]).min(axis=1)


def chain(roles: list[int | None], costs: Costs) -> np.ndarray:
    out = np.where(np.eye(4, dtype=bool), 0.0, np.inf)
    for r in roles:
        out = product(out, costs.matrices[r])
    return out


def path(roles: list[int | None], entry: int, ahead: np.ndarray, costs: Costs) -> list[int]:
    """States after each turn on the cheapest path from `entry`, where leaving in state s costs ahead[s]."""
    best, back = np.where(np.arange(4) == entry, 0.0, np.inf), []
    for r in roles:
        every = best[:, None] + costs.matrices[r]
        back.append(every.argmin(axis=0))
        best = every.min(axis=0)
    states = [int((best + ahead).argmin())]
    for came in reversed(back[1:]):
        states.append(int(came[states[-1]]))
    return states[::-1]


def _open(role: int) -> str:
    return f"<|im_start|>{ROLES[role - 1]}\n"


_CLOSE = "<|im_end|>\n"


def _safe(text: str) -> str:
    return text.replace("<|im_", "< |im_")


def rendered(roles: list[int | None], texts: list[str], states: list[int], entry: int, ends: bool, costs: Costs) -> list[tuple]:
    """(role, action, inserted, cost, fragment) of consecutive turns."""
    out, before = [], entry
    for i, (role, text, state) in enumerate(zip(roles, texts, states, strict=True)):
        cost, merged, put = costs.step(before, state)
        cost += costs.label(role, state)
        done = [] if role == state else ["relabel"]
        if merged:
            fragment, done = "\n" + _safe(text), [*done, "merge"]
        else:
            close = "" if before == START else _CLOSE
            fragment = close + "".join(_open(r) + _CLOSE for r in put) + _open(state) + _safe(text)
        names = [ROLES[r - 1] for r in put]
        if ends and i + 1 == len(roles):
            fragment += _CLOSE + "".join(_open(r) + _CLOSE for r in costs.closing[state])
            cost += float(costs.final[state])
            names += [ROLES[r - 1] + " at the end" for r in costs.closing[state]]
        out.append((ROLES[state - 1], "+".join(done) or "keep", ", ".join(names), cost, fragment))
        before = state
    return out


def _role(name: object) -> int | None:
    name = str(name).strip().lower() if name is not None else ""
    return ROLES.index(name) + 1 if name in ROLES else None


def _groups(part: pd.DataFrame) -> list[tuple[int, int]]:
    """(from, to) of each conversation in a sorted part."""
    ids = part["conv_key"].to_numpy()
    cuts = np.flatnonzero(ids[1:] != ids[:-1]) + 1
    return list(zip([0, *cuts.tolist()], [*cuts.tolist(), len(ids)], strict=True))


def formatted(
    turns: DataFrame, costs: Costs | None = None, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", rows_per_part: int = ROWS_PER_PART
) -> DataFrame:
    """(conv_id, turn, seq, original_role, role, action, inserted, cost, fragment) of every turn."""
    costs = costs or Costs()
    modest_batches(turns.sparkSession)
    rows = turns.select(
        F.col(conv_id).alias("conv_id"),
        F.col(turn).alias("turn"),
        F.col(role).cast("string").alias("original_role"),
        F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"),
    )
    # One text per id, null too; the spread only parts rows that are equal otherwise.
    key = F.coalesce(F.concat(F.lit("="), F.col("conv_id").cast("string")), F.lit(""))
    order = ["conv_key", "no_turn", "turn", "original_role", "text_hash", "spread"]
    rows = rows.withColumns(
        {"conv_key": key, "no_turn": F.col("turn").isNull(), "text_hash": F.xxhash64("text"), "spread": F.xxhash64(F.monotonically_increasing_id())}
    )
    n_parts = max(1, turns.count() // rows_per_part)
    dealt = rows.repartitionByRange(n_parts, *order).sortWithinPartitions(*order)
    # Numbers follow the order within each part.
    dealt = dealt.select("conv_id", "conv_key", "turn", "original_role", "text", F.monotonically_increasing_id().alias("seq"))
    stored = written(dealt.withColumn("part", F.shiftright("seq", 33)), "turns")

    kinds = "part long, conv_key string, first boolean, last boolean, matrix array<double>"

    def ends(part: pd.DataFrame) -> pd.DataFrame:
        """The first and the last conversation of a part (or the one that is both)."""
        part = part.sort_values("seq", ignore_index=True)
        groups = _groups(part)
        out = []
        for n in sorted({0, len(groups) - 1}):
            a, b = groups[n]
            matrix = chain([_role(r) for r in part["original_role"][a:b]], costs)
            out.append((part["part"][0], part["conv_key"][a], n == 0, n == len(groups) - 1, matrix.ravel().tolist()))
        return pd.DataFrame(out, columns=["part", "conv_key", "first", "last", "matrix"])

    def cut(rows: pd.DataFrame) -> pd.DataFrame:
        """States at the cuts of one conversation: where each of its parts is entered and left (-1: it ends there)."""
        rows = rows.sort_values("part", ignore_index=True)
        matrices = [np.array(m).reshape(4, 4) for m in rows["matrix"]]
        ahead = [costs.final]
        for m in reversed(matrices[1:]):
            ahead.append((m + ahead[-1][None, :]).min(axis=1))
        state, out = START, []
        for n, (part, m) in enumerate(zip(rows["part"], matrices, strict=True)):
            left = int((m[state] + ahead[-1 - n]).argmin())
            is_last = n + 1 == len(matrices)
            out.append((part, rows["conv_key"][n], state, -1 if is_last else left))
            state = left
        return pd.DataFrame(out, columns=["part", "conv_key", "entry", "exit"])

    edges = written(stored.groupBy("part").applyInPandas(ends, kinds), "cuts")
    cuts = edges.groupBy("conv_key").applyInPandas(cut, "part long, conv_key string, entry int, exit int")

    id_type, turn_type = stored.schema["conv_id"].dataType, stored.schema["turn"].dataType
    result = T.StructType(
        [
            T.StructField("conv_id", id_type),
            T.StructField("turn", turn_type),
            T.StructField("seq", T.LongType()),
            *[T.StructField(n, T.StringType()) for n in ("original_role", "role", "action", "inserted")],
            T.StructField("cost", T.DoubleType()),
            T.StructField("fragment", T.StringType()),
        ]
    )

    def repair(part: pd.DataFrame, states: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("seq", ignore_index=True)
        fixed = {k: (a, b) for k, a, b in zip(states["conv_key"], states["entry"], states["exit"], strict=True)}
        out = []
        for a, b in _groups(part):
            entry, left = fixed.get(part["conv_key"][a], (START, -1))
            ahead = costs.final if left < 0 else np.where(np.arange(4) == left, 0.0, np.inf)
            roles = [_role(r) for r in part["original_role"][a:b]]
            out += rendered(roles, part["text"][a:b].tolist(), path(roles, entry, ahead, costs), entry, left < 0, costs)
        made = pd.DataFrame(out, columns=["role", "action", "inserted", "cost", "fragment"])
        return pd.concat([part[["conv_id", "turn", "seq", "original_role"]], made], axis=1)[result.fieldNames()]

    return stored.groupBy("part").cogroup(cuts.groupBy("part")).applyInPandas(repair, result)
