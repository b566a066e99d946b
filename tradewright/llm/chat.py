"""Chat formatting by minimum-cost role repair.

A legal conversation is an optional system turn, then user and assistant in turn, ending with the assistant. For each
turn a dynamic program over the states of that automaton chooses to keep it, relabel it, merge it with the turn
before, or put an empty turn in front of it, at the least total cost. A turn acts on the states as a min-plus matrix, so a
conversation of any length is split: turns are range-dealt in order, each task multiplies the matrices of the
conversations that cross its borders, the driver joins those few, and each task then decides its own turns.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tradewright.session import cut_lineage, ship_package

START, SYSTEM, USER, ASSISTANT = range(4)
ROLES = (None, "system", "user", "assistant")
DIRECT = {(START, SYSTEM), (START, USER), (SYSTEM, USER), (USER, ASSISTANT), (ASSISTANT, USER)}
#: The empty turn that makes a step legal.
BETWEEN = {(USER, USER): ASSISTANT, (START, ASSISTANT): USER, (SYSTEM, ASSISTANT): USER, (ASSISTANT, ASSISTANT): USER}
MERGE, RELABEL, UNKNOWN, INSERT = 1, 2, 1, 3
#: Cost of ending in a state: empty turns up to an assistant's.
END_COST = (0, 2 * INSERT, INSERT, 0)
END_TURNS = ((), (USER, ASSISTANT), (ASSISTANT,), ())
FAR = 1 << 40
OUT = "conv_id long, turn long, role string, action string, inserted string, cost long, rendered string"


def steps(role: int) -> dict[tuple[int, int], tuple[int, str, int]]:
    """(state, next state) to (cost, action, role put in between or 0) for a turn of a role; 0 is an unknown role."""
    out: dict[tuple[int, int], tuple[int, str, int]] = {}
    for s in range(4):
        for q in (SYSTEM, USER, ASSISTANT):
            base, word = (0, "keep") if q == role else (RELABEL if role else UNKNOWN, "relabel")
            options = []
            if (s, q) in DIRECT:
                options.append((base, word, 0))
            if s == q:
                options.append((base + MERGE, "merge" if word == "keep" else "relabel and merge", 0))
            if (s, q) in BETWEEN:
                options.append((base + INSERT, word, BETWEEN[s, q]))
            if options:
                out[s, q] = min(options, key=lambda o: o[0])
    return out


STEPS = {role: steps(role) for role in range(4)}


def role_number(name: str | None) -> int:
    """System, user and assistant by name without regard to case or outer blanks; 0 for any other or null."""
    low = (name or "").strip().lower()
    return ROLES.index(low) if low in ROLES[1:] else 0


def matrix(role: int) -> np.ndarray:
    m = np.full((4, 4), FAR, np.int64)
    for (s, q), (cost, _, _) in STEPS[role].items():
        m[s, q] = cost
    return m


MATRICES = [matrix(r) for r in range(4)]


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.minimum((a[:, :, None] + b[None, :, :]).min(axis=1), FAR)


def best_path(roles: list[int], start: int = START, end: int | None = None) -> list[tuple[int, int, str, int]]:
    """(state, cost, action, inserted) of each turn on a cheapest path; smaller states win ties. Without an end, the cost of ending counts."""
    cost = [0 if s == start else FAR for s in range(4)]
    back: list[list[int]] = []
    for r in roles:
        new, came = [FAR] * 4, [0] * 4
        for (s, q), (c, _, _) in STEPS[r].items():
            if cost[s] + c < new[q]:
                new[q], came[q] = cost[s] + c, s
        cost = new
        back.append(came)
    if end is None:
        end = min(range(4), key=lambda s: cost[s] + END_COST[s])
    states = [end]
    for came in reversed(back):
        states.append(came[states[-1]])
    states.reverse()
    return [(q, *STEPS[r][s, q]) for r, s, q in zip(roles, states, states[1:])]


def _tag(role: int) -> str:
    return f"<|{ROLES[role]}|>\n"


CLOSE = "<|end|>\n"


def pieces(texts: list[str], path: list[tuple[int, int, str, int]], opens: bool, closes: bool) -> list[str]:
    """The rendered piece of each turn; joined in order they are the conversation."""
    out = []
    for i, (text, (state, _, action, put)) in enumerate(zip(texts, path)):
        if action.endswith("merge"):
            piece = "\n" + text
        else:
            piece = (CLOSE if i or not opens else "") + (_tag(put) + CLOSE if put else "") + _tag(state) + text
        out.append(piece)
    if closes and out:
        out[-1] += CLOSE + "".join(_tag(r) + CLOSE for r in END_TURNS[path[-1][0]])
    return out


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, object, list, list, list]]:
    """(partition, conv_id, turns, roles, texts) of each run of rows of one conversation within the partition."""
    part, conv, turns, roles, texts, begun = 0, None, [], [], [], False
    for batch in batches:
        for p, c, t, r, x in zip(*(batch.column(i).to_pylist() for i in range(5))):
            if begun and c != conv:
                yield part, conv, turns, roles, texts
                turns, roles, texts = [], [], []
            part, conv, begun = p, c, True
            turns.append(t)
            roles.append(r)
            texts.append(x)
    if begun:
        yield part, conv, turns, roles, texts


def _borders(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The matrix of the first and of the last conversation of a partition (one row if it is the same)."""
    part, held = 0, []
    conv, total, count = None, None, 0
    rows: list[tuple[int, object, np.ndarray]] = []
    for batch in batches:
        for p, c, r in zip(*(batch.column(i).to_pylist() for i in range(3))):
            if total is None or c != conv:
                if total is not None:
                    rows = [*rows[:1], (count, conv, total)]
                    count += 1
                conv, total = c, MATRICES[role_number(r)]
            else:
                total = product(total, MATRICES[role_number(r)])
            part = p
    if total is None:
        return
    rows = [*rows[:1], (count, conv, total)]
    yield pa.RecordBatch.from_arrays([pa.array([part] * len(rows), pa.int32()), pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()),
                                      pa.array([r[2].reshape(-1).tolist() for r in rows], pa.list_(pa.int64()))], ["part", "place", "conv_id", "matrix"])


def _joints(rows: list) -> dict[tuple[int, int], tuple[int, int | None, bool, bool]]:
    """For the conversations that cross borders: (partition, place in it) to (state before, state after or None, opens, closes)."""
    out: dict[tuple[int, int], tuple[int, int | None, bool, bool]] = {}
    rows = sorted(rows, key=lambda r: (r.part, r.place))
    i = 0
    while i < len(rows):
        j = i
        while j + 1 < len(rows) and rows[j + 1].conv_id == rows[i].conv_id:
            j += 1
        if j > i:
            cost = np.array([0, FAR, FAR, FAR], np.int64)
            ways = []
            for r in rows[i:j + 1]:
                both = cost[:, None] + np.array(r.matrix, np.int64).reshape(4, 4)
                ways.append(both.argmin(axis=0))
                cost = np.minimum(both.min(axis=0), FAR)
            state = int((cost + np.array(END_COST)).argmin())
            states = [state]
            for came in reversed(ways):
                states.append(int(came[states[-1]]))
            states.reverse()
            for k, r in enumerate(rows[i:j + 1]):
                out[r.part, r.place] = (states[k], states[k + 1], k == 0, k == j - i)
        i = j + 1
    return out


def repair(conversations: DataFrame) -> DataFrame:
    """A row for each turn: conv_id, turn, role (repaired), action, inserted (role of the empty turn before it, or null), cost, rendered.

    The rendered pieces of a conversation, in order, are its chat text; empty turns at its end stand in its last piece. Turns stand by turn
    number (null first), then role and text, so ties and repeated rows have one order. A null or unknown role costs less to
    relabel; a null text is empty. Rows with a null conv_id are one conversation. An empty table gives no rows; other
    columns are not read.
    """
    ship_package(conversations.sparkSession)
    keys = ["conv_id", "turn", "role", "text"]
    dealt = (conversations.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text")
             .repartitionByRange(*[F.asc_nulls_first(k) for k in keys]).sortWithinPartitions(*[F.asc_nulls_first(k) for k in keys]))
    dealt = cut_lineage(dealt.select(F.spark_partition_id().alias("part"), *keys))      # both passes read the same partitions
    ends = dealt.select("part", "conv_id", "role").mapInArrow(_borders, "part int, place long, conv_id long, matrix array<long>")
    joints = _joints(ends.collect())                                                      # two rows for each partition at most

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for place, (part, conv, turns, roles, texts) in enumerate(_runs(batches)):
            start, end, opens, closes = joints.get((part, place), (START, None, True, True))
            path = best_path([role_number(r) for r in roles], start, end)
            drawn = pieces([t or "" for t in texts], path, opens, closes)
            yield pa.RecordBatch.from_arrays(
                [pa.array([conv] * len(turns), pa.int64()), pa.array(turns, pa.int64()), pa.array([ROLES[p[0]] for p in path], pa.string()), pa.array([p[2] for p in path], pa.string()),
                 pa.array([ROLES[p[3]] for p in path], pa.string()), pa.array([p[1] for p in path], pa.int64()), pa.array(drawn, pa.string())],
                ["conv_id", "turn", "role", "action", "inserted", "cost", "rendered"])

    return dealt.mapInArrow(decide, OUT)
