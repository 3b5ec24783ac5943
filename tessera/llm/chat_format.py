"""Operator 2, chat formatting by minimum-cost role repair.

Legal conversations are an optional system turn, then user and assistant in turn, from user to assistant. Dynamic
programming over that automaton (states: start, after system, after user, after assistant) chooses for every turn to keep
its role or to relabel it, to merge it into the turn before it if the roles are equal, and where to put empty turns, at the
least total cost. The repaired turns are rendered with a template.

Conversations are hash-distributed and stream through a task in order of their turns; a task holds one conversation at a
time. Defined results: turns are ordered by (turn, role, text), nulls first; a null or unknown role is relabelled at
``UNKNOWN``; a null text is empty; ids may be numbers or text; other columns, whatever their names, are not read; repeated rows are separate turns; a null conv_id is a conversation; ties prefer keeping,
then user, assistant, system, and merging to inserting; an empty table gives no rows.
"""

from __future__ import annotations

import math

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from tessera.llm.common import map_arrow

ROLES = ("user", "assistant", "system")
MERGE, RELABEL, UNKNOWN, INSERT = 1.0, 2.0, 1.5, 1.25
TEMPLATE = "<|im_start|>{role}\n{text}<|im_end|>\n"
START, SYSTEM, USER, ASSISTANT = range(4)
_STATE = {"user": USER, "assistant": ASSISTANT, "system": SYSTEM}

# Empty turns to put in before a turn of the role (state, role); None where it is illegal.
_FILL: dict[tuple[int, str], tuple[str, ...] | None] = {
    (START, "user"): (), (START, "assistant"): ("user",), (START, "system"): (),
    (SYSTEM, "user"): (), (SYSTEM, "assistant"): ("user",), (SYSTEM, "system"): None,
    (USER, "user"): ("assistant",), (USER, "assistant"): (), (USER, "system"): None,
    (ASSISTANT, "user"): (), (ASSISTANT, "assistant"): ("user",), (ASSISTANT, "system"): None,
}
# Empty turns that end a conversation legally.
_CLOSE: dict[int, tuple[str, ...]] = {START: (), SYSTEM: ("user", "assistant"), USER: ("assistant",), ASSISTANT: ()}


def repair(roles: list[str | None]) -> tuple[float, list[tuple[str, tuple[str, ...], bool]], tuple[str, ...]]:
    """Cost; for every turn its role, the empty turns before it and whether it merges; the empty turns at the end."""
    cost = {START: 0.0}
    back: list[dict[int, tuple[int, str, tuple[str, ...], bool]]] = []
    for given in roles:
        new: dict[int, float] = {}
        via: dict[int, tuple[int, str, tuple[str, ...], bool]] = {}
        ranked = sorted(ROLES, key=lambda r: (r != given, ROLES.index(r)))
        for role in ranked:
            named = 0.0 if role == given else RELABEL if given in ROLES else UNKNOWN
            to = _STATE[role]
            for state, so_far in cost.items():
                options = [(so_far + named + MERGE, (), True)] if state == to else []
                fill = _FILL[state, role]
                if fill is not None:
                    options.append((so_far + named + INSERT * len(fill), fill, False))
                for c, empty, merged in options:
                    if c < new.get(to, math.inf) - 1e-9:
                        new[to], via[to] = c, (state, role, empty, merged)
        cost = new
        back.append(via)
    total, state = min((c + INSERT * len(_CLOSE[s]), s) for s, c in cost.items())
    close, path = _CLOSE[state], []
    for via in reversed(back):
        state, role, empty, merged = via[state]
        path.append((role, empty, merged))
    return total, path[::-1], close


def formatted(turns: list[tuple[str | None, str]], template: str = TEMPLATE, joint: str = "\n") -> dict:
    """The repaired conversation: cost, counts of repairs, turns and rendered text."""
    total, path, close = repair([r for r, _ in turns])
    out: list[tuple[str, list[str]]] = []
    merged = relabelled = inserted = 0
    for (given, text), (role, empty, merge) in zip(turns, path, strict=True):
        for e in empty:
            out.append((e, []))
        inserted += len(empty)
        relabelled += role != given
        if merge:
            merged += 1
            out[-1][1].append(text)
        else:
            out.append((role, [text]))
    out += [(e, []) for e in close]
    inserted += len(close)
    final = [{"role": r, "text": joint.join(t)} for r, t in out]
    return {"n_in": len(turns), "n_out": len(final), "n_merged": merged, "n_relabelled": relabelled, "n_inserted": inserted, "cost": total, "turns": final, "rendered": "".join(template.format(role=t["role"], text=t["text"]) for t in final)}


_FIELDS = (("n_in", pa.int64()), ("n_out", pa.int64()), ("n_merged", pa.int64()), ("n_relabelled", pa.int64()), ("n_inserted", pa.int64()), ("cost", pa.float64()), ("turns", pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())]))), ("rendered", pa.string()))
_DDL = "n_in long, n_out long, n_merged long, n_relabelled long, n_inserted long, cost double, turns array<struct<role:string,text:string>>, rendered string"


def _format(template: str, kind: pa.DataType):
    def run(batches):
        ids, rows, current, turns = [], [], None, []

        def batch():
            out = pa.RecordBatch.from_arrays([pa.array(ids, kind), *(pa.array([r[n] for r in rows], t) for n, t in _FIELDS)], names=["conv_id", *(n for n, _ in _FIELDS)])
            ids.clear()
            rows.clear()
            return out

        def close():
            ids.append(current)
            rows.append(formatted(turns, template))

        for b in batches:
            for conv, role, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                if turns and conv != current:
                    close()
                    turns = []
                    if sum(len(r["rendered"]) for r in rows[-64:]) > 1 << 20 or len(rows) >= 4096:
                        yield batch()
                current = conv
                turns.append((role, text or ""))
        if turns:
            close()
        if rows:
            yield batch()

    return run


def format_conversations(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", template: str = TEMPLATE) -> DataFrame:
    """conv_id, n_in, n_out, n_merged, n_relabelled, n_inserted, cost, turns and rendered, one row a conversation."""
    kind = turns.schema[conv_col].dataType
    rows = turns.select(F.col(conv_col).alias("c"), F.col(turn_col).alias("t"), F.col(role_col).cast("string").alias("r"), F.col(text_col).cast("string").alias("x"))
    ordered = rows.repartition("c").sortWithinPartitions("c", "t", "r", "x")
    return ordered.select("c", "r", "x").transform(map_arrow, _format(template, to_arrow_type(kind)), f"conv_id {kind.simpleString()}, {_DDL}").withColumnRenamed("conv_id", conv_col)
