"""Chat formatting with minimum-cost role repair.

Legal conversations are: an optional system turn, then user and assistant in
turn, an assistant turn last. Every input turn is placed as a turn of some role
(relabelled, at a cost, if that isn't its own), merged into the turn before it,
or preceded by an empty inserted turn. A step is a 4 x 4 matrix of costs between
automaton states that depends on the turn's role alone, and steps compose in the
(min, +) algebra, which is associative: conversations of any length are repaired
chunk by chunk, the chunks' matrices giving the states at their borders.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skylode.llm.common import written

START, SYSTEM, USER, ASSISTANT = range(4)
NAMES = ("", "system", "user", "assistant")
#: Role names that stand for one of the three.
ALIASES = {"system": SYSTEM, "developer": SYSTEM, "user": USER, "human": USER, "prompter": USER, "assistant": ASSISTANT, "gpt": ASSISTANT, "bot": ASSISTANT, "model": ASSISTANT}
LEGAL = ((START, SYSTEM), (START, USER), (SYSTEM, USER), (USER, ASSISTANT), (ASSISTANT, USER))
#: Costs of merging a turn, of another role than its own, of a role for a turn
#: without a known one, and of an empty turn.
MERGE, RELABEL, NAME, INSERT = 1.0, 4.0, 0.5, 3.0
#: Turns of one chunk, and rows that a task holds at a time.
CHUNK = 4096

KEEP, MERGED = "keep", "merge"
_MARKER, _ESCAPED = re.compile(r"<(\\*)\|"), re.compile(r"<(\\*)\\\|")
_TURN = re.compile(r"<\|(system|user|assistant)\|>\n(.*?)<\|end\|>\n", re.DOTALL)
_LEGAL = np.full((4, 4), np.inf)
for _a, _b in LEGAL:
    _LEGAL[_a, _b] = 0.0


def _role_cost(role: int, to: int) -> float:
    return 0.0 if role == to else NAME if role == START else RELABEL


def _steps() -> tuple[np.ndarray, np.ndarray]:
    """cost[role, from, to] of one turn, and what it does: 0 place, 1 merge, 2 + s: insert s, place."""
    cost, how = np.full((4, 4, 4), np.inf), np.zeros((4, 4, 4), np.int64)
    for role in range(4):
        for s in range(4):
            for t in range(1, 4):
                options = [(_LEGAL[s, t] + _role_cost(role, t), 0)]
                if s == t:
                    options.append((MERGE + _role_cost(role, t), 1))
                options += [(_LEGAL[s, m] + INSERT + _LEGAL[m, t] + _role_cost(role, t), 2 + m) for m in range(1, 4)]
                cost[role, s, t], how[role, s, t] = min(options)
    return cost, how


STEP, HOW = _steps()
#: Cost of ending in a state; the empty turns that a user or system turn lacks at the end.
END = np.array([0.0, 2 * INSERT, INSERT, 0.0])
END_TURNS = ((), (USER, ASSISTANT), (ASSISTANT,), ())


def compose(roles: np.ndarray) -> np.ndarray:
    """The (min, +) product of the turns' matrices, by pairwise reduction."""
    parts = STEP[roles]
    while len(parts) > 1:
        odd = parts[len(parts) & ~1 :]
        parts = np.concatenate(((parts[0::2][: len(parts) // 2, :, :, None] + parts[1::2][:, None, :, :]).min(axis=2), odd))
    return parts[0]


def path(roles: np.ndarray, entry: int, leave: int) -> list[int]:
    """The states after each turn on a cheapest path from ``entry`` to ``leave``."""
    cost = np.full(4, np.inf)
    cost[entry] = 0
    back = np.empty((len(roles), 4), np.int64)
    for i, r in enumerate(roles):
        total = cost[:, None] + STEP[r]
        back[i] = total.argmin(axis=0)
        cost = total.min(axis=0)
    states, at = [], leave
    for i in range(len(roles) - 1, -1, -1):
        states.append(at)
        at = int(back[i, at])
    return states[::-1]


def role_numbers(names: list[str | None]) -> np.ndarray:
    return np.array([ALIASES.get((n or "").strip().lower(), START) for n in names], np.int64)


def escaped(text: str) -> str:
    """``text`` without anything that reads as a marker: each ``<|`` gets a backslash
    between its characters, and one more if it has some there."""
    return _MARKER.sub(r"<\1\\|", text)


def unescaped(text: str) -> str:
    """What ``escaped`` was given."""
    return _ESCAPED.sub(r"<\1|", text)


def parsed(rendered: str) -> list[tuple[str, str]]:
    """(role, text) of the turns of a rendered conversation; merged texts stay joined."""
    return [(role, unescaped(text)) for role, text in _TURN.findall(rendered)]


def _turns(roles: np.ndarray, texts: list[str | None], entry: int, leave: int, first: int, last: bool) -> list[tuple]:
    """(order_key, role, action, text, rendered) of the output rows of one chunk."""
    out, state = [], entry
    opens = lambda s, new, text: ("<|end|>\n" if s != START else "") + f"<|{NAMES[new]}|>\n{escaped(text)}"
    for i, (role, text, new) in enumerate(zip(roles, texts, path(roles, entry, leave))):
        key, text, how = 3 * (first + i), text or "", int(HOW[role, state, new])
        if how == 1:
            out.append((key + 1, NAMES[new], MERGED, text, "\n" + escaped(text)))
        else:
            if how >= 2:
                out.append((key, NAMES[how - 2], "insert", "", opens(state, how - 2, "")))
                state = how - 2
            out.append((key + 1, NAMES[new], KEEP if role == new else "relabel", text, opens(state, new, text)))
        state = new
    if last:
        key = 3 * (first + len(roles))
        for i, new in enumerate(END_TURNS[state]):
            out.append((key + i, NAMES[new], "insert", "", opens(state, new, "")))
            state = new
        k, role, action, text, rendered = out[-1]
        out[-1] = (k, role, action, text, rendered + "<|end|>\n")
    return out


def format_chats(df: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", chunk: int = CHUNK) -> DataFrame:
    """Repaired and rendered turns: ``conv_id, order_key, role, action, text, rendered``.

    One row for each input turn (action keep, relabel or merge) and each inserted
    empty turn (insert). ``rendered``, joined in the order of ``order_key``, is the
    conversation's chat text, in which texts are ``escaped`` so that none can pass
    for a marker; ``parsed`` reads it back. Turns are ordered by turn, role and text, nulls
    first; equal rows are turns of their own (and get merged). A null or unknown
    role takes any role cheaply, a null text is empty, null conversation ids form
    one conversation. No rows give no rows; other columns are not read.

    A conversation of over ``chunk`` turns is never gathered: its turns are
    ordered by a range sort and repaired in chunks, and only one matrix for each
    chunk meets in one place.
    """
    rows = df.select(F.col(conv_col).alias("conv_id"), F.col(turn_col).alias("turn"), F.col(role_col).cast("string").alias("role"), F.col(text_col).alias("text"))
    order = ["conv_id", "turn", "role", "text"]
    kind = rows.schema["conv_id"].dataType
    schema = f"conv_id {kind.simpleString()}, order_key long, role string, action string, text string, rendered string"
    id_type = df.sparkSession.createDataFrame([], rows.select("conv_id").schema).toArrow().schema.field(0).type
    types = [id_type, pa.int64(), *[pa.string()] * 4]
    names = ["conv_id", "order_key", "role", "action", "text", "rendered"]

    def batch_of(found: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*found)) or [()] * 6
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=names)

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Conversations that come one after another, each within the chunk size."""

        def done() -> list[tuple]:
            roles = role_numbers([r[1] for r in held])
            leave = int((compose(roles)[START] + END).argmin())
            return [(held[0][0], *t) for t in _turns(roles, [r[2] for r in held], START, leave, 0, True)]

        held: list[tuple] = []
        for batch in batches:
            out: list[tuple] = []
            for row in zip(*(c.to_pylist() for c in batch.select(["conv_id", "role", "text"]).columns)):
                if held and held[0][0] != row[0]:
                    out += done()
                    held = []
                held.append(row)
            yield batch_of(out)
        if held:
            yield batch_of(done())

    # Long conversations are few: one in `chunk` rows at most.
    long = written(rows.groupBy("conv_id").count().filter(F.col("count") > chunk).select(F.col("conv_id").alias("long_id")), "long-chats")
    n_long = long.count()
    if not n_long:
        return rows.repartition("conv_id").sortWithinPartitions(*order).mapInArrow(whole, schema)
    hint = F.broadcast(long) if n_long <= 100_000 else long
    same = F.col("conv_id").eqNullSafe(F.col("long_id"))
    short = rows.join(hint, same, "left_anti").repartition("conv_id").sortWithinPartitions(*order).mapInArrow(whole, schema)
    ranged = rows.join(hint, same, "left_semi").repartitionByRange(*order).sortWithinPartitions(*order)
    # Numbered by range partition (upper bits) and place in it; written, so that all steps see one numbering.
    placed = written(ranged.withColumn("at", F.monotonically_increasing_id()), "chat-turns")
    part, place = F.shiftright("at", 33), F.col("at").bitwiseAND(F.lit((1 << 33) - 1))
    placed = placed.withColumn("chunk", F.shiftleft(part, 33) + F.floor(place / chunk))

    def summary(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("at")
        return pd.DataFrame({"conv_id": rows["conv_id"].iloc[:1], "chunk": rows["chunk"].iloc[:1], "n": [len(rows)], "costs": [compose(role_numbers(rows["role"].tolist())).ravel().tolist()]})

    def borders(chunks: pd.DataFrame) -> pd.DataFrame:
        """Prefix scan over one conversation's matrices, then the states on a cheapest path."""
        chunks = chunks.sort_values("chunk").reset_index(drop=True)
        matrices = [np.array(c).reshape(4, 4) for c in chunks["costs"]]
        cost, back = np.array([0.0, np.inf, np.inf, np.inf]), []
        for m in matrices:
            total = cost[:, None] + m
            back.append(total.argmin(axis=0))
            cost = total.min(axis=0)
        leave, states = int((cost + END).argmin()), []
        for b in reversed(back):
            states.append((int(b[leave]), leave))
            leave = int(b[leave])
        n = chunks["n"].to_numpy()
        entry, leave_ = zip(*reversed(states))
        return chunks[["conv_id", "chunk"]].assign(entry=entry, leave=leave_, first=np.cumsum(n) - n, last=np.arange(len(n)) == len(n) - 1)

    id_part = f"conv_id {kind.simpleString()}, chunk long"
    sums = placed.groupBy("conv_id", "chunk").applyInPandas(summary, f"{id_part}, n long, costs array<double>")
    border = written(sums.groupBy("conv_id").applyInPandas(borders, f"{id_part}, entry int, leave int, first long, last boolean"), "chat-borders")
    border = border.select(F.col("conv_id").alias("b_conv"), F.col("chunk").alias("b_chunk"), "entry", "leave", "first", "last")

    def repair(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("at")
        roles = role_numbers(rows["role"].to_pylist())
        one = {c: rows[c][0].as_py() for c in ("conv_id", "entry", "leave", "first", "last")}
        turns = _turns(roles, rows["text"].to_pylist(), one["entry"], one["leave"], one["first"], one["last"])
        return pa.Table.from_batches([batch_of([(one["conv_id"], *t) for t in turns])])

    joined = placed.join(border, F.col("conv_id").eqNullSafe(F.col("b_conv")) & (F.col("chunk") == F.col("b_chunk")))
    return short.unionByName(joined.groupBy("conv_id", "chunk").applyInArrow(repair, schema))
