"""Chat formatting: minimum-cost role repair, then rendering.

A legal conversation is an optional system turn, then user and assistant in
turn, ending with the assistant. Dynamic programming over that automaton picks,
for every turn given, the role it is to have and whether it opens a new turn or
is merged into the one before, with empty turns inserted where the automaton
needs them, so that the sum of costs is least.
"""

from __future__ import annotations

from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairframe.llm.common import shuffle_partitions

ROLES = ("system", "user", "assistant")
FAR = 1 << 40


@dataclass(frozen=True)
class Costs:
    """What one repair costs. A role outside ROLES, or none, is named at ``name``."""

    merge: int = 1
    insert: int = 2
    relabel: int = 3
    name: int = 1


def _moves(costs: Costs) -> dict[tuple[int, int], list[tuple[int, tuple[int, ...], bool]]]:
    """(role before or -1, role) -> ways as (cost, roles of empty turns between, merged)."""
    follows = {-1: (0, 1), 0: (1,), 1: (2,), 2: (1,)}
    out: dict = {}
    for last in follows:
        for role in range(3):
            ways = [(costs.merge, (), True)] if last == role else []
            if role in follows[last]:
                ways.append((0, (), False))
            for empty in follows[last]:
                if empty != 0 and role in follows[empty] and role != 0:
                    ways.append((costs.insert, (empty,), False))
            out[last, role] = ways
    return out


def repair(roles: list[str | None], costs: Costs = Costs()) -> tuple[int, list[tuple[int, int | None]]]:
    """Least cost, and the repaired turns as (role, index of the given turn), None for an empty turn.

    Several given turns in one repaired turn follow one another with the same
    turn number: a merged turn is marked by role -1. Ties go to the way listed
    first, with earlier roles first.
    """
    moves = _moves(costs)
    best: dict[int, int] = {-1: 0}
    back: list[dict[int, tuple[int, tuple[int, ...], bool]]] = []
    for given in roles:
        known = ROLES.index(given) if given in ROLES else None
        now: dict[int, int] = {}
        came: dict[int, tuple[int, tuple[int, ...], bool]] = {}
        for role in range(3):
            label = costs.name if known is None else 0 if known == role else costs.relabel
            for last, so_far in best.items():
                for cost, empties, merged in moves[last, role]:
                    if so_far + label + cost < now.get(role, FAR):
                        now[role], came[role] = so_far + label + cost, (last, empties, merged)
        best = now
        back.append(came)
    ends = {-1: (0, ()), 0: (2 * costs.insert, (1, 2)), 1: (costs.insert, (2,)), 2: (0, ())}
    last = min(best, key=lambda r: (best[r] + ends[r][0], r))
    total, tail = best[last] + ends[last][0], [(r, None) for r in ends[last][1]]
    out: list[tuple[int, int | None]] = []
    for i in range(len(roles) - 1, -1, -1):
        before, empties, merged = back[i][last]
        out.append((-1 if merged else last, i))
        out += [(r, None) for r in reversed(empties)]
        last = before
    return total, out[::-1] + tail


def rendered(turns: list[tuple[int, int | None]], texts: list[str]) -> tuple[list[str], list[str]]:
    """Roles and texts of the repaired turns; merged texts are joined by a line break."""
    roles: list[str] = []
    parts: list[list[str]] = []
    for role, i in turns:
        if role != -1:
            roles.append(ROLES[role])
            parts.append([])
        parts[-1].append("" if i is None else texts[i])
    return roles, ["\n".join(p) for p in parts]


def format_chats(turns: DataFrame, costs: Costs = Costs(), conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row per conversation: conv_id, n_turns, cost, n_merged, n_relabelled, n_inserted, roles, texts, rendered.

    Turns go by turn number (null first), then role and text. Roles are compared
    in lower case without outer spaces; null texts are empty. Repeated rows are
    turns of their own, and a null conv_id is one conversation. An empty table
    gives no rows; other columns are ignored. Conversations are dealt out by a
    hash, many to a task; one conversation is repaired within one task, in time
    and memory in proportion to its turns. Texts are rendered as they are: one
    that holds ``<|end|>`` or a role's mark looks like a turn's end or start in
    ``rendered``, while ``roles`` and ``texts`` keep turns apart.
    """
    spread = 4 * shuffle_partitions(turns.sparkSession)
    rows = turns.select(
        F.col(f"`{conv_col}`").cast("long").alias("conv_id"), F.col(f"`{turn_col}`").cast("long").alias("turn"),
        F.lower(F.trim(F.col(f"`{role_col}`"))).alias("role"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"),
    ).withColumn("deal", F.pmod(F.xxhash64("conv_id"), F.lit(spread)))
    schema = "conv_id long, n_turns long, cost long, n_merged long, n_relabelled long, n_inserted long, roles array<string>, texts array<string>, rendered string"
    names = [f.split()[0] for f in schema.split(", ")]

    def run(group: pa.Table) -> pa.Table:
        group = group.sort_by([(c, "ascending") for c in ("conv_id", "turn", "role", "text")])
        columns = [group.column(c).to_pylist() for c in ("conv_id", "turn", "role", "text")]
        # sort_by puts nulls last; turns without a number come first
        order = sorted(range(group.num_rows), key=lambda i: (columns[0][i] is not None, columns[0][i] or 0, columns[1][i] is not None))
        conv, _, role, text = ([c[i] for i in order] for c in columns)
        out: list[list] = [[] for _ in names]
        at = 0
        while at < len(conv):
            end = at
            while end < len(conv) and conv[end] == conv[at]:
                end += 1
            given, texts = role[at:end], text[at:end]
            cost, made = repair(given, costs)
            roles, bodies = rendered(made, texts)
            current, changed = None, 0
            for r, i in made:
                current = current if r == -1 else r
                changed += i is not None and given[i] != ROLES[current]
            row = (conv[at], end - at, cost, sum(r == -1 for r, _ in made), changed, sum(i is None for _, i in made), roles, bodies, "".join(f"<|{r}|>\n{b}\n<|end|>\n" for r, b in zip(roles, bodies, strict=True)))
            for column, value in zip(out, row, strict=True):
                column.append(value)
            at = end
        kinds = [*[pa.int64()] * 6, pa.list_(pa.string()), pa.list_(pa.string()), pa.string()]
        return pa.table([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], names=names)

    return rows.groupBy("deal").applyInArrow(run, schema)
