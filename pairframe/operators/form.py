"""Lagged form of both sides of an event, by spans of time that all participants share.

A table of events is dealt out once, by spans of days, so that both sides of an
event meet in the task that works out their form: the wide rows are made there
and never shuffled. What a span needs of the earlier ones is small: for every
participant and span the last rows and, for the exponential mean, an affine map
of the mean that comes in (see ``lagged.ewma``). These rows are folded by
participant. Spans shrink as the table grows, down to a day, which is the most
that a task holds at a time.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StructType

from pairframe.operators.lagged import FIRST, time_block

DAY = 86_400_000_000
#: Events that a span has on average.
ROWS = 20_000
STATE = "team {team}, __block long, come binary, known binary, delta binary, halo binary"


@dataclass(frozen=True)
class Form:
    """rest_days, {column}_r{k} and {column}_ewma of home_ and away_ columns, of rows before the event only.

    Results are those of ``lagged.gap_days``, ``rolling_mean`` and ``ewma`` over
    the two sides' rows; without ``alpha`` there is no exponential mean. A
    participant is on one side of an event. ``order`` tells events apart;
    ``days`` is the length of a span (see ``span``).
    """

    order: tuple[str, ...]
    time: str
    columns: tuple[str, ...]
    windows: tuple[int, ...] = (1, 3, 5, 10)
    alpha: float | None = 1 / 3
    default: int = 7
    days: int = 90

    @property
    def names(self) -> list[str]:
        return ["rest_days", *[f"{c}_{k}" for c in self.columns for k in (*[f"r{w}" for w in self.windows], *(["ewma"] if self.alpha else []))]]

    def _row(self) -> np.dtype:
        """A row of a participant as spans hand it on."""
        n = len(self.columns)
        return np.dtype([("t", "<i8"), ("timed", "?"), ("x", "<f8", (n,)), ("has", "?", (n,))])

    def _map(self) -> np.dtype:
        """What a span makes of the means that come in, by column."""
        return np.dtype([("first", "<i8"), ("after", "<i8"), ("x", "<f8"), ("y", "<f8"), ("weight", "<f8"), ("some", "?")])

    def dealt(self, events: DataFrame) -> DataFrame:
        return events.withColumn("__block", F.coalesce(time_block(self.time, self.days).cast("long"), F.lit(FIRST)))

    def states(self, events: DataFrame) -> DataFrame:
        """What comes into every (participant, span)."""
        kind = dict(events.dtypes)["home_team"]
        narrow = self.dealt(events).select("__block", *dict.fromkeys([*self.order, self.time]), "home_team", "away_team", *[f"{p}_{c}" for p in ("home", "away") for c in self.columns])
        ends = narrow.groupBy("__block").applyInArrow(lambda rows: self._ends(rows), f"team {kind}, __block long, rows long, maps binary, tail binary")
        return ends.groupBy("team").applyInArrow(lambda rows: self._carried(rows), STATE.format(team=kind))

    def attach(self, events: DataFrame, states: DataFrame) -> DataFrame:
        """events with home_ and away_ form; they may be some of those that the states are of."""
        schema = StructType(list(events.schema.fields))
        for p in ("home", "away"):
            for n in self.names:
                schema = schema.add(f"{p}_{n}", LongType() if n == "rest_days" else DoubleType())
        blocks = self.dealt(events).groupBy("__block")
        return blocks.cogroup(states.groupBy("__block")).applyInArrow(lambda rows, came: self._form(rows, came), schema)

    def _sides(self, events: pa.Table) -> tuple[np.ndarray, pa.ChunkedArray]:
        """Rows of home sides, then of away sides, and their participants."""
        n, rows = events.num_rows, np.zeros(2 * events.num_rows, self._row())
        t = events[self.time]
        t = t.cast(pa.timestamp("us")) if not pa.types.is_timestamp(t.type) else t
        rows["t"] = np.tile(pc.fill_null(t.cast(pa.int64()), 0).to_numpy(), 2)
        rows["timed"] = np.tile(pc.is_valid(t).to_numpy(), 2)
        for k, p in enumerate(("home", "away")):
            for i, c in enumerate(self.columns):
                x = events[f"{p}_{c}"]
                rows["has"][k * n : (k + 1) * n, i] = pc.is_valid(x).to_numpy()
                rows["x"][k * n : (k + 1) * n, i] = pc.fill_null(x.cast(pa.float64()), 0.0).to_numpy()
        return rows, pa.chunked_array([*events["home_team"].chunks, *events["away_team"].chunks], events["home_team"].type)

    def _sorted(self, events: pa.Table) -> pa.Table:
        return events.take(pc.sort_indices(events.select(self.order), sort_keys=[(o, "ascending") for o in self.order], null_placement="at_start"))

    def _fold(self, rows: np.ndarray, starts: np.ndarray, counts: np.ndarray, y: np.ndarray, known: np.ndarray, delta: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Means before every row, whether there is one, and the maps of the participants, whose rows lie one after the other."""
        shape = y.shape
        before, is_there = np.zeros((len(rows), shape[1])), np.zeros((len(rows), shape[1]), bool)
        maps, age, weight, some, y, known = np.zeros(shape, self._map()), np.zeros(shape, np.int64), np.ones(shape), np.zeros(shape, bool), y.copy(), known.copy()
        longest = np.argsort(-counts, kind="stable")
        for t in range(counts.max(initial=0)):
            on = longest[: np.searchsorted(-counts[longest], -t, side="left")]
            at = starts[on] + t
            before[at], is_there[at] = y[on], known[on]
            x, has, seen = rows["x"][at], rows["has"][at], some[on]
            gap = age[on] + 1
            k = (1 - self.alpha) ** gap
            again = has & seen
            y[on] = np.where(again, (k * y[on] + self.alpha * x) / (k + self.alpha), np.where(has, x + delta[on], y[on]))
            weight[on] = np.where(again, weight[on] * (k / (k + self.alpha)), weight[on])
            new = has & ~seen
            maps["first"][on] = np.where(new, t + 1, maps["first"][on])
            maps["x"][on] = np.where(new, x, maps["x"][on])
            age[on], some[on], known[on] = np.where(has, 0, gap), seen | has, known[on] | has
        maps["after"], maps["y"], maps["weight"], maps["some"] = age, y, weight, some
        return before, is_there, maps

    def _ends(self, events: pa.Table) -> pa.Table:
        """The maps and the last rows of every participant in a span."""
        events = self._sorted(events)
        rows, teams = self._sides(events)
        coded = teams.combine_chunks().dictionary_encode(null_encoding="encode")
        code, n = coded.indices.to_numpy(), len(coded.dictionary)
        by_team = np.lexsort((np.tile(np.arange(events.num_rows), 2), code))
        rows, counts = rows[by_team], np.bincount(code, minlength=n)
        starts, shape = np.cumsum(counts) - counts, (n, len(self.columns))
        maps = self._fold(rows, starts, counts, np.zeros(shape), np.zeros(shape, bool), np.zeros(shape))[2] if self.alpha else np.zeros(shape, self._map())
        tails = [rows[max(s, s + c - max(self.windows)) : s + c].tobytes() for s, c in zip(starts, counts, strict=True)]
        parts = [coded.dictionary, pa.repeat(events["__block"][0], n), pa.array(counts, pa.int64()), pa.array([m.tobytes() for m in maps], pa.binary()), pa.array(tails, pa.binary())]
        return pa.table(parts, names=["team", "__block", "rows", "maps", "tail"])

    def _carried(self, ends: pa.Table) -> pa.Table:
        """The means that come into each span of a participant, by how much they change the mean at its first value, and the rows before it."""
        ends = ends.sort_by("__block")
        n, alpha = len(self.columns), self.alpha or 1.0
        y, known, age, halo, out = np.zeros(n), np.zeros(n, bool), np.zeros(n, np.int64), np.zeros(0, self._row()), []
        for rows, maps, tail in zip(*[ends[c].to_pylist() for c in ("rows", "maps", "tail")], strict=True):
            b = np.frombuffer(maps, self._map())
            k = (1 - alpha) ** (age + b["first"])
            delta = np.where(known & b["some"], (k * y + alpha * b["x"]) / (k + alpha) - b["x"], 0.0)
            out.append((y.tobytes(), known.tobytes(), delta.tobytes(), halo.tobytes()))
            y, age, known = np.where(b["some"], b["y"] + b["weight"] * delta, y), np.where(b["some"], b["after"], age + rows), known | b["some"]
            halo = np.concatenate([halo, np.frombuffer(tail, self._row())])[-max(self.windows) :]
        return pa.table([ends["team"], ends["__block"], *[pa.array(c, pa.binary()) for c in zip(*out, strict=True)]], names=["team", "__block", "come", "known", "delta", "halo"])

    def _form(self, events: pa.Table, states: pa.Table) -> pa.Table:
        """The events of a span with both sides' form."""
        n, width = events.num_rows, len(self.columns)
        if n:
            events = self._sorted(events)
        own, teams = self._sides(events)
        # participants get numbers; those of states come first
        coded = pa.chunked_array([*states["team"].chunks, *teams.chunks], teams.type).combine_chunks().dictionary_encode(null_encoding="encode")
        code, held = coded.indices.to_numpy(), states.num_rows
        came = {c: states[c].to_pylist() for c in ("come", "known", "delta", "halo")}
        read = lambda c, kind: np.array([np.frombuffer(b, kind) for b in came[c]], kind).reshape(held, width)
        halos = [np.frombuffer(b, self._row()) for b in came["halo"]]
        rows = np.concatenate([*halos, own])
        lengths = np.array([len(h) for h in halos], np.int64)
        at_code = np.concatenate([np.repeat(code[:held], lengths), code[held:]])
        place = np.concatenate([np.arange(len(rows) - 2 * n) - len(rows), np.tile(np.arange(n), 2)])
        by_team = np.lexsort((place, at_code))
        all_rows = rows[by_team]
        counts = np.bincount(at_code, minlength=held)
        starts = np.cumsum(counts) - counts
        back = np.arange(len(rows)) - np.repeat(starts, counts)
        mine = by_team >= len(rows) - 2 * n
        to = by_team[mine] - (len(rows) - 2 * n)

        def before(j: int) -> tuple[np.ndarray, np.ndarray]:
            return np.maximum(np.flatnonzero(mine) - j, 0), back[mine] >= j

        found: dict[str, tuple[np.ndarray, np.ndarray]] = {}

        def keep(name: str, values: np.ndarray, there: np.ndarray) -> None:
            out, ok = np.empty(2 * n, values.dtype), np.empty(2 * n, bool)
            out[to], ok[to] = values, there
            found[name] = (out, ok)

        at, ok = before(1)
        ok = ok & all_rows["timed"][at] & all_rows["timed"][mine]
        gap = all_rows["t"][mine] - all_rows["t"][at]
        keep("rest_days", np.where(ok, np.sign(gap) * (np.abs(gap) // DAY), self.default), np.ones(len(to), bool))
        for k in self.windows:
            total, some = np.zeros((len(to), width)), np.zeros((len(to), width), np.int64)
            for j in range(k, 0, -1):
                at, ok = before(j)
                has = all_rows["has"][at] & ok[:, None]
                total, some = total + np.where(has, all_rows["x"][at], 0.0), some + has
            mean = total / np.maximum(some, 1)
            for i, c in enumerate(self.columns):
                keep(f"{c}_r{k}", mean[:, i], some[:, i] > 0)
        if self.alpha:
            sums = np.bincount(code[held:], minlength=held)
            mean, there, _ = self._fold(all_rows[mine], np.cumsum(sums) - sums, sums, read("come", "<f8"), read("known", "?"), read("delta", "<f8"))
            for i, c in enumerate(self.columns):
                keep(f"{c}_ewma", mean[:, i], there[:, i])
        out = events.drop_columns(["__block"])
        for p, part in (("home", slice(0, n)), ("away", slice(n, 2 * n))):
            for name in self.names:
                values, ok = found[name]
                out = out.append_column(f"{p}_{name}", pa.array(values[part], pa.int64() if name == "rest_days" else pa.float64(), mask=~ok[part]))
        return out


def span(events: DataFrame, time: str, rows: int = ROWS, most: int = 90) -> int:
    """Days in which about ``rows`` events lie, from 1 to ``most``."""
    n, first, last = events.agg(F.count(time), F.min(F.to_date(time)), F.max(F.to_date(time))).first()
    return max(1, min(most, ((last - first).days + 1) * rows // n)) if n else most
