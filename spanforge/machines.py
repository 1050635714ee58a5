"""State machines over timelines, run block by block in parallel.

A rule that walks a timeline row by row (hysteresis, refractory periods, capped merging)
is a machine whose next state follows from its state and the row.  It is run as a
parallel prefix: each block of seconds becomes a table from entry state to exit state,
the tables of a key are followed along its blocks, and each block is replayed from the
state it is entered with.  A task holds one block; along a key only one table a block
is read, in order, with one state kept.
"""

from __future__ import annotations

from collections.abc import Sequence
from itertools import groupby, islice

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .blocks import block_of

#: seconds in a block
HOUR = 3600


class Machine:
    """States are short lists of numbers; ``start`` is the first one."""

    #: columns that a replay returns besides the keys
    out = ""
    start: list[float] = []

    def table(self, rows: list[tuple]) -> list[list[float]]:
        """What ``follow`` needs to know of a block."""
        raise NotImplementedError

    def follow(self, table: list[list[float]], state: list[float], block: int) -> list[float]:
        """State after a block that is entered with ``state``."""
        raise NotImplementedError

    def replay(self, rows: list[tuple], state: list[float], block: int) -> list[tuple]:
        """Rows that the block yields."""
        raise NotImplementedError


def run_blocks(df: DataFrame, keys: Sequence[str], t: str, columns: Sequence[str], machine: Machine, block: int = HOUR) -> tuple[DataFrame, DataFrame]:
    """Run a machine over ``columns`` (in this order within a block, numbers only).

    Returns what the replays yield, and the state (``__exit``) of each key at its end.
    """
    keys, columns = list(keys), list(columns)
    x = df.select(*keys, *columns, block_of(t, block).alias("__blk"))
    group, key_types = [*keys, "__blk"], [df.schema[k] for k in keys]
    at = T.StructField("__blk", T.LongType())
    tables_type = T.StructType([*key_types, at, *T.StructType.fromDDL("__table array<array<double>>").fields])
    states_type = T.StructType([*key_types, at, *T.StructType.fromDDL("__entry array<double>, __exit array<double>, __last boolean").fields])
    rows_type = T.StructType([*key_types, *T.StructType.fromDDL(machine.out).fields])
    tables_arrow, states_arrow, rows_arrow = map(to_arrow_schema, (tables_type, states_type, rows_type))

    def ordered(table: pa.Table) -> list[tuple]:
        return list(zip(*(c.to_pylist() for c in table.select(columns).sort_by([(c, "ascending") for c in columns]).columns), strict=True))

    def first(table: pa.Table, names: Sequence[str]) -> list[list]:
        return [[table[c][0].as_py()] for c in names]

    def tabulate(table: pa.Table) -> pa.Table:
        return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip([*first(table, group), [machine.table(ordered(table))]], tables_arrow, strict=True)], schema=tables_arrow)

    def compose(batches):
        rows = (row for b in batches for row in zip(*(c.to_pylist() for c in b.columns), strict=True))
        for key, blocks in groupby(rows, key=lambda r: r[: len(keys)]):
            state, held = machine.start, None
            for row in blocks:
                if held:
                    yield [*held, False]
                left = machine.follow(row[-1], state, row[-2])
                held = [*key, row[-2], state, left]
                state = left
            yield [*held, True]

    def batched(batches):
        rows = compose(batches)
        while part := list(islice(rows, 4096)):
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*part, strict=True), states_arrow, strict=True)], schema=states_arrow)

    def replay(rows: pa.Table, states: pa.Table) -> pa.Table:
        made = machine.replay(ordered(rows), states["__entry"][0].as_py(), rows["__blk"][0].as_py()) if rows.num_rows else []
        fields = [*[v * len(made) for v in first(rows, keys)], *zip(*made, strict=True)] if made else [[] for _ in rows_arrow]
        return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(fields, rows_arrow, strict=True)], schema=rows_arrow)

    tables = x.groupBy(*group).applyInArrow(tabulate, tables_type)
    states = tables.repartition(*keys).sortWithinPartitions(*group).mapInArrow(batched, states_type)
    own = [f"__key_{c}" for c in group]
    entries = states.select(*[F.col(c).alias(k) for c, k in zip(group, own, strict=True)], "__entry")
    made = x.groupBy(*group).cogroup(entries.groupBy(*own)).applyInArrow(replay, rows_type)
    return made, states.filter("__last").select(*keys, "__exit")


class Chain(Machine):
    """Heads of a greedy chain over ``(order..., value, base)``.

    The first row is a head; after a head the next one is the first row whose ``value``
    lies ``gap`` or more (``strict``: more than ``gap``) beyond the head's ``base``.
    States: base, block and number of the last head.  Yields for each row its columns,
    its head (block, number) and whether it is one.
    """

    start: list[float] = []

    def __init__(self, gap: float, strict: bool, out: str):
        self.gap, self.strict, self.out = gap, strict, out

    def far(self, value: float, base: float) -> bool:
        return value - base > self.gap if self.strict else value - base >= self.gap

    def _next(self, rows: list[tuple], base: float, k: int) -> int:
        while k < len(rows) and not self.far(rows[k][-2], base):
            k += 1
        return k

    def table(self, rows):
        """One row for each row that can be the block's first head (a new greatest value): value, base and number of heads after it."""
        best, last, out = None, {}, []
        for k, row in enumerate(rows):
            if best is None or row[-2] > best:
                best, path, at = row[-2], [], k
                while at < len(rows) and at not in last:
                    path.append(at)
                    at = self._next(rows, rows[at][-1], at + 1)
                base, count = last[at] if at < len(rows) else (rows[path[-1]][-1], -1)
                for at in reversed(path):
                    count += 1
                    last[at] = (base, count)
                out.append([best, *last[k]])
        return out

    def follow(self, table, state, block):
        for value, base, number in table:
            if not state or self.far(value, state[0]):
                return [base, block, number]
        return state

    def replay(self, rows, state, block):
        out, number = [], 0
        for row in rows:
            head = not state or self.far(row[-2], state[0])
            if head:
                state = [row[-1], block, number]
                number += 1
            out.append((*row, int(state[1]), int(state[2]), head))
        return out


class TwoThresholds(Machine):
    """Open/close windows of rows ``(t, m)``: ``start_s, end_s, source``.

    States: empty (closed, no run), run length and start of an active run, or 0 and the
    start of an open window.  Starts before a block are told apart by their age up to
    ``max_open`` only: beyond it they act alike.
    """

    out = "start_s int, end_s int, source string"

    def __init__(self, open_at: float, stop_at: float, min_run: int, max_open: int, block: int = HOUR):
        self.open_at, self.stop_at, self.min_run, self.max_open, self.block = open_at, stop_at, max(min_run, 1), max(max_open, 1), block

    def step(self, state: list[float], t: int, m: float) -> tuple[list[float], tuple | None]:
        active = m >= self.open_at
        if not state or state[0]:
            if not active:
                return [], None
            state = [min(state[0] + 1, self.min_run), state[1]] if state else [1, t]
            if state[0] < self.min_run:
                return state, None
        start = state[1]
        if m < self.stop_at:  # a run outlives the close
            return ([self.min_run, start] if active else []), (int(start), t, "motion")
        if t - start >= self.max_open:
            return [], (int(start), t, "motion_auto_close")
        return [0, start], None

    def entries(self, at: int) -> list[list[float]]:
        return [[], *([run, at - age] for run in range(self.min_run + 1) for age in range(1, self.max_open + 1))]

    def _seconds(self, rows):
        """One row a second, as a number that is not there is below all thresholds."""
        return [(t, float("-inf") if m is None or m != m else m) for t, m in rows]

    def table(self, rows):
        """Entry (run length, age) and exit (run length, start; none: that of the entry) of all entries that differ from the empty one's exit, which comes first."""
        rows = self._seconds(rows)
        at = rows[0][0] // self.block * self.block
        now = {tuple(e): [tuple(e)] for e in self.entries(at)}
        for t, m in rows:
            then: dict = {}
            for state, came in now.items():
                to = tuple(self.step(list(state), t, m)[0])
                then[to] = then[to] + came if to in then else came
            now = then
        exits = {e: s for s, came in now.items() for e in came}
        usual = exits[()]
        out = [[float(v) for v in usual]]
        for e, s in exits.items():
            if e and s != usual:
                out.append([float(e[0]), float(at - e[1]), *(float(v) for v in (s if not s or s[1] >= at else (s[0], float("nan"))))])
        return out

    def follow(self, table, state, block):
        if state:
            age = min(block * self.block - state[1], self.max_open)
            for run, old, *exit_ in table[1:]:
                if run == state[0] and old == age:
                    return [exit_[0], state[1]] if exit_ and exit_[1] != exit_[1] else exit_
        return table[0]

    def replay(self, rows, state, block):
        out = []
        for t, m in self._seconds(rows):
            state, window = self.step(state, t, m)
            if window:
                out.append(window)
        return out
