"""Ordered folds: a small state machine run over each key's rows in order.

One key, or one moment of it, may hold much of the data, so a key is not folded in one go.
Its rows are cut by *tick*, the time resolution at which timers run out, and within a tick
by blocks of sequence numbers. A fold has few states apart from its timer, and a timer can
only end between ticks, so the work splits in five:

1. per (key, tick, block), in parallel: where does each possible entry state lead?
2. per (key, run of ticks), in parallel: those small maps composed into one for the run;
3. per key: chain the maps of its runs, one row per run;
4. per (key, run of ticks), in parallel: the entry state of each tick and block of the run;
5. per (key, tick, block), in parallel: replay the rows from the now known entry state.

Steps 1 and 5 see at most ``BLOCK_ROWS`` rows per group, as sorted streams, steps 2 and 4 the ticks and blocks of
``RUN_TICKS`` seconds. Step 3 sees a key's runs: as many as the time it spans has.

The map of a run is not one state per entry state where a timer is running on entry: the result then depends on when
it ends. It is a list of end times, each with the state that follows if the timer ends by then and not before, and the state for all later ones.
Neighbours with one result are one entry.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from flowwatch.session import Scratch

# Timer results of a step: KEEP leaves the timer, 0 stops it, more sets it to so many
# seconds after the row.
KEEP = -1

BLOCK_ROWS = 1 << 20
RUN_TICKS = 1 << 16

# No timer, and a timer that a run leaves as it was.
NEVER = 1 << 62
SAME = -(1 << 62)

_GROUP = ["key", "tick", "block"]
_RUN = ["key", "run"]
_KNOWN_LIMIT = 100_000


@dataclass(frozen=True)
class Machine:
    """``step(state, op, arg)`` gives (state, verdict, timer). While a timer runs the state is
    ``timed``; ``grace`` seconds after its end the state becomes ``after``. A timer ends with its state."""

    step: Callable[[int, int, int], tuple[int, str, int]]
    entries: tuple[int, ...]
    timed: int
    after: int
    grace: int = 0


def _groups(batch: pd.DataFrame, columns: list[str]) -> Iterator[tuple[tuple, int, int]]:
    """Runs of equal keys in a sorted batch, as (key, start, end)."""
    values = [batch[c].to_numpy() for c in columns]
    change = np.zeros(len(batch), dtype=bool)
    change[0] = True
    for v in values:
        change[1:] |= v[1:] != v[:-1]
    starts = np.flatnonzero(change)
    for lo, hi in zip(starts, np.append(starts[1:], len(batch))):
        yield tuple(v[lo] for v in values), lo, hi


def _tick_maps(machine: Machine):
    step, entries = machine.step, machine.entries
    columns = [*_GROUP, "exits", "timers"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        # What a command does to all entry states at once recurs all the time.
        known: dict[tuple, tuple] = {}

        def advance(states: tuple, op: int, arg: int) -> tuple:
            if (states, op, arg) not in known:
                if len(known) >= _KNOWN_LIMIT:
                    known.clear()
                results = [step(s, op, arg) for s in states]
                timers = tuple((e, r[2]) for e, r in enumerate(results) if r[2] != KEEP)
                known[states, op, arg] = tuple(r[0] for r in results), timers
            return known[states, op, arg]

        key, states, timers = None, entries, []
        done: list[tuple] = []
        for batch in batches:
            if batch.empty:
                continue
            ops, args = batch["op"].tolist(), batch["arg"].tolist()
            for here, lo, hi in _groups(batch, _GROUP):
                if here != key:
                    if key is not None:
                        done.append((*key, states, timers))
                    key, states, timers = here, entries, [KEEP] * len(entries)
                for i in range(lo, hi):
                    states, changed = advance(states, ops[i], args[i])
                    for e, timer in changed:
                        timers[e] = timer
            yield pd.DataFrame(done, columns=columns)
            done = []
        if key is not None:
            done.append((*key, states, timers))
        yield pd.DataFrame(done, columns=columns)

    return run


class _Run:
    """The ticks and blocks of one run of a key, from their maps."""

    def __init__(self, machine: Machine, ticks: list[int], exits: list[list[int]], timers: list[list[int]]):
        self.machine, self.ticks, self.exits, self.timers = machine, ticks, exits, timers
        timed = machine.entries.index(machine.timed)
        # The next place where a state with a running timer meets a map that changes it.
        self.next = [len(ticks)] * (len(ticks) + 1)
        for i in range(len(ticks) - 1, -1, -1):
            touched = exits[i][timed] != machine.timed or timers[i][timed] != KEEP
            self.next[i] = i if touched else self.next[i + 1]

    def results(self) -> list[dict[int, tuple[int, int]]]:
        """For each place the end of the run from each state, without a timer that may end on the way."""
        machine, ticks = self.machine, self.ticks
        found: list[dict[int, tuple[int, int]]] = [{}] * len(ticks)
        for i in range(len(ticks) - 1, -1, -1):
            here, ends = {}, {}
            for state, after, timer in zip(machine.entries, self.exits[i], self.timers[i]):
                if (after, timer) not in ends:
                    running = after == machine.timed and timer > 0
                    ends[after, timer] = self.end(found, i + 1, after, ticks[i] + timer + machine.grace if running else NEVER)
                here[state] = ends[after, timer]
            found[i] = here
        return found

    def end(self, found: list[dict[int, tuple[int, int]]], i: int, state: int, until: int) -> tuple[int, int]:
        """Where the run ends from this state before the i-th map; this and later places are known."""
        n = len(self.ticks)
        if state != self.machine.timed:
            return found[i][state] if i < n else (state, NEVER)
        touched = self.next[i]
        over = bisect_left(self.ticks, until, i) if until != NEVER else n
        if over <= touched and over < n:
            return found[over][self.machine.after]
        return found[touched][state] if touched < n else (state, until)

    def total(self) -> tuple[list[int], list[int], list[int], list[int], list[int]]:
        """By entry state its result (state, end of timer), of the timed one if its timer does not end; then the end times with theirs."""
        found, n, touched = self.results(), len(self.ticks), self.next[0]
        ends = [found[0][state] for state in self.machine.entries]
        ends[self.machine.entries.index(self.machine.timed)] = found[touched][self.machine.timed] if touched < n else (self.machine.timed, SAME)
        by, results = [], []
        for i in range(min(touched + 1, n)):
            end = found[i][self.machine.after]
            if by and results[-1] == end:
                by[-1] = self.ticks[i]
            else:
                by.append(self.ticks[i])
                results.append(end)
        return [e[0] for e in ends], [e[1] for e in ends], by, [e[0] for e in results], [e[1] for e in results]


_TOTAL = "states array<int>, untils array<bigint>, by array<bigint>, by_state array<int>, by_until array<bigint>"


def _totals(machine: Machine):
    columns = [*_RUN, "states", "untils", "by", "by_state", "by_until"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, held = None, ([], [], [])

        def total() -> tuple:
            return (*key, *_Run(machine, *held).total())

        for batch in batches:
            if batch.empty:
                continue
            done = []
            flat = batch["tick"].tolist(), [x.tolist() for x in batch["exits"]], [x.tolist() for x in batch["timers"]]
            for here, lo, hi in _groups(batch, _RUN):
                if here != key and held[0]:
                    done.append(total())
                    held = ([], [], [])
                key = here
                for mine, new in zip(held, flat):
                    mine += new[lo:hi]
            yield pd.DataFrame(done, columns=columns)
        if held[0]:
            yield pd.DataFrame([total()], columns=columns)

    return run


def _chain(machine: Machine):
    """The entry of each run of a key, and after its last run, under no run, what the key is left with."""
    index = {e: i for i, e in enumerate(machine.entries)}
    columns = ["key", "run", "state", "until"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, state, until, begun = None, machine.after, NEVER, False
        for batch in batches:
            out = []
            if batch.empty:
                continue
            at = {c: batch[c].to_numpy() for c in batch.columns}
            for (here,), lo, hi in _groups(batch, ["key"]):
                if not begun or here != key:
                    if begun:
                        out.append((key, None, state, until))
                    key, state, until, begun = here, machine.after, NEVER, True
                for i in range(lo, hi):
                    if at["given"][i]:
                        state, until = int(at["states"][i][0]), int(at["untils"][i][0])
                        continue
                    out.append((key, at["run"][i], state, until))
                    e = index[state]
                    if state == machine.timed and until != NEVER:
                        ended = int(np.searchsorted(at["by"][i], until))
                        if ended < len(at["by"][i]):
                            state, until = int(at["by_state"][i][ended]), int(at["by_until"][i][ended])
                            continue
                    state, after = int(at["states"][i][e]), int(at["untils"][i][e])
                    until = until if after == SAME else after
            yield pd.DataFrame(out, columns=columns).astype({"run": "Int64"})
        if begun:
            yield pd.DataFrame([(key, None, state, until)], columns=columns).astype({"run": "Int64"})

    return run


def _entries(machine: Machine):
    index = {e: i for i, e in enumerate(machine.entries)}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        state, until = machine.after, NEVER
        for batch in batches:
            if batch.empty:
                continue
            entry = np.empty(len(batch), dtype=np.int32)
            rows = zip(batch["tick"].tolist(), batch["exits"], batch["timers"], batch["opens"].tolist())
            for i, (tick, exits, timers, opens) in enumerate(rows):
                if opens:
                    state, until = int(exits[0]), int(timers[0])
                    continue
                if state == machine.timed and until <= tick:
                    state, until = machine.after, NEVER
                entry[i] = state
                e = index[state]
                timer, state = int(timers[e]), int(exits[e])
                if state != machine.timed:
                    until = NEVER
                elif timer != KEEP:
                    until = int(tick) + timer + machine.grace if timer > 0 else NEVER
            yield batch[_GROUP].assign(entry=entry)[~batch["opens"]]

    return run


def _replay(machine: Machine):
    step = machine.step

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        state = machine.after
        for batch in batches:
            ops, args, opens = batch["op"].to_numpy(), batch["arg"].to_numpy(), batch["opens"].to_numpy()
            verdicts = np.empty(len(batch), dtype=object)
            before = np.empty(len(batch), dtype=np.int32)
            for i in range(len(batch)):
                if opens[i]:
                    state = args[i]
                    continue
                before[i] = state
                state, verdicts[i], _ = step(state, ops[i], args[i])
            batch["state_before"], batch["verdict"] = before, verdicts
            yield batch[~opens]

    return run


def fold_commands(rows: DataFrame, machine: Machine, block_rows: int = BLOCK_ROWS, run_ticks: int = RUN_TICKS) -> DataFrame:
    """Rows ``(key, tick, seq, op, arg)`` with ``state_before`` and ``verdict``; ticks are in
    seconds, and rows of a tick are taken in ``seq`` order, those without one first."""
    blocked, maps = _tick_blocks(rows, machine, block_rows, run_ticks)
    return _replayed(blocked, maps, _chained(maps, machine), machine)


def fold_onward(
    rows: DataFrame, carried: DataFrame, machine: Machine, scratch: Scratch, block_rows: int = BLOCK_ROWS, run_ticks: int = RUN_TICKS
) -> tuple[DataFrame, DataFrame]:
    """The same from the states that earlier rows have left, and what is left now: ``(key, state, until)`` with the end of the timer, or ``NEVER``.

    This runs jobs: the rows of a micro-batch are read for the states and again for the verdicts. Both results read the scratch tables.
    """
    blocked, maps = _tick_blocks(rows, machine, block_rows, run_ticks)
    maps = scratch.keep(maps, "maps")
    chained = scratch.keep(_chained(maps, machine, carried), "chain")
    return _replayed(blocked, maps, chained, machine), chained.filter("run is null").select("key", "state", "until")


def _tick_blocks(rows: DataFrame, machine: Machine, block_rows: int, run_ticks: int) -> tuple[DataFrame, DataFrame]:
    # A missing number comes first in its tick; the row itself keeps its null.
    blocked = rows.withColumn("block", F.coalesce(F.expr(f"seq div {block_rows}"), F.lit(-(1 << 62))))
    maps = (
        blocked.repartition(*_GROUP)
        .sortWithinPartitions(*_GROUP, "seq")
        .mapInPandas(_tick_maps(machine), f"{_group_schema(rows)}, exits array<int>, timers array<bigint>")
    )
    return blocked, maps.withColumn("run", F.floor(F.col("tick") / run_ticks))


def _group_schema(rows: DataFrame) -> str:
    return f"key {rows.schema['key'].dataType.simpleString()}, tick bigint, block bigint"


def _chained(maps: DataFrame, machine: Machine, carried: DataFrame | None = None) -> DataFrame:
    key = f"key {maps.schema['key'].dataType.simpleString()}, run bigint"
    totals = (
        maps.repartition(*_RUN).sortWithinPartitions(*_RUN, "tick", "block").mapInPandas(_totals(machine), f"{key}, {_TOTAL}")
    ).withColumn("given", F.lit(False))
    if carried is not None:
        nothing = F.array().cast("array<bigint>")
        totals = totals.unionByName(
            carried.select(
                "key", F.lit(None).cast("bigint").alias("run"), F.array("state").alias("states"), F.array("until").alias("untils"),
                nothing.alias("by"), nothing.cast("array<int>").alias("by_state"), nothing.alias("by_until"), F.lit(True).alias("given"),
            )
        )
    ordered = totals.repartition("key").sortWithinPartitions("key", F.col("given").desc(), "run")
    return ordered.mapInPandas(_chain(machine), f"{key}, state int, until bigint")


def _replayed(blocked: DataFrame, maps: DataFrame, chained: DataFrame, machine: Machine) -> DataFrame:
    group = _group_schema(blocked)
    # What is known on entry travels as the first row of its run or group, so no join is needed.
    known = chained.filter("run is not null").select(
        "key", F.lit(None).cast("bigint").alias("tick"), F.lit(None).cast("bigint").alias("block"), "run",
        F.array("state").alias("exits"), F.array("until").alias("timers"), F.lit(True).alias("opens"),
    )
    entries = (
        known.unionByName(maps.withColumn("opens", F.lit(False)))
        .repartition(*_RUN)
        .sortWithinPartitions(*_RUN, F.col("opens").desc(), "tick", "block")
        .mapInPandas(_entries(machine), f"{group}, entry int")
    )
    openings = entries.select(
        *_GROUP,
        F.lit(None).cast("bigint").alias("seq"),
        F.lit(0).alias("op"),
        F.col("entry").cast("bigint").alias("arg"),
        F.lit(True).alias("opens"),
    )
    return (
        openings.unionByName(blocked.withColumn("opens", F.lit(False)))
        .repartition(*_GROUP)
        .sortWithinPartitions(*_GROUP, F.col("opens").desc(), F.col("seq").asc_nulls_first())
        .mapInPandas(
            _replay(machine), f"{group}, seq bigint, op int, arg bigint, opens boolean, state_before int, verdict string"
        )
        .drop("block", "opens")
    )
