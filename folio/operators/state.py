"""Rules that depend on what was taken before: each key is one ordered fold over its rows.

A key's rows are sorted by Spark and read in order, batch by batch, so that no key has to fit in memory. Null is a key like any
other; a row without a time belongs nowhere in the order and is left out.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _folded(rows: DataFrame, key: str, at: str, tie: str, step, columns: str, *names: str) -> DataFrame:
    """Rows with what ``step(first of its key, time)`` returns for each, in the order of key, time and tie."""
    types = dict(rows.dtypes)

    def run(batches):
        last = object()
        for b in batches:
            out = []
            for k, t in zip(b.column(key).to_pylist(), b.column(at).to_pylist(), strict=True):
                out.append(step(k != last, t))
                last = k
            found = [pa.array(x) for x in zip(*out, strict=True)] if out else [pa.nulls(0) for _ in names]
            yield pa.RecordBatch.from_arrays([b.column(key), b.column(tie), b.column(at), *found], names=[key, tie, at, *names])

    placed = rows.filter(F.col(at).isNotNull()).select(key, tie, at).repartition(key).sortWithinPartitions(key, at, tie)
    return placed.mapInArrow(run, f"{key} {types[key]}, {tie} {types[tie]}, {at} {types[at]}, {columns}")


class Anchored:
    """A window that opens at the first event after the last one ended."""

    def __init__(self, width: int, allowed: int):
        self.width, self.allowed, self.start, self.n = width, allowed, 0, 0

    def __call__(self, new: bool, t: int) -> tuple[int, bool]:
        if new or t >= self.start + self.width:
            self.start, self.n = t, 0
        self.n += 1
        return self.start, self.n <= self.allowed


class Gap:
    """Takes an event if it is far enough from the last one taken."""

    def __init__(self, gap: int):
        self.gap, self.last = gap, 0

    def __call__(self, new: bool, t: int) -> tuple[bool]:
        taken = new or t >= self.last + self.gap
        if taken:
            self.last = t
        return (taken,)


def anchored_windows(rows: DataFrame, key: str, at: str, tie: str, width: int, allowed: int) -> DataFrame:
    """(key, tie, start, allowed): the window of each event, and whether it is among the first ``allowed`` of it."""
    return _folded(rows, key, at, tie, Anchored(width, allowed), "start long, allowed boolean", "start", "allowed").select(key, tie, "start", "allowed")


def min_gap(rows: DataFrame, key: str, at: str, tie: str, gap: int) -> DataFrame:
    """(key, tie, at): the first event of each key and every later one at least ``gap`` after the one taken before."""
    return _folded(rows, key, at, tie, Gap(gap), "taken boolean", "taken").filter(F.col("taken")).select(key, tie, at)


def bounded_totals(rows: DataFrame, key: str, at: str, tie: str, session: str, amount: str, most: int) -> DataFrame:
    """(key, session, total, started, last, evicted): the sessions that each key still tracks at its end, and how many it let go.

    A key tracks ``most`` sessions; a further one takes the place of the one that was charged longest ago (of equals the first that came), whose total is lost.
    """
    kinds = dict(rows.dtypes)
    columns = [key, session, "total", "started", "last", "evicted"]

    def run(batches):
        now, tracked, evicted = object(), {}, 0  # session -> [total, started, last], in the order in which they came

        def out() -> pa.RecordBatch:
            found = [(now, s, *x, evicted) for s, x in tracked.items()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found, strict=True), types, strict=True)], names=columns)

        types = None
        for b in batches:
            types = [b.column(key).type, b.column(session).type, pa.int64(), b.column(at).type, b.column(at).type, pa.int64()]
            for k, t, s, n in zip(*(b.column(c).to_pylist() for c in (key, at, session, amount)), strict=True):
                if k != now:
                    if tracked:
                        yield out()
                    now, tracked, evicted = k, {}, 0
                found = tracked.get(s)
                if found is None:
                    if len(tracked) >= most:
                        del tracked[min(tracked, key=lambda x: tracked[x][2])]
                        evicted += 1
                    found = tracked[s] = [0, t, t]
                found[0] += n or 0
                found[2] = t
        if tracked:
            yield out()

    placed = rows.filter(F.col(at).isNotNull()).select(key, at, tie, session, amount).repartition(key).sortWithinPartitions(key, at, tie)
    return placed.mapInArrow(run, f"{key} {kinds[key]}, {session} {kinds[session]}, total long, started {kinds[at]}, last {kinds[at]}, evicted long")
