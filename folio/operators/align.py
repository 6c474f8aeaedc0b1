"""Aligning two numberings of one series.

Titles are compared by several keys each (``keys.title_keys``). A key that one unit of either side has alone is an anchor; anchors are taken in the order
of ours while they ascend in theirs. Between two anchors, and at the ends, stretches of equal length are filled by position and others are
left open. A season without anchors whose length both sides agree about keeps its own numbers. Parts of one episode that follow each other
are one unit where theirs has fewer titles with that beginning than we have parts.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folio.functions import keys as K

PART = r"(?i)[\s,:\-]*\(?(?:part|pt\.?)?\s*(?:[0-9]+|i{1,3}|iv|v)\)?\s*$"


def units(seasons: Sequence[int], bases: Sequence[str | None], titles: Sequence[str]) -> list[list[int]]:
    """Positions of ours that stand for one episode: each for itself, or a run of parts (``bases``: the title without its part; null if it has none)."""
    ordered, out, i = None, [], 0
    while i < len(seasons):
        j = i + 1
        while bases[i] and j < len(seasons) and seasons[j] == seasons[i] and bases[j] == bases[i]:
            j += 1
        if j - i > 1 and ordered is None:
            ordered = sorted(titles)
        if j - i > 1 and bisect_left(ordered, bases[i] + chr(0x10FFFF)) - bisect_left(ordered, bases[i]) < j - i:
            out.append(list(range(i, j)))
        else:
            out += [[k] for k in range(i, j)]
        i = j
    return out


def anchors(ours: Sequence[Sequence[str]], theirs: Sequence[Sequence[str]]) -> tuple[list[tuple[int, int]], set[int]]:
    """(unit, place) by keys that are unique on both sides, ascending; and the units that had such a key at all."""
    count, other = Counter(k for u in ours for k in u), Counter(k for t in theirs for k in t)
    place = {k: j for j, t in enumerate(theirs) for k in t if other[k] == 1}
    out, known, last = [], set(), -1
    for i, u in enumerate(ours):
        at = next((place[k] for k in u if count[k] == 1 and k in place), None)
        if at is None:
            continue
        known.add(i)
        if at > last:
            out.append((i, at))
            last = at
    return out, known


def aligned(ours: list[tuple], theirs: list[tuple]) -> list[tuple[int | None, int, int]]:
    """For each of ours, its place in theirs (or None), and which part of how many of it. Both are sorted rows (season, number, own, joint, base, fold)."""
    seasons = [x[0] for x in ours]
    group = units(seasons, [x[4] for x in ours], [y[5] for y in theirs])
    fixed, known = anchors([ours[u[0]][2 if len(u) == 1 else 3] for u in group], [y[2] for y in theirs])
    found: list[int | None] = [None] * len(group)
    for (i, j), (i2, j2) in zip([(-1, -1), *fixed], [*fixed, (len(group), len(theirs))], strict=True):
        if i2 - i == j2 - j:
            found[i + 1 : i2] = range(j + 1, j2)
        if i2 < len(group):
            found[i2] = j2
    at: list[int | None] = [None] * len(ours)
    for u, j in zip(group, found, strict=True):
        for k in u:
            at[k] = j
    anchored = {seasons[group[i][0]] for i in known}
    mine, other = dict(x[:2] for x in ours), dict(y[:2] for y in theirs)  # the last number of a season is its largest
    naive = {y[:2]: j for j, y in enumerate(theirs)}
    for k, x in enumerate(ours):
        if at[k] is None and x[0] not in anchored and mine[x[0]] == other.get(x[0]):
            at[k] = naive.get(x[:2])
    total, seen, out = Counter(j for j in at if j is not None), Counter(), []
    for j in at:
        seen[j] += 1
        out.append((j, seen[j], total[j]) if j is not None else (None, 1, 1))
    return out


def _prepared(rows: DataFrame, side: int) -> DataFrame:
    """(series, side, season, number, own, joint, base, fold): keys of the title; of ours also keys without its part and the folded title without it, if it has one; of theirs the folded title."""
    title: Column = F.coalesce("title", F.lit(""))
    whole = F.regexp_replace(title, PART, "")
    ours = lambda c: F.when(whole != title, c) if side == 0 else F.lit(None)
    fold = K.episode_title(title) if side else F.lit(None)
    return rows.select("series", F.lit(side).alias("side"), F.col("season").cast("int"), F.col("number").cast("int"), K.title_keys(title).alias("own"), ours(K.title_keys(whole)).cast("array<string>").alias("joint"), ours(K.episode_title(whole)).cast("string").alias("base"), fold.cast("string").alias("fold"))


def align(mine: DataFrame, theirs: DataFrame) -> DataFrame:
    """(series, season, number, other_season, other_number, part, parts) from two tables (series, season, number, title).

    Both sides meet in order of series; a task holds one series and one batch at a time. An episode that nothing places has nulls, and one of theirs that covers
    several of ours numbers them as parts.
    """
    kind = dict(mine.dtypes)["series"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sides: tuple[list[tuple], list[tuple]] = ([], [])
        now, out = None, []

        def close() -> None:
            ours, theirs = sides
            for o, (j, p, n) in zip(ours, aligned(ours, theirs), strict=True):
                out.append((now, *o[:2], *(theirs[j][:2] if j is not None else (None, None)), p, n))
            ours.clear()
            theirs.clear()

        def flush(b: pa.RecordBatch) -> pa.RecordBatch:
            columns = list(zip(*out, strict=True)) if out else [[]] * 7
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, [b.schema.field("series").type, *[pa.int32()] * 6], strict=True)], names=["series", "season", "number", "other_season", "other_number", "part", "parts"])

        b = None
        for b in batches:
            for series, side, season, number, own, joint, base, fold in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if series != now:
                    close()
                    now = series
                sides[side].append((season, number, own, own if joint is None else joint, base, fold))
            yield flush(b)
        if b is not None:
            close()
            yield flush(b)

    both = _prepared(mine, 0).unionByName(_prepared(theirs, 1)).repartition("series").sortWithinPartitions("series", "side", "season", "number")
    return both.mapInArrow(run, f"series {kind}, season int, number int, other_season int, other_number int, part int, parts int")
