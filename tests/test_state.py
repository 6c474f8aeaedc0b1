"""Folds over ordered rows against plain loops; null is a key like any other."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from folio.functions import text as T
from folio.operators import state


def test_null_keys_have_windows_and_gaps(spark):
    rows = [(None, 1, 0), (None, 2, 5), (None, 3, 8), (7, 4, 0), (7, 5, 3), (2**60 + 1, 6, 1), (2**60, 7, 1), (None, 8, None)]
    df = spark.createDataFrame(rows, "k long, id long, at long")
    got = {r.id: (r.start, r.allowed) for r in state.anchored_windows(df, "k", "at", "id", 100, 1).collect()}
    assert got == {1: (0, True), 2: (0, False), 3: (0, False), 4: (0, True), 5: (0, False), 6: (1, True), 7: (1, True)}
    assert {r.id for r in state.min_gap(df, "k", "at", "id", 6).collect()} == {1, 3, 4, 6, 7}


def test_bounded_totals_equal_a_replay(spark):
    r = random.Random(1)
    rows = [(r.choice([None, "a", "b"]), r.randrange(500), i, r.choice([None, *range(12)]), r.randrange(1, 9)) for i in range(1500)]
    want = set()
    for k in (None, "a", "b"):
        tracked, evicted = {}, 0
        for _, at, _, s, n in sorted((x for x in rows if x[0] == k), key=lambda x: (x[1], x[2])):
            if s not in tracked:
                if len(tracked) == 5:
                    oldest = min(v[2] for v in tracked.values())
                    tracked.pop(next(x for x, v in tracked.items() if v[2] == oldest))
                    evicted += 1
                tracked[s] = [0, at, at]
            tracked[s] = [tracked[s][0] + n, tracked[s][1], at]
        want |= {(k, s, *v, evicted) for s, v in tracked.items()}
    got = state.bounded_totals(spark.createDataFrame(rows, "k string, at long, id long, s long, n long"), "k", "at", "id", "s", "n", 5)
    assert {tuple(x) for x in got.collect()} == want and len(want) == 15


def test_ids_in_a_text(spark):
    texts = ["see tt0111161, nm0000151 and (tt0111161)", "xtt1 tt2x tt nm3_ tt4-nm5", None, ""]
    got = [r.ids for r in spark.createDataFrame([(t,) for t in texts], "t string").select(T.ids_in(F.col("t")).alias("ids")).collect()]
    assert got == [["tt0111161", "nm0000151"], ["nm3", "tt4", "nm5"], [], []]
