"""The walk between two people: stopped and resumed, strengths, ends without anything."""

from __future__ import annotations

import random

from folio.operators import graph


def test_a_walk_that_stops_finds_what_one_run_finds(spark):
    r = random.Random(6)
    credits = [(t, p) for t in range(120) for p in r.sample(range(40), r.randrange(1, 7))]
    weight = {t: r.randrange(1000) for t in range(120)}
    walk = graph.Connections(spark.createDataFrame(credits, "title_id long, person_id long"), spark.createDataFrame(list(weight.items()), "id long, weight long"), 1, 2)
    whole, end = walk.go(10_000)
    assert end is None
    pieces, cursor, calls = [], 0, 0
    while cursor is not None:
        found, cursor = walk.go(13, cursor)
        pieces += [tuple(x) for x in found.collect()]
        calls += 1
    of = {p: {t for t, q in credits if q == p} for p in range(40)}
    cast = {t: {p for u, p in credits if u == t} for t in weight}
    want = [(t, None, None, 1, weight[t]) for t in of[1] & of[2]]
    want += [(t, p, u, 2, max(weight[x] for x in of[p])) for t in of[1] for p in cast[t] - {1, 2} for u in of[p] & of[2] if u != t]
    assert sorted(map(tuple, whole.collect()), key=repr) == sorted(pieces, key=repr) == sorted(want, key=repr)
    assert calls > 2 and any(x[3] == 1 for x in want)


def test_people_that_nothing_connects(spark):
    credits, titles = spark.createDataFrame([(1, 1), (2, 2)], "title_id long, person_id long"), spark.createDataFrame([(1, 5), (2, 5)], "id long, weight long")
    found, cursor = graph.Connections(credits, titles, 1, 2).go(5)
    assert found.count() == 0 and cursor is None
    found, cursor = graph.Connections(credits, titles, 1, 99).go(5)
    assert found.count() == 0 and cursor is None
