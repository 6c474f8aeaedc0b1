"""The scorer's arms that the given tables don't reach."""

from __future__ import annotations

import math

from folio.operators import search


def test_an_exact_match_that_looks_like_a_typo_of_something_popular(spark):
    """A title that is the query, but unknown, gives way to a popular one a letter away; without the popular one it keeps its bonus."""
    rows = [(1, 1, "grey harbours", "Grey Harbours", 12), (1, 2, "grey harbours", "Grey Harbour", 60_000), (2, 1, "grey harbours", "Grey Harbours", 12), (2, 2, "grey harbours", "Grey Harbour", 40_000)]
    got = {(r.qid, r.id): r.score for r in search.scored(spark.createDataFrame(rows, "qid long, id long, query string, title string, votes long")).collect()}
    known = 2.4 * math.log(22)
    assert abs(got[1, 1] - (22 + 14 * math.log(22) / math.log(50_000) + known)) < 0.001
    assert abs(got[2, 1] - (22 + 12 + known)) < 0.001
    assert got[1, 2] > got[1, 1] and got[1, 2] > got[2, 2]


def test_an_exact_match_earns_more_with_votes(spark):
    rows = [(1, k, "quarry", "Quarry", v) for k, v in enumerate((1, 5_000, 50_000, 400_000, 900_000))]
    got = {r.id: r.score for r in search.scored(spark.createDataFrame(rows, "qid long, id long, query string, title string, votes long")).collect()}
    part = lambda v: 22 + max(12.0, 14 * min(1.0, math.log(v + 10) / math.log(50_000))) + 2.4 * math.log(min(v, 300_000) + 10)
    assert all(abs(got[k] - part(v)) < 0.001 for k, v in enumerate((1, 5_000, 50_000, 400_000, 900_000)))
    assert got[3] == got[4]
