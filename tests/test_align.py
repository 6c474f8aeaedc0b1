"""Alignment of two numberings: anchors, stretches, seasons, parts."""

from __future__ import annotations

import time

from folio.operators import align


def run(spark, ours, theirs):
    """ours, theirs: (season, number, title); {(season, number): (season, number, part, parts) or None}."""
    make = lambda rows: spark.createDataFrame([(1, *r) for r in rows], "series long, season int, number int, title string")
    got = align.align(make(ours), make(theirs)).collect()
    return {(r.season, r.number): (r.other_season, r.other_number, r.part, r.parts) if r.other_season is not None else None for r in got}


def season(s, *titles, first=1):
    return [(s, k, t) for k, t in enumerate(titles, first)]


def test_a_shifted_numbering_is_followed(spark):
    ours = season(1, "Harbour", "Lantern", "Orchard") + season(2, "Quarry", "Saddle")
    theirs = season(0, "Special") + season(1, "Harbour", "Lantern") + season(2, "Orchard", "Quarry", "Saddle")
    assert run(spark, ours, theirs) == {(1, 1): (1, 1, 1, 1), (1, 2): (1, 2, 1, 1), (1, 3): (2, 1, 1, 1), (2, 1): (2, 2, 1, 1), (2, 2): (2, 3, 1, 1)}


def test_stretches_between_anchors(spark):
    ours = season(1, "Harbour", "one name", "another", "Orchard", "x", "y", "Quarry")
    theirs = season(1, "Harbour", "uno", "dos", "Orchard", "z", "Quarry")
    got = run(spark, ours, theirs)
    assert [got[1, k] and got[1, k][1] for k in range(1, 8)] == [1, 2, 3, 4, None, None, 6]  # unequal: nothing says which is which


def test_anchors_are_taken_in_order(spark):
    """The first that ascends is taken; one that lies before it is not."""
    got = run(spark, season(1, "Orchard", "Harbour", "Lantern"), season(1, "Harbour", "Lantern", "Orchard"))
    assert got == {(1, 1): (1, 3, 1, 1), (1, 2): None, (1, 3): None}


def test_a_season_without_evidence_keeps_its_numbers(spark):
    ours = season(1, "12 March: A. Guest", "19 March: B. Guest") + season(2, "Harbour", "Lantern") + season(3, "p", "q", "r")
    theirs = season(1, "Guest A", "Guest B", first=1) + season(2, "Harbour", "inserted", "Lantern") + season(3, "s", "t")
    got = run(spark, ours, theirs)
    assert got[1, 1] == (1, 1, 1, 1) and got[1, 2] == (1, 2, 1, 1) and got[2, 2] == (2, 3, 1, 1)
    assert got[3, 1] is None and got[3, 3] is None  # the two sides state other lengths


def test_parts_of_one_episode_share_it(spark):
    got = run(spark, season(1, "Harbour", "The Storm (1)", "The Storm (2)", "Lantern"), season(1, "Harbour", "The Storm", "Lantern"))
    assert got == {(1, 1): (1, 1, 1, 1), (1, 2): (1, 2, 1, 2), (1, 3): (1, 2, 2, 2), (1, 4): (1, 3, 1, 1)}
    two = run(spark, season(1, "Harbour", "The Storm (1)", "The Storm (2)", "Lantern"), season(1, "Harbour", "The Storm", "The Storm: Part Two", "Lantern"))
    assert two == {(1, k): (1, k, 1, 1) for k in range(1, 5)}  # spelt otherwise, but as many


def test_sides_without_rows_and_nulls(spark):
    assert run(spark, season(1, "a"), []) == {(1, 1): None} and run(spark, [], season(1, "a")) == {}
    assert run(spark, season(1, None, None), season(1, None, None)) == {(1, 1): (1, 1, 1, 1), (1, 2): (1, 2, 1, 1)}


def test_a_very_long_series_takes_seconds(spark):
    name = lambda k: "".join(chr(97 + int(c)) for c in str(k)) + " story"
    ours = [(k // 250 + 1, k % 250 + 1, name(k)) for k in range(60_000)]
    theirs = [(k // 300 + 1, k % 300 + 1, name(k)) for k in range(60_000) if k % 1000]
    began = time.time()
    got = run(spark, ours, theirs)
    assert sum(x is not None for x in got.values()) == 60_000 - 60 and time.time() - began < 60
