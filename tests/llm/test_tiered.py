"""Ranked search: every tier against a brute-force scorer, ties, copies, odd rows."""

from __future__ import annotations

import math
import random
import re
from collections import Counter

import pytest

from folio.llm import tiered

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall((text or "").translate({c: c + 32 for c in range(65, 91)}))


def brute(docs, items, k=20):
    bags = [(i, Counter(terms(t))) for i, t in docs]
    full = [b for _, b in bags if b]
    n_docs, occurrences = len(full), sum(sum(b.values()) for b in full)
    df = Counter(t for b in full for t in b)
    weight = {t: math.floor(1000 * math.log((2 * n_docs + 2) / (2 * d + 1))) for t, d in df.items()}
    out = []
    for item, text in items:
        scored = []
        for doc, b in bags:
            m = 75 + 25 * sum(b.values()) * n_docs // max(1, occurrences)
            score = sum(weight[t] * (10**9 * b[t] // (1000 * b[t] + 12 * m)) for t in terms(text) if t in b)
            if score > 0:
                scored.append((-score, doc is None, doc or 0, doc))
        out += [(item, r, x[3], -x[0]) for r, x in enumerate(sorted(scored, key=lambda x: x[:3])[:k], 1)]
    return sorted(out, key=repr)


def texts(n, seed, size=40):
    r = random.Random(seed)
    words = [f"w{i}" for i in range(300)]
    return [" ".join(r.choices(words, [1 / (1 + i) for i in range(300)], k=r.randrange(size))) for _ in range(n)]


def ranked(spark, docs, items, **more):
    d, i = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    return tiered.rank(d, i, **more)


@pytest.mark.parametrize("tiers", [(10_000, 20_000), (5, 40), (0, 0), (30, 60)])
def test_every_tier_is_exact(spark, tiers):
    docs = list(enumerate(texts(400, 1)))
    items = list(enumerate(texts(25, 2, 12)))
    rows = ranked(spark, docs, items, tiers=tiers).collect()
    assert sorted([tuple(r[:4]) for r in rows], key=repr) == brute(docs, items)
    reached = {r.tier for r in rows}
    assert reached == {1} if tiers[0] >= 10_000 else reached == {3} if not tiers[0] else max(reached) > 1


def test_copies_and_ties_are_ranked_by_id(spark):
    docs = [(i, "alpha beta") for i in range(60)] + [(None, "alpha beta"), (3, "alpha beta"), (100, "gamma"), (101, None), (102, "")]
    items = [(1, "alpha"), (2, "ALPHA beta alpha"), (2, "gamma"), (3, None), (4, "nothing here"), (5, " ,;")]
    got = sorted([tuple(r[:4]) for r in ranked(spark, docs, items, tiers=(2, 10)).collect()], key=repr)
    assert got == brute(docs, items)


def test_items_in_groups_of_terms(spark):
    docs, items = list(enumerate(texts(120, 3))), list(enumerate(texts(30, 4, 10)))
    got = ranked(spark, docs, items, vocabulary=20).collect()
    assert sorted([tuple(r[:4]) for r in got], key=repr) == brute(docs, items)


def test_odd_rows(spark, odd, odd_texts, none):
    items = [(1, "alpha0 beta1 a row without an id"), (2, "日本語 wörds"), (3, "x" * 50_000)]
    items_df = spark.createDataFrame(items, "item_id long, text string")
    got = tiered.rank(odd, items_df).collect()
    assert sorted([tuple(r[:4]) for r in got], key=repr) == brute(odd_texts, items)
    assert tiered.rank(none, items_df).count() == 0
    assert tiered.rank(odd, items_df.limit(0)).count() == 0


def test_a_tier_never_takes_part_of_equal_impacts(spark):
    found = spark.createDataFrame([(0, r, 500_000) for r in range(50)] + [(0, 99, 900_000)], "t int, row long, impact long")
    row = tiered.bounds(found, 60, (10, 100)).first()
    assert (row.rest_1, row.rest_2) == (500_000 * row.w, 0)
    assert row.floor_1 > row.floor_2
