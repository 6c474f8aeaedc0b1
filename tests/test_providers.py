"""Two providers and more: shapes, order, overlay, precedence, versions."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from folio.operators.providers import Facet, Provider, Registry


def fixed(spark, answers):
    rows = spark.createDataFrame([(i, x if isinstance(x, str) or x is None else json.dumps(x)) for i, x in answers.items()], "id long, data string")
    return lambda entities: entities.select("id").join(rows, "id")


@pytest.fixture
def registry(spark):
    size = lambda d: F.json_array_length(d)
    r = Registry(Facet("ratings", "list"), Facet("details", "object"), Facet("artwork", "single"), Facet("cast", "list", size))
    every = frozenset(("movie", "tv"))
    r.add(Provider("ratings", "b", 1, every, fixed(spark, {1: [{"r": 2}], 2: "not json", 3: [{"r": "x]"}, {"r": 9}]})))
    r.add(Provider("ratings", "a", 1, frozenset(("movie",)), fixed(spark, {1: [{"r": 1}], 2: [], 3: [{"r": 0}]})))
    r.add(Provider("ratings", "c", 1, every, fixed(spark, {1: [1, 2], 2: {"r": 3}})))
    r.add(Provider("details", "a", 1, every, fixed(spark, {1: {"t": "old", "n": 5, "deep": {"x": [1]}}, 2: {"only": None}})))
    r.add(Provider("details", "b", 1, every, fixed(spark, {1: {"t": "neu \"ü\"", "f": 1.5, "ok": True}, 2: [1]})))
    r.add(Provider("artwork", "z", 1, every, fixed(spark, {1: {"p": "z"}, 2: {"p": "z"}})))
    r.add(Provider("artwork", "m", 1, every, fixed(spark, {1: {"p": "m"}})))
    r.add(Provider("cast", "a", 1, every, fixed(spark, {1: [{"n": 1}], 2: [], 3: [{"n": 1}]})))
    r.add(Provider("cast", "b", 1, every, fixed(spark, {1: [{"n": 2}, {"n": 3}], 3: [{"n": 2}]})))
    r.add(Provider("cast", "c", 1, every, fixed(spark, {1: [{"n": 4}, {"n": 5}]})))
    return r


@pytest.fixture
def entities(spark):
    return spark.createDataFrame([(1, "movie"), (2, "movie"), (3, "tv"), (4, "tv")], "id long, kind string")


def test_answers_become_one_value(registry, entities):
    got = {(r.facet, r.id): (r.plugins, json.loads(r.data)) for r in registry.merged(registry.contributions(entities)).collect()}
    assert got == {
        ("ratings", 1): (["a", "b"], [{"r": 1}, {"r": 2}]), ("ratings", 2): (["a"], []), ("ratings", 3): (["b"], [{"r": "x]"}, {"r": 9}]),  # a knows movies only
        ("details", 1): (["a", "b"], {"t": 'neu "ü"', "n": 5, "deep": {"x": [1]}, "f": 1.5, "ok": True}), ("details", 2): (["a"], {"only": None}),
        ("artwork", 1): (["m"], {"p": "m"}), ("artwork", 2): (["z"], {"p": "z"}),
        ("cast", 1): (["b", "c"], [{"n": 2}, {"n": 3}, {"n": 4}, {"n": 5}]), ("cast", 2): (["a"], []), ("cast", 3): (["a", "b"], [{"n": 1}, {"n": 2}]),  # ties stay
    }


def test_outcomes(registry, entities):
    got = {(r.facet, r.plugin, r.id): r.outcome for r in registry.contributions(entities).collect()}
    assert got["ratings", "b", 2] == got["ratings", "c", 1] == got["ratings", "c", 2] == got["details", "b", 2] == "invalid-shape"
    assert got["ratings", "b", 4] == "empty" and got["ratings", "a", 1] == "ok" and ("ratings", "a", 3) not in got


def test_the_highest_version_answers(spark, registry, entities):
    registry.add(Provider("artwork", "m", 3, frozenset(("movie",)), fixed(spark, {1: {"p": "third"}})))
    registry.add(Provider("artwork", "m", 2, frozenset(("movie",)), fixed(spark, {1: {"p": "second"}})))
    got = {(r.id): json.loads(r.data) for r in registry.merged(registry.contributions(entities)).filter("facet = 'artwork'").collect()}
    assert got == {1: {"p": "third"}, 2: {"p": "z"}}
    with pytest.raises(ValueError, match="no facet"):
        registry.add(Provider("nothing", "m", 1, frozenset(), lambda e: e))
    assert Registry(Facet("x", "single")).merged(Registry(Facet("x", "single")).contributions(entities)).count() == 0
