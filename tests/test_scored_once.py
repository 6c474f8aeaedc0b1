"""Texts that are scored are normalised once a row, not once for each of their trigrams."""

from pyspark.sql import functions as F

from folio.operators import search
from folio.plans import text


def _normalised(df):
    return df._jdf.queryExecution().optimizedPlan().toString().count("regexp_replace(")


def test_scored_normalises_once_a_row(spark):
    rows = spark.createDataFrame([(1, 7, "red widget", "Red Widget", 60_000), (1, 8, "red widget", "red widgets", 60_000), (2, 9, "anvil", None, 3)], "qid int, id int, query string, title string, votes long")
    found = search.scored(rows)
    # Query and title, over all rows and over those of many votes.
    assert _normalised(found) == 4
    assert {(r.qid, r.id): (r.score, r.coverage) for r in found.collect()}[1, 7][1] == 1.0
    assert found.count() == 3


def test_similarity_normalises_once_a_row(spark, sf_dir):
    # Twice in the columns; filters that Spark derives from the two explodes repeat them below.
    assert _normalised(text.trigram_similarity(spark, sf_dir)) <= 6


def test_ladder_makes_its_titles_once(spark):
    """The tiers work on one saved table of titles, so what made the titles is not done again for each of them."""
    made = spark.sparkContext.accumulator(0)
    votes = F.udf(lambda v: (made.add(1), v)[1], "long")
    rows = spark.createDataFrame([(1, "red widget", 40), (2, "hot gear", 50), (3, "the plate", 60)], "id int, title string, votes long")
    asked = spark.createDataFrame([(1, "red widget"), (2, '"hot gear"'), (4, "the")], "qid int, query string")
    found = search.ladder(rows.withColumn("votes", votes("votes")), asked, 5, 30, 20)
    assert {(r.qid, r.id) for r in found.collect()} == {(1, 1), (2, 2), (4, 3)}
    assert made.value == 3
