"""Documents with everything that may go wrong: nulls, blanks, long texts, copies, columns with clashing names."""

from __future__ import annotations

import random

import pytest

from pyspark.sql import functions as F

#: Columns that the operators use inside; tables may have them too.
CLASHES = ("key", "id", "copies", "fp", "node", "row", "g", "size", "shard", "spans", "terms", "_key", "_node", "_own", "item", "hash", "words", "v", "score")


def prose(n: int, seed: int) -> str:
    r = random.Random(seed)
    return " ".join(r.choice("alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega".split()) + str(r.randrange(60)) for _ in range(n))


@pytest.fixture(scope="session")
def odd_texts():
    """(doc_id, text); 7 and 8 are copies, 9 a near copy of them, the last row repeats row 7."""
    base = prose(120, 1)
    return [
        (1, None), (2, ""), (3, " \t\n "), (4, "one"), (5, "ünïcode wörds … 日本語 text"), (6, prose(30_000, 2)),
        (7, base), (8, base), (9, base + " tail"), (10, "x" * 50_000), (None, "a row without an id"), (11, "Mail a.b@example.com now"), (7, base),
    ]


@pytest.fixture(scope="session")
def odd(spark, odd_texts):
    df = spark.createDataFrame(odd_texts, "doc_id long, text string").withColumns({"lang": F.lit(None).cast("string"), "source": F.lit("s"), "n_chars": F.length("text").cast("long")})
    return df.withColumns({c: F.lit("clash") for c in CLASHES})


@pytest.fixture(scope="session")
def none(odd):
    return odd.limit(0)
