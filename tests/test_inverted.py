"""Parts that are inverted where they are read: their words, their size, ids that come again, blocks that cannot matter."""

from __future__ import annotations

import random

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from folio.functions import plain
from folio.functions import text as T
from folio.operators import postings, search
from folio.operators.postings import Postings
from folio.plans.text import BM25


def test_words_are_those_of_normalize(spark, monkeypatch):
    r = random.Random(3)
    some = [*map(chr, range(1, 0x500)), *"ẞßæŒþÞøŁİKΣ́̈ͯＡ🄰𐐀漢"]
    texts = ["".join(f"b{c}" for c in some), *("".join(r.choices(some[:700] + list("ab ") * 300 + some[-18:] * 20, k=r.randrange(30))) for _ in range(500)), None, "", " ", "ß", "́", "x"]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id long, text string")
    want = [x.t or [] for x in rows.select("id", T.tokens(T.normalize(F.col("text"))).alias("t")).orderBy("id").collect()]
    for step in (1, 100, 500_000):
        monkeypatch.setattr(plain, "STEP", step)
        n, words = plain.words(pa.array(texts, pa.string()))
        ends = np.cumsum(n)
        assert [words.to_pylist()[b - k : b] for k, b in zip(n, ends)] == want
    wrong = pa.Array.from_buffers(pa.string(), 2, [None, pa.py_buffer(np.array([0, 4, 7], np.int32)), pa.py_buffer(b"a\xff\xc3b\xc3\xa9c")])
    assert (plain.words(wrong)[0].tolist(), plain.words(wrong)[1].to_pylist()) == ([2, 1], ["a", "b", "ec"])


def _sql(docs, asked):
    with duckdb.connect() as db:
        db.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR); CREATE TABLE benchmark (item_id BIGINT, text VARCHAR)")
        db.executemany("INSERT INTO documents VALUES (?, ?)", docs)
        db.executemany("INSERT INTO benchmark VALUES (?, ?)", asked)
        return sorted(db.execute(BM25).fetchall(), key=lambda x: (x[0] is None, x))


@pytest.mark.parametrize("part", [3, 100_000])
def test_ids_and_queries_that_come_again_are_scored_as_in_sql(spark, tmp_path, monkeypatch, part):
    monkeypatch.setattr(postings, "QUERIES", part)  # in several lots
    monkeypatch.setattr(postings, "WRITTEN", 10 * part)
    r = random.Random(5)
    words = [f"word{k}" for k in range(30)]
    docs = [(r.randrange(60), " ".join(r.choices(words, k=r.choice([4, 4, 7])))) for _ in range(100)] + [(70, None), (70, ""), (71, "word1 word1"), (71, "word1 word2"), (2, None)]
    asked = [(q % 9, " ".join(r.choices(words, k=3))) for q in range(12)] + [(None, "word1 word9"), (20, "word3"), (20, "word3 word4"), (21, None)]
    index = Postings(spark, str(tmp_path / "index")).build(spark.createDataFrame(docs, "id long, text string"), buckets=4, part=part, block=2)
    found = index.search(spark.createDataFrame(asked, "qid long, query string"), 10).select("qid", "id", "place", "score").collect()
    assert sorted(map(tuple, found), key=lambda x: (x[0] is None, x)) == _sql(docs, asked)


def test_rows_are_blocks_not_postings(spark, tmp_path):
    docs = spark.range(2000).select("id", F.concat_ws(" ", F.lit("every one of them"), F.concat(F.lit("w"), F.col("id") % 50)).alias("text")).coalesce(2)
    index = Postings(spark, str(tmp_path / "index")).build(docs, buckets=4)
    rows = index._read("postings", [0, 1, 2, 3])
    held = search.postings(docs).count()
    assert held == rows.agg(F.sum("n")).first()[0] == 10_000
    assert rows.count() < held / 20  # what is moved, sorted and written; one row a posting before


def test_blocks_that_cannot_matter_are_left_out(monkeypatch):
    """Two parts of one task; in the second, only documents of the rare term can reach what the first part has, so no list of the common one is added up."""
    docs = lambda n, own: pa.table({"id": pa.array(range(n, n + 40)), "text": [f"common rare{own}" if i < 5 else "common " + "filler " * 9 for i in range(40)]})
    batches = [b for k, own in ((0, ""), (1, "x")) for b in postings._inverted(docs(100 * k, own), k, 8, False)]
    rows = []
    for b in batches:
        for x in b.to_pylist():
            if x["term"] in (None, "common", "rare"):
                rows.append({**{c: x[c] for c in ("part", "term", "block", "n", "at", "tf", "ids", "lens")}, "lot": 0, "rarity": {"rare": 3.0}.get(x["term"], 0.01), "qids": None if x["term"] is None else [7]})
    kind = pa.schema([("lot", pa.int32()), ("part", pa.int64()), ("term", pa.string()), ("block", pa.int32()), ("n", pa.int32()), ("at", pa.binary()), ("tf", pa.binary()), ("ids", pa.list_(pa.int64())), ("lens", pa.list_(pa.int32())), ("rarity", pa.float64()), ("qids", pa.list_(pa.int64()))])
    batch = pa.RecordBatch.from_pylist(rows, kind)
    summed = []
    real = np.bincount
    monkeypatch.setattr(postings.np, "bincount", lambda x, *a: (summed.append(len(x)) if len(a) == 2 else None, real(x, *a))[1])
    found = pa.Table.from_batches(postings._scored(iter([batch.slice(0, 3), batch.slice(3)]), 5, 8.0))
    assert found.column("id").to_pylist() == [0, 1, 2, 3, 4]
    assert summed == [45]  # the first part only
