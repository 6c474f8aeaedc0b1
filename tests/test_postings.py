"""The written index against BM25 over all postings; what a search reads of it."""

from __future__ import annotations

import random

from folio.operators import search
from folio.operators.postings import Postings


def _rows(df):
    return sorted((r.qid, r.place, r.score) for r in df.collect())


def test_the_index_finds_what_all_postings_give(spark, tmp_path):
    r = random.Random(2)
    words = [f"word{k}" for k in range(200)]
    docs = spark.createDataFrame([(i, " ".join(r.choices(words, [1 / (1 + k) for k in range(200)], k=r.randrange(1, 60)))) for i in range(600)] + [(900, None), (901, "")], "id long, text string")
    asked = spark.createDataFrame([(q, " ".join(r.choices(words, k=r.randrange(1, 6)))) for q in range(20)] + [(50, "nothing of it"), (51, None)], "qid long, query string")
    index = Postings(spark, str(tmp_path / "index")).build(docs, buckets=16, part=50, block=8)
    assert _rows(index.search(asked, 5)) == _rows(search.bm25(docs, asked, 5))
    parts = spark.read.parquet(str(tmp_path / "index/postings"))
    assert parts.groupBy("term", "part").count().agg({"count": "max"}).first()[0] <= 80  # common terms are dealt out
    assert parts.filter("term = 'word0'").select("part").distinct().count() > 1
    assert Postings(spark, str(tmp_path / "empty")).build(docs.limit(0)).search(asked, 5).count() == 0


def test_a_search_reads_the_buckets_of_its_terms(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"term{i} common") for i in range(500)], "id long, text string")
    index = Postings(spark, str(tmp_path / "index")).build(docs, buckets=32)
    one = spark.createDataFrame([(1, "term7")], "qid long, query string")
    found = index.search(one, 3)
    assert [(r.id, r.place) for r in found.collect()] == [(7, 1)]
    files = {f.split("bucket=")[1].split("/")[0] for f in index._read("postings", [3]).inputFiles()}
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "bucket" in plan.split("PartitionFilters: [")[1][:60] and files
