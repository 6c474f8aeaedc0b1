"""Queries that judge their whole tables."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from folio import plans, session
from folio.operators import rank
from folio.sources import files


def _write(spark, path, rows, schema):
    spark.createDataFrame(rows, schema).write.parquet(str(path))


def test_every_source_is_judged_by_all_its_documents(spark, tmp_path):
    rows = [(1, "a", "en", 2000), (2, "a", "en", 5), (3, "a", "fr", 2000), (4, "b", "en", 2000), (5, "b", "fr", 2000), (6, "b", "fr", 5), (7, None, None, 2000)]
    _write(spark, tmp_path / "documents.parquet", rows, "doc_id long, source string, lang string, n_chars long")
    got = plans.queries()["ranked_non_english"](spark, str(tmp_path)).collect()
    assert {(r.lang, r.n, r.outside) for r in got} == {("en", 0, 1), ("fr", 2, 1), ("", 1, 1)}


def test_every_line_is_in_the_crosswalk(spark, tmp_path):
    rows = [(1, 10, 100), (1, 10, 100), (1, 20, 200), (1, 30, 200), (2, 20, 300), (2, 40, 400)]  # no line is left out by its quantity or discount
    _write(spark, tmp_path / "lineitem.parquet", [(*r, 1.0, 0.0) for r in rows], "l_suppkey long, l_orderkey long, l_partkey long, l_quantity double, l_discount double")
    got = plans.queries()["crosswalk_one_to_one"](spark, str(tmp_path)).collect()
    assert {(r.l_suppkey, r.l_orderkey, r.l_partkey, r.everywhere) for r in got} == {(1, 10, 100, True), (2, 20, 300, False), (2, 40, 400, True)} and len(got) == 3


def test_large_tables_are_dealt_in_bounded_parts(spark):
    rows = spark.range(1000).selectExpr("id % 100 AS k")
    sizes = [len(p) for p in session.dealt(rows, 1000, "k", each=50).rdd.glom().collect()]
    assert len(sizes) == 20 and sum(sizes) == 1000 and session.dealt(rows, 1000, "k") is rows


def test_pieces_of_an_array_are_cut_into_runs(spark, tmp_path, monkeypatch):
    """Windows over an array see runs of few pieces, parts hold few of them, and elements come in the order of the file."""
    monkeypatch.setattr(files, "RANGE_BITS", 3)
    monkeypatch.setattr(files, "PIECES", 40)
    want = [(k, "a, ] \" [ \\" * (k % 4)) for k in range(300)]
    (tmp_path / "a.json").write_text(json.dumps([{"id": k, "t": t} for k, t in want]))
    got = files.json_array(spark, str(tmp_path / "a.json"), "id int, t string")
    assert [tuple(r) for r in got.collect()] == want
    assert got.rdd.getNumPartitions() > 10


def test_medians_of_large_groups_are_exact(spark):
    rows = spark.range(60_000).selectExpr("id % 2 AS k", "CASE WHEN id % 7 = 0 THEN 0.5 ELSE hash(id) / 1e6 END AS v").unionByName(spark.createDataFrame([(5, 1.0), (5, 4.0), (6, 3.0)], "k long, v double"))
    want = {r.k: (r.n, r.m) for r in rows.groupBy("k").agg(F.count("*").alias("n"), F.median("v").alias("m")).collect()}
    got = rank.medians(rows, ["k"], [F.col("v")], accuracy=100)
    assert {r.k: (r._n, r._m0) for r in got.collect()} == want
