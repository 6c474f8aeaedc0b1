"""Scans over generated files and sinks over generated tables: what is dropped, what is an error, what stays."""

from __future__ import annotations

import gzip
import json

import pytest
from pyspark.sql import functions as F

from folio.functions import queries as Q
from folio.operators import order, search
from folio.sources import files, tables


def test_tsv_header_nulls_and_last_line(spark, tmp_path):
    path = tmp_path / "t.tsv.gz"
    with gzip.open(path, "wt") as f:
        f.write('id\ttitle\n\n1\t"a\n2\t\\N\n3\t')
    assert [tuple(r) for r in files.tsv(spark, str(path), ["id", "title"]).orderBy("id").collect()] == [("1", '"a'), ("2", None), ("3", None)]
    with pytest.raises(files.SchemaDrift):
        files.tsv(spark, str(path), ["id", "name"])
    cut = tmp_path / "cut.tsv.gz"
    with gzip.open(path, "wt") as f:
        f.write("id\ttitle\n" + "".join(f"{k}\t{k * k}\n" for k in range(20_000)))
    cut.write_bytes(path.read_bytes()[:-2000])
    with pytest.raises(Exception):  # noqa: B017  a broken stream is no short file
        files.tsv(spark, str(cut), ["id", "title"]).count()


def test_numbers_begin_a_text(spark):
    got = spark.createDataFrame([("12abc",), (" -7",), ("x1",), ("",), (None,), ("99999999999",)], "v string").select(files.int_or_null(F.col("v")).alias("i")).collect()
    assert [r.i for r in got] == [12, -7, None, None, None, None]


def test_csv_lines_and_records(spark, tmp_path):
    (tmp_path / "a.csv").write_text("tt1,x\ntt2\nnm3,y\ntt4,z,w\ntt5,\n")
    assert [tuple(r) for r in files.csv_lines(spark, str(tmp_path / "a.csv"), ["id", "v"], {"id": r"^tt[0-9]+$"}).collect()] == [("tt1", "x"), ("tt5", "")]
    (tmp_path / "b.csv").write_text('1,"a, ""b"""\n2,"open\n3,c\n')
    got = {tuple(r) for r in files.csv_records(spark, str(tmp_path / "b.csv"), "id int, v string").collect()}
    assert (1, 'a, "b"') in got and (3, "c") in got


def test_json_arrays_are_whole_or_an_error(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps([{"id": 1, "t": "] [ \\\" {"}, {"id": 2, "t": None}]))
    assert [tuple(r) for r in files.json_array(spark, str(tmp_path / "a.json"), "id int, t string").collect()] == [(1, "] [ \\\" {"), (2, None)]
    (tmp_path / "b.json").write_text('[{"id": 1}, {"id": ')
    with pytest.raises(Exception):  # noqa: B017
        files.json_array(spark, str(tmp_path / "b.json"), "id int").collect()
    (tmp_path / "s.json").write_text(json.dumps({"results": {"bindings": [{"a": {"type": "uri", "value": "x"}}, {"a": {"type": "uri", "value": "y"}, "b": {"type": "literal", "value": "1"}}]}}))
    assert sorted(tuple(r) for r in files.sparql(spark, str(tmp_path / "s.json"), ["a", "b"]).collect()) == [("x", None), ("y", "1")]


def test_only_changed_files_are_read_again(spark, tmp_path):
    for k in "ab":
        (tmp_path / f"{k}.txt").write_text(k)
    known = files.fingerprints(spark, str(tmp_path))
    rows = spark.createDataFrame(known.collect(), known.schema)
    assert files.changed(files.fingerprints(spark, str(tmp_path)), rows).count() == 0
    (tmp_path / "b.txt").write_text("longer")
    assert [r.path[-5:] for r in files.changed(files.fingerprints(spark, str(tmp_path)), rows).collect()] == ["b.txt"]


def test_versions(spark, tmp_path):
    versions = tables.Versions(spark, f"file://{tmp_path}/v")
    with pytest.raises(ValueError, match="finished"):
        versions.promote("one")
    for n in (1, 2):
        versions.write(spark.range(n), f"b{n}")
        versions.promote(f"b{n}")
    assert versions.read().count() == 2
    versions.rollback()
    assert versions.read().count() == 1


def test_running_is_the_plain_running_sum(spark):
    rows = [(v % 17 if v % 3 else 4, v) for v in range(500)] + [(None, 1)]
    got = {(r.v, r.t): r.s for r in order.running(spark.createDataFrame(rows, "v int, t int"), "v", F.col("t"), "s", "t", buckets=8).collect()}
    total = 0
    for v, t in sorted(r for r in rows if r[0] is not None):
        total += t
        assert got[v, t] == total
    assert len(got) == 500


PARSED = [
    ("the matrix 1999", ("the matrix", 1999, None, None, None, None, False)), ('"the office" s02e05 1080p', ("the office", None, None, "tvSeries", 2, 5, True)), ("2012", ("2012", None, None, None, None, None, False)),
    ("1990s horror movies", ("horror", None, 1990, "movie", None, None, False)), ("blade runner 2049 (2017)", ("blade runner 2049", 2017, None, None, None, None, False)), ('"unclosed', ('"unclosed', None, None, None, None, None, False)),
    ("WEB-DL x265 dune", ("dune", None, None, None, None, None, False)), ("tv shows", ("tv shows", None, None, "tvSeries", None, None, False)), ('"2012" 2009', ("2012", 2009, None, None, None, None, True)), (None, (None, None, None, None, None, None, False)),
]


def test_queries_are_parsed(spark):
    rows = spark.createDataFrame([(k, q) for k, (q, _) in enumerate(PARSED)], "k int, q string")
    got = {r.k: tuple(r)[1:] for r in Q.parse(rows, "q", 2024).select("k", "parsed.text", "parsed.year", "parsed.decade", "parsed.kind", "parsed.season", "parsed.episode", "parsed.exact").collect()}
    assert got == {k: want for k, (_, want) in enumerate(PARSED)}


def test_intents(spark):
    asked = ["new french films", "best sci-fi", "the best korean thrillers 2015", '"drama"', "red dramas", "best", "science fiction comedies"]
    rows = spark.createDataFrame([(k, q) for k, q in enumerate(asked)], "k int, q string")
    got = {r.k: r.intent and tuple(r.intent) for r in Q.intent(rows, "q", 2024).collect()}
    assert got == {0: (None, "fr", "movie", 2020, None), 1: ("Sci-Fi", None, None, None, None), 2: ("Thriller", "ko", None, None, 2015), 3: None, 4: None, 5: None, 6: ("Sci-Fi", None, None, None, None)}


def test_the_ladder_stops_where_hits_are_strong(spark):
    titles = spark.createDataFrame([(1, "red bolt", 9000), (2, "red plate", 9000), (3, "blue gear", 9000), (4, "the gear", 9000), (5, "Der Ring", 10)], "id long, title string, votes long")
    asked = spark.createDataFrame([(1, "red bolt"), (2, "the"), (3, '"blue gear"'), (4, "blu gaer"), (5, "der")], "qid int, query string")
    got = {}
    for r in search.ladder(titles, asked, 5, 100, 100).collect():
        got.setdefault(r.qid, []).append((r.place, r.id, r.tier))
    assert sorted(got[1]) == [(1, 1, 2)] and got[2] == [(1, 4, 0)] and got[3] == [(1, 3, 1)]
    assert got[4][0][2] == 4 and {i for _, i, _ in got[4]} >= {3} and 5 not in got


def test_cube_answers_equal_live_counts(spark, sf_dir):
    from folio.operators import browse, catalogue, rank

    titles = rank.bayesian(catalogue.titles(spark, sf_dir), 25)
    cells = browse.cube(titles, 25).cache()
    live = titles.select("kind", F.coalesce("year", F.lit(0)).alias("year"), "genres", "votes", "rank").collect()
    for genre, kind, years, column in (("", None, None, "n"), ("red", None, None, "n_floor"), ("", "PROMO", None, "n_ranked"), ("red", "PROMO", (1995, 1995), "n"), ("none such", None, None, "n")):
        fits = [r for r in live if (not genre or genre in r.genres) and (kind is None or r.kind == kind) and (years is None or years[0] <= r.year <= years[1])]
        want = sum(r.votes >= 25 if column == "n_floor" else r.rank is not None if column == "n_ranked" else 1 for r in fits)
        assert browse.cube_total(cells, genre, kind, years, column).first().total == want
    cells.unpersist()


def test_no_query_orders_all_rows_in_one_task(spark, sf_dir):
    """Windows of the order statistics are over buckets (a bounded number) or within one."""
    from folio import plans

    for name in ("percentile_cutoff", "rank_head_cutoff", "quantile_impute"):
        lines = plans.queries()[name](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString().splitlines()
        windows = [x for x in lines if x.lstrip(" +-:").startswith("Window [")]
        assert windows and all("_bucket#" in x for x in windows), name
