"""Foreign stores: SQLite tables in ranges with filters, paged services with failures, one long JSON array in byte ranges."""

from __future__ import annotations

import json
import sqlite3
import threading
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qs, urlparse

import pytest
from pyspark.sql import functions as F

from folio.sources import files, foreign


@pytest.fixture(scope="module")
def database(tmp_path_factory):
    path = str(tmp_path_factory.mktemp("db") / "users.db")
    with sqlite3.connect(path) as db:
        db.execute('CREATE TABLE "user data" (id INTEGER PRIMARY KEY, "outer id" INT, name VARCHAR(20), score REAL, photo BLOB, level)')
        rows = [(k, k * 7 if k % 3 else None, f"näme {k % 10}" if k % 11 else None, k / 4, bytes([k % 256]), None) for k in range(-50, 5000)]
        db.executemany('INSERT INTO "user data" VALUES (?,?,?,?,?,?)', rows)
        db.execute("""INSERT INTO "user data" VALUES (9999, 'no number', x'00ff', 'x', 'text', 3)""")
        db.execute("CREATE TABLE loose (k INTEGER, v TEXT)")
        db.executemany("INSERT INTO loose VALUES (?, ?)", [(None, "a"), (5, "b"), ("x", "c"), (1.5, "d"), (2**62, "e"), (-(2**62), "f")])
        db.execute("CREATE TABLE bare (k INTEGER)")
    return path


def test_sqlite_is_read_in_ranges(spark, database):
    df = foreign.sqlite_table(spark, database, "user data", "id", 6)
    assert [f.simpleString() for f in df.schema] == ["id:bigint", "outer id:bigint", "name:string", "score:double", "photo:binary", "level:binary"]
    assert df.rdd.getNumPartitions() == 6
    with sqlite3.connect(database) as db:
        want = db.execute("""SELECT id, CASE typeof("outer id") WHEN 'integer' THEN "outer id" END, CASE typeof(name) WHEN 'text' THEN name END, CASE WHEN typeof(score) IN ('real', 'integer') THEN score END FROM "user data" """).fetchall()
    assert sorted(map(tuple, df.select("id", "outer id", "name", "score").collect())) == sorted(want)
    assert {r.photo for r in df.filter("id = 9999").collect()} == {None}


def test_sqlite_applies_the_conditions(spark, database):
    df = foreign.sqlite_table(spark, database, "user data", "id", 4)
    for where, same in (
        ([("id", ">=", 100), ("id", "<", 140)], "id >= 100 AND id < 140"), ([("name", "=", "näme 3")], "name = 'näme 3'"), ([("name", "null", True), ("id", ">", 4000)], "name IS NULL AND id > 4000"),
        ([("id", "in", [1, 2, 9999])], "id IN (1, 2, 9999)"), ([("name", "prefix", "näme"), ("score", ">", 1200)], "name LIKE 'näme%' AND score > 1200"), ([("outer id", "null", False), ("outer id", "<=", 70)], "`outer id` IS NOT NULL AND `outer id` <= 70"), ([("name", "<>", "näme 1")], "name <> 'näme 1'"),
    ):
        found = foreign.sqlite_table(spark, database, "user data", "id", 4, ["name", "id"], where)
        assert found.columns == ["name", "id"]
        assert sorted(map(repr, found.collect())) == sorted(map(repr, df.filter(same).select("name", "id").collect())), where
    narrow = foreign.sqlite_table(spark, database, "user data", "id", 4, where=[("id", ">=", 100), ("id", "<", 140)])
    assert narrow.rdd.getNumPartitions() == 4 and narrow.rdd.glom().map(len).collect() == [10, 10, 10, 10]  # ranges of what is left
    assert df.count() == 5051  # conditions of another table don't stick
    with pytest.raises(Exception, match="there is no operator"):
        foreign.sqlite_table(spark, database, "user data", where=[("id", "~", 1)]).count()


def test_sqlite_reads_every_key(spark, database):
    df = foreign.sqlite_table(spark, database, "loose", "k", 3)
    assert {(r.k, r.v) for r in df.collect()} == {(None, "a"), (5, "b"), (None, "c"), (None, "d"), (2**62, "e"), (-(2**62), "f")}
    assert foreign.sqlite_table(spark, database, "loose").count() == 6
    assert foreign.sqlite_table(spark, database, "bare", "k").count() == 0
    with pytest.raises(Exception, match="there is no table"):
        foreign.sqlite_table(spark, database, "missing").count()


class Stub(BaseHTTPRequestHandler):
    """Records 1 to total; every third page fails at first, once with an error, once with half an answer."""

    total, asked = 0, {}

    def do_GET(self):
        q = {k: v[0] for k, v in parse_qs(urlparse(self.path).query).items()}
        page, size = int(q["page"]), int(q["pageSize"])
        n = Stub.asked[page] = Stub.asked.get(page, 0) + 1
        if self.headers.get("X-Api-Key") != "k":
            self.send_response(401)
            self.end_headers()
            return
        body = json.dumps({"totalRecords": Stub.total, "records": [{"id": i, "title": f"t{i}", "tags": [i], "ok": i % 2 == 0} for i in range((page - 1) * size + 1, min(page * size, Stub.total) + 1)]}).encode()
        if page % 3 == 0 and n <= 2:
            self.send_response(503 if n == 1 else 200)
            self.end_headers()
            self.wfile.write(body[: len(body) // 2])
            return
        self.send_response(200)
        self.end_headers()
        self.wfile.write(body)

    def log_message(self, *_):
        pass


@pytest.fixture
def service():
    server = ThreadingHTTPServer(("127.0.0.1", 0), Stub)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    Stub.total, Stub.asked = 0, {}
    yield f"http://127.0.0.1:{server.server_port}/api/movie"
    server.shutdown()


SCHEMA = "id long, title string, tags string, ok boolean, missing double"
KEY = {"header": "X-Api-Key", "secret": "k", "pagesize": "10", "pages": "2"}


def test_a_failing_page_is_read_again(spark, service):
    Stub.total = 95
    df = foreign.paged(spark, service, SCHEMA, **KEY)
    rows = sorted(map(tuple, df.collect()))
    assert rows == [(i, f"t{i}", f"[{i}]", i % 2 == 0, None) for i in range(1, 96)]
    assert df.rdd.getNumPartitions() == 5 and Stub.asked[3] >= 3
    with pytest.raises(Exception, match="401"):
        foreign.paged(spark, service, SCHEMA, pagesize="10").count()
    Stub.total = 0
    assert foreign.paged(spark, service, SCHEMA, **KEY).count() == 0


def test_a_stream_goes_on_where_it_stopped(spark, service, tmp_path):
    def run():
        df = foreign.paged(spark, service, SCHEMA, stream=True, **KEY)
        q = df.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start(str(tmp_path / "out"))
        q.awaitTermination(120)
        return sorted(r.id for r in spark.read.parquet(str(tmp_path / "out")).collect())

    Stub.total = 45
    assert run() == list(range(1, 41))  # whole pages
    before = dict(Stub.asked)
    Stub.total = 73
    assert run() == list(range(1, 71))
    assert Stub.asked[2] == before[2]


def test_one_long_array_is_read_by_many_tasks(spark, tmp_path):
    rows = [{"id": k, "t": ('a, "b" ]}[{ \\' + "x" * (k % 97)) if k % 5 else None, "deep": {"list": [[k, 1], [], ["]"]], "more": {"x": ",", "y": {}}}} for k in range(20_000)]
    path = tmp_path / "long.json"
    path.write_text(json.dumps(rows, ensure_ascii=False))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "100k")
    try:
        schema = "id long, t string, deep struct<list:array<array<string>>,more:struct<x:string,y:map<string,string>>>"
        pieces = spark.read.option("lineSep", ",").text(str(path))
        assert pieces.rdd.getNumPartitions() > 8
        got = {r.id: r for r in files.json_array(spark, str(path), schema).collect()}
        assert len(got) == len(rows) and all(got[r["id"]].t == r["t"] and got[r["id"]].deep.list == [[str(r["id"]), "1"], [], ["]"]] for r in rows)
        for cut in (path.stat().st_size - 1, 500_000, 100):
            short = tmp_path / f"cut{cut}.json"
            short.write_bytes(path.read_bytes()[:cut])
            with pytest.raises(files.CutArray):
                files.json_array(spark, str(short), schema)
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_small_and_odd_arrays(spark, tmp_path):
    for name, text, want in (("a", "[]", []), ("b", " [ ] \n", []), ("c", '[{"id":1}]', [1]), ("d", '[\n {"id" : 1},\n{"id":2}\n]\n', [1, 2]), ("e", '[{"id":3,"s":"\\\\"},{"id":4,"s":"\\","}]', [3, 4])):
        (tmp_path / f"{name}.json").write_text(text)
        assert sorted(r.id for r in files.json_array(spark, str(tmp_path / f"{name}.json"), "id int, s string").collect()) == want, name
    assert sorted(r.id for r in files.json_array(spark, str(tmp_path / "[c-d].json"), "id int").collect()) == [1, 1, 2]
    (tmp_path / "x.json").write_text('[{"id":1}, nonsense]')
    with pytest.raises(Exception):  # noqa: B017
        files.json_array(spark, str(tmp_path / "x.json"), "id int").collect()


def test_awards_keep_the_order_of_split_files(spark, tmp_path):
    (tmp_path / "a.tsv").write_text("key\tname\n" + "".join(f"k{i % 3}\tn{i}\n" for i in range(3000)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4k")
    try:
        got = files.awards(spark, str(tmp_path / "a.tsv"), ["key", "name"], [], "key").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert {(r.key, r.seq, r.name) for r in got} == {(f"k{i % 3}", i // 3, f"n{i}") for i in range(3000)}


def test_all_ids_are_hydrated_in_their_order(spark):
    rows = spark.range(5000).withColumn("v", F.col("id") * 2)
    ids = spark.createDataFrame([(k * 37 % 5000,) for k in range(1500)], "id long")
    assert [r.id for r in files.hydrated(rows, ids, "id").collect()] == [k * 37 % 5000 for k in range(1500)]
