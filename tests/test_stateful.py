"""Streams with state against the ordered table: shuffled and late input, replays."""

from __future__ import annotations

import random
from datetime import UTC, datetime

import pytest
from pyspark.sql import functions as F

from folio.streaming import stateful as S

SCHEMA = "event_id long, ts timestamp, user_id long, event_type string, text string"
DAY = 86_400


def _run(spark, tmp_path, rows, make, columns, chunks=6):
    """The stream over rows in a random order, in some files; the last one, far later, lets the watermark pass them all."""
    S.stateful(spark)
    folder = tmp_path / "in"
    parts = [rows[k::chunks] for k in range(chunks)]
    end = [(10**9, 10 * DAY, -1, "end", None)]
    for k, part in enumerate([*parts, end, [(10**9 + 1, 11 * DAY, -1, "end", None)]]):
        made = [(i, datetime.fromtimestamp(at, UTC), u, e, t) for i, at, u, e, t in part]
        spark.createDataFrame(made, SCHEMA).coalesce(1).write.mode("append").parquet(str(folder))
    events = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(folder)).withWatermark("ts", f"{2 * DAY} seconds")
    out, check = str(tmp_path / "out"), str(tmp_path / "check")
    make(events).writeStream.format("parquet").option("checkpointLocation", check).trigger(availableNow=True).start(out).awaitTermination(200)
    return sorted((tuple(r[c] for c in columns) for r in spark.read.parquet(out).filter("user_id >= 0").collect()), key=repr)


@pytest.fixture
def events():
    """(id, second, user, kind, text) over a day, shuffled."""
    r = random.Random(3)
    rows = []
    for i in range(400):
        text = "".join(r.choices("ab", k=r.randrange(1, 4)))
        rows.append((i, r.randrange(20, DAY, 20), r.randrange(6), r.choice(["search", "error"]), text))
    r.shuffle(rows)
    return rows


def test_debounce_of_a_stream_equals_the_ordered_table(spark, tmp_path, events):
    window = 900
    want = []
    for i, at, u, e, t in events:
        if not any(u == v and e == f and (at, i) < (b, j) and b - at <= window and x.startswith(t) for j, b, v, f, x in events):
            want.append((u, e, at * 1000, i, t))
    got = _run(spark, tmp_path, events, lambda s: S.debounced(s, F.col("text"), window * 1000), ("user_id", "event_type", "at", "id", "what"))
    assert got == sorted(want, key=repr) and 0 < len(want) < len(events)


def replay(rows):
    """Events in order, waits in between, as a plain loop."""
    out, state = [], {}
    for _, at, u, e, t in sorted(rows, key=lambda x: (x[1], x[0])):
        attempt, due = state.get(u, (0, None))
        if due is not None and due < at * 1000:
            out.append((u, due, attempt, "retry", None))
            due = None
        if t[0] == "b" and e == "search":
            out.append((u, at * 1000, attempt, "available", None))
            attempt, due = 0, None
        elif e == "error":
            attempt += 1
            due = at * 1000 + (1, 5, 15, 30, 60)[min(attempt, 5) - 1] * 60_000 if attempt < 24 else None
            out.append((u, at * 1000, attempt, "waiting" if due else "failed", due))
        state[u] = attempt, due
    return sorted(out + [(u, due, a, "retry", None) for u, (a, due) in state.items() if due is not None], key=repr)


def test_retries_of_a_stream_equal_a_replay(spark, tmp_path, events):
    events = [x for x in events if x[3] == "error" or x[4][0] == "b" and x[0] % 5 == 0]
    what = F.when(F.col("event_type") == "error", "failed").when(F.col("text").startswith("b"), "arrived")
    got = _run(spark, tmp_path, events, lambda s: S.retried(s, what), ("user_id", "at", "attempt", "state", "due"))
    want = replay(events)
    assert {x[3] for x in want} >= {"waiting", "retry", "available"}
    assert got == want


def test_a_replayed_flush_writes_nothing_twice(spark, tmp_path):
    flush = S.Flush(str(tmp_path / "log"), ["event_id"], cap=50)
    rows = spark.range(120).select(F.col("id").alias("event_id"))
    flush(rows, 0)
    flush(rows.filter("event_id < 20"), 1)
    flush(rows, 0)  # again, after a failure
    rows.write.parquet(str(tmp_path / "log/rows/flush=2"))  # died before the count
    assert {(r.flush, r.written, r.dropped) for r in flush.counts(spark).collect()} == {(0, 50, 70), (1, 20, 0)}
    assert sorted((r.flush, r.event_id) for r in flush.read(spark).collect()) == [(0, k) for k in range(50)] + [(1, k) for k in range(20)]


def test_a_log_is_flushed_by_batches(spark, tmp_path):
    for k in range(3):
        spark.range(k * 100, k * 100 + 40 * (k + 1)).select(F.col("id").alias("event_id")).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("event_id long").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    flush = S.Flush(str(tmp_path / "log"), ["event_id"], cap=60)
    for _ in range(2):  # nothing is left for the second run
        S.flushed(stream, flush, str(tmp_path / "check"), now=True).awaitTermination(100)
    counts = flush.counts(spark).agg(F.sum("written").alias("w"), F.sum("dropped").alias("d"), F.count("*").alias("n")).first()
    assert tuple(counts) == (40 + 60 + 60, 20 + 60, 3) and flush.read(spark).count() == 160
