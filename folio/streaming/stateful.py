"""Streams with state and timers, and a sink that a replayed batch does not change.

Rows wait in the state of their key until the watermark has passed them and are then taken in the order of time and id, timers
among them, so results are those of the ordered table whatever order rows came in, as long as they were not later than the watermark allows (a watermark begins at the first second of 1970, which counts as late).
State is kept in RocksDB (``stateful`` sets the provider) and is as large as a key's rows within watermark and window.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: Minutes before each further attempt, the last one for all after it, and the most attempts: fixed values.
DELAYS, MOST = (1, 5, 15, 30, 60), 24
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def stateful(spark: SparkSession) -> None:
    """Lets queries that begin from now on keep state with timers."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)


class Ordered(StatefulProcessor):
    """Keeps rows (at in milliseconds, id, text) until the watermark has passed them, then hands them on in order."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "at long, id long, what string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        came = [(int(at), int(i), w) for b in rows for at, i, w in zip(b["at"].tolist(), b["id"].tolist(), b["what"].tolist(), strict=True) if w is not None]
        for r in came:
            self.waiting.appendValue(r)
        for at in sorted({r[0] for r in came}):
            self.handle.registerTimer(at + self.after())
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        """Once for a watermark: the rows that it has passed, and what falls due up to it."""
        rows = sorted(tuple(r) for r in self.waiting.get()) if self.waiting.exists() else []
        yield from self.passed(key, rows, timerValues.getCurrentWatermarkInMs())

    def keep(self, rows: list[tuple]) -> None:
        if rows:
            self.waiting.put(rows)
        else:
            self.waiting.clear()

    def after(self) -> int:
        """Milliseconds behind a row at which it is looked at."""
        return 0

    def passed(self, key, rows: list[tuple], watermark: int) -> Iterator[pd.DataFrame]:
        raise NotImplementedError

    def close(self) -> None:
        pass


class Debounce(Ordered):
    """A typed text passes once it is ripe, unless a later one of its key within the window begins with it."""

    def __init__(self, window: int):
        self.window = window

    def after(self) -> int:
        return self.window

    def passed(self, key, rows, watermark):
        out = []
        for k, (at, i, what) in enumerate(rows):
            if at + self.window > watermark:
                break
            if not any(later[0] <= at + self.window and later[2].startswith(what) for later in rows[k + 1 :]):
                out.append((*key, at, i, what))
        self.keep([r for r in rows if r[0] + self.window > watermark])
        if out:
            yield pd.DataFrame(out, columns=["user_id", "event_type", "at", "id", "what"])


class Retry(Ordered):
    """Failed attempts of a request wait longer each time; when a wait is over the request is tried again, until it arrives or too many attempts failed.

    ``what`` is ``failed`` or ``arrived`` (the reconciled state of the mirror).
    """

    def init(self, handle):
        super().init(handle)
        self.now = handle.getValueState("now", "attempt int, due long")

    def passed(self, key, rows, watermark):
        attempt, due = self.now.get() if self.now.exists() else (0, -1)
        out = []

        def retried(until: int) -> None:
            nonlocal due
            if 0 <= due <= until:
                out.append((*key, due, attempt, "retry", None))
                due = -1

        for at, _, what in rows:
            if at > watermark:
                break
            retried(at - 1)
            if what == "arrived":
                out.append((*key, at, attempt, "available", None))
                attempt, due = 0, -1
            else:
                attempt += 1
                due = at + DELAYS[min(attempt, len(DELAYS)) - 1] * 60_000 if attempt < MOST else -1
                out.append((*key, at, attempt, "waiting", due) if due >= 0 else (*key, at, attempt, "failed", None))
        retried(watermark)
        self.keep([r for r in rows if r[0] > watermark])
        self.now.update((attempt, due))
        if due >= 0:
            self.handle.registerTimer(due)
        if out:
            yield pd.DataFrame(out, columns=["user_id", "at", "attempt", "state", "due"]).astype({"due": "Int64"})


def _timed(events: DataFrame, what) -> DataFrame:
    return events.select("user_id", "event_type", "ts", F.unix_millis("ts").alias("at"), F.col("event_id").alias("id"), what.alias("what"))


def debounced(events: DataFrame, text, window: int) -> DataFrame:
    """(user_id, event_type, at, id, what) of a stream with a watermark on ts; ``text`` is a column, null as empty, ``window`` in milliseconds."""
    rows = _timed(events, F.coalesce(F.lower(text), F.lit("")))
    kinds = dict(events.dtypes)
    schema = f"user_id {kinds['user_id']}, event_type {kinds['event_type']}, at long, id long, what string"
    return rows.groupBy("user_id", "event_type").transformWithStateInPandas(Debounce(window), outputStructType=schema, outputMode="Append", timeMode="EventTime")


def retried(events: DataFrame, what) -> DataFrame:
    """(user_id, at, attempt, state, due) of a stream of failures and arrivals; other rows have a null ``what``.

    They are not filtered out before, as Spark would filter them before it sets the watermark, and then only failures and arrivals moved it.
    """
    rows = _timed(events, what)
    schema = f"user_id {dict(events.dtypes)['user_id']}, at long, attempt int, state string, due long"
    return rows.groupBy("user_id").transformWithStateInPandas(Retry(), outputStructType=schema, outputMode="Append", timeMode="EventTime")


class Flush:
    """Writes each batch of a log as one flush: its first ``cap`` rows in the order, and how many were written and dropped.

    A flush is named by its batch, so a batch that is replayed after a failure is written over itself: rows first, then the count that
    makes it valid. ``read`` takes the rows of counted flushes only.
    """

    def __init__(self, path: str, order: list[str], cap: int = 2000):
        self.path, self.order, self.cap = path.rstrip("/"), order, cap

    def __call__(self, batch: DataFrame, number: int) -> None:
        rows = f"{self.path}/rows/flush={number}"
        batch.orderBy(*self.order).limit(self.cap).write.mode("overwrite").parquet(rows)
        seen = batch.agg(F.count("*").alias("n"))
        counts = seen.select(F.least("n", F.lit(self.cap)).alias("written"), F.greatest(F.col("n") - self.cap, F.lit(0)).alias("dropped"))
        counts.write.mode("overwrite").parquet(f"{self.path}/counts/flush={number}")

    def counts(self, spark: SparkSession) -> DataFrame:
        return spark.read.parquet(f"{self.path}/counts")

    def read(self, spark: SparkSession) -> DataFrame:
        return spark.read.parquet(f"{self.path}/rows").join(F.broadcast(self.counts(spark).select("flush")), "flush", "left_semi")


def flushed(rows: DataFrame, flush: Flush, checkpoint: str, every: str = "30 seconds", now: bool = False):
    """Starts the sink: a flush every so often, or of all that is there."""
    writer = rows.writeStream.foreachBatch(flush).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if now else writer.trigger(processingTime=every)).start()
