"""Foreign stores as data sources: tables of SQLite files, and services that hand out their records page by page.

``spark.dataSource.register(Sqlite)`` makes ``spark.read.format("sqlite")`` known, ``Paged`` does so for
``"paged"``, in batch and as a stream whose checkpoint holds the next page.

Conditions that SQLite is to apply, and the columns wanted, are named when a table is opened. Spark could hand filters over by itself, but
4.1 keeps those of one query for the next over the same DataFrame (a count after a filter counted the filtered rows), so this source does not offer it.
"""

from __future__ import annotations

import json
import os
import sqlite3
import time
import urllib.error
import urllib.request
from collections.abc import Iterator, Sequence
from urllib.parse import urlencode

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import (
    DataSource,
    DataSourceReader,
    DataSourceStreamReader,
    InputPartition,
)
from pyspark.sql.types import StructType

ROWS = 10_000
#: Seconds before each further attempt at a page.
WAITS = (0.2, 1.0, 5.0, 20.0)


class Changed(RuntimeError):
    """A file became another while it was read."""


def _quoted(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


class Range(InputPartition):
    """Rows whose key is at least low and below high; rows without a key if both are None."""

    def __init__(self, low: int | None, high: int | None):
        self.low, self.high = low, high


class Sqlite(DataSource):
    """A table of a SQLite file that all executors can reach.

    Options: path, table, key (an integer column by which the rows are dealt out; the rowid if none is named),
    partitions (8), columns (a JSON list; all if none is named), where (a JSON list of [column, operator, value], all of which must hold, with the
    operators =, <>, <, <=, >, >=, in, prefix and null; the value of null says whether it is to be null). A value that is not of its column's
    declared type reads as null, here and in conditions, as does a blob in a text column.
    """

    @classmethod
    def name(cls) -> str:
        return "sqlite"

    def schema(self) -> str:
        with _opened(self.options["path"]) as db:
            columns = db.execute(f"PRAGMA table_info({_quoted(self.options['table'])})").fetchall()
        if not columns:
            raise ValueError(f"there is no table {self.options['table']} in {self.options['path']}")
        kinds = {name: _kind(declared) for _, name, declared, *_ in columns}
        wanted = json.loads(self.options.get("columns", "null")) or list(kinds)
        if unknown := set(wanted) - set(kinds):
            raise ValueError(f"there is no column {sorted(unknown)} in {self.options['table']}")
        return ", ".join(f"`{name}` {kinds[name]}" for name in wanted)

    def reader(self, schema: StructType) -> DataSourceReader:
        return SqliteReader(schema, dict(self.options))


def _kind(declared: str) -> str:
    """SQLite's own rules of affinity, by what the declared type contains."""
    d = declared.upper()
    if "INT" in d:
        return "bigint"
    if any(x in d for x in ("CHAR", "CLOB", "TEXT")):
        return "string"
    if "BLOB" in d or not d:
        return "binary"
    return "double"


def _opened(path: str) -> sqlite3.Connection:
    return sqlite3.connect(f"file:{path}?mode=ro", uri=True)


def _stamp(path: str) -> tuple[int, int]:
    found = os.stat(path)
    return found.st_size, found.st_mtime_ns


class SqliteReader(DataSourceReader):
    #: typeof() of the values that a column of a type holds.
    TYPES = {"bigint": ("integer",), "double": ("real", "integer"), "string": ("text",), "binary": ("blob",)}
    ARROW = {"long": pa.int64(), "double": pa.float64(), "string": pa.string(), "binary": pa.binary()}

    def __init__(self, schema: StructType, options: dict[str, str]):
        self.arrow = pa.schema([(f.name, self.ARROW[f.dataType.typeName()]) for f in schema.fields])
        self.path, self.table = options["path"], _quoted(options["table"])
        self.key = _quoted(options["key"]) if options.get("key") else "rowid"
        self.wanted = int(options.get("partitions", 8))
        with _opened(self.path) as db:
            self.kinds = {name: _kind(declared) for _, name, declared, *_ in db.execute(f"PRAGMA table_info({self.table})")}
        self.where: list[str] = []
        self.values: list = []
        for column, operator, value in json.loads(options.get("where", "[]")):
            self._condition(self._value(column), operator, value)
        self.stamp = _stamp(self.path)

    def _value(self, name: str) -> str:
        """The column as its type has it: anything else is null."""
        held = ", ".join(f"'{t}'" for t in self.TYPES[self.kinds[name]])
        return f"CASE WHEN typeof({_quoted(name)}) IN ({held}) THEN {_quoted(name)} END"

    def _condition(self, c: str, operator: str, value) -> None:
        if operator in ("=", "<>", "<", "<=", ">", ">="):
            self.where.append(f"{c} {operator} ?")
            self.values.append(value)
        elif operator == "in":
            self.where.append(f"{c} IN (SELECT value FROM json_each(?))")
            self.values.append(json.dumps(list(value)))
        elif operator == "prefix":
            self.where.append(f"substr({c}, 1, ?) = ?")
            self.values += [len(value), value]
        elif operator == "null":
            self.where.append(f"{c} IS {'' if value else 'NOT '}NULL")
        else:
            raise ValueError(f"there is no operator {operator}")

    def _sql(self, what: str, *more: str) -> str:
        where = [*self.where, *more]
        return f"SELECT {what} FROM {self.table}" + (" WHERE " + " AND ".join(f"({w})" for w in where) if where else "")

    def partitions(self) -> Sequence[InputPartition]:
        """Equal ranges of the keys that the filters leave, and one for rows without a whole number as key."""
        with _opened(self.path) as db:
            low, high = db.execute(self._sql(f"min({self.key}), max({self.key})", f"typeof({self.key}) = 'integer'"), self.values).fetchone()
            rest = db.execute(self._sql("1", f"typeof({self.key}) <> 'integer'") + " LIMIT 1", self.values).fetchone()
        out: list[InputPartition] = [Range(None, None)] if rest else []
        if low is not None:
            step = max(1, -(-(high - low + 1) // self.wanted))
            out += [Range(at, min(at + step, high + 1)) for at in range(low, high + 1, step)]
        return out or [Range(0, 0)]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        if partition.low is None:
            more, bounds = f"typeof({self.key}) <> 'integer'", []
        else:
            more, bounds = f"typeof({self.key}) = 'integer' AND {self.key} >= ? AND {self.key} < ?", [partition.low, partition.high]
        with _opened(self.path) as db:
            db.text_factory = lambda raw: raw.decode("utf-8", "replace")
            found = db.execute(self._sql(", ".join(map(self._value, self.arrow.names)), more) + f" ORDER BY {self.key}", [*self.values, *bounds])
            while rows := found.fetchmany(ROWS):
                columns = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, self.arrow, strict=True)], schema=self.arrow)
        if _stamp(self.path) != self.stamp:
            raise Changed(self.path)


def sqlite_table(spark: SparkSession, path: str, table: str, key: str | None = None, partitions: int = 8, columns: Sequence[str] = (), where: Sequence[tuple] = ()) -> DataFrame:
    """The rows of a table that meet all conditions (column, operator, value), read in ranges of its key by many tasks."""
    spark.dataSource.register(Sqlite)
    options = {"path": path, "table": table, "partitions": str(partitions), "where": json.dumps([list(w) for w in where])}
    options |= ({"key": key} if key else {}) | ({"columns": json.dumps(list(columns))} if columns else {})
    return spark.read.format("sqlite").options(**options).load()


class Pages(InputPartition):
    """Pages from first to before end."""

    def __init__(self, first: int, end: int):
        self.first, self.end = first, end


class Service:
    """A service that answers ``?page=N&pageSize=M`` (from 1) with ``{"totalRecords": T, "records": [...]}``; options rename these."""

    def __init__(self, schema: StructType, options: dict[str, str]):
        self.url, self.size = options["url"], int(options.get("pagesize", 100))
        self.page, self.per = options.get("pageparameter", "page"), options.get("sizeparameter", "pageSize")
        self.records, self.total = options.get("records", "records"), options.get("total", "totalRecords")
        self.header, self.secret = options.get("header"), options.get("secret")  # such as X-Api-Key
        self.names = [f.name for f in schema.fields]
        self.types = [f.dataType.typeName() for f in schema.fields]

    def get(self, page: int) -> dict:
        """One page; asked for again after errors that may pass, with growing waits."""
        request = urllib.request.Request(f"{self.url}{'&' if '?' in self.url else '?'}{urlencode({self.page: page, self.per: self.size})}")
        if self.header:
            request.add_header(self.header, self.secret or "")
        for wait in (*WAITS, None):
            try:
                with urllib.request.urlopen(request, timeout=60) as answer:
                    return json.load(answer)
            except urllib.error.HTTPError as error:
                if wait is None or error.code < 500 and error.code != 429:
                    raise
            except (urllib.error.URLError, TimeoutError, ConnectionError, json.JSONDecodeError):
                if wait is None:
                    raise
            time.sleep(wait)
        raise AssertionError

    def count(self) -> int:
        """Pages that the service has now."""
        return -(-int(self.get(1)[self.total]) // self.size)

    def rows(self, first: int, end: int) -> Iterator[tuple]:
        for page in range(first, end):
            for r in self.get(page)[self.records]:
                yield tuple(self._as(r.get(n), t) for n, t in zip(self.names, self.types, strict=True))

    @staticmethod
    def _as(value, kind: str):
        if value is None:
            return None
        if kind == "string":
            return value if isinstance(value, str) else json.dumps(value)
        if kind in ("long", "integer"):
            return int(value) if isinstance(value, (int, float)) and not isinstance(value, bool) and value == int(value) else None
        if kind == "double":
            return float(value) if isinstance(value, (int, float)) and not isinstance(value, bool) else None
        return value if isinstance(value, bool) else None


class Paged(DataSource):
    """Records of a paged service. Options: url, pagesize (100), pages (of one task, 10), and the names that Service takes.

    As a stream, what was read up to is the number of whole pages, kept in the checkpoint: a query that starts again goes on there, and a page is
    read once it is full. A record's fields that are not of the schema's type are null; nested ones are JSON in a string column.
    """

    @classmethod
    def name(cls) -> str:
        return "paged"

    def schema(self) -> str:
        raise ValueError("name the fields to read: .schema(...)")

    def reader(self, schema: StructType) -> DataSourceReader:
        return PagedReader(schema, dict(self.options))

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:
        return PagedStream(schema, dict(self.options))


def _dealt(first: int, end: int, each: int) -> list[Pages]:
    return [Pages(at, min(at + each, end)) for at in range(first, end, each)]


class PagedReader(DataSourceReader):
    def __init__(self, schema: StructType, options: dict[str, str]):
        self.service, self.each = Service(schema, options), int(options.get("pages", 10))

    def partitions(self) -> Sequence[InputPartition]:
        return _dealt(1, self.service.count() + 1, self.each) or [Pages(1, 1)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        return self.service.rows(partition.first, partition.end)


class PagedStream(DataSourceStreamReader):
    def __init__(self, schema: StructType, options: dict[str, str]):
        self.service, self.each = Service(schema, options), int(options.get("pages", 10))

    def initialOffset(self) -> dict:
        return {"page": 1}

    def latestOffset(self) -> dict:
        """The page behind the last full one."""
        return {"page": int(self.service.get(1)[self.service.total]) // self.service.size + 1}

    def partitions(self, start: dict, end: dict) -> Sequence[InputPartition]:
        return _dealt(start["page"], end["page"], self.each)

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        return self.service.rows(partition.first, partition.end)


def paged(spark: SparkSession, url: str, schema: StructType | str, stream: bool = False, **options: str) -> DataFrame:
    """The records of a paged service, in batch or as a stream."""
    spark.dataSource.register(Paged)
    return (spark.readStream if stream else spark.read).format("paged").schema(schema).options(url=url, **options).load()
