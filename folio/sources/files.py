"""Scans of the files that a catalogue is built from. Every scan has a fixed schema; what does not fit is an error or is dropped, as each says."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from folio.session import dealt, few, saved


class SchemaDrift(ValueError):
    """A file's header is not the expected one."""


def nullable(c: Column) -> Column:
    """Null for ``\\N`` and for nothing."""
    return F.when(~c.isin("\\N", ""), c)


def int_or_null(c: Column) -> Column:
    """The integer that a text begins with, or null."""
    return F.regexp_extract(c, r"^\s*([+-]?\d+)", 1).try_cast("int")


def tsv(spark: SparkSession, path: str, columns: list[str], place: str | None = None) -> DataFrame:
    """Rows of (gzipped) TSV files as text, ``\\N`` and empty fields as null; ``place`` names a column for a row's place in the order of files and lines.

    Every file's header must be the columns, else SchemaDrift. Blank lines are skipped, a last line without
    a line end counts, quotes are ordinary characters; a broken gzip stream fails the job.
    """
    options = {"sep": "\t", "quote": "", "escape": "", "header": True, "enforceSchema": False}
    found = spark.read.options(**options).csv(path).columns
    if found != columns:
        raise SchemaDrift(f"{path}: header {found} is not {columns}")
    schema = ", ".join(f"`{c}` string" for c in columns)
    return spark.read.options(**options).schema(schema).csv(path).select(*(nullable(F.col(f"`{c}`")).alias(c) for c in columns), *([_place().alias(place)] if place else []))


def _place() -> Column:
    """A row's file, byte range, and place within the rows that its task reads: together the order of the file, however it is split and dealt out."""
    return F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("range"), F.monotonically_increasing_id().alias("at"))


def csv_lines(spark: SparkSession, path: str, columns: list[str], ids: dict[str, str]) -> DataFrame:
    """Rows of plain CSV files without quoting; lines of another number of fields, or whose ids do not match, are dropped."""
    parts = F.split("value", ",", -1)
    rows = spark.read.text(path).select(parts.alias("p")).filter(F.size("p") == len(columns))
    rows = rows.select(*(F.col("p")[k].alias(c) for k, c in enumerate(columns)))
    for c, pattern in ids.items():
        rows = rows.filter(F.col(c).rlike(pattern))
    return rows


def csv_records(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """Rows of CSV with quotes and doubled quotes; a record that is not closed on its line is dropped."""
    return spark.read.options(quote='"', escape='"', mode="DROPMALFORMED").schema(schema).csv(path)


def entities(rows: DataFrame) -> DataFrame:
    """(id, label, lat, lon, country, kind) of rows (iri, label, point, country, caption, area): numbers of IRIs, points in range, the kind by precedence."""
    number = F.regexp_extract("iri", r"/Q([0-9]+)$", 1).try_cast("long")
    lon, lat = (F.regexp_extract(F.coalesce("point", F.lit("")), r"(?i)^POINT\s*\(\s*(-?[0-9.]+)\s+(-?[0-9.]+)\s*\)$", k).try_cast("double") for k in (1, 2))
    ok = lat.between(-90, 90) & lon.between(-180, 180)
    kind = F.when(F.col("caption").isNotNull(), "caption").when(F.col("area").isNotNull(), "area").otherwise("site")
    return rows.select(number.alias("id"), "label", F.when(ok, lat).alias("lat"), F.when(ok, lon).alias("lon"), F.when(F.col("country").rlike("^[A-Z]{2}$"), F.col("country")).alias("country"), kind.alias("kind")).filter("id IS NOT NULL")


def ndjson(spark: SparkSession, path: str, schema: StructType | str, *valid: Column) -> DataFrame:
    """Rows of (gzipped) files with one JSON object a line; lines that are none, or not valid, are dropped."""
    rows = spark.read.option("mode", "DROPMALFORMED").schema(schema).json(path)
    for condition in valid:
        rows = rows.filter(condition)
    return rows


def popularity(spark: SparkSession, path: str) -> DataFrame:
    """(id, popularity) of an export: positive ids, finite popularities of zero or more."""
    p = F.col("popularity")
    return ndjson(spark, path, "id long, popularity double", F.col("id") > 0, (p >= 0) & ~F.isnan(p) & (p < float("inf")))


RANGE_BITS, PIECES = 16, 500_000  # pieces of one window are 65,536 at most; so many pieces go to a task


class CutArray(ValueError):
    """A JSON array that ends within a string or before its last bracket."""


def _along(rows: DataFrame, amount: Column, name: str) -> DataFrame:
    """Adds ``name``: the sum of ``amount`` over a file's pieces before this one. A window sees the pieces of one range (bounded in number), or one row for each range of a file."""
    rows = rows.withColumn("_amount", amount)
    ranges = rows.groupBy("file", "range").agg(F.sum("_amount").alias("_own"))
    upto = Window.partitionBy("file").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    before = ranges.select("file", "range", F.coalesce(F.sum("_own").over(upto), F.lit(0)).alias("_before"))
    within = Window.partitionBy("file", "range").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    here = rows.withColumn("_here", F.coalesce(F.sum("_amount").over(within), F.lit(0)))
    return here.join(few(before), ["file", "range"]).withColumn(name, F.col("_before") + F.col("_here")).drop("_amount", "_here", "_before")


def json_array(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """Elements of files that are one JSON array each, however long; an array that is cut off is an error (CutArray).

    A file is read in byte ranges by many tasks, in pieces that end at commas. A piece tells its number of quotes that no backslash escapes, and
    how far its brackets lead in or out, once for a start outside of a string and once for one inside. Running sums put the pieces together:
    of quotes, which side a piece starts on; of the brackets on that side, its depth; of the commas at depth one, its element.
    """
    pieces = spark.read.option("lineSep", ",").text(path).select(F.col("_metadata.file_path").alias("file"), F.struct(F.col("_metadata.file_block_start").alias("start"), F.shiftright(F.monotonically_increasing_id(), RANGE_BITS).alias("run")).alias("range"), F.monotonically_increasing_id().alias("at"), "value")
    parts = F.split(F.regexp_replace("value", r"(?s)\\.", ""), '"', -1)
    count = lambda x, which: F.length(F.regexp_replace(x, which, ""))
    depth = lambda x: count(x, r"[^\[{]") - count(x, r"[^\]}]")
    deeper = lambda side: F.aggregate(F.filter("parts", lambda x, i: i % 2 == side), F.lit(0), lambda n, x: n + depth(x))
    found = pieces.withColumn("parts", parts).select("file", "range", "at", "value", (F.size("parts") - 1).alias("quotes"), deeper(0).alias("outside"), deeper(1).alias("inside"))
    found = saved(found)
    rows = _along(dealt(found, found.count(), "file", "range", each=PIECES), F.col("quotes"), "before")
    rows = rows.withColumn("step", F.when(F.col("before") % 2 == 0, F.col("outside")).otherwise(F.col("inside")))
    rows = _along(rows, F.col("step"), "depth")
    cut = ((F.col("before") + F.col("quotes")) % 2 == 0) & (F.col("depth") + F.col("step") == 1)
    rows = saved(_along(rows.withColumn("cut", cut.cast("int")), F.col("cut"), "element").select("file", "range", "at", "value", "quotes", "step", "cut", "element"))
    whole = rows.groupBy("file").agg((F.sum("quotes") % 2).alias("open"), F.sum("step").alias("depth"), F.max("element").alias("last"))
    if broken := whole.filter("open <> 0 OR depth <> 0").first():
        raise CutArray(broken.file)
    ordered = rows.repartitionByRange(max(1, -(-rows.count() // PIECES)), "file", "element")  # an element is whole in one part, and parts follow each other
    texts = ordered.groupBy("file", "element").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("range", "at", "value"))), lambda x: x.value), ",").alias("text"))
    texts = texts.join(F.broadcast(whole.select("file", "last")), "file").sortWithinPartitions("file", "element")  # one row a file
    head = F.when(F.col("element") == 0, F.regexp_replace("text", r"^\s*\[", "")).otherwise(F.col("text"))
    body = F.when(F.col("element") == F.col("last"), F.regexp_replace(head, r"\]\s*$", "")).otherwise(head)
    empty = (F.col("last") == 0) & (F.trim("body") == "")
    return texts.withColumn("body", body).filter(~empty).select(F.from_json("body", schema, {"mode": "FAILFAST"}).alias("r")).select("r.*")


def awards(spark: SparkSession, path: str, columns: list[str], lists: list[str], key: str) -> DataFrame:
    """Rows of an awards TSV: fields of pipe-separated lists as arrays, and ``seq``, the place within the key in the order of the file."""
    rows = saved(tsv(spark, path, columns, "_at"))
    for c in lists:
        rows = rows.withColumn(c, F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), r"\|"), lambda x: F.trim(x)), lambda x: x != ""))
    return rows.withColumn("seq", F.row_number().over(Window.partitionBy(key).orderBy("_at")) - 1).drop("_at")


def sparql(spark: SparkSession, path: str, names: list[str]) -> DataFrame:
    """Rows of a SPARQL JSON result, one column a variable, null where it is not bound."""
    cell = "struct<type:string,value:string>"
    schema = f"results struct<bindings:array<struct<{', '.join(f'`{n}`:{cell}' for n in names)}>>>"
    rows = spark.read.options(multiLine=True, mode="FAILFAST").schema(schema).json(path).select(F.explode("results.bindings").alias("b"))
    return rows.select(*(F.col(f"b.`{n}`.value").alias(n) for n in names))


def fingerprints(spark: SparkSession, path: str) -> DataFrame:
    """(path, length, modified) of the files of a source; their contents are not read."""
    return spark.read.format("binaryFile").load(path).select("path", "length", F.col("modificationTime").alias("modified"))


def changed(now: DataFrame, known: DataFrame) -> DataFrame:
    """Files of a source whose length or time is not the known one, or that are not known."""
    same = (now["path"] == known["path"]) & (now["length"] == known["length"]) & (now["modified"] == known["modified"])
    return now.join(known, same, "left_anti")


def by_key(rows: DataFrame, key: str, value: object) -> DataFrame:
    """The row of a unique key; the filter reaches the file scan."""
    return rows.filter(F.col(key) == F.lit(value))


def hydrated(rows: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """The rows of a table of ids, in their order; the ids are broadcast if they are few, and all are looked up in any case."""
    placed = ids.select(key, F.monotonically_increasing_id().alias("_at"))
    return rows.join(few(placed), key).orderBy("_at").drop("_at")
