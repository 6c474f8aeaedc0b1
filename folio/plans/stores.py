"""Tables written in a source's format and scanned again, and tables as sinks leave them."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import functions as F

from folio.session import table, temporary
from folio.sources import files, tables


def _arrays(rows):
    """The JSON texts in the column value as lines of one array a file."""

    def brackets(batches):
        mark = "["
        for b in batches:
            lines = []
            for v in b.column("value").to_pylist():
                lines.append(mark + v)
                mark = ","
            yield pa.RecordBatch.from_arrays([pa.array(lines, pa.string())], names=["value"])
        yield pa.RecordBatch.from_arrays([pa.array(["[]" if mark == "[" else "]"])], names=["value"])

    return rows.select("value").mapInArrow(brackets, "value string")


def tsv_scan(spark, sf_dir):
    """Parts through a gzipped TSV with unknown values."""
    path, part = temporary(spark), table(spark, sf_dir, "part")
    size = F.when(F.col("p_size") > 5, F.concat(F.col("p_size").cast("string"), F.lit(" cm"))).otherwise("\\N")
    part.select(F.col("p_partkey").cast("string").alias("id"), F.col("p_name").alias("title"), size.alias("size")).write.options(sep="\t", quote="", header=True, compression="gzip").csv(path)
    return files.tsv(spark, path, ["id", "title", "size"]).select(files.int_or_null(F.col("id")).alias("id"), "title", files.int_or_null(F.col("size")).alias("size"))


def csv_scan(spark, sf_dir):
    """Suppliers through plain CSV lines of valid ids, and names with quotes through records."""
    path, rows = temporary(spark), table(spark, sf_dir, "supplier")
    line = F.when(F.col("s_suppkey") % 5 == 0, F.concat_ws(",", "s_name", F.lit("x"))).otherwise(F.concat_ws(",", F.concat(F.lit("nm"), "s_suppkey"), "s_name", F.col("s_nationkey").cast("string")))
    rows.select(line.alias("value")).write.text(f"{path}/a")
    rows.select("s_suppkey", F.concat(F.lit('a "quoted", '), "s_name").alias("name")).write.options(quote='"', escape='"').csv(f"{path}/b")
    a = files.csv_lines(spark, f"{path}/a", ["id", "name", "nation"], {"id": r"^nm[0-9]+$"})
    b = files.csv_records(spark, f"{path}/b", "key long, label string")
    return a.join(b, F.concat(F.lit("nm"), b["key"].cast("string")) == a["id"]).select("id", "name", "label")


def entity_scan(spark, sf_dir):
    """Places from entity rows."""
    n = table(spark, sf_dir, "nation")
    point = F.when(F.col("n_nationkey") % 6 == 5, F.lit("Point(500 1)")).otherwise(F.concat(F.lit("Point("), (F.col("n_nationkey") * 2 - 20).cast("string"), F.lit(".5 -"), (F.col("n_nationkey") + 1).cast("string"), F.lit(")")))
    rows = n.select(F.concat(F.lit("http://e/entity/Q"), "n_nationkey").alias("iri"), F.col("n_name").alias("label"), point.alias("point"), F.upper(F.substring("n_name", 1, 2)).alias("country"), F.when(F.col("n_regionkey") == 1, F.lit("c")).alias("caption"), F.when(F.col("n_regionkey") < 3, F.lit("a")).alias("area"))
    return files.entities(rows).select("id", "label", "lat", "lon", "kind")


def ndjson_scan(spark, sf_dir):
    """Popularities through one JSON object a line; broken lines and impossible values are dropped."""
    path, part = temporary(spark), table(spark, sf_dir, "part")
    good = F.to_json(F.struct((F.col("p_partkey") - 3).alias("id"), (F.col("p_retailprice") - 950).alias("popularity")))
    part.select(F.when(F.col("p_size") == 7, F.lit('{"id": 5, "popul')).otherwise(good).alias("value")).write.option("compression", "gzip").text(path)
    return files.popularity(spark, path)


def json_array_scan(spark, sf_dir):
    """Regions and their nations, and orders, through files that hold one JSON array each."""
    path = temporary(spark)
    per = table(spark, sf_dir, "nation").groupBy("n_regionkey").agg(F.sort_array(F.collect_list("n_name")).alias("names"))  # as many rows as regions
    _arrays(per.select(F.to_json(F.struct("n_regionkey", "names")).alias("value"))).write.text(f"{path}/a")
    regions = files.json_array(spark, f"{path}/a", "n_regionkey int, names array<string>").select(F.lit("nation").alias("what"), F.explode("names").alias("name"))
    orders = table(spark, sf_dir, "orders").select(F.to_json(F.struct("o_orderkey", F.concat(F.lit('a "quoted" [, \\'), "o_orderstatus").alias("status"))).alias("value"))
    _arrays(orders).write.text(f"{path}/b")
    again = files.json_array(spark, f"{path}/b", "o_orderkey long, status string")
    return regions.unionByName(again.select(F.lit("order").alias("what"), F.concat_ws(":", "o_orderkey", "status").alias("name")))


def awards_scan(spark, sf_dir):
    """Orders as ceremonies through TSV with lists, numbered in the order of the file that holds the ceremony."""
    path, o = temporary(spark), table(spark, sf_dir, "orders")
    rows = o.select(F.col("o_custkey").cast("string").alias("ceremony"), F.col("o_orderkey").cast("string").alias("id"), F.concat_ws("|", "o_orderstatus", F.lit(" x "), F.lit("")).alias("films"))
    rows.repartition("ceremony").sortWithinPartitions(F.col("id").cast("long").desc()).write.options(sep="\t", quote="", header=True).csv(path)
    return files.awards(spark, path, ["ceremony", "id", "films"], ["films"], "ceremony").select("ceremony", "id", F.array_join("films", "+").alias("films"), "seq")


def insert_or_ignore(spark, sf_dir):
    """Of each customer's orders the first stays, or the last."""
    o = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderstatus")
    a = tables.first_wins(o, ["o_custkey"], "o_orderkey").select(F.lit("first").alias("how"), "*")
    return a.unionByName(tables.last_wins(o, ["o_custkey"], "o_orderkey").select(F.lit("last").alias("how"), "*"))


def replace_mirror(spark, sf_dir):
    """A mirror of which one source is replaced."""
    path, c = temporary(spark), table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment", F.lit(1).alias("sync"))
    tables.replace_mirror(c, path, "c_mktsegment")
    tables.replace_mirror(c.filter("c_mktsegment = 'BUILDING' AND c_custkey > 100").withColumn("sync", F.lit(2)), path, "c_mktsegment")
    return spark.read.parquet(path).groupBy("c_mktsegment", "sync").agg(F.count("*").alias("n"))


def upsert_changed(spark, sf_dir):
    """Customers with new balances; a null keeps the old value, an equal one the old stamp."""
    old = table(spark, sf_dir, "customer").filter("c_custkey > 10").select("c_custkey", F.col("c_nationkey").alias("nation"), F.lit(1).alias("stamp"))
    new = table(spark, sf_dir, "customer").filter("c_custkey < 100").select("c_custkey", F.when(F.col("c_nationkey") > 15, F.lit(0)).when(F.col("c_nationkey") > 10, F.lit(None).cast("int")).otherwise(F.col("c_nationkey")).alias("nation"), F.lit(2).alias("stamp"))
    return tables.upserted(old, new, ["c_custkey"], ["nation"], "stamp")


def promote_version(spark, sf_dir):
    """A build that was promoted after another and taken back, laid out by key."""
    versions, part = tables.Versions(spark, temporary(spark)), table(spark, sf_dir, "part").select("p_partkey", "p_name")
    for build, rows in (("one", part.filter("p_partkey < 50")), ("two", part)):
        versions.write(rows.repartitionByRange(4, "p_name").sortWithinPartitions("p_name"), build)
        versions.promote(build)
    versions.rollback()
    return versions.read()


def hydrate_page(spark, sf_dir):
    """The titles of a page of ids in the order asked for, and one by its key."""
    part = table(spark, sf_dir, "part").select("p_partkey", "p_name")
    ids = spark.createDataFrame([(7,), (3,), (11,), (-1,)], "p_partkey long")
    page = files.hydrated(part, ids, "p_partkey").select(F.lit("page").alias("how"), "*")
    return page.unionByName(files.by_key(part, "p_partkey", 5).select(F.lit("key").alias("how"), "*"))


QUERIES = {
    "tsv_scan": (tsv_scan, "SELECT CAST(p_partkey AS INT) AS id, p_name AS title, CASE WHEN p_size > 5 THEN p_size END AS size FROM part"),
    "csv_scan": (csv_scan, "SELECT 'nm' || s_suppkey AS id, s_name AS name, 'a \"quoted\", ' || s_name AS label FROM supplier WHERE s_suppkey % 5 <> 0"),
    "entity_scan": (entity_scan, """SELECT CAST(n_nationkey AS BIGINT) AS id, n_name AS label, CASE WHEN n_nationkey % 6 <> 5 THEN CAST(-n_nationkey - 1 AS DOUBLE) END AS lat, CASE WHEN n_nationkey % 6 <> 5 THEN CAST((n_nationkey * 2 - 20) || '.5' AS DOUBLE) END AS lon,
      CASE WHEN n_regionkey = 1 THEN 'caption' WHEN n_regionkey < 3 THEN 'area' ELSE 'site' END AS kind FROM nation"""),
    "ndjson_scan": (ndjson_scan, "SELECT p_partkey - 3 AS id, p_retailprice - 950 AS popularity FROM part WHERE p_size <> 7 AND p_partkey > 3 AND p_retailprice >= 950"),
    "json_array_scan": (json_array_scan, "SELECT 'nation' AS what, n_name AS name FROM nation UNION ALL SELECT 'order', o_orderkey || ':a \"quoted\" [, \\' || o_orderstatus FROM orders"),
    "awards_scan": (awards_scan, "SELECT CAST(o_custkey AS VARCHAR) AS ceremony, CAST(o_orderkey AS VARCHAR) AS id, o_orderstatus || '+x' AS films, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) - 1 AS INT) AS seq FROM orders"),
    "insert_or_ignore": (insert_or_ignore, """SELECT 'first' AS how, * FROM (SELECT o_custkey, o_orderkey, o_orderstatus FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) = 1)
      UNION ALL SELECT 'last', * FROM (SELECT o_custkey, o_orderkey, o_orderstatus FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) = 1)"""),
    "replace_mirror": (replace_mirror, "SELECT c_mktsegment, CASE WHEN c_mktsegment = 'BUILDING' THEN 2 ELSE 1 END AS sync, count(*) AS n FROM customer WHERE c_mktsegment <> 'BUILDING' OR c_custkey > 100 GROUP BY 1, 2"),
    "upsert_changed": (upsert_changed, """SELECT c_custkey, CASE WHEN c_custkey > 10 AND (c_custkey >= 100 OR c_nationkey <= 15) THEN c_nationkey WHEN c_nationkey > 15 THEN 0 WHEN c_nationkey > 10 THEN NULL ELSE c_nationkey END AS nation,
      CASE WHEN c_custkey <= 10 OR c_custkey < 100 AND c_nationkey > 15 THEN 2 ELSE 1 END AS stamp FROM customer"""),
    "promote_version": (promote_version, "SELECT p_partkey, p_name FROM part WHERE p_partkey < 50"),
    "hydrate_page": (hydrate_page, "SELECT 'page' AS how, p_partkey, p_name FROM part WHERE p_partkey IN (3, 7, 11) UNION ALL SELECT 'key', p_partkey, p_name FROM part WHERE p_partkey = 5"),
}
