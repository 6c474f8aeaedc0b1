"""What the operators of this subpackage share: written tables, running sums, components."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import os
import re
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Words are runs of anything but these six white-space characters.
WORD = r"[^\x20\x09-\x0D]+"
#: Rows and bytes (as JSON) up to which a side may be broadcast; both are counted first, and it is joined by shuffle beyond.
BROADCAST_ROWS, BROADCAST_BYTES = 100_000, 32_000_000


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; a temporary one only where none is set and all runs on this machine (tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", spark.conf.get("spark.master", "local")):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = "file://" + os.path.join(tempfile.gettempdir(), "checkpoints")
    return found.rstrip("/")


def written(df: DataFrame) -> DataFrame:
    """df as a table in the shared folder: cuts lineage, is computed once, survives lost executors; it goes when the session ends."""
    path = f"{shared_dir(df.sparkSession)}/folio-{uuid.uuid4().hex}"
    df.write.parquet(path)
    jvm = df.sparkSession._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).deleteOnExit(at)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def fresh() -> None:
    """Gives back to the system what earlier tasks of this Python worker no longer use; workers are reused from stage to stage."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """df with a broadcast hint if it has at most so many rows and BROADCAST_BYTES, else unchanged."""
    weight = F.coalesce(F.sum(F.length(F.to_json(F.struct(*(F.col(f"`{c}`") for c in df.columns))))), F.lit(0))
    found = df.limit(rows + 1).agg(F.count("*").alias("rows"), weight.alias("bytes")).first()
    return F.broadcast(df) if found.rows <= rows and found.bytes <= BROADCAST_BYTES else df


def free(df: DataFrame, name: str) -> str:
    """A column name that df does not have, whatever its own columns are called."""
    taken = {c.lower() for c in df.columns}
    while name in taken:
        name = "_" + name
    return name


def running(df: DataFrame, keys: list[str], bucket: Column, order: list[Column], size: Column, name: str) -> DataFrame:
    """Adds ``name``: the sum of ``size`` over the rows before this one, by bucket, then order, within keys.

    Two levels: sums of the buckets (a bounded number of rows) are accumulated first, so that
    no task holds more than one bucket of one key.
    """
    df = df.withColumn("_b", bucket)
    before = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1) if keys else Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    sums = df.groupBy(*keys, "_b").agg(F.sum(size).alias("_s")).withColumn("_base", F.coalesce(F.sum("_s").over(before), F.lit(0))).drop("_s")
    within = Window.partitionBy(*keys, "_b").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    inner = df.withColumn("_in", F.coalesce(F.sum(size).over(within), F.lit(0)))
    return inner.join(sums, [*keys, "_b"]).withColumn(name, F.col("_base") + F.col("_in")).drop("_b", "_base", "_in")


def components(edges: DataFrame, a: str = "a", b: str = "b", rounds: int = 40) -> DataFrame:
    """(node, root): the smallest node reachable over the undirected edges, for every node of an edge.

    Alternates large-star and small-star steps. Both take the minimum of a node's neighbours
    by a combinable aggregate and join it back, so a node with very many neighbours is a
    skewed join that adaptive execution can split, never one group in one task. Each round
    is written to the shared folder; the rounds end when only stars are left. A chain that ``rounds`` can't follow is an error.
    """
    e = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u <> v").distinct()
    e = written(e)
    for _ in range(rounds):
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        big = both.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        low = big.groupBy("u").agg(F.min("v").alias("m"))
        tied = big.join(low, "u")
        star = tied.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v"))).distinct()
        e = written(star)
        n = e.agg(F.count("*").alias("n"), F.count_distinct("u").alias("d")).first()
        leaves = e.select(F.col("u").alias("v"))
        if n.n == n.d and e.select("v").distinct().join(leaves, "v", "left_semi").limit(1).count() == 0:
            break  # every node hangs on one centre, and no centre hangs on another
    else:
        raise RuntimeError(f"components: {rounds} rounds were not enough")
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).union(e.select("v", "v").distinct())
