"""Positions and running values in a total order without a single task that sees all rows.

Cut points of the ordering value are estimated first (a bounded array); they put rows in buckets that follow
each other, values that are equal in one of them. The rows are written once and read from there for cuts, sums and positions. Sums of the buckets are few rows; within a bucket an ordinary window does the rest.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folio.session import saved

BUCKETS = 256


def running(rows: DataFrame, value: str, amount: Column, name: str, *ties: str, how=F.sum, buckets: int = BUCKETS) -> DataFrame:
    """Adds ``name``: sum (or max, min) of ``amount`` over the rows up to this one, by ``value``, then ``ties``. Null values are dropped."""
    rows = saved(rows.filter(F.col(value).isNotNull()).withColumn("_amount", amount))  # read three times below
    cuts = rows.agg(F.percentile_approx(value, [k / buckets for k in range(1, buckets)], 10_000).alias("cuts")).first().cuts or []
    placed = rows.withColumn("_bucket", F.size(F.filter(F.lit(sorted(set(cuts))), lambda c: c < F.col(value))) if cuts else F.lit(0))
    # One row a bucket: the window without partition keys is over ``buckets`` rows at most.
    each = placed.groupBy("_bucket").agg(how("_amount").alias("_own"))
    upto = Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    before = each.select("_bucket", how("_own").over(upto).alias("_before"))
    inner = Window.partitionBy("_bucket").orderBy(value, *ties).rowsBetween(Window.unboundedPreceding, 0)
    both = placed.withColumn("_here", how("_amount").over(inner)).join(F.broadcast(before), "_bucket")
    joined = {F.max: F.greatest, F.min: F.least}.get(how)
    total = joined("_before", "_here") if joined else F.coalesce("_before", F.lit(0)) + F.coalesce("_here", F.lit(0))
    return both.withColumn(name, total).drop("_bucket", "_amount", "_before", "_here")
