"""Ranking statistics: weighted means, robust scores, cutoffs, imputation by quantile."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folio.operators.order import running
from folio.session import few, saved


def bayesian(titles: DataFrame, prior: int) -> DataFrame:
    """Adds rank = v/(v+C)·R + C/(v+C)·m, with m the mean rating where votes >= C.

    Unknown stays unknown: no votes or no rating gives a null rank, not a zero.
    The mean is one row, so the join that brings it is a broadcast of a single value.
    """
    mean = titles.filter(F.col("votes") >= prior).agg(F.avg("rating").alias("_m"))
    v, c = F.col("votes"), F.lit(float(prior))
    score = F.round(v / (v + c) * F.col("rating") + c / (v + c) * F.col("_m"), 6)
    return titles.join(F.broadcast(mean), F.lit(True), "left").withColumn("rank", F.when((v > 0) & (F.col("rating") > 0), score)).drop("_m")


def medians(rows: DataFrame, keys: list[str], values: list[Column], accuracy: int = 10_000) -> DataFrame:
    """(keys, _n, _m0, _m1, ...): rows of each group and the exact medians of values, without a group's values in one task.

    Approximate percentiles just below and above the middle, whose error in rank is bounded, give a band for each group. Values below the band are only
    counted; those within it, few, are put in order. A band that misses the middle is an error.
    """
    rows = saved(rows.select(*keys, *(v.alias(f"_v{k}") for k, v in enumerate(values))))
    cut = [0.5 - 2 / accuracy, 0.5 + 2 / accuracy]
    bands = few(saved(rows.groupBy(*keys).agg(F.count("*").alias("_n"), *(F.count(f"_v{k}").alias(f"_n{k}") for k in range(len(values))), *(F.percentile_approx(f"_v{k}", cut, accuracy).alias(f"_b{k}") for k in range(len(values))))))
    out = bands.select(*keys, "_n")
    for k in range(len(values)):
        v, low, high = F.col(f"_v{k}"), F.col(f"_b{k}")[0], F.col(f"_b{k}")[1]
        near = rows.join(bands, keys).filter(v <= high).groupBy(*keys, f"_n{k}", F.when(v >= low, v).alias("_at")).agg(F.count("*").alias("_c"))
        upto = F.sum("_c").over(Window.partitionBy(*keys).orderBy(F.asc_nulls_first("_at")))
        at = lambda place: F.min(F.when((F.col("_upto") > place) & F.col("_at").isNotNull() & (F.col("_upto") - F.col("_c") <= place), F.col("_at")))  # noqa: B023, E731
        n = F.col(f"_n{k}")
        two = near.withColumn("_upto", upto).groupBy(*keys).agg(at(F.floor((n - 1) / 2)).alias("_a"), at(F.floor(n / 2)).alias("_z"))
        middle = F.when(F.col("_a").isNull() | F.col("_z").isNull(), F.raise_error(F.lit("a band missed the middle"))).otherwise(0.5 * F.col("_a") + 0.5 * F.col("_z"))
        out = out.join(few(saved(two.select(*keys, middle.alias(f"_m{k}")))), keys, "left")
    return out


def robust_z(rows: DataFrame, keys: list[str], values: dict[str, str], least: int = 1) -> DataFrame:
    """Adds (value - median) / max(1.4826 · MAD, 1e-9) within keys, for {name: value}.

    Only groups of ``least`` rows or more stay.
    """
    count = range(len(values))
    centre = medians(rows, keys, [F.col(v) for v in values.values()]).filter(F.col("_n") >= least).select(*keys, *(F.col(f"_m{k}").alias(f"_c{k}") for k in count))
    away = rows.join(few(saved(centre)), keys)
    spread = medians(away, keys, [F.abs(F.col(v) - F.col(f"_c{k}")) for k, v in enumerate(values.values())]).select(*keys, *(F.col(f"_m{k}").alias(f"_d{k}") for k in count))
    out = away.join(few(saved(spread)), keys)
    for k, (name, v) in enumerate(values.items()):
        out = out.withColumn(name, (F.col(v) - F.col(f"_c{k}")) / F.greatest(F.col(f"_d{k}") * 1.4826, F.lit(1e-9))).drop(f"_c{k}", f"_d{k}")
    return out


def breakout(rows: DataFrame, rungs: list[list[str]], least: int, confidence: int) -> DataFrame:
    """reach and love of (id, votes, rating, ...): medians of robust z-scores over a ladder of strata.

    For each locale key of a row (the column ``locale``) the first rung whose stratum has ``least`` members
    scores the row; rungs are lists of columns, finest first. love is damped by v/(v + confidence).
    """
    base = saved(rows.withColumn("_reach", F.log10("votes")))
    scored = None
    for level, keys in enumerate(rungs):
        z = robust_z(base, keys, {"_zr": "_reach", "_zl": "rating"}, least).select("id", "locale", "votes", F.lit(level).alias("_level"), "_zr", "_zl")
        scored = z if scored is None else scored.unionByName(z)
    first = scored.groupBy("id", "locale").agg(F.min_by(F.struct("votes", "_zr", "_zl"), "_level").alias("s"))
    damp = F.col("s.votes") / (F.col("s.votes") + confidence)
    return first.groupBy("id").agg(F.round(F.median("s._zr"), 6).alias("reach"), F.round(F.median(F.col("s._zl") * damp), 6).alias("love"))


def at_index(rows: DataFrame, value: str, index: Column) -> DataFrame:
    """The value at a 0-based index of the ascending order, as one row; index may use n, the number of rows.

    Values are counted first, so the ordered scan is over distinct values, in buckets.
    """
    counts = rows.filter(F.col(value).isNotNull()).groupBy(value).agg(F.count("*").alias("c"))
    total = counts.agg(F.sum("c").alias("n"))
    placed = running(counts, value, F.col("c"), "upto").crossJoin(F.broadcast(total)).withColumn("at", index)
    return placed.filter((F.col("upto") > F.col("at")) & (F.col("upto") - F.col("c") <= F.col("at"))).select(F.col(value).alias("cutoff"))


def floor_percentile(rows: DataFrame, value: str, p: float) -> DataFrame:
    """Discrete percentile: index min(n - 1, floor(n · p))."""
    return at_index(rows, value, F.least(F.col("n") - 1, F.floor(F.col("n") * p)))


def nearest_rank(rows: DataFrame, value: str, q: float) -> DataFrame:
    """Nearest-rank percentile: the ceil(q · n)-th value."""
    return at_index(rows, value, F.greatest(F.ceil(F.col("n") * q) - 1, F.lit(0)))


def head_cutoff(rows: DataFrame, value: str, k: int) -> DataFrame:
    """The k-th largest value, or -1 where there are fewer."""
    return at_index(rows, value, F.col("n") - k).unionByName(rows.filter(F.col(value).isNotNull()).agg(F.count("*").alias("n")).filter(F.col("n") < k).select(F.lit(-1.0).alias("cutoff")))


def impute(reference: DataFrame, targets: DataFrame) -> DataFrame:
    """Votes at the target's popularity quantile: reference (popularity, votes), targets (id, popularity).

    The lower bound of a target in the sorted reference is a running count over reference and targets together, both
    counted by value first. The votes at that place are a running maximum over places and the first place of each number of votes.
    """
    refs = reference.groupBy("popularity").agg(F.count("*").alias("c")).select("popularity", "c", F.lit(1).alias("ref"))
    asked = targets.select("popularity").distinct().select("popularity", F.lit(0).cast("long").alias("c"), F.lit(0).alias("ref"))
    low = running(refs.unionByName(asked), "popularity", F.col("c"), "lo", "ref").filter("ref = 0").select("popularity", "lo")
    at = saved(low.select("popularity", F.least("lo", F.lit(reference.count() - 1)).alias("at")))
    votes = reference.groupBy("votes").agg(F.count("*").alias("c"))
    starts = running(votes, "votes", F.col("c"), "upto").select((F.col("upto") - F.col("c")).alias("at"), "votes", F.lit(0).alias("asked"))
    places = starts.unionByName(at.select("at").distinct().select("at", F.lit(None).cast("long").alias("votes"), F.lit(1).alias("asked")))
    found = running(places, "at", F.col("votes"), "imputed", "asked", how=F.max).filter("asked = 1").select("at", "imputed")
    return targets.select("id", "popularity").join(at, "popularity").join(found, "at").select("id", "imputed")
