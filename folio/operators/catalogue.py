"""The catalogue: parts as titles, line items as votes, suppliers as people."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folio.session import table


def titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per title: id, title, kind, votes, rating, year, genres.

    Votes are counted before the join, so that it moves one row per title; a title
    without votes keeps votes 0 and rating 0, and its year is unknown (null).
    """
    votes = table(spark, sf_dir, "lineitem").groupBy("l_partkey").agg(
        F.count("*").alias("votes"),
        F.round(F.avg(F.col("l_discount") * 100), 6).alias("rating"),
        F.min(F.year("l_shipdate")).alias("year"),
    )
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("title"), F.col("p_type").alias("kind"))
    return part.join(votes, part.id == votes.l_partkey, "left").select(
        "id", "title", "kind", F.coalesce("votes", F.lit(0)).alias("votes"), F.coalesce("rating", F.lit(0.0)).alias("rating"), "year",
        F.array_distinct(F.split("title", " ")).alias("genres"),
    )


def credits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per title, person and category: title_id, person_id, category, ordering."""
    return table(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("title_id"), F.col("l_suppkey").alias("person_id"), F.col("l_returnflag").alias("category")).agg(F.min("l_linenumber").alias("ordering"))


def people(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("person_id"), F.col("s_name").alias("name"), F.col("s_nationkey").alias("nation"))
