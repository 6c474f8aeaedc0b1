"""Sinks: tables that are filled, mirrored, upserted, promoted and laid out anew. Writes go to new files; nothing is changed in place."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def first_wins(rows: DataFrame, keys: list[str], order: Column | str) -> DataFrame:
    """Insert or ignore: of rows with one key the first in the order stays."""
    return rows.groupBy(*keys).agg(F.min_by(F.struct(*rows.columns), order).alias("_r")).select(*(F.col("_r")[c].alias(c) for c in rows.columns))


def last_wins(rows: DataFrame, keys: list[str], order: Column | str) -> DataFrame:
    """Insert or replace: of rows with one key the last in the order stays."""
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rows.columns), order).alias("_r")).select(*(F.col("_r")[c].alias(c) for c in rows.columns))


def replace_mirror(rows: DataFrame, path: str, source: str) -> None:
    """Replaces what a mirror holds of the sources that the rows name; other sources stay, and a job that fails changes nothing."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(source).parquet(path)


def upserted(old: DataFrame, new: DataFrame, keys: list[str], values: list[str], stamp: str) -> DataFrame:
    """old with new's rows; a null value keeps the old one, and the stamp moves only where a value is another."""
    both = old.alias("o").join(new.alias("n"), [F.col(f"o.{k}").eqNullSafe(F.col(f"n.{k}")) for k in keys], "full_outer")
    value = lambda c: F.coalesce(F.col(f"n.{c}"), F.col(f"o.{c}"))
    other = F.lit(False)
    for c in values:
        other = other | ~value(c).eqNullSafe(F.col(f"o.{c}"))
    fresh = F.when(other | F.col(f"o.{stamp}").isNull(), F.coalesce(F.col(f"n.{stamp}"), F.col(f"o.{stamp}"))).otherwise(F.col(f"o.{stamp}"))
    return both.select(*(value(c).alias(c) for c in [*keys, *values]), fresh.alias(stamp))


def relayout(rows: DataFrame, path: str, by: list[str], files: int) -> None:
    """Writes a table in files of ascending ranges, sorted within, so that a filter on its keys reads few row groups."""
    rows.repartitionByRange(files, *by).sortWithinPartitions(*by).write.mode("overwrite").parquet(path)


class Versions:
    """Builds of a table under one path: a new one is written beside the others, and readers see it once it is promoted."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._hadoop = spark._jvm.org.apache.hadoop.fs
        self._fs = self._hadoop.Path(self.path).getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())

    def _at(self, name: str):
        return self._hadoop.Path(f"{self.path}/{name}")

    def _pointer(self, name: str) -> str | None:
        if not self._fs.exists(self._at(name)):
            return None
        return self.spark.read.text(f"{self.path}/{name}").first().value

    def _point(self, name: str, build: str) -> None:
        """Writes a pointer file whole, then renames it over the old one in one step, so that readers see the one or the other."""
        out = self._fs.create(self._at(f".{name}.new"), True)
        out.write(bytearray(build.encode()))
        out.close()
        files = self._hadoop.FileContext.getFileContext(self._fs.getUri(), self.spark._jsparkSession.sessionState().newHadoopConf())
        options = self.spark._sc._gateway.new_array(self.spark._jvm.org.apache.hadoop.fs.Options.Rename, 1)
        options[0] = self.spark._jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
        files.rename(self._at(f".{name}.new"), self._at(name), options)

    def write(self, rows: DataFrame, build: str) -> None:
        rows.write.mode("error").parquet(f"{self.path}/{build}")

    def promote(self, build: str) -> None:
        """Makes a finished build the current one; what was current is the one to go back to."""
        if not self._fs.exists(self._at(f"{build}/_SUCCESS")):
            raise ValueError(f"{build} is not a finished build")
        before = self._pointer("CURRENT")
        if before:
            self._point("PREVIOUS", before)
        self._point("CURRENT", build)

    def rollback(self) -> None:
        before = self._pointer("PREVIOUS")
        if not before:
            raise ValueError("there is nothing to go back to")
        self._point("CURRENT", before)

    def read(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{self._pointer('CURRENT')}")
