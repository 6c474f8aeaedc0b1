"""Filtered browsing over the catalogue, and totals from a precomputed cube."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ANY = ""  # the genre of the any-genre grain
UNKNOWN_YEAR = 0


def vote_floor(sort: str = "votes", year: int | None = None, years: tuple[int, int] | None = None, decade: int | None = None, floor: int = 1000) -> int:
    """The votes a browsed title needs: none when ranked or when a time filter already narrows the list."""
    return 0 if sort == "rank" or year is not None or years is not None or decade is not None else floor


def filtered(titles: DataFrame, genre=None, kind=None, year=None, years=None, decade=None, min_votes: int = 0, sort: str = "votes") -> DataFrame:
    """The conjunction of the filters; year wins over years, years over decade; ranked lists need a rank."""
    if genre is not None:
        titles = titles.filter(F.array_contains("genres", genre))
    if kind is not None:
        titles = titles.filter(F.col("kind").isin(kind) if isinstance(kind, (list, tuple)) else F.col("kind") == kind)
    if year is not None:
        titles = titles.filter(F.col("year") == year)
    elif years is not None:
        titles = titles.filter(F.col("year").between(*years))
    elif decade is not None:
        titles = titles.filter(F.col("year").between(decade, decade + 9))
    if min_votes > 0:
        titles = titles.filter(F.col("votes") >= min_votes)
    return titles.filter(F.col("rank").isNotNull()) if sort == "rank" else titles


def page(titles: DataFrame, sort: str, limit: int, offset: int = 0) -> DataFrame:
    return titles.orderBy(F.desc(sort), "id").offset(offset).limit(limit)


def exploded(titles: DataFrame) -> DataFrame:
    """One row per title and genre, with the columns genre filters need."""
    return titles.select("id", F.explode("genres").alias("genre"), "kind", "rank", "votes", "year")


def cube(titles: DataFrame, floor: int) -> DataFrame:
    """n, n_floor, n_ranked by (kind, genre, year), and by (kind, year) as the any-genre grain.

    The second grain is counted over titles, never summed over genres, so a title with two genres counts once.
    """
    measures = (F.count("*").alias("n"), F.count_if(F.col("votes") >= floor).alias("n_floor"), F.count_if(F.col("rank").isNotNull()).alias("n_ranked"))
    year = F.coalesce("year", F.lit(UNKNOWN_YEAR)).alias("year")
    by_genre = exploded(titles).groupBy("kind", "genre", year).agg(*measures)
    return by_genre.unionByName(titles.groupBy("kind", F.lit(ANY).alias("genre"), year).agg(*measures))


def cube_total(cube_: DataFrame, genre: str = ANY, kind: str | None = None, years: tuple[int, int] | None = None, column: str = "n") -> DataFrame:
    """The total of a filter the cube can express, as one row (total)."""
    cells = cube_.filter(F.col("genre") == genre)
    if kind is not None:
        cells = cells.filter(F.col("kind") == kind)
    if years is not None:
        cells = cells.filter(F.col("year").between(*years))
    return cells.agg(F.coalesce(F.sum(column), F.lit(0)).alias("total"))


def project(rows: DataFrame, wanted: dict[str, Column | None]) -> DataFrame:
    """The wanted columns; one that the table lacks is its stand-in, and without a stand-in an error."""
    return rows.select(*(F.col(c) if c in rows.columns or other is None else other.alias(c) for c, other in wanted.items()))
