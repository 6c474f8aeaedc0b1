"""Episodes of a series: a title's lines by year as seasons, in the order they were shipped."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from folio.operators import align as A
from folio.operators import catalogue
from folio.plans.browse import TITLES
from folio.session import dealt, table

AS_OF = "1998-09-01"
ORDER = ("l_shipdate", "l_orderkey", "l_linenumber", "l_suppkey", "l_extendedprice")
LABELS = {"A": "cast", "N": "cast", "R": "crew"}


def episodes(spark, sf_dir):
    """One row per episode; season 0 has the specials, an episode without rating has none."""
    season = F.year("l_shipdate") - 1995
    number = F.row_number().over(Window.partitionBy("l_partkey", season).orderBy(*ORDER))
    day = F.to_date("l_shipdate")
    lines = table(spark, sf_dir, "lineitem")
    return dealt(lines, lines.count(), "l_partkey").select(
        F.col("l_partkey").alias("series"), season.alias("season"), number.alias("number"), F.when(F.col("l_discount") > 0, F.round(F.col("l_discount") * 100, 4)).alias("rating"),
        (F.col("l_linestatus") == "F").alias("held"), (day <= F.lit(AS_OF).cast("date")).alias("aired"), F.col("l_returnflag").alias("run"), F.col("l_suppkey").alias("person"), F.col("l_quantity").alias("votes"),
    )


def episode_order(spark, sf_dir):
    """Place of every episode in its series, specials last, from zero."""
    w = Window.partitionBy("series").orderBy((F.col("season") == 0).cast("int"), "season", "number")
    return episodes(spark, sf_dir).select("series", "season", "number", (F.row_number().over(w) - 1).alias("place"))


def season_progress(spark, sf_dir):
    """Held and aired episodes of a season, what is missing, and how it stands."""
    held, aired = F.count_if(F.col("held") & F.col("aired")), F.count_if("aired")
    rows = episodes(spark, sf_dir).groupBy("series", "season").agg(held.alias("held"), aired.alias("aired"), F.count("*").alias("n"))
    standing = F.when(F.col("aired") == 0, "none").when(F.col("held") < F.col("aired"), "partial").when(F.col("aired") < F.col("n"), "current").otherwise("complete")
    return rows.select("series", "season", "held", "aired", (F.col("aired") - F.col("held")).alias("missing"), standing.alias("standing"))


def _parts(rows):
    """Adds part k of n: episodes that follow each other in a season with one run are parts of one."""
    w = Window.partitionBy("series", "season").orderBy("number")
    new = F.coalesce((F.lag("run").over(w) != F.col("run")).cast("int"), F.lit(1))
    rows = rows.withColumn("_new", new).withColumn("_run", F.sum("_new").over(w))
    one = Window.partitionBy("series", "season", "_run")
    return rows.withColumn("part", F.row_number().over(one.orderBy("number"))).withColumn("of", F.count("*").over(one).cast("int")).drop("_new", "_run")


def part_of_run(spark, sf_dir):
    """Part k of n of the episodes that one run maps to."""
    return _parts(episodes(spark, sf_dir)).select("series", "season", "number", "part", "of")


def average_rating(spark, sf_dir):
    """V2: mean rating of a season over first parts that are rated, rounded half up to a tenth."""
    mean = F.avg(F.when(F.col("part") == 1, F.col("rating")))
    return _parts(episodes(spark, sf_dir)).groupBy("series", "season").agg((F.floor(F.round(mean * 10, 6) + 0.5) / 10).alias("mean"))


def episode_grid(spark, sf_dir):
    """V3: episode numbers by season, five rows a series at most, and how many numbers are hidden."""
    cells = (F.max(F.when(F.col("season") == k, F.col("rating"))).alias(f"s{k}") for k in range(4))
    rows = episodes(spark, sf_dir).groupBy("series", "number").agg(*cells)
    return rows.withColumn("hidden", F.greatest(F.max("number").over(Window.partitionBy("series")) - 5, F.lit(0))).filter("number <= 5")


def score_join(spark, sf_dir):
    """V4: every episode with the first score that a feed has for its season and number."""
    feed = table(spark, sf_dir, "lineitem").filter("l_returnflag = 'R'").groupBy(F.col("l_partkey").alias("series"), (F.year("l_shipdate") - 1995).alias("season"), F.col("l_linenumber").alias("number"))
    first = feed.agg(F.min_by("l_tax", F.struct("l_shipdate", "l_orderkey", "l_suppkey", "l_tax")).alias("score"))
    return episodes(spark, sf_dir).select("series", "season", "number").join(first, ["series", "season", "number"], "left")


def score_timeline(spark, sf_dir):
    """V5: the span of places that each season takes up, and the bounds of the axis."""
    w = Window.partitionBy("series").orderBy("season", "number")
    rows = episodes(spark, sf_dir).withColumn("at", F.row_number().over(w) - 1).groupBy("series", "season").agg(F.min("at").alias("from"), (F.max("at") + 1).alias("to"), F.min("rating").alias("low"), F.max("rating").alias("high"))
    all_ = Window.partitionBy("series")
    return rows.select("series", "season", "from", "to", (F.floor(F.min("low").over(all_)) - 1).alias("low"), F.ceil(F.max("high").over(all_)).alias("high"))


def seasons_missing(spark, sf_dir):
    """Seasons with aired episodes that are not held, as ranges of numbers in order."""
    seasons = episodes(spark, sf_dir).filter("aired AND NOT held AND season BETWEEN 0 AND 3").select("series", "season").distinct()
    island = F.col("season") - F.row_number().over(Window.partitionBy("series").orderBy("season"))
    runs = seasons.withColumn("island", island).groupBy("series", "island").agg(F.min("season").alias("a"), F.max("season").alias("b"))
    text = F.when(F.col("a") == F.col("b"), F.col("a").cast("string")).otherwise(F.concat_ws("-", F.col("a").cast("string"), F.col("b").cast("string")))
    return runs.groupBy("series").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("a", text.alias("t")))), lambda x: x["t"]), ", ").alias("missing"))


def episode_build(spark, sf_dir):
    """Episodes of series with enough votes, numbers known, with their own rating or none."""
    series = catalogue.titles(spark, sf_dir).filter("votes >= 28").select(F.col("id").alias("series"), "title")
    return episodes(spark, sf_dir).filter("season IS NOT NULL AND number IS NOT NULL").join(series, "series").groupBy("series", "title").agg(F.count("*").alias("episodes"), F.count("rating").alias("rated"))


def episode_align(spark, sf_dir):
    """Numbers of one edition in another, which lacks what was returned and has its own order within a year."""
    letters = lambda c: F.translate(F.col(c).cast("long").cast("string"), "0123456789", "abcdefghij")
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("series"), F.year("l_shipdate").alias("season"), F.concat_ws(" ", letters("l_suppkey"), letters("l_quantity")).alias("title"), *ORDER, "l_returnflag")
    number = lambda *order: F.row_number().over(Window.partitionBy("series", "season").orderBy(*order)).alias("number")
    mine = rows.select("series", "season", "title", number(*ORDER))
    theirs = rows.filter("l_returnflag <> 'R'").select("series", "season", "title", number(F.to_date("l_shipdate"), "l_suppkey", "l_orderkey", "l_linenumber"))
    return A.align(mine, theirs)


def poster_strip(spark, sf_dir):
    """The first five rated episodes of each series in order, with their places in that list."""
    w = Window.partitionBy("series").orderBy("season", "number")
    return episodes(spark, sf_dir).filter("rating >= 5").withColumn("place", F.row_number().over(w)).filter("place <= 5").select("series", "season", "number", (F.col("place") - 1).alias("place"))


def crew_by_job(spark, sf_dir):
    """People by folded job, jobs in a fixed order, then the others by name."""
    lead = F.array(F.lit("r"), F.lit("a"))
    rows = catalogue.credits(spark, sf_dir).groupBy("title_id", F.lower("category").alias("job")).agg(F.count_distinct("person_id").alias("people"))
    at = F.nullif(F.array_position(lead, F.col("job")), F.lit(0))
    return rows.withColumn("place", F.row_number().over(Window.partitionBy("title_id").orderBy(at.asc_nulls_last(), "job")))


def merged_categories(spark, sf_dir):
    """A person's categories under merged labels, the most first, then by label."""
    label = F.create_map(*(F.lit(x) for kv in LABELS.items() for x in kv))[F.col("category")]
    rows = catalogue.credits(spark, sf_dir).groupBy("person_id", label.alias("label")).agg(F.count_distinct("title_id").alias("titles"))
    return rows.withColumn("place", F.row_number().over(Window.partitionBy("person_id").orderBy(F.desc("titles"), "label")))


EP = f"""ep AS (SELECT l_partkey AS series, CAST(year(l_shipdate) - 1995 AS INT) AS season, CAST(row_number() OVER (PARTITION BY l_partkey, year(l_shipdate) ORDER BY {", ".join(ORDER)}) AS INT) AS number,
  CASE WHEN l_discount > 0 THEN round(l_discount * 100, 4) END AS rating, l_linestatus = 'F' AS held, CAST(l_shipdate AS DATE) <= DATE '{AS_OF}' AS aired, l_returnflag AS run FROM lineitem)"""
PARTS = f"""{EP}, pn AS (SELECT *, coalesce(CAST(lag(run) OVER w <> run AS INT), 1) AS new FROM ep WINDOW w AS (PARTITION BY series, season ORDER BY number)),
  pr AS (SELECT *, sum(new) OVER (PARTITION BY series, season ORDER BY number) AS r FROM pn),
  parts AS (SELECT *, CAST(row_number() OVER (PARTITION BY series, season, r ORDER BY number) AS INT) AS part, CAST(count(*) OVER (PARTITION BY series, season, r) AS INT) AS "of" FROM pr)"""
CREDITS = "credits AS (SELECT DISTINCT l_partkey AS title_id, l_suppkey AS person_id, l_returnflag AS category FROM lineitem)"
QUERIES = {
    "episode_order": (episode_order, f"WITH {EP} SELECT series, season, number, CAST(row_number() OVER (PARTITION BY series ORDER BY season = 0, season, number) - 1 AS INT) AS place FROM ep"),
    "season_progress": (season_progress, f"""WITH {EP}, s AS (SELECT series, season, count(*) FILTER (held AND aired) AS held, count(*) FILTER (aired) AS aired, count(*) AS n FROM ep GROUP BY 1, 2)
      SELECT series, season, held, aired, aired - held AS missing, CASE WHEN aired = 0 THEN 'none' WHEN held < aired THEN 'partial' WHEN aired < n THEN 'current' ELSE 'complete' END AS standing FROM s"""),
    "part_of_run": (part_of_run, f"""WITH {PARTS} SELECT series, season, number, part, "of" FROM parts"""),
    "average_rating": (average_rating, f"WITH {PARTS} SELECT series, season, floor(round(avg(rating) FILTER (part = 1) * 10, 6) + 0.5) / 10 AS mean FROM parts GROUP BY 1, 2"),
    "episode_grid": (episode_grid, f"""WITH {EP}, g AS (SELECT series, number, max(rating) FILTER (season = 0) AS s0, max(rating) FILTER (season = 1) AS s1, max(rating) FILTER (season = 2) AS s2, max(rating) FILTER (season = 3) AS s3 FROM ep GROUP BY 1, 2),
      h AS (SELECT *, greatest(max(number) OVER (PARTITION BY series) - 5, 0) AS hidden FROM g) SELECT * FROM h WHERE number <= 5"""),
    "score_join": (score_join, f"""WITH {EP}, f AS (SELECT l_partkey AS series, year(l_shipdate) - 1995 AS season, l_linenumber AS number, l_tax AS score FROM lineitem WHERE l_returnflag = 'R'
      QUALIFY row_number() OVER (PARTITION BY l_partkey, year(l_shipdate), l_linenumber ORDER BY l_shipdate, l_orderkey, l_suppkey, l_tax) = 1)
      SELECT series, season, number, score FROM ep LEFT JOIN f USING (series, season, number)"""),
    "score_timeline": (score_timeline, f"""WITH {EP}, t AS (SELECT *, CAST(row_number() OVER (PARTITION BY series ORDER BY season, number) - 1 AS INT) AS pos FROM ep), s AS (SELECT series, season, min(pos) AS "from", max(pos) + 1 AS "to", min(rating) AS lo, max(rating) AS hi FROM t GROUP BY 1, 2)
      SELECT series, season, "from", "to", CAST(floor(min(lo) OVER w) - 1 AS BIGINT) AS low, CAST(ceil(max(hi) OVER w) AS BIGINT) AS high FROM s WINDOW w AS (PARTITION BY series)"""),
    "seasons_missing": (seasons_missing, f"""WITH {EP}, s AS (SELECT DISTINCT series, season FROM ep WHERE aired AND NOT held AND season BETWEEN 0 AND 3), i AS (SELECT *, season - row_number() OVER (PARTITION BY series ORDER BY season) AS g FROM s),
      r AS (SELECT series, min(season) AS a, max(season) AS b FROM i GROUP BY series, g) SELECT series, string_agg(CASE WHEN a = b THEN CAST(a AS VARCHAR) ELSE a || '-' || b END, ', ' ORDER BY a) AS missing FROM r GROUP BY 1"""),
    "episode_build": (episode_build, f"WITH {TITLES}, {EP} SELECT series, title, count(*) AS episodes, count(ep.rating) AS rated FROM ep JOIN titles ON id = series WHERE votes >= 28 GROUP BY 1, 2"),
    "episode_align": (episode_align, None),
    "poster_strip": (poster_strip, f"WITH {EP} SELECT series, season, number, CAST(row_number() OVER (PARTITION BY series ORDER BY season, number) - 1 AS INT) AS place FROM ep WHERE rating >= 5 QUALIFY place < 5"),
    "crew_by_job": (crew_by_job, f"""WITH {CREDITS}, j AS (SELECT title_id, lower(category) AS job, count(DISTINCT person_id) AS people FROM credits GROUP BY 1, 2)
      SELECT *, CAST(row_number() OVER (PARTITION BY title_id ORDER BY CASE job WHEN 'r' THEN 1 WHEN 'a' THEN 2 ELSE 3 END, job) AS INT) AS place FROM j"""),
    "merged_categories": (merged_categories, f"""WITH {CREDITS}, m AS (SELECT person_id, CASE WHEN category = 'R' THEN 'crew' ELSE 'cast' END AS label, count(DISTINCT title_id) AS titles FROM credits GROUP BY 1, 2)
      SELECT *, CAST(row_number() OVER (PARTITION BY person_id ORDER BY titles DESC, label) AS INT) AS place FROM m"""),
}
