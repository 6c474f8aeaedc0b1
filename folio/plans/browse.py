"""Browsing: filters, floors, ranked and paged lists, cubes, semi and anti joins."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from folio.operators import browse, catalogue, rank
from folio.session import table

PRIOR, FLOOR, SIZE = 25, 25, 250

TITLES = """titles AS (
  SELECT p_partkey AS id, p_name AS title, p_type AS kind, CAST(coalesce(v.votes, 0) AS BIGINT) AS votes,
         CAST(coalesce(v.rating, 0) AS DOUBLE) AS rating, v.year
  FROM part LEFT JOIN (
    SELECT l_partkey, count(*) AS votes, round(avg(l_discount * 100), 6) AS rating, CAST(min(year(l_shipdate)) AS INT) AS year
    FROM lineitem GROUP BY l_partkey) v ON l_partkey = p_partkey)"""
RANKED = f"""{TITLES},
prior AS (SELECT avg(rating) AS m FROM titles WHERE votes >= {PRIOR}),
ranked AS (SELECT titles.*, CASE WHEN votes > 0 AND rating > 0 THEN
  round(votes / (votes + {PRIOR}.0) * rating + {PRIOR}.0 / (votes + {PRIOR}.0) * m, 6) END AS rank FROM titles, prior),
genre AS (SELECT id, unnest(list_distinct(string_split(title, ' '))) AS genre, kind, rank, votes, year FROM ranked)"""
COLS = ("id", "title", "kind", "votes", "rank")


def ranked(spark, sf_dir):
    return rank.bayesian(catalogue.titles(spark, sf_dir), PRIOR)


def votes_floor(spark, sf_dir):
    """By votes, above the floor the policy sets."""
    return browse.page(browse.filtered(ranked(spark, sf_dir), kind=["PROMO", "LARGE"], min_votes=browse.vote_floor(floor=FLOOR)), "votes", 100).select(*COLS)


def ranked_topk(spark, sf_dir):
    """The ranked head, by rank, then votes, then id."""
    return browse.filtered(ranked(spark, sf_dir), sort="rank").orderBy(F.desc("rank"), F.desc("votes"), "id").limit(SIZE).select(*COLS)


def paged_offset(spark, sf_dir):
    """Third page of twenty and one more, which says whether there is a fourth."""
    return browse.page(browse.filtered(ranked(spark, sf_dir), genre="red"), "votes", 21, 40).select(*COLS)


def decade(spark, sf_dir):
    """Ranked within a decade; the time filter lifts the floor."""
    rows = browse.filtered(ranked(spark, sf_dir), decade=1990, sort="rank", min_votes=browse.vote_floor("rank", decade=1990))
    return browse.page(rows, "rank", 100).select(*COLS, "year")


def bayesian_rank(spark, sf_dir):
    return ranked(spark, sf_dir).select("id", "votes", "rating", "rank")


def genre_explode(spark, sf_dir):
    return browse.exploded(ranked(spark, sf_dir))


def browse_cube(spark, sf_dir):
    return browse.cube(ranked(spark, sf_dir), FLOOR)


def cube_total_vs_live(spark, sf_dir):
    """A3 A4: totals from the cube beside live counts, per genre."""
    titles = ranked(spark, sf_dir)
    cube = browse.cube(titles, FLOOR).filter("genre <> ''").groupBy("genre").agg(F.sum("n").alias("n"), F.sum("n_floor").alias("n_floor"), F.sum("n_ranked").alias("n_ranked"))
    live = browse.exploded(titles).groupBy("genre").agg(F.count("*").alias("live"), F.count_if(F.col("votes") >= FLOOR).alias("live_floor"), F.count("rank").alias("live_ranked"))
    return cube.join(live, "genre")


def top_per_kind(spark, sf_dir):
    """The best ten of each kind."""
    w = Window.partitionBy("kind").orderBy(F.desc("rank"), "id")
    return browse.filtered(ranked(spark, sf_dir), sort="rank").withColumn("place", F.row_number().over(w)).filter("place <= 10").select(*COLS, "place")


def hidden_by_floor(spark, sf_dir):
    """What the floor hides, by kind."""
    return catalogue.titles(spark, sf_dir).groupBy("kind").agg(F.count_if(F.col("votes") >= FLOOR).alias("shown"), F.count_if(F.col("votes") < FLOOR).alias("hidden"))


def _owned(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").filter("l_returnflag = 'R' AND l_quantity >= 45").select(F.col("l_partkey").alias("id"))


def exclude_owned(spark, sf_dir):
    """The ranked head without owned titles."""
    rows = browse.filtered(ranked(spark, sf_dir), sort="rank").join(_owned(spark, sf_dir), "id", "left_anti")
    return browse.page(rows, "rank", 50).select(*COLS)


def exists_semi(spark, sf_dir):
    """Customers with an urgent order."""
    urgent = table(spark, sf_dir, "orders").filter("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, sf_dir, "customer").join(urgent, "c_custkey", "left_semi").select("c_custkey", "c_name")


def not_exists_anti(spark, sf_dir):
    """Customers without an order in 1995."""
    orders = table(spark, sf_dir, "orders").filter(F.year("o_orderdate") == 1995).select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, sf_dir, "customer").join(orders, "c_custkey", "left_anti").select("c_custkey", "c_name")


def not_in_multi(spark, sf_dir):
    """Orders none of whose lines came late."""
    late = table(spark, sf_dir, "lineitem").filter("l_linestatus = 'F'").select(F.col("l_orderkey").alias("o_orderkey"))
    return table(spark, sf_dir, "orders").join(late, "o_orderkey", "left_anti").select("o_orderkey", "o_orderstatus")


def named_language(spark, sf_dir):
    """Texts of a named language by source, but not those of sources that write English as well, unless the name is English."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "lang")
    english = docs.filter("lang = 'en'").groupBy("source").agg(F.count("*").alias("n")).filter("n >= 5").select("source")
    named = [docs.filter(F.col("lang") == x).select(F.lit(x).alias("asked"), "source") for x in ("fr", "en")]
    return named[0].join(english, "source", "left_anti").select("asked", "source").unionByName(named[1]).groupBy("asked", "source").agg(F.count("*").alias("n"))


def language_any(spark, sf_dir):
    """Documents in preferred languages; unknown ones pass."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("lang", F.lit("")).alias("lang"))
    return docs.filter(F.col("lang").isin("en", "es", "")).select("doc_id", "lang")


def ranked_non_english(spark, sf_dir):
    """Long documents per language: n without those that have an English version, and outside: those of sources that do not write English mainly."""
    docs = table(spark, sf_dir, "documents")
    english = docs.filter("lang = 'en'").select("doc_id", F.lit(True).alias("english")).distinct()
    by = docs.groupBy("source").agg(F.count("*").alias("n"), F.count_if(F.col("lang") == "en").alias("en"))
    mainly = by.filter(F.col("en") * 2 > F.col("n")).select("source", F.lit(True).alias("mainly"))
    rows = docs.filter("n_chars >= 1000").join(english, "doc_id", "left").join(mainly, "source", "left")
    return rows.groupBy(F.coalesce("lang", F.lit("")).alias("lang")).agg(F.count_if(F.col("english").isNull()).alias("n"), F.count_if(F.col("mainly").isNull()).alias("outside"))


QUERIES = {
    "browse_votes_floor": (votes_floor, f"WITH {RANKED} SELECT id, title, kind, votes, rank FROM ranked WHERE kind IN ('PROMO', 'LARGE') AND votes >= {FLOOR} ORDER BY votes DESC, id LIMIT 100"),
    "browse_ranked_topk": (ranked_topk, f"WITH {RANKED} SELECT id, title, kind, votes, rank FROM ranked WHERE rank IS NOT NULL ORDER BY rank DESC, votes DESC, id LIMIT {SIZE}"),
    "browse_paged_offset": (paged_offset, f"WITH {RANKED} SELECT id, title, kind, votes, rank FROM ranked WHERE list_contains(string_split(title, ' '), 'red') ORDER BY votes DESC, id LIMIT 21 OFFSET 40"),
    "browse_decade": (decade, f"WITH {RANKED} SELECT id, title, kind, votes, rank, year FROM ranked WHERE year BETWEEN 1990 AND 1999 AND rank IS NOT NULL ORDER BY rank DESC, id LIMIT 100"),
    "bayesian_rank": (bayesian_rank, f"WITH {RANKED} SELECT id, votes, rating, rank FROM ranked"),
    "genre_explode": (genre_explode, f"WITH {RANKED} SELECT id, genre, kind, rank, votes, year FROM genre"),
    "browse_cube": (browse_cube, f"""WITH {RANKED}
      SELECT kind, genre, coalesce(year, 0) AS year, count(*) AS n, count(*) FILTER (votes >= {FLOOR}) AS n_floor, count(rank) AS n_ranked FROM genre GROUP BY 1, 2, 3
      UNION ALL SELECT kind, '', coalesce(year, 0), count(*), count(*) FILTER (votes >= {FLOOR}), count(rank) FROM ranked GROUP BY 1, 3"""),
    "cube_total_vs_live": (cube_total_vs_live, f"""WITH {RANKED} SELECT genre, count(*) AS n, count(*) FILTER (votes >= {FLOOR}) AS n_floor, count(rank) AS n_ranked,
      count(*) AS live, count(*) FILTER (votes >= {FLOOR}) AS live_floor, count(rank) AS live_ranked FROM genre GROUP BY genre"""),
    "top_per_kind": (top_per_kind, f"""WITH {RANKED} SELECT id, title, kind, votes, rank, CAST(row_number() OVER (PARTITION BY kind ORDER BY rank DESC, id) AS INT) AS place
      FROM ranked WHERE rank IS NOT NULL QUALIFY place <= 10"""),
    "hidden_by_floor": (hidden_by_floor, f"WITH {TITLES} SELECT kind, count(*) FILTER (votes >= {FLOOR}) AS shown, count(*) FILTER (votes < {FLOOR}) AS hidden FROM titles GROUP BY kind"),
    "exclude_owned": (exclude_owned, f"""WITH {RANKED} SELECT id, title, kind, votes, rank FROM ranked WHERE rank IS NOT NULL
      AND id NOT IN (SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R' AND l_quantity >= 45) ORDER BY rank DESC, id LIMIT 50"""),
    "exists_semi": (exists_semi, "SELECT c_custkey, c_name FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT')"),
    "not_exists_anti": (not_exists_anti, "SELECT c_custkey, c_name FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND year(o_orderdate) = 1995)"),
    "not_in_multi": (not_in_multi, "SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_linestatus = 'F')"),
    "named_language": (named_language, """SELECT lang AS asked, source, count(*) AS n FROM documents WHERE lang = 'en' OR lang = 'fr' AND source NOT IN
      (SELECT source FROM documents WHERE lang = 'en' GROUP BY 1 HAVING count(*) >= 5) GROUP BY 1, 2"""),
    "language_any": (language_any, "SELECT doc_id, coalesce(lang, '') AS lang FROM documents WHERE coalesce(lang, '') IN ('en', 'es', '')"),
    "ranked_non_english": (ranked_non_english, """WITH mainly AS (SELECT source FROM documents GROUP BY source HAVING 2 * count(*) FILTER (lang = 'en') > count(*))
      SELECT coalesce(lang, '') AS lang, count(*) FILTER (NOT EXISTS (SELECT 1 FROM documents e WHERE e.doc_id = d.doc_id AND e.lang = 'en')) AS n,
      count(*) FILTER (NOT EXISTS (SELECT 1 FROM mainly m WHERE m.source = d.source)) AS outside FROM documents d WHERE n_chars >= 1000 GROUP BY 1"""),
}
