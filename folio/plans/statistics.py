"""Robust statistics, cutoffs, imputation and facet counts."""

from __future__ import annotations

from pyspark.sql import functions as F

from folio.operators import catalogue, rank
from folio.plans.browse import PRIOR, RANKED, TITLES
from folio.session import saved, table

LEAST, CONFIDENCE = 30, 50
LOCALE = """loc AS (SELECT DISTINCT l_partkey AS id, s_nationkey AS locale FROM lineitem JOIN supplier ON s_suppkey = l_suppkey WHERE l_quantity >= 40)"""
BREAK = f"""{TITLES}, {LOCALE},
rows AS (SELECT t.id, locale, kind, votes, rating, year, log10(votes) AS lv FROM titles t JOIN loc USING (id) WHERE votes > 0),
r0 AS (SELECT *, count(*) OVER (PARTITION BY locale, year, kind) AS n, median(lv) OVER (PARTITION BY locale, year, kind) AS cv, median(rating) OVER (PARTITION BY locale, year, kind) AS cr FROM rows),
z0 AS (SELECT id, locale, votes, 0 AS lvl, (lv - cv) / greatest(1.4826 * median(abs(lv - cv)) OVER w, 1e-9) AS zr, (rating - cr) / greatest(1.4826 * median(abs(rating - cr)) OVER w, 1e-9) AS zl FROM r0 WHERE n >= {LEAST} WINDOW w AS (PARTITION BY locale, year, kind)),
r1 AS (SELECT *, count(*) OVER (PARTITION BY locale, year) AS n, median(lv) OVER (PARTITION BY locale, year) AS cv, median(rating) OVER (PARTITION BY locale, year) AS cr FROM rows),
z1 AS (SELECT id, locale, votes, 1 AS lvl, (lv - cv) / greatest(1.4826 * median(abs(lv - cv)) OVER w, 1e-9) AS zr, (rating - cr) / greatest(1.4826 * median(abs(rating - cr)) OVER w, 1e-9) AS zl FROM r1 WHERE n >= {LEAST} WINDOW w AS (PARTITION BY locale, year)),
r2 AS (SELECT *, count(*) OVER (PARTITION BY locale) AS n, median(lv) OVER (PARTITION BY locale) AS cv, median(rating) OVER (PARTITION BY locale) AS cr FROM rows),
z2 AS (SELECT id, locale, votes, 2 AS lvl, (lv - cv) / greatest(1.4826 * median(abs(lv - cv)) OVER w, 1e-9) AS zr, (rating - cr) / greatest(1.4826 * median(abs(rating - cr)) OVER w, 1e-9) AS zl FROM r2 WHERE n >= {LEAST} WINDOW w AS (PARTITION BY locale)),
z AS (SELECT * FROM (SELECT * FROM z0 UNION ALL SELECT * FROM z1 UNION ALL SELECT * FROM z2) QUALIFY row_number() OVER (PARTITION BY id, locale ORDER BY lvl) = 1),
scores AS (SELECT id, round(median(zr), 6) AS reach, round(median(zl * votes / (votes + {CONFIDENCE})), 6) AS love FROM z GROUP BY id)"""


def _breakout(spark, sf_dir):
    locale = table(spark, sf_dir, "lineitem").filter("l_quantity >= 40").join(table(spark, sf_dir, "supplier"), F.col("l_suppkey") == F.col("s_suppkey")).select(F.col("l_partkey").alias("id"), F.col("s_nationkey").alias("locale")).distinct()
    rows = catalogue.titles(spark, sf_dir).filter("votes > 0").join(locale, "id").select("id", "locale", "kind", "votes", "rating", "year")
    return rank.breakout(rows, [["locale", "year", "kind"], ["locale", "year"], ["locale"]], LEAST, CONFIDENCE)


def _cutoffs(scores, column, p):
    return rank.floor_percentile(scores, column, p)


def breakout_shelf(spark, sf_dir):
    """Titles beyond both percentiles, in a band of votes, outside the ranked head."""
    scores = saved(_breakout(spark, sf_dir))
    head = saved(rank.bayesian(catalogue.titles(spark, sf_dir), PRIOR).select("id", "votes", "rank"))
    limits = _cutoffs(scores, "reach", 0.6).withColumnRenamed("cutoff", "_r").join(_cutoffs(scores, "love", 0.5).withColumnRenamed("cutoff", "_l"), F.lit(True), "inner").join(rank.head_cutoff(head, "rank", 100).withColumnRenamed("cutoff", "_h"), F.lit(True), "inner")
    rows = scores.join(head, "id").join(F.broadcast(limits), F.lit(True), "inner")
    return rows.filter("reach >= _r AND love >= _l AND votes BETWEEN 20 AND 60 AND rank < _h").select("id", "reach", "love", "votes", "rank")


def percentile_cutoff(spark, sf_dir):
    """Floor-index and nearest-rank percentiles."""
    part = table(spark, sf_dir, "part")
    kinds = [("floor", rank.floor_percentile(part, "p_retailprice", 0.92)), ("nearest", rank.nearest_rank(part, "p_retailprice", 0.95))]
    a, b = (df.select(F.lit(n).alias("kind"), "cutoff") for n, df in kinds)
    return a.unionByName(b)


def rank_head_cutoff(spark, sf_dir):
    """The 250th largest rank; -1 where fewer are ranked."""
    ranked = rank.bayesian(catalogue.titles(spark, sf_dir), PRIOR)
    return rank.head_cutoff(ranked, "rank", 250).select(F.lit(250).alias("k"), "cutoff").unionByName(rank.head_cutoff(ranked, "rank", 10_000_000).select(F.lit(10_000_000).alias("k"), "cutoff"))


def quantile_impute(spark, sf_dir):
    """Votes of recent titles at the popularity quantile of settled ones, kept if higher."""
    titles = saved(catalogue.titles(spark, sf_dir).join(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_retailprice").alias("popularity")), "id").select("id", "year", "votes", "popularity"))
    reference = titles.filter("year <= 1995 AND votes > 0").select("popularity", "votes")
    targets = titles.filter("year > 1995").select("id", "popularity", "votes")
    return rank.impute(reference, targets).join(targets, "id").filter("imputed > votes").select("id", "votes", "imputed")


def facet_counts(spark, sf_dir):
    """Facets of a candidate set: genre, decade, year, kind, each with its own order and size."""
    rows = catalogue.titles(spark, sf_dir).filter("votes >= 28")
    genre = rows.select(F.explode("genres").alias("value")).groupBy("value").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "value").limit(10)
    year = rows.filter("year IS NOT NULL").groupBy(F.col("year").cast("string").alias("value")).agg(F.count("*").alias("n")).orderBy(F.desc("value")).limit(10)
    decade = rows.filter("year IS NOT NULL").groupBy((F.floor(F.col("year") / 10) * 10).cast("string").alias("value")).agg(F.count("*").alias("n")).orderBy(F.desc("value"))
    kind = rows.groupBy(F.col("kind").alias("value")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "value").limit(5)
    out = [df.select(F.lit(name).alias("facet"), "value", "n") for name, df in (("genre", genre), ("decade", decade), ("year", year), ("kind", kind))]
    return out[0].unionByName(out[1]).unionByName(out[2]).unionByName(out[3])


def shelf_genres(spark, sf_dir):
    """The commonest genres of titles that many rated well."""
    return catalogue.titles(spark, sf_dir).filter("votes >= 25 AND rating >= 5").select(F.explode("genres").alias("genre")).groupBy("genre").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "genre").limit(12)


def hidden_gems(spark, sf_dir):
    """Well rated in a band of votes; also the older score, rating times log votes."""
    rows = catalogue.titles(spark, sf_dir).filter("votes BETWEEN 20 AND 30 AND rating >= 5")
    return rows.orderBy(F.desc("rating"), F.desc("votes"), "id").limit(50).select("id", "rating", "votes", F.round(F.col("rating") * F.ln("votes"), 6).alias("score"))


QUERIES = {
    "breakout_scores": (_breakout, f"WITH {BREAK} SELECT id, reach, love FROM scores"),
    "breakout_shelf": (breakout_shelf, f"""WITH RECURSIVE {BREAK}, r AS (SELECT titles.*, CASE WHEN votes > 0 AND rating > 0 THEN round(votes / (votes + {PRIOR}.0) * rating + {PRIOR}.0 / (votes + {PRIOR}.0) * (SELECT avg(rating) FROM titles WHERE votes >= {PRIOR}), 6) END AS rank FROM titles),
      o AS (SELECT *, row_number() OVER (ORDER BY reach) - 1 AS ir, row_number() OVER (ORDER BY love) - 1 AS il, count(*) OVER () AS n FROM scores)
      SELECT s.id, s.reach, s.love, votes, rank FROM scores s JOIN r ON r.id = s.id
      WHERE s.reach >= (SELECT reach FROM o WHERE ir = least(n - 1, CAST(floor(n * 0.6) AS BIGINT))) AND s.love >= (SELECT love FROM o WHERE il = least(n - 1, CAST(floor(n * 0.5) AS BIGINT)))
      AND votes BETWEEN 20 AND 60 AND rank < (SELECT rank FROM r WHERE rank IS NOT NULL ORDER BY rank DESC LIMIT 1 OFFSET 99)"""),
    "percentile_cutoff": (percentile_cutoff, """WITH o AS (SELECT p_retailprice AS v, row_number() OVER (ORDER BY p_retailprice) - 1 AS i, count(*) OVER () AS n FROM part)
      SELECT 'floor' AS kind, v AS cutoff FROM o WHERE i = least(n - 1, CAST(floor(n * 0.92) AS BIGINT)) UNION ALL SELECT 'nearest', v FROM o WHERE i = greatest(CAST(ceil(n * 0.95) AS BIGINT) - 1, 0)"""),
    "rank_head_cutoff": (rank_head_cutoff, f"WITH {RANKED}, o AS (SELECT rank, row_number() OVER (ORDER BY rank DESC) AS i FROM ranked WHERE rank IS NOT NULL) SELECT k, coalesce((SELECT rank FROM o WHERE i = k), -1.0) AS cutoff FROM (VALUES (250), (10000000)) ks(k)"),
    "quantile_impute": (quantile_impute, f"""WITH {TITLES}, p AS (SELECT t.id, t.votes, t.year, p_retailprice AS pop FROM titles t JOIN part ON p_partkey = t.id), ref AS (SELECT * FROM p WHERE year <= 1995 AND votes > 0),
      byv AS (SELECT votes, row_number() OVER (ORDER BY votes) - 1 AS i FROM ref), tgt AS (SELECT id, votes, (SELECT count(*) FROM ref WHERE ref.pop < p.pop) AS lo FROM p WHERE year > 1995)
      SELECT id, tgt.votes, byv.votes AS imputed FROM tgt JOIN byv ON i = least(lo, (SELECT count(*) FROM ref) - 1) WHERE byv.votes > tgt.votes"""),
    "facet_counts": (facet_counts, f"""WITH {TITLES}, c AS (SELECT * FROM titles WHERE votes >= 28)
      SELECT * FROM (SELECT 'genre' AS facet, value, count(*) AS n FROM (SELECT unnest(list_distinct(string_split(title, ' '))) AS value FROM c) GROUP BY 2 ORDER BY n DESC, value LIMIT 10)
      UNION ALL SELECT 'decade', CAST(year // 10 * 10 AS VARCHAR), count(*) FROM c WHERE year IS NOT NULL GROUP BY 2
      UNION ALL SELECT * FROM (SELECT 'year', CAST(year AS VARCHAR) AS v, count(*) FROM c WHERE year IS NOT NULL GROUP BY 2 ORDER BY v DESC LIMIT 10)
      UNION ALL SELECT * FROM (SELECT 'kind', kind, count(*) AS n FROM c GROUP BY 2 ORDER BY n DESC, kind LIMIT 5)"""),
    "shelf_genres": (shelf_genres, f"WITH {TITLES} SELECT genre, count(*) AS n FROM (SELECT unnest(list_distinct(string_split(title, ' '))) AS genre FROM titles WHERE votes >= 25 AND rating >= 5) GROUP BY 1 ORDER BY n DESC, genre LIMIT 12"),
    "hidden_gems": (hidden_gems, f"WITH {TITLES} SELECT id, rating, votes, round(rating * ln(votes), 6) AS score FROM titles WHERE votes BETWEEN 20 AND 30 AND rating >= 5 ORDER BY rating DESC, votes DESC, id LIMIT 50"),
}
