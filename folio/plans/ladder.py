"""The search ladder: what a query means, its signals, the gate and the tiers."""

from __future__ import annotations

from pyspark.sql import functions as F

from folio.functions import queries as Q
from folio.operators import catalogue, search
from folio.plans import text
from folio.plans.browse import TITLES
from folio.session import few, table

YEAR = 1996
WANT = [(1, "red widget", 1995, None, "movie"), (2, "blue bolt", None, 1990, None), (3, "hot gear", 1996, None, "tvSeries"), (4, "old plate", 2010, None, None), (5, "gizmo", None, None, "movie"), (6, "anvil", None, 1980, None)]
LADDER = [(1, "red widget"), (2, "red bolt 1995"), (3, '"hot gear"'), (4, "the"), (5, "wdget"), (6, "gizmo xyzzy"), (7, "small rings movie"), (8, "of the")]
TYPED = [(1, '"the office" s02e05 1080p'), (2, "best 90s comedies"), (3, "new french films"), (4, "blade runner 2049 (2017)"), (5, "2012"), (6, "breaking bad season 3")]
COLUMNS = "qid int, query string, want_year int, want_decade int, want_kind string"


def _scored(spark, sf_dir):
    kind = F.when(F.col("kind") == "PROMO", "movie").when(F.col("kind") == "LARGE", "tvSeries").otherwise("other")
    titles = catalogue.titles(spark, sf_dir).select("id", "title", "votes", "year", kind.alias("kind"), (F.col("votes") + F.length("title")).alias("buzz"))
    asked = spark.createDataFrame(WANT, COLUMNS)
    found = search.any_word(text._titles(spark, sf_dir), asked.select("qid", "query")).select("qid", "id")
    return search.signalled(found.join(titles, "id").join(few(asked), "qid"), YEAR)


def search_signals(spark, sf_dir):
    """Hits by similarity, match, votes or expected votes, year, kind and recency; ties by year, then id."""
    return search.top(_scored(spark, sf_dir), 10, F.desc("score"), F.coalesce("year", F.lit(0)).desc()).select("qid", "id", "score", "place")


def candidate_window(spark, sf_dir):
    """The candidates by text rank and votes together, a window of forty for each query."""
    docs = text._titles(spark, sf_dir)
    votes = catalogue.titles(spark, sf_dir).select("id", "votes")
    hits = search.bm25(docs, text._asked(spark), 1_000_000).join(votes, "id").withColumn("value", F.round(F.col("score") + 1.6 * F.ln(F.col("votes") + 10), 4))
    return search.top(hits.drop("place"), 40, F.desc("value")).select("qid", "id", "value", "place")


def search_gate(spark, sf_dir):
    """Whether the hits of a query are weak, so that it climbs on."""
    titles = catalogue.titles(spark, sf_dir).select("id", "title", "votes")
    rows = search.any_word(text._titles(spark, sf_dir), text._asked(spark)).join(titles, "id").join(few(text._asked(spark)), "qid")
    return search.weak(search.top(search.scored(rows), 2, F.desc("score"), F.desc("votes")), 30)


def stopword_prefix(spark, sf_dir):
    """Popular documents' beginnings for queries of stopwords only."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("title"), F.col("n_chars").alias("votes"))
    return search.stopword_hits(docs, spark.createDataFrame([(1, "the"), (2, "Der"), (3, "el"), (4, "red")], "qid int, query string"), 1000)


def search_ladder(spark, sf_dir):
    """Eight queries up the ladder."""
    titles = catalogue.titles(spark, sf_dir).select("id", "title", "votes")
    return search.ladder(titles, spark.createDataFrame(LADDER, "qid int, query string"), 10, 30, 20)


def parse_query(spark, sf_dir):
    """Signals of typed queries, and of every benchmark item as a query of bounded length."""
    typed = spark.createDataFrame(TYPED, "qid long, query string").unionByName(table(spark, sf_dir, "benchmark").select((F.col("item_id") + 1000).alias("qid"), Q.bounded(F.col("text")).alias("query")))
    return Q.parse(typed, "query", 2024).select("qid", "parsed.text", "parsed.year", "parsed.decade", "parsed.kind", "parsed.season", "parsed.episode", "parsed.exact")


def browse_intent(spark, sf_dir):
    """The shelf that a query asks for, if it asks for one."""
    typed = spark.createDataFrame(TYPED, "qid int, query string")
    return Q.intent(typed, "query", 2024).filter("intent IS NOT NULL").select("qid", "intent.*")


def phonetic_shortlist(spark, sf_dir):
    """Words of the titles that sound like the query's."""
    words = search.postings(text._titles(spark, sf_dir)).select("term").distinct()
    return search.sounds_like(words, spark.createDataFrame([(1, "boltt"), (2, "gere"), (3, "widjit")], "qid int, query string"), 5)


WANT_SQL = "queries(qid, query, want_year, want_decade, want_kind) AS (VALUES " + ", ".join("(" + ", ".join("NULL" if x is None else repr(x) for x in r) + ")" for r in WANT) + ")"
Q0 = text.QUERIES_SQL
STOPS = f"wanted AS (SELECT DISTINCT qid, term FROM (SELECT qid, unnest({text.words('query')}) AS term FROM queries) WHERE term NOT IN ({text.STOP}))"
PARTS = f"grams AS (SELECT *, {text.grams('nq')} AS gq, {text.grams('nt')} AS gt, len(list_filter(ws, lambda w: contains(nt, w))) / len(ws) AS cov FROM n), {text.SIM}, t AS (SELECT *, bool_or(nq <> nt AND cov < 0.999 AND sim >= 0.7 AND votes >= 50000) OVER (PARTITION BY qid) AS twin FROM rated)"
MATCH = "CASE WHEN nq = nt THEN greatest(CASE WHEN twin THEN 0 ELSE 12 END, 14 * least(1, ln(votes + 10) / ln(50000))) WHEN starts_with(nt, nq) THEN 9 WHEN cov >= 0.999 THEN 12 ELSE 10 * cov END"
SAT = "2.4 * ln(least(votes, 300000) + 10)"
QUERIES = {
    "search_signals": (search_signals, f"""WITH {WANT_SQL}, {STOPS}, {text.POSTINGS}, {TITLES}, hit AS (SELECT DISTINCT qid, id FROM wanted JOIN tokens USING (term)),
      n AS (SELECT qid, id, votes + length(title) AS votes, year, CASE kind WHEN 'PROMO' THEN 'movie' WHEN 'LARGE' THEN 'tvSeries' ELSE 'other' END AS kind, want_year, want_decade, want_kind, {text.words('query')} AS ws, {text.norm('query')} AS nq, {text.norm('title')} AS nt
        FROM hit JOIN queries USING (qid) JOIN titles USING (id)), {PARTS},
      s AS (SELECT qid, id, year, round(round(22 * sim + {MATCH} + {SAT}, 4)
        + CASE WHEN year IS NULL OR abs(year - {YEAR}) > 5 THEN 0 ELSE pow(2, -pow(greatest(0, abs(year - {YEAR}) - CASE WHEN year >= {YEAR} THEN 1 ELSE 0 END), 2)) END * greatest(0, 2.4 * ln(1510) - {SAT})
        + CASE WHEN year IS NULL THEN CASE WHEN want_year IS NOT NULL OR want_decade IS NOT NULL THEN -4 ELSE 0 END WHEN want_year IS NOT NULL THEN CASE abs(year - want_year) WHEN 0 THEN 9 WHEN 1 THEN 6 WHEN 2 THEN 3 ELSE CASE WHEN abs(year - want_year) <= 5 THEN 0.5 ELSE -6 END END
          WHEN want_decade IS NOT NULL THEN CASE WHEN year BETWEEN want_decade AND want_decade + 9 THEN 6 ELSE -5 END ELSE 0 END
        + CASE WHEN want_kind IS NULL THEN 0 WHEN kind = want_kind THEN 4 ELSE -5 END + CASE WHEN year >= 2015 THEN 1.2 WHEN year >= 2000 THEN 0.4 ELSE 0 END
        - CASE WHEN nq = nt AND want_year IS NOT NULL AND year IS NOT NULL AND abs(year - want_year) > 2 THEN least(14, greatest(12, 14 * ln(votes + 10) / ln(50000))) ELSE 0 END, 4) AS score FROM t)
      SELECT qid, id, score, CAST(row_number() OVER (PARTITION BY qid ORDER BY score DESC, coalesce(year, 0) DESC, id) AS INT) AS place FROM s QUALIFY place <= 10"""),
    "candidate_window": (candidate_window, f"""WITH {Q0}, {STOPS}, {TITLES}, sized AS (SELECT p_partkey AS id, {text.words('p_name')} AS ws FROM part), whole AS (SELECT count(*) AS n, avg(len(ws)) AS mean FROM sized),
      hits AS (SELECT id, dl, term, count(*) AS tf FROM (SELECT id, len(ws) AS dl, unnest(ws) AS term FROM sized) WHERE term IN (SELECT term FROM wanted) GROUP BY ALL), freq AS (SELECT term, count(*) AS df FROM hits GROUP BY 1),
      s AS (SELECT qid, id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / mean))), 4) AS score FROM hits JOIN freq USING (term) JOIN wanted USING (term), whole GROUP BY 1, 2),
      v AS (SELECT qid, id, round(score + 1.6 * ln(votes + 10), 4) AS value FROM s JOIN titles USING (id))
      SELECT qid, id, value, CAST(row_number() OVER (PARTITION BY qid ORDER BY value DESC, id) AS INT) AS place FROM v QUALIFY place <= 40"""),
    "search_gate": (search_gate, f"""WITH {Q0}, {STOPS}, {text.POSTINGS}, {TITLES}, hit AS (SELECT DISTINCT qid, id FROM wanted JOIN tokens USING (term)),
      n AS (SELECT qid, id, votes, {text.words('query')} AS ws, {text.norm('query')} AS nq, {text.norm('title')} AS nt FROM hit JOIN queries USING (qid) JOIN titles USING (id)), {PARTS},
      s AS (SELECT qid, votes, cov, round(22 * sim + {MATCH} + {SAT}, 4) AS score, id FROM t), o AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, votes DESC, id) AS p FROM s),
      w AS (SELECT qid, max(score) FILTER (p = 1) AS s1, max(score) FILTER (p = 2) AS s2, max(cov) FILTER (p = 1) AS c, max(votes) FILTER (p = 1) AS v FROM o GROUP BY 1)
      SELECT qid, s1 < 20 OR c < 0.6 OR v < 30 OR coalesce(s1 - s2 < 1 AND s1 < 26, false) AS weak FROM w"""),
    "stopword_prefix": (stopword_prefix, "SELECT qid, doc_id AS id FROM (VALUES (1, 'the'), (2, 'der'), (3, 'el')) q(qid, query) JOIN documents ON starts_with(lower(text), query) AND split_part(lower(text), ' ', 1) = query WHERE n_chars >= 1000"),
    "search_ladder": (search_ladder, None),
    "parse_query": (parse_query, None),
    "browse_intent": (browse_intent, None),
    "phonetic_shortlist": (phonetic_shortlist, None),
}
