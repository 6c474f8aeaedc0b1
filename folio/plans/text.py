"""Text search over titles, people and documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from folio.functions import text as T
from folio.operators import catalogue, postings, search
from folio.plans.browse import TITLES
from folio.session import few, table, temporary

ASKED = [(1, "red widget"), (2, "wdget"), (3, "blu bol"), (4, "the plate"), (5, "Hot Géar"), (6, "gizmo xyzzy"), (7, "anvl"), (8, "old")]
QUERIES_SQL = "queries(qid, query) AS (VALUES " + ", ".join(f"({i}, '{q}')" for i, q in ASKED) + ")"
STOP = ", ".join(f"'{w}'" for w in sorted(set(T.STOPWORDS)))


def norm(x: str) -> str:
    """The SQL of functions.text.normalize."""
    return f"trim(regexp_replace(lower(strip_accents(translate(replace(replace(replace(replace(lower({x}), 'æ', 'ae'), 'ß', 'ss'), 'œ', 'oe'), 'þ', 'th'), 'øđðł', 'oddl'))), '[^a-z0-9]+', ' ', 'g'))"


def words(x: str) -> str:
    return f"list_filter(string_split({norm(x)}, ' '), lambda t: t <> '')"


def grams(x: str) -> str:
    """Distinct padded trigrams of a normalised text."""
    return f"list_distinct(list_transform(range(1, length({x}) + 1), lambda i: substring(' ' || {x} || ' ', CAST(i AS INT), 3)))"


WANTED = f"{QUERIES_SQL}, wanted AS (SELECT DISTINCT qid, term FROM (SELECT qid, unnest({words('query')}) AS term FROM queries) WHERE term NOT IN ({STOP}))"
POSTINGS = f"tokens AS (SELECT p_partkey AS id, unnest({words('p_name')}) AS term, generate_subscripts({words('p_name')}, 1) AS pos FROM part)"
SIM = """sims AS (SELECT *, len(list_intersect(gq, gt)) AS shared, len(list_distinct(list_concat(gq, gt))) AS total FROM grams),
  rated AS (SELECT *, coalesce(0.65 * shared / nullif(total, 0) + 0.35 * shared / nullif(len(gq), 0), 0) AS sim FROM sims)"""


def _asked(spark):
    return spark.createDataFrame(ASKED, "qid int, query string")


def _titles(spark, sf_dir):
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("text"))


def normalize_text(spark, sf_dir):
    """2.9: every document's text in lower-case ASCII words."""
    return table(spark, sf_dir, "documents").select("doc_id", T.normalize(F.col("text")).alias("norm"))


def trigram_similarity(spark, sf_dir):
    """Similarity of every title to each of the queries that share a trigram with it."""
    titles = table(spark, sf_dir, "part").select(F.col("p_name").alias("title")).distinct()
    grams = lambda c: T.trigrams(F.col(c)).alias("grams")
    t = titles.select("title", T.normalize(F.col("title")).alias("_t")).select("title", grams("_t")).select("title", F.col("grams").alias("_gt"), F.explode("grams").alias("gram"))
    q = _asked(spark).select("qid", T.normalize(F.col("query")).alias("_q")).select("qid", grams("_q")).select("qid", F.col("grams").alias("_gq"), F.explode("grams").alias("gram"))
    pairs = t.join(few(q), "gram").select("qid", "title", "_gq", "_gt").dropDuplicates(["qid", "title"])
    return pairs.select("qid", "title", F.round(T.overlap(F.col("_gq"), F.col("_gt")), 6).alias("sim"))


def token_coverage(spark, sf_dir):
    """X11: how much of a query the titles of its candidates cover."""
    hits = search.any_word(_titles(spark, sf_dir), _asked(spark)).join(_titles(spark, sf_dir), "id").join(few(_asked(spark)), "qid")
    texts = hits.select("qid", "id", T.normalize(F.col("query")).alias("_q"), T.normalize(F.col("text")).alias("_t"))
    return texts.select("qid", "id", F.round(T.coverage(F.col("_q"), F.col("_t")), 6).alias("cov"))


def levenshtein_capped(spark, sf_dir):
    """2.9: distances of neighbouring parts' names, at most 4."""
    part = table(spark, sf_dir, "part").select("p_partkey", "p_name")
    other = part.select((F.col("p_partkey") + 1).alias("p_partkey"), F.col("p_name").alias("before"))
    return part.join(other, "p_partkey").select("p_partkey", T.capped_distance(F.col("p_name"), F.col("before"), 3).alias("distance"))


def bm25_search(spark, sf_dir):
    """The ten best documents for each benchmark item."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")
    asked = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("qid"), F.col("text").alias("query"))
    return search.bm25(docs, asked, 10).select("qid", "id", "place", "score")


def bm25_indexed(spark, sf_dir):
    """The same ten from a written index, of which the buckets of the asked words are read and the blocks that can matter added up."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")
    asked = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("qid"), F.col("text").alias("query"))
    index = postings.Postings(spark, temporary(spark)).build(docs)
    return index.search(asked, 10).select("qid", "id", "place", "score")


def prefix_and_search(spark, sf_dir):
    """All of the words, as prefixes."""
    return search.prefix_all(_titles(spark, sf_dir), _asked(spark))


def or_search(spark, sf_dir):
    """Any of the words."""
    return search.any_word(_titles(spark, sf_dir), _asked(spark))


def phrase_search(spark, sf_dir):
    """The words in this order."""
    return search.phrase(_titles(spark, sf_dir), _asked(spark))


def fuzzy_shortlist(spark, sf_dir):
    """Words of the titles' vocabulary within two edits, by the rarest trigrams of each token."""
    return search.fuzzy(search.postings(_titles(spark, sf_dir)).select("term").distinct(), _asked(spark))


def people_search(spark, sf_dir):
    """People by prefixes of all words, most credited first."""
    people = catalogue.people(spark, sf_dir).select(F.col("person_id").alias("id"), F.translate("name", "#", " ").alias("text"))
    asked = spark.createDataFrame([(1, "supp 00000000"), (2, "supplier 000000007")], "qid int, query string")
    credits = catalogue.credits(spark, sf_dir).groupBy(F.col("person_id").alias("id")).agg(F.count_distinct("title_id").alias("titles"))
    return search.top(search.prefix_all(people, asked).join(credits, "id"), 8, F.desc("titles"))


def search_scored(spark, sf_dir):
    """The ten best titles with any of the words, by similarity, match and votes."""
    titles = catalogue.titles(spark, sf_dir).select("id", "title", "votes")
    rows = search.any_word(_titles(spark, sf_dir), _asked(spark)).join(titles, "id").join(few(_asked(spark)), "qid")
    return search.top(search.scored(rows), 10, F.desc("score"), F.desc("votes")).select("qid", "id", "title", "score", "place")


BM25 = f"""WITH sized AS (SELECT doc_id AS id, {words('text')} AS ws FROM documents), whole AS (SELECT count(*) AS n, avg(len(ws)) AS mean FROM sized),
      wanted AS (SELECT DISTINCT qid, term FROM (SELECT item_id AS qid, unnest({words('text')}) AS term FROM benchmark) WHERE term NOT IN ({STOP})),
      hits AS (SELECT id, dl, term, count(*) AS tf FROM (SELECT id, len(ws) AS dl, unnest(ws) AS term FROM sized) WHERE term IN (SELECT term FROM wanted) GROUP BY ALL),
      freq AS (SELECT term, count(*) AS df FROM hits GROUP BY 1),
      scored AS (SELECT qid, id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / mean))), 4) AS score FROM hits JOIN freq USING (term) JOIN wanted USING (term), whole GROUP BY 1, 2)
      SELECT qid, id, CAST(row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS INT) AS place, score FROM scored QUALIFY place <= 10"""

QUERIES = {
    "normalize_text": (normalize_text, f"SELECT doc_id, {norm('text')} AS norm FROM documents"),
    "trigram_similarity": (trigram_similarity, f"""WITH {QUERIES_SQL}, titles AS (SELECT DISTINCT p_name AS title FROM part), n AS (SELECT qid, title, {norm('query')} AS nq, {norm('title')} AS nt FROM queries, titles),
      grams AS (SELECT qid, title, {grams('nq')} AS gq, {grams('nt')} AS gt FROM n), {SIM} SELECT qid, title, round(sim, 6) AS sim FROM rated WHERE shared > 0"""),
    "token_coverage": (token_coverage, f"""WITH {WANTED}, {POSTINGS}, hit AS (SELECT DISTINCT qid, id FROM wanted JOIN tokens USING (term)),
      n AS (SELECT qid, id, {words('query')} AS ws, {norm('p_name')} AS nt FROM hit JOIN queries USING (qid) JOIN part ON p_partkey = id)
      SELECT qid, id, round(len(list_filter(ws, lambda w: contains(nt, w))) / len(ws), 6) AS cov FROM n"""),
    "levenshtein_capped": (levenshtein_capped, """SELECT a.p_partkey, CAST(least(levenshtein(a.p_name, b.p_name), 4) AS INT) AS distance FROM part a JOIN part b ON a.p_partkey = b.p_partkey + 1"""),
    "bm25_search": (bm25_search, BM25),
    "bm25_indexed": (bm25_indexed, BM25),
    "prefix_and_search": (prefix_and_search, f"""WITH {WANTED}, {POSTINGS} SELECT qid, id FROM wanted w JOIN tokens t ON t.term = w.term OR (length(w.term) > 2 AND starts_with(t.term, w.term))
      GROUP BY qid, id HAVING count(DISTINCT w.term) = (SELECT count(*) FROM wanted x WHERE x.qid = w.qid)"""),
    "or_search": (or_search, f"WITH {WANTED}, {POSTINGS} SELECT qid, id, count(DISTINCT term) AS hits FROM wanted JOIN tokens USING (term) GROUP BY 1, 2"),
    "phrase_search": (phrase_search, f"WITH {QUERIES_SQL} SELECT qid, p_partkey AS id FROM queries JOIN part ON contains(' ' || {norm('p_name')} || ' ', ' ' || {norm('query')} || ' ')"),
    "fuzzy_shortlist": (fuzzy_shortlist, f"""WITH {WANTED}, {POSTINGS}, voc AS (SELECT DISTINCT term FROM tokens), vg AS (SELECT term, unnest({grams('term')}) AS gram FROM voc), df AS (SELECT gram, count(*) AS df FROM vg GROUP BY 1),
      tk AS (SELECT DISTINCT term AS token FROM wanted), qg AS (SELECT token, unnest({grams('token')}) AS gram FROM tk), spots AS (SELECT token, gram, strpos(' ' || token || ' ', gram) AS spot FROM qg),
      few AS (SELECT token, gram FROM spots JOIN df USING (gram) QUALIFY row_number() OVER (PARTITION BY token ORDER BY df, spot) <= 8)
      SELECT DISTINCT qid, token, v.term, CAST(levenshtein(token, v.term) AS INT) AS distance FROM few JOIN vg v USING (gram) JOIN wanted w ON w.term = token WHERE levenshtein(token, v.term) <= 2"""),
    "people_search": (people_search, """WITH q(qid, a, b) AS (VALUES (1, 'supp', '00000000'), (2, 'supplier', '000000007')), c AS (SELECT l_suppkey AS id, count(DISTINCT l_partkey) AS titles FROM lineitem GROUP BY 1)
      SELECT qid, id, titles, CAST(row_number() OVER (PARTITION BY qid ORDER BY titles DESC, id) AS INT) AS place FROM q JOIN supplier ON lower(s_name) LIKE a || '%#' || b || '%' JOIN c ON id = s_suppkey QUALIFY place <= 8"""),
    "search_scored": (search_scored, f"""WITH {WANTED}, {POSTINGS}, {TITLES}, hit AS (SELECT DISTINCT qid, id FROM wanted JOIN tokens USING (term)),
      n AS (SELECT qid, id, title, votes, {words('query')} AS ws, {norm('query')} AS nq, {norm('title')} AS nt FROM hit JOIN queries USING (qid) JOIN titles USING (id)),
      grams AS (SELECT *, {grams('nq')} AS gq, {grams('nt')} AS gt, len(list_filter(ws, lambda w: contains(nt, w))) / len(ws) AS cov FROM n), {SIM},
      t AS (SELECT *, bool_or(nq <> nt AND cov < 0.999 AND sim >= 0.7 AND votes >= 50000) OVER (PARTITION BY qid) AS twin FROM rated),
      s AS (SELECT qid, id, title, votes, round(22 * sim + CASE WHEN nq = nt THEN greatest(CASE WHEN twin THEN 0 ELSE 12 END, 14 * least(1, ln(votes + 10) / ln(50000))) WHEN starts_with(nt, nq) THEN 9 WHEN cov >= 0.999 THEN 12 ELSE 10 * cov END
        + 2.4 * ln(least(votes, 300000) + 10), 4) AS score FROM t)
      SELECT qid, id, title, score, CAST(row_number() OVER (PARTITION BY qid ORDER BY score DESC, votes DESC, id) AS INT) AS place FROM s QUALIFY place <= 10"""),
}
