"""Batch text search: postings, BM25, prefix, any-word, phrase and fuzzy candidates, and the scorer.

Queries come as a table (qid, query); every step is an equi-join on terms, edge prefixes or trigrams,
so a batch of queries costs one pass over the postings. Top lists are row numbers per query, which
Spark limits before the shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folio.functions import keys as K
from folio.functions import queries as Q
from folio.functions import text as T
from folio.session import few, saved

K1, B, RAREST, REACH = 1.2, 0.75, 8, 2


def positions(docs: DataFrame, body: str = "text") -> DataFrame:
    """(id, pos, term) of documents (id, body)."""
    return docs.select("id", F.posexplode(T.tokens(T.normalize(F.col(body)))).alias("pos", "term"))


def postings(docs: DataFrame, body: str = "text") -> DataFrame:
    """(term, id, tf)."""
    return positions(docs, body).groupBy("term", "id").agg(F.count("*").alias("tf"))


def query_terms(queries: DataFrame) -> DataFrame:
    """(qid, term): distinct tokens of each query that are no stopwords."""
    terms = queries.select("qid", F.explode(F.array_distinct(T.tokens(T.normalize(F.col("query"))))).alias("term"))
    return terms.filter(~F.col("term").isin(T.STOPWORDS))


def top(rows: DataFrame, k: int, *order) -> DataFrame:
    """The first k rows of each query in an order that ends in the id."""
    place = F.row_number().over(Window.partitionBy("qid").orderBy(*order, "id"))
    return rows.withColumn("place", place).filter(F.col("place") <= k)


def counted(docs: DataFrame, body: str = "text") -> DataFrame:
    """(id, len, terms, tfs): each text's length, its different terms and how often it has each. Texts are normalised once and counted where they are read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column("terms")
            code = lists.flatten().dictionary_encode()
            n = max(len(code.dictionary), 1)
            cells, tfs = np.unique(pc.list_parent_indices(lists).to_numpy().astype(np.int64) * n + code.indices.to_numpy(), return_counts=True)
            at = pa.array(np.searchsorted(cells // n, np.arange(b.num_rows + 1)).astype(np.int32))
            terms = code.dictionary.take(pa.array(cells % n))
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("len"), pa.ListArray.from_arrays(at, terms), pa.ListArray.from_arrays(at, pa.array(tfs, pa.int32()))], names=["id", "len", "terms", "tfs"])

    texts = docs.select("id", T.tokens(T.normalize(F.col(body))).alias("terms")).select("id", F.size("terms").alias("len"), "terms")
    return texts.mapInArrow(run, f"id {dict(docs.dtypes)['id']}, len int, terms array<string>, tfs array<int>")


def entries(counts: DataFrame) -> DataFrame:
    """(id, len, term, tf) of counted texts."""
    return counts.select("id", "len", F.inline(F.arrays_zip(F.col("terms").alias("term"), F.col("tfs").alias("tf"))).alias("term", "tf"))


def bm25(docs: DataFrame, queries: DataFrame, k: int, body: str = "text") -> DataFrame:
    """(qid, id, score, place): the k best documents of each query.

    Texts are counted once. Queried terms with their rarity go to the postings if they are few, so that postings meet them where they are
    and only sums by query and document move.
    """
    counts = saved(counted(docs, body))
    whole = counts.agg(F.count("*").alias("n"), F.avg("len").alias("mean"))
    wanted = saved(query_terms(queries))
    hits = entries(counts).join(few(wanted.select("term").distinct()), "term", "left_semi")
    df = hits.groupBy("term").agg(F.count("*").alias("df"))
    idf = F.ln(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    asked = saved(wanted.join(df, "term").join(F.broadcast(whole), F.lit(True), "inner").select("qid", "term", "mean", idf.alias("idf")))
    part = F.col("idf") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("len") / F.col("mean")))
    scored = entries(counts).join(few(asked), "term").withColumn("part", part).groupBy("qid", "id").agg(F.round(F.sum("part"), 4).alias("score"))
    return top(scored, k, F.desc("score"))


def prefix_all(docs: DataFrame, queries: DataFrame, body: str = "text") -> DataFrame:
    """(qid, id): documents with a word for every token of the query; a token of three letters or more is a prefix."""
    return _prefixed(postings(docs, body).select("term", "id"), queries)


def _prefixed(found: DataFrame, queries: DataFrame) -> DataFrame:
    vocabulary = found.select("term").distinct()
    edges = vocabulary.select("term", F.explode(F.transform(F.sequence(F.lit(1), F.length("term")), lambda i: F.substring("term", F.lit(1), i))).alias("token")).filter((F.length("token") > 2) | (F.col("token") == F.col("term")))
    wanted = query_terms(queries).withColumnRenamed("term", "token")
    need = wanted.groupBy("qid").agg(F.count("*").alias("need"))
    meant = saved(wanted.join(edges, "token"))
    have = found.join(few(meant), "term").groupBy("qid", "id").agg(F.count_distinct("token").alias("have"))
    return have.join(need, "qid").filter("have = need").select("qid", "id")


def any_word(docs: DataFrame, queries: DataFrame, body: str = "text") -> DataFrame:
    """(qid, id, hits): documents with any of the query's words, and how many of them."""
    return _any(positions(docs, body).select("term", "id"), queries)


def _any(found: DataFrame, queries: DataFrame) -> DataFrame:
    return found.join(few(query_terms(queries)), "term").groupBy("qid", "id").agg(F.count_distinct("term").alias("hits"))


def phrase(docs: DataFrame, queries: DataFrame, body: str = "text") -> DataFrame:
    """(qid, id): documents that hold the query's words one after the other, stopwords included."""
    words = queries.select("qid", F.posexplode(T.tokens(T.normalize(F.col("query")))).alias("at", "term"))
    need = words.groupBy("qid").agg(F.count("*").alias("need"))
    runs = positions(docs, body).join(few(words), "term").groupBy("qid", "id", (F.col("pos") - F.col("at")).alias("start")).agg(F.count("*").alias("have"))
    return runs.join(need, "qid").filter("have = need").select("qid", "id").distinct()


def fuzzy(vocabulary: DataFrame, queries: DataFrame, rarest: int = RAREST, reach: int = REACH) -> DataFrame:
    """(qid, token, term, distance): words of a vocabulary (term) near each token, found by its rarest trigrams."""
    grams = vocabulary.select("term", F.explode(T.trigrams(F.col("term"))).alias("gram"))
    df = grams.groupBy("gram").agg(F.count("*").alias("df"))
    tokens = query_terms(queries).withColumnRenamed("term", "token")
    asked = tokens.select("token").distinct().select("token", F.posexplode(T.trigrams(F.col("token"))).alias("at", "gram")).join(df, "gram")
    order = Window.partitionBy("token").orderBy("df", "at")
    few = asked.withColumn("r", F.row_number().over(order)).filter(F.col("r") <= rarest).select("token", "gram")
    near = few.join(grams, "gram").select("token", "term").distinct().withColumn("distance", F.levenshtein("token", "term", reach)).filter("distance >= 0")
    return tokens.join(near, "token").select("qid", "token", "term", "distance")


def scored(candidates: DataFrame) -> DataFrame:
    """Adds score to (qid, id, query, title, votes): similarity, match term and popularity.

    The match term is the first that holds: exact, prefix, full coverage, coverage in part. An exact match is worth 12
    unless the query looks like a mistyped popular title, and up to 14 by its own votes.
    """
    return _scored(candidates).drop("_q", "_t")


def _rated(candidates: DataFrame) -> DataFrame:
    """Adds _q and _t (query and title, normalised), _sim and _cov: each text is normalised and cut into trigrams once a row, in columns of their own."""
    texts = candidates.select("*", T.normalize(F.col("query")).alias("_q"), T.normalize(F.col("title")).alias("_t"))
    grams = texts.select("*", T.trigrams(F.col("_q")).alias("_gq"), T.trigrams(F.col("_t")).alias("_gt"))
    return grams.select("*", T.overlap(F.col("_gq"), F.col("_gt")).alias("_sim"), T.coverage(F.col("_q"), F.col("_t")).alias("_cov")).drop("_gq", "_gt")


def _scored(candidates: DataFrame) -> DataFrame:
    candidates = saved(candidates)
    near = (F.col("_q") != F.col("_t")) & (F.col("_cov") < 0.999) & (F.col("_sim") >= 0.7)
    # Summed up, not filtered: a filter would go below the columns and repeat what they are made of.
    twin = _rated(candidates.filter("votes >= 50000")).groupBy("qid").agg(F.bool_or(near).alias("_twin"))
    rows = _rated(candidates).join(twin, "qid", "left")
    exact = F.greatest(F.when(F.col("_twin"), 0.0).otherwise(12.0), 14 * F.least(F.lit(1.0), F.ln(F.col("votes") + 10) / F.ln(F.lit(50_000.0))))
    match = F.when(F.col("_q") == F.col("_t"), exact).when(F.startswith("_t", "_q"), 9.0).when(F.col("_cov") >= 0.999, 12.0).otherwise(10 * F.col("_cov"))
    popular = 2.4 * F.ln(F.least("votes", F.lit(300_000)) + 10)
    return rows.withColumn("score", F.round(22 * F.col("_sim") + match + popular, 4)).withColumn("coverage", F.col("_cov")).drop("_sim", "_cov", "_twin")


def signalled(hits: DataFrame, this_year: int) -> DataFrame:
    """Adds to the score of (qid, title, votes, buzz, year, kind, query, want_year, want_decade, want_kind) what year, kind, recency and anticipation say.

    Votes that are only expected count as far as the title is looked forward to. A name that matches whole but is of another
    year than asked loses its match.
    """
    year, want = F.col("year"), F.col("want_year")
    base = _scored(hits.withColumn("votes", F.greatest("votes", F.col("buzz"))))
    sat = lambda v: 2.4 * F.ln(F.least(v, F.lit(300_000)) + 10)
    ahead = Q.anticipation(year, this_year) * F.greatest(F.lit(0.0), sat(F.lit(1500)) - sat(F.col("votes")))
    wrong = (F.col("_q") == F.col("_t")) & want.isNotNull() & year.isNotNull() & (F.abs(year - want) > 2)
    lost = F.when(wrong, F.least(F.lit(14.0), F.greatest(F.lit(12.0), 14 * F.ln(F.col("votes") + 10) / F.ln(F.lit(50_000.0))))).otherwise(0.0)
    more = ahead + Q.year_score(year, want, F.col("want_decade")) + Q.kind_score(F.col("kind"), F.col("want_kind")) + Q.recency_score(year)
    return base.withColumn("score", F.round(F.col("score") + more - lost, 4)).drop("_q", "_t")


def stopword_hits(titles: DataFrame, queries: DataFrame, floor: int) -> DataFrame:
    """(qid, id): popular titles that begin with a query of stopwords only, whatever the case; such a query is not looked for in any other way."""
    asked = queries.filter(K.stopword_only(F.col("query"))).select("qid", F.lower(F.trim("query")).alias("_q"))
    first = titles.filter(F.col("votes") >= floor).select("id", F.lower("title").alias("_t"))
    words = lambda c: F.split(c, " ")[0]
    near = asked.withColumn("_w", words(F.col("_q"))).join(first.withColumn("_w", words(F.col("_t"))), "_w")
    return near.filter(F.startswith("_t", "_q")).select("qid", "id")


def weak(hits: DataFrame, votes: int) -> DataFrame:
    """(qid, weak) of ranked hits (qid, score, coverage, votes, place): a low score, little coverage, few votes, or no clear winner."""
    of = lambda k, c: F.max(F.when(F.col("place") == k, F.col(c)))
    top_ = hits.filter("place <= 2").groupBy("qid").agg(of(1, "score").alias("s1"), of(2, "score").alias("s2"), of(1, "coverage").alias("c"), of(1, "votes").alias("v"))
    close = F.coalesce((F.col("s1") - F.col("s2") < 1.0) & (F.col("s1") < 26), F.lit(False))
    return top_.select("qid", ((F.col("s1") < 20) | (F.col("c") < 0.6) | (F.col("v") < votes) | close).alias("weak"))


def ladder(titles: DataFrame, queries: DataFrame, k: int, votes: int, floor: int) -> DataFrame:
    """(qid, id, tier, score, place): hits of the first tiers that are not weak; titles (id, title, votes), queries (qid, query).

    Stopword queries and quoted ones have a tier of their own. The others climb: all words, any word, near words; a query
    climbs on only while its hits are weak, and each hit keeps the first tier that found it.
    """
    titles = saved(titles)
    docs = titles.select("id", F.col("title").alias("text"))
    parsed = saved(Q.parse(queries, "query", 2024).select("qid", F.col("parsed.text").alias("query"), F.col("parsed.exact").alias("exact"), K.stopword_only(F.col("query")).alias("stop")))
    climbers = parsed.filter("NOT stop AND NOT exact").select("qid", "query")
    terms = saved(postings(docs).select("term", "id"))

    def near_words(open_):
        near = saved(fuzzy(terms.select("term").distinct(), open_).select("qid", "term").distinct())
        return terms.join(few(near), "term").select("qid", "id").distinct()

    def judged(found):
        rows = found.join(titles, "id").join(few(parsed.select("qid", "query")), "qid")
        return saved(top(scored(rows), k, F.desc("score"), F.desc("votes")).select("qid", "id", "tier", "score", "coverage", "votes", "place"))

    out = judged(stopword_hits(titles, parsed.filter("stop"), floor).withColumn("tier", F.lit(0)).union(phrase(docs, parsed.filter("exact AND NOT stop").select("qid", "query")).withColumn("tier", F.lit(1))))
    open_, found = climbers, None
    for tier, find in ((2, lambda q: _prefixed(terms, q)), (3, lambda q: _any(terms, q).select("qid", "id")), (4, near_words)):
        new = find(open_).withColumn("tier", F.lit(tier))
        found = new if found is None else found.join(few(open_.select("qid")), "qid", "left_semi").unionByName(new)
        found = saved(found.groupBy("qid", "id").agg(F.min("tier").alias("tier")))
        hits = judged(found)
        still = saved(open_.join(weak(hits, votes).filter("NOT weak"), "qid", "left_anti")) if tier < 4 else open_.limit(0)
        out = out.unionByName(hits.join(still.select("qid"), "qid", "left_anti"))
        open_ = still
    return out.select("qid", "id", "tier", "score", "place")


def sounds_like(vocabulary: DataFrame, queries: DataFrame, most: int) -> DataFrame:
    """(qid, token, term, distance): the nearest words that sound like a token, so many at most."""
    tokens = query_terms(queries).withColumnRenamed("term", "token").withColumn("_p", Q.phonetic(F.col("token")))
    near = tokens.join(vocabulary.select("term", Q.phonetic(F.col("term")).alias("_p")), "_p").withColumn("distance", F.levenshtein("token", "term"))
    place = F.row_number().over(Window.partitionBy("qid", "token").orderBy("distance", "term"))
    return near.withColumn("place", place).filter(F.col("place") <= most).select("qid", "token", "term", "distance")
