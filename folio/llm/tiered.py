"""Ranked search of all documents over a tiered index.

One pass over the texts gives every document's length and its occurrences of the terms that the items ask for; written
in document order, that table is the lowest tier. Above it stand two tiers of postings: of each term those of the
highest impact, at most ``tiers[0]`` in the first and ``tiers[1]`` in both. Impacts are put in buckets, and a bucket goes
up whole or not at all, so copies without end (equal impacts) never swell a tier. Each term has a residual bound for each tier, the
largest contribution that any of its postings further down can make.

An item is first scored on the first tier: posting lists are joined and summed by document. With U the sum of its
residual bounds and T its 20th best sum so far, no document outside can reach the first 20 if U < T, and inside only those
whose sum and bounds of the terms not seen reach T. These are scored in full from the document-ordered table, and the item is
done. An item without that proof falls to the next tier, and at last to the document-ordered table, where blocks of documents are scored
whole, block by block, each passing on its best 20. Results are exact whatever the tier.

The joins of the upper tiers make at most ``tiers`` rows for a term of an item, however many documents there are. Items are taken in groups
with about ``VOCABULARY`` terms at most, so what is broadcast is bounded.

Defined results: null and empty texts hold no terms; such a document ranks nowhere, such an item has no rows. Repeated documents are
ranked each, repeated items each have their rows. Of equal scores the smaller doc_id is first, a null doc_id last. Empty tables give an
empty result.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folio.llm.common import small, written
from folio.llm.words import runs, slices

K = 20
#: Postings of a term in the first tier and in the first two, at most; buckets of impacts.
TIERS, BUCKETS = (1_000, 10_000), 64
#: Terms that a pass over the documents looks for.
VOCABULARY = 200_000
#: Scale of an impact: the largest is below it.
TOP = 1_000_000

_TERM = np.zeros(256, bool)
_TERM[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True


def member(data: np.ndarray) -> np.ndarray:
    return _TERM[data]


def questions(items: DataFrame, item_id: str, text: str) -> DataFrame:
    """(item, item_id, term, q): the terms of each row of items with their repeats; item numbers the rows."""
    rows = items.select(F.monotonically_increasing_id().alias("item"), F.col(item_id).alias("item_id"), F.col(text).alias("text"))

    def terms(batches):
        for batch in batches:
            row, words = runs(batch.column("text"), member)
            yield pa.RecordBatch.from_arrays([batch.column("item").take(row), batch.column("item_id").take(row), words], names=["item", "item_id", "term"])

    kinds = dict(rows.dtypes)
    return rows.mapInArrow(terms, f"item long, item_id {kinds['item_id']}, term string").groupBy("item", "item_id", "term").agg(F.count("*").alias("q"))


def forward(docs: DataFrame, vocabulary: list[str], doc_id: str, text: str) -> DataFrame:
    """(row, doc_id, n, t, tf): a document's number of terms and, ascending, those of the vocabulary with their occurrences."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    known = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def count(batches):
        wanted = pa.array(known.value, pa.string())
        size = max(1, len(wanted))
        for batch in batches:
            for part in slices(batch, "text"):
                row, words = runs(part.column("text"), member)
                code = pc.fill_null(pc.index_in(words, value_set=wanted), -1).to_numpy(zero_copy_only=False)
                held = code >= 0
                key, times = np.unique(row[held] * size + code[held], return_counts=True)
                offsets = pa.array(np.searchsorted(key, np.arange(part.num_rows + 1) * size), pa.int32())
                t, tf = (pa.ListArray.from_arrays(offsets, pa.array(x, pa.int32())) for x in (key % size, times))
                n = pa.array(np.bincount(row, minlength=part.num_rows), pa.int64())
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), n, t, tf], names=["doc_id", "n", "t", "tf"])

    kind = dict(rows.dtypes)["doc_id"]
    return rows.mapInArrow(count, f"doc_id {kind}, n long, t array<int>, tf array<int>").withColumn("row", F.monotonically_increasing_id())


def impact(tf, n, documents: int, occurrences: int):
    """(1000000000 tf) div (1000 tf + 12 m), with m = 75 + (25 n N) div L."""
    return F.expr(f"(1000000000L * {tf}) div (1000L * {tf} + 12L * (75L + (25L * {n} * {documents}L) div {max(1, occurrences)}L))")


def postings(table: DataFrame, documents: int, occurrences: int) -> DataFrame:
    """(row, t, impact)"""
    each = table.select("row", "n", F.explode(F.arrays_zip("t", "tf")).alias("p")).select("row", "n", "p.t", "p.tf")
    return each.select("row", "t", impact("tf", "n", documents, occurrences).alias("impact"))


def bounds(found: DataFrame, documents: int, tiers: tuple[int, ...]) -> DataFrame:
    """(t, w, floor_1, rest_1, ...): a term's weight, the lowest bucket of each tier, and the largest contribution below it."""
    bucket = F.floor(F.col("impact") * BUCKETS / TOP).cast("int")
    counts = found.groupBy("t", bucket.alias("bucket")).agg(F.count("*").alias("c"), F.max("impact").alias("top"))
    down = Window.partitionBy("t").orderBy(F.desc("bucket"))
    upto = counts.withColumn("upto", F.sum("c").over(down))
    w = F.floor(1000 * F.log((F.lit(2.0) * documents + 2) / (2 * F.sum("c") + 1))).cast("long")
    each = []
    for k, most in enumerate(tiers, 1):
        each += [F.coalesce(F.min(F.when(F.col("upto") <= most, F.col("bucket"))), F.lit(BUCKETS)).alias(f"floor_{k}"), F.coalesce(F.max(F.when(F.col("upto") > most, F.col("top"))), F.lit(0)).alias(f"rest_{k}")]
    out = upto.groupBy("t").agg(w.alias("w"), *each)
    return out.withColumns({f"rest_{k}": F.col(f"rest_{k}") * F.col("w") for k in range(1, len(tiers) + 1)})


def best(scored: DataFrame, k: int) -> DataFrame:
    """Of (item, row, doc_id, score) the first k of each item, ranked. Tasks pass on k rows of an item at most."""
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"), "row")
    return scored.filter("score > 0").withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def complete(candidates: DataFrame, table: DataFrame, asked: DataFrame, stats: DataFrame, documents: int, occurrences: int) -> DataFrame:
    """(item, row, doc_id, score) of (item, row), scored over all terms of the document."""
    rows = table.join(small(candidates.select("row").distinct()), "row", "left_semi").select("row", "doc_id", "n", F.explode(F.arrays_zip("t", "tf")).alias("p"))
    held = rows.select("row", "doc_id", "p.t", impact("p.tf", "n", documents, occurrences).alias("impact")).join(small(stats.select("t", "w")), "t")
    each = held.join(small(asked), "t").join(small(candidates), ["item", "row"], "left_semi")
    return each.groupBy("item", "row").agg(F.first("doc_id").alias("doc_id"), F.sum(F.col("q") * F.col("w") * F.col("impact")).alias("score"))


def tier(k: int, found: DataFrame, asked: DataFrame, stats: DataFrame, best_of: int) -> tuple[DataFrame, DataFrame]:
    """Scores the items asked on the tiers up to k: (item) proven, and (item, row) that may be among their best."""
    rest = asked.join(small(stats.select("t", "w", F.col(f"rest_{k}").alias("rest"))), "t")
    lists = found.join(small(rest.select("item", "t", "q", "w", "rest")), "t")
    sums = written(lists.groupBy("item", "row").agg(F.sum(F.col("q") * F.col("w") * F.col("impact")).alias("sum"), F.sum(F.col("q") * F.col("rest")).alias("seen")))
    order = Window.partitionBy("item").orderBy(F.desc("sum"))
    last = sums.withColumn("at", F.row_number().over(order)).filter(F.col("at") <= best_of).groupBy("item").agg(F.max("at").alias("at"), F.min("sum").alias("sum"))
    least = last.select("item", F.when(F.col("at") == best_of, F.col("sum")).otherwise(0).alias("least"))
    bound = rest.groupBy("item").agg(F.sum(F.col("q") * F.col("rest")).alias("bound"))
    proven = written(bound.join(least, "item", "left").filter((F.col("bound") == 0) | (F.col("bound") < F.col("least"))).select("item", "bound", F.coalesce("least", F.lit(0)).alias("least")))
    kept = sums.join(small(proven), "item").filter(F.col("sum") + F.col("bound") - F.col("seen") >= F.col("least")).select("item", "row")
    return proven.select("item"), written(kept)


def scan(table: DataFrame, asked: DataFrame, stats: DataFrame, documents: int, occurrences: int, k: int) -> DataFrame:
    """(item, row, doc_id, score): the items' best k of every block of documents, scored over the document-ordered table."""
    weight = {r.t: r.w for r in stats.select("t", "w").collect()}  # the terms of one group of items
    plan: dict[int, list[tuple[int, int]]] = {}
    for r in asked.collect():
        if r.t in weight:
            plan.setdefault(r.item, []).append((r.t, r.q * weight[r.t]))
    terms = {i: (np.array([t for t, _ in x]), np.array([c for _, c in x], np.int64)) for i, x in sorted(plan.items())}
    shared = table.sparkSession.sparkContext.broadcast(terms)
    size = 1 + max(weight, default=0)

    def score(batches):
        for batch in batches:
            lists = batch.column("t")
            t = lists.flatten().to_numpy(zero_copy_only=False)
            value = batch.column("i").flatten().to_numpy(zero_copy_only=False)
            lengths = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
            doc = np.repeat(np.arange(batch.num_rows), lengths)
            by = np.argsort(t, kind="stable")
            doc, value, starts = doc[by], value[by], np.searchsorted(t[by], np.arange(size + 1))
            ids = batch.column("doc_id").to_pandas()
            place = ids.rank(method="min", na_option="bottom").to_numpy()
            out = []
            for item, (own, factor) in shared.value.items():
                total = np.zeros(batch.num_rows, np.int64)
                for x, f in zip(own, factor, strict=True):
                    a, b = starts[x], starts[x + 1]
                    total[doc[a:b]] += f * value[a:b]  # a document holds a term once in its list
                hit = np.flatnonzero(total > 0)
                if len(hit) > k:
                    hit = hit[total[hit] >= np.partition(total[hit], len(hit) - k)[len(hit) - k]]
                hit = hit[np.lexsort((hit, place[hit], -total[hit]))[:k]]
                out.append(pa.RecordBatch.from_arrays([pa.array(np.full(len(hit), item)), batch.column("row").take(hit), batch.column("doc_id").take(hit), pa.array(total[hit])], names=["item", "row", "doc_id", "score"]))
            yield from out

    lists = table.select("row", "doc_id", "t", F.transform(F.arrays_zip("t", "tf"), lambda p: F.struct(p.tf.alias("tf"))).alias("p"), "n")
    each = lists.select("row", "doc_id", "t", F.expr(f"transform(p, x -> (1000000000L * x.tf) div (1000L * x.tf + 12L * (75L + (25L * n * {documents}L) div {max(1, occurrences)}L)))").alias("i")).filter(F.size("t") > 0)
    return each.mapInArrow(score, f"item long, row long, doc_id {dict(table.dtypes)['doc_id']}, score long")


def _ranked(docs: DataFrame, asked: DataFrame, k: int, tiers: tuple[int, ...], doc_id: str, text: str) -> DataFrame:
    """(item, rank, doc_id, score, tier) of one group of items."""
    vocabulary = sorted(r.term for r in asked.select("term").distinct().collect())
    codes = docs.sparkSession.createDataFrame(pd.DataFrame({"term": pd.Series(vocabulary, dtype=str), "t": range(len(vocabulary))}), "term string, t int")
    asked = written(asked.join(small(codes), "term").select("item", "t", "q"))
    table = written(forward(docs, vocabulary, doc_id, text))
    counts = table.agg(F.count_if(F.col("n") > 0).alias("documents"), F.coalesce(F.sum("n"), F.lit(0)).alias("occurrences")).first()
    each = postings(table, *counts)
    stats = written(bounds(each, counts.documents, tiers))
    held = each.join(small(stats.select("t", *(f"floor_{j}" for j in range(1, len(tiers) + 1)))), "t").withColumn("bucket", F.floor(F.col("impact") * BUCKETS / TOP))
    level = F.coalesce(*(F.when(F.col("bucket") >= F.col(f"floor_{j}"), j) for j in range(1, len(tiers) + 1)))
    upper = written(held.withColumn("tier", level).filter("tier IS NOT NULL").select("t", "row", "impact", "tier"))
    out, left = None, asked
    for j in range(1, len(tiers) + 1):
        proven, candidates = tier(j, upper.filter(F.col("tier") <= j), left, stats, k)
        done = best(complete(candidates, table, left, stats, *counts), k).withColumn("tier", F.lit(j))
        out = done if out is None else out.unionByName(done)
        left = written(left.join(small(proven), "item", "left_anti"))
    if left.limit(1).count():
        done = best(scan(table, left, stats, *counts, k), k).withColumn("tier", F.lit(len(tiers) + 1))
        out = done if out is None else out.unionByName(done)
    return out.select("item", "rank", "doc_id", "score", "tier")


def rank(docs: DataFrame, items: DataFrame, k: int = K, tiers: tuple[int, ...] = TIERS, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", vocabulary: int = VOCABULARY) -> DataFrame:
    """(item_id, rank, doc_id, score, tier): each item's k best documents, and the tier that proved them (the last one if none above did)."""
    asked = written(questions(items, item_id, item_text))
    groups = max(1, math.ceil(asked.select("term").distinct().count() / vocabulary))
    out = None
    for g in range(groups):
        own = asked.filter(F.pmod(F.xxhash64("item"), F.lit(groups)) == g) if groups > 1 else asked
        found = _ranked(docs, own.select("item", "term", "q"), k, tiers, doc_id, text)
        out = found if out is None else out.unionByName(found)
    names = asked.select("item", "item_id").distinct()
    return out.join(small(names), "item").select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score", "tier")


_TERMS = "regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')"
SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_TERMS} AS w FROM documents),
size AS (SELECT count(*) AS big_n, sum(len(w))::BIGINT AS big_l FROM d WHERE len(w) > 0),
q AS (SELECT item_id, term, count(*) AS q FROM (SELECT item_id, unnest({_TERMS}) AS term FROM benchmark) GROUP BY ALL),
p AS (SELECT r, doc_id, len(w) AS n, term, count(*) AS tf FROM (SELECT r, doc_id, w, unnest(w) AS term FROM d) WHERE term IN (SELECT term FROM q) GROUP BY ALL),
f AS (SELECT term, floor(1000 * ln((2 * big_n + 2) / (2 * count(*) + 1)))::BIGINT AS w FROM p, size GROUP BY term, big_n),
s AS (SELECT item_id, r, doc_id, sum(q * w * ((1000000000 * tf) // (1000 * tf + 12 * (100 - 25 + ((25 * n * big_n) // big_l)))))::BIGINT AS score
  FROM p JOIN f USING (term) JOIN q USING (term), size GROUP BY ALL),
b AS (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id, r) AS rank, doc_id, score FROM s WHERE score > 0)
SELECT item_id, rank::INT AS rank, doc_id, score FROM b WHERE rank <= {K}
"""
