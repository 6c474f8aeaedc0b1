"""Benchmark decontamination by template canonicalisation.

Numbers, units and names of both sides are replaced by typed placeholders; windows of
canonical words are hashed and joined; hits on one diagonal (document position minus item
position) are counted before any word moves. Where enough windows of an item lie on a
diagonal, the words are compared again: the canonical words must be equal, and the
values in the placeholders must map one to one, so that a question with other
numbers and names is caught and a chance likeness of templates is not. A run most of whose words are
equal is a copy even if a slot of it is not consistent. An item none of whose windows holds enough literals (sums, lists of names,
capitals throughout) says too little as a template: its windows are hashed and joined by the words themselves. DataFrame functions only.

A token is what stands between ASCII white space, without the marks ``.,;:!?"'()[]{}`` around
it. ``<num>``: digits with points and commas, perhaps signed. ``<unit>``: a unit after a
number, or glued to it. ``<name>``: begins with a capital, is not the first token, and the token
before does not end a sentence. Everything else is a literal in lower case.

Defined results: null or empty texts have no tokens and never match. Items with fewer
tokens than a window never match. Repeated documents and items match each for itself; the
result has one row for a document id and an item id. Empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folio.llm.common import free, small, written

WINDOW, LITERALS, NEEDED = 8, 5, 6
#: Share of equal words from which a run is a copy, whatever its slots.
SAME = 0.8
MARKS = ".,;:!?\"'()[]{}"
# Unit words.
UNITS = ("mm", "cm", "m", "km", "mg", "g", "kg", "ml", "l", "s", "min", "h", "hours", "minutes", "seconds", "days", "weeks", "years", "meters", "miles", "feet", "inches", "grams", "pounds", "liters", "dollars", "cents", "euros", "percent", "%")
CAPITAL = "[A-ZÀÁÂÄÇÈÉÊËÍÎÏÑÓÔÖÙÚÛÜ]"
NUMBER = r"[+-]?[0-9][0-9.,]*"
SPACE = r"[\x20\x09-\x0D]+"


def tokens(text: str) -> Column:
    return F.filter(F.split(F.coalesce(F.col(text), F.lit("")), SPACE), lambda t: t != "")


def canonical(t: Column, before: Column) -> Column:
    """The canonical form of a raw token; before: the raw token in front (null for the first)."""
    bare = F.btrim(t, F.lit(MARKS))
    front = F.btrim(before, F.lit(MARKS))
    first, first_before = F.ascii(t), F.coalesce(F.ascii(before), F.lit(0))
    plain = (first >= 97) & (first <= 122) & ~first_before.isin([43, 45, *range(48, 58)]) & ~F.coalesce(before.startswith("("), F.lit(False))
    units = "|".join(UNITS)
    return (
        F.when(plain & (bare != ""), F.lower(bare))
        .when(bare == "", t)
        .when(bare.rlike(f"^{NUMBER}$"), F.lit("<num>"))
        .when(bare.rlike(f"^{NUMBER}({units})$"), F.lit("<num><unit>"))
        .when(F.lower(bare).isin(list(UNITS)) & F.coalesce(front.rlike(f"^{NUMBER}$"), F.lit(False)), F.lit("<unit>"))
        .when(before.isNotNull() & bare.rlike(f"^{CAPITAL}") & ~F.substring(before, -1, 1).isin(".", "!", "?", ":"), F.lit("<name>"))
        .otherwise(F.lower(bare))
    )


def canon(raw: str) -> Column:
    c = F.col(raw)
    return F.transform(c, lambda t, i: canonical(t, F.get(c, i - 1)))


def window_hashes(raw: str, window: int) -> Column:
    """Hash of every window of canonical tokens."""
    c = F.col(raw)
    hashes = F.transform(c, lambda t, i: F.xxhash64(canonical(t, F.get(c, i - 1))))
    # The array of hashes is bound once for all windows by a transform over a single element.
    per_window = F.transform(F.array(hashes), lambda h: F.transform(F.sequence(F.lit(1), F.size(h) - window + 1), lambda i: F.xxhash64(F.slice(h, i, F.lit(window)))))
    return F.when(F.size(c) >= window, per_window[0]).otherwise(F.array().cast("array<long>"))


def bare(t: Column) -> Column:
    """A token without the marks around it, in lower case; the token itself if it is all marks."""
    found = F.btrim(t, F.lit(MARKS))
    return F.lower(F.when(found == "", t).otherwise(found))


def verbatim_hashes(raw: str, window: int) -> Column:
    """Hash of every window of the words themselves."""
    c = F.col(raw)
    per_window = F.transform(F.array(F.transform(c, lambda t: F.xxhash64(F.lit("verbatim"), bare(t)))), lambda h: F.transform(F.sequence(F.lit(1), F.size(h) - window + 1), lambda i: F.xxhash64(F.slice(h, i, F.lit(window)))))
    return F.when(F.size(c) >= window, per_window[0]).otherwise(F.array().cast("array<long>"))


def _literals(words: Column) -> Column:
    return F.size(F.filter(words, lambda w: ~w.startswith("<")))


def items(benchmark: DataFrame, window: int, literals: int, item_id: str, text: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Items (item_id, item, words, canon), and windows (hash, item, ipos, total): of templates with enough literals, and of the words of items that have none."""
    raw = benchmark.select(F.col(item_id).alias("item_id"), tokens(text).alias("words"))
    base = written(raw.withColumn("canon", canon("words")).withColumn("item", F.xxhash64("item_id", "words")))
    long = base.filter(F.size("words") >= window)
    at = long.select("item", "canon", F.posexplode(window_hashes("words", window)).alias("ipos", "hash"))
    good = written(at.filter(_literals(F.slice("canon", F.col("ipos") + 1, F.lit(window))) >= literals).select("hash", "item", "ipos").distinct())
    total = good.groupBy("item").agg(F.count("*").alias("total"))
    poor = long.join(total, "item", "left_anti").select("item", F.posexplode(verbatim_hashes("words", window)).alias("ipos", "hash")).select("hash", "item", "ipos").distinct()
    return base, written(good.join(total, "item")), written(poor.join(poor.groupBy("item").agg(F.count("*").alias("total")), "item"))


def matches(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, literals: int = LITERALS, needed: int = NEEDED, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """(doc_id, key, item_id, n_windows, from_word, to_word, exact): items found in documents, slots consistent.

    key is the hash of the document id and text. An item with fewer good windows than needed must have all of them.
    """
    base, index, verbatim = items(benchmark, window, literals, item_id, item_text)
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.xxhash64(F.col(doc_id), F.col(text)).alias("key"))
    at = rows.select("key", tokens("text").alias("words")).select("key", F.posexplode(window_hashes("words", window)).alias("dpos", "hash"))
    hits = at.join(small(index), "hash")
    if verbatim.limit(1).count():
        said = rows.select("key", tokens("text").alias("words")).select("key", F.posexplode(verbatim_hashes("words", window)).alias("dpos", "hash"))
        hits = hits.unionByName(said.join(small(verbatim), "hash"))
    runs = hits.groupBy("key", "item", (F.col("dpos") - F.col("ipos")).alias("shift")).agg(
        F.count_distinct("ipos").alias("n"), F.min("ipos").alias("first"), F.max("ipos").alias("last"), F.max("total").alias("total")
    )
    runs = written(runs.filter(F.col("n") >= F.least(F.lit(needed), F.col("total"))).select("key", "item", "shift", "n", "first", "last"))
    found = rows.join(small(runs.select("key").distinct()), "key", "left_semi").select("doc_id", "key", tokens("text").alias("dwords"))
    near = found.withColumn("dcanon", canon("dwords")).join(small(runs), "key").join(small(base), "item")
    size = F.col("last") - F.col("first") + window
    cut = lambda c, at_: F.slice(c, at_ + 1, size)
    both = near.select(
        "doc_id", "key", "item_id", "n", (F.col("first") + F.col("shift")).alias("from_word"), size.alias("size"),
        F.arrays_zip(cut("words", F.col("first")).alias("iw"), cut("canon", F.col("first")).alias("ic"), cut("dwords", F.col("first") + F.col("shift")).alias("dw"), cut("dcanon", F.col("first") + F.col("shift")).alias("dc")).alias("zip"),
    )
    agree = F.filter("zip", lambda z: z["ic"] == z["dc"])
    trimmed = lambda w: F.btrim(w, F.lit(MARKS))
    slots = F.transform(F.filter(agree, lambda z: z["ic"].startswith("<")), lambda z: F.struct(z["ic"].alias("kind"), trimmed(z["iw"]).alias("i"), trimmed(z["dw"]).alias("d")))
    checked = both.withColumn("_agree", agree).withColumn("slots", F.array_distinct(slots))
    item_values, doc_values = F.transform("slots", lambda s: F.struct(s.kind, s.i)), F.transform("slots", lambda s: F.struct(s.kind, s.d))
    one_to_one = (F.size(F.array_distinct(item_values)) == F.size("slots")) & (F.size(F.array_distinct(doc_values)) == F.size("slots"))
    exact = F.forall("zip", lambda z: trimmed(z["iw"]).eqNullSafe(trimmed(z["dw"])))
    enough = (F.size("_agree") >= window) | F.forall("zip", lambda z: F.lower(trimmed(z["iw"])).eqNullSafe(F.lower(trimmed(z["dw"]))))
    same = F.size(F.filter("zip", lambda z: trimmed(z["iw"]).eqNullSafe(trimmed(z["dw"])))) >= SAME * F.size("zip")
    return checked.filter((one_to_one | same) & enough).select("doc_id", "key", "item_id", F.col("n").alias("n_windows"), "from_word", (F.col("from_word") + F.col("size")).alias("to_word"), exact.alias("exact"))


def report(found: DataFrame) -> DataFrame:
    """One row per document id and item id: doc_id, item_id, n_windows (most on one diagonal), exact (somewhere)."""
    return found.groupBy("doc_id", "item_id").agg(F.max("n_windows").alias("n_windows"), F.bool_or("exact").alias("exact"))


def clean(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", **params) -> DataFrame:
    """docs without the documents in which an item was found."""
    key = free(docs, "_key")
    found = written(matches(docs, benchmark, doc_id=doc_id, text=text, **params).select(F.col("key").alias(key)).distinct())
    return docs.withColumn(key, F.xxhash64(F.col(doc_id), F.col(text))).join(small(found), key, "left_anti").drop(key)


_T = "string_split_regex(coalesce(text, ''), '[\\x20\\x09-\\x0D]+')"
_UNITS = ", ".join(f"'{u}'" for u in UNITS)
_MARKS = MARKS.replace("'", "''")
_NUM = NUMBER
SQL = rf"""
WITH src AS (
  SELECT 'd' AS side, doc_id AS id, row_number() OVER () AS r, list_filter({_T}, lambda t: t <> '') AS w FROM documents
  UNION ALL SELECT 'i', item_id, row_number() OVER (), list_filter({_T}, lambda t: t <> '') FROM benchmark),
tok AS (SELECT side, id, r, unnest(w) AS t, unnest(range(len(w))) AS pos FROM src),
prev AS (SELECT *, lag(t) OVER (PARTITION BY side, r ORDER BY pos) AS p, trim(t, '{_MARKS}') AS b FROM tok),
can AS (SELECT side, id, r, pos, b, lower(CASE WHEN b = '' THEN t ELSE b END) AS v, CASE
    WHEN b = '' THEN t
    WHEN regexp_matches(b, '^{_NUM}$') THEN '<num>'
    WHEN regexp_matches(b, '^{_NUM}({"|".join(UNITS)})$') THEN '<num><unit>'
    WHEN lower(b) IN ({_UNITS}) AND coalesce(regexp_matches(trim(p, '{_MARKS}'), '^{_NUM}$'), false) THEN '<unit>'
    WHEN p IS NOT NULL AND regexp_matches(b, '^{CAPITAL}') AND right(p, 1) NOT IN ('.', '!', '?', ':') THEN '<name>'
    ELSE lower(b) END AS c FROM prev),
win AS (SELECT side, id, r, pos,
    array_agg(c) OVER (PARTITION BY side, r ORDER BY pos ROWS BETWEEN CURRENT ROW AND {WINDOW - 1} FOLLOWING) AS k,
    array_agg(v) OVER (PARTITION BY side, r ORDER BY pos ROWS BETWEEN CURRENT ROW AND {WINDOW - 1} FOLLOWING) AS kv,
    sum(CASE WHEN starts_with(c, '<') THEN 0 ELSE 1 END) OVER (PARTITION BY side, r ORDER BY pos ROWS BETWEEN CURRENT ROW AND {WINDOW - 1} FOLLOWING) AS lits FROM can),
iw AS (SELECT id AS item_id, r AS ir, pos AS ipos, k, count(*) OVER (PARTITION BY r) AS total FROM win WHERE side = 'i' AND len(k) = {WINDOW} AND lits >= {LITERALS}),
vw AS (SELECT id AS item_id, r AS ir, pos AS ipos, kv, count(*) OVER (PARTITION BY r) AS total FROM win WHERE side = 'i' AND len(k) = {WINDOW} AND r NOT IN (SELECT ir FROM iw)),
found AS (SELECT d.id AS doc_id, d.r AS dr, item_id, ir, d.pos, ipos, total FROM win d JOIN iw ON d.k = iw.k WHERE d.side = 'd'
  UNION ALL SELECT d.id, d.r, item_id, ir, d.pos, ipos, total FROM win d JOIN vw ON d.kv = vw.kv WHERE d.side = 'd'),
hit AS (SELECT doc_id, dr, item_id, ir, pos - ipos AS shift, count(DISTINCT ipos) AS n, min(ipos) AS f, max(ipos) AS l, max(total) AS total FROM found GROUP BY ALL),
run AS (SELECT * FROM hit WHERE n >= least({NEEDED}, total)),
pair AS (SELECT run.*, i.c AS ic, d.c AS dc, i.b AS ib, d.b AS db FROM run
  JOIN can i ON i.side = 'i' AND i.r = run.ir AND i.pos BETWEEN f AND l + {WINDOW - 1}
  JOIN can d ON d.side = 'd' AND d.r = run.dr AND d.pos = i.pos + shift),
ok AS (SELECT doc_id, dr, item_id, ir, shift, n, bool_and(ib = db) AS exact FROM pair GROUP BY ALL
  HAVING (count(*) FILTER (ic = dc) >= {WINDOW} OR bool_and(lower(ib) = lower(db)))
    AND (count(*) FILTER (ib = db) >= {SAME} * count(*)
      OR count(DISTINCT (ic, ib, db)) FILTER (ic = dc AND starts_with(ic, '<')) = count(DISTINCT (ic, ib)) FILTER (ic = dc AND starts_with(ic, '<'))
      AND count(DISTINCT (ic, ib, db)) FILTER (ic = dc AND starts_with(ic, '<')) = count(DISTINCT (ic, db)) FILTER (ic = dc AND starts_with(ic, '<'))))
SELECT doc_id, item_id, max(n) AS n_windows, bool_or(exact) AS exact FROM ok GROUP BY doc_id, item_id
"""
