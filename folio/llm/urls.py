"""URL filters: fixed host and path rules, then association rules mined from labels.

FP-growth mines the token combinations of labelled urls together with their label; rules
that pass the support, confidence and lift bounds are matched through an inverted index
from token to rule. A url that a fixed rule decides is a label of its verdict, without the
tokens of that rule's own host, so that what is learnt holds for other hosts. More labels may be given.

Labels have sources: the fixed rule that made them, or one of ``FOLDS`` parts of the labels given, by hash of the url. A mined rule must
reach the confidence in every source that has ``EACH`` rows of its tokens or more, and in two sources at least. So what merely echoes one fixed rule (pages of
one language are blocked because one domain is) is no rule. Of rules that say the same the longer goes if the shorter is as confident.
DataFrame functions only. Urls with equal tokens are matched once, so that a host or url that fills
a third of the table costs no more than any other.

Defined results: a null url, or one without ``://``, has an empty host and path, matches
nothing and gets the default verdict. Repeated rows are kept. No labels or one class of
labels gives no mined rules. Of several matching rules the one of the highest
confidence, then support, then the shortest and smallest text decides. Columns of the table
other than the id and the url are not read, whatever their names. A page of conflicting labels is bad.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folio.llm.common import small, written

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: (verdict, host, path): the fixed rules of the registered query.
FIXED = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
MIN_SUPPORT, MIN_CONFIDENCE, MIN_LIFT, MIN_ROWS = 0.002, 0.8, 1.05, 20
#: Rows by which a source counts for a rule; parts of the labels given.
EACH, FOLDS = 5, 4


def host_path(url: str) -> tuple[Column, Column]:
    u = F.col(url)
    at = F.instr(u, "://")
    rest = F.when(at > 0, F.substring(u, at + 3, F.length(u))).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.coalesce(F.translate(host, UPPER, LOWER), F.lit("")), F.coalesce(path, F.lit(""))


def fixed_rule(rules: Sequence[tuple[str, str, str]]) -> Column:
    """The longest fixed rule that fits (rule, verdict, own: its host), or null; ties go to the first in text order."""
    out = None
    for verdict, host, path in sorted(rules, key=lambda r: (-len(r[1] + r[2]), r[1] + r[2])):
        fits = ((F.col("host") == host) | F.col("host").endswith("." + host)) & F.col("path").startswith(path)
        value = F.struct(F.lit(host + path).alias("rule"), F.lit(verdict).alias("verdict"), F.lit(host).alias("own"))
        out = F.when(fits, value) if out is None else out.when(fits, value)
    return F.lit(None).cast("struct<rule:string,verdict:string,own:string>") if out is None else out


def tokens() -> Column:
    """Tokens of a url with host and path: host labels, its last two labels, words of the path, the number of segments."""
    labels = F.filter(F.split("host", r"\."), lambda x: x != "")
    tail = F.when(F.size(labels) >= 2, F.array(F.concat(F.lit("site:"), F.array_join(F.slice(labels, -2, 2), ".")))).otherwise(F.array().cast("array<string>"))
    words = F.filter(F.split(F.lower("path"), r"[/._-]+"), lambda x: (x != "") & ~x.rlike("[0-9]"))
    deep = F.array(F.concat(F.lit("depth:"), F.least(F.size(F.filter(F.split("path", "/"), lambda x: x != "")), F.lit(9)).cast("string")))
    return F.array_distinct(F.concat(F.transform(labels, lambda x: F.concat(F.lit("host:"), x)), tail, F.transform(words, lambda x: F.concat(F.lit("path:"), x)), deep))


def mine(labelled: DataFrame, min_support: float = MIN_SUPPORT, min_confidence: float = MIN_CONFIDENCE, min_lift: float = MIN_LIFT, min_rows: int = MIN_ROWS) -> DataFrame:
    """Rules (rule, tokens, verdict, confidence, support) from rows (items: array, bad: boolean, source).

    The support bound is min_support of the rows, and min_rows of them at least.
    """
    spark = labelled.sparkSession
    none = spark.createDataFrame([], "rule string, tokens array<string>, verdict string, confidence double, support double")
    seen = labelled.agg(F.count("*").alias("n"), F.count_if("bad").alias("bad")).first()
    if not seen.bad or seen.bad == seen.n:
        return none
    items = labelled.select(F.concat("items", F.array(F.when(F.col("bad"), "label:block").otherwise("label:allow"))).alias("items"))
    found = FPGrowth(itemsCol="items", minSupport=min(1.0, max(min_support, min_rows / seen.n)), minConfidence=min_confidence).fit(items).associationRules
    is_label = F.col("consequent")[0].startswith("label:")
    clean = ~F.exists("antecedent", lambda x: x.startswith("label:"))
    kept = found.filter(is_label & clean & (F.col("lift") >= min_lift))
    toks = F.array_sort("antecedent")
    rules = written(kept.select(F.array_join(toks, "+").alias("rule"), toks.alias("tokens"), F.expr("substring(consequent[0], 7)").alias("verdict"), "confidence", "support"))
    return shortest(rules.join(small(backed(labelled, rules, min_confidence)), "rule", "left_semi"))


def backed(labelled: DataFrame, rules: DataFrame, min_confidence: float) -> DataFrame:
    """(rule) of rules that hold in each of their sources, two at least."""
    rows = labelled.groupBy("items", "bad", "source").agg(F.count("*").alias("n"))
    index = small(rules.select(F.explode("tokens").alias("token"), F.size("tokens").alias("need"), "rule", "verdict"))
    sets = rows.select("items").distinct()
    hits = sets.select("items", F.explode("items").alias("token")).join(index, "token").groupBy("items", "rule", "verdict", "need").agg(F.count("*").alias("held")).filter("held = need")
    right = F.sum(F.when(F.col("bad") == (F.col("verdict") == "block"), F.col("n")).otherwise(0))
    each = hits.join(rows, "items").groupBy("rule", "source").agg(F.sum("n").alias("n"), right.alias("right")).filter(F.col("n") >= EACH)
    return each.groupBy("rule").agg(F.count("*").alias("sources"), F.min(F.col("right") / F.col("n")).alias("least")).filter((F.col("sources") >= 2) & (F.col("least") >= min_confidence)).select("rule")


def shortest(rules: DataFrame) -> DataFrame:
    """rules without those that say no more than one with fewer of their tokens."""
    token = rules.select("rule", "verdict", F.size("tokens").alias("size"), "confidence", F.explode("tokens").alias("token"))
    less = token.select("token", "verdict", F.col("rule").alias("less"), F.col("size").alias("need"), F.col("confidence").alias("as_sure"))
    both = token.join(less, ["token", "verdict"]).filter((F.col("need") < F.col("size")) & (F.col("as_sure") >= F.col("confidence") - 1e-9))
    spare = both.groupBy("rule", "less", "need").agg(F.count("*").alias("held")).filter("held = need").select("rule").distinct()
    return rules.join(spare, "rule", "left_anti")


def match(found: DataFrame, rules: DataFrame) -> DataFrame:
    """(items, mined_rule, mined_verdict) of distinct token sets (items): the best rule all of whose tokens are there."""
    index = small(rules.select(F.explode("tokens").alias("token"), F.size("tokens").alias("need"), "rule", "verdict", "confidence", "support"))
    hits = found.select("items", F.explode("items").alias("token")).join(index, "token").groupBy("items", "rule", "verdict", "confidence", "support", "need").agg(F.count("*").alias("n"))
    best = F.max_by(F.struct("rule", "verdict"), F.struct("confidence", "support", F.expr("-length(rule)"), "rule"))
    return hits.filter("n = need").groupBy("items").agg(best.alias("best")).select("items", F.col("best.rule").alias("mined_rule"), F.col("best.verdict").alias("mined_verdict"))


def training(base: DataFrame, labels: DataFrame | None) -> DataFrame:
    """(items, bad, source, host): rows that a fixed rule decides, without the tokens of its host, and rows of the labels."""
    own = F.col("_f.own")
    theirs = lambda x: (x.startswith("host:") & F.array_contains(F.split(own, r"\."), F.substring(x, 6, 255))) | (x.startswith("site:") & x.endswith(own))
    rows = base.filter("_f IS NOT NULL").select(F.filter("items", lambda x: ~theirs(x)).alias("items"), (F.col("_f.verdict") == "block").alias("bad"), F.col("_f.rule").alias("source"), "host")
    if labels is not None:
        truth = labels.select("page_id", "bad").filter("bad IS NOT NULL AND page_id IS NOT NULL").groupBy("page_id").agg(F.bool_or("bad").alias("bad"))
        fold = F.concat(F.lit("labels "), F.pmod(F.xxhash64("host", "path"), F.lit(FOLDS)).cast("string"))
        rows = rows.union(base.join(truth, "page_id").filter("items IS NOT NULL").select("items", "bad", fold, "host"))
    return rows


def _based(pages: DataFrame, fixed: Sequence[tuple[str, str, str]], page_id: str, url: str) -> DataFrame:
    host, path = host_path(url)
    base = pages.select(F.col(page_id).alias("page_id"), host.alias("host"), path.alias("path"))
    return base.withColumn("items", F.when(F.col("host") != "", tokens())).withColumn("_f", fixed_rule(fixed))


def held_out(pages: DataFrame, labels: DataFrame | None = None, fixed: Sequence[tuple[str, str, str]] = FIXED, page_id: str = "page_id", url: str = "url", **bounds: float) -> DataFrame:
    """(verdict, pages, said, right): of a quarter of the hosts (by hash), pages with the verdict, those for which rules mined on the other hosts say it, and those for which they do so rightly."""
    rows = written(training(_based(pages, fixed, page_id, url), labels).withColumn("out", F.pmod(F.crc32("host"), F.lit(4)) == 2))
    rules = written(mine(rows.filter(~F.col("out")).drop("out"), **bounds))
    test = rows.filter("out")
    said = test.join(match(test.select("items").distinct(), rules), "items", "left").withColumn("truth", F.when(F.col("bad"), "block").otherwise("allow"))
    each = said.select(F.explode(F.array(F.lit("block"), F.lit("allow"))).alias("verdict"), "truth", "mined_verdict")
    count = lambda c: F.count_if(F.coalesce(c, F.lit(False)))
    ours = F.col("mined_verdict") == F.col("verdict")
    return each.groupBy("verdict").agg(count(F.col("truth") == F.col("verdict")).alias("pages"), count(ours).alias("said"), count(ours & (F.col("truth") == F.col("verdict"))).alias("right"))


def judge(pages: DataFrame, labels: DataFrame | None = None, fixed: Sequence[tuple[str, str, str]] = FIXED, default: str = "allow", page_id: str = "page_id", url: str = "url", **bounds: float) -> DataFrame:
    """Per row: page_id, host, path, rule, verdict, mined_rule. labels: (page_id, bad boolean), beside the fixed rules' own."""
    base = _based(pages, fixed, page_id, url)
    rules = written(mine(training(base, labels), **bounds))
    matched = written(match(base.filter("items IS NOT NULL").select("items").distinct(), rules))
    judged = base.join(small(matched), "items", "left")
    return judged.select(
        "page_id", "host", "path", F.col("_f.rule").alias("rule"),
        F.coalesce("_f.verdict", "mined_verdict", F.lit(default)).alias("verdict"), "mined_rule",
    )
