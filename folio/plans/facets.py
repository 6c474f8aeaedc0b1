"""Facets, labels, orders, merged contributions, lists, front page and log reports."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from folio.functions import text as T
from folio.operators import catalogue, rank, providers
from folio.operators.browse import project
from folio.plans.browse import PRIOR, RANKED, TITLES
from folio.plans.logs import _events
from folio.session import saved, table

WINDOW = 400


def _ranked(spark, sf_dir):
    return rank.bayesian(catalogue.titles(spark, sf_dir), PRIOR)


def facet_filters(spark, sf_dir):
    """Of the 500 best titles those of a genre, decade, year and kind; the filters come after the ranks."""
    head = _ranked(spark, sf_dir).filter("rank IS NOT NULL").orderBy(F.desc("rank"), "id").limit(500)
    return head.filter(F.array_contains("genres", "red") & (F.floor(F.col("year") / 10) * 10 == 1990) & (F.col("year") == 1995) & F.col("kind").isin("PROMO", "LARGE", "SMALL")).select("id", "title", "rank")


def title_projection(spark, sf_dir):
    """Titles with columns that this table lacks as literals."""
    return project(catalogue.titles(spark, sf_dir), {"id": None, "title": None, "votes": None, "lang": F.lit(None).cast("string"), "buzz_votes": F.lit(0)})


def name_equality(spark, sf_dir):
    """Titles equal to a name exactly, but for case and space, or normalised."""
    name, t = "Red  Widget ", F.col("title")
    modes = (("exact", t == name), ("loose", F.lower(F.trim(t)) == F.lower(F.trim(F.lit(name)))), ("strict", T.normalize(t) == T.normalize(F.lit(name))))
    rows = catalogue.titles(spark, sf_dir).select("id", "title", F.explode(F.array(*(F.struct(F.lit(m).alias("mode"), c.alias("hit")) for m, c in modes))).alias("m"))
    return rows.groupBy("m.mode").agg(F.count_if("m.hit").alias("n"))


def all_phrases(spark, sf_dir):
    """P10: documents that hold every one of several phrases, as whole words."""
    body = F.concat(F.lit(" "), T.normalize(F.col("text")), F.lit(" "))
    holds = F.forall(F.array(F.lit("of the"), F.lit("in")), lambda p: F.contains(body, F.concat(F.lit(" "), p, F.lit(" "))))
    return table(spark, sf_dir, "documents").filter(holds).select("doc_id")


def commonest_label(spark, sf_dir):
    """Terms under one key with their commonest spelling (of equals the first) and their titles; O8: linkable ones first."""
    rows = table(spark, sf_dir, "part").select("p_partkey", F.lower(F.split("p_name", " ")[1]).alias("key"), F.when(F.col("p_size") % 3 == 0, F.initcap(F.split("p_name", " ")[1])).otherwise(F.split("p_name", " ")[1]).alias("spelling"))
    per = rows.groupBy("key", "spelling").agg(F.count("*").alias("n"), F.count_distinct("p_partkey").alias("t"))
    best = F.min_by("spelling", F.struct(-F.col("n"), "spelling"))
    return per.groupBy("key").agg(best.alias("label"), F.sum("t").alias("titles")).withColumn("linkable", F.col("titles") >= 2)


def places_order(spark, sf_dir):
    """Places in a region: linkable first, sites before areas, the most people, then the label."""
    nation = table(spark, sf_dir, "supplier").groupBy("s_nationkey").agg(F.count("*").alias("titles")).join(table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey"), "right")
    rows = nation.select("n_regionkey", F.col("n_name").alias("label"), F.coalesce("titles", F.lit(0)).alias("titles"), F.when(F.col("n_nationkey") % 2 == 0, "site").otherwise("area").alias("kind"))
    w = Window.partitionBy("n_regionkey").orderBy((F.col("titles") >= 2).desc(), (F.col("kind") == "site").desc(), F.desc("titles"), "label")
    return rows.withColumn("place", F.row_number().over(w))


def release_order(spark, sf_dir):
    """Titles of a brand by year, unknown ones last, then title and id."""
    w = Window.partitionBy("p_brand").orderBy(F.asc_nulls_last("year"), "title", "id")
    rows = catalogue.titles(spark, sf_dir).withColumn("year", F.when(F.col("kind") != "PROMO", F.col("year"))).join(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), "p_brand"), "id")
    return rows.select("id", "p_brand", F.row_number().over(w).alias("place"))


def name_rank_order(spark, sf_dir):
    """Collections whose normalised name is the query, begins with it or holds it, in this order."""
    names = table(spark, sf_dir, "part").select(T.normalize(F.col("p_name")).alias("name")).groupBy("name").agg(F.count("*").alias("titles"))
    q = F.lit("red bolt")
    tier = F.when(F.col("name") == q, 0).when(F.col("name").startswith("red"), 1).when(F.contains("name", F.lit("e")), 2)
    rows = names.withColumn("tier", tier).filter("tier IS NOT NULL")
    return rows.orderBy("tier", F.desc("titles"), "name").limit(20)


def class_order(spark, sf_dir):
    """Each customer's orders by class in a fixed order, unknown classes last; within a class those won first."""
    known = F.array(*map(F.lit, ("2-HIGH", "1-URGENT", "3-MEDIUM")))
    at = F.nullif(F.array_position(known, F.col("o_orderpriority")), F.lit(0))
    w = Window.partitionBy("o_custkey").orderBy(at.asc_nulls_last(), (F.col("o_orderstatus") == "F").desc(), "o_orderkey")
    return table(spark, sf_dir, "orders").select("o_orderkey", F.row_number().over(w).alias("place"))


def user_order(spark, sf_dir):
    """Kinds in each customer segment's own order; a newcomer stands behind what precedes it in the default order."""
    kinds = table(spark, sf_dir, "part").groupBy("p_type").agg(F.min("p_partkey").alias("default"))
    own = table(spark, sf_dir, "customer").select("c_mktsegment").distinct().crossJoin(F.broadcast(kinds))  # a few segments by a few kinds
    chosen = F.when(F.pmod(F.length("p_type") + F.length("c_mktsegment"), F.lit(3)) != 0, F.length("p_type"))
    w = Window.partitionBy("c_mktsegment").orderBy("default")
    anchored = own.withColumn("pos", chosen).withColumn("anchor", F.coalesce(F.last("pos", ignorenulls=True).over(w), F.lit(-1)))
    place = F.row_number().over(Window.partitionBy("c_mktsegment").orderBy("anchor", F.col("pos").isNull().cast("int"), "default"))
    return anchored.select("c_mktsegment", "p_type", place.alias("place"))


def tier_union(spark, sf_dir):
    """Candidates of several tiers, each in the first that has it."""
    part = table(spark, sf_dir, "part")
    tiers = (("exact", "p_name = 'red bolt'"), ("all", "p_name LIKE 'red %'"), ("any", "p_name LIKE '%bolt' OR p_name LIKE 'red %'"))
    out = None
    for k, (name, cond) in enumerate(tiers):
        one = part.filter(cond).select("p_partkey", F.lit(k).alias("k"), F.lit(name).alias("tier"))
        out = one if out is None else out.unionByName(one)
    return out.groupBy("p_partkey").agg(F.min_by("tier", "k").alias("tier"))


def shortlist_union(spark, sf_dir):
    """Two shortlists of words near a query, each word with its least distance."""
    words = table(spark, sf_dir, "part").select(F.explode(F.split("p_name", " ")).alias("term")).distinct()
    lists = [words.select("term", F.levenshtein("term", F.lit(q)).alias("distance")).filter(F.col("distance") <= 3) for q in ("bolt", "gear")]
    return lists[0].unionByName(lists[1]).groupBy("term").agg(F.min("distance").alias("distance"))


def capability_diff(spark, sf_dir):
    """What the old build could do and the new one can't: names of a brand that are gone."""
    part = table(spark, sf_dir, "part")
    old, new = (part.filter(c).select("p_brand", "p_name").distinct() for c in ("p_size < 25", "p_size >= 25"))
    return old.exceptAll(new)


def merge_contributions(spark, sf_dir):
    """Contributions to a key by source: lists one after the other, maps overlaid, a single value from the first that has one."""
    rows = table(spark, sf_dir, "lineitem").groupBy("l_partkey", "l_returnflag").agg(F.array_sort(F.collect_set("l_linenumber")).alias("items"), F.min("l_tax").alias("tax"), F.max("l_quantity").alias("q"))
    one = rows.withColumn("tax", F.when(F.col("l_returnflag") != "A", F.col("tax")))
    per = one.groupBy("l_partkey").agg(F.array_sort(F.collect_list(F.struct("l_returnflag", "items", "tax", "q"))).alias("c"))
    single = F.get(F.filter("c.tax", lambda x: x.isNotNull()), F.lit(0))
    overlay = F.element_at(F.col("c.q"), -1)
    return per.select("l_partkey", F.array_join(F.flatten("c.items"), ",").alias("items"), single.alias("single"), overlay.alias("overlay"))


def merged_facets(spark, sf_dir):
    """What three providers (return flags) say of a title, merged: fields overlaid, lists of lines joined where they are longest."""
    per = saved(table(spark, sf_dir, "lineitem").groupBy("l_partkey", "l_returnflag").agg(F.max("l_quantity").cast("long").alias("q"), F.min("l_linenumber").alias("first"), F.array_sort(F.collect_set("l_linenumber")).alias("lines")))
    said = {
        "details": F.when(F.col("l_returnflag") == "N", F.to_json(F.struct("q"))).otherwise(F.to_json(F.struct("q", "first"))),
        "lines": F.to_json(F.transform("lines", lambda n: F.struct(n.alias("n")))),
    }
    registry = providers.Registry(providers.Facet("details", "object"), providers.Facet("lines", "list", F.json_array_length))
    for flag in ("A", "N", "R"):
        for facet, data in said.items():
            registry.add(providers.Provider(facet, flag, 1, frozenset(("PROMO", "LARGE")), lambda e, flag=flag, data=data: e.join(per.filter(F.col("l_returnflag") == flag), F.col("id") == F.col("l_partkey")).select("id", data.alias("data"))))
    entities = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_type").alias("kind"))
    return registry.merged(registry.contributions(entities)).select("id", "facet", F.array_join("plugins", "").alias("plugins"), "data")


def coverage_shelf(spark, sf_dir):
    """Of each kind's titles, how many a source covers, and the share."""
    covered = table(spark, sf_dir, "lineitem").filter("l_returnflag = 'R' AND l_quantity >= 45").select(F.col("l_partkey").alias("id")).distinct().withColumn("has", F.lit(1))
    rows = catalogue.titles(spark, sf_dir).join(covered, "id", "left").groupBy("kind").agg(F.count("*").alias("titles"), F.count("has").alias("covered"))
    return rows.withColumn("share", F.round(F.try_divide("covered", "titles"), 6))


def ceremony_summary(spark, sf_dir):
    """Two aggregates of different grain as one: orders of a year, and customers of that year's fulfilled ones."""
    o = table(spark, sf_dir, "orders").withColumn("year", F.year("o_orderdate"))
    a = o.groupBy("year").agg(F.count("*").alias("nominations"), F.count_distinct("o_orderpriority").alias("classes"))
    b = o.filter("o_orderstatus = 'F'").groupBy("year").agg(F.count_distinct("o_custkey").alias("winners"))
    return a.join(b, "year", "left").select("year", "nominations", "classes", F.coalesce("winners", F.lit(0)).alias("winners"))


def share_of_total(spark, sf_dir):
    """Each type's share of all time spent."""
    per = table(spark, sf_dir, "events").groupBy("event_type").agg(F.sum("value").alias("spent"))
    total = per.agg(F.sum("spent").alias("all"))
    return per.crossJoin(F.broadcast(total)).select("event_type", F.round(F.try_divide("spent", "all"), 6).alias("share"))


def origin_load(spark, sf_dir):
    """Languages of a source as rows with a flag, the whole list as text, and sources without any known one."""
    docs = table(spark, sf_dir, "documents")
    per = docs.filter("lang IS NOT NULL AND n_chars > 5000").select("source", "lang").distinct()
    shown = per.groupBy("source").agg(F.array_join(F.array_sort(F.collect_list("lang")), ",").alias("langs"))
    rows = per.join(shown, "source").select("source", "lang", (F.col("lang") != "en").cast("int").alias("non_english"), "langs")
    unknown = docs.select("source").distinct().join(per, "source", "left_anti").select("source", F.lit("").alias("lang"), F.lit(1).alias("non_english"), F.lit(None).cast("string").alias("langs"))
    return rows.unionByName(unknown)


def lists_catalogue(spark, sf_dir):
    """Computed lists: all time, by genre, by decade and kind; each a filter over the ranked titles, 25 long."""
    t = _ranked(spark, sf_dir).filter("rank IS NOT NULL")
    lists = F.concat(F.array(F.lit("all")), F.transform("genres", lambda g: F.concat(F.lit("genre:"), g)), F.array(F.concat(F.lit("decade:"), (F.floor(F.col("year") / 10) * 10).cast("string")), F.concat(F.lit("kind:"), "kind")))
    rows = t.select("id", "rank", F.explode(lists).alias("list")).filter("list IS NOT NULL")
    return rows.withColumn("place", F.row_number().over(Window.partitionBy("list").orderBy(F.desc("rank"), "id"))).filter("place <= 25").select("list", "id", "place")


def shelves_front_page(spark, sf_dir):
    """Fixed shelves and one for each of the top genres: three times as many as shown, without what is owned, cut; empty ones go. U6: a title on several shelves stays on the last."""
    t = _ranked(spark, sf_dir).filter("rank IS NOT NULL")
    top = t.select(F.explode("genres").alias("genre")).groupBy("genre").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "genre").limit(5)
    fixed = t.select("id", "rank", F.explode(F.filter(F.array(F.lit("0 best"), F.when(F.col("votes") >= 40, F.lit("1 popular")), F.when(F.col("kind") == "PROMO", F.lit("2 promo"))), lambda x: x.isNotNull())).alias("shelf"))
    genres = t.select("id", "rank", F.explode("genres").alias("genre")).join(F.broadcast(top), "genre").select("id", "rank", F.concat(F.lit("3 "), "genre").alias("shelf"))
    over = fixed.unionByName(genres).withColumn("p", F.row_number().over(Window.partitionBy("shelf").orderBy(F.desc("rank"), "id"))).filter("p <= 30")
    owned = table(spark, sf_dir, "lineitem").filter("l_returnflag = 'R' AND l_quantity >= 48").select(F.col("l_partkey").alias("id"))
    once = over.join(owned, "id", "left_anti").groupBy("id").agg(F.max("shelf").alias("shelf"), F.first("rank").alias("rank"))
    return once.withColumn("place", F.row_number().over(Window.partitionBy("shelf").orderBy(F.desc("rank"), "id"))).filter("place <= 10").select("shelf", "id", "place")


def log_report_top(spark, sf_dir):
    """The twenty commonest queries, with how many had no result, were of two characters at least, and ranks by band."""
    q = F.get_json_object("props", "$.k")
    rows = table(spark, sf_dir, "events").withColumn("q", q)
    per = rows.groupBy("q").agg(F.count("*").alias("n"), F.count_distinct("user_id").alias("users"), F.count_if(F.col("value") < 1).alias("none"), F.count_if(F.col("value") < 10).alias("r0"), F.count_if((F.col("value") >= 10) & (F.col("value") < 50)).alias("r1"), F.count_if(F.col("value") >= 50).alias("r2"))
    return per.orderBy(F.desc("n"), "q").limit(20)


def rank_failures(spark, sf_dir):
    """Every query's clicks, and the click of the worst rank above zero; the twenty worst."""
    rows = _events(spark, sf_dir).filter("event_type = 'click'").select(F.get_json_object("props", "$.k").alias("q"), F.floor("value").alias("rank"), "event_id")
    worst = F.max_by(F.struct("rank", "event_id"), F.when(F.col("rank") > 0, F.struct("rank", -F.col("event_id")))).alias("w")
    per = rows.groupBy("q").agg(F.count("*").alias("clicks"), worst).filter("w IS NOT NULL")
    return per.select("q", "clicks", F.col("w.rank").alias("rank"), "w.event_id").orderBy(F.desc("rank"), "q").limit(20)


def replay_mean(spark, sf_dir):
    """Pairs of query and type at their deepest rank then and now; what is missing now counts as the whole window."""
    rows = _events(spark, sf_dir).select(F.get_json_object("props", "$.k").alias("q"), "event_type", F.floor("value").alias("rank"), (F.col("day") < "2024-01-16").alias("then"))
    per = rows.groupBy("q", "event_type").agg(F.max(F.when(F.col("then"), F.col("rank"))).alias("a"), F.max(F.when(~F.col("then"), F.col("rank"))).alias("b")).filter("a IS NOT NULL")
    return per.groupBy("event_type").agg(F.count("*").alias("pairs"), F.round(F.avg("a"), 4).alias("mean_then"), F.round(F.avg(F.coalesce("b", F.lit(WINDOW))), 4).alias("mean_now"))


NORM = "trim(regexp_replace(lower(p_name), '[^a-z0-9]+', ' ', 'g'))"
OWNED = "SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R' AND l_quantity >= 48"
EV = "ev AS (SELECT *, strftime(ts, '%Y-%m-%d') AS day, json_extract_string(props, '$.k') AS q FROM events)"
QUERIES = {
    "facet_filters": (facet_filters, f"""WITH {RANKED}, h AS (SELECT * FROM ranked WHERE rank IS NOT NULL ORDER BY rank DESC, id LIMIT 500)
      SELECT id, title, rank FROM h WHERE list_contains(string_split(title, ' '), 'red') AND year = 1995 AND kind IN ('PROMO', 'LARGE', 'SMALL')"""),
    "title_projection": (title_projection, f"WITH {TITLES} SELECT id, title, votes, CAST(NULL AS VARCHAR) AS lang, 0 AS buzz_votes FROM titles"),
    "name_equality": (name_equality, "SELECT 'exact' AS mode, count(*) FILTER (p_name = 'Red  Widget ') AS n FROM part UNION ALL SELECT 'loose', count(*) FILTER (lower(trim(p_name)) = 'red  widget') FROM part UNION ALL SELECT 'strict', count(*) FILTER (p_name = 'red widget') FROM part"),
    "all_phrases": (all_phrases, None),
    "commonest_label": (commonest_label, """WITH r AS (SELECT p_partkey, lower(split_part(p_name, ' ', 2)) AS key, CASE WHEN p_size % 3 = 0 THEN upper(substring(split_part(p_name, ' ', 2), 1, 1)) || substring(split_part(p_name, ' ', 2), 2) ELSE split_part(p_name, ' ', 2) END AS s FROM part),
      p AS (SELECT key, s, count(*) AS n FROM r GROUP BY 1, 2), b AS (SELECT key, s FROM p QUALIFY row_number() OVER (PARTITION BY key ORDER BY n DESC, s) = 1)
      SELECT p.key, any_value(b.s) AS label, CAST(sum(n) AS BIGINT) AS titles, sum(n) >= 2 AS linkable FROM p JOIN b ON p.key = b.key GROUP BY 1"""),
    "places_order": (places_order, """WITH n AS (SELECT n_regionkey, n_name AS label, (SELECT count(*) FROM supplier WHERE s_nationkey = n_nationkey) AS titles, CASE WHEN n_nationkey % 2 = 0 THEN 'site' ELSE 'area' END AS kind FROM nation)
      SELECT *, CAST(row_number() OVER (PARTITION BY n_regionkey ORDER BY titles >= 2 DESC, kind = 'site' DESC, titles DESC, label) AS INT) AS place FROM n"""),
    "release_order": (release_order, f"""WITH {TITLES} SELECT t.id, p_brand, CAST(row_number() OVER (PARTITION BY p_brand ORDER BY CASE WHEN kind <> 'PROMO' THEN year END ASC NULLS LAST, title, t.id) AS INT) AS place FROM titles t JOIN part ON p_partkey = t.id"""),
    "name_rank_order": (name_rank_order, f"""WITH n AS (SELECT {NORM} AS name, count(*) AS titles FROM part GROUP BY 1), t AS (SELECT *, CASE WHEN name = 'red bolt' THEN 0 WHEN starts_with(name, 'red') THEN 1 WHEN contains(name, 'e') THEN 2 END AS tier FROM n)
      SELECT * FROM t WHERE tier IS NOT NULL ORDER BY tier, titles DESC, name LIMIT 20"""),
    "class_order": (class_order, """SELECT o_orderkey, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY CASE o_orderpriority WHEN '2-HIGH' THEN 1 WHEN '1-URGENT' THEN 2 WHEN '3-MEDIUM' THEN 3 ELSE 4 END, o_orderstatus = 'F' DESC, o_orderkey) AS INT) AS place FROM orders"""),
    "user_order": (user_order, """WITH k AS (SELECT p_type, min(p_partkey) AS d FROM part GROUP BY 1), s AS (SELECT DISTINCT c_mktsegment FROM customer), o AS (SELECT *, CASE WHEN (length(p_type) + length(c_mktsegment)) % 3 <> 0 THEN length(p_type) END AS pos FROM s, k),
      a AS (SELECT *, coalesce(last_value(pos IGNORE NULLS) OVER (PARTITION BY c_mktsegment ORDER BY d), -1) AS anchor FROM o) SELECT c_mktsegment, p_type, CAST(row_number() OVER (PARTITION BY c_mktsegment ORDER BY anchor, pos IS NULL, d) AS INT) AS place FROM a"""),
    "tier_union": (tier_union, "SELECT p_partkey, CASE WHEN p_name = 'red bolt' THEN 'exact' WHEN p_name LIKE 'red %' THEN 'all' ELSE 'any' END AS tier FROM part WHERE p_name LIKE 'red %' OR p_name LIKE '%bolt'"),
    "shortlist_union": (shortlist_union, "WITH w AS (SELECT DISTINCT unnest(string_split(p_name, ' ')) AS term FROM part) SELECT term, CAST(least(levenshtein(term, 'bolt'), levenshtein(term, 'gear')) AS INT) AS distance FROM w WHERE least(levenshtein(term, 'bolt'), levenshtein(term, 'gear')) <= 3"),
    "capability_diff": (capability_diff, "SELECT DISTINCT p_brand, p_name FROM part WHERE p_size < 25 EXCEPT SELECT p_brand, p_name FROM part WHERE p_size >= 25"),
    "merge_contributions": (merge_contributions, """WITH g AS (SELECT l_partkey, l_returnflag, list_sort(list_distinct(list(l_linenumber))) AS items, CASE WHEN l_returnflag <> 'A' THEN min(l_tax) END AS tax, max(l_quantity) AS q FROM lineitem GROUP BY 1, 2)
      SELECT l_partkey, array_to_string(flatten(list(items ORDER BY l_returnflag)), ',') AS items, arg_min(tax, l_returnflag) FILTER (tax IS NOT NULL) AS single, arg_max(q, l_returnflag) AS overlay FROM g GROUP BY 1"""),
    "merged_facets": (merged_facets, """WITH p AS (SELECT l_partkey AS id, l_returnflag AS flag, CAST(max(l_quantity) AS BIGINT) AS q, min(l_linenumber) AS f, list_sort(list_distinct(list(l_linenumber))) AS lines
        FROM lineitem JOIN part ON p_partkey = l_partkey WHERE p_type IN ('PROMO', 'LARGE') GROUP BY 1, 2), s AS (SELECT *, max(len(lines)) OVER (PARTITION BY id) AS most FROM p)
      SELECT id, 'details' AS facet, string_agg(flag, '' ORDER BY flag) AS plugins, '{' || coalesce('"first":' || arg_max(f, flag) FILTER (flag <> 'N') || ',', '') || '"q":' || arg_max(q, flag) || '}' AS data FROM p GROUP BY 1
      UNION ALL SELECT id, 'lines', string_agg(flag, '' ORDER BY flag), '[' || string_agg(array_to_string(list_transform(lines, lambda n: '{"n":' || n || '}'), ','), ',' ORDER BY flag) || ']' FROM s WHERE len(lines) = most GROUP BY 1"""),
    "coverage_shelf": (coverage_shelf, """SELECT p_type AS kind, count(*) AS titles, count(c.id) AS covered, round(count(c.id) / count(*), 6) AS share FROM part LEFT JOIN (SELECT DISTINCT l_partkey AS id FROM lineitem WHERE l_returnflag = 'R' AND l_quantity >= 45) c ON c.id = p_partkey GROUP BY 1"""),
    "ceremony_summary": (ceremony_summary, "SELECT CAST(year(o_orderdate) AS INT) AS year, count(*) AS nominations, count(DISTINCT o_orderpriority) AS classes, count(DISTINCT CASE WHEN o_orderstatus = 'F' THEN o_custkey END) AS winners FROM orders GROUP BY 1"),
    "share_of_total": (share_of_total, "SELECT event_type, round(sum(value) / (SELECT sum(value) FROM events), 6) AS share FROM events GROUP BY 1"),
    "origin_load": (origin_load, """WITH p AS (SELECT DISTINCT source, lang FROM documents WHERE lang IS NOT NULL AND n_chars > 5000), s AS (SELECT source, string_agg(lang, ',' ORDER BY lang) AS langs FROM p GROUP BY 1)
      SELECT p.source, lang, CAST(lang <> 'en' AS INT) AS non_english, langs FROM p JOIN s ON s.source = p.source UNION ALL SELECT DISTINCT source, '', 1, NULL FROM documents WHERE source NOT IN (SELECT source FROM p)"""),
    "lists_catalogue": (lists_catalogue, f"""WITH {RANKED}, l AS (SELECT id, rank, unnest(list_concat(['all', 'decade:' || (year // 10 * 10), 'kind:' || kind], list_transform(list_distinct(string_split(title, ' ')), lambda g: 'genre:' || g))) AS list FROM ranked WHERE rank IS NOT NULL)
      SELECT list, id, CAST(row_number() OVER (PARTITION BY list ORDER BY rank DESC, id) AS INT) AS place FROM l WHERE list IS NOT NULL QUALIFY place <= 25"""),
    "shelves_front_page": (shelves_front_page, f"""WITH {RANKED}, g AS (SELECT id, rank, genre FROM genre WHERE rank IS NOT NULL), top AS (SELECT genre FROM g GROUP BY 1 ORDER BY count(*) DESC, genre LIMIT 5),
      s AS (SELECT id, rank, '0 best' AS shelf FROM ranked WHERE rank IS NOT NULL UNION ALL SELECT id, rank, '1 popular' FROM ranked WHERE rank IS NOT NULL AND votes >= 40 UNION ALL SELECT id, rank, '2 promo' FROM ranked WHERE rank IS NOT NULL AND kind = 'PROMO'
        UNION ALL SELECT id, rank, '3 ' || genre FROM g WHERE genre IN (SELECT genre FROM top)),
      o AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY shelf ORDER BY rank DESC, id) <= 30), u AS (SELECT id, max(shelf) AS shelf, any_value(rank) AS rank FROM o WHERE id NOT IN ({OWNED}) GROUP BY 1)
      SELECT shelf, id, CAST(row_number() OVER (PARTITION BY shelf ORDER BY rank DESC, id) AS INT) AS place FROM u QUALIFY place <= 10"""),
    "log_report_top": (log_report_top, f"""WITH {EV} SELECT q, count(*) AS n, count(DISTINCT user_id) AS users, count(*) FILTER (value < 1) AS none, count(*) FILTER (value < 10) AS r0, count(*) FILTER (value >= 10 AND value < 50) AS r1, count(*) FILTER (value >= 50) AS r2 FROM ev GROUP BY 1 ORDER BY n DESC, q LIMIT 20"""),
    "rank_failures": (rank_failures, f"""WITH {EV}, c AS (SELECT q, CAST(floor(value) AS BIGINT) AS rank, event_id, count(*) OVER (PARTITION BY q) AS clicks FROM ev WHERE event_type = 'click'),
      w AS (SELECT * FROM c WHERE rank > 0 QUALIFY row_number() OVER (PARTITION BY q ORDER BY rank DESC, event_id) = 1) SELECT q, clicks, rank, event_id FROM w ORDER BY rank DESC, q LIMIT 20"""),
    "replay_mean": (replay_mean, f"""WITH {EV}, p AS (SELECT q, event_type, max(floor(value)) FILTER (day < '2024-01-16') AS a, max(floor(value)) FILTER (day >= '2024-01-16') AS b FROM ev GROUP BY 1, 2)
      SELECT event_type, count(*) AS pairs, round(avg(a), 4) AS mean_then, round(avg(coalesce(b, {WINDOW})), 4) AS mean_now FROM p WHERE a IS NOT NULL GROUP BY 1"""),
}
