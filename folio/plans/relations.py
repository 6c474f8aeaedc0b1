"""Joins and the graph of titles and people."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from folio.operators import catalogue, graph
from folio.plans.browse import TITLES
from folio.session import table

CREDITS = "credits AS (SELECT l_partkey AS title_id, l_suppkey AS person_id, l_returnflag AS category, CAST(min(l_linenumber) AS INT) AS ordering FROM lineitem GROUP BY 1, 2, 3)"


def left_coalesce_join(spark, sf_dir):
    """A left join whose result, or the row's own key, leads to the next table."""
    orders, cust, nation = (table(spark, sf_dir, t) for t in ("orders", "customer", "nation"))
    joined = orders.join(cust.filter("c_acctbal > 0"), orders.o_custkey == cust.c_custkey, "left").withColumn("key", F.coalesce("c_nationkey", F.lit(0)))
    return joined.join(F.broadcast(nation), joined.key == nation.n_nationkey).groupBy("n_name").agg(F.count("*").alias("n"), F.count("c_custkey").alias("known"))


def nulls_first_stale(spark, sf_dir):
    """The stalest customers, those that never ordered first."""
    last = table(spark, sf_dir, "orders").filter("o_orderstatus = 'P'").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max("o_orderdate").alias("last"))
    return table(spark, sf_dir, "customer").join(last, "c_custkey", "left").orderBy(F.asc_nulls_first("last"), "c_custkey").limit(40).select("c_custkey", F.to_date("last").alias("last_day"))


def composite_key_join(spark, sf_dir):
    """Two aggregates of different grain on a three-column key."""
    li = table(spark, sf_dir, "lineitem")
    a = li.groupBy("l_suppkey", "l_returnflag", "l_linestatus").agg(F.count("*").alias("n"))
    b = li.filter("l_quantity > 40").groupBy("l_suppkey", "l_returnflag", "l_linestatus").agg(F.count("*").alias("large"))
    return a.join(b, ["l_suppkey", "l_returnflag", "l_linestatus"]).select("l_suppkey", "l_returnflag", "l_linestatus", "n", "large")


def crosswalk_one_to_one(spark, sf_dir):
    """Orders and titles that are unambiguous on both sides within a supplier, of all lines; everywhere: over all suppliers as well."""
    pairs = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_orderkey", "l_partkey")
    whole = graph.one_to_one(pairs.select("l_orderkey", "l_partkey"), "l_orderkey", "l_partkey").withColumn("everywhere", F.lit(True))
    return graph.one_to_one(pairs, "l_orderkey", "l_partkey", "l_suppkey").join(whole, ["l_orderkey", "l_partkey"], "left").withColumn("everywhere", F.coalesce("everywhere", F.lit(False)))


def boolean_key_join(spark, sf_dir):
    """A key column chosen by a condition, and a flag in the join key."""
    part = table(spark, sf_dir, "part").select("p_partkey", (F.col("p_type") == "PROMO").alias("promo"), F.when(F.col("p_type") == "PROMO", F.col("p_size")).otherwise(F.col("p_partkey") % 50).cast("long").alias("key"))
    side = table(spark, sf_dir, "supplier").select((F.col("s_acctbal") > 5000).alias("promo"), (F.col("s_suppkey") % 50).alias("key"), "s_suppkey")
    return part.join(side, ["promo", "key"]).groupBy("promo").agg(F.count("*").alias("n"), F.count_distinct("p_partkey").alias("parts"))


def collaborators(spark, sf_dir):
    """Who shares most titles with supplier 1, by shared titles, then votes."""
    credits = catalogue.credits(spark, sf_dir)
    votes = catalogue.titles(spark, sf_dir).select(F.col("id").alias("title_id"), "votes")
    shared = graph.collaborators(credits, 1, 2)
    weight = credits.join(shared.select("person_id"), "person_id", "left_semi").select("title_id", "person_id").distinct().join(votes, "title_id").groupBy("person_id").agg(F.sum("votes").alias("votes"))
    return shared.join(weight, "person_id").join(catalogue.people(spark, sf_dir), "person_id").orderBy(F.desc("shared"), F.desc("votes"), "name", "person_id").limit(12).select("person_id", "name", "shared", "votes")


def credit_tally(spark, sf_dir):
    """Credits per category and person over a set of titles."""
    head = catalogue.titles(spark, sf_dir).orderBy(F.desc("votes"), "id").limit(300).select(F.col("id").alias("title_id"))
    return catalogue.credits(spark, sf_dir).join(head, "title_id", "left_semi").groupBy("category", "person_id").agg(F.count_distinct("title_id").alias("titles"))


def relational_division(spark, sf_dir):
    """Titles with credits of all three categories."""
    return graph.everywhere(catalogue.credits(spark, sf_dir), "title_id", "category", ["A", "N", "R"])


def listcast_union(spark, sf_dir):
    """The cast of three titles, with the titles each person is in."""
    rows = catalogue.credits(spark, sf_dir).filter(F.col("title_id").isin(1, 2, 3))
    return rows.groupBy("person_id").agg(F.count_distinct("title_id").alias("titles"), F.array_join(F.array_sort(F.collect_set("category")), ",").alias("roles"))


def listcast_intersection(spark, sf_dir):
    """U4: people credited in two whole groups of titles."""
    rows = catalogue.credits(spark, sf_dir).select("person_id", (F.col("title_id") % 100).alias("group"))
    return graph.everywhere(rows, "person_id", "group", [1, 2, 3])


def graph_two_hop(spark, sf_dir):
    """Paths of one and two bridges between suppliers 1 and 2, neighbours capped at 40."""
    return graph.paths(catalogue.credits(spark, sf_dir), 1, 2, 40)


def connections(spark, sf_dir):
    """How suppliers 1 and 2 are connected, strongest first: a walk that is stopped again and again and goes on where it stopped."""
    titles = catalogue.titles(spark, sf_dir).select("id", F.col("votes").alias("weight"))
    walk = graph.Connections(catalogue.credits(spark, sf_dir), titles, 1, 2)
    found, cursor = None, 0
    while cursor is not None:
        more, cursor = walk.go(800, cursor)
        found = more if found is None else found.unionByName(more)
    return found.orderBy("hops", F.desc("strength"), "t1", F.col("via").asc_nulls_first(), "t2").limit(200)


def filmography(spark, sf_dir):
    """A person's titles with categories and first ordering."""
    rows = catalogue.credits(spark, sf_dir).filter("person_id = 1").groupBy("title_id").agg(F.array_join(F.array_sort(F.collect_set("category")), ",").alias("categories"), F.min("ordering").alias("ordering"))
    titles = catalogue.titles(spark, sf_dir)
    return rows.join(titles, rows.title_id == titles.id).select("title_id", "title", "year", "votes", "categories", "ordering")


def category_counts(spark, sf_dir):
    """A5: distinct titles per person and category."""
    return catalogue.credits(spark, sf_dir).groupBy("person_id", "category").agg(F.count_distinct("title_id").alias("titles"))


def person_popularity(spark, sf_dir):
    """Highest votes and distinct titles of every person."""
    votes = catalogue.titles(spark, sf_dir).select(F.col("id").alias("title_id"), "votes")
    return catalogue.credits(spark, sf_dir).join(votes, "title_id").groupBy("person_id").agg(F.max("votes").alias("top_votes"), F.count_distinct("title_id").alias("credits"))


def cast_eligibility(spark, sf_dir):
    """Credits of the wanted categories, of titles with enough votes or recent enough."""
    wanted = catalogue.titles(spark, sf_dir).filter("votes >= 35 OR year >= 1994").select(F.col("id").alias("title_id"))
    return catalogue.credits(spark, sf_dir).filter(F.col("category").isin("A", "N")).join(wanted, "title_id", "left_semi").groupBy("category").agg(F.count("*").alias("n"), F.count_distinct("title_id").alias("titles"))


def unordered_pairs(spark, sf_dir):
    """U8: unordered pairs of kinds bought in one order, as one key."""
    li, part = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey"), table(spark, sf_dir, "part").select("p_partkey", "p_type")
    kinds = li.join(part, li.l_partkey == part.p_partkey).select("l_orderkey", "p_type").distinct()
    other = kinds.select("l_orderkey", F.col("p_type").alias("q_type"))
    pairs = kinds.join(other, "l_orderkey").filter("p_type < q_type")
    return pairs.groupBy(F.concat_ws("|", F.least("p_type", "q_type"), F.greatest("p_type", "q_type")).alias("pair")).agg(F.count("*").alias("n"))


def carry_forward(spark, sf_dir):
    """Credits of an earlier snapshot re-attached by the stable name of their title."""
    part = table(spark, sf_dir, "part")
    early = table(spark, sf_dir, "lineitem").filter("l_shipdate < '1997-01-01'").select(F.col("l_partkey").alias("title_id"), F.col("l_suppkey").alias("person_id"), F.col("l_returnflag").alias("category")).distinct()
    old = early.join(part.select(F.col("p_partkey").alias("title_id"), "p_name", "p_brand"), "title_id")
    new = graph.single(part.withColumn("name", F.concat_ws("#", "p_name", "p_brand", "p_size")), "name", "p_partkey")
    names = part.select(F.col("p_partkey").alias("title_id"), F.concat_ws("#", "p_name", "p_brand", "p_size").alias("name"))
    return old.join(names, "title_id").join(new, "name").groupBy(F.col("p_partkey").alias("title_id")).agg(F.count("*").alias("n"))


QUERIES = {
    "left_coalesce_join": (left_coalesce_join, """SELECT n_name, count(*) AS n, count(c_custkey) AS known FROM orders LEFT JOIN (SELECT * FROM customer WHERE c_acctbal > 0) c ON o_custkey = c_custkey
      JOIN nation ON n_nationkey = coalesce(c_nationkey, 0) GROUP BY n_name"""),
    "nulls_first_stale": (nulls_first_stale, """SELECT c_custkey, CAST(last AS DATE) AS last_day FROM customer LEFT JOIN (SELECT o_custkey, max(o_orderdate) AS last FROM orders WHERE o_orderstatus = 'P' GROUP BY 1) o
      ON o_custkey = c_custkey ORDER BY last ASC NULLS FIRST, c_custkey LIMIT 40"""),
    "composite_key_join": (composite_key_join, """SELECT a.l_suppkey, a.l_returnflag, a.l_linestatus, a.n, b.large FROM
      (SELECT l_suppkey, l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY 1, 2, 3) a JOIN
      (SELECT l_suppkey, l_returnflag, l_linestatus, count(*) AS large FROM lineitem WHERE l_quantity > 40 GROUP BY 1, 2, 3) b
      ON a.l_suppkey = b.l_suppkey AND a.l_returnflag = b.l_returnflag AND a.l_linestatus = b.l_linestatus"""),
    "crosswalk_one_to_one": (crosswalk_one_to_one, """WITH q AS (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem), s AS (SELECT DISTINCT l_suppkey, l_orderkey, l_partkey FROM lineitem),
      w AS (SELECT l_orderkey, l_partkey FROM q WHERE l_orderkey IN (SELECT l_orderkey FROM q GROUP BY 1 HAVING count(*) = 1) AND l_partkey IN (SELECT l_partkey FROM q GROUP BY 1 HAVING count(*) = 1))
      SELECT l_suppkey, l_orderkey, l_partkey, (l_orderkey, l_partkey) IN (SELECT (l_orderkey, l_partkey) FROM w) AS everywhere FROM s
      WHERE (l_suppkey, l_orderkey) IN (SELECT (l_suppkey, l_orderkey) FROM s GROUP BY l_suppkey, l_orderkey HAVING count(*) = 1) AND (l_suppkey, l_partkey) IN (SELECT (l_suppkey, l_partkey) FROM s GROUP BY l_suppkey, l_partkey HAVING count(*) = 1)"""),
    "boolean_key_join": (boolean_key_join, """SELECT p.promo, count(*) AS n, count(DISTINCT p_partkey) AS parts FROM (SELECT p_partkey, p_type = 'PROMO' AS promo, CASE WHEN p_type = 'PROMO' THEN p_size ELSE p_partkey % 50 END AS key FROM part) p
      JOIN (SELECT s_acctbal > 5000 AS promo, s_suppkey % 50 AS key FROM supplier) s ON p.promo = s.promo AND p.key = s.key GROUP BY p.promo"""),
    "collaborators": (collaborators, f"""WITH {TITLES}, {CREDITS}, pairs AS (SELECT DISTINCT title_id, person_id FROM credits),
      shared AS (SELECT b.person_id, count(*) AS shared FROM pairs a JOIN pairs b ON a.title_id = b.title_id AND a.person_id = 1 AND b.person_id <> 1 GROUP BY 1 HAVING count(*) >= 2),
      w AS (SELECT person_id, CAST(sum(votes) AS BIGINT) AS votes FROM pairs JOIN titles ON id = title_id GROUP BY 1)
      SELECT person_id, s_name AS name, shared, votes FROM shared JOIN w USING (person_id) JOIN supplier ON s_suppkey = person_id ORDER BY shared DESC, votes DESC, name, person_id LIMIT 12"""),
    "credit_tally": (credit_tally, f"""WITH {TITLES}, {CREDITS} SELECT category, person_id, count(DISTINCT title_id) AS titles FROM credits
      WHERE title_id IN (SELECT id FROM titles ORDER BY votes DESC, id LIMIT 300) GROUP BY 1, 2"""),
    "relational_division": (relational_division, f"WITH {CREDITS} SELECT title_id FROM credits WHERE category IN ('A', 'N', 'R') GROUP BY 1 HAVING count(DISTINCT category) = 3"),
    "listcast_union": (listcast_union, f"WITH {CREDITS} SELECT person_id, count(DISTINCT title_id) AS titles, string_agg(DISTINCT category, ',' ORDER BY category) AS roles FROM credits WHERE title_id IN (1, 2, 3) GROUP BY 1"),
    "listcast_intersection": (listcast_intersection, f"WITH {CREDITS} SELECT person_id FROM credits WHERE title_id % 100 IN (1, 2, 3) GROUP BY 1 HAVING count(DISTINCT title_id % 100) = 3"),
    "graph_two_hop": (graph_two_hop, f"""WITH {CREDITS}, edges AS (SELECT title_id, person_id, min(ordering) AS o FROM credits GROUP BY 1, 2),
      op AS (SELECT * FROM edges QUALIFY row_number() OVER (PARTITION BY person_id ORDER BY o, title_id) <= 40), ot AS (SELECT * FROM edges QUALIFY row_number() OVER (PARTITION BY title_id ORDER BY o, person_id) <= 40)
      SELECT a.title_id AS t1, CAST(NULL AS BIGINT) AS via, CAST(NULL AS BIGINT) AS t2, 1 AS hops FROM op a JOIN op b ON a.title_id = b.title_id AND a.person_id = 1 AND b.person_id = 2
      UNION ALL SELECT a.title_id, x.person_id, b.title_id, 2 FROM op a JOIN ot x ON x.title_id = a.title_id JOIN ot y ON y.person_id = x.person_id JOIN op b ON b.title_id = y.title_id
      WHERE a.person_id = 1 AND b.person_id = 2 AND x.person_id NOT IN (1, 2) AND a.title_id <> b.title_id"""),
    "connections": (connections, f"""WITH {TITLES}, {CREDITS}, e AS (SELECT DISTINCT title_id, person_id FROM credits), et AS (SELECT e.*, votes FROM e JOIN titles ON id = title_id),
      w AS (SELECT person_id, max(votes) AS weight FROM et GROUP BY 1), mine AS (SELECT * FROM et QUALIFY row_number() OVER (PARTITION BY person_id ORDER BY votes DESC, title_id) <= 40),
      cast_ AS (SELECT title_id, person_id, weight FROM e JOIN w USING (person_id) QUALIFY row_number() OVER (PARTITION BY title_id ORDER BY weight DESC, person_id) <= 40)
      SELECT * FROM (SELECT a.title_id AS t1, CAST(NULL AS BIGINT) AS via, CAST(NULL AS BIGINT) AS t2, 1 AS hops, a.votes AS strength FROM mine a JOIN mine b ON a.title_id = b.title_id AND a.person_id = 1 AND b.person_id = 2
      UNION ALL SELECT a.title_id, x.person_id, o.title_id, 2, weight FROM mine a JOIN cast_ x ON x.title_id = a.title_id AND x.person_id NOT IN (1, 2) JOIN mine o ON o.person_id = x.person_id JOIN mine b ON b.title_id = o.title_id
      WHERE a.person_id = 1 AND b.person_id = 2 AND a.title_id <> o.title_id) ORDER BY hops, strength DESC, t1, via NULLS FIRST, t2 LIMIT 200"""),
    "filmography": (filmography, f"""WITH {TITLES}, {CREDITS} SELECT title_id, any_value(title) AS title, any_value(year) AS year, any_value(votes) AS votes, string_agg(DISTINCT category, ',' ORDER BY category) AS categories, min(ordering) AS ordering
      FROM credits JOIN titles ON id = title_id WHERE person_id = 1 GROUP BY title_id"""),
    "category_counts": (category_counts, f"WITH {CREDITS} SELECT person_id, category, count(DISTINCT title_id) AS titles FROM credits GROUP BY 1, 2"),
    "person_popularity": (person_popularity, f"WITH {TITLES}, {CREDITS} SELECT person_id, max(votes) AS top_votes, count(DISTINCT title_id) AS credits FROM credits JOIN titles ON id = title_id GROUP BY 1"),
    "cast_eligibility": (cast_eligibility, f"""WITH {TITLES}, {CREDITS} SELECT category, count(*) AS n, count(DISTINCT title_id) AS titles FROM credits WHERE category IN ('A', 'N')
      AND title_id IN (SELECT id FROM titles WHERE votes >= 35 OR year >= 1994) GROUP BY 1"""),
    "unordered_pairs": (unordered_pairs, """WITH k AS (SELECT DISTINCT l_orderkey, p_type FROM lineitem JOIN part ON p_partkey = l_partkey)
      SELECT a.p_type || '|' || b.p_type AS pair, count(*) AS n FROM k a JOIN k b ON a.l_orderkey = b.l_orderkey AND a.p_type < b.p_type GROUP BY 1"""),
    "carry_forward": (carry_forward, """WITH names AS (SELECT p_partkey, p_name || '#' || p_brand || '#' || p_size AS name FROM part), new AS (SELECT name, min(p_partkey) AS id FROM names GROUP BY 1 HAVING count(*) = 1)
      SELECT id AS title_id, count(*) AS n FROM (SELECT DISTINCT l_partkey, l_suppkey, l_returnflag FROM lineitem WHERE l_shipdate < '1997-01-01') JOIN names ON p_partkey = l_partkey JOIN new USING (name) GROUP BY 1"""),
}
