"""Debounced logs, sliding meters, caps, lists, places and neighbours in an order."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from folio.plans.logs import _events
from folio.session import table

RIPE, WIDTH, STEP, CAP = 3600, 3600, 600, 150.0


def log_debounce(spark, sf_dir):
    """What a user typed goes if a later query of the same filters within the window begins with it; only rows older than the window are ripe."""
    typed = F.lower(F.get_json_object("props", "$.k"))
    rows = _events(spark, sf_dir).withColumn("typed", typed)
    near = Window.partitionBy("user_id", "event_type").orderBy("sec").rangeBetween(0, RIPE)
    later = F.collect_list(F.struct("sec", "event_id", "typed")).over(near)
    own = F.struct("sec", "event_id")
    goes = F.exists("later", lambda x: (F.struct(x["sec"], x["event_id"]) > own) & x["typed"].startswith(F.col("typed")))
    ripe = rows.crossJoin(F.broadcast(rows.agg(F.max("sec").alias("now")))).withColumn("later", later)
    return ripe.filter((F.col("sec") <= F.col("now") - RIPE) & ~goes).select("event_id", "user_id", "event_type", "typed")


def sliding_meter(spark, sf_dir):
    """Counts of each user over windows of an hour that begin every ten minutes."""
    first = F.col("sec") - F.col("sec") % STEP
    starts = F.sequence(first - (WIDTH - STEP), first, F.lit(STEP))
    return _events(spark, sf_dir).select("user_id", F.explode(starts).alias("start")).groupBy("user_id", "start").agg(F.count("*").alias("n"))


def spend_cap(spark, sf_dir):
    """Users and days strictly over the cap."""
    per = _events(spark, sf_dir).groupBy("user_id", "day").agg(F.round(F.sum("value"), 2).alias("spent"))
    return per.filter(F.col("spent") > CAP)


def lists_completion(spark, sf_dir):
    """Titles of each kind, how many of them customer 1 has, and the share."""
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_type").alias("kind"))
    mine = table(spark, sf_dir, "orders").filter("o_custkey = 1").select("o_orderkey")
    owned = table(spark, sf_dir, "lineitem").join(mine, F.col("l_orderkey") == F.col("o_orderkey"), "left_semi").select(F.col("l_partkey").alias("id")).distinct().withColumn("own", F.lit(1))
    rows = part.join(owned, "id", "left").groupBy("kind").agg(F.count("*").alias("titles"), F.count("own").alias("owned"))
    return rows.withColumn("share", F.round(F.col("owned") / F.col("titles"), 6))


def places_rollup(spark, sf_dir):
    """People by place and by area; an area is the total of its places."""
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    sites = table(spark, sf_dir, "supplier").join(nation, F.col("s_nationkey") == F.col("n_nationkey")).join(region, F.col("n_regionkey") == F.col("r_regionkey"))
    return sites.rollup("r_name", "n_name").agg(F.count("*").alias("people"), F.grouping_id().cast("int").alias("level"))


def bool_any_override(spark, sf_dir):
    """Orders of which any line was returned, and whether all were."""
    flags = F.col("l_returnflag") == "R"
    return table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.bool_or(flags).alias("some"), F.bool_and(flags).alias("every")).filter("some")


def cond_distinct(spark, sf_dir):
    """Distinct titles of each supplier, and those in large lots."""
    return table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(F.count_distinct("l_partkey").alias("titles"), F.count_distinct(F.when(F.col("l_quantity") > 40, F.col("l_partkey"))).alias("large"))


def prev_next(spark, sf_dir):
    """The orders before and after each, within a customer."""
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    return table(spark, sf_dir, "orders").select("o_orderkey", F.lag("o_orderkey").over(w).alias("before"), F.lead("o_orderkey").over(w).alias("after"))


def award_timeline(spark, sf_dir):
    """By year and class of order, how many there were and how many were fulfilled."""
    return table(spark, sf_dir, "orders").groupBy(F.year("o_orderdate").alias("year"), "o_orderpriority").agg(F.count("*").alias("nominated"), F.count_if(F.col("o_orderstatus") == "F").alias("won"))


def leaderboards(spark, sf_dir):
    """Most nominated, and most without a win, three to a board."""
    per = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"), F.count_if(F.col("o_orderstatus") == "F").alias("won"))
    most = per.select(F.lit("nominated").alias("board"), "o_custkey", F.col("n").alias("score"))
    wins = per.select(F.lit("wins").alias("board"), "o_custkey", F.col("won").alias("score"))
    never = per.filter("won = 0").select(F.lit("never").alias("board"), "o_custkey", F.col("n").alias("score"))
    place = F.row_number().over(Window.partitionBy("board").orderBy(F.desc("score"), "o_custkey"))
    return most.unionByName(wins).unionByName(never).withColumn("place", place).filter("place <= 3")


EV = "ev AS (SELECT *, CAST(floor(epoch(ts)) AS BIGINT) AS sec, strftime(ts, '%Y-%m-%d') AS day FROM events)"
QUERIES = {
    "log_debounce": (log_debounce, f"""WITH {EV}, n AS (SELECT *, lower(json_extract_string(props, '$.k')) AS typed FROM ev)
      SELECT event_id, user_id, event_type, typed FROM n WHERE sec <= (SELECT max(sec) FROM n) - {RIPE} AND NOT EXISTS (SELECT 1 FROM n m WHERE m.user_id = n.user_id AND m.event_type = n.event_type
      AND (m.sec > n.sec OR m.sec = n.sec AND m.event_id > n.event_id) AND m.sec - n.sec <= {RIPE} AND starts_with(m.typed, n.typed))"""),
    "sliding_meter": (sliding_meter, f"""WITH {EV}, s AS (SELECT user_id, unnest(generate_series(sec - sec % {STEP} - {WIDTH - STEP}, sec - sec % {STEP}, {STEP})) AS start FROM ev)
      SELECT user_id, start, count(*) AS n FROM s GROUP BY 1, 2"""),
    "spend_cap": (spend_cap, f"WITH {EV} SELECT user_id, day, round(sum(value), 2) AS spent FROM ev GROUP BY 1, 2 HAVING round(sum(value), 2) > {CAP}"),
    "lists_completion": (lists_completion, """WITH o AS (SELECT DISTINCT l_partkey AS id FROM lineitem JOIN orders ON o_orderkey = l_orderkey AND o_custkey = 1)
      SELECT p_type AS kind, count(*) AS titles, count(o.id) AS owned, round(count(o.id) / count(*), 6) AS share FROM part LEFT JOIN o ON o.id = p_partkey GROUP BY 1"""),
    "places_rollup": (places_rollup, """SELECT r_name, n_name, count(*) AS people, CAST(grouping(r_name, n_name) AS INT) AS level FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ROLLUP (r_name, n_name)"""),
    "bool_any_override": (bool_any_override, "SELECT l_orderkey, bool_or(l_returnflag = 'R') AS some, bool_and(l_returnflag = 'R') AS every FROM lineitem GROUP BY 1 HAVING bool_or(l_returnflag = 'R')"),
    "cond_distinct": (cond_distinct, "SELECT l_suppkey, count(DISTINCT l_partkey) AS titles, count(DISTINCT CASE WHEN l_quantity > 40 THEN l_partkey END) AS large FROM lineitem GROUP BY 1"),
    "prev_next": (prev_next, "SELECT o_orderkey, lag(o_orderkey) OVER w AS before, lead(o_orderkey) OVER w AS after FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)"),
    "award_timeline": (award_timeline, "SELECT CAST(year(o_orderdate) AS INT) AS year, o_orderpriority, count(*) AS nominated, count(*) FILTER (o_orderstatus = 'F') AS won FROM orders GROUP BY 1, 2"),
    "leaderboards": (leaderboards, """WITH p AS (SELECT o_custkey, count(*) AS n, count(*) FILTER (o_orderstatus = 'F') AS won FROM orders GROUP BY 1),
      b AS (SELECT 'nominated' AS board, o_custkey, n AS score FROM p UNION ALL SELECT 'wins', o_custkey, won FROM p UNION ALL SELECT 'never', o_custkey, n FROM p WHERE won = 0)
      SELECT board, o_custkey, score, CAST(row_number() OVER (PARTITION BY board ORDER BY score DESC, o_custkey) AS INT) AS place FROM b QUALIFY place <= 3"""),
}
