"""Requests, evidence, caches and quotas: state ladders, newest and nearest records, progress, versions, retries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from folio.functions import text as T
from folio.operators import state
from folio.plans.logs import _events
from folio.session import table

AS_OF, NOW = "1998-09-01", "2024-01-30 00:00:00"
# Minutes between attempts, most attempts, attempts beyond which a day without a release is enough to give up, days that an entry of a class stays fresh.
DELAYS, MOST, GIVEN_UP = (1, 5, 15, 30, 60), 24, 9
FRESH = (("volatile", 7), ("recent", 14), ("settled", 90))


def expiry_filter(spark, sf_dir):
    """Entries that never expire, or not yet."""
    rows = table(spark, sf_dir, "orders").withColumn("expires", F.when(F.col("o_orderstatus") != "P", F.date_add(F.to_date("o_orderdate"), 90)))
    return rows.filter(F.col("expires").isNull() | (F.col("expires") > F.lit(AS_OF).cast("date"))).groupBy("o_orderstatus").agg(F.count("*").alias("n"))


def date_window(spark, sf_dir):
    """Lines from four days before to fourteen after a day."""
    away = F.datediff("l_shipdate", F.lit(AS_OF).cast("date"))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", away.alias("away")).filter("away BETWEEN -4 AND 14")


def case_standing(spark, sf_dir):
    """Lines by standing; the first condition that holds decides."""
    held, wanted, aired = F.col("l_linestatus") == "F", F.col("l_returnflag") != "N", F.to_date("l_shipdate") <= F.lit(AS_OF).cast("date")
    standing = F.when(F.col("l_returnflag").isNull(), "unknown").when(held, "owned").when(~aired, "unknown").when(wanted, "wanted").otherwise("missing")
    return table(spark, sf_dir, "lineitem").groupBy(standing.alias("standing")).agg(F.count("*").alias("n"))


def request_log(spark, sf_dir):
    """Requests in ordered states with a line of evidence, news first, then newest; given up only after many attempts and a day."""
    r = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.sum("l_linenumber").alias("attempts"), F.max("l_shipdate").alias("last")), F.col("o_orderkey") == F.col("l_orderkey"))
    old = F.datediff(F.lit(AS_OF).cast("date"), F.to_date("last")) > 1
    state_ = F.when(F.col("o_orderstatus") == "F", "done").when((F.col("attempts") > GIVEN_UP) & old, "no_release").when(F.col("o_orderstatus") == "P", "waiting").otherwise("open")
    rows = r.withColumn("state", state_).withColumn("bucket", F.array_position(F.array(*map(F.lit, ("no_release", "waiting", "open", "done"))), F.col("state")).cast("int"))
    news = F.to_date("last") > F.lit("1998-08-01").cast("date")
    place = F.row_number().over(Window.partitionBy("o_custkey").orderBy(news.cast("int").desc(), F.desc("o_orderdate"), F.desc("o_orderkey")))
    evidence = F.concat(F.col("attempts").cast("string"), F.lit(" attempts, last "), F.date_format("last", "yyyy-MM-dd"))
    return rows.select("o_custkey", "o_orderkey", "state", "bucket", evidence.alias("evidence"), place.alias("place"))


def finished_flags(spark, sf_dir):
    """Finished if what remains is at most 5 % and at most 180."""
    left = F.col("l_extendedprice") * F.col("l_discount")
    done = left <= F.least(0.05 * F.col("l_extendedprice"), F.lit(180.0))
    return table(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(F.count_if(done).alias("finished"), F.count("*").alias("n"))


def glob_exclusion(spark, sf_dir):
    """Kinds without those that a pattern names, whole or by prefix."""
    hidden = F.lit(False)
    for glob in ("PROMO", "S*"):
        hidden = hidden | (F.col("p_type").startswith(glob[:-1]) if glob.endswith("*") else F.col("p_type") == glob)
    return table(spark, sf_dir, "part").filter(~hidden).groupBy("p_type").agg(F.count("*").alias("n"))


def event_validation(spark, sf_dir):
    """Rows of well-formed JSON, a rank of zero or more, a known type and a positive id."""
    rank = F.try_to_number(F.get_json_object("props", "$.k"), F.lit("999999"))
    ok = F.coalesce((rank >= 0) & F.col("event_type").isin("click", "view", "purchase") & F.col("event_id").cast("string").rlike("^[1-9][0-9]*$"), F.lit(False))
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.count_if(ok).alias("valid"), F.count_if(~ok).alias("dropped"))


def upcoming_nearest(spark, sf_dir):
    """Each customer's order nearest to a day; of two the earlier, then the smaller key."""
    day = F.lit(AS_OF).cast("date")
    key = F.struct(F.abs(F.datediff("o_orderdate", day)), F.to_date("o_orderdate"), "o_orderkey")
    soonest = F.min(F.when(F.to_date("o_orderdate") > day, F.to_date("o_orderdate")))
    return table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.min_by("o_orderkey", key).alias("nearest"), F.date_format(soonest, "yyyy-MM-dd").alias("soonest"))


def newest_wins(spark, sf_dir):
    """Status and price of each customer's newest order, as one row, ties to the larger key."""
    best = F.max_by(F.struct("o_orderstatus", "o_totalprice"), F.struct("o_orderdate", "o_orderkey")).alias("b")
    return table(spark, sf_dir, "orders").groupBy("o_custkey").agg(best).select("o_custkey", "b.o_orderstatus", "b.o_totalprice")


def exists_any(spark, sf_dir):
    """Whether there is any, without counting."""
    out = None
    for name, cond in (("urgent", "o_orderpriority = '1-URGENT'"), ("future", "o_orderdate > '2030-01-01'")):
        one = table(spark, sf_dir, "orders").filter(cond).limit(1).agg((F.count("*") > 0).alias("found")).select(F.lit(name).alias("asked"), "found")
        out = one if out is None else out.unionByName(one)
    return out


def multi_count(spark, sf_dir):
    """Several counts of a user in one pass; users without any have zeros."""
    users = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("user_id"))
    kinds = ("click", "error", "purchase")
    per = table(spark, sf_dir, "events").groupBy("user_id").agg(*(F.count_if(F.col("event_type") == k).alias(k) for k in kinds))
    return users.join(per, "user_id", "left").select("user_id", *(F.coalesce(k, F.lit(0)).alias(k) for k in kinds))


def spend_sum(spark, sf_dir):
    """What each user spent on a day, nothing as zero."""
    users = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("user_id"))
    day = _events(spark, sf_dir).filter("day = '2024-01-15' AND event_type = 'purchase'").groupBy("user_id").agg(F.sum("value").alias("s"))
    return users.join(day, "user_id", "left").select("user_id", F.coalesce(F.round("s", 4), F.lit(0.0)).alias("spent"))


def progress_sums(spark, sf_dir):
    """Progress of downloads by coalesced id: what is there of what there is, and the latest end."""
    size, left = F.col("l_extendedprice"), F.least(F.greatest(F.col("l_extendedprice") * F.col("l_tax") * 20 - 100, F.lit(0.0)), F.col("l_extendedprice"))
    key = F.coalesce(F.when(F.col("l_returnflag") == "N", F.col("l_suppkey")), F.col("l_partkey"))
    return table(spark, sf_dir, "lineitem").groupBy(key.alias("id")).agg(F.round(F.try_divide(F.sum(size - left), F.sum(size)), 6).alias("progress"), F.to_date(F.max("l_shipdate")).cast("string").alias("eta"))


def search_evidence(spark, sf_dir):
    """For every user with an open request, distinct sources and the most results since a time."""
    since = _events(spark, sf_dir).filter("day >= '2024-01-10'").groupBy("user_id").agg(F.count_distinct("event_type").alias("sources"), F.max("value").alias("most"))
    open_ = table(spark, sf_dir, "orders").filter("o_orderstatus = 'P'").groupBy(F.col("o_custkey").alias("user_id")).agg(F.count("*").alias("open"))
    return open_.join(since, "user_id", "left").select("user_id", "open", F.coalesce("sources", F.lit(0)).alias("sources"), "most")


def merge_ratings(spark, sf_dir):
    """One measurement a key: local ones first, then of the richest source, above zero only."""
    li = table(spark, sf_dir, "lineitem")
    rows = li.groupBy(F.col("l_partkey").alias("id"), F.col("l_returnflag").alias("source")).agg(F.count("*").alias("votes"), F.round(F.avg("l_discount"), 6).alias("value")).filter("value > 0")
    best = F.max_by(F.struct("source", "value"), F.struct((F.col("source") == "R").cast("int"), "votes", "source")).alias("b")
    return rows.groupBy("id").agg(best).select("id", "b.source", "b.value")


def run_comparison(spark, sf_dir):
    """A measure of two runs on the keys that both have, and their ratio."""
    rows = _events(spark, sf_dir).withColumn("run", F.when(F.col("day") < "2024-01-16", 0).otherwise(1))
    mean = rows.groupBy("user_id", "event_type").agg(*(F.avg(F.when(F.col("run") == k, F.col("value"))).alias(f"m{k}") for k in (0, 1)))
    return mean.filter("m0 IS NOT NULL AND m1 IS NOT NULL").select("user_id", "event_type", F.round(F.try_divide("m1", "m0"), 6).alias("ratio"))


def first_guid(spark, sf_dir):
    """The first identifier of a scheme in each order's list; orders without one are dropped."""
    guid = F.concat(F.lower("l_returnflag"), F.lit("://"), F.col("l_partkey").cast("string"))
    lists = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_suppkey", guid.alias("guid")))).alias("all"))
    hit = F.get(F.filter("all", lambda x: x["guid"].startswith("r://")), F.lit(0))
    return lists.select("l_orderkey", hit["guid"].alias("guid")).filter("guid IS NOT NULL")


def freshness_classes(spark, sf_dir):
    """T8 2.10: entries by class of their age, and how many of each class are still fresh after an idle time; the class sets the time."""
    age = F.datediff(F.lit(AS_OF).cast("date"), "o_orderdate")
    name, days = F.lit("immutable"), F.lit(None).cast("int")
    for k, (label, ttl) in reversed(list(enumerate(FRESH))):
        old = age <= (30, 365, 1500)[k]
        name, days = F.when(old, F.lit(label)).otherwise(name), F.when(old, F.lit(ttl)).otherwise(days)
    rows = table(spark, sf_dir, "orders").filter(age >= 0).select(name.alias("class"), days.alias("ttl"), (F.col("o_orderkey") % 100).alias("idle"))
    return rows.groupBy("class").agg(F.count("*").alias("n"), F.count_if(F.col("ttl").isNull() | (F.col("idle") <= F.col("ttl"))).alias("fresh"))


def current_version(spark, sf_dir):
    """Of each key the data of the current version, else the newest of an older one."""
    rows = table(spark, sf_dir, "orders")
    best = F.max_by(F.struct("o_orderkey", "o_orderstatus"), F.struct((F.col("o_orderstatus") == "P").cast("int"), "o_orderdate", "o_orderkey")).alias("b")
    return rows.groupBy("o_custkey").agg(best).select("o_custkey", "b.o_orderkey", (F.col("b.o_orderstatus") == "P").alias("current"))


def superseded_prune(spark, sf_dir):
    """An old version goes only where the same key has a current one."""
    rows = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderstatus")
    current = rows.filter("o_orderstatus = 'P'").select("o_custkey").distinct()
    old = rows.filter("o_orderstatus <> 'P'")
    return rows.filter("o_orderstatus = 'P'").unionByName(old.join(current, "o_custkey", "left_anti"))


def retry_schedule(spark, sf_dir):
    """Attempts of a user, the wait after each, and whether it may be tried again."""
    errors = _events(spark, sf_dir).filter("event_type = 'error'").withColumn("attempt", F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")))
    wait = F.element_at(F.array(*map(F.lit, DELAYS)), F.least("attempt", F.lit(len(DELAYS))))
    due = F.when(F.col("attempt") < MOST, F.col("sec") + wait * 60)
    return errors.select("event_id", "user_id", "attempt", due.alias("due"), F.when(F.col("attempt") < MOST, "waiting").otherwise("failed").alias("state"))


def flush_batches(spark, sf_dir):
    """Rows that each flush writes, and what a bounded buffer dropped."""
    cap, every = 12, 3600
    rows = _events(spark, sf_dir).groupBy((F.col("sec") - F.col("sec") % every).alias("flush")).agg(F.count("*").alias("n"))
    return rows.select("flush", F.least("n", F.lit(cap)).alias("written"), F.greatest(F.col("n") - cap, F.lit(0)).alias("dropped"))


def rate_limit_fixed(spark, sf_dir):
    """T4: a fixed window opens at a user's first event after the last window; so many events pass in each."""
    return state.anchored_windows(_events(spark, sf_dir).select("user_id", "event_id", "sec"), "user_id", "sec", "event_id", width=43_200, allowed=2)


def greedy_min_gap(spark, sf_dir):
    """From each user's first event on, events at least a day after the one taken before."""
    return state.min_gap(_events(spark, sf_dir).select("user_id", "event_id", "sec"), "user_id", "sec", "event_id", gap=86_400)


def sampler_p95(spark, sf_dir):
    """The nearest-rank 95th percentile of the last samples of each type."""
    last = F.row_number().over(Window.partitionBy("event_type").orderBy(F.desc("ts"), F.desc("event_id")))
    kept = _events(spark, sf_dir).withColumn("back", last).filter("back <= 256").groupBy("event_type").agg(F.array_sort(F.collect_list("value")).alias("all"))
    n = F.size("all")
    return kept.select("event_type", n.alias("samples"), F.element_at("all", F.greatest(F.ceil(n * 0.95), F.lit(1)).cast("int")).alias("p95"))


def sliced_ring(spark, sf_dir):
    """T5: the newest slices of each type; older ones are evicted."""
    per = _events(spark, sf_dir).groupBy("event_type", (F.col("sec") - F.col("sec") % 1800).alias("slice")).agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
    back = F.row_number().over(Window.partitionBy("event_type").orderBy(F.desc("slice")))
    return per.withColumn("back", back).filter("back <= 240").drop("back")


def session_totals(spark, sf_dir):
    """T5: totals of the sessions (users) that each meter (type) still tracks, when it tracks eight and the one that was idle longest makes room."""
    rows = _events(spark, sf_dir).filter("value > 0").select("event_type", "sec", "event_id", "user_id", F.round(F.col("value") * 100).cast("long").alias("charge"))
    return state.bounded_totals(rows, "event_type", "sec", "event_id", "user_id", "charge", most=8)


def meter_verdict(spark, sf_dir):
    """What a user used over a window, and whether it is allowed, slowed (by how much) or refused."""
    budget, most = 20.0, 4
    used = _events(spark, sf_dir).groupBy("user_id", (F.col("sec") - F.col("sec") % 3600).alias("start")).agg(F.round(F.sum("value"), 4).alias("used"))
    verdict = F.when(F.col("used") > most * budget, "refuse").when(F.col("used") > budget, "slow").otherwise("allow")
    delay = F.when(verdict == "slow", F.round(F.least(F.lit(2.0), 2.0 * (F.col("used") - budget) / (budget * (most - 1))), 4)).otherwise(0.0)
    return used.select("user_id", "start", "used", verdict.alias("verdict"), delay.alias("delay"))


def import_planning(spark, sf_dir):
    """Rows to create, or why they are skipped."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderpriority", F.to_date("o_orderdate").alias("day"))
    again = F.row_number().over(Window.partitionBy("o_custkey", "o_orderpriority").orderBy("o_orderkey")) > 1
    linked = table(spark, sf_dir, "events").filter("event_type = 'signup'").select(F.col("user_id").alias("o_custkey")).distinct().withColumn("linked", F.lit(True))
    why = F.when(F.col("o_custkey").isNull(), "no id").when(F.col("o_orderpriority") == "5-LOW", "excluded").when(F.col("linked"), "already linked").when(again, "duplicate").otherwise("create")
    return o.join(linked, "o_custkey", "left").select("o_orderkey", why.alias("plan"))


def mentions(spark, sf_dir):
    """Titles and people that an answer names by id, the first sixty of each answer; ids that nothing has stay plain text."""
    line = F.concat(F.lit("As tt"), "l_partkey", F.lit(" (nm"), "l_suppkey", F.lit(") and xtt1, tt2y, nm, tt"), F.col("l_partkey") + 10_000_000, F.lit(" say."))
    said = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", line.alias("line")))), lambda x: x.line), " ")
    answers = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(said.alias("text"))
    named = answers.select("l_orderkey", F.posexplode(F.slice(T.ids_in(F.col("text")), 1, 60)).alias("place", "id"))
    number = F.substring("id", 3, 20).cast("long")
    titles = table(spark, sf_dir, "part").select(F.concat(F.lit("tt"), "p_partkey").alias("id"), F.lit("title").alias("kind"), F.col("p_name").alias("label"))
    people = table(spark, sf_dir, "supplier").select(F.concat(F.lit("nm"), "s_suppkey").alias("id"), F.lit("person").alias("kind"), F.col("s_name").alias("label"))
    return named.join(titles.unionByName(people), "id").select("l_orderkey", "kind", number.alias("number"), "label")


def record_linkage(spark, sf_dir):
    """Each foreign title (name, year) with the best of those that share its first word; similarity, year and exactness decide."""
    part = table(spark, sf_dir, "part").select("p_partkey", "p_name", F.col("p_size").alias("year"))
    mine = part.filter("p_type = 'PROMO'").groupBy("p_name").agg(F.min("p_partkey").alias("id"), F.min("year").alias("year"))
    theirs = part.filter("p_type = 'LARGE'").groupBy("p_name").agg(F.min("p_partkey").alias("other"), F.min("year").alias("y"))
    first = lambda c: F.split(c, " ")[0]
    pairs = mine.withColumn("block", first("p_name")).join(theirs.withColumnRenamed("p_name", "q_name").withColumn("block", first("q_name")), "block")
    exact = F.col("p_name") == F.col("q_name")
    near = 1 - F.levenshtein("p_name", "q_name") / F.greatest(F.length("p_name"), F.length("q_name"))
    gap = F.abs(F.col("year") - F.col("y"))
    score = F.round(near * F.when(exact, 1.0).otherwise(0.25) * F.greatest(F.lit(0.0), 1 - 0.4 * gap), 6)
    good = pairs.withColumn("score", score).filter((F.col("score") >= 0.175) | exact).filter((gap <= 1) | exact)
    return good.groupBy("id").agg(F.max_by(F.struct("other", "score"), F.struct("score", -F.col("other"))).alias("b")).select("id", "b.other", "b.score")


EV = "ev AS (SELECT *, CAST(floor(epoch(ts)) AS BIGINT) AS sec, strftime(ts, '%Y-%m-%d') AS day FROM events)"
DAY = f"DATE '{AS_OF}'"
QUERIES = {
    "expiry_filter": (expiry_filter, f"SELECT o_orderstatus, count(*) AS n FROM orders WHERE o_orderstatus = 'P' OR CAST(o_orderdate AS DATE) + 90 > {DAY} GROUP BY 1"),
    "date_window": (date_window, f"SELECT l_orderkey, l_linenumber, CAST(CAST(l_shipdate AS DATE) - {DAY} AS INT) AS away FROM lineitem WHERE CAST(l_shipdate AS DATE) - {DAY} BETWEEN -4 AND 14"),
    "case_standing": (case_standing, f"SELECT CASE WHEN l_linestatus = 'F' THEN 'owned' WHEN CAST(l_shipdate AS DATE) > {DAY} THEN 'unknown' WHEN l_returnflag <> 'N' THEN 'wanted' ELSE 'missing' END AS standing, count(*) AS n FROM lineitem GROUP BY 1"),
    "request_log": (request_log, f"""WITH l AS (SELECT l_orderkey, sum(l_linenumber)::BIGINT AS attempts, CAST(max(l_shipdate) AS DATE) AS last FROM lineitem GROUP BY 1),
      s AS (SELECT *, CASE WHEN o_orderstatus = 'F' THEN 'done' WHEN attempts > {GIVEN_UP} AND {DAY} - last > 1 THEN 'no_release' WHEN o_orderstatus = 'P' THEN 'waiting' ELSE 'open' END AS state FROM orders JOIN l ON l_orderkey = o_orderkey)
      SELECT o_custkey, o_orderkey, state, CAST(list_position(['no_release', 'waiting', 'open', 'done'], state) AS INT) AS bucket, attempts || ' attempts, last ' || strftime(last, '%Y-%m-%d') AS evidence,
      CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY last > DATE '1998-08-01' DESC, o_orderdate DESC, o_orderkey DESC) AS INT) AS place FROM s"""),
    "finished_flags": (finished_flags, "SELECT l_returnflag, count(*) FILTER (l_extendedprice * l_discount <= least(0.05 * l_extendedprice, 180.0)) AS finished, count(*) AS n FROM lineitem GROUP BY 1"),
    "glob_exclusion": (glob_exclusion, "SELECT p_type, count(*) AS n FROM part WHERE NOT (p_type = 'PROMO' OR starts_with(p_type, 'S')) GROUP BY 1"),
    "event_validation": (event_validation, """WITH v AS (SELECT event_type, coalesce(TRY_CAST(json_extract_string(props, '$.k') AS INT) >= 0 AND event_type IN ('click', 'view', 'purchase') AND event_id > 0, false) AS ok FROM events)
      SELECT event_type, count(*) FILTER (ok) AS valid, count(*) FILTER (NOT ok) AS dropped FROM v GROUP BY 1"""),
    "upcoming_nearest": (upcoming_nearest, f"""WITH o AS (SELECT o_custkey, o_orderkey, CAST(o_orderdate AS DATE) AS d FROM orders), s AS (SELECT o_custkey, min(d) FILTER (d > {DAY}) AS soon FROM o GROUP BY 1)
      SELECT o.o_custkey, o_orderkey AS nearest, strftime(soon, '%Y-%m-%d') AS soonest FROM o JOIN s ON s.o_custkey = o.o_custkey QUALIFY row_number() OVER (PARTITION BY o.o_custkey ORDER BY abs(d - {DAY}), d, o_orderkey) = 1"""),
    "newest_wins": (newest_wins, "SELECT o_custkey, o_orderstatus, o_totalprice FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1"),
    "exists_any": (exists_any, "SELECT 'urgent' AS asked, EXISTS (SELECT 1 FROM orders WHERE o_orderpriority = '1-URGENT') AS found UNION ALL SELECT 'future', EXISTS (SELECT 1 FROM orders WHERE o_orderdate > '2030-01-01')"),
    "multi_count": (multi_count, "SELECT c_custkey AS user_id, count(*) FILTER (event_type = 'click') AS click, count(*) FILTER (event_type = 'error') AS error, count(*) FILTER (event_type = 'purchase') AS purchase FROM customer LEFT JOIN events ON user_id = c_custkey GROUP BY 1"),
    "spend_sum": (spend_sum, f"WITH {EV} SELECT c_custkey AS user_id, coalesce(round(sum(value), 4), 0.0) AS spent FROM customer LEFT JOIN ev ON user_id = c_custkey AND day = '2024-01-15' AND event_type = 'purchase' GROUP BY 1"),
    "progress_sums": (progress_sums, """WITH q AS (SELECT coalesce(CASE WHEN l_returnflag = 'N' THEN l_suppkey END, l_partkey) AS id, l_extendedprice AS size, least(greatest(l_extendedprice * l_tax * 20 - 100, 0), l_extendedprice) AS rest, l_shipdate FROM lineitem)
      SELECT id, round(sum(size - rest) / sum(size), 6) AS progress, strftime(max(l_shipdate), '%Y-%m-%d') AS eta FROM q GROUP BY 1"""),
    "search_evidence": (search_evidence, f"""WITH {EV}, s AS (SELECT user_id, count(DISTINCT event_type) AS sources, max(value) AS most FROM ev WHERE day >= '2024-01-10' GROUP BY 1)
      SELECT o.o_custkey AS user_id, open, coalesce(sources, 0) AS sources, most FROM (SELECT o_custkey, count(*) AS open FROM orders WHERE o_orderstatus = 'P' GROUP BY 1) o LEFT JOIN s ON s.user_id = o.o_custkey"""),
    "merge_ratings": (merge_ratings, """WITH r AS (SELECT l_partkey AS id, l_returnflag AS source, count(*) AS votes, round(avg(l_discount), 6) AS value FROM lineitem GROUP BY 1, 2)
      SELECT id, source, value FROM r WHERE value > 0 QUALIFY row_number() OVER (PARTITION BY id ORDER BY source = 'R' DESC, votes DESC, source DESC) = 1"""),
    "run_comparison": (run_comparison, f"""WITH {EV}, m AS (SELECT user_id, event_type, avg(value) FILTER (day < '2024-01-16') AS m0, avg(value) FILTER (day >= '2024-01-16') AS m1 FROM ev GROUP BY 1, 2)
      SELECT user_id, event_type, round(m1 / m0, 6) AS ratio FROM m WHERE m0 IS NOT NULL AND m1 IS NOT NULL"""),
    "first_guid": (first_guid, "SELECT l_orderkey, 'r://' || l_partkey AS guid FROM lineitem WHERE l_returnflag = 'R' QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_suppkey, 'r://' || l_partkey) = 1"),
    "freshness_classes": (freshness_classes, f"""WITH a AS (SELECT {DAY} - CAST(o_orderdate AS DATE) AS age, o_orderkey % 100 AS idle FROM orders), c AS (SELECT CASE WHEN age <= 30 THEN 'volatile' WHEN age <= 365 THEN 'recent' WHEN age <= 1500 THEN 'settled' ELSE 'immutable' END AS class,
      CASE WHEN age <= 30 THEN 7 WHEN age <= 365 THEN 14 WHEN age <= 1500 THEN 90 END AS ttl, idle FROM a WHERE age >= 0) SELECT class, count(*) AS n, count(*) FILTER (ttl IS NULL OR idle <= ttl) AS fresh FROM c GROUP BY 1"""),
    "current_version": (current_version, "SELECT o_custkey, o_orderkey, o_orderstatus = 'P' AS current FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderstatus = 'P' DESC, o_orderdate DESC, o_orderkey DESC) = 1"),
    "superseded_prune": (superseded_prune, "SELECT o_custkey, o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus = 'P' OR o_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')"),
    "retry_schedule": (retry_schedule, f"""WITH {EV}, a AS (SELECT event_id, user_id, sec, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS INT) AS attempt FROM ev WHERE event_type = 'error')
      SELECT event_id, user_id, attempt, CASE WHEN attempt < {MOST} THEN sec + [1, 5, 15, 30, 60][least(attempt, 5)] * 60 END AS due, CASE WHEN attempt < {MOST} THEN 'waiting' ELSE 'failed' END AS state FROM a"""),
    "flush_batches": (flush_batches, f"WITH {EV} SELECT sec - sec % 3600 AS flush, least(count(*), 12) AS written, greatest(count(*) - 12, 0) AS dropped FROM ev GROUP BY 1"),
    "rate_limit_fixed": (rate_limit_fixed, f"""WITH RECURSIVE {EV}, o AS (SELECT user_id, event_id, sec, row_number() OVER (PARTITION BY user_id ORDER BY sec, event_id) AS i FROM ev),
      w AS (SELECT user_id, event_id, i, sec, sec AS start, 1 AS n FROM o WHERE i = 1
        UNION ALL SELECT o.user_id, o.event_id, o.i, o.sec, CASE WHEN o.sec >= w.start + 43200 THEN o.sec ELSE w.start END, CASE WHEN o.sec >= w.start + 43200 THEN 1 ELSE w.n + 1 END FROM w JOIN o ON o.user_id = w.user_id AND o.i = w.i + 1)
      SELECT user_id, event_id, start, n <= 2 AS allowed FROM w"""),
    "greedy_min_gap": (greedy_min_gap, f"""WITH RECURSIVE {EV}, o AS (SELECT user_id, event_id, sec, row_number() OVER (PARTITION BY user_id ORDER BY sec, event_id) AS i FROM ev),
      w AS (SELECT user_id, event_id, i, sec, sec AS last FROM o WHERE i = 1
        UNION ALL SELECT o.user_id, o.event_id, o.i, o.sec, CASE WHEN o.sec >= w.last + 86400 THEN o.sec ELSE w.last END FROM w JOIN o ON o.user_id = w.user_id AND o.i = w.i + 1)
      SELECT user_id, event_id, sec FROM w WHERE sec = last QUALIFY row_number() OVER (PARTITION BY user_id, sec ORDER BY i) = 1"""),
    "sampler_p95": (sampler_p95, """WITH k AS (SELECT event_type, value FROM events QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) <= 256), l AS (SELECT event_type, list_sort(list(value)) AS a FROM k GROUP BY 1)
      SELECT event_type, CAST(len(a) AS INT) AS samples, a[CAST(greatest(ceil(len(a) * 0.95), 1) AS INT)] AS p95 FROM l"""),
    "sliced_ring": (sliced_ring, f"""WITH {EV}, s AS (SELECT event_type, sec - sec % 1800 AS slice, count(*) AS n, round(sum(value), 4) AS total FROM ev GROUP BY 1, 2)
      SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY slice DESC) <= 240"""),
    "meter_verdict": (meter_verdict, f"""WITH {EV}, u AS (SELECT user_id, sec - sec % 3600 AS start, round(sum(value), 4) AS used FROM ev GROUP BY 1, 2), v AS (SELECT *, CASE WHEN used > 80 THEN 'refuse' WHEN used > 20 THEN 'slow' ELSE 'allow' END AS verdict FROM u)
      SELECT user_id, start, used, verdict, CASE WHEN verdict = 'slow' THEN round(least(2.0, 2.0 * (used - 20) / 60), 4) ELSE 0.0 END AS delay FROM v"""),
    "import_planning": (import_planning, """SELECT o_orderkey, CASE WHEN o_custkey IS NULL THEN 'no id' WHEN o_orderpriority = '5-LOW' THEN 'excluded' WHEN o_custkey IN (SELECT user_id FROM events WHERE event_type = 'signup') THEN 'already linked'
      WHEN row_number() OVER (PARTITION BY o_custkey, o_orderpriority ORDER BY o_orderkey) > 1 THEN 'duplicate' ELSE 'create' END AS plan FROM orders"""),
    "mentions": (mentions, """SELECT DISTINCT l_orderkey, 'title' AS kind, l_partkey AS number, p_name AS label FROM lineitem JOIN part ON p_partkey = l_partkey
      UNION ALL SELECT DISTINCT l_orderkey, 'person', l_suppkey, s_name FROM lineitem JOIN supplier ON s_suppkey = l_suppkey"""),
    "session_totals": (session_totals, None),
    "record_linkage": (record_linkage, """WITH m AS (SELECT p_name, min(p_partkey) AS id, min(p_size) AS year FROM part WHERE p_type = 'PROMO' GROUP BY 1), t AS (SELECT p_name AS q_name, min(p_partkey) AS other, min(p_size) AS y FROM part WHERE p_type = 'LARGE' GROUP BY 1),
      s AS (SELECT *, round((1 - levenshtein(p_name, q_name) / greatest(length(p_name), length(q_name))) * CASE WHEN p_name = q_name THEN 1.0 ELSE 0.25 END * greatest(0, 1 - 0.4 * abs(year - y)), 6) AS score FROM m JOIN t ON split_part(p_name, ' ', 1) = split_part(q_name, ' ', 1))
      SELECT id, other, score FROM s WHERE (score >= 0.175 OR p_name = q_name) AND (abs(year - y) <= 1 OR p_name = q_name) QUALIFY row_number() OVER (PARTITION BY id ORDER BY score DESC, other) = 1"""),
}
