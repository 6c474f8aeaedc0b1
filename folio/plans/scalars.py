"""Column functions over whole tables: dates, keys, arrays, maps and nested JSON."""

from __future__ import annotations

from pyspark.sql import functions as F

from folio.functions import dates as D
from folio.functions import keys as K
from folio.functions import text as T
from folio.session import table

AS_OF = "1998-09-01"


def date_functions(spark, sf_dir):
    """2.10: decade, date of a text, window, soonest future date, and time that remains, for every order."""
    day, today = F.to_date("o_orderdate"), F.lit(AS_OF).cast("date")
    text = F.concat(F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit("T10:00:00Z"))
    soon = D.soonest_future([("order", day), ("month", F.date_add(day, 30)), ("quarter", F.date_add(day, 90))], today)
    return table(spark, sf_dir, "orders").select(
        "o_orderkey", D.decade(F.year(day)).alias("decade"), D.calendar_date(text).cast("string").alias("day"), D.calendar_date(F.lit("199x-01-01")).isNull().alias("bad"),
        D.within(day, today, 4, 14).alias("near"), soon["label"].alias("label"), soon["day"].cast("string").alias("next"),
        D.remaining(F.datediff(D.expiry(day.cast("timestamp"), F.lit(90)), today) * 86400 + 3700).alias("left"),
    )


def day_bounds(spark, sf_dir):
    """2.10: start of the day, of a week before, the local day and the next local midnight of every event."""
    at, show = F.col("ts").cast("timestamp"), lambda c: F.date_format(c, "yyyy-MM-dd HH:mm")
    return table(spark, sf_dir, "events").select("event_id", show(D.day_start(at)).alias("start"), show(D.day_start(at, 7)).alias("week"), D.local_day(at, "America/New_York").cast("string").alias("local"), show(D.next_midnight(at, "America/New_York")).alias("reset"))


def list_decades(spark, sf_dir):
    """2.10 X35: titles ordered by decade, the seven decades up to a year; empty ones too."""
    want = spark.createDataFrame([(d,) for d in D.decades(1998)], "decade int")
    n = table(spark, sf_dir, "orders").groupBy(D.decade(F.year("o_orderdate")).alias("decade")).agg(F.count("*").alias("n"))
    return want.join(n, "decade", "left").select("decade", F.coalesce("n", F.lit(0)).alias("n"))


def key_functions(spark, sf_dir):
    """2.9: keys of every title, brand, person and tag."""
    part = table(spark, sf_dir, "part")
    label = F.concat(F.lit("12: "), F.initcap("p_name"), F.lit(" (Part 2)"))
    tag = F.concat(F.lower(F.substring("p_type", 1, 2)), F.lit("_XX-Latn"))
    return part.select(
        "p_partkey", K.despaced(T.normalize(F.col("p_name"))).alias("despaced"), T.stripped(F.concat(F.lit("The  "), "p_name")).alias("stripped"), F.array_join(K.title_keys(label), "|").alias("keys"),
        K.term_key(F.concat(F.lit("  "), F.replace("p_name", F.lit(" "), F.lit(" \t ")))).alias("term"), K.service_key(F.concat("p_type", F.lit("  Channel")), {"promo": "promotion"}, ("channel", "amazon")).alias("service"),
        K.person_key(F.concat(F.lit(" "), "p_brand")).alias("person"), K.language_code(tag).alias("lang"), K.language_code(F.lit("und")).isNull().alias("none"), K.plural(F.lower("p_type")).alias("plural"),
        F.concat(F.lit("tt"), F.col("p_partkey").cast("string")).rlike(K.TITLE_ID).alias("is_id"), K.stopword_only(F.concat(F.lit("the "), F.element_at(F.array(F.lit("of"), F.lit("bolt")), F.pmod("p_partkey", F.lit(2)).cast("int") + 1))).alias("stop"),
    )


def string_functions(spark, sf_dir):
    """2.9: LIKE without case, position, substring, trim and upper."""
    n = F.col("p_name")
    return table(spark, sf_dir, "part").select("p_partkey", n.ilike("RED %").alias("red"), F.instr(n, "e").alias("at"), F.upper(F.trim(F.substring(n, 1, 5))).alias("head"), F.concat_ws("|", n, "p_type").alias("both"))


def array_functions(spark, sf_dir):
    """2.11: sets, slices, positions and zipped lists of each order's lines."""
    lists = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey"))).alias("l"))
    parts, people = F.col("l.l_partkey"), F.col("l.l_suppkey")
    pairs = F.transform(F.arrays_zip(parts.alias("p"), people.alias("s")), lambda x: F.concat_ws(":", x["p"].cast("string"), x["s"].cast("string")))
    return lists.select("l_orderkey", F.array_join(F.slice(pairs, 1, 2), ",").alias("head"), F.size(F.array_distinct(people)).alias("people"), F.array_position(parts, F.array_max(parts)).cast("int").alias("largest_at"), F.get(parts, F.lit(2)).alias("third"))


def json_explode(spark, sf_dir):
    """J16 2.11: documents of nested lists, unnested twice."""
    per = table(spark, sf_dir, "events").select("user_id", "event_type", F.get_json_object("props", "$.k").cast("int").alias("k")).groupBy("user_id", "event_type").agg(F.collect_list(F.struct("k")).alias("items"))
    data = per.groupBy("user_id").agg(F.to_json(F.collect_list(F.struct("event_type", "items"))).alias("data"))
    outer = data.select("user_id", F.explode(F.from_json("data", "array<struct<event_type:string,items:array<struct<k:int>>>>")).alias("c"))
    return outer.select("user_id", "c.event_type", F.explode("c.items.k").alias("k")).groupBy("user_id", "event_type").agg(F.count("*").alias("n"), F.sum("k").alias("total"))


def map_overlay(spark, sf_dir):
    """2.11: one map over another, the later value of a key wins."""
    rows = table(spark, sf_dir, "customer")
    base, over = F.create_map(F.lit("nation"), F.col("c_nationkey").cast("string"), F.lit("segment"), F.col("c_mktsegment")), F.create_map(F.lit("segment"), F.lower("c_mktsegment"))
    kept = F.map_filter(base, lambda k, _: ~F.map_contains_key(over, k))
    return rows.select("c_custkey", F.map_concat(kept, over).alias("m")).select("c_custkey", F.col("m")["nation"].alias("nation"), F.col("m")["segment"].alias("segment"))


def nested_rewrite(spark, sf_dir):
    """2.11: entries of a JSON list that are well-formed, one field of each rewritten."""
    raw = F.to_json(F.array(F.struct(F.col("p_partkey").alias("id"), F.col("p_name").alias("url")), F.struct(F.lit(None).cast("long").alias("id"), F.lit("x").alias("url"))))
    items = F.filter(F.from_json(raw, "array<struct<id:long,url:string>>"), lambda x: x["id"].isNotNull() & x["url"].isNotNull())
    mapped = F.transform(items, lambda x: x.withField("url", F.concat(F.lit("img/"), x["url"])))
    return table(spark, sf_dir, "part").select("p_partkey", F.size(mapped).alias("n"), mapped[0]["url"].alias("url"))


def math_functions(spark, sf_dir):
    """2.11: logarithms, roots and clamps; an unknown argument makes the least of two unknown."""
    v = F.col("value")
    both = F.when(v.isNotNull() & F.col("b").isNotNull(), F.least(v, F.col("b")))
    rows = table(spark, sf_dir, "events").withColumn("b", F.when(F.col("event_type") != "view", F.col("value") / 2 + 3))
    return rows.select("event_id", F.round(F.ln(v + 10), 6).alias("ln"), F.round(F.log10(v + 1), 6).alias("lg"), F.round(F.sqrt(v), 6).alias("root"), F.round(F.greatest(F.lit(5.0), F.least(v, F.lit(50.0))), 6).alias("clamped"), F.round(both, 6).alias("least"))


KEYS = """regexp_replace(lower(x), '[^a-z0-9]+', '', 'g')"""
QUERIES = {
    "date_functions": (date_functions, f"""WITH o AS (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS d, DATE '{AS_OF}' AS t FROM orders)
      SELECT o_orderkey, CAST(year(d) // 10 * 10 AS INT) AS decade, strftime(d, '%Y-%m-%d') AS day, true AS bad, d - t BETWEEN -4 AND 14 AS near,
      CASE WHEN d > t THEN 'order' WHEN d + 30 > t THEN 'month' WHEN d + 90 > t THEN 'quarter' END AS label, strftime(CASE WHEN d > t THEN d WHEN d + 30 > t THEN d + 30 WHEN d + 90 > t THEN d + 90 END, '%Y-%m-%d') AS next,
      CASE WHEN d + 90 - t > 0 THEN (d + 90 - t) || 'd 1h' WHEN d + 90 - t = 0 THEN '1h 1m' ELSE 'under a minute' END AS "left" FROM o"""),
    "day_bounds": (day_bounds, """WITH e AS (SELECT event_id, ts, timezone('America/New_York', timezone('UTC', ts)) AS l FROM events)
      SELECT event_id, strftime(date_trunc('day', ts), '%Y-%m-%d %H:%M') AS start, strftime(date_trunc('day', ts) - INTERVAL 7 DAY, '%Y-%m-%d %H:%M') AS week, strftime(l, '%Y-%m-%d') AS local,
      strftime(date_trunc('day', l) + INTERVAL 29 HOUR, '%Y-%m-%d %H:%M') AS reset FROM e"""),
    "list_decades": (list_decades, "SELECT d AS decade, (SELECT count(*) FROM orders WHERE year(o_orderdate) // 10 * 10 = d) AS n FROM (SELECT CAST(1990 - 10 * i AS INT) AS d FROM range(7) t(i))"),
    "key_functions": (key_functions, None),
    "string_functions": (string_functions, "SELECT p_partkey, p_name ILIKE 'RED %' AS red, CAST(instr(p_name, 'e') AS INT) AS at, upper(trim(substring(p_name, 1, 5))) AS head, p_name || '|' || p_type AS both FROM part"),
    "array_functions": (array_functions, """WITH l AS (SELECT l_orderkey, list(struct_pack(n := l_linenumber, p := l_partkey, s := l_suppkey) ORDER BY l_linenumber, l_partkey, l_suppkey) AS l FROM lineitem GROUP BY 1),
      z AS (SELECT l_orderkey, list_transform(l, lambda x: x.p) AS ps, list_transform(l, lambda x: x.s) AS ss, list_transform(l, lambda x: x.p || ':' || x.s) AS pr FROM l)
      SELECT l_orderkey, array_to_string(pr[1:2], ',') AS head, CAST(len(list_distinct(ss)) AS INT) AS people, CAST(list_position(ps, list_max(ps)) AS INT) AS largest_at, ps[3] AS third FROM z"""),
    "json_explode": (json_explode, "SELECT user_id, event_type, count(*) AS n, CAST(sum(CAST(json_extract_string(props, '$.k') AS INT)) AS BIGINT) AS total FROM events GROUP BY 1, 2"),
    "map_overlay": (map_overlay, "SELECT c_custkey, CAST(c_nationkey AS VARCHAR) AS nation, lower(c_mktsegment) AS segment FROM customer"),
    "nested_rewrite": (nested_rewrite, "SELECT p_partkey, 1 AS n, 'img/' || p_name AS url FROM part"),
    "math_functions": (math_functions, """SELECT event_id, round(ln(value + 10), 6) AS ln, round(log10(value + 1), 6) AS lg, round(sqrt(value), 6) AS root, round(greatest(5.0, least(value, 50.0)), 6) AS clamped,
      CASE WHEN event_type <> 'view' THEN round(least(value, value / 2 + 3), 6) END AS least FROM events"""),
}
