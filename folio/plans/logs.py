"""Event logs: windows per user, sessions, quotas, reports and bands."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from folio.session import table

GAP, QUOTA, NEWEST = 1800, 3, 3


def _by_user():
    return Window.partitionBy("user_id").orderBy("ts", "event_id")


def _events(spark, sf_dir):
    """Events with whole seconds since the epoch (sec) and the day as text."""
    return table(spark, sf_dir, "events").withColumn("sec", F.unix_seconds(F.col("ts").cast("timestamp"))).withColumn("day", F.date_format("ts", "yyyy-MM-dd"))


def refinements_lag(spark, sf_dir):
    """What a user did before, and how many seconds earlier."""
    rows = _events(spark, sf_dir).withColumn("before", F.lag("event_type").over(_by_user())).withColumn("since", F.col("sec") - F.lag("sec").over(_by_user()))
    return rows.select("event_id", "before", "since")


def lead_intervals(spark, sf_dir):
    """The interval from each event to the user's next; the last one ends where the log does."""
    rows = _events(spark, sf_dir)
    return rows.crossJoin(F.broadcast(rows.agg(F.max("sec").alias("end")))).withColumn("until", F.coalesce(F.lead("sec").over(_by_user()), "end")).select("event_id", "sec", "until")


def session_gap(spark, sf_dir):
    """Sessions that end after a gap of half an hour; events and length of each."""
    new = F.coalesce((F.col("sec") - F.lag("sec").over(_by_user()) > GAP).cast("int"), F.lit(1))
    rows = _events(spark, sf_dir).withColumn("new", new).withColumn("session", F.sum("new").over(_by_user()))
    return rows.groupBy("user_id", "session").agg(F.count("*").alias("n"), (F.max("sec") - F.min("sec")).alias("seconds"))


def tumbling_hour(spark, sf_dir):
    """T5: counts and sums by hour and type."""
    rows = _events(spark, sf_dir).groupBy(F.date_format("ts", "yyyy-MM-dd HH").alias("hour"), "event_type")
    return rows.agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


def daily_quota(spark, sf_dir):
    """The first events of a user and day are admitted, the rest refused."""
    w = Window.partitionBy("user_id", "day").orderBy("ts", "event_id")
    rows = _events(spark, sf_dir).withColumn("ok", F.row_number().over(w) <= QUOTA)
    return rows.groupBy("day").agg(F.count_if("ok").alias("admitted"), F.count_if(~F.col("ok")).alias("refused"))


def log_report(spark, sf_dir):
    """Events, users, mean value and busiest user of each type."""
    rows = _events(spark, sf_dir)
    per = rows.groupBy("event_type", "user_id").agg(F.count("*").alias("c"), F.sum("value").alias("s"))
    best = F.max_by("user_id", F.struct("c", -F.col("user_id"))).alias("busiest")
    return per.groupBy("event_type").agg(F.sum("c").alias("n"), F.count("*").alias("users"), F.round(F.sum("s") / F.sum("c"), 4).alias("mean"), best)


def retention_topn(spark, sf_dir):
    """The newest events of each user stay."""
    w = Window.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("event_id"))
    return _events(spark, sf_dir).withColumn("place", F.row_number().over(w)).filter(F.col("place") <= NEWEST).select("user_id", "event_id", "place")


def first_per_key(spark, sf_dir):
    """Each user's first event, by one combinable aggregate."""
    return _events(spark, sf_dir).groupBy("user_id").agg(F.min_by(F.struct("event_id", "event_type"), F.struct("sec", "ts", "event_id")).alias("f")).select("user_id", "f.event_id", "f.event_type")


def moving_average(spark, sf_dir):
    """V6: mean of a day and the two on either side, of each type of event; fewer at the edges."""
    around = Window.partitionBy("event_type").orderBy("day").rowsBetween(-2, 2)
    days = _events(spark, sf_dir).groupBy("event_type", "day").agg(F.count("*").alias("n"))
    return days.select("event_type", "day", F.round(F.avg("n").over(around), 4).alias("mean"))


def share_of_max(spark, sf_dir):
    """An hour's value as a percentage of the largest hour's, 1 at least unless it is none; and per event, null-safe.

    Values count in hundredths and are divided as whole numbers, so a result doesn't hang on the order of a sum.
    """
    hours = _events(spark, sf_dir).groupBy("day", F.date_format("ts", "HH").alias("hour")).agg(F.count("*").alias("n"), F.coalesce(F.sum(F.when(F.col("event_type") == "error", F.round(100 * F.col("value")).cast("long"))), F.lit(0)).alias("total"))
    bar = F.when(F.col("total") > 0, F.greatest(F.expr("(10000 * total + top div 2) div top") / 100, F.lit(1.0))).otherwise(0.0)
    return hours.crossJoin(F.broadcast(hours.agg(F.max("total").alias("top")))).select("day", "hour", bar.alias("bar"), (F.expr("(100 * total + n div 2) div n") / 10000).alias("rate"))


def islands_ranges(spark, sf_dir):
    """V7: runs of consecutive days on which a user was active."""
    days = _events(spark, sf_dir).select("user_id", F.unix_date(F.to_date("day")).alias("d")).distinct()
    run = F.col("d") - F.row_number().over(Window.partitionBy("user_id").orderBy("d"))
    return days.withColumn("run", run).groupBy("user_id", "run").agg(F.min("d").alias("from_day"), F.count("*").alias("days")).select("user_id", "from_day", "days")


def band_buckets(spark, sf_dir):
    """V1: events by band: the first of the floors that a value reaches, the lowest for what is below all, null for null."""
    v = F.col("value") - 5
    band = F.when(v.isNotNull(), F.lit("0"))
    for floor in (0, 10, 50, 100):
        band = F.when(v >= floor, F.lit(str(floor))).otherwise(band)
    return _events(spark, sf_dir).groupBy(band.alias("band")).agg(F.count("*").alias("n"))


def pivot_grid(spark, sf_dir):
    """V3: a grid of day by type, with one column for each known type."""
    kinds = ("click", "error", "purchase", "signup", "view")
    return _events(spark, sf_dir).groupBy("day").agg(*(F.count_if(F.col("event_type") == k).alias(k) for k in kinds))


def json_extract(spark, sf_dir):
    """Fields of a JSON column, counted."""
    return _events(spark, sf_dir).groupBy(F.get_json_object("props", "$.k").cast("long").alias("k")).agg(F.count("*").alias("n"))


E = "e AS (SELECT *, CAST(floor(epoch(ts)) AS BIGINT) AS sec, strftime(ts, '%Y-%m-%d') AS day FROM events)"
U = "WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)"
QUERIES = {
    "log_refinements_lag": (refinements_lag, f"WITH {E} SELECT event_id, lag(event_type) OVER w AS before, sec - lag(sec) OVER w AS since FROM e {U}"),
    "lead_intervals": (lead_intervals, f"WITH {E} SELECT event_id, sec, coalesce(lead(sec) OVER w, (SELECT max(sec) FROM e)) AS until FROM e {U}"),
    "session_gap": (session_gap, f"""WITH {E}, n AS (SELECT *, coalesce(CAST(sec - lag(sec) OVER w > {GAP} AS INT), 1) AS new FROM e {U}), s AS (SELECT *, CAST(sum(new) OVER w AS BIGINT) AS session FROM n {U})
      SELECT user_id, session, count(*) AS n, max(sec) - min(sec) AS seconds FROM s GROUP BY 1, 2"""),
    "tumbling_hour": (tumbling_hour, "SELECT strftime(ts, '%Y-%m-%d %H') AS hour, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2"),
    "daily_quota": (daily_quota, f"""WITH {E}, q AS (SELECT day, row_number() OVER (PARTITION BY user_id, day ORDER BY ts, event_id) <= {QUOTA} AS ok FROM e)
      SELECT day, count(*) FILTER (ok) AS admitted, count(*) FILTER (NOT ok) AS refused FROM q GROUP BY 1"""),
    "log_report": (log_report, """WITH p AS (SELECT event_type, user_id, count(*) AS c, sum(value) AS s FROM events GROUP BY 1, 2),
      b AS (SELECT event_type, user_id FROM p QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY c DESC, user_id) = 1)
      SELECT event_type, CAST(sum(c) AS BIGINT) AS n, count(*) AS users, round(sum(s) / sum(c), 4) AS mean, any_value(b.user_id) AS busiest FROM p JOIN b USING (event_type) GROUP BY 1"""),
    "retention_topn": (retention_topn, f"SELECT user_id, event_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS INT) AS place FROM events QUALIFY place <= {NEWEST}"),
    "first_per_key": (first_per_key, "SELECT user_id, event_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) = 1"),
    "moving_average": (moving_average, f"WITH {E}, d AS (SELECT event_type, day, count(*) AS n FROM e GROUP BY 1, 2) SELECT event_type, day, round(avg(n) OVER (PARTITION BY event_type ORDER BY day ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING), 4) AS mean FROM d"),
    "share_of_max": (share_of_max, f"""WITH {E}, d AS (SELECT day, strftime(ts, '%H') AS hour, count(*) AS n, coalesce(sum(round(100 * value)::BIGINT) FILTER (event_type = 'error'), 0)::BIGINT AS total FROM e GROUP BY 1, 2), t AS (SELECT max(total) AS top FROM d)
      SELECT day, hour, CASE WHEN total > 0 THEN greatest(((10000 * total + top // 2) // top) / 100, 1.0) ELSE 0.0 END AS bar, ((100 * total + n // 2) // n) / 10000 AS rate FROM d, t"""),
    "islands_ranges": (islands_ranges, f"""WITH {E}, d AS (SELECT DISTINCT user_id, CAST(CAST(day AS DATE) - DATE '1970-01-01' AS INT) AS d FROM e), r AS (SELECT *, d - row_number() OVER (PARTITION BY user_id ORDER BY d) AS run FROM d)
      SELECT user_id, min(d) AS from_day, count(*) AS days FROM r GROUP BY user_id, run"""),
    "band_buckets": (band_buckets, "SELECT CASE WHEN value - 5 >= 100 THEN '100' WHEN value - 5 >= 50 THEN '50' WHEN value - 5 >= 10 THEN '10' WHEN value IS NOT NULL THEN '0' END AS band, count(*) AS n FROM events GROUP BY 1"),
    "pivot_grid": (pivot_grid, f"WITH {E} SELECT day, " + ", ".join(f"count(*) FILTER (event_type = '{k}') AS {k}" for k in ("click", "error", "purchase", "signup", "view")) + " FROM e GROUP BY 1"),
    "json_extract": (json_extract, "SELECT CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, count(*) AS n FROM events GROUP BY 1"),
}
