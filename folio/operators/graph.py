"""The bipartite graph of people and titles, from a table of credits (title_id, person_id, category, ordering)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folio.session import few, saved


def collaborators(credits: DataFrame, person: int, shared: int) -> DataFrame:
    """People who share titles with a person: (title, person) pairs once, then counted per person."""
    pairs = credits.select("title_id", "person_id").distinct()
    mine = pairs.filter(F.col("person_id") == person).select("title_id")
    return pairs.filter(F.col("person_id") != person).join(mine, "title_id").groupBy("person_id").agg(F.count("*").alias("shared")).filter(F.col("shared") >= shared)


def capped(credits: DataFrame, key: str, other: str, cap: int) -> DataFrame:
    """The first ``cap`` neighbours of every node by ordering, then id: a total order, so the cap is repeatable."""
    edges = credits.groupBy("title_id", "person_id").agg(F.min("ordering").alias("ordering"))
    w = Window.partitionBy(key).orderBy("ordering", other)
    return edges.withColumn("_k", F.row_number().over(w)).filter(F.col("_k") <= cap).select("title_id", "person_id")


def paths(credits: DataFrame, start: int, goal: int, cap: int) -> DataFrame:
    """Paths between two people over one bridge (a shared title) or two (a person between), with their length."""
    of_person = capped(credits.filter(F.col("person_id").isin(start, goal)), "person_id", "title_id", cap)
    # Two lists of at most ``cap`` titles: only their casts are ranked.
    of_title = capped(credits.join(F.broadcast(of_person.select("title_id").distinct()), "title_id", "left_semi"), "title_id", "person_id", cap)
    a = of_person.filter(F.col("person_id") == start).select(F.col("title_id").alias("t1"))
    b = of_person.filter(F.col("person_id") == goal).select(F.col("title_id").alias("t2"))
    one = a.join(b, a.t1 == b.t2).select("t1", F.lit(None).cast("long").alias("via"), F.lit(None).cast("long").alias("t2"), F.lit(1).alias("hops"))
    left = a.join(of_title, a.t1 == of_title.title_id).select("t1", F.col("person_id").alias("via"))
    right = b.join(of_title, b.t2 == of_title.title_id).select("t2", F.col("person_id").alias("via"))
    two = left.join(right, "via").filter(~F.col("via").isin(start, goal) & (F.col("t1") != F.col("t2"))).select("t1", "via", "t2", F.lit(2).alias("hops"))
    return one.unionByName(two)


def _neighbours(edges: DataFrame, nodes: DataFrame, node: str, other: str, weights: DataFrame, cap: int) -> DataFrame:
    """(node, other, weight, place) of the nodes given: of each node's neighbours the ``cap`` of the largest weight, then smallest id."""
    found = edges.join(few(nodes.select(node).distinct()), node, "left_semi").join(weights.select(F.col("id").alias(other), "weight"), other)
    place = F.row_number().over(Window.partitionBy(node).orderBy(F.desc("weight"), other))
    return found.withColumn("place", place).filter(F.col("place") <= cap).select(node, other, "weight", "place")


class Connections:
    """How two people are connected: paths (t1, via, t2, hops, strength), looked for step by step.

    titles: (id, weight). The walk comes from both sides: over the titles of either (one bridge: the strength is the shared title's weight), then, in the order
    of weights, over the people of the first side's titles, whose own titles are looked for among the other side's (two bridges: the strength is
    the person's weight, that of their largest title). A step of the budget is one such person. Steps that follow each other find together what one
    call with a large budget finds. Lists are capped, so all calls together read at most cap x cap people; the ends and the order of steps are written once.
    """

    def __init__(self, credits: DataFrame, titles: DataFrame, start: int, goal: int, cap: int = 40):
        self.titles, self.cap = titles, cap
        self.edges = credits.select("title_id", "person_id").distinct()
        ends = self.edges.sparkSession.createDataFrame([(start,), (goal,)], "person_id long")
        sides = saved(_neighbours(self.edges, ends, "person_id", "title_id", titles, cap))
        self.near, self.far = (sides.filter(F.col("person_id") == p).drop("person_id") for p in (start, goal))
        people = self.edges.join(few(self.near.select("title_id")), "title_id", "left_semi").select("person_id").distinct()
        weights = self.edges.join(few(people), "person_id", "left_semi").join(titles, F.col("title_id") == F.col("id")).groupBy("person_id").agg(F.max("weight").alias("weight")).withColumnRenamed("person_id", "id")
        bridges = _neighbours(self.edges, self.near, "title_id", "person_id", weights, cap).filter(~F.col("person_id").isin(start, goal))
        order = Window.orderBy("near_place", "place")  # cap x cap rows at most
        self.steps = saved(bridges.join(self.near.select("title_id", F.col("place").alias("near_place")), "title_id").withColumn("step", F.row_number().over(order)))
        self.last = self.steps.count()

    def go(self, budget: int, cursor: int = 0) -> tuple[DataFrame, int | None]:
        """What the next ``budget`` steps behind the cursor find (the first call the shared titles as well), and where to go on; None if all was looked at."""
        now = self.steps.filter((F.col("step") > cursor) & (F.col("step") <= cursor + budget)).select(F.col("title_id").alias("t1"), "person_id", "weight")
        onward = _neighbours(self.edges, now, "person_id", "title_id", self.titles, self.cap).select("person_id", F.col("title_id").alias("t2"))
        onward = onward.join(few(self.far.select(F.col("title_id").alias("t2"))), "t2", "left_semi")
        found = now.join(onward, "person_id").filter("t1 <> t2").select("t1", F.col("person_id").alias("via"), "t2", F.lit(2).alias("hops"), F.col("weight").alias("strength"))
        if cursor == 0:
            one = self.near.select("title_id", "weight").join(self.far.select("title_id"), "title_id")
            found = one.select(F.col("title_id").alias("t1"), F.lit(None).cast("long").alias("via"), F.lit(None).cast("long").alias("t2"), F.lit(1).alias("hops"), F.col("weight").alias("strength")).unionByName(found)
        return found, cursor + budget if cursor + budget < self.last else None


def everywhere(rows: DataFrame, key: str, value: str, wanted: list) -> DataFrame:
    """Relational division: keys that have every wanted value."""
    return rows.filter(F.col(value).isin(wanted)).groupBy(key).agg(F.count_distinct(value).alias("n")).filter(F.col("n") == len(wanted)).select(key)


def single(rows: DataFrame, key: str, value: str, *within: str) -> DataFrame:
    """Links a key (within others) only where exactly one value competes for it."""
    return rows.groupBy(*within, key).agg(F.count_distinct(value).alias("n"), F.min(value).alias(value)).filter("n = 1").drop("n")


def one_to_one(pairs: DataFrame, left: str, right: str, *within: str) -> DataFrame:
    """Pairs whose two sides each have exactly one partner (within other columns)."""
    pairs = pairs.distinct()
    one = lambda a, b: single(pairs, a, b, *within).select(*within, a)
    return pairs.join(one(left, right), [*within, left], "left_semi").join(one(right, left), [*within, right], "left_semi")
