"""Contributions of several providers to the facets of entities, and how they become one value.

A facet says how answers combine: ``list`` puts them one after the other, ``object`` lays them over each other (a later one's fields win), ``single`` takes the first. Order is that of
the plugins' ids, so nothing hangs on the order of rows. A facet with a precedence keeps the strongest answers first (ties all stay), whatever the mode;
a provider that answers alone is never measured. What does not fit the shape of its facet is left out and counted as a failure.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MODES = ("list", "object", "single")
#: Outcomes of a provider for an entity.
OK, EMPTY, ERROR, SHAPE = "ok", "empty", "error", "invalid-shape"


@dataclass(frozen=True)
class Facet:
    """name, how answers combine, and the strength of an answer: a column of its data, larger is stronger."""

    name: str
    mode: str
    precedence: Callable[[Column], Column] | None = None

    def __post_init__(self):
        if self.mode not in MODES:
            raise ValueError(f"{self.name}: there is no mode {self.mode}")


@dataclass(frozen=True)
class Provider:
    """What a plugin of a version knows about a facet of entities of some kinds.

    answer takes a DataFrame with the entities (id, kind and what else they have) and returns (id, data), data as JSON; entities that it leaves out have no answer.
    """

    facet: str
    plugin: str
    version: int
    kinds: frozenset[str]
    answer: Callable[[DataFrame], DataFrame]


class Registry:
    """Providers by facet, kind and plugin; of the versions of a plugin the highest answers."""

    def __init__(self, *facets: Facet):
        self.facets = {f.name: f for f in facets}
        self.providers: dict[tuple[str, str], Provider] = {}

    def add(self, provider: Provider) -> None:
        if provider.facet not in self.facets:
            raise ValueError(f"there is no facet {provider.facet}")
        key = provider.facet, provider.plugin
        if key not in self.providers or self.providers[key].version < provider.version:
            self.providers[key] = provider

    def contributions(self, entities: DataFrame) -> DataFrame:
        """(id, facet, plugin, version, outcome, data) of all providers for the entities (id, kind, ...) of their kinds."""
        out = None
        for p in self.providers.values():
            asked = entities.filter(F.col("kind").isin(*sorted(p.kinds)))
            shaped = fits(F.col("data"), self.facets[p.facet].mode)
            outcome = F.when(F.col("data").isNull(), EMPTY).when(shaped, OK).otherwise(SHAPE)
            each = asked.select("id").join(p.answer(asked).select("id", F.col("data").cast("string").alias("data")), "id", "left")
            rows = each.select("id", F.lit(p.facet).alias("facet"), F.lit(p.plugin).alias("plugin"), F.lit(p.version).alias("version"), outcome.alias("outcome"), F.when(outcome == OK, F.col("data")).alias("data"))
            out = rows if out is None else out.unionByName(rows)
        if out is None:
            return entities.select("id", *(F.lit(None).cast(t).alias(c) for c, t in (("facet", "string"), ("plugin", "string"), ("version", "int"), ("outcome", "string"), ("data", "string")))).limit(0)
        return out

    def merged(self, contributions: DataFrame) -> DataFrame:
        """(id, facet, plugins, data): the one value of each facet of an entity, as JSON, and who made it."""
        out = None
        for f in self.facets.values():
            rows = strongest(contributions.filter((F.col("facet") == f.name) & (F.col("outcome") == OK)), f)
            per = rows.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("plugin", "data"))).alias("c"))  # as many as providers
            data = {"list": joined, "object": overlaid, "single": lambda c: c[0]}[f.mode](F.col("c.data"))
            plugins = F.slice("c.plugin", 1, 1) if f.mode == "single" else F.col("c.plugin")
            value = per.select("id", F.lit(f.name).alias("facet"), plugins.alias("plugins"), data.alias("data"))
            out = value if out is None else out.unionByName(value)
        return out


def fits(data: Column, mode: str) -> Column:
    """Whether JSON is a list of objects, or an object."""
    if mode == "list":
        items = F.from_json(data, "array<string>")
        return F.coalesce(F.ltrim(data).startswith("[") & F.forall(items, lambda x: x.isNotNull() & F.ltrim(x).startswith("{")), F.lit(False))
    return F.coalesce(F.ltrim(data).startswith("{") & F.from_json(data, "map<string,string>").isNotNull(), F.lit(False))


def strongest(rows: DataFrame, facet: Facet) -> DataFrame:
    """Of the answers for an entity those of the best score, if the facet measures them and there is more than one."""
    if facet.precedence is None:
        return rows
    per = Window.partitionBy("id")
    scored = rows.withColumn("_score", facet.precedence(F.col("data"))).withColumn("_best", F.max("_score").over(per)).withColumn("_n", F.count("*").over(per))
    return scored.filter((F.col("_n") == 1) | F.col("_score").eqNullSafe(F.col("_best"))).drop("_score", "_best", "_n")


def joined(data: Column) -> Column:
    """One JSON list of the elements of several."""
    inner = F.transform(data, lambda x: F.regexp_replace(F.regexp_replace(x, r"^\s*\[\s*", ""), r"\s*\]\s*$", ""))
    return F.concat(F.lit("["), F.array_join(F.filter(inner, lambda x: x != ""), ","), F.lit("]"))


def overlaid(data: Column) -> Column:
    """One JSON object with the fields of several, a later one's before an earlier one's; fields stand by name. Values keep their JSON."""
    pairs = F.transform(data, lambda x: F.from_json(x, "map<string,variant>"))
    empty = F.from_json(F.lit("{}"), "map<string,variant>")
    laid = F.aggregate(pairs, empty, lambda out, x: F.map_concat(F.map_filter(out, lambda k, _: ~F.map_contains_key(x, k)), x))
    names = F.array_sort(F.map_keys(laid))
    field = lambda k: F.concat(F.to_json(F.array(k)), F.lit(":"), F.coalesce(F.to_json(F.element_at(laid, k)), F.lit("null")))
    clean = F.transform(names, lambda k: F.regexp_replace(field(k), r'^\[("(?:[^"\\]|\\.)*")\]:', "$1:"))
    return F.concat(F.lit("{"), F.array_join(clean, ","), F.lit("}"))
