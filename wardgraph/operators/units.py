"""Organisational units: distinguished names as paths, so that what lies below a unit is found by an equi-join on its ancestors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import registry, scalars
from .names import lookup
from .paths import nearest_routes


def parts(dn: Column) -> Column:
    """The components of a distinguished name in upper case; an escaped comma doesn't part them."""
    return F.transform(F.split(F.upper(dn), r"(?<!\\),"), lambda p: F.trim(p))


def ancestors(dn: Column) -> Column:
    """The names of all that an object lies below, the nearest first; the object itself isn't one of them."""
    own = parts(dn)
    return F.transform(F.sequence(F.lit(2), F.greatest(F.size(own), F.lit(2))), lambda i: F.array_join(F.slice(own, i, F.size(own)), ","))


def key(dn: Column) -> Column:
    return F.array_join(parts(F.ltrim(dn, F.lit(","))), ",")


def below(objects: DataFrame, units: DataFrame) -> DataFrame:
    """(unit, object_id): objects (object_id, dn) below units (unit: a distinguished name), at any depth. Null names lie nowhere."""
    asked = units.select("unit", key(F.col("unit")).alias("k")).distinct()
    under = objects.where("dn is not null").select("object_id", F.explode(ancestors(F.col("dn"))).alias("k")).where("k <> ''")
    return under.join(asked, "k").select("unit", "object_id").distinct()


def declared_values(specs: DataFrame, nodes: DataFrame, objects: DataFrame) -> DataFrame:
    """(id, value): objects with a declared value. specs: value, match (a name), ou (a unit); the highest value of an object counts. objects: object_id, dn."""
    named = lookup(specs.select(F.col("match").alias("query")), nodes).join(specs.select(F.col("match").alias("query"), "value"), "query")
    inside = below(objects, specs.where("ou is not null").select(F.col("ou").alias("unit"))).join(specs.select(F.col("ou").alias("unit"), "value"), "unit")
    rows = named.select(F.col("object_id").alias("id"), "value").union(inside.select("object_id", "value"))
    return rows.groupBy("id").agg(F.max("value").alias("value"))


def totals(objects: DataFrame, measures: DataFrame, root: str = "OU") -> DataFrame:
    """(unit, objects, total, most): of each unit with all that lies below it, how many objects (object_id, dn) have a measure (object_id, measure), its sum
    and its greatest. An object counts in each unit above it: partial sums by unit are all that is shuffled."""
    rows = objects.join(measures, "object_id").select("measure", F.explode(ancestors(F.col("dn"))).alias("unit"))
    return rows.where(F.col("unit").startswith(f"{root}=")).groupBy("unit").agg(F.count("*").alias("objects"), F.sum("measure").alias("total"), F.max("measure").alias("most"))


def breakdown(objects: DataFrame, risk: DataFrame, units: int = 20, most: int = 8) -> DataFrame:
    """(place, unit, objects, reaching, rank, object_id, tier0_reach, risk): the ``units`` units with most objects that reach tier 0 (then most objects, then by
    name), and the ``most`` riskiest of each. objects: object_id, dn; risk: object_id, tier0_reach, risk, of objects below tier 0.
    Objects without a unit are left out."""
    rows = objects.select("object_id", scalars.ou_path(F.col("dn")).alias("unit")).where("unit <> ''").join(risk, "object_id")
    counted = rows.groupBy("unit").agg(F.count("*").alias("objects"), F.count(F.when(F.col("tier0_reach") > 0, 1)).alias("reaching"))
    first = counted.orderBy(F.desc("reaching"), F.desc("objects"), "unit").limit(units)
    first = first.withColumn("place", F.row_number().over(Window.orderBy(F.desc("reaching"), F.desc("objects"), "unit")))  # ``units`` rows
    best = Window.partitionBy("unit").orderBy(F.desc("tier0_reach"), F.desc("risk"), "object_id")
    ranked = rows.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= most)
    return ranked.join(first, "unit").select("place", "unit", "objects", "reaching", "rank", "object_id", "tier0_reach", "risk")


def jewel_routes(jewels: DataFrame, tiered: DataFrame, edges: DataFrame) -> DataFrame:
    """(jewel, value, source, effort, noise, steps, nodes, edge_types): the cheapest route onto each jewel (id, value) from any user or computer below tier 0
    along walkable edges: least effort, then noise, then steps, then source. Jewels that nobody reaches have nulls.

    All sources search at once, forwards, and exactly: neither sources nor routes are bounded, and jewels add no more than their own routes."""
    named = jewels.groupBy("id").agg(F.max("value").alias("value"))
    walk = edges.where(~F.col("edge_type").isin(registry.NON_TRAVERSABLE))
    # one number: effort, noise and steps, in this order
    costs = registry.edge_dim(edges.sparkSession).select("edge_type", (F.col("effort") * (1 << 40) + F.col("noise") * (1 << 20) + 1).cast("long").alias("w"))
    actors = tiered.where(F.col("node_type").isin(registry.ACTORS) & (F.col("tier") != 0)).select(F.col("object_id").alias("id"))
    routes = nearest_routes(named, actors, walk, costs, 1 + (11 << 40) + (3 << 20))
    out = routes.select(
        F.col("target").alias("jewel"), "source", F.shiftright("cost", 40).cast("int").alias("effort"),
        F.shiftright("cost", 20).bitwiseAND(F.lit((1 << 20) - 1)).cast("int").alias("noise"), F.col("cost").bitwiseAND(F.lit((1 << 20) - 1)).cast("int").alias("steps"),
        "nodes", "edge_types",
    )
    return named.select(F.col("id").alias("jewel"), "value").join(out, "jewel", "left")
