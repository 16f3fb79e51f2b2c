"""Semi-naive fixpoints: each round joins only what the last one found.

Every round is written to the shared folder, so plans and lineage stay short, what is known is one scan of the rounds' files, and a
lost executor costs a re-read.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from ..storage import materialise, scratch, shuffled


class Rounds:
    """Tables of equal columns, one for each round, in a folder of their own."""

    def __init__(self, spark: SparkSession, label: str):
        self.spark, self.root, self.written, self.schema = spark, scratch(spark, label), [], None

    @property
    def count(self) -> int:
        return len(self.written)

    def add(self, rows: DataFrame, newest: Column | None = None) -> int:
        """Writes a round and returns its number of rows (those that ``newest`` holds for), which the write itself counts."""
        seen = Observation()
        self.schema = self.schema or rows.schema
        self.written.append(f"{self.root}/{self.count:05d}")
        rows.observe(seen, F.count(F.lit(1) if newest is None else F.when(newest, 1)).alias("n")).write.parquet(self.written[-1])
        return seen.get["n"]

    def last(self) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(self.written[-1])

    def all(self) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(*self.written)


def semi_naive(start: DataFrame, step: Callable[[DataFrame], DataFrame], keys: list[str], max_depth: int | None = None, depth: str = "depth", together: int = 3, few: int = 200_000, dealt: bool = False) -> DataFrame:
    """(keys, depth): all states reachable from ``start`` (depth 0), with the fewest steps to each.

    ``step`` takes the newest states (keys) and returns states one step on, in any number of copies. While a round finds at most ``few``
    states, ``together`` steps are one job: what is known is then read and shuffled once for all of them. ``dealt``: nothing is broadcast; for a state or two an object,
    not for states of many origins that meet in a few objects.
    """
    put = shuffled if dealt else lambda rows: rows
    rounds = Rounds(start.sparkSession, "fixpoint")
    n, at = rounds.add(start.select(*keys).distinct().withColumn(depth, F.lit(0))), 0
    while n and (max_depth is None or at < max_depth):
        known = rounds.all().select(*keys)
        front, found = rounds.last().where(F.col(depth) == at).select(*keys), None
        steps = together if n <= few else 1
        steps = steps if max_depth is None else min(steps, max_depth - at)
        for i in range(1, steps + 1):
            front = step(put(front)).select(*keys).distinct().join(put(known), keys, "left_anti")
            rows = front.withColumn(depth, F.lit(at + i))
            found = rows if found is None else found.union(rows)
        if steps > 1:
            found = found.groupBy(*keys).agg(F.min(depth).alias(depth))
        at += steps
        n = rounds.add(found, F.col(depth) == at)
    return rounds.all()


def closure(start: DataFrame, edges: DataFrame, from_col: str = "src", to_col: str = "dst", max_depth: int | None = None) -> DataFrame:
    """(origin, id, depth): what each origin (start: origin, id) reaches along ``edges``; the start itself has depth 0."""
    hops = edges.select(F.col(from_col).alias("id"), F.col(to_col).alias("next")).distinct().persist(StorageLevel.MEMORY_AND_DISK)
    try:
        return semi_naive(start, lambda new: new.join(hops, "id").select("origin", F.col("next").alias("id")), ["origin", "id"], max_depth)
    finally:
        hops.unpersist()


#: So many origins share a number.
MARKS = 63


def marked(origins: DataFrame, start: DataFrame, edges: DataFrame, max_depth: int | None = None) -> tuple[DataFrame, DataFrame]:
    """((origin, block, bit), (id, block, depth, marks)): the closure of many origins (origin; start: origin, id) along ``edges`` (src, dst), where a row of an
    object holds the bits of all origins of a block that reach it first in ``depth`` steps."""
    numbered = origins.select("origin").distinct().withColumn("n", F.monotonically_increasing_id())
    numbered = materialise(numbered.select("origin", F.floor(F.col("n") / MARKS).alias("block"), F.pmod("n", F.lit(MARKS)).cast("int").alias("bit")), "marks")
    hops = edges.select(F.col("src").alias("id"), F.col("dst").alias("next")).distinct().persist(StorageLevel.MEMORY_AND_DISK)
    united = lambda rows, name="marks": rows.groupBy("id", "block").agg(F.bit_or("marks").alias(name))
    rounds = Rounds(origins.sparkSession, "marked")
    first = start.join(numbered, "origin").select("id", "block", F.expr("shiftleft(1L, bit)").alias("marks"))
    n, at = rounds.add(united(first).select("id", "block", F.lit(0).alias("depth"), "marks")), 0
    try:
        while n and (max_depth is None or at < max_depth):
            at += 1
            found = united(rounds.last().join(shuffled(hops), "id").select(F.col("next").alias("id"), "block", "marks"))
            new = F.col("marks").bitwiseAND(F.bitwise_not(F.coalesce("known", F.lit(0).cast("long"))))
            found = found.join(shuffled(united(rounds.all(), "known")), ["id", "block"], "left").select("id", "block", F.lit(at).alias("depth"), new.alias("marks"))
            n = rounds.add(found.where("marks <> 0"))
    finally:
        hops.unpersist()
    return numbered, rounds.all()


def relax(start: DataFrame, hops: DataFrame, keys: list[str], max_rounds: int = 200) -> DataFrame:
    """(keys, cost): least cost of each state. ``start``: keys and cost; ``hops``: id, next, weight, joined on the last key.

    Bellman-Ford by rounds: only states whose cost fell go on.
    """
    *rest, last = keys
    hops = hops.select(F.col("id").alias(last), "next", "weight").persist(StorageLevel.MEMORY_AND_DISK)
    least = lambda rows: rows.groupBy(*keys).agg(F.min("cost").alias("cost"))
    rounds = Rounds(start.sparkSession, "costs")
    n = rounds.add(least(start))
    try:
        while n:
            if rounds.count > max_rounds:
                raise RuntimeError(f"costs did not settle in {max_rounds} rounds")
            found = least(rounds.last().join(hops, last).select(*rest, F.col("next").alias(last), (F.col("cost") + F.col("weight")).alias("cost")))
            before = least(rounds.all()).withColumnRenamed("cost", "old")
            n = rounds.add(found.join(before, keys, "left").where("old is null or cost < old - 1e-9").select(*keys, "cost"))
    finally:
        hops.unpersist()
    return least(rounds.all())


def nearest_sources(sources: DataFrame, hops: DataFrame, most: int = 2, max_rounds: int = 200) -> DataFrame:
    """(id, source, cost): of each object the ``most`` sources (id) with the least cost of a way from them to it, ties by source; a source's own is 0. ``hops``:
    prev, id, w, which is above 0.

    Whatever is near an object is near the one before it too, so no object has more than ``most`` states, however many sources there are.
    """
    hops = hops.select(F.col("prev"), F.col("id").alias("next"), "w").persist(StorageLevel.MEMORY_AND_DISK)
    order = Window.partitionBy("id").orderBy("cost", "source")
    first = lambda rows: rows.withColumn("k", F.row_number().over(order)).where(F.col("k") <= most).drop("k")
    least = lambda rows: rows.groupBy("id", "source").agg(F.min("cost").alias("cost"))
    rounds = Rounds(sources.sparkSession, "nearest")
    n = rounds.add(sources.select("id", F.col("id").alias("source"), F.lit(0).cast("long").alias("cost")).distinct())
    try:
        while n:
            if rounds.count > max_rounds:
                raise RuntimeError(f"costs did not settle in {max_rounds} rounds")
            found = rounds.last().join(shuffled(hops), F.col("id") == F.col("prev")).select(F.col("next").alias("id"), "source", (F.col("cost") + F.col("w")).alias("cost"))
            both = rounds.all().withColumn("new", F.lit(False)).union(first(least(found)).withColumn("new", F.lit(True)))
            both = both.groupBy("id", "source").agg(F.min(F.struct("cost", "new")).alias("x")).select("id", "source", "x.cost", "x.new")
            n = rounds.add(first(both).where("new").drop("new"))
    finally:
        hops.unpersist()
    return first(least(rounds.all()))
