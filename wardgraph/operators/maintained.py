"""Exposure kept up to date under changes of edges and of tier 0.

What is kept is the backward search's states with their distance and one shortest route's next step, so next steps form a forest. A change costs the states that it
touches:

* Removed edges, promoted and demoted objects invalidate states. Those whose route went through them are found by descending the forest. They lose their distance, and
  each takes the best one that its remaining edges offer to states that kept theirs.
* Added edges and new tier-0 objects offer distances. Offers that are better than what a state has are taken and passed on to the states before it, until
  none is better. Distances only fall, so each wave is a join of what just fell with the edges.

The result is an overlay: a row for each state that changed, with a null depth where it is lost. ``Kept`` is the first table with its overlay; updates follow one another.
Equal to a new search (the next step may be another one of equally short ones). An empty change leaves the overlay as it is.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import materialise, shuffled
from .exposure import next_steps, states, walkable
from .fixpoint import Rounds, semi_naive

STATE = ["id", "attacked"]
STEP = ["edge_type", "next_id", "next_attacked"]


class Kept(NamedTuple):
    base: DataFrame  #: STATE, depth, STEP
    overlay: DataFrame | None = None  #: the same for states that changed since; a null depth: no route any more

    def table(self) -> DataFrame:
        if self.overlay is None:
            return self.base
        return self.base.join(shuffled(self.overlay.select(*STATE)), STATE, "left_anti").union(self.overlay.where("depth is not null"))

    def exposed(self, top: DataFrame) -> DataFrame:
        """(id, hops), as ``exposure.exposed`` on the changed edges."""
        return self.table().where("attacked").join(shuffled(top.select("id")), "id", "left_anti").select("id", F.col("depth").alias("hops"))


def keep(edges: DataFrame, top: DataFrame) -> Kept:
    """The states of a graph and their next steps, computed once."""
    found = states(edges, top)
    steps = next_steps(edges, top, found).select(*STATE, *STEP)
    return Kept(materialise(found.join(shuffled(steps), STATE, "left").select(*STATE, "depth", *STEP), "kept"))


def _invalid(kept: DataFrame, removed: DataFrame, moved: DataFrame) -> DataFrame:
    """(STATE): states whose stored route uses a removed edge or passes an object of ``moved`` (id), which entered or left tier 0."""
    cut = removed.select(F.col("src").alias("id"), F.col("dst").alias("next_id"), "edge_type")
    seeds = kept.join(shuffled(cut), ["id", "next_id", "edge_type"], "left_semi").select(*STATE).union(kept.join(shuffled(moved.select("id")), "id", "left_semi").select(*STATE))
    behind = kept.where("next_id is not null").select(F.col("next_id").alias("id"), F.col("next_attacked").alias("attacked"), F.col("id").alias("child"), F.col("attacked").alias("child_attacked"))
    behind = behind.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        found = semi_naive(seeds, lambda new: new.join(behind, STATE).select(F.col("child").alias("id"), F.col("child_attacked").alias("attacked")), STATE, dealt=True)
    finally:
        behind.unpersist()
    return shuffled(materialise(found.select(*STATE), "invalid"))


def _offers(hops: DataFrame, ahead: DataFrame) -> DataFrame:
    """(STATE, depth, STEP) that ``hops`` offer to the objects before the states ``ahead`` (STATE, depth)."""
    ahead = ahead.select(F.col("id").alias("next_id"), F.col("attacked").alias("next_attacked"), (F.col("depth") + 1).alias("depth"))
    both = hops.select("src", F.col("dst").alias("next_id"), "edge_type", "attack").join(shuffled(ahead), "next_id")
    return both.select(F.col("src").alias("id"), (F.col("next_attacked") | F.col("attack")).alias("attacked"), "depth", *STEP)


def _best(offers: DataFrame) -> DataFrame:
    return offers.groupBy(*STATE).agg(F.min(F.struct("depth", *STEP)).alias("s")).select(*STATE, "s.*")


def update(kept: Kept, edges: DataFrame, top: DataFrame, removed: DataFrame, added: DataFrame, promoted: DataFrame | None = None, demoted: DataFrame | None = None, together: int = 2) -> Kept:
    """``kept`` after a change. ``edges`` and ``top`` are those after it; ``removed`` and ``added`` (src, dst, edge_type) the edges that went and came,
    ``promoted`` and ``demoted`` (id) the objects that entered and left tier 0."""
    spark = edges.sparkSession
    none = spark.createDataFrame([], "id string")
    promoted, demoted = (none if x is None else x.select("id") for x in (promoted, demoted))
    table = kept.table()
    hops = walkable(edges, top).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        invalid = _invalid(table, removed, promoted.union(demoted))
        sure = table.join(invalid, STATE, "left_anti")
        # edges of an object that left tier 0 weren't walked before
        new = walkable(added.select("src", "dst", "edge_type").union(edges.join(shuffled(demoted.withColumnRenamed("id", "src")), "src", "left_semi").select("src", "dst", "edge_type")), top)
        own = hops.join(shuffled(invalid.select(F.col("id").alias("src")).distinct()), "src", "left_semi")
        first = _offers(own, sure).join(invalid, STATE, "left_semi").union(_offers(new, sure))
        sources = promoted.select("id", F.lit(False).alias("attacked"), F.lit(0).alias("depth"), *[F.lit(None).cast("boolean" if c == "next_attacked" else "string").alias(c) for c in STEP])
        offers = first.union(sources)
        marked = invalid.withColumn("lost", F.lit(True))
        rounds = Rounds(spark, "waves")
        n = 1
        while n:
            fallen = None
            for i in range(1, together + 1):
                better = _best(offers).join(marked, STATE, "left").withColumn("lost", F.coalesce("lost", F.lit(False)))
                old = shuffled(table.select(*STATE, F.col("depth").alias("old")))
                better = better.join(old, (better["id"] == old["id"]) & (better["attacked"] == old["attacked"]) & ~better["lost"] & (old["old"] <= better["depth"]), "left_anti").drop("lost")
                if rounds.written:
                    taken = shuffled(rounds.all().select(F.col("id").alias("t"), F.col("attacked").alias("a"), F.col("depth").alias("d")))
                    better = better.join(taken, (F.col("id") == F.col("t")) & (F.col("attacked") == F.col("a")) & (F.col("d") <= F.col("depth")), "left_anti")
                rows = better.select(*STATE, "depth", *STEP, F.lit(i).alias("wave"))
                fallen = rows if fallen is None else fallen.union(rows)
                offers = _offers(hops, better)
            # what a later wave found again, no better, isn't passed on again
            one = fallen.groupBy(*STATE).agg(F.min(F.struct("depth", "wave", *STEP)).alias("s")).select(*STATE, "s.depth", *[f"s.{c}" for c in STEP], "s.wave")
            n = rounds.add(one, F.col("wave") == together)
            offers = _offers(hops, rounds.last().where(F.col("wave") == together))
        reached = _best(rounds.all())
        lost = invalid.join(shuffled(reached.select(*STATE)), STATE, "left_anti")
        nothing = [F.lit(None).cast(t).alias(c) for c, t in (("depth", "int"), ("edge_type", "string"), ("next_id", "string"), ("next_attacked", "boolean"))]
        overlay = reached.union(lost.select(*STATE, *nothing))
        if kept.overlay is not None:
            overlay = overlay.union(kept.overlay.join(shuffled(overlay.select(*STATE)), STATE, "left_anti").select(*overlay.columns))
        return Kept(kept.base, materialise(overlay.select(*STATE, "depth", *STEP), "overlay"))
    finally:
        hops.unpersist()


def changes_of(before: Kept, after: Kept, top_before: DataFrame, top_after: DataFrame) -> DataFrame:
    """(id, hops_before, hops_after) of objects whose exposure differs, read from the states that ``after`` changed and the objects whose tier did."""
    new = shuffled(after.overlay.where("attacked").select("id", "depth"))
    old = shuffled(before.table().where("attacked").select("id", "depth"))
    top_before, top_after = (shuffled(top_before),) * 2 if top_before is top_after else (shuffled(top_before), shuffled(top_after))
    ids, now = new.select("id"), new.where("depth is not null")
    if top_before is not top_after:
        moved = top_before.join(top_after, "id", "left_anti").select("id").union(top_after.join(top_before, "id", "left_anti").select("id"))
        ids, now = ids.union(moved), now.union(old.join(moved, "id", "left_semi").join(ids, "id", "left_anti"))
    was = old.join(shuffled(ids), "id", "left_semi").join(top_before.select("id"), "id", "left_anti").select("id", F.col("depth").alias("hops_before"))
    now = now.join(top_after.select("id"), "id", "left_anti").select("id", F.col("depth").alias("hops_after"))
    return was.join(shuffled(now), "id", "full").where(~F.col("hops_before").eqNullSafe(F.col("hops_after")))

