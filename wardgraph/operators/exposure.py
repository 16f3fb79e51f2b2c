"""Exact exposure: which principals reach tier 0 by a route with at least one attack step, and in how many hops.

The search runs backwards from all tier-0 objects at once over states (id, attacked): attacked is true once a step of an attack kind lies on
the route. Steps of input kinds are never walked, and no route passes through a second tier-0 object. A shortest walk may pass an
object twice, once in each state; routes that might are checked by ``simple_routes``.
"""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import registry
from ..storage import materialise, shuffled
from .fixpoint import closure, semi_naive


def walkable(edges: DataFrame, top: DataFrame) -> DataFrame:
    """(src, dst, edge_type, attack): edges that routes may use: no input kinds, none that starts in tier 0."""
    kept = edges.where(~F.col("edge_type").isin(registry.NON_TRAVERSABLE)).join(shuffled(top.select(F.col("id").alias("src"))), "src", "left_anti")
    return kept.select("src", "dst", "edge_type", F.col("edge_type").isin(registry.ATTACK).alias("attack"))


def states(edges: DataFrame, top: DataFrame) -> DataFrame:
    """(id, attacked, depth): fewest hops from each state to tier 0."""
    hops = walkable(edges, top).select("src", F.col("dst").alias("id"), "attack").distinct().persist(StorageLevel.MEMORY_AND_DISK)
    start = top.select("id", F.lit(False).alias("attacked"))
    found = semi_naive(start, lambda new: new.join(hops, "id").select(F.col("src").alias("id"), (F.col("attacked") | F.col("attack")).alias("attacked")), ["id", "attacked"], dealt=True)
    hops.unpersist()
    return found


def exposed(edges: DataFrame, top: DataFrame) -> DataFrame:
    """(id, hops) of exposed objects, by walks."""
    return states(edges, top).where("attacked").join(shuffled(top), "id", "left_anti").select("id", F.col("depth").alias("hops"))


def next_steps(edges: DataFrame, top: DataFrame, found: DataFrame) -> DataFrame:
    """(id, attacked, depth, next_id, next_attacked, edge_type): a shortest route's next step from each state, the least (edge_type, next_id) of those."""
    ahead = found.select(F.col("id").alias("dst"), F.col("attacked").alias("next_attacked"), (F.col("depth") + 1).alias("depth"))
    steps = walkable(edges, top).join(shuffled(ahead), "dst").withColumn("attacked", F.col("next_attacked") | F.col("attack"))
    best = steps.groupBy(F.col("src").alias("id"), "attacked", "depth").agg(F.min(F.struct("edge_type", F.col("dst").alias("next_id"), "next_attacked")).alias("s"))
    return found.where("depth > 0").join(shuffled(best), ["id", "attacked", "depth"]).select("id", "attacked", "depth", "s.next_id", "s.next_attacked", "s.edge_type")


def simple_routes(edges: DataFrame, top: DataFrame, suspects: DataFrame, max_depth: int = 14, budget: int = 60_000, found: DataFrame | None = None) -> DataFrame:
    """(id, hops, verified): for suspects (id), the fewest hops of a route that passes no object twice; hops is null if none was found.

    Routes of all suspects grow together, a step a round; of those with the same objects and head one is kept, and none grows on from
    where ``found`` (the states, computed if not given) has no way to tier 0. verified is false where a suspect's routes were more than
    ``budget`` or still growing after ``max_depth`` steps.
    """
    ahead = (states(edges, top) if found is None else found).groupBy(F.col("id").alias("dst")).agg(F.max("attacked").alias("may_attack"))
    goals = top.select(F.col("id").alias("dst"), F.lit(True).alias("goal")).distinct()
    hops = walkable(edges, top).groupBy("src", "dst").agg(F.max("attack").alias("attack")).join(ahead, "dst").join(goals, "dst", "left").withColumn("goal", F.coalesce("goal", F.lit(False)))
    hops = materialise(hops, "hops")
    origins = materialise(suspects.select(F.col("id").alias("origin")).distinct(), "suspects")
    front = origins.select("origin", F.col("origin").alias("head"), F.lit(False).alias("attacked"), F.array("origin").alias("passed"))
    used = origins.select("origin", F.lit(0).cast("long").alias("n"))
    settled = None

    def settle(rows: DataFrame, hops: int | None, verified: bool) -> None:
        nonlocal settled
        rows = rows.select(F.col("origin").alias("id"), F.lit(hops).cast("int").alias("hops"), F.lit(verified).alias("verified"))
        settled = rows if settled is None else settled.union(rows)

    for depth in range(1, max_depth + 1):
        used = materialise(used.union(front.groupBy("origin").agg(F.count("*").alias("n"))).groupBy("origin").agg(F.sum("n").alias("n")), "used")
        over = used.where(F.col("n") > budget).select("origin")
        settle(over.join(front, "origin", "left_semi"), None, False)
        grown = front.join(over, "origin", "left_anti").join(hops, F.col("head") == F.col("src")).where(~F.array_contains("passed", F.col("dst")))
        grown = grown.withColumn("attacked", F.col("attacked") | F.col("attack")).where(F.col("attacked") | (~F.col("goal") & F.col("may_attack")))
        grown = grown.select("origin", F.col("dst").alias("head"), "attacked", F.array_sort(F.array_append("passed", F.col("dst"))).alias("passed"), "goal").distinct()
        grown = materialise(grown, "routes")
        reached = grown.where("goal").select("origin").distinct()
        settle(reached, depth, True)
        front = grown.where("not goal").drop("goal").join(reached, "origin", "left_anti")
        if front.isEmpty():
            break
    settle(front.select("origin").distinct(), None, False)
    settled = materialise(settled, "settled")
    without = origins.withColumnRenamed("origin", "id").join(settled, "id", "left_anti").select("id", F.lit(None).cast("int").alias("hops"), F.lit(True).alias("verified"))
    return settled.union(without)


def exact(edges: DataFrame, top: DataFrame) -> DataFrame:
    """(id, hops, verified) of exposed objects, with walks that pass an object twice replaced by the shortest route that doesn't.

    Where a bound ended the search for that route, hops is the walk's and verified is false.
    """
    found = states(edges, top)
    steps = materialise(next_steps(edges, top, found), "steps")
    both = found.groupBy("id").agg(F.count("*").alias("n")).where("n = 2").select("id")
    # states whose shortest route passes an object that is reachable in both states
    touched = steps.join(both, "id", "left_semi").select("id", "attacked")
    back = steps.select(F.col("id").alias("src"), F.col("attacked").alias("was"), F.col("next_id").alias("id"), F.col("next_attacked").alias("attacked"))
    suspects = semi_naive(touched, lambda new: new.join(back, ["id", "attacked"]).select(F.col("src").alias("id"), F.col("was").alias("attacked")), ["id", "attacked"])
    walks = found.where("attacked").join(top, "id", "left_anti").select("id", F.col("depth").alias("hops"))
    checked = materialise(simple_routes(edges, top, walks.join(suspects.where("attacked").select("id"), "id", "left_semi"), found=found), "checked")
    sure = walks.join(checked.select("id"), "id", "left_anti").select("id", "hops", F.lit(True).alias("verified"))
    return sure.union(checked.where("hops is not null").select("id", "hops", "verified")).union(
        checked.where("hops is null and not verified").select("id").join(walks, "id").select("id", "hops", F.lit(False))
    )


#: Stands for every signature; a signature is made of numbers and commas.
ANY = "*"


def deny_signatures(denies: DataFrame, edges: DataFrame) -> DataFrame:
    """(actor, sig): sorted deny_ids that bind an actor. denies: deny_id, principal, edge_type, target; a deny binds its principal and all recursive members."""
    members = edges.where(F.col("edge_type") == "MemberOf")
    bound = closure(denies.select(F.col("deny_id").alias("origin"), F.col("principal").alias("id")), members, "dst", "src")
    return bound.groupBy(F.col("id").alias("actor")).agg(F.array_join(F.array_sort(F.collect_set(F.col("origin").cast("string"))), ",").alias("sig"))


def exposed_with_denies(edges: DataFrame, top: DataFrame, denies: DataFrame) -> DataFrame:
    """(id, hops): exposure where a deny blocks one kind of step onto one object for those it binds.

    A state also carries the signature of the identity that acts. A membership step keeps it; any other step lands on an object, so the
    signature ahead must be the object's own, and behind it may be any signature that no deny for that step and object contains. ANY stands for all
    signatures, so only steps onto guarded objects have a row for each signature that may take them.
    """
    hops = materialise(walkable(edges, top), "hops")
    step_of = ["dst", "edge_type"]
    guarded = denies.select("deny_id", F.col("principal"), "edge_type", F.col("target").alias("dst")).join(hops.select(*step_of).distinct(), step_of, "left_semi")
    sigs = materialise(deny_signatures(guarded, edges), "signatures")
    universe = sigs.select("sig").union(sigs.sparkSession.createDataFrame([("",)], "sig string")).distinct()
    bound = universe.select("sig", F.explode(F.split("sig", ",")).alias("deny_id"))
    blocked = bound.join(guarded.select(F.col("deny_id").cast("string").alias("deny_id"), *step_of), "deny_id").select(*step_of, "sig").distinct()
    universe, blocked = materialise(universe, "universe"), materialise(blocked, "blocked")
    own = hops.select(F.col("dst").alias("id")).union(hops.select("src")).union(top.select("id")).distinct().join(sigs.withColumnRenamed("actor", "id"), "id", "left").select("id", F.coalesce("sig", F.lit("")).alias("own"))
    own = materialise(own, "own")
    nested = hops.where("edge_type = 'MemberOf'").select("src", F.col("dst").alias("id"))
    landed = hops.where("edge_type <> 'MemberOf'").join(own, F.col("dst") == F.col("id"))
    free = landed.join(blocked.select(*step_of).distinct(), step_of, "left_anti").select("src", "id", "attack", "own", F.lit(ANY).alias("behind"))
    # only steps that a deny names meet the signatures
    barred = landed.join(blocked.select(*step_of).distinct(), step_of, "left_semi").crossJoin(universe).join(blocked, [*step_of, "sig"], "left_anti")
    landing = materialise(free.union(barred.select("src", "id", "attack", "own", "sig")).distinct(), "landing")

    def step(new: DataFrame) -> DataFrame:
        up = new.join(nested, "id").select(F.col("src").alias("id"), "attacked", "sig")
        on = new.join(landing, "id").where((F.col("sig") == ANY) | (F.col("sig") == F.col("own")))
        return up.union(on.select(F.col("src").alias("id"), (F.col("attacked") | F.col("attack")).alias("attacked"), F.col("behind").alias("sig")))

    found = semi_naive(top.select("id", F.lit(False).alias("attacked"), F.lit(ANY).alias("sig")), step, ["id", "attacked", "sig"])
    found = found.where("attacked").join(own, "id").where((F.col("sig") == ANY) | (F.col("sig") == F.col("own")))
    return found.join(top, "id", "left_anti").groupBy("id").agg(F.min("depth").alias("hops"))
