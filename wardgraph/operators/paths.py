"""Attack paths: enumeration, reachability, weighted routes, and what a path costs, shows and proves."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import registry
from ..storage import materialise, shuffled
from .exposure import states, walkable
from .fixpoint import closure, nearest_sources, relax, semi_naive

PATH = ["source", "target", "length", "weight", "nodes", "edge_types"]


def _weighted(edges: DataFrame, top: DataFrame) -> DataFrame:
    """(src, dst, edge_type, attack, w): edges that routes may use, with their weights."""
    dim = F.broadcast(registry.edge_dim(edges.sparkSession).select("edge_type", F.col("weight").alias("w")))
    return walkable(edges, top).join(dim, "edge_type", "left").select("src", "dst", "edge_type", "attack", F.coalesce("w", F.lit(100.0)).alias("w"))


def _shortest(level: DataFrame, grow: Callable[[DataFrame], DataFrame], routes: Callable[[DataFrame], DataFrame], max_depth: int, most: int | None) -> DataFrame:
    """PATH: what ``routes`` finds on each level that ``grow`` makes of the one before, the first ``most`` in order of (length, ``routes``'
    first two columns, nodes, edge types).

    A level is written only once it is known to hold fewer than are still wanted, so the last one, the largest, never is: each of its
    tasks keeps the first that are wanted.
    """
    done, n = None, 0
    for depth in range(1, max_depth + 1):
        grown = grow(level)
        if most is None:
            grown = level = materialise(grown, "paths")
        found = routes(grown).withColumn("length", F.lit(depth))
        if most is not None:
            found = materialise(found.orderBy(found.columns[0], found.columns[1], "nodes", "edge_types").limit(most - n), "shortest")
            n += found.count()
        done = found if done is None else done.union(found)
        if most is not None and n >= most:
            break
        if most is not None:
            level = materialise(grown, "paths")
        if level.isEmpty():
            break
    return done.select(*PATH)


def enumerate_paths(nodes: DataFrame, edges: DataFrame, top: DataFrame, max_depth: int = 20, max_paths: int | None = 10_000) -> DataFrame:
    """PATH: simple paths with an attack step from known objects to tier 0, of at most ``max_depth`` steps; parallel edges give paths of their own.

    Grown backwards, a level a job; no path passes another tier-0 object. With ``max_paths`` the shortest are kept, in order of (length,
    target, nodes, edge types), and levels stop once there are enough; None keeps all.
    """
    back = materialise(_weighted(edges, top).withColumnRenamed("dst", "head"), "back")
    start = top.select(F.col("id").alias("target"), F.col("id").alias("head"), F.array("id").alias("nodes"), F.array().cast("array<string>").alias("edge_types"), F.lit(0.0).alias("weight"), F.lit(False).alias("attacked"))

    def grow(level: DataFrame) -> DataFrame:
        level = level.join(back, "head").where(~F.array_contains("nodes", F.col("src")))
        return level.select("target", F.col("src").alias("head"), F.array_insert("nodes", 1, F.col("src")).alias("nodes"), F.array_insert("edge_types", 1, F.col("edge_type")).alias("edge_types"), (F.col("weight") + F.col("w")).alias("weight"), (F.col("attacked") | F.col("attack")).alias("attacked"))

    def routes(level: DataFrame) -> DataFrame:
        known = level.where("attacked").join(nodes.select(F.col("object_id").alias("head")), "head", "left_semi")
        return known.select("target", F.col("head").alias("source"), "weight", "nodes", "edge_types")

    return _shortest(start, grow, routes, max_depth, max_paths)


def with_ids(paths: DataFrame) -> DataFrame:
    """``paths`` with path_id: its nodes and edge types in one text."""
    return paths.withColumn("path_id", F.concat(F.array_join("nodes", ">"), F.lit("|"), F.array_join("edge_types", ">")))


def steps(paths: DataFrame) -> DataFrame:
    """(path_id, step, src, dst, edge_type): a row for each step of each path, from 1."""
    rows = paths.select("path_id", "nodes", F.posexplode("edge_types").alias("i", "edge_type"))
    return rows.select("path_id", (F.col("i") + 1).alias("step"), F.get("nodes", F.col("i")).alias("src"), F.get("nodes", F.col("i") + 1).alias("dst"), "edge_type")


def path_stats(paths: DataFrame) -> DataFrame:
    return paths.agg(F.count("*").alias("n_paths"), F.min("length").alias("min_length"), F.max("length").alias("max_length"), F.round(F.avg("length"), 4).alias("avg_length"), F.count_distinct("source").alias("n_sources"))


def blast_radius(starts: DataFrame, edges: DataFrame, max_depth: int = 6) -> DataFrame:
    """(origin, id, depth): what starts (id) reach along any edge, themselves left out."""
    found = closure(starts.select(F.col("id").alias("origin"), "id"), edges, max_depth=max_depth)
    return found.where("depth > 0")


def reverse_reach(targets: DataFrame, edges: DataFrame, max_depth: int | None = None) -> DataFrame:
    """(id, depth): objects that reach any target (id) along any edge, targets left out."""
    start = targets.select(F.lit("all").alias("origin"), "id")
    found = closure(start, edges, "dst", "src", max_depth)
    return found.where("depth > 0").select("id", "depth")


def cheapest_weights(starts: DataFrame, edges: DataFrame) -> DataFrame:
    """(origin, id, cost): least total weight from starts (id) along any edge."""
    dim = F.broadcast(registry.edge_dim(edges.sparkSession).select("edge_type", "weight"))
    hops = edges.join(dim, "edge_type", "left").groupBy(F.col("src").alias("id"), F.col("dst").alias("next")).agg(F.min(F.coalesce("weight", F.lit(100.0))).alias("weight"))
    return relax(starts.select(F.col("id").alias("origin"), "id", F.lit(0.0).alias("cost")), hops, ["origin", "id"])


#: Weights are summed as whole billionths, so that equal routes have equal costs whatever the order of their steps.
UNIT = 1_000_000_000


def _cheapest_hops(edges: DataFrame, costs: DataFrame, other: int) -> DataFrame:
    """(prev, id, w, edge_type): of parallel edges the one with the least cost (ties by kind)."""
    rows = edges.select("src", "dst", "edge_type").join(F.broadcast(costs), "edge_type", "left").withColumn("w", F.coalesce("w", F.lit(other)))
    return rows.groupBy(F.col("src").alias("prev"), F.col("dst").alias("id")).agg(F.min(F.struct("w", "edge_type")).alias("x")).select("prev", "id", "x.w", "x.edge_type")


def weighted_tree(starts: DataFrame, edges: DataFrame, costs: DataFrame | None = None, other: int = 100 * UNIT) -> DataFrame:
    """(origin, id, cost, prev, edge_type): least total cost from each start (id) along any edge, and the last step of such a route: of
    several the one with the least previous object. A start itself has cost 0 and no step. costs: edge_type, w (above 0), a row for each kind; ``other``: of kinds
    that aren't in it. Weights in UNITs unless given."""
    if costs is None:
        costs = registry.edge_dim(edges.sparkSession).select("edge_type", F.round(F.col("weight") * UNIT).cast("long").alias("w"))
    hops = materialise(_cheapest_hops(edges, costs, other), "hops")
    costs = relax(starts.select(F.col("id").alias("origin"), "id", F.lit(0).cast("long").alias("cost")).distinct(), hops.select(F.col("prev").alias("id"), F.col("id").alias("next"), F.col("w").alias("weight")), ["origin", "id"])
    costs = materialise(costs, "costs")
    ahead = costs.select("origin", F.col("id").alias("prev"), F.col("cost").alias("so_far"))
    last = ahead.join(hops, "prev").withColumn("cost", F.col("so_far") + F.col("w")).join(costs, ["origin", "id", "cost"], "left_semi")
    last = last.groupBy("origin", "id").agg(F.min(F.struct("prev", "edge_type")).alias("x")).select("origin", "id", "x.prev", "x.edge_type")
    return costs.join(last.where("id <> origin"), ["origin", "id"], "left").select("origin", "id", "cost", "prev", "edge_type")


def nearest_routes(targets: DataFrame, sources: DataFrame, edges: DataFrame, costs: DataFrame, other: int) -> DataFrame:
    """(target, source, cost, nodes, edge_types): the route of least cost from any other source (id) to each target (id) that one reaches; of equal ones that of
    the least source, then the one whose next object is least at each step. costs: edge_type, w (above 0), a row for each kind; ``other``: of kinds that aren't in it.

    All sources search forwards at once. Two of them are kept for each object, as the nearest to a target may be the target itself; whatever lies on a
    cheapest route to a target has the route's source among its two."""
    hops = materialise(_cheapest_hops(edges, costs, other), "hops")
    near = materialise(nearest_sources(sources, hops), "nearest")
    best = near.join(shuffled(targets.select("id").distinct()), "id").where("source <> id").groupBy("id").agg(F.min(F.struct("cost", "source")).alias("x"))
    best = materialise(best.select(F.col("id").alias("target"), "x.source", "x.cost"), "best")
    # steps on a cheapest way from their source
    ahead = near.select(F.col("id").alias("prev"), "source", F.col("cost").alias("so_far")).join(shuffled(hops), "prev")
    ahead = ahead.withColumn("cost", F.col("so_far") + F.col("w")).join(shuffled(near), ["id", "source", "cost"], "left_semi").select("source", "prev", "id", "edge_type")
    # a route is found by its steps backwards
    wanted = shuffled(best.select("source").distinct())
    ahead = materialise(ahead.join(wanted, "source", "left_semi"), "ahead")
    start = best.select("target", "source", F.col("target").alias("id"))
    seen = semi_naive(start, lambda new: new.join(ahead, ["source", "id"]).select("target", "source", F.col("prev").alias("id")), ["target", "source", "id"])
    seen = materialise(seen.select("target", "source", "id"), "seen")
    step = seen.join(ahead, ["source", "id"]).groupBy("target", F.col("prev").alias("id")).agg(F.min(F.struct(F.col("id").alias("prev"), "edge_type")).alias("x"))
    tree = seen.select(F.col("target").alias("origin"), "id").join(step.select(F.col("target").alias("origin"), "id", "x.prev", "x.edge_type"), ["origin", "id"], "left")
    routes = routes_of(materialise(tree, "tree"), best.select(F.col("target").alias("origin"), F.col("source").alias("id")))
    routes = routes.select(F.col("origin").alias("target"), F.reverse("nodes").alias("nodes"), F.reverse("edge_types").alias("edge_types"))
    return best.join(routes, "target").select("target", "source", "cost", "nodes", "edge_types")


def cheapest_routes_to_targets(starts: DataFrame, targets: DataFrame, edges: DataFrame) -> DataFrame:
    """(origin, target, cost, nodes, edge_types): a route of least weight from each start (id) to each target (id) that it reaches. A start that is a target
    has a route of no steps."""
    tree = materialise(weighted_tree(starts, edges), "tree")
    wanted = tree.join(targets.select("id").distinct(), "id", "left_semi").select("origin", "id")
    rows = routes_of(tree, wanted).join(tree.select("origin", "id", "cost"), ["origin", "id"])
    return rows.select("origin", F.col("id").alias("target"), (F.col("cost") / UNIT).alias("cost"), "nodes", "edge_types")


def routes_of(tree: DataFrame, wanted: DataFrame) -> DataFrame:
    """(origin, id, nodes, edge_types): the routes of ``tree`` (``weighted_tree``) to wanted objects (origin, id). Each pass doubles the part of the routes
    that is known, so a route of n steps takes about log2(n) passes."""
    empty = F.array().cast("array<string>")
    # from a to ``at``: objects after ``at``, and kinds of the steps
    jumps = tree.select(
        "origin", "id", F.coalesce("prev", "id").alias("at"),
        F.when(F.col("prev").isNull(), empty).otherwise(F.array("id")).alias("nodes"), F.when(F.col("prev").isNull(), empty).otherwise(F.array("edge_type")).alias("kinds"),
    )
    jumps = materialise(jumps, "jumps")
    while not jumps.where("at <> origin").isEmpty():
        before = jumps.select("origin", F.col("id").alias("at"), F.col("at").alias("at2"), F.col("nodes").alias("nodes2"), F.col("kinds").alias("kinds2"))
        joined = jumps.join(before, ["origin", "at"])
        jumps = materialise(joined.select("origin", "id", F.col("at2").alias("at"), F.concat("nodes2", "nodes").alias("nodes"), F.concat("kinds2", "kinds").alias("kinds")), "jumps")
    rows = jumps.join(wanted.select("origin", "id").distinct(), ["origin", "id"], "left_semi")
    return rows.select("origin", "id", F.concat(F.array("origin"), "nodes").alias("nodes"), F.col("kinds").alias("edge_types"))


def breach_routes(starts: DataFrame, nodes: DataFrame, edges: DataFrame, top: DataFrame, max_depth: int = 12, max_routes: int | None = 4000) -> DataFrame:
    """PATH: simple routes with an attack step from known starts (id) to the first tier-0 object they meet, the shortest ``max_routes`` in order of
    (length, source, target, nodes, edge types).

    Grown forwards from the starts, over objects from which tier 0 can be reached and an attack step, if it is still lacking, taken.
    """
    ahead = states(edges, top).groupBy(F.col("id").alias("dst")).agg(F.max("attacked").alias("may_attack"))
    goals = top.select(F.col("id").alias("dst"), F.lit(True).alias("goal")).distinct()
    hops = _weighted(edges, top).join(ahead, "dst").join(goals, "dst", "left").withColumn("goal", F.coalesce("goal", F.lit(False)))
    hops = materialise(hops.withColumnRenamed("src", "head"), "hops")
    first = starts.select(F.col("id").alias("object_id")).join(nodes, "object_id", "left_semi").join(top.select(F.col("id").alias("object_id")), "object_id", "left_anti").distinct()
    start = first.select(F.col("object_id").alias("source"), F.col("object_id").alias("head"), F.array("object_id").alias("nodes"), F.array().cast("array<string>").alias("edge_types"), F.lit(0.0).alias("weight"), F.lit(False).alias("attacked"), F.lit(False).alias("goal"))

    def grow(level: DataFrame) -> DataFrame:
        level = level.where("not goal").drop("goal").join(hops, "head").where(~F.array_contains("nodes", F.col("dst")))
        level = level.withColumn("attacked", F.col("attacked") | F.col("attack")).where(F.col("attacked") | (~F.col("goal") & F.col("may_attack")))
        return level.select("source", F.col("dst").alias("head"), F.array_append("nodes", F.col("dst")).alias("nodes"), F.array_append("edge_types", F.col("edge_type")).alias("edge_types"), (F.col("weight") + F.col("w")).alias("weight"), "attacked", "goal")

    def routes(level: DataFrame) -> DataFrame:
        return level.where("goal").select("source", F.col("head").alias("target"), "weight", "nodes", "edge_types")

    return _shortest(start, grow, routes, max_depth, max_routes)


def membership_chain(principals: DataFrame, edges: DataFrame, top_groups: DataFrame) -> DataFrame:
    """(principal_id, group_id, depth): the nearest tier-0 group (id) that a principal (id) is in; ties by id."""
    found = closure(principals.select(F.col("id").alias("origin"), "id"), edges.where("edge_type = 'MemberOf'")).where("depth > 0")
    best = found.join(top_groups.select("id").distinct(), "id", "left_semi").groupBy("origin").agg(F.min(F.struct("depth", "id")).alias("m"))
    return best.select(F.col("origin").alias("principal_id"), F.col("m.id").alias("group_id"), F.col("m.depth").alias("depth"))


def path_costs(paths: DataFrame) -> DataFrame:
    """(path_id, effort, noise, steps, fragile, planes, cross_plane): what a path costs an attacker; free steps don't count."""
    rows = steps(paths).join(F.broadcast(registry.edge_dim(paths.sparkSession)), "edge_type", "left")
    bridge, ad, cloud = F.max(F.col("plane") == "bridge"), F.max(F.col("plane") == "ad"), F.max(F.col("plane").isin("entra", "azure", "msgraph"))
    return rows.groupBy("path_id").agg(
        F.sum(F.coalesce("effort", F.lit(0))).alias("effort"),
        F.sum(F.coalesce("noise", F.lit(0))).alias("noise"),
        F.count(F.when(F.coalesce("effort", F.lit(0)) > 0, 1)).alias("steps"),
        F.count(F.when(F.col("fragile"), 1)).alias("fragile"),
        F.array_join(F.array_sort(F.collect_set(F.coalesce("plane", F.lit("ad")))), ",").alias("planes"),
        F.coalesce((ad & cloud) | bridge, F.lit(False)).alias("cross_plane"),
    )


def attractiveness(costs: DataFrame, effort: float = 1.0, noise: float = 1.0) -> DataFrame:
    """``costs`` with attractiveness: weighted effort and noise, and 3 for each fragile step; the least attracts most."""
    return costs.withColumn("attractiveness", F.lit(effort) * F.col("effort") + F.lit(noise) * F.col("noise") + 3 * F.col("fragile"))


def best_per_target(paths: DataFrame, costs: DataFrame) -> DataFrame:
    """(target, cheapest, stealthiest): path ids by (effort, noise, length) and (noise, effort, length), ties by id."""
    rows = paths.join(costs, "path_id")
    return rows.groupBy("target").agg(F.min(F.struct("effort", "noise", "length", "path_id"))["path_id"].alias("cheapest"), F.min(F.struct("noise", "effort", "length", "path_id"))["path_id"].alias("stealthiest"))


def edge_confidence(edges: DataFrame) -> DataFrame:
    """(src, dst, edge_type, level): how sure an edge is, 1 low to 3 high. A session counts by ``seen``, the number of collections, if the column exists."""
    dim = F.broadcast(registry.edge_dim(edges.sparkSession).select("edge_type", registry.rank("confidence", registry.CONFIDENCES).alias("known")))
    seen = F.coalesce("seen", F.lit(1)) if "seen" in edges.columns else F.lit(1)
    session = F.col("edge_type") == "HasSession"
    return edges.join(dim, "edge_type", "left").select("src", "dst", "edge_type", F.when(session, F.least(seen, F.lit(3)).cast("int")).otherwise(F.coalesce("known", F.lit(3))).alias("level"))


def path_confidence(paths: DataFrame, edges: DataFrame) -> DataFrame:
    """(path_id, level, weakest): the least sure step that isn't plain structure, the first of those; level is high where there is none."""
    sure = edge_confidence(edges)
    rows = steps(paths).join(sure, ["src", "dst", "edge_type"], "left")
    counted = F.when(~F.col("edge_type").isin(registry.PLAIN_STRUCTURE), F.struct(F.coalesce("level", F.lit(3)).alias("level"), "step", "edge_type"))
    found = rows.groupBy("path_id").agg(F.min(counted).alias("m"))
    return found.select("path_id", registry.label(F.coalesce("m.level", F.lit(3)), registry.CONFIDENCES).alias("level"), F.col("m.edge_type").alias("weakest"))


def finding_confidence(paths: DataFrame, confidence: DataFrame, by: str = "source") -> DataFrame:
    """(by, level): of a finding's paths the surest counts."""
    rows = paths.join(confidence, "path_id").withColumn("r", registry.rank("level", registry.CONFIDENCES))
    return rows.groupBy(by).agg(F.max("r").alias("r")).select(by, registry.label(F.col("r"), registry.CONFIDENCES).alias("level"))


def coverage(paths: DataFrame, telemetry: list[str], rule_edges: list[str], rule_techniques: list[str] = ()) -> DataFrame:
    """(path_id, step, edge_type, status): 0 blind, 1 visible with ``telemetry``, 2 detected by a rule, of steps that show anything."""
    spark = paths.sparkSession
    have = F.array(*[F.lit(t) for t in telemetry]) if telemetry else F.array().cast("array<string>")
    seen = registry.observable_dim(spark).groupBy("edge_type").agg(F.max(F.size(F.array_except("needs", have)) == 0).alias("seen"))
    dim = registry.edge_dim(spark).select("edge_type", "technique").join(seen, "edge_type", "full")
    technique = F.upper(F.coalesce("technique", F.lit("")))
    named = F.lit(False)
    for t in rule_techniques:
        named = named | ((technique != "") & ((technique == t.upper()) | technique.startswith(t.upper() + ".") | F.lit(t.upper()).startswith(F.concat(technique, F.lit(".")))))
    fallback = registry.FALLBACK_TELEMETRY[0] in telemetry
    rows = steps(paths).where(~F.col("edge_type").isin(registry.UNCUTTABLE)).join(F.broadcast(dim), "edge_type", "left")
    status = F.when(~F.coalesce("seen", F.lit(fallback)), 0).when(F.col("edge_type").isin(list(rule_edges)) | named, 2).otherwise(1)
    return rows.select("path_id", "step", "edge_type", status.alias("status"))


def path_coverage(paths: DataFrame, covered: DataFrame) -> DataFrame:
    """(path_id, status, first_detected): a path is as visible as its most visible step; first_detected counts its steps that show anything."""
    ranked = covered.groupBy("path_id").agg(F.max("status").alias("status"), F.min(F.when(F.col("status") == 2, F.col("step"))).alias("at"))
    before = covered.join(ranked.select("path_id", "at"), "path_id").groupBy("path_id").agg(F.count(F.when(F.col("step") <= F.col("at"), 1)).alias("k"))
    rows = paths.select("path_id").join(ranked, "path_id", "left").join(before, "path_id", "left")
    return rows.select("path_id", registry.label(F.coalesce("status", F.lit(0)) + 1, registry.COVERAGES).alias("status"), F.when(F.col("at").isNotNull(), F.col("k")).alias("first_detected"))


def enable_next(paths: DataFrame, telemetry: list[str], covered: DataFrame) -> DataFrame:
    """(telemetry, paths, quality): for each one source of telemetry, the blind paths that switching it on makes visible, and the sum of its best quality."""
    spark = paths.sparkSession
    have = F.array(*[F.lit(t) for t in telemetry]) if telemetry else F.array().cast("array<string>")
    gain = registry.observable_dim(spark).withColumn("missing", F.array_except("needs", have)).where(F.size("missing") == 1).select("edge_type", F.get("missing", 0).alias("telemetry"), "quality")
    blind = covered.groupBy("path_id").agg(F.max("status").alias("s")).where("s = 0").select("path_id")
    best = covered.join(blind, "path_id", "left_semi").join(F.broadcast(gain), "edge_type").groupBy("path_id", "telemetry").agg(F.max("quality").alias("q"))
    return best.groupBy("telemetry").agg(F.count("*").alias("paths"), F.sum("q").alias("quality"))


def chains(paths: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(path_id, chain): known patterns that a path holds. What ``nodes`` tells of objects counts where it has the columns: hasspn,
    dontreqpreauth, unconstraineddelegation."""
    has = lambda *kinds: F.arrays_overlap("edge_types", F.array(*[F.lit(k) for k in kinds]))
    found = {
        "acl_chain": has("WriteDacl", "WriteOwner", "Owns") & has("GenericAll", "GenericWrite", "AddMember", "ForceChangePassword"),
        "shadow_credentials": has("WriteKeyCredentialLink"),
        "rbcd": has("AddAllowedToAct", "AllowedToAct"),
        "gpo_abuse": has("GPOControlsObject", "WriteGPLink"),
        "laps_abuse": has("ReadLAPSPassword"),
        "gmsa_abuse": has("ReadGMSAPassword"),
        "adcs_abuse": F.exists("edge_types", lambda e: e.startswith("ADCS") | (e == "GoldenCert")),
        "kerberoast": has("WriteSPN"),
    }
    # a name where a pattern holds, else nothing
    by_edges = paths.select("path_id", F.explode(F.array_compact(F.array(*[F.when(c, F.lit(name)) for name, c in found.items()]))).alias("chain"))
    visited = paths.select("path_id", F.posexplode("nodes").alias("at", "object_id"), "edge_types").select("path_id", "at", "object_id", F.get("edge_types", F.col("at") - 1).alias("by"))
    flag = lambda name: F.coalesce(name, F.lit(False)) if name in nodes.columns else F.lit(False)
    kind, host = F.col("node_type"), F.upper(F.split_part("name", F.lit("."), F.lit(1)))
    told = nodes.select(
        "object_id",
        (~F.coalesce("enabled", F.lit(True))).alias("disabled"),
        flag("hasspn").alias("served"),
        kind.isin("CertTemplate", "EnterpriseCA", "AIACA", "RootCA", "NTAuthStore").alias("pki"),
        ((kind == "User") & flag("dontreqpreauth")).alias("open"),
        ((kind == "Computer") & flag("unconstraineddelegation") & ~F.coalesce(host.contains("DC"), F.lit(False))).alias("free"),
    ).where("disabled or served or pki or open or free")
    control = ["GenericAll", "GenericWrite"]
    by_object = {
        "disabled_account": F.col("disabled"),
        "kerberoast": F.col("served") & F.col("by").isin(control),
        "adcs_abuse": F.col("pki") & F.col("by").isin([*control, "WriteDacl", "WriteOwner"]),
        "asrep_roasting": F.col("open") & (F.col("at") == 0),
        "unconstrained_delegation": F.col("free"),
    }
    by_objects = visited.join(told, "object_id").select("path_id", F.explode(F.array_compact(F.array(*[F.when(c, F.lit(name)) for name, c in by_object.items()]))).alias("chain"))
    syncing = edges.where("edge_type = 'DCSync'").select(F.col("src").alias("object_id"))
    synced = visited.join(syncing, "object_id", "left_semi").select("path_id", F.lit("dcsync").alias("chain"))
    return by_edges.union(by_objects).union(synced).distinct()


def through_node(paths: DataFrame, object_id: str) -> DataFrame:
    return paths.where(F.array_contains("nodes", object_id))


def through_edge(paths: DataFrame, src: str, dst: str, edge_type: str) -> DataFrame:
    at = lambda i: (F.get("nodes", i) == src) & (F.get("nodes", i + 1) == dst) & (F.get("edge_types", i) == edge_type)
    return paths.where(F.exists(F.sequence(F.lit(0), F.size("edge_types") - 1), at))


def onto_named(paths: DataFrame, nodes: DataFrame, part: str, most: int = 10) -> DataFrame:
    """The shortest ``most`` paths onto targets with ``part`` in their name, in any case; ties by path id."""
    named = nodes.where(F.upper("name").contains(part.upper())).select(F.col("object_id").alias("target"))
    return paths.join(named, "target", "left_semi").orderBy("length", "path_id").limit(most)
