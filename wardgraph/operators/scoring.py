"""Scores over paths: node risk, posture, choke points, leaderboards."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import registry, scalars
from ..storage import materialise, shuffled
from .fixpoint import MARKS, marked
from .paths import blast_radius, enumerate_paths, steps, with_ids
from .tiering import tier0


def node_risk(paths: DataFrame, tiered: DataFrame, edges: DataFrame, exact: int = 100, depth: int = 6) -> DataFrame:
    """(object_id, path_count, blast, tier0_reach, risk): of known objects below tier 0 that lie on paths. Reach is exact for the ``exact``
    objects on most paths (ties by id), and estimated from the count for the rest."""
    total = paths.agg(F.count("*").alias("total"))  # one row
    counts = paths.select(F.explode("nodes").alias("object_id")).groupBy("object_id").agg(F.count("*").alias("path_count"))
    counts = materialise(counts.join(tiered.where("tier <> 0").select("object_id"), "object_id", "left_semi"), "counts")
    first = counts.orderBy(F.desc("path_count"), "object_id").limit(exact)
    reach = blast_radius(first.select(F.col("object_id").alias("id")), edges, depth)
    top = tiered.where("tier = 0").select(F.col("object_id").alias("id"), F.lit(1).alias("t0"))
    exactly = reach.where("id <> origin").join(top, "id", "left").groupBy(F.col("origin").alias("object_id")).agg(F.count("*").alias("blast"), F.count("t0").alias("t0"))
    chosen = first.select("object_id").join(exactly, "object_id", "left").select("object_id", F.coalesce("blast", F.lit(0)).alias("b"), F.coalesce("t0", F.lit(0)).alias("t"))
    rows = counts.join(chosen, "object_id", "left").crossJoin(F.broadcast(total))
    c = F.col("path_count")
    rows = rows.select("object_id", "path_count", "total", F.coalesce("b", F.least(c, F.lit(50))).alias("blast"), F.coalesce("t", F.lit(1)).alias("tier0_reach"))
    score = F.least(F.log2(c + 1) / 10, F.lit(1.0)) * 40 + c / F.col("total") * 30 + F.least(F.col("blast") / 50, F.lit(1.0)) * 15 + F.least(F.col("tier0_reach") / 3, F.lit(1.0)) * 15
    return rows.select("object_id", "path_count", "blast", "tier0_reach", F.round(F.least(score, F.lit(100.0)), 1).alias("risk"))


def posture(paths: DataFrame, tiered: DataFrame) -> DataFrame:
    """One row: score (0 to 100, more is worse), grade, and what they are made of."""
    sources = paths.select(F.col("source").alias("object_id")).distinct()
    low = tiered.where("tier = 2").select("object_id")
    p = paths.agg(F.count("*").alias("n"), F.avg("length").alias("avg_length"))
    t = tiered.agg(F.count(F.when(F.col("tier") != 0, 1)).alias("below"), F.count(F.when(F.col("tier") == 2, 1)).alias("tier2_total"))
    s = low.join(sources, "object_id", "left_semi").agg(F.count("*").alias("tier2_exposed"))
    row = p.crossJoin(t).crossJoin(s)  # a row each
    share = F.coalesce(F.try_divide("tier2_exposed", "tier2_total"), F.lit(0.0))
    density = F.coalesce(F.try_divide("n", "below"), F.lit(0.0))
    short = F.when(F.col("avg_length") > 0, F.greatest(F.lit(0.0), 1 - (F.col("avg_length") - 1) / 10)).otherwise(0.0)
    raw = share * 40 + F.least(density / 10, F.lit(1.0)) * 25 + short * 20 + F.least(F.log2(F.col("n") + 1) / 15, F.lit(1.0)) * 15
    row = row.withColumn("score", F.least(F.bround(raw), F.lit(100.0)).cast("int")).withColumn("density", F.round(density, 2))
    grade = F.when(F.col("score") <= 20, "A").when(F.col("score") <= 40, "B").when(F.col("score") <= 60, "C").when(F.col("score") <= 80, "D").otherwise("F")
    return row.select("score", grade.alias("grade"), F.col("n").alias("n_paths"), "tier2_exposed", "tier2_total", "density")


def cut_order(nodes: DataFrame) -> DataFrame:
    """(src, safety): of two edges that cut as many paths, the one with the lower value goes first."""
    service = F.when(scalars.is_service_account(F.col("name"), registry.COVER_PREFIXES), 2).otherwise(0)
    return nodes.select(F.col("object_id").alias("src"), (service - F.when(~F.coalesce("enabled", F.lit(True)), 1).otherwise(0) + F.when(F.col("admin_count"), 1).otherwise(0)).alias("safety"))


def choke_points(paths: DataFrame, nodes: DataFrame, rounds: int = 5, exclude: DataFrame | None = None) -> DataFrame:
    """(rank, src, dst, edge_type, eliminated, cumulative, pct): greedy cover. Each round takes the edge on most paths that are left (ties by
    safety, then src, dst, edge_type); structure can't be cut, nor can edges in ``exclude`` (src, dst, edge_type)."""
    cuts = steps(paths).where(~F.col("edge_type").isin(registry.UNCUTTABLE)).select("path_id", "src", "dst", "edge_type").distinct()
    if exclude is not None:
        cuts = cuts.join(exclude, ["src", "dst", "edge_type"], "left_anti")
    left = materialise(cuts.join(cut_order(nodes), "src", "left").withColumn("safety", F.coalesce("safety", F.lit(0))), "cuts")
    total = paths.count()
    chosen, cumulative = [], 0
    for k in range(1, rounds + 1):
        best = left.groupBy("src", "dst", "edge_type", "safety").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "safety", "src", "dst", "edge_type").first()
        if best is None:
            break
        cumulative += best["n"]
        chosen.append((k, best["src"], best["dst"], best["edge_type"], best["n"], cumulative, round(100 * cumulative / total, 1)))
        hit = left.where((F.col("src") == best["src"]) & (F.col("dst") == best["dst"]) & (F.col("edge_type") == best["edge_type"])).select("path_id")
        left = left.join(hit, "path_id", "left_anti")
        if k % 4 == 0:
            left = materialise(left, "cuts")
    return paths.sparkSession.createDataFrame(chosen, "rank int, src string, dst string, edge_type string, eliminated long, cumulative long, pct double")


def fixes_for(choke: DataFrame, percent: float) -> DataFrame:
    """The shortest run of fixes, from the first, that reaches the percentage; all if none does."""
    before = Window.orderBy("rank")  # a row for each fix
    return choke.withColumn("prior", F.lag("pct", 1, 0.0).over(before)).where(F.col("prior") < percent).drop("prior")


def node_chokepoints(paths: DataFrame, most: int = 20) -> DataFrame:
    """(object_id, n, pct): objects inside paths (not their ends) that most paths pass."""
    total = paths.agg(F.count("*").alias("total"))
    inner = paths.where("length >= 2").select("path_id", F.explode(F.slice("nodes", 2, F.col("length") - 1)).alias("object_id"))
    counts = inner.groupBy("object_id").agg(F.count_distinct("path_id").alias("n")).orderBy(F.desc("n"), "object_id").limit(most)
    return counts.crossJoin(F.broadcast(total)).select("object_id", "n", F.round(F.col("n") * 100 / F.col("total"), 1).alias("pct"))


def blind_spots(paths: DataFrame, status: DataFrame, fixes: DataFrame, most: int = 10) -> DataFrame:
    """(source, target, chain, n): paths that no fix cuts and nothing shows, by ends and kinds of steps."""
    cut = steps(paths).join(fixes.select("src", "dst", "edge_type"), ["src", "dst", "edge_type"], "left_semi").select("path_id").distinct()
    left = paths.join(cut, "path_id", "left_anti").join(status.where("status = 'blind'"), "path_id", "left_semi")
    return left.groupBy("source", "target", F.array_join("edge_types", ">").alias("chain")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "source", "target", "chain").limit(most)


def protect_first(risk: DataFrame, nodes: DataFrame, most: int = 10) -> DataFrame:
    """(object_id, tier0_reach, path_count, risk): actors to protect first."""
    actors = nodes.where(F.col("node_type").isin(registry.ACTORS)).select("object_id")
    return risk.join(actors, "object_id", "left_semi").orderBy(F.desc("tier0_reach"), F.desc("path_count"), F.desc("risk"), "object_id").limit(most).select("object_id", "tier0_reach", "path_count", "risk")


def fix_safety(fixes: DataFrame, tiered: DataFrame) -> DataFrame:
    """``fixes`` with safety: safe, caution or dangerous, by the account that loses the right and the object."""
    src = tiered.select(F.col("object_id").alias("src"), F.col("name").alias("src_name"), F.col("enabled").alias("src_enabled"))
    dst = tiered.select(F.col("object_id").alias("dst"), ((F.col("node_type") == "Computer") & (F.col("tier") == 0)).alias("top_host"))
    upper = F.upper("src_name")
    needs = F.coalesce(((F.col("edge_type") == "DCSync") & upper.rlike("MSOL_|AZUREAD|ADCONNECT")) | ((F.col("edge_type") == "GenericAll") & upper.rlike("EXCHANGE|EXCH_")), F.lit(False))
    service = F.coalesce(scalars.is_service_account(F.col("src_name")), F.lit(False))
    level = F.when(needs, 2).when(service & F.coalesce("src_enabled", F.lit(True)), 1).otherwise(0)
    level = F.greatest(level, F.when(F.coalesce("top_host", F.lit(False)) | (F.col("edge_type") == "MemberOf"), 1).otherwise(0))
    out = fixes.join(src, "src", "left").join(dst, "dst", "left").withColumn("safety", registry.label(level + 1, ["safe", "caution", "dangerous"]))
    return out.select(*fixes.columns, "safety")


def crown_jewels(jewels: DataFrame, tiered: DataFrame, edges: DataFrame, max_depth: int = 12) -> DataFrame:
    """(jewel, value, reachers, nearest): for jewels (id, value; the highest value of an id counts), actors that reach them along walkable edges.

    Jewels onto which the same objects have edges are reached by the same, but for themselves; each class of them is searched once, and the classes' marks
    travel together.
    """
    named = jewels.groupBy("id").agg(F.max("value").alias("value"))
    hops = edges.where(~F.col("edge_type").isin(registry.NON_TRAVERSABLE)).select("src", "dst").where("src <> dst").distinct()
    actors = tiered.where(F.col("node_type").isin(registry.ACTORS)).select(F.col("object_id").alias("id")).distinct()
    onto = hops.join(shuffled(named.select(F.col("id").alias("dst"))), "dst", "left_semi").groupBy(F.col("dst").alias("id")).agg(F.array_sort(F.collect_set("src")).alias("before"))
    onto = materialise(onto, "before")
    classes = onto.groupBy("before").agg(F.min("id").alias("class"))
    classed = materialise(onto.join(classes, "before").select("id", "class"), "class-of")
    start = onto.join(classes.select(F.col("class").alias("id")), "id").select(F.col("id").alias("origin"), F.explode("before").alias("id"))
    names, found = marked(start, start, hops.select(F.col("dst").alias("src"), F.col("src").alias("dst")), max_depth - 1)
    names = names.withColumnRenamed("origin", "class")
    inside = materialise(found.join(shuffled(actors), "id", "left_semi"), "inside")
    counts = inside.groupBy("block", "depth").agg(F.array(*[F.sum(F.shiftright("marks", i).bitwiseAND(F.lit(1))) for i in range(MARKS)]).alias("counts"))
    counts = counts.select("block", "depth", F.posexplode("counts").alias("bit", "n")).where("n > 0")
    levels = names.join(counts, ["block", "bit"]).groupBy("class").agg(F.sum("n").alias("n"), F.array_sort(F.collect_list(F.struct("depth", "n"))).alias("levels"))
    # a jewel that reaches itself is no reacher of its own
    own = classed.join(names, "class").join(shuffled(inside), ["id", "block"]).where(F.expr("shiftright(marks, bit) & 1 = 1")).select("id", F.col("depth").alias("own"))
    reach = classed.join(levels, "class").join(own, "id", "left")
    left = F.filter("levels", lambda x: (x["depth"] != F.coalesce("own", F.lit(-1))) | (x["n"] > 1))
    reach = reach.select("id", (F.col("n") - F.when(F.col("own").isNull(), 0).otherwise(1)).alias("reachers"), (F.get(left, 0)["depth"] + 1).alias("nearest"))
    return named.join(reach, "id", "left").select(F.col("id").alias("jewel"), "value", F.coalesce("reachers", F.lit(0).cast("long")).alias("reachers"), "nearest")


def leaf_clusters(tiered: DataFrame, edges: DataFrame, least: int = 6) -> DataFrame:
    """(dst, edge_type, node_type, n): users and computers below tier 0 without an edge onto them and with a single edge, grouped by it."""
    onto = edges.select(F.col("dst").alias("object_id")).distinct()
    lone = edges.groupBy(F.col("src").alias("object_id")).agg(F.count("*").alias("k"), F.first("dst").alias("dst"), F.first("edge_type").alias("edge_type")).where("k = 1")
    leaves = tiered.where((F.col("tier") != 0) & F.col("node_type").isin("User", "Computer")).join(onto, "object_id", "left_anti").join(lone, "object_id")
    return leaves.groupBy("dst", "edge_type", "node_type").agg(F.count("*").alias("n")).where(F.col("n") >= least)


def residual_points(nodes: DataFrame, edges: DataFrame, paths: DataFrame, fixes: int = 5, points: int = 25) -> DataFrame:
    """``choke_points`` of what is left once the first ``fixes`` of ``paths`` are made: where to watch. Tiers and paths are found anew."""
    left = edges.join(choke_points(paths, nodes, fixes).select("src", "dst", "edge_type"), ["src", "dst", "edge_type"], "left_anti")
    return choke_points(with_ids(enumerate_paths(nodes, left, tier0(nodes, left))), nodes, points)
