"""Proposed changes: resolved, applied as deltas, compared before and after, and judged by a policy."""

from __future__ import annotations

import re
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import registry, scalars
from ..storage import materialise, shuffled
from .exposure import exposed, walkable
from .fixpoint import semi_naive
from .maintained import Kept, changes_of, update
from .tiering import tier0

#: Verbs of the change language. Verb, operation, kind of edge (empty: named in the line), least and most arguments.
VERBS = [
    ("add-member", "add", "MemberOf", 2, 2),
    ("remove-member", "remove", "MemberOf", 2, 2),
    ("local-admin", "add", "AdminTo", 2, 2),
    ("remove-local-admin", "remove", "AdminTo", 2, 2),
    ("delegate", "add", "AllowedToDelegate", 2, 2),
    ("undelegate", "remove", "AllowedToDelegate", 2, 2),
    ("rbcd", "add", "AllowedToAct", 2, 2),
    ("remove-rbcd", "remove", "AllowedToAct", 2, 2),
    ("session", "add", "HasSession", 2, 2),
    ("rdp", "add", "CanRDP", 2, 2),
    ("psremote", "add", "CanPSRemote", 2, 2),
    ("grant-dcsync", "add", "DCSync", 2, 2),
    ("revoke-dcsync", "remove", "DCSync", 2, 2),
    ("grant", "add", "", 3, 3),
    ("revoke", "remove", "", 3, 3),
    ("revoke-all", "remove", "*", 2, 2),
    ("add", "add", "", 3, 3),
    ("remove", "remove", "", 3, 3),
    ("deny", "deny", "", 3, 3),
    ("undeny", "undeny", "", 3, 3),
    ("delete", "delete", "*", 1, 1),
    ("move", "move", "Contains", 2, 2),
]
EDGE = ["src", "dst", "edge_type"]
CHANGES = "idx int, op string, src string, edge_type string, dst string, ttl_minutes int"
_PART = re.compile(r'"([^"]*)"|(\S+)')


class ChangeError(ValueError):
    """All errors of a change file, a line each."""


def parse_changes(text: str, most: int = 5000) -> list[tuple]:
    """Rows of CHANGES from lines like ``add-member alice "Help Desk" ttl=2h``; # begins a comment. ``session host user`` stores (host, user).

    Change files are small: a person's proposal, of at most ``most`` lines.
    """
    verbs = {v[0]: v for v in VERBS}
    rows, errors = [], []
    for number, line in enumerate(text.splitlines(), 1):
        parts = [a or b for a, b in _PART.findall(line.split("#")[0])]
        if not parts:
            continue
        ttl = next((p[4:] for p in parts if p.startswith("ttl=")), None)
        verb, *args = [p for p in parts if not p.startswith("ttl=")]
        if verb not in verbs:
            errors.append(f"line {number}: unknown verb {verb}")
            continue
        _, op, kind, least, most_args = verbs[verb]
        if not least <= len(args) <= most_args:
            errors.append(f"line {number}: {verb} takes {least} names, not {len(args)}")
            continue
        minutes = None
        if ttl is not None:
            found = re.fullmatch(r"(?:(\d+)d)?(?:(\d+)h)?(?:(\d+)m)?", ttl.lower())
            if not ttl or not found or not any(found.groups()):
                errors.append(f"line {number}: ttl {ttl} can't be read")
                continue
            minutes = sum(int(g or 0) * n for g, n in zip(found.groups(), (1440, 60, 1), strict=True))
        if op == "delete":
            rows.append((len(rows), op, args[0], "*", None, minutes))
        elif kind:
            rows.append((len(rows), op, args[0], kind, args[1], minutes))
        else:
            rows.append((len(rows), op, args[0], args[1], args[2], minutes))
    if len(rows) > most:
        errors.append(f"{len(rows)} changes; at most {most} are taken")
    if errors:
        raise ChangeError("\n".join(errors))
    return rows


def resolve_changes(changes: DataFrame, nodes: DataFrame) -> DataFrame:
    """``changes`` with names turned into ids: by id, then full or display name, letters of either case. Names that fit none or several raise."""
    from .tiering import resolve

    names = changes.select(F.explode(F.array("src", "dst")).alias("query")).where("query is not null").distinct()
    found = resolve(names, nodes).where("stage < 3")
    ids = found.groupBy("query").agg(F.min("object_id").alias("id"), F.count("*").alias("n"))
    wrong = [r["query"] for r in names.join(ids, "query", "left").where("n is null or n > 1").orderBy("query").collect()]  # as many as names in the change file
    if wrong:
        raise ChangeError("\n".join(f"{x}: no such object, or several" for x in wrong))
    one, two = ids.select(F.col("query").alias("src"), F.col("id").alias("s")), ids.select(F.col("query").alias("dst"), F.col("id").alias("d"))
    return changes.join(F.broadcast(one), "src", "left").join(F.broadcast(two), "dst", "left").select("idx", "op", F.col("s").alias("src"), "edge_type", F.col("d").alias("dst"), "ttl_minutes")


class Deltas(NamedTuple):
    """What a change does to a table of edges: ``removed`` are edges of it, ``added`` are none of it, so that either can be undone."""

    removed: DataFrame  #: EDGE
    added: DataFrame  #: EDGE


def deltas(edges: DataFrame, changes: DataFrame) -> Deltas:
    """The net effect of all ``changes`` (resolved) on ``edges``: removed edges go, with * all kinds but structure between the two; a deleted object loses all
    edges; a moved object leaves its containers; an added edge that is there or is removed by the same changes stays as it is."""
    rows = edges.select(*EDGE)
    named = changes.where("op = 'remove' and edge_type <> '*'").select(*EDGE)
    every = changes.where("op = 'remove' and edge_type = '*'").select("src", "dst")
    gone = changes.where("op = 'delete'").select(F.col("src").alias("x"))
    moved = changes.where("op = 'move'").select(F.col("src").alias("x"))
    new = changes.where("op = 'add'").select(*EDGE).union(changes.where("op = 'move'").select(F.col("dst").alias("src"), F.col("src").alias("dst"), F.lit("Contains"))).distinct()
    lost = (
        rows.join(named, EDGE, "left_semi")
        .union(rows.where(~F.col("edge_type").isin(registry.PLAIN_STRUCTURE)).join(every, ["src", "dst"], "left_semi").select(*EDGE))
        .union(rows.join(gone, F.col("src") == F.col("x"), "left_semi"))
        .union(rows.join(gone, F.col("dst") == F.col("x"), "left_semi"))
        .union(rows.where("edge_type = 'Contains'").join(moved, F.col("dst") == F.col("x"), "left_semi"))
    )
    return Deltas(lost.distinct().join(new, EDGE, "left_anti"), new.join(rows, EDGE, "left_anti"))


def applied(edges: DataFrame, change: Deltas) -> DataFrame:
    """``edges`` (a set of EDGE) after a change."""
    return edges.select(*EDGE).distinct().join(shuffled(change.removed), EDGE, "left_anti").union(change.added)


def undone(edges: DataFrame, change: Deltas) -> DataFrame:
    """``edges`` before a change that was applied to them."""
    return applied(edges, Deltas(change.added, change.removed))


def apply_changes(edges: DataFrame, changes: DataFrame) -> DataFrame:
    """``edges`` (src, dst, edge_type) after all ``changes`` (resolved), each edge once."""
    return applied(edges, deltas(edges, changes))


def logged(version: int, change: Deltas) -> DataFrame:
    """(version, EDGE, present): a change as rows of a log; versions count from 1."""
    rows = lambda df, there: df.select(F.lit(version).alias("version"), *EDGE, F.lit(there).alias("present"))
    return rows(change.removed, False).union(rows(change.added, True))


def edges_at(base: DataFrame, log: DataFrame, version: int) -> DataFrame:
    """The edges as of a version (0: ``base``): for each edge that the log names up to then its last entry holds. The base is read once, whatever the version."""
    last = log.where(F.col("version") <= version).groupBy(*EDGE).agg(F.max_by("present", "version").alias("present"))
    return base.select(*EDGE).distinct().join(last, EDGE, "left_anti").union(last.where("present").select(*EDGE))


class Impact(NamedTuple):
    exposure: DataFrame  #: id, hops_before, hops_after, effect
    tiers: DataFrame  #: id, effect: promoted or demoted


def impact(nodes: DataFrame, before: DataFrame, after: DataFrame) -> Impact:
    """Exposure and tier 0 before and after: newly exposed, secured, shortened and lengthened objects; promoted and demoted ones."""
    top_b, top_a = tier0(nodes, before), tier0(nodes, after)
    b, a = exposed(before, top_b).withColumnRenamed("hops", "hops_before"), exposed(after, top_a).withColumnRenamed("hops", "hops_after")
    rows = _effects(b.join(a, "id", "full"))
    tiers = top_a.join(top_b, "id", "left_anti").select("id", F.lit("promoted").alias("effect")).union(top_b.join(top_a, "id", "left_anti").select("id", F.lit("demoted")))
    return Impact(rows, tiers)


def _effects(rows: DataFrame) -> DataFrame:
    effect = (
        F.when(F.col("hops_before").isNull(), "new_exposure")
        .when(F.col("hops_after").isNull(), "secured")
        .when(F.col("hops_after") < F.col("hops_before"), "shortened")
        .when(F.col("hops_after") > F.col("hops_before"), "lengthened")
    )
    return rows.withColumn("effect", effect).where("effect is not null").select("id", "hops_before", "hops_after", "effect")


class Forecast(NamedTuple):
    impact: Impact
    kept: Kept  #: states after the changes
    edges: DataFrame
    top: DataFrame


def forecast(nodes: DataFrame, edges: DataFrame, kept: Kept, top: DataFrame, changes: DataFrame) -> Forecast:
    """As ``impact``, from the states kept of ``edges`` and ``top``: only what the changes touch is searched again, and tier 0 only if memberships change."""
    d = deltas(edges, changes)
    d = Deltas(materialise(d.removed, "removed"), materialise(d.added, "added"))
    after = applied(edges, d)
    member = F.col("edge_type") == "MemberOf"
    none = top.select("id").limit(0)
    top_after, up, down = top, none, none
    if not d.removed.where(member).union(d.added.where(member)).isEmpty():
        top_after = materialise(tier0(nodes, after), "top")
        up, down = top_after.join(top, "id", "left_anti"), top.join(top_after, "id", "left_anti")
    new = update(kept, after, top_after, d.removed, d.added, up, down)
    tiers = up.select("id", F.lit("promoted").alias("effect")).union(down.select("id", F.lit("demoted")))
    return Forecast(Impact(_effects(changes_of(kept, new, top, top_after)), tiers), new, after, top_after)


def combined_effects(edges: DataFrame, top: DataFrame, kept: Kept, added: DataFrame, sets: int = 32, most: int = 8, max_rounds: int = 100) -> DataFrame:
    """(id, needs, unknown): for each object that ``added`` (idx, EDGE) exposes, the least sets of changes that suffice, and so none of which can be left out.
    ``edges`` and ``kept`` are those before the additions. An object is exposed by a combination alone if each of its sets has two or more.

    A state carries the set of changes on its route. States that the graph has anyway need none, so only new ones are searched; of a state's sets those that
    contain another one are dropped. unknown is true where a state had more than ``sets`` sets or one of more than ``most`` changes: there could be others.
    """
    state = ["id", "attacked"]
    known = kept.table().select(*state)
    attack = F.col("edge_type").isin(registry.ATTACK)
    usable = lambda rows: rows.where(~F.col("edge_type").isin(registry.NON_TRAVERSABLE)).join(top.select(F.col("id").alias("src")), "src", "left_anti")
    new = materialise(usable(added).select("idx", "src", F.col("dst").alias("id"), attack.alias("attack")), "additions")
    old = materialise(walkable(edges, top).select("src", F.col("dst").alias("id"), "attack").distinct(), "hops")
    landed = (F.col("attacked") | F.col("attack")).alias("attacked")
    inside = lambda x, y: F.size(F.array_except(x, y)) == 0
    least = lambda xs: F.filter(xs, lambda x: ~F.exists(xs, lambda y: inside(y, x) & (F.size(y) < F.size(x))))

    def gathered(rows: DataFrame) -> DataFrame:
        """A row for each state: its least sets, the smallest first, as many as ``sets``."""
        own = rows.groupBy(*state).agg(F.collect_set("needs").alias("xs"), F.max("unknown").alias("unknown"))
        ordered = F.array_sort(F.transform(least("xs"), lambda x: F.struct(F.size(x).alias("n"), x.alias("x"))))
        own = own.withColumn("ys", F.transform(ordered, lambda p: p["x"])).withColumn("unknown", F.col("unknown") | (F.size("ys") > sets))
        return own.select(*state, F.slice("ys", 1, sets).alias("xs"), "unknown")

    first = new.join(known, "id").select(F.col("src").alias("id"), landed, F.array("idx").alias("needs"), F.lit(False).alias("unknown"))
    front = materialise(gathered(first.join(known, state, "left_anti")), "needs")
    total = front
    for _ in range(max_rounds):
        if front.isEmpty():
            break
        each = front.select(*state, F.explode("xs").alias("needs"), "unknown")
        back = each.join(old, "id").select(F.col("src").alias("id"), landed, "needs", "unknown")
        grown = each.join(new, "id").select(F.col("src").alias("id"), landed, F.array_sort(F.array_union("needs", F.array("idx"))).alias("needs"), "unknown")
        grown = grown.withColumn("unknown", F.col("unknown") | (F.size("needs") > most)).withColumn("needs", F.slice("needs", 1, most))
        found = gathered(back.union(grown).join(known, state, "left_anti"))
        before = total.select(*state, F.col("xs").alias("had"), F.col("unknown").alias("was"))
        found = found.join(before, state, "left")
        kept_sets = F.filter("xs", lambda x: F.col("had").isNull() | ~F.exists("had", lambda y: inside(y, x)))
        front = materialise(found.withColumn("xs", kept_sets).where((F.size("xs") > 0) | (F.col("unknown") & ~F.coalesce("was", F.lit(False)))).select(*state, "xs", "unknown"), "needs")
        total = materialise(gathered(total.union(front).select(*state, F.explode_outer("xs").alias("needs"), "unknown").withColumn("needs", F.coalesce("needs", F.array().cast("array<int>")))).withColumn("xs", F.filter("xs", lambda x: F.size(x) > 0)), "needs")
    else:
        raise RuntimeError(f"sets of changes did not settle in {max_rounds} rounds")
    return total.where("attacked").join(top.select("id"), "id", "left_anti").select("id", F.col("xs").alias("needs"), "unknown")


def scenario_exposure(edges: DataFrame, top: DataFrame, removed: DataFrame, added: DataFrame) -> DataFrame:
    """(scenario, id, hops): exposure in each scenario, all in one search. top: scenario, id; removed, added: scenario, src, dst, edge_type.

    The edges are shared: a scenario costs its own deltas and the states that it reaches.
    """
    columns = ["src", "dst", "edge_type"]
    kept = edges.where(~F.col("edge_type").isin(registry.NON_TRAVERSABLE)).select(*columns).persist()
    new_edges = added.where(~F.col("edge_type").isin(registry.NON_TRAVERSABLE)).select("scenario", *columns)
    attack = F.col("attacked") | F.col("edge_type").isin(registry.ATTACK)
    ends = top.select("scenario", F.col("id").alias("src"))

    def step(new: DataFrame) -> DataFrame:
        from_base = new.join(kept, new["id"] == kept["dst"]).join(removed.select("scenario", *columns), ["scenario", *columns], "left_anti")
        from_new = new.join(new_edges.select(F.col("scenario").alias("s"), *columns), (F.col("id") == F.col("dst")) & (F.col("scenario") == F.col("s")))
        both = from_base.select("scenario", "src", attack.alias("attacked")).union(from_new.select("scenario", "src", attack))
        return both.join(ends, ["scenario", "src"], "left_anti").select("scenario", F.col("src").alias("id"), "attacked")

    found = semi_naive(top.select("scenario", "id", F.lit(False).alias("attacked")), step, ["scenario", "id", "attacked"])
    kept.unpersist()
    return found.where("attacked").select("scenario", "id", F.col("depth").alias("hops")).join(top, ["scenario", "id"], "left_anti")


def marginal(edges: DataFrame, top: DataFrame, changes: DataFrame) -> DataFrame:
    """(idx, new_exposure, secured): what each added or removed edge of ``changes`` (resolved) does alone, in objects. Tier 0 is taken as it is."""
    spark = edges.sparkSession
    one = changes.where(F.col("op").isin("add", "remove")).select(F.col("idx").alias("scenario"), "op", "src", "dst", "edge_type")
    scenarios = one.select("scenario").union(spark.createDataFrame([(-1,)], "scenario int")).distinct()
    tops = scenarios.crossJoin(top.select("id"))  # change files are small, and so is tier 0 times their lines
    found = scenario_exposure(edges, tops, one.where("op = 'remove'"), one.where("op = 'add'"))
    base = found.where("scenario = -1").select("id", F.lit(True).alias("was"))
    now = found.where("scenario <> -1").select("scenario", "id", F.lit(True).alias("now"))
    new = now.join(base, "id", "left_anti").groupBy("scenario").agg(F.count("*").alias("new_exposure"))
    # secured: exposed before, and not among those still exposed
    still = now.join(base, "id", "left_semi").groupBy("scenario").agg(F.count("*").alias("still"))
    total = base.agg(F.count("*").alias("total"))  # one row
    rows = one.select("scenario").join(new, "scenario", "left").join(still, "scenario", "left").crossJoin(total)
    return rows.select(F.col("scenario").alias("idx"), F.coalesce("new_exposure", F.lit(0)).alias("new_exposure"), (F.col("total") - F.coalesce("still", F.lit(0))).alias("secured"))


def judged(findings: DataFrame, nodes: DataFrame, waivers: DataFrame, block_at: str = "critical", review_at: str = "medium", today: str | None = None) -> DataFrame:
    """(effect, severity, actors, waived, verdict): of an impact's exposure rows by effect. waivers: effect, pattern (glob on names), expires;
    a group is waived if live waivers cover all its objects. Verdicts: block, review, pass."""
    rows = findings.join(nodes.select(F.col("object_id").alias("id"), "name", "node_type", "enabled"), "id", "left")
    live = waivers.where(F.col("expires").isNull() | (F.col("expires") >= (F.lit(today).cast("date") if today else F.current_date())))
    live = live.select(F.col("effect").alias("e"), scalars.glob_to_regex(F.col("pattern")).alias("p"))
    covered = rows.join(live, (F.col("effect") == F.col("e")) & F.expr("name rlike p")).select("id", "effect").distinct().withColumn("w", F.lit(True))
    rows = rows.join(covered, ["id", "effect"], "left")
    actor = F.col("node_type").isin(registry.ACTORS)
    groups = rows.groupBy("effect").agg(
        F.count(F.when(actor, 1)).alias("actors"),
        F.min("hops_after").alias("hops"),
        F.coalesce(F.bool_and(F.when(actor, ~F.coalesce("enabled", F.lit(True)))), F.lit(False)).alias("disabled"),
        F.bool_and(F.coalesce("w", F.lit(False))).alias("waived"),
    )
    risky = F.col("effect").isin("new_exposure", "shortened")
    level = F.when(risky, scalars.exposure_severity(F.col("actors"), F.col("hops"), F.col("disabled"))).otherwise(1)
    at = lambda x: registry.SEVERITIES.index(x) + 1
    verdict = F.when(~risky | F.col("waived"), "pass").when(level >= at(block_at), "block").when(level >= at(review_at), "review").otherwise("pass")
    return groups.select("effect", registry.label(level, registry.SEVERITIES).alias("severity"), "actors", "waived", verdict.alias("verdict"))


def path_edge_diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """(src, dst, edge_type, change): edges on attack paths that came or went (before, after: steps of paths)."""
    b, a = (x.select("src", "dst", "edge_type").distinct() for x in (before, after))
    return a.exceptAll(b).withColumn("change", F.lit("added")).union(b.exceptAll(a).withColumn("change", F.lit("removed")))
