"""What a policy makes of an impact's findings: lifetimes and declared controls that lower severities, waivers, limits, a verdict.

findings: finding_id, kind, severity (rank, 1 info to 5 critical), changes (array of idx), superseded. changes: idx, source, edge, target (names), ttl_minutes.
rules (waivers and controls): rule_id, place (their order in the policy), source, edge, target (globs), kinds (array; * for all), expires, and steps for controls.
Policies and change files are a person's; findings are many, and all of this is joins and one aggregate for each finding.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import registry, scalars

#: Findings that aren't judged by severity.
APART = ["RISK_REDUCTION", "NOOP", "NOTE", "UNMODELED"]
#: Findings whose severity stays at medium at least.
GRAVE = ["TIER0_PROMOTION", "COMBINED_EFFECT"]
LOW, MEDIUM = registry.SEVERITIES.index("low") + 1, registry.SEVERITIES.index("medium") + 1


def _expired(today: Column) -> Column:
    return F.col("expires").isNotNull() & (F.col("expires") < today)


def matches(rules: DataFrame, findings: DataFrame, changes: DataFrame, today: Column) -> DataFrame:
    """(finding_id, idx, rules): for each change of each finding the rules that it meets, an array of (live, rank, place, rule_id, steps, expires) with the one that
    counts first: live ones before expired ones, of live ones those of more steps, then the policy's order."""
    glob = lambda c: scalars.glob_to_regex(F.col(c))
    given = rules.select("rule_id", "place", "kinds", "steps", "expires", ~_expired(today), *[glob(c) for c in ("source", "edge", "target")]).toDF("rule_id", "place", "kinds", "steps", "expires", "live", "s", "e", "t")
    fits = F.expr("source rlike s") & F.expr("edge rlike e") & F.expr("target rlike t")
    each = findings.select("finding_id", "kind", F.explode("changes").alias("idx")).join(changes, "idx")
    met = each.select("finding_id", "idx", "kind", *[F.coalesce(c, F.lit("")).alias(c) for c in ("source", "edge", "target")]).crossJoin(given)  # lines of a policy
    met = met.where(fits & (F.array_contains("kinds", "*") | F.array_contains("kinds", F.col("kind"))))
    order = F.struct((~F.col("live")).alias("after"), F.when(F.col("live"), -F.col("steps")).otherwise(0).alias("rank"), "place", "rule_id", "steps", "expires")
    return met.groupBy("finding_id", "idx").agg(F.array_sort(F.collect_list(order)).alias("rules"))


def lowered(severity: Column, kind: Column, steps: Column) -> Column:
    """A severity less so many steps, not below low, for some kinds not below medium; it never rises."""
    floor = F.when(kind.isin(GRAVE), MEDIUM).otherwise(LOW)
    return F.least(severity, F.greatest(severity - steps, floor))


def softened(findings: DataFrame, changes: DataFrame, controls: DataFrame, today: Column, jit_minutes: int | None = None) -> DataFrame:
    """``findings`` with original (severity before), temporary (minutes, if all its changes end by themselves), control and control_status.

    Rights that last at most ``jit_minutes`` lower a finding by one. A control must be live for each change; each change counts its best one, and the
    finding falls by the least of those. If a change meets expired controls only, the first of these is named and nothing falls. Lowered findings stay."""
    each = findings.where(~F.coalesce("superseded", F.lit(False)) & ~F.col("kind").isin(APART)).select("finding_id", "kind", F.posexplode("changes").alias("at", "idx"))
    met = each.join(changes.select("idx", "ttl_minutes"), "idx", "left").join(matches(controls, findings, changes, today), ["finding_id", "idx"], "left")
    met = met.join(changes.select("idx", F.lit(True).alias("known")), "idx", "left")
    row = F.struct("at", F.coalesce("ttl_minutes", F.lit(0)).alias("ttl"), "rules", F.coalesce("known", F.lit(False)).alias("known"))
    folded = met.groupBy("finding_id").agg(F.array_sort(F.collect_list(row)).alias("x"))
    first = lambda r: F.get(r["rules"], 0)
    live = lambda r: F.coalesce(~first(r)["after"], F.lit(False))
    bare = F.get(F.filter("x", lambda r: ~live(r)), 0)  # the first change without a live control
    folded = folded.select(
        "finding_id",
        F.forall("x", lambda r: r["known"]).alias("known"),
        F.when(F.forall("x", lambda r: r["ttl"] > 0), F.array_max(F.transform("x", lambda r: r["ttl"]))).alias("temporary"),
        F.when(F.forall("x", live), F.array_min(F.transform("x", lambda r: first(r)["steps"]))).alias("steps"),
        F.when(F.forall("x", live), first(F.get("x", 0))["rule_id"]).alias("control"),
        F.when(~F.forall("x", live), first(bare)["rule_id"]).alias("expired"),
    ).where("known")
    out = findings.join(folded, "finding_id", "left")
    jit = F.coalesce(F.col("temporary") <= jit_minutes, F.lit(False)).cast("int") if jit_minutes is not None else F.lit(0)
    less = lowered(lowered(F.col("severity"), F.col("kind"), jit), F.col("kind"), F.coalesce("steps", F.lit(0)))
    named = F.coalesce("control", "expired")
    status = F.when(F.col("control").isNotNull(), "applied").when(F.col("expired").isNotNull(), "expired")
    return out.select(*[c for c in findings.columns if c != "severity"], F.col("severity").alias("original"), less.alias("severity"), "temporary", named.alias("control"), status.alias("control_status"))


def waived(findings: DataFrame, changes: DataFrame, waivers: DataFrame, today: Column) -> DataFrame:
    """``findings`` with waiver and waiver_status: applied if each change meets a live waiver (the first change's is named), expired if the first change
    without one meets an expired one."""
    met = findings.select("finding_id", F.posexplode("changes").alias("at", "idx")).join(matches(waivers.withColumn("steps", F.lit(0)), findings, changes, today), ["finding_id", "idx"], "left")
    folded = met.groupBy("finding_id").agg(F.array_sort(F.collect_list(F.struct("at", "rules"))).alias("x"))
    first = lambda r: F.get(r["rules"], 0)
    live = lambda r: F.coalesce(~first(r)["after"], F.lit(False))
    bare = F.get(F.filter("x", lambda r: ~live(r)), 0)
    folded = folded.select("finding_id", F.forall("x", live).alias("all"), first(F.get("x", 0))["rule_id"].alias("one"), first(bare)["rule_id"].alias("other"))
    rows = findings.join(folded, "finding_id", "left")
    status = F.when(F.col("all"), "applied").when(F.col("other").isNotNull(), "expired")
    return rows.select(*findings.columns, F.when(F.col("all"), F.col("one")).otherwise(F.col("other")).alias("waiver"), status.alias("waiver_status"))


def decided(findings: DataFrame, block_at: str = "high", review_at: str = "medium", block_kinds: tuple[str, ...] = ("TIER0_PROMOTION", "NEW_EXPOSURE", "COMBINED_EFFECT")) -> DataFrame:
    """``findings`` (softened and waived) with decision: block, review, waived or ok."""
    at = lambda x: registry.SEVERITIES.index(x) + 1
    gated = F.col("kind").isin(list(block_kinds)) & (F.col("severity") >= at(block_at))
    decision = (
        F.when(F.coalesce("superseded", F.lit(False)) | (F.col("kind") == "RISK_REDUCTION"), "ok")
        .when(~gated & (F.col("severity") < at(review_at)), "ok")
        .when(F.coalesce(F.col("waiver_status") == "applied", F.lit(False)), "waived")
        .when(gated, "block")
        .otherwise("review")
    )
    return findings.withColumn("decision", decision)


def violations(findings: DataFrame, exposed_actors: DataFrame, baseline_age: int | None, max_actors: int | None = None, max_age: int | None = None) -> DataFrame:
    """(rule, rule_id, n, blocking): limits that an impact passes. findings: ``decided``; exposed_actors: finding_id, id (newly exposed users and computers); those of
    waived findings don't count. Expired waivers and controls are told, too."""
    spark = findings.sparkSession
    told = lambda rule, n, blocking: F.struct(F.lit(rule).alias("rule"), F.lit(None).cast("string").alias("rule_id"), n.cast("long").alias("n"), F.lit(blocking).alias("blocking"))
    pardoned = exposed_actors.join(findings.where("decision = 'waived'").select("finding_id"), "finding_id", "left_semi").select("id")
    left = exposed_actors.select("id").distinct().join(pardoned, "id", "left_anti").agg(F.count("*").alias("n"))
    out = left.where(F.lit(max_actors is not None) & (F.col("n") > (max_actors or 0))).select(told("max_new_exposed_actors", F.col("n"), True).alias("x")).select("x.*")
    if max_age is not None and baseline_age is not None and baseline_age > max_age:
        out = out.union(spark.range(1).select(told("max_baseline_age_days", F.lit(baseline_age), False).alias("x")).select("x.*"))
    for kind in ("waiver", "control"):
        old = findings.where(F.col(f"{kind}_status") == "expired").groupBy(F.col(kind).alias("rule_id")).agg(F.count("*").alias("n"))
        out = out.union(old.select(F.lit(f"expired_{kind}"), "rule_id", "n", F.lit(False)))
    return out


def telemetry_plan(paths: DataFrame, telemetry: list[str]) -> DataFrame:
    """(rank, telemetry, paths): sources of telemetry to switch on, in order: each time the one that makes most blind paths visible, alone, with what is on by
    then (ties: the better quality in sum, then the last by name). paths: edge_types.

    Paths that show the same kinds of steps are one row with a count; a round is one aggregate over these rows."""
    spark = paths.sparkSession
    shows = F.array_sort(F.array_distinct(F.filter("edge_types", lambda e: ~e.isin(registry.UNCUTTABLE))))
    left = paths.groupBy(shows.alias("kinds")).agg(F.count("*").alias("n"))
    own = registry.observable_dim(spark)
    other = spark.createDataFrame([registry.FALLBACK_TELEMETRY], "needs string, quality string").select(F.split("needs", r"\+").alias("needs"), registry.rank("quality", registry.CONFIDENCES).alias("quality"))
    options = own.groupBy("edge_type").agg(F.collect_list(F.struct("needs", "quality")).alias("options"))
    # what each row could be seen by
    each = left.select("kinds", "n", F.explode("kinds").alias("edge_type")).join(F.broadcast(options), "edge_type", "left").crossJoin(F.broadcast(other.select(F.array(F.struct("needs", "quality")).alias("fallback"))))
    rows = each.groupBy("kinds", "n").agg(F.flatten(F.collect_list(F.coalesce("options", "fallback"))).alias("options"))
    on, chosen = list(telemetry), []
    rows = rows.persist()
    try:
        while True:
            have = F.array(*[F.lit(t) for t in on]).cast("array<string>")
            blind = rows.where(F.forall("options", lambda o: F.size(F.array_except(o["needs"], have)) > 0))  # noqa: B023
            wanted = blind.select("n", "kinds", F.explode("options").alias("o")).withColumn("missing", F.array_except("o.needs", have)).where(F.size("missing") == 1)
            best = wanted.groupBy("kinds", "n", F.get("missing", 0).alias("telemetry")).agg(F.max("o.quality").alias("q"))
            gain = best.groupBy("telemetry").agg(F.sum("n").alias("paths"), F.sum(F.col("n") * F.col("q")).alias("quality")).orderBy(F.desc("paths"), F.desc("quality"), F.desc("telemetry")).first()
            if gain is None:
                break
            on.append(gain["telemetry"])
            chosen.append((len(chosen) + 1, gain["telemetry"], gain["paths"]))
    finally:
        rows.unpersist()
    return spark.createDataFrame(chosen, "rank int, telemetry string, paths long")


def rules_to_write(covered: DataFrame) -> DataFrame:
    """(edge_type, steps): kinds of steps that can be seen but that no rule detects. covered: ``paths.coverage``."""
    return covered.where("status = 1").groupBy("edge_type").agg(F.count("*").alias("steps"))
