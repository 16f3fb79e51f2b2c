"""Sign-in policies of a cloud tenant: which privileged users a policy that demands a second factor covers.

A policy applies to a user that its includes name (the user, a group or role above, or all) unless its excludes name the user. A policy that other
conditions narrow doesn't count as cover.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import registry
from .fixpoint import closure

LISTS = ["includeUsers", "includeGroups", "includeRoles", "excludeUsers", "excludeGroups", "excludeRoles"]
LEGACY = ["exchangeactivesync", "other"]


def policies(objects: DataFrame) -> DataFrame:
    """policy, name, state, demands (a second factor, for all applications), blocks, narrowed, legacy, includes, excludes of the objects (o) that are policies.

    Ids are upper case; ``ALL`` stands for every user. Keys may be written in either case of their first letter.
    """

    def get(path: str, kind: str):
        words = path.split(".")
        pascal = ".".join(w[0].upper() + w[1:] for w in words)
        return F.coalesce(F.try_variant_get("o", f"$.{path}", kind), F.try_variant_get("o", f"$.{pascal}", kind))

    texts = lambda path: F.transform(F.coalesce(get(path, "array<string>"), F.array().cast("array<string>")), F.upper)
    there = lambda path: F.coalesce(F.size(get(path, "array<variant>")), F.lit(-1)) > 0
    controls, apps, clients, places = texts("grantControls.builtInControls"), texts("conditions.applications.includeApplications"), texts("conditions.clientAppTypes"), texts("conditions.locations.includeLocations")
    alone = (F.upper(F.coalesce(get("grantControls.operator", "string"), F.lit("OR"))) == "AND") | (F.size(controls) == 1)
    given = lambda path: get(path, "variant").isNotNull() & ~F.is_variant_null(get(path, "variant"))
    factor = given("grantControls.authenticationStrength") | (F.array_contains(controls, "MFA") & alone)
    narrow = reduce(lambda a, b: a | b, [there(f"conditions.{c}") for c in ("signInRiskLevels", "userRiskLevels", "servicePrincipalRiskLevels")])
    narrow = narrow | reduce(lambda a, b: a | b, [given(f"conditions.{c}") for c in ("platforms", "devices")]) | ((F.size(places) > 0) & ~F.array_contains(places, "ALL"))
    rows = objects.where(get("conditions", "variant").isNotNull() & get("grantControls", "variant").isNotNull())
    return rows.select(
        get("id", "string").alias("policy"),
        F.coalesce(get("displayName", "string"), get("id", "string")).alias("name"),
        F.coalesce(get("state", "string"), F.lit("disabled")).alias("state"),
        (factor & F.array_contains(apps, "ALL") & ~there("conditions.applications.excludeApplications")).alias("demands"),
        F.array_contains(controls, "BLOCK").alias("blocks"),
        narrow.alias("narrowed"),
        (F.size(F.array_intersect(F.transform(clients, F.lower), F.array(*[F.lit(x) for x in LEGACY]))) == len(LEGACY)).alias("legacy"),
        F.concat(*[texts(f"conditions.users.{x}") for x in LISTS[:3]]).alias("includes"),
        F.concat(*[texts(f"conditions.users.{x}") for x in LISTS[3:]]).alias("excludes"),
    )


def privileged(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(user, id): cloud users that hold or may activate a tier-0 role, with the ids of themselves and of all groups and roles above."""
    users = nodes.where("node_type = 'AZUser'").select(F.col("object_id").alias("origin"), F.col("object_id").alias("id"))
    above = closure(users, edges.where("edge_type = 'MemberOf'")).select(F.col("origin").alias("user"), "id")
    may = edges.where("edge_type = 'AZEligibleRole'").select(F.col("src").alias("user"), F.col("dst").alias("id")).join(users.select(F.col("id").alias("user")), "user", "left_semi")
    high = above.union(may).where(F.upper("id").isin(registry.TIER0_CLOUD_ROLES)).select("user").distinct()
    return above.join(high, "user", "left_semi").select("user", F.upper("id").alias("id"))


def applies(rules: DataFrame, people: DataFrame) -> DataFrame:
    """(policy, user) where a policy applies; people: as ``privileged``."""
    named = lambda column: rules.select("policy", F.explode(column).alias("id")).join(people, "id").select("policy", "user")
    everyone = rules.where(F.array_contains("includes", "ALL")).select("policy").crossJoin(people.select("user").distinct())  # policies are some dozens
    return named("includes").union(everyone).distinct().join(named("excludes"), ["policy", "user"], "left_anti")


def gaps(nodes: DataFrame, edges: DataFrame, rules: DataFrame) -> DataFrame:
    """(finding, object_id, name): users without cover, users that a policy for all leaves out, users that only a policy in report mode covers, and
    legacy sign-in that isn't blocked for all."""
    people = privileged(nodes, edges).persist()
    users = people.select("user").distinct()
    demands = rules.where("demands")
    on = F.col("state") == "enabled"
    covered = applies(demands.where(on & ~F.col("narrowed")), people).select("user").distinct()
    bare = users.join(covered, "user", "left_anti")
    count = users.agg(F.count("*").alias("all")).crossJoin(bare.agg(F.count("*").alias("bare")))  # one row
    found = bare.crossJoin(count).select(F.when(F.col("all") == F.col("bare"), "ca-no-admin-mfa").otherwise("ca-admin-uncovered").alias("finding"), F.col("user").alias("object_id"))
    reported = applies(demands.where("state = 'enabledForReportingButNotEnforced'"), people).select("user").distinct()
    found = found.union(bare.join(reported, "user", "left_semi").select(F.lit("ca-report-only"), "user"))
    broad = demands.where(on & F.array_contains("includes", "ALL"))
    out = users.crossJoin(broad.select("policy")).join(applies(broad, people), ["policy", "user"], "left_anti")
    found = found.union(out.select(F.lit("ca-admin-excluded"), "user").distinct())
    found = found.join(nodes.select("object_id", "name"), "object_id", "left").select("finding", "object_id", F.coalesce("name", "object_id").alias("name"))
    legacy = rules.where(on & F.col("blocks") & F.col("legacy"))
    whole = legacy.agg(F.coalesce(F.bool_or(F.array_contains("includes", "ALL")), F.lit(False)).alias("whole"), F.coalesce(F.array_join(F.array_sort(F.collect_set("name")), ", "), F.lit("")).alias("some"))  # one row
    return found.union(whole.where("not whole").select(F.lit("ca-legacy-auth"), F.lit("tenant"), F.when(F.col("some") != "", F.concat(F.lit("only in part: "), "some")).otherwise("tenant")))
