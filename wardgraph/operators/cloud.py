"""Cloud edges that need every file: role grants, applications, synchronised accounts, application permissions, role fan-out.

An edge onto a victim is only added where the victim leads on: it has an edge of ONWARD or holds an application permission. That is asked of
the edges as they are before any fan-out, so the answer doesn't depend on an order.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import registry
from ..storage import materialise

#: Roles that reset passwords and roles that add secrets, whatever actions were collected of them.
RESET_ROLES = ["729827E3-9C14-49F7-BB1B-9608F156BBB8", "FE930BE7-5E62-47DB-91AF-98C3A49A38B1", "966707D0-3269-4727-9BE2-8C3A10F19B9D", "C4E39BD9-1100-46D3-8C65-FB160DA0071F"]
SECRET_ROLES = ["9B895D92-2CD3-44C7-9D02-A6AC2D5EA5C3", "158C047A-C907-4556-B7EF-446551A6B5F7"]
GLOBAL_ADMINISTRATOR = "62E90394-69F5-4237-9190-012177145E10"
DEFAULT_ROLES = ["USER", "GUEST USER", "RESTRICTED GUEST USER"]
ONWARD = ["AZAuthenticatesTo", "AZMGGrantRole", "AZMGAddSecret", "AZMGAddMember", "AZMGResetPassword", "AZOwns", "AZRunsAs", "AZEligibleRole", "AZResetPassword", "AZAddSecret", "SyncedTo", "MemberOf"]
EDGE = ["src", "dst", "edge_type"]


def capabilities(nodes: DataFrame) -> DataFrame:
    """(role, cap): what roles can do: reset, secret; known roles by id, others by their actions. Tier-0 and default roles have none."""
    roles = nodes.where("node_type = 'AZRole'")
    by_id = roles.select(F.col("object_id").alias("role"), F.when(F.col("object_id").isin(RESET_ROLES), "reset").when(F.col("object_id").isin(SECRET_ROLES), "secret").alias("cap")).where("cap is not null")
    custom = roles.where(~F.col("object_id").isin(registry.TIER0_CLOUD_ROLES) & ~F.upper("name").isin(DEFAULT_ROLES)).select(F.col("object_id").alias("role"), F.explode("caps").alias("cap"))
    return by_id.union(custom.where("cap in ('reset', 'secret')")).distinct()


def linked(nodes: DataFrame, edges: DataFrame, grants: DataFrame, credentials: DataFrame, collected: DataFrame) -> DataFrame:
    """EDGE of grants for the whole tenant, applications and their principals, federated credentials, and synchronised accounts (collected: id of
    the directory's objects). A role that can't be scoped is granted as a whole whatever its scope says."""
    scoped = grants.join(capabilities(nodes).select("role").distinct().withColumn("may", F.lit(True)), "role", "left").where(F.col("may") & (F.col("scope") != "/"))
    whole = grants.join(scoped.select(*grants.columns), grants.columns, "left_anti")
    granted = whole.select(F.col("who").alias("src"), F.col("role").alias("dst"), F.when(F.col("eligible"), "AZEligibleRole").otherwise("MemberOf").alias("edge_type"))
    apps = nodes.where("node_type = 'AZApp' and app_id is not null").select("app_id", F.col("object_id").alias("app"))
    principals = nodes.where("node_type = 'AZServicePrincipal' and app_id is not null").select("app_id", F.col("object_id").alias("principal"))
    runs = apps.join(principals, "app_id").select("app", "principal", F.lit("AZRunsAs"))
    # a credential leads to the application, or to the principal where the application wasn't collected
    to = credentials.join(apps, "app_id", "left").join(principals, "app_id", "left").select("credential", F.coalesce("app", "principal").alias("dst"), F.lit("AZAuthenticatesTo"))
    synced = nodes.where("node_type = 'AZUser' and on_premises_id is not null and coalesce(synced, true)").select(F.col("on_premises_id").alias("id"), "object_id").join(collected.select("id"), "id", "left_semi").select("id", "object_id", F.lit("SyncedTo"))
    return reduce(DataFrame.union, [granted, runs, to, synced]).where("src is not null and dst is not null and src <> dst").distinct().join(edges, EDGE, "left_anti")


def fan_out(nodes: DataFrame, edges: DataFrame, grants: DataFrame, permissions: DataFrame, units: DataFrame) -> DataFrame:
    """EDGE of application permissions and of roles onto the objects they can change; a role scoped to a unit or an object reaches just that.

    Holders and roles are few; victims may be many, and each pair is an edge of the result. Holders are broadcast only below Spark's threshold.
    """
    typed = nodes.select(F.col("object_id").alias("id"), "node_type", F.coalesce("assignable", F.lit(False)).alias("assignable"))
    leads = edges.where(F.col("edge_type").isin(ONWARD)).select(F.col("src").alias("id")).union(permissions.select("who")).distinct()
    high = edges.where("edge_type = 'MemberOf'").where(F.col("dst").isin(registry.TIER0_CLOUD_ROLES)).select(F.col("src").alias("id")).distinct()
    onward = typed.join(leads, "id", "left_semi")
    victims = onward.where("node_type = 'AZUser'").join(high, "id", "left_anti").select("id", F.lit("reset").alias("what"))
    victims = victims.union(onward.where("node_type in ('AZApp', 'AZServicePrincipal')").select("id", F.lit("secret")))
    victims = materialise(victims.union(onward.where("node_type = 'AZGroup' and not assignable").select("id", F.lit("member"))), "victims")
    made = F.create_map(*[F.lit(x) for x in ("reset", "AZMGResetPassword", "secret", "AZMGAddSecret", "member", "AZMGAddMember")])
    by_permission = permissions.where("allows <> 'grant'").join(victims, F.col("allows") == F.col("what")).select(F.col("who").alias("src"), F.col("id").alias("dst"), F.element_at(made, F.col("what")).alias("edge_type"))
    granting = permissions.where("allows = 'grant'").select("who", F.lit(GLOBAL_ADMINISTRATOR), F.lit("AZMGGrantRole"))
    kinds = F.when(F.col("cap") == "reset", "AZResetPassword").otherwise("AZAddSecret")
    caps = capabilities(nodes)
    by_role = caps.join(victims, F.col("cap") == F.col("what")).select("role", "id", kinds)
    scoped = grants.where("scope <> '/'").join(caps, "role").withColumn("last", F.element_at(F.split("scope", "/"), -1))
    in_unit = scoped.where(F.col("scope").startswith("/ADMINISTRATIVEUNITS/")).join(units, F.col("last") == F.col("unit")).select("who", "cap", F.col("member").alias("at"))
    on_one = scoped.where(~F.col("scope").startswith("/ADMINISTRATIVEUNITS/")).select("who", "cap", F.col("last").alias("at"))
    by_scope = in_unit.union(on_one).join(victims, (F.col("at") == F.col("id")) & (F.col("cap") == F.col("what"))).select("who", "id", kinds)
    return reduce(DataFrame.union, [by_permission, granting, by_role, by_scope]).where("src <> dst").distinct().join(edges, EDGE, "left_anti")


def unresolved_scopes(nodes: DataFrame, grants: DataFrame, units: DataFrame) -> DataFrame:
    """(who, role, scope): grants for units that weren't collected."""
    scoped = grants.where("scope like '/ADMINISTRATIVEUNITS/%'").join(capabilities(nodes).select("role").distinct(), "role", "left_semi")
    return scoped.withColumn("unit", F.element_at(F.split("scope", "/"), -1)).join(units, "unit", "left_anti").select("who", "role", "scope")
