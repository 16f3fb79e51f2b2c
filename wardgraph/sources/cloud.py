"""Cloud collections: objects, relationships and role grants of the items ``{"kind": "AZ...", "data": {...}}``.

Ids are upper case; a subscription is ``/SUBSCRIPTIONS/<id>`` wherever it is named.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The object type of each kind of item.
TYPES = {
    "AZUser": "AZUser", "AZGroup": "AZGroup", "AZApp": "AZApp", "AZServicePrincipal": "AZServicePrincipal", "AZTenant": "AZTenant", "AZRole": "AZRole",
    "AZSubscription": "AZSubscription", "AZResourceGroup": "AZResourceGroup", "AZManagementGroup": "AZManagementGroup", "AZVM": "AZVM", "AZKeyVault": "AZKeyVault",
    "AZFunctionApp": "AZResource", "AZWebApp": "AZResource", "AZAutomationAccount": "AZResource", "AZLogicApp": "AZResource", "AZVMScaleSet": "AZResource", "AZManagedCluster": "AZResource", "AZContainerRegistry": "AZResource",
}
RESOURCES = [k for k, t in TYPES.items() if t == "AZResource"]
#: Field of a scope's id by the scope's name, and the edge of a resource role by its name or definition.
SCOPES = {"Subscription": "subscriptionId", "ResourceGroup": "resourceGroupId", "ManagementGroup": "managementGroupId", "VM": "virtualMachineId", "KeyVault": "keyVaultId"}
ROLE_EDGES = {"Owner": "AZOwner", "Contributor": "AZContributor", "VMContributor": "AZContributor", "AvereContributor": "AZContributor", "KVContributor": "AZContributor", "UserAccessAdmin": "AZUserAccessAdmin", "AdminLogin": "AZVMAdminLogin"}
DEFINITION_EDGES = {
    "8E3AF657-A8FF-443C-A75C-2FE8C4BCB635": "AZOwner",
    "B24988AC-6180-42A0-AB88-20F7382DD24C": "AZContributor",
    "18D7D88D-D35E-4FB5-A5C3-7773C20A72D9": "AZUserAccessAdmin",
    "9980E02C-C2BE-4D73-94E8-173B1DC7CF3C": "AZContributor",
    "1C0163C0-47E6-4577-8991-EA5C82E286E4": "AZVMAdminLogin",
}
#: Application permissions that lead on, by what they allow.
PERMISSIONS = {
    "9E3F62CF-CA93-4989-B6CE-BF83C28F9FE8": "grant",
    "06B708A9-E830-4DB3-A914-8E69DA51D44F": "grant",
    "1BFEFB4E-E0B5-418B-A88F-73C46D2CC8E9": "secret",
    "62A82D76-70EA-41E2-9197-370581804D09": "member",
    "DBAAE8CF-10B5-4B86-A4A1-F871C94C6695": "member",
    "19DBC75E-C2E2-444C-A770-EC69D8559FC7": "member",
    "741F803B-C850-494E-B5DF-CDE7C675A1CA": "reset",
    "50483E42-D915-4231-9639-7FDB7FD190E5": "reset",
}


def _dict(pairs: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for pair in pairs.items() for x in pair])


def _text(column: str, *paths: str) -> Column:
    return F.coalesce(*[F.try_variant_get(column, p, "string") for p in paths])


def _id(column: str, *paths: str) -> Column:
    return F.upper(_text(column, *paths))


def subscription(value: Column) -> Column:
    bare = F.regexp_extract(F.upper(value), r"^(?:/SUBSCRIPTIONS/)?([^/]+)", 1)
    return F.when(bare != "", F.concat(F.lit("/SUBSCRIPTIONS/"), bare))


def _list(column: str, path: str) -> Column:
    return F.explode(F.try_variant_get(column, path, "array<variant>"))


def items(objects: DataFrame) -> DataFrame:
    """(kind, d) of the cloud items among a collection's objects (o)."""
    rows = objects.select(F.try_variant_get("o", "$.kind", "string").alias("kind"), F.try_variant_get("o", "$.data", "variant").alias("d"))
    return rows.where(F.col("kind").startswith("AZ") & F.col("d").isNotNull())


def nodes(rows: DataFrame) -> DataFrame:
    """object_id, name, node_type, enabled, admin_count, app_id, on_premises_id, synced, assignable, caps (of roles: reset, secret, grant)."""
    named = F.col("node_type").isin("AZResource", "AZVM", "AZResourceGroup", "AZKeyVault")
    actions = F.transform(F.flatten(F.transform(F.coalesce(F.try_variant_get("d", "$.rolePermissions", "array<struct<allowedResourceActions array<string>>>"), F.array()), lambda p: F.coalesce(p["allowedResourceActions"], F.array().cast("array<string>")))), F.lower)
    caps = F.array_compact(
        F.array(
            F.when(F.array_contains("actions", "microsoft.directory/users/password/update"), "reset"),
            F.when(F.arrays_overlap("actions", F.array(F.lit("microsoft.directory/applications/credentials/update"), F.lit("microsoft.directory/serviceprincipals/credentials/update"))), "secret"),
            F.when(F.exists("actions", lambda a: a.rlike("^microsoft.directory/roleassignments/.*(?:alltasks|create)$")), "grant"),
        )
    )
    own = rows.withColumn("node_type", F.element_at(_dict(TYPES), F.col("kind"))).where("node_type is not null").withColumn("actions", actions)
    found = own.select(
        F.when(F.col("kind") == "AZSubscription", subscription(_text("d", "$.id", "$.subscriptionId"))).otherwise(_id("d", "$.id", "$.tenantId", "$.objectId")).alias("object_id"),
        F.upper(F.coalesce(F.when(F.col("kind") == "AZUser", _text("d", "$.userPrincipalName")), _text("d", "$.displayName", "$.defaultDomain"), F.when(named, _text("d", "$.name")), _text("d", "$.id", "$.tenantId"))).alias("name"),
        "node_type",
        F.coalesce(F.try_variant_get("d", "$.accountEnabled", "boolean"), F.lit(True)).alias("enabled"),
        F.lit(None).cast("boolean").alias("admin_count"),
        _id("d", "$.appId").alias("app_id"),
        _text("d", "$.onPremisesSecurityIdentifier").alias("on_premises_id"),
        F.try_variant_get("d", "$.onPremisesSyncEnabled", "boolean").alias("synced"),
        F.try_variant_get("d", "$.isAssignableToRole", "boolean").alias("assignable"),
        caps.alias("caps"),
    )
    return found.where("object_id is not null and object_id <> ''").dropDuplicates(["object_id"])


def grants(rows: DataFrame) -> DataFrame:
    """(who, role, scope, eligible): directory roles, held or to be activated; scope is / for the whole tenant."""
    held = rows.where("kind = 'AZRoleAssignment'").select(_id("d", "$.roleDefinitionId").alias("role"), _text("d", "$.directoryScopeId").alias("outer"), _list("d", "$.roleAssignments").alias("m"))
    held = held.select(_id("m", "$.principalId").alias("who"), "role", F.coalesce(_text("m", "$.directoryScopeId"), F.col("outer")).alias("scope"), F.lit(False).alias("eligible"))
    may = rows.where(F.col("kind").isin("AZRoleEligibilityScheduleInstance", "AZRoleEligibility"))
    may = may.select(_id("d", "$.principalId"), _id("d", "$.roleDefinitionId"), _text("d", "$.directoryScopeId"), F.lit(True))
    out = held.union(may).where("who is not null and role is not null")
    return out.withColumn("scope", F.coalesce(F.nullif(F.upper(F.trim("scope")), F.lit("")), F.lit("/"))).distinct()


def permissions(rows: DataFrame) -> DataFrame:
    """(who, allows): application permissions on the directory's API that lead on: grant, secret, member, reset."""
    api = _text("d", "$.resourceDisplayName")
    found = rows.where("kind = 'AZAppRoleAssignment'").where(F.coalesce(api, F.lit("")).isin("") | F.upper(api).contains("GRAPH"))
    return found.select(_id("d", "$.principalId").alias("who"), F.element_at(_dict(PERMISSIONS), _id("d", "$.appRoleId")).alias("allows")).where("who is not null and allows is not null").distinct()


def activations(rows: DataFrame) -> DataFrame:
    """(role, mfa, approval): what activating an eligible role demands of its user."""
    rules = rows.where("kind = 'AZRoleManagementPolicyAssignment'").select(_id("d", "$.roleDefinitionId").alias("role"), _list("d", "$.policy.rules").alias("m"))
    own = _text("m", "$.id")
    for_user = own.endswith("_EndUser_Assignment") | ((F.lower(_text("m", "$.target.caller")) == "enduser") & (F.lower(_text("m", "$.target.level")) == "assignment"))
    asked = F.transform(F.coalesce(F.try_variant_get("m", "$.enabledRules", "array<string>"), F.array().cast("array<string>")), F.lower)
    rules = rules.where(F.coalesce(for_user, F.lit(False))).select("role", F.array_contains(asked, "multifactorauthentication").alias("mfa"), F.coalesce(F.try_variant_get("m", "$.setting.isApprovalRequired", "boolean"), F.lit(False)).alias("approval"))
    return rules.groupBy("role").agg(F.bool_or("mfa").alias("mfa"), F.bool_or("approval").alias("approval"))


def units(rows: DataFrame) -> DataFrame:
    """(unit, member) of administrative units."""
    found = rows.where("kind = 'AZAdministrativeUnit'").select(_id("d", "$.id").alias("unit"), _list("d", "$.members").alias("m"))
    return found.select("unit", _id("m", "$.member.id", "$.member.objectId", "$.id", "$.objectId").alias("member")).where("unit is not null and member is not null").distinct()


def credentials(rows: DataFrame) -> DataFrame:
    """(credential, name, app_id, issuer, subject): federated credentials."""
    found = rows.where("kind = 'AZFederatedIdentityCredential'").select(_id("d", "$.appId").alias("outer"), _list("d", "$.fics").alias("m"))
    found = found.select(_id("m", "$.fic.id").alias("credential"), F.upper(_text("m", "$.fic.name", "$.fic.id")).alias("name"), F.coalesce(_id("m", "$.appId"), F.col("outer")).alias("app_id"), _text("m", "$.fic.issuer").alias("issuer"), _text("m", "$.fic.subject").alias("subject"))
    return found.where("credential is not null and app_id is not null").distinct()


def _resource_roles(rows: DataFrame) -> DataFrame:
    """(who, scope, role, definition) of role assignments on resources, whatever their wrappers are called."""
    pattern = f"^AZ({'|'.join(SCOPES)})({'|'.join([*ROLE_EDGES, 'RoleAssignment'])})$"
    scope = reduce(lambda other, s: F.when(F.col("scoped") == s[0], _text("d", f"$.{s[1]}")).otherwise(other), SCOPES.items(), F.lit(None).cast("string"))
    named = rows.withColumn("scoped", F.regexp_extract("kind", pattern, 1)).where("scoped <> ''").withColumn("role", F.regexp_extract("kind", pattern, 2))
    named = named.select("role", F.when(F.col("scoped") == "Subscription", subscription(scope)).otherwise(F.upper(scope)).alias("scope"), F.explode(F.map_values(F.try_variant_get("d", "$", "map<string,variant>"))).alias("v"))
    named = named.select("role", "scope", F.explode(F.try_variant_get("v", "$", "array<variant>")).alias("e"))
    on_resource = rows.where(F.col("kind").isin([f"{k}RoleAssignment" for k in RESOURCES])).select(F.lit("RoleAssignment").alias("role"), _list("d", "$.assignees").alias("e"))
    every = named.union(on_resource.select("role", _id("e", "$.objectId").alias("scope"), "e"))
    inner = F.filter(F.map_values(F.try_variant_get("e", "$", "map<string,variant>")), lambda w: F.try_variant_get(w, "$.properties.principalId", "string").isNotNull() | F.try_variant_get(w, "$.principalId", "string").isNotNull())
    every = every.withColumn("w", F.get(inner, 0))
    definition = F.coalesce(_id("w", "$.properties.roleDefinitionId"), _id("e", "$.roleDefinitionId"))
    return every.select(F.coalesce(_id("w", "$.properties.principalId", "$.principalId"), _id("e", "$.principalId")).alias("who"), "scope", "role", F.element_at(F.split(definition, "/"), -1).alias("definition"))


def unevaluated_roles(rows: DataFrame) -> DataFrame:
    """(definition, n): resource roles that no edge is known for."""
    found = _resource_roles(rows).where("role = 'RoleAssignment' and definition <> ''").where(~F.col("definition").isin(list(DEFINITION_EDGES)))
    return found.groupBy("definition").agg(F.count("*").alias("n"))


def edges(rows: DataFrame) -> DataFrame:
    """(src, dst, edge_type): memberships, owners, resource roles, vault policies, containment and managed identities."""
    member = _id("m", "$.member.id", "$.member.objectId", "$.owner.id", "$.owner.objectId", "$.id", "$.objectId")
    members = rows.where("kind = 'AZGroupMember'").select(_id("d", "$.groupId").alias("t"), _list("d", "$.members").alias("m")).select(member.alias("src"), F.col("t").alias("dst"), F.lit("MemberOf").alias("edge_type"))
    owners = rows.where(F.col("kind").isin("AZGroupOwner", "AZAppOwner", "AZServicePrincipalOwner")).select(_id("d", "$.groupId", "$.appId", "$.servicePrincipalId", "$.objectId").alias("t"), _list("d", "$.owners").alias("m"))
    owners = owners.select(member, "t", F.lit("AZOwns"))
    roles = _resource_roles(rows)
    roles = roles.select("who", "scope", F.when(F.col("role") == "RoleAssignment", F.element_at(_dict(DEFINITION_EDGES), F.col("definition"))).otherwise(F.element_at(_dict(ROLE_EDGES), F.col("role"))))
    vault = rows.where("kind = 'AZKeyVaultAccessPolicy'").select(_id("d", "$.objectId").alias("who"), _id("d", "$.keyVaultId").alias("vault"), *[F.transform(F.coalesce(F.try_variant_get("d", f"$.permissions.{f}", "array<string>"), F.array().cast("array<string>")), F.lower).alias(f) for f in ("secrets", "keys", "certificates")])
    may = lambda f, edge: F.when(F.arrays_overlap(f, F.array(F.lit("get"), F.lit("all"))), F.lit(edge))
    vault = vault.select("who", "vault", F.explode(F.array_compact(F.array(may("secrets", "AZGetSecrets"), may("keys", "AZGetKeys"), may("certificates", "AZGetCertificates")))))
    groups = rows.where("kind = 'AZResourceGroup'").select(subscription(_text("d", "$.subscriptionId")), _id("d", "$.id"), F.lit("AZContains"))
    inside = rows.where(F.col("kind").isin("AZVM", "AZKeyVault", *RESOURCES)).select(_id("d", "$.resourceGroupId"), _id("d", "$.id"), F.lit("AZContains"))
    hosts = rows.where(F.col("kind").isin("AZVM", *RESOURCES))
    own = hosts.select(_id("d", "$.id"), _id("d", "$.identity.principalId"), F.lit("AZManagedIdentity"))
    given = hosts.select(_id("d", "$.id").alias("h"), F.explode(F.map_values(F.try_variant_get("d", "$.identity.userAssignedIdentities", "map<string,variant>"))).alias("m")).select("h", _id("m", "$.principalId"), F.lit("AZManagedIdentity"))
    out = reduce(DataFrame.union, [members, owners, roles, vault, groups, inside, own, given])
    return out.where("src is not null and dst is not null and edge_type is not null and src <> dst").distinct()
