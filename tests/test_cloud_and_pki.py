"""Cloud collections and certificate services, from items as collectors write them."""

import json
import random

import pytest

from wardgraph.operators import access, adcs, audit, cloud, derive
from wardgraph.sources import cloud as source
from wardgraph.sources import collections, pki

GA, HELPDESK, APPADMIN = "62E90394-69F5-4237-9190-012177145E10", "729827E3-9C14-49F7-BB1B-9608F156BBB8", "9B895D92-2CD3-44C7-9D02-A6AC2D5EA5C3"


def rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def parsed(spark, *files):
    return collections.parse(spark.createDataFrame([(f"{i}.json", json.dumps(f)) for i, f in enumerate(files)], "file string, text string"))[0]


@pytest.fixture(scope="module")
def tenant(spark):
    user = lambda x, **more: {"kind": "AZUser", "data": {"id": x, "displayName": x, "userPrincipalName": f"{x}@corp", **more}}
    return source.items(
        parsed(
            spark,
            {
                "meta": {"type": "azure"},
                "data": [
                    user("u1", onPremisesSecurityIdentifier="S-1-5-21-1-1105"),
                    user("u2", onPremisesSecurityIdentifier="S-1-5-21-1-9999"),
                    user("boss"),
                    user("lonely"),
                    {"kind": "AZGroup", "data": {"id": "g1", "displayName": "team"}},
                    {"kind": "AZGroupMember", "data": {"groupId": "g1", "members": [{"member": {"id": "u2"}}, {"member": {"id": "u1"}}]}},
                    {"kind": "AZGroupOwner", "data": {"groupId": "g1", "owners": [{"owner": {"id": "u1"}}]}},
                    {"kind": "AZApp", "data": {"id": "app1", "appId": "A-1", "displayName": "app"}},
                    {"kind": "AZServicePrincipal", "data": {"id": "sp1", "appId": "a-1", "displayName": "app"}},
                    {"kind": "AZServicePrincipal", "data": {"id": "sp2", "appId": "a-2", "displayName": "other"}},
                    {"kind": "AZRole", "data": {"id": GA, "displayName": "Global Administrator"}},
                    {"kind": "AZRole", "data": {"id": HELPDESK, "displayName": "Helpdesk Administrator"}},
                    {"kind": "AZRole", "data": {"id": "custom", "displayName": "Custom", "rolePermissions": [{"allowedResourceActions": ["microsoft.directory/servicePrincipals/credentials/update"]}]}},
                    {"kind": "AZRoleAssignment", "data": {"roleDefinitionId": GA, "roleAssignments": [{"principalId": "boss", "directoryScopeId": "/"}]}},
                    {"kind": "AZRoleAssignment", "data": {"roleDefinitionId": HELPDESK, "roleAssignments": [{"principalId": "g1", "directoryScopeId": "/administrativeUnits/unit1"}, {"principalId": "u1", "directoryScopeId": "/administrativeUnits/lost"}]}},
                    {"kind": "AZRoleEligibilityScheduleInstance", "data": {"roleDefinitionId": "custom", "principalId": "lonely", "directoryScopeId": "/"}},
                    {"kind": "AZAdministrativeUnit", "data": {"id": "unit1", "members": [{"id": "u1"}, {"id": "boss"}]}},
                    {"kind": "AZAppRoleAssignment", "data": {"principalId": "sp2", "appRoleId": "1bfefb4e-e0b5-418b-a88f-73c46d2cc8e9", "resourceDisplayName": "Microsoft Graph"}},
                    {"kind": "AZAppRoleAssignment", "data": {"principalId": "sp1", "appRoleId": "1bfefb4e-e0b5-418b-a88f-73c46d2cc8e9", "resourceDisplayName": "Other API"}},
                    {"kind": "AZFederatedIdentityCredential", "data": {"appId": "A-1", "fics": [{"fic": {"id": "f1", "name": "ci", "issuer": "https://x", "subject": "repo:a/b:ref:refs/heads/main"}}]}},
                    {"kind": "AZSubscription", "data": {"subscriptionId": "s-1", "displayName": "prod"}},
                    {"kind": "AZResourceGroup", "data": {"id": "/subscriptions/s-1/rg", "subscriptionId": "/subscriptions/s-1", "name": "rg"}},
                    {"kind": "AZVM", "data": {"id": "/subscriptions/s-1/rg/vm", "resourceGroupId": "/subscriptions/s-1/rg", "name": "vm", "identity": {"principalId": "sp1", "userAssignedIdentities": {"x": {"principalId": "sp2"}}}}},
                    {"kind": "AZSubscriptionOwner", "data": {"subscriptionId": "s-1", "owners": [{"owner": {"properties": {"principalId": "u2"}}}]}},
                    {"kind": "AZVMRoleAssignment", "data": {"virtualMachineId": "/subscriptions/s-1/rg/vm", "roleAssignments": [{"a": {"properties": {"principalId": "u1", "roleDefinitionId": "/x/1c0163c0-47e6-4577-8991-ea5c82e286e4"}}}, {"a": {"properties": {"principalId": "u1", "roleDefinitionId": "/x/unknown"}}}]}},
                    {"kind": "AZKeyVaultAccessPolicy", "data": {"objectId": "sp1", "keyVaultId": "v1", "permissions": {"secrets": ["Get"], "keys": ["list"], "certificates": ["all"]}}},
                ],
            },
        )
    )


def test_cloud_edges(tenant):
    assert set(rows(source.edges(tenant), "src", "dst", "edge_type")) == {
        ("U1", "G1", "MemberOf"), ("U2", "G1", "MemberOf"), ("U1", "G1", "AZOwns"), ("U2", "/SUBSCRIPTIONS/S-1", "AZOwner"), ("U1", "/SUBSCRIPTIONS/S-1/RG/VM", "AZVMAdminLogin"),
        ("/SUBSCRIPTIONS/S-1", "/SUBSCRIPTIONS/S-1/RG", "AZContains"), ("/SUBSCRIPTIONS/S-1/RG", "/SUBSCRIPTIONS/S-1/RG/VM", "AZContains"),
        ("/SUBSCRIPTIONS/S-1/RG/VM", "SP1", "AZManagedIdentity"), ("/SUBSCRIPTIONS/S-1/RG/VM", "SP2", "AZManagedIdentity"), ("SP1", "V1", "AZGetSecrets"), ("SP1", "V1", "AZGetCertificates"),
    }
    assert rows(source.unevaluated_roles(tenant), "definition", "n") == [("UNKNOWN", 1)]
    kinds = dict(rows(source.nodes(tenant), "object_id", "node_type"))
    assert kinds["U1"] == "AZUser" and kinds["/SUBSCRIPTIONS/S-1"] == "AZSubscription" and len(kinds) == 14


def test_cloud_derivation(spark, tenant):
    nodes, edges, grants = source.nodes(tenant), source.edges(tenant), source.grants(tenant)
    collected = spark.createDataFrame([("S-1-5-21-1-1105",)], "id string")
    linked = cloud.linked(nodes, edges, grants, source.credentials(tenant), collected)
    assert set(rows(linked, "src", "dst", "edge_type")) == {
        ("BOSS", GA, "MemberOf"), ("LONELY", "CUSTOM", "AZEligibleRole"), ("APP1", "SP1", "AZRunsAs"), ("F1", "APP1", "AZAuthenticatesTo"), ("S-1-5-21-1-1105", "U1", "SyncedTo"),
    }
    every = edges.union(linked)
    found = cloud.fan_out(nodes, every, grants, source.permissions(tenant), source.units(tenant))
    assert set(rows(found, "src", "dst", "edge_type")) == {
        (HELPDESK, "U1", "AZResetPassword"), (HELPDESK, "U2", "AZResetPassword"), (HELPDESK, "LONELY", "AZResetPassword"), ("G1", "U1", "AZResetPassword"),
        ("CUSTOM", "APP1", "AZAddSecret"), ("CUSTOM", "SP2", "AZAddSecret"), ("SP2", "APP1", "AZMGAddSecret"),
    }
    assert rows(cloud.unresolved_scopes(nodes, grants, source.units(tenant)), "who", "scope") == [("U1", "/ADMINISTRATIVEUNITS/LOST")]


TEMPLATE = {"enrolleesuppliessubject": True, "authenticationenabled": True, "requiresmanagerapproval": False, "schemaversion": 1, "authorizedsignatures": 0, "ekus": []}


def lab(k, template=None, thumbprints=("AA",), enrol_ca=True):
    """Files of a domain of its own (ids end in k), where a user is in a group that may enrol in one template of one authority."""
    enrol = [{"PrincipalSID": f"G{k}", "RightName": "Enroll"}]
    return [
        {"meta": {"type": "domains"}, "data": [{"ObjectIdentifier": f"D{k}", "Properties": {"name": f"CORP{k}"}}]},
        {"meta": {"type": "groups"}, "data": [{"ObjectIdentifier": f"G{k}", "Properties": {"name": "STAFF"}, "Members": [{"ObjectIdentifier": f"U{k}"}]}]},
        {"meta": {"type": "users"}, "data": [{"ObjectIdentifier": f"U{k}", "Properties": {"name": "ALICE"}}]},
        {"meta": {"type": "certtemplates"}, "data": [{"ObjectIdentifier": f"T{k}", "Properties": {"name": "WEB", **TEMPLATE, **(template or {})}, "Aces": enrol}]},
        {"meta": {"type": "enterprisecas"}, "data": [{"ObjectIdentifier": f"CA{k}", "Properties": {"name": f"CA{k}@CORP{k}", "domain": f"corp{k}", "certthumbprint": f"{k}aa"}, "EnabledCertTemplates": [{"ObjectIdentifier": f"T{k}"}], "Aces": enrol if enrol_ca else []}]},
        {"meta": {"type": "ntauthstores"}, "data": [{"ObjectIdentifier": f"NT{k}", "Properties": {"domain": f"CORP{k}", "certthumbprints": [f"{k}{t}" for t in thumbprints]}, "Aces": [{"PrincipalSID": f"P{k}", "RightName": "WriteDacl"}]}]},
        {"meta": {"type": "adcsrelay"}, "data": [{"CA": f"ca{k}", "WebEnrollment": {"Http": False, "Https": True, "ExtendedProtection": "Unknown", "Collected": True}}]},
    ]


#: Each takes one condition away from the first.
LABS = [{}, {"template": {"requiresmanagerapproval": True}}, {"template": {"authorizedsignatures": 1}}, {"template": {"enrolleesuppliessubject": False}}, {"thumbprints": ["BB"]}, {"enrol_ca": False}]


def test_certificate_abuse_needs_every_condition(spark):
    objects = parsed(spark, *[f for k, change in enumerate(LABS) for f in lab(k, **change)])
    ca, top = pki.authorities(objects), spark.createDataFrame([("D0",)], "id string")
    found = adcs.derive(collections.nodes(objects), collections.edges(objects), top, pki.templates(objects), ca, pki.published(objects), pki.stores(objects), pki.issuance_policies(objects), pki.controllers(objects), pki.relay_facts(objects, ca))
    controls = {(f"P{k}", f"D{k}", "ADCSESC5") for k in range(len(LABS))}
    assert set(rows(found, "src", "dst", "edge_type")) == controls | {("G0", "D0", "ADCSESC1"), ("G0", "D0", "ADCSESC15")}


def test_highest_holders(spark):
    edges = spark.createDataFrame([("u", "a", "MemberOf"), ("u", "b", "MemberOf"), ("v", "u", "MemberOf"), ("x", "y", "MemberOf"), ("y", "x", "MemberOf")], "src string, dst string, edge_type string")
    rights = spark.createDataFrame([("k", 1, "a"), ("k", 2, "b"), ("l", 1, "x"), ("l", 2, "y"), ("m", 1, "a"), ("m", 2, "nobody"), ("n", 1, "a")], "k string, need int, id string")
    assert rows(adcs.highest_holders(rights, edges, ["k"]), "k", "id") == [("k", "u"), ("l", "x"), ("l", "y")]


def test_equal_rights_are_followed_once(spark, monkeypatch):
    """Forty templates and fifty members of a group: neither a row for each template and member, nor one for each member."""
    made, fixpoint = [], adcs.semi_naive

    def counted(*args):
        found = fixpoint(*args)
        made.append(found.count())
        return found

    monkeypatch.setattr(adcs, "semi_naive", counted)
    files = lab(0)
    files[1]["data"][0]["Members"] = [{"ObjectIdentifier": f"U{i}"} for i in range(50)]
    files[3]["data"] = [{**files[3]["data"][0], "ObjectIdentifier": f"T{i}"} for i in range(40)]
    files[4]["data"][0]["EnabledCertTemplates"] = [{"ObjectIdentifier": f"T{i}"} for i in range(40)]
    objects = parsed(spark, *files)
    ca = pki.authorities(objects)
    found = adcs.derive(collections.nodes(objects), collections.edges(objects), spark.createDataFrame([("D0",)], "id string"), pki.templates(objects), ca, pki.published(objects), pki.stores(objects), pki.issuance_policies(objects), pki.controllers(objects), pki.relay_facts(objects, ca))
    assert set(rows(found, "src", "dst", "edge_type")) == {("P0", "D0", "ADCSESC5"), ("G0", "D0", "ADCSESC1"), ("G0", "D0", "ADCSESC15")}
    assert sum(made) < 60


def test_highest_holders_are_those_of_a_plain_search(spark):
    rng = random.Random(6)
    edges = {(f"u{i}", f"g{g}") for i in range(30) for g in rng.sample(range(6), rng.randint(1, 2))} | {(f"g{a}", f"g{b}") for a, b in ((0, 1), (1, 2), (3, 4), (4, 3))}
    rights = {(f"k{k}", n, rng.choice([f"g{rng.randrange(6)}", f"u{rng.randrange(30)}"])) for k in range(6) for n in (1, 2) for _ in range(3)}
    up = lambda x: {b for a, b in edges if a == x}

    def above(x):
        seen, front = {x}, {x}
        while front := {y for z in front for y in up(z)} - seen:
            seen |= front
        return seen

    want, people = set(), {x for e in edges for x in e}
    for k in {k for k, *_ in rights}:
        full = {x for x in people if all(any((k, n, y) in rights for y in above(x)) for n in (1, 2))}
        high = {x for x in full if not up(x) & full}
        want |= {(k, x) for x in full if x in high or not above(x) & high}
    found = adcs.highest_holders(spark.createDataFrame(sorted(rights), "k string, need int, id string"), spark.createDataFrame([(*e, "MemberOf") for e in sorted(edges)], "src string, dst string, edge_type string"), ["k"])
    assert rows(found, "k", "id") == sorted(want) and len(want) > 20


def test_more_ways_in(spark):
    objects = parsed(
        spark,
        {"meta": {"type": "computers"}, "data": [{"ObjectIdentifier": "C", "Properties": {}, "ContainedBy": {"ObjectIdentifier": "OU"}, "LocalGroups": [{"ObjectIdentifier": "C-544", "Results": [{"ObjectIdentifier": "A"}]}, {"ObjectIdentifier": "C-999", "Results": [{"ObjectIdentifier": "B"}]}], "DumpSMSAPassword": [{"ObjectIdentifier": "M"}]}]},
        {"meta": {"type": "ous"}, "data": [{"ObjectIdentifier": "OU", "Properties": {}, "GPOChanges": {"AffectedComputers": [{"ObjectIdentifier": "C"}], "RemoteDesktopUsers": [{"ObjectIdentifier": "R"}]}}]},
        {"meta": {"type": "users"}, "data": [{"ObjectIdentifier": "S", "Properties": {}, "SPNTargets": [{"ComputerSID": "C", "Service": "SQLAdmin"}, {"ComputerSID": "C", "Service": "other"}]}]},
        {"meta": {"type": "edges"}, "data": [{"source": "X", "target": "Y", "Kind": "GenericAll"}]},
    )
    edges = collections.edges(objects)
    assert rows(edges, "src", "dst", "edge_type") == [("A", "C", "AdminTo"), ("C", "M", "ReadGMSAPassword"), ("OU", "C", "Contains"), ("R", "C", "CanRDP"), ("S", "C", "SQLAdmin"), ("X", "Y", "GenericAll")]
    named = derive.name_uncollected(collections.nodes(objects), spark.createDataFrame([("S-1-5-21-1-2-3-513", "CORP.LOCAL-S-1-5-11", "x"), ("odd", None, "x")], "src string, dst string, edge_type string"))
    assert rows(named, "object_id", "name") == [("CORP.LOCAL-S-1-5-11", "AUTHENTICATED USERS@CORP.LOCAL"), ("S-1-5-21-1-2-3-513", "DOMAIN USERS")]


def policy(spark, **changes):
    base = {"id": "p1", "displayName": "Admins", "state": "enabled", "conditions": {"users": {"includeUsers": ["All"], "excludeUsers": ["boss"]}, "applications": {"includeApplications": ["All"]}}, "grantControls": {"operator": "OR", "builtInControls": ["mfa"]}}
    return access.policies(parsed(spark, [{**base, **changes}]))


def test_sign_in_policies(spark):
    nodes = spark.createDataFrame([("BOSS", "BOSS", "AZUser"), ("ADA", "ADA", "AZUser"), ("BEN", "BEN", "AZUser"), ("G", "G", "AZGroup")], "object_id string, name string, node_type string")
    edges = spark.createDataFrame([("BOSS", GA, "MemberOf"), ("ADA", "G", "MemberOf"), ("G", GA, "MemberOf")], "src string, dst string, edge_type string")
    found = lambda rules: {(r["finding"], r["object_id"]) for r in access.gaps(nodes, edges, rules).collect()}
    legacy = ("ca-legacy-auth", "tenant")
    assert found(policy(spark)) == {("ca-admin-uncovered", "BOSS"), ("ca-admin-excluded", "BOSS"), legacy}
    none = {("ca-no-admin-mfa", "BOSS"), ("ca-no-admin-mfa", "ADA"), legacy}
    assert found(policy(spark, state="enabledForReportingButNotEnforced")) == none | {("ca-report-only", "ADA")}
    assert found(policy(spark, grantControls={"operator": "OR", "builtInControls": ["mfa", "compliantDevice"]})) == none
    groups = {"users": {"includeGroups": ["g"]}, "applications": {"includeApplications": ["All"]}}
    assert found(policy(spark, conditions=groups)) == {("ca-admin-uncovered", "BOSS"), legacy}
    blocking = {"users": {"includeUsers": ["All"]}, "clientAppTypes": ["exchangeActiveSync", "other"]}
    assert found(policy(spark, conditions=blocking, grantControls={"builtInControls": ["block"]})) == none - {legacy}


def test_cloud_audit(spark, tenant):
    tiered = source.nodes(tenant).selectExpr("object_id", "name", "node_type", "enabled", "admin_count", "2 tier")
    activations = spark.createDataFrame([("CUSTOM", False, False), (GA, True, False)], "role string, mfa boolean, approval boolean")
    edges = source.edges(tenant).union(spark.createDataFrame([("LONELY", "CUSTOM", "AZEligibleRole"), ("U1", GA, "AZEligibleRole")], "src string, dst string, edge_type string"))
    facts = {"credentials": source.credentials(tenant), "activations": activations, "unevaluated": source.unevaluated_roles(tenant), "policies": policy(spark)}
    found = rows(audit.found(audit.Context(tiered, edges, None, facts)), "finding", "object_id")
    # of the privileged only U1 is in these edges, and the policy for all covers U1
    assert {f for f, _ in found} == {"fic-external-issuer", "pim-activation-no-mfa", "pim-activation-no-approval", "keyvault-secret-readers", "azure-roles-unevaluated", "ca-legacy-auth"}
    assert ("pim-activation-no-mfa", "CUSTOM") in found and ("pim-activation-no-approval", GA) in found and ("keyvault-secret-readers", "V1") in found
    without = rows(audit.found(audit.Context(tiered, edges), ["ca-not-collected", "fic-external-issuer"]), "finding", "object_id")
    assert without == [("ca-not-collected", "tenant")]


def test_weak_encryption(spark):
    tiered = spark.createDataFrame([("1", "krbtgt@c", "User", None, None, 2, 0, False), ("2", "a", "User", True, True, 2, 4, True), ("3", "b", "User", True, None, 2, 4, True), ("4", "c", "Computer", True, None, 2, 7, None), ("5", "d", "User", True, None, 2, 28, True), ("6", "e", "User", True, None, 2, None, True), ("7", "f", "User", False, None, 2, 4, True)], "object_id string, name string, node_type string, enabled boolean, admin_count boolean, tier int, supportedencryptiontypes int, hasspn boolean")
    edges = spark.createDataFrame([], "src string, dst string, edge_type string")
    found = audit.found(audit.Context(tiered, edges), ["weak-kerberos-enc", "weak-kerberos-enc-spn", "weak-kerberos-enc-privileged"])
    assert rows(found, "finding", "object_id") == [("weak-kerberos-enc", "4"), ("weak-kerberos-enc-privileged", "1"), ("weak-kerberos-enc-privileged", "2"), ("weak-kerberos-enc-spn", "3")]
