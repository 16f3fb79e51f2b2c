"""Facts that lie beside a collection, and what is left after fixes."""

import json

from pyspark.sql import functions as F

from wardgraph.functions import scalars
from wardgraph.operators import paths, scoring, sidecars, tiering
from wardgraph.sources import sidecars as files

EDGE = "src string, dst string, edge_type string"


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def scanned(spark, **texts):
    return spark.createDataFrame([(f"/in/{n}.json", t if isinstance(t, str) else json.dumps(t)) for n, t in texts.items()], "file string, text string")


def test_hosts_are_found_by_either_name(spark):
    data = {"data": [{"FQDN": "a.corp", "Computer": "B", "LocalAdmins": ["U1", "U9", None, ""], "Sessions": ["U2"]}, {"FQDN": None, "Computer": "b", "RemoteDesktopUsers": ["U1"]}, {"Computer": "zz", "Sessions": ["U1"]}, {}, 5]}
    facts = files.host_facts(scanned(spark, x_localsessions=data, bad_localsessions="{", other={"data": []}))
    nodes = spark.createDataFrame([("H1", "A@CORP", "Computer", "A.CORP"), ("H2", "B$@CORP", "Computer", None), ("H3", "B@X", "Computer", None), ("U1", "u1", "User", None), ("U2", "u2", "User", None)], "object_id string, name string, node_type string, dnshostname string")
    assert rows(sidecars.host_edges(facts, nodes)) == [("H1", "U2", "HasSession"), ("U1", "H1", "AdminTo"), ("U1", "H2", "CanRDP")]
    assert rows(sidecars.host_edges(facts, nodes.drop("dnshostname"))) == [("H2", "U2", "HasSession"), ("U1", "H2", "AdminTo"), ("U1", "H2", "CanRDP")]


def test_policy_grants(spark):
    data = {"data": [{"GPO": "{aa-1}", "Rights": {"SeDebugPrivilege": ["s-1", "s-2"], "SeShutdownPrivilege": ["s-3"]}}, {"GPO": "", "Rights": {"SeTcbPrivilege": ["s-4"]}}, {"GPO": "b"}]}
    assert rows(files.policy_grants(scanned(spark, x_gporights=data))) == [("AA-1", "SeDebugPrivilege", "S-1"), ("AA-1", "SeDebugPrivilege", "S-2")]


def test_repositories(spark):
    data = {"meta": {"provider": "GitHub"}, "data": [{"repo": "o/r", "principals": [{"id": "u1"}, {"id": "nobody"}, {}]}, {"repo": "O/S", "principals": []}, {"repo": "o/untrusted", "principals": [{"id": "u1"}]}, {"repo": " "}]}
    pushers = files.pushers(scanned(spark, x_cicd=data))
    nodes = spark.createDataFrame([("U1",), ("APP1",), ("APP2",)], "object_id string")
    edges = spark.createDataFrame([("F1", "APP1", "AZAuthenticatesTo"), ("F2", "APP2", "AZAuthenticatesTo"), ("F3", "GONE", "AZAuthenticatesTo")], EDGE)
    hub = "https://token.actions.githubusercontent.com"
    credentials = spark.createDataFrame([("F1", hub, "repo:O/R:ref:refs/heads/main"), ("F2", hub, "repo:o/s"), ("F3", hub, "repo:o/untrusted:*")], "credential string, issuer string, subject string")
    assert rows(sidecars.repository_edges(pushers, credentials, nodes, edges)) == [("CICD:GITHUB:O/R", "APP1", "AZAuthenticatesTo"), ("CICD:GITHUB:O/S", "APP2", "AZAuthenticatesTo"), ("U1", "CICD:GITHUB:O/R", "MemberOf")]


def test_subjects(spark):
    hub = "https://token.actions.githubusercontent.com"
    cases = [
        (hub, "repo:o/r:ref:refs/heads/x", "github", "o/r", False),
        (hub, "repo:o/r:environment:prod*", "github", "o/r", False),
        (hub, "repo:o/r:pull_request", "github", "o/r", True),
        (hub, "repo:o/r", "github", "o/r", True),
        (hub, "junk*", "github", None, False),
        ("https://gitlab.com", "project_path:g/p:ref_type:branch:ref:main", "gitlab", "g/p", False),
        ("https://gitlab.com", "project_path:g/p:ref_type:tag", "gitlab", "g/p", True),
        ("https://vstoken.dev.azure.com/1", "sc://o/p/c", "azuredevops", None, False),
        ("https://else.example/x", "y", "other", None, True),
        (None, None, "entra", None, True),
    ]
    df = spark.createDataFrame([(i, *c[:2]) for i, c in enumerate(cases)], "n int, issuer string, subject string")
    found = df.select("n", scalars.federation_subject(F.col("issuer"), F.col("subject")).alias("x")).select("n", "x.*").orderBy("n").collect()
    assert [tuple(r)[1:] for r in found] == [c[2:] for c in cases]


def test_paths_by_node_edge_and_name(spark):
    ps = spark.createDataFrame([("p1", "T", 2, ["a", "b", "T"], ["AdminTo", "MemberOf"]), ("p2", "T", 1, ["b", "T"], ["GenericAll"]), ("p3", "V", 1, ["a", "V"], ["AdminTo"])], "path_id string, target string, length int, nodes array<string>, edge_types array<string>")
    nodes = spark.createDataFrame([("T", "Vault@X"), ("V", None)], "object_id string, name string")
    ids = lambda df: sorted(r[0] for r in df.select("path_id").collect())
    assert ids(paths.through_node(ps, "b")) == ["p1", "p2"]
    assert ids(paths.through_edge(ps, "b", "T", "MemberOf")) == ["p1"] and ids(paths.through_edge(ps, "b", "T", "AdminTo")) == []
    assert ids(paths.onto_named(ps, nodes, "vault", 1)) == ["p2"]
    assert rows(tiering.induced(spark.createDataFrame([("a", "b", "x"), ("a", "c", "x")], EDGE), spark.createDataFrame([("a",), ("b",), ("b",)], "id string"))) == [("a", "b", "x")]


def test_residual_points(spark):
    """Two ways in: the first fix closes that of three principals, the other two are what is left to watch."""
    da = "S-1-5-21-0-512"
    nodes = spark.createDataFrame([(i, i, "User", True, False) for i in "abcdxy"] + [(da, "DOMAIN ADMINS", "Group", True, False)], "object_id string, name string, node_type string, enabled boolean, admin_count boolean")
    edges = spark.createDataFrame([*[(i, "x", "ForceChangePassword") for i in "ab"], ("x", da, "GenericAll"), ("c", "y", "WriteDacl"), ("y", da, "WriteDacl")], EDGE)
    ps = paths.with_ids(paths.enumerate_paths(nodes, edges, tiering.tier0(nodes, edges)))
    assert rows(scoring.residual_points(nodes, edges, ps, 1, 1)) == [(1, "y", da, "WriteDacl", 2, 2, 100.0)]
    assert rows(scoring.residual_points(nodes, edges, ps, 2, 5)) == []


def test_chains_of_properties(spark):
    node = "object_id string, name string, node_type string, enabled boolean"
    data = [("u", "u", "User", True, True, True, None), ("v", "v", "User", None, None, None, None), ("h", "web1.x", "Computer", True, False, True, True), ("d", "dc1.x", "Computer", True, False, False, True), ("t", None, "CertTemplate", True, None, None, None)]
    nodes = spark.createDataFrame(data, node + ", hasspn boolean, dontreqpreauth boolean, unconstraineddelegation boolean")
    made = [("p1", ["v", "u"], ["GenericAll"]), ("p2", ["u", "v"], ["MemberOf"]), ("p3", ["v", "h"], ["AdminTo"]), ("p4", ["v", "d"], ["AdminTo"]), ("p5", ["v", "t"], ["WriteDacl"]), ("p6", ["v", "t"], ["Enroll"]), ("p7", ["v", "d"], ["GoldenCert"])]
    ps = spark.createDataFrame(made, "path_id string, nodes array<string>, edge_types array<string>")
    none = spark.createDataFrame([], EDGE)
    by_edges = [("p7", "adcs_abuse")]
    assert rows(paths.chains(ps, nodes, none)) == sorted([("p1", "kerberoast"), ("p2", "asrep_roasting"), ("p3", "unconstrained_delegation"), ("p5", "adcs_abuse"), *by_edges])
    assert rows(paths.chains(ps, nodes.drop("hasspn", "dontreqpreauth", "unconstraineddelegation"), none)) == sorted([("p5", "adcs_abuse"), *by_edges])
